"""Operators for preparing training text at scale, one module for each, with their queries in `queries`.

What they run on executors travels there by value, so the package need not be installed on them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
