"""plumbline: profiling, cleaning, monitoring and AutoML for tables of any size, on PySpark.

Operators take DataFrames and return DataFrames.  Work stays in the JVM unless a
docstring says otherwise, and nothing that grows with the data reaches the driver.
"""

__version__ = "0.1.0"
