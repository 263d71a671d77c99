"""Random Fourier features: a linear model on them approximates an RBF kernel machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RandomFourierFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Maps `inputCol` to sqrt(2/D) cos(Wx + b); W and b follow from the seed, so only parameters are saved."""

    inputCol = Param(Params._dummy(), "inputCol", "input vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "output vector column", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "number of random features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    width = Param(Params._dummy(), "width", "length of the input vector", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the projection", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="kernel_features", size=128, gamma=1.0, width=1, seed=42):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="kernel_features", size=128, gamma=1.0, width=1, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, width = self.getOrDefault(self.size), self.getOrDefault(self.width)
        rng = np.random.default_rng(self.getOrDefault(self.seed))
        weights = rng.normal(0.0, np.sqrt(2 * self.getOrDefault(self.gamma)), (width, size))
        shift = rng.uniform(0, 2 * np.pi, size)
        scale = np.sqrt(2.0 / size)

        @F.pandas_udf("array<double>")
        def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                if not len(x):
                    yield pd.Series([], dtype=object)
                    continue
                yield pd.Series(list(scale * np.cos(np.stack(x.to_numpy()) @ weights + shift)))

        values = project(vector_to_array(F.col(self.getOrDefault(self.inputCol))))
        return dataset.withColumn(self.getOrDefault(self.outputCol), array_to_vector(values))
