"""A trained model with everything scoring needs, saved as one folder."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


@dataclass
class ModelBundle:
    """Preparation and model as one pipeline, its input columns and class names."""

    name: str
    task: str
    target: str
    features: list[tuple[str, str]]
    labels: list[str] | None
    pipeline: PipelineModel

    @classmethod
    def of(cls, run, trained, df: DataFrame) -> ModelBundle:
        """Bundle one model of a training run; `df` supplies the feature types."""
        types = dict(df.dtypes)
        features = [(c, types[c]) for c in run.preparation.features]
        stages = [*run.prepare.stages, *trained.model.stages]
        return cls(trained.name, run.task, run.target, features, run.labels, PipelineModel(stages))

    def save(self, spark: SparkSession, path: str) -> None:
        self.pipeline.write().overwrite().save(path + "/pipeline")
        meta = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "pipeline"}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(path + "/bundle")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ModelBundle:
        meta = json.loads(spark.read.text(path + "/bundle").first()[0])
        meta["features"] = [tuple(f) for f in meta["features"]]
        return cls(**meta, pipeline=PipelineModel.load(path + "/pipeline"))

