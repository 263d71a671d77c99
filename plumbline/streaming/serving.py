"""Scoring and drift checks on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbline.ml.score import score
from plumbline.operators.drift import mean_shift, saved_moments
from plumbline.sources.bundles import ModelBundle


def score_stream(stream: DataFrame, bundle: ModelBundle, keep: list[str] | None = None) -> DataFrame:
    """A streaming frame with predictions: scoring is row by row, so no state is kept."""
    return score(stream, bundle, keep)


def watch_drift(
    stream: DataFrame, baseline: DataFrame, report: Callable[[DataFrame, int], None], checkpoint: str, target: str | None = None, **trigger
) -> StreamingQuery:
    """Compares each micro-batch with `baseline` and hands the per-feature shift to `report`.

    The baseline is read once, for its moments.  The offsets live in `checkpoint`, so a restarted
    query repeats at most one batch.
    """
    moments = saved_moments(baseline, target)

    def compare(batch: DataFrame, number: int) -> None:
        report(mean_shift(baseline, batch, target, moments=moments), number)

    writer = stream.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
