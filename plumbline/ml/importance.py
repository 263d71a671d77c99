"""Feature importance of a fitted model, summed back to source columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Model, PipelineModel

# Fixed value: length of the importance list.
TOP_FEATURES = 20


def _slot_weights(stage) -> np.ndarray | None:
    if hasattr(stage, "featureImportances"):
        return stage.featureImportances.toArray()
    matrix = getattr(stage, "coefficientMatrix", None)
    if matrix is not None:
        return np.abs(matrix.toArray()).sum(axis=0)
    weights = getattr(stage, "coefficients", None)
    return None if weights is None else np.abs(weights.toArray())


def slot_importance(model: Model, width: int) -> np.ndarray | None:
    """Importance per vector position; None for models that have none."""
    if hasattr(model, "slot_weights"):
        return model.slot_weights
    stages = model.stages if isinstance(model, PipelineModel) else [model]
    found = [w for w in (_slot_weights(s) for s in stages) if w is not None and len(w) == width]
    if not found:
        return None
    return np.sum(found, axis=0) if len(found) > 1 else found[0]


def feature_importance(model: Model, slots: Sequence[tuple[str, str]]) -> dict[str, float]:
    """Importance per source column, normalised when the total is positive, best 20 (a few numbers per column)."""
    weights = slot_importance(model, len(slots))
    if weights is None:
        return {}
    per: dict[str, float] = {}
    for (_, source), w in zip(slots, weights):
        per[source] = per.get(source, 0.0) + float(w)
    total = sum(per.values())
    if total > 0:
        per = {k: v / total for k, v in per.items()}
    return dict(sorted(per.items(), key=lambda kv: (-kv[1], kv[0]))[:TOP_FEATURES])
