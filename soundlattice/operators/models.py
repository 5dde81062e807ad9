"""Model registry and inference: embeddings, classifier heads on them, and a pitch histogram."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Model:
    """A head: its classes, the class whose probability is the feature, and the embedding family it reads."""

    name: str
    classes: tuple[str, ...]
    target: int
    family: str = "effnet"

    @property
    def feature(self) -> str:
        return f"{self.classes[self.target]}_{self.family}"


def _registry() -> dict[str, Model]:
    # Names, classes and target classes of the heads.
    heads = [
        ("approachability_2c", ("not_approachable", "approachable"), 1, "effnet"),
        ("approachability_3c", ("not_approachable", "moderately_approachable", "approachable"), 0, "effnet"),
        ("approachability_regression", ("approachability",), 0, "effnet"),
        ("engagement_2c", ("not_engaging", "engaging"), 1, "effnet"),
        ("engagement_3c", ("not_engaging", "moderately_engaging", "engaging"), 0, "effnet"),
        ("engagement_regression", ("engagement",), 0, "effnet"),
        ("danceability", ("danceable", "not_danceable"), 0, "effnet"),
        ("aggressive", ("aggressive", "non_aggressive"), 0, "effnet"),
        ("happy", ("happy", "non_happy"), 0, "effnet"),
        ("party", ("non_party", "party"), 1, "effnet"),
        ("relaxed", ("non_relaxed", "relaxed"), 1, "effnet"),
        ("sad", ("non_sad", "sad"), 1, "effnet"),
        ("acoustic", ("acoustic", "non_acoustic"), 0, "effnet"),
        ("electronic", ("electronic", "non_electronic"), 0, "effnet"),
        ("instrumental", ("instrumental", "voice"), 0, "effnet"),
        ("gender", ("female", "male"), 0, "effnet"),
        ("tonal", ("tonal", "atonal"), 0, "effnet"),
        ("timbre", ("bright", "dark"), 0, "effnet"),
        ("nsynth_timbre", ("bright", "dark"), 0, "nsynth_effnet"),
        ("musicnn_danceability", ("danceable", "not_danceable"), 0, "MusiCNN"),
        ("musicnn_instrumental", ("instrumental", "voice"), 0, "MusiCNN"),
        ("musicnn_happy", ("happy", "non_happy"), 0, "MusiCNN"),
        ("musicnn_aggressive", ("aggressive", "not_aggressive"), 0, "MusiCNN"),
    ]
    return {h[0]: Model(*h) for h in heads}


REGISTRY = _registry()
EMBEDDINGS = {"effnet": "discogs_effnet_embeddings", "MusiCNN": "msd_musicnn_embeddings"}
DEFAULT_HEADS = ("danceability", "aggressive", "happy", "party", "relaxed", "sad", "acoustic", "electronic", "instrumental", "gender")


def stub_embedding(width: int = 8, hop: int = 8) -> Callable[[np.ndarray], np.ndarray]:
    """Stands in for a trained embedding: windows of the signal against fixed cosines."""
    basis = np.cos(np.outer(np.arange(hop) + 0.5, np.arange(width)) * np.pi / hop)

    def run(x: np.ndarray) -> np.ndarray:
        n = len(x) // hop
        return x[: n * hop].reshape(n, hop) @ basis

    return run


def stub_head(model: Model, width: int = 8) -> Callable[[np.ndarray], np.ndarray]:
    """Stands in for a trained head: softmax of fixed weights (one class: their logistic)."""
    k = len(model.classes)
    weights = (np.add.outer(np.arange(width), 2 * np.arange(k)) % 5 - 2) / 4

    def run(e: np.ndarray) -> np.ndarray:
        z = e @ weights
        if k == 1:
            return 1 / (1 + np.exp(-z))
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    return run


@lru_cache(32)
def _loaded(builder: Callable, *args):
    """Models are built once in a worker."""
    return builder(*args)


def infer(df: DataFrame, key: str, signal: str, heads: tuple[str, ...] = DEFAULT_HEADS, embedding: Callable = stub_embedding, head: Callable = stub_head, embedding_name: str = EMBEDDINGS["effnet"]) -> DataFrame:
    """(key, mean embedding, a feature for each head).

    Heads read the embedding's rows, not their mean, and a feature is the mean over rows of its class's value.  All
    runs in one stage, so the embedding matrix never leaves the worker.  Signals too short for a row give nulls.
    """
    models = [REGISTRY[h] for h in heads]
    kind = df.schema[key].dataType.simpleString()
    names = [m.feature for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = _loaded(embedding)
        classify = [_loaded(head, m) for m in models]
        for batch in batches:
            means, found = [], [[] for _ in models]
            for values in batch.column(1):
                e = embed(np.asarray(values.values, dtype=np.float64)) if values.is_valid else np.zeros((0, 1))
                means.append(e.mean(axis=0).tolist() if len(e) else None)
                for out, m, f in zip(found, models, classify, strict=True):
                    out.append(float(f(e)[:, m.target].mean()) if len(e) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(means, pa.list_(pa.float64())), *(pa.array(x, pa.float64()) for x in found)], [key, embedding_name, *names])

    schema = ", ".join([f"{key} {kind}", f"{embedding_name} array<double>", *(f"{n} double" for n in names)])
    return df.select(key, signal).mapInArrow(run, schema)


def stage_kind(task) -> str:
    """'model' for a registered head or a Model, 'algorithm' for a function; anything else is refused."""
    match task:
        case Model():
            return "model"
        case str() if task in REGISTRY:
            return "model"
        case _ if callable(task):
            return "algorithm"
    raise TypeError(f"no feature stage: {task!r}")
