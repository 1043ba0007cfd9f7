"""Quality (naive-Bayes support vectors) and toxicity (factorization machine) of documents.

Training is bounded: of the labelled rows that may be learned from, at most
``per_class`` documents of either label, those with the smallest hash of their
id, go to the driver as feature indices. Scoring runs over every whole text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.llm import features
from locuspark.llm.frames import columns, held_out, map_text, unused
from locuspark.llm.models import FactorizationMachine, NaiveBayesSupportVectors

DIMS = 1 << 18
#: Training documents of either label, at most.
PER_CLASS = 3000


def training_ids(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``doc_id, y``: at most ``per_class`` of either label, none held out. Of clashing labels the larger counts."""
    own = columns(labels, "doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    own = own.groupBy("doc_id").agg(F.max(label).alias("y"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    return own.where("y = 0").orderBy(*by_hash).limit(per_class).union(own.where("y = 1").orderBy(*by_hash).limit(per_class))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, feature: Callable, dims: int, per_class: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature indices, bounds and labels of the sample, ordered by id."""
    ids = training_ids(labels, label, per_class)  # at most 2 * per_class rows, so it may be broadcast
    rows = columns(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def fn(batch: pa.RecordBatch) -> dict:
        idx, at = feature(batch.column("text"), dims)
        return {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "idx": [idx[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]}

    got = map_text(rows.select("doc_id", "text", F.col("y").cast("int").alias("y")), fn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, idx binary").toArrow().sort_by("doc_id")
    parts = [np.frombuffer(x, np.int32) for x in got["idx"].to_pylist()]
    idx = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return idx, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), got["y"].to_numpy()


def quality_model(docs: DataFrame, labels: DataFrame, dims: int = DIMS, per_class: int = PER_CLASS):
    return NaiveBayesSupportVectors(dims).fit(*training_rows(docs, labels, "quality", features.style, dims, per_class))


def toxicity_model(docs: DataFrame, labels: DataFrame, dims: int = DIMS, per_class: int = PER_CLASS):
    return FactorizationMachine(dims).fit(*training_rows(docs, labels, "toxic", features.terms, dims, per_class))


def with_score(docs: DataFrame, model, feature: Callable, name: str, keep: tuple[str, ...], at_least: float | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the score as ``name``; with ``at_least``, only rows that reach it."""
    dims = model.dims
    own = list(dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def fn(batch: pa.RecordBatch) -> dict:
        score = model.score(*feature(batch.column("text"), dims))
        if at_least is not None:
            rows = pa.array(np.flatnonzero(score >= at_least))
            batch, score = batch.take(rows), score[rows.to_numpy()]
        return {**{c: batch.column(c) for c in keep}, name: score}

    return map_text(columns(docs, *own), fn, f"{schema}, `{name}` double")


def scored(docs: DataFrame, model, feature: Callable, threshold: float) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row.

    Null and empty texts get the score of a text without features; without
    labels of both kinds every score is that of the only kind, or one half;
    repeated rows come back repeated; a null doc_id is not held out.
    """
    out = with_score(docs, model, feature, "score", ("doc_id",))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = PER_CLASS) -> DataFrame:
    return scored(docs, quality_model(docs, labels, per_class=per_class), features.style, threshold)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    return scored(docs, toxicity_model(docs, labels, per_class=per_class), features.terms, threshold)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs`` that the quality model accepts, with all their columns.

    Null and empty texts get the score of a text without features; repeated
    rows stay or go together.
    """
    model = quality_model(docs, labels, per_class=per_class)
    return columns(with_score(docs, model, features.style, unused(docs, "score"), tuple(docs.columns), threshold), *docs.columns)
