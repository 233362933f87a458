"""Bounded labelled samples for the classifiers, and one way to score every text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, held_out, lean, learnable, prepare, text_bytes

by_value(__name__)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, left_out: int, rows: int, longest: int) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most rows labelled documents, by a hash of doc_id, none over longest characters.

    Both bounds are parameters of the classifiers: the driver holds rows * longest characters at most.
    A document without text, and a label that is null, teach nothing; any label but 0 counts as 1; a
    repeated id counts once.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(learnable(modulus, left_out))
    ids = known.groupBy("doc_id").agg(F.min((F.col(label) != 0).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    useful = docs.where(F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", "text")
    found = useful.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: r["doc_id"])
    return [r["text"].encode() for r in found], np.array([r["y"] for r in found], np.int64)


def score_texts(docs: DataFrame, score: Callable[[object, list[bytes]], np.ndarray], model: object, modulus: int, left_out: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; no shuffle."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score(sent.value, text_bytes(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", held_out(modulus, left_out).alias("held_out"), "text")
    return plain.mapInArrow(work, f"doc_id {kind}, held_out boolean, score double, predicted int")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
