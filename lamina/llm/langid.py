"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD.

A text is the mean of the embeddings of its hashed byte n-grams (case of A-Z ignored); a linear
softmax on that mean gives the languages. Both are trained by stochastic gradient descent in numpy on
whole texts and short snippets of them. On texts kept back from training, a temperature is fitted that
calibrates the probability, and then the rejection threshold: the highest one, up to reject_at_most,
below which no more than the share `lost` of the kept-back texts lie that are identified rightly.

Fitted on a bounded sample of rows with text and lang: sample_rows of them, shared out evenly among the
languages, but least_rows of each language even if that is more; none over sample_longest characters.
Every whole text is scored. Edge cases: a text that is null or has no letter is ``und``, scores 0 and is
rejected; no learnable rows make every text ``und``; ties go to the first language by code point; null
ids keep their row and are not held out; repeated rows are predicted alike; extra columns pass
keep_known().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, held_out, lean, learnable, prepare, text_bytes

by_value(__name__)

BITS = 13
WIDTH = 16
ORDERS = (2, 3, 4)
#: Steps of gradient descent at least, whatever the size of the sample.
STEPS = 2000
LETTER = re.compile(r"[^\W\d_]")
ASCII_LETTER = re.compile(rb"[A-Za-z]")
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # embeddings times softmax weights: what one n-gram adds to each language
    bias: np.ndarray
    temperature: float
    reject_below: float


def counts(text: bytes) -> np.ndarray:
    """How often each bucket occurs among a text's n-grams."""
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    out = np.zeros(1 << BITS)
    h = b
    for n in range(2, max(ORDERS) + 1):
        if len(h) < 2:
            break
        h = h[:-1] * np.uint32(0x01000193) ^ b[n - 1 :]
        if n in ORDERS:
            out += np.bincount((h * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int32), minlength=1 << BITS)
    return out


def _mean(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and the share of each."""
    c = counts(text)
    held = np.flatnonzero(c)
    return held.astype(np.int32), (c[held] / max(1.0, c.sum())).astype(np.float32)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), 1 << BITS), np.float32)
    for row, (held, share) in zip(out, rows, strict=True):
        row[held] = share
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[bytes], langs: list[str], epochs: int = 6, reject_at_most: float = 0.5, lost: float = 0.001, seed: int = 7) -> Model:
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0, reject_at_most)
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(v) for v in langs])
    kept_back = np.arange(len(texts)) % 8 == 7
    snippets, owners = [], []
    for i, t in enumerate(texts):  # short stretches, so that short texts are met in training
        length = int(rng.integers(8, 160))
        at = int(rng.integers(0, max(1, len(t) - length)))
        snippets.append(t[at : at + length])
        owners.append(i)
    x = [_mean(t) for t in texts + snippets]
    target = np.concatenate([y, y[owners]])
    back = np.concatenate([kept_back, kept_back[owners]])
    embed = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    soft = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    learn = np.flatnonzero(~back)
    one_hot = np.eye(len(languages), dtype=np.float32)
    epochs = max(epochs, STEPS * 16 // max(1, len(learn)))  # small samples are gone through more often
    for epoch in range(epochs):
        rate = 1.0 * (1 - epoch / epochs)
        order = rng.permutation(learn)
        for at in range(0, len(order), 16):
            rows = order[at : at + 16]
            part = _dense([x[i] for i in rows])
            used = np.flatnonzero(part.any(0))
            part = part[:, used]
            mean = part @ embed[used]
            error = (_softmax(mean @ soft + bias) - one_hot[target[rows]]) / len(rows)
            grad = error @ soft.T
            soft -= rate * mean.T @ error
            bias -= rate * 0.1 * error.sum(0)
            embed[used] -= rate * 20 * (part.T @ grad)
    table = embed @ soft
    temperature, reject_below = 1.0, reject_at_most
    if back.any():
        logits, truth = np.stack([share @ table[held] for held, share in (x[i] for i in np.flatnonzero(back))]) + bias, target[back]
        tries = np.geomspace(0.25, 8, 41)
        loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-9).mean() for t in tries]
        temperature = float(tries[int(np.argmin(loss))])
        p = _softmax(logits[: kept_back.sum()] / temperature)  # the whole texts; snippets are shorter than documents
        right = np.sort(p.max(1)[p.argmax(1) == truth[: kept_back.sum()]])
        if len(right):
            reject_below = min(reject_at_most, float(right[int(lost * len(right))]))
    return Model(languages, table.astype(np.float64), bias.astype(np.float64), temperature, reject_below)


def predict(model: Model, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Language and calibrated probability of each text."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    for i, text in enumerate(texts):
        if not model.languages or not (ASCII_LETTER.search(text) or LETTER.search(text.decode("utf-8", "replace"))):
            continue
        c = counts(text)
        p = _softmax(((c @ model.table) / max(1.0, c.sum()) + model.bias)[None] / model.temperature)[0]
        names[i], scores[i] = model.languages[int(p.argmax())], float(p.max())
    return names, scores


def learn(docs: DataFrame, modulus: int = 3, left_out: int = 1, sample_rows: int = 3000, sample_longest: int = 10_000, least_rows: int = 50, reject_at_most: float = 0.5, lost: float = 0.001) -> Model:
    """A model from a sample of the learnable rows, chosen by a hash within each language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= sample_longest)).where(learnable(modulus, left_out))
    known = known.where(F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    counts_ = known.groupBy("lang").agg(F.count("*").alias("n"))
    quota = max(least_rows, sample_rows // max(1, counts_.count()))
    # a first cut by hash, so that only about twice the sample is sorted
    span = 1 << 20
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    cut = F.least(F.lit(span), F.ceil((2.0 * quota + 100) / F.col("n") * span))
    thin = known.join(F.broadcast(counts_.select("lang", cut.alias("cut"))), "lang").where(slot < F.col("cut"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(slot, "doc_id", "text"))
    rows = thin.withColumn("nth", nth).where(F.col("nth") <= quota).orderBy("doc_id", "text").select("text", "lang").collect()
    return fit([r["text"].encode() for r in rows], [r["lang"] for r in rows], reject_at_most=reject_at_most, lost=lost)


def identify(docs: DataFrame, model: Model, modulus: int = 3, left_out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, p = predict(sent.value, text_bytes(batch, "text"))
            low = [n == UNKNOWN or s < sent.value.reject_below for n, s in zip(names, p, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(p, pa.float64()), pa.array(low, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", held_out(modulus, left_out).alias("held_out"), "text")
    return plain.mapInArrow(work, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the rows that the model rejects; columns stay as they are."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, p = predict(sent.value, text_bytes(batch, f"c{at}"))
            yield batch.filter(pa.array([n != UNKNOWN and s >= sent.value.reject_below for n, s in zip(names, p, strict=True)], pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(work, plain.schema).toDF(*docs.columns)
