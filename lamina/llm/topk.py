"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector's components are quantised to floor(256 * x); each dimension is a term whose postings are
the candidates with a non-zero weight there. Query rows are sparse lists of (term, weight): for
every term, the weighted postings are scattered into a dense array of scores; a partition selection
keeps the k best of a block, and the blocks' lists are merged.

Queries go out in blocks of at most QUERY_BLOCK rows, one after another, and a block's lists are
written before the next goes out: that bounds what is broadcast at any time, whatever the number of
queries. Every block meets all candidates. Each partition sends at most k rows a query to the merge.

Edge cases: rows with a null id, a null vector, or a null or non-finite component take no part;
vectors of other lengths count missing components as zero; an empty vector scores 0; every row is a
candidate and every query row a query, repeated ones too, so an id may be listed several times; rows
that share the query's id are its own; weights beyond 64 bits become the least or largest integer, and
sums wrap around as 64-bit integers do; ties go to the smaller id; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, lean, materialize

by_value(__name__)

QUERY_BLOCK = 16_384
CANDIDATE_BLOCK = 4096
#: Queries scored at once: 64 rows of 4096 scores stay in the processor's cache.
ROWS_AT_ONCE = 64


def usable(vec_id: str, embedding: str) -> Column:
    sound = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & F.coalesce(sound, F.lit(False))


def _quantised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row lengths, and all components one after another."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return lengths, whole_number(256.0 * flat)


def whole_number(x: np.ndarray) -> np.ndarray:
    """floor(x) as a 64-bit integer; what lies beyond its range becomes its least or largest value."""
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    with np.errstate(invalid="ignore"):
        out = np.floor(x).astype(np.int64)
    return np.where(x >= 2.0**63, high, np.where(x < -(2.0**63), low, out))


def _dense(lengths: np.ndarray, flat: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(lengths), width), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    cols = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    fit = cols < width
    out[rows[fit], cols[fit]] = flat[fit]
    return out


def postings(weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every term the candidates with a weight there, and the weights."""
    return [(np.flatnonzero(column), column[column != 0]) for column in np.ascontiguousarray(weights.T)]


def accumulate(queries: np.ndarray, index: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Scores of every query row against n candidates, one term's postings after another."""
    scores = np.zeros((len(queries), n), np.int64)
    for term, (posting, weight) in enumerate(index[: queries.shape[1]]):
        rows = np.flatnonzero(queries[:, term])
        if not len(rows) or not len(posting):
            continue
        gain = np.multiply.outer(queries[rows, term], weight)
        if len(rows) == len(queries) and len(posting) == n:
            scores += gain
        else:
            scores[np.ix_(rows, posting)] += gain
    return scores


def select(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best in each row; of equal scores the earlier columns."""
    n = scores.shape[1]
    if n <= k:
        row, col = np.indices(scores.shape)
        return row.ravel(), col.ravel()
    if max(-int(scores.min(initial=0)), int(scores.max(initial=0))) < 2**62 // n:
        key = scores * n + np.arange(n - 1, -1, -1)
        col = np.argpartition(key, n - k, axis=1)[:, n - k :]
    else:
        col = np.stack([np.lexsort((np.arange(n), -np.maximum(row, -np.iinfo(np.int64).max)))[:k] for row in scores])
    return np.repeat(np.arange(len(scores)), k), col.ravel()


def _best(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k best candidates a query of several lists."""
    q, ids, s = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, -np.maximum(s, -np.iinfo(np.int64).max), q))
    q, ids, s = q[order], ids[order], s[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return q[place < k], ids[place < k], s[place < k]


def _scorer(block, first: int, k: int):
    """The k best of a partition for every row of a block; rows are numbered from first on."""

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = block.value
        kept: list[tuple[np.ndarray, ...]] = []

        def score(ids: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
            weights = _dense(lengths, flat, queries.shape[1])
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            index = postings(weights[order])
            found = []
            for at in range(0, len(queries), ROWS_AT_ONCE):
                scores = accumulate(queries[at : at + ROWS_AT_ONCE], index, len(ids))
                own = query_ids[at : at + ROWS_AT_ONCE]
                lo, hi = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
                most = int((hi - lo).max(initial=0))
                row, col = select(scores, k + most)  # own rows may be among them
                fine = ids[col] != own[row]
                found.append((row[fine] + at, ids[col[fine]], scores[row[fine], col[fine]]))
            kept.append(_best(found, k))
            if len(kept) > 8:
                kept[:] = [_best(kept, k)]

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CANDIDATE_BLOCK:
                whole = pa.Table.from_batches(held).combine_chunks()
                score(whole.column(0).chunk(0).to_numpy(), *_quantised(whole.column(1).chunk(0)))
                held, size = [], 0
        if size:
            whole = pa.Table.from_batches(held).combine_chunks()
            score(whole.column(0).chunk(0).to_numpy(), *_quantised(whole.column(1).chunk(0)))
        if kept:
            q, ids, s = _best(kept, k)
            yield pa.RecordBatch.from_arrays([pa.array(first + q), pa.array(query_ids[q]), pa.array(ids), pa.array(s)], ["row", "query_id", "vec_id", "score"])

    return work


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query rows as (ids, dense matrix), at most QUERY_BLOCK at a time; the driver holds one block."""
    ids: list[int] = []
    rows: list[list[int]] = []

    def block():
        width = max(map(len, rows), default=0)
        out = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
        return np.array(ids, np.int64), out

    for r in queries.toLocalIterator(prefetchPartitions=False):
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == QUERY_BLOCK:
            yield block()
            ids, rows = [], []
    if ids:
        yield block()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k candidates of highest integer inner product for each query: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    candidates = vectors.where(usable(vec_id, embedding)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    asked = queries.where(usable(vec_id, embedding)).select(
        F.col(vec_id).cast("long").alias("query_id"),
        F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("q"),
    )
    schema = "row long, query_id long, vec_id long, score long"
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    done, first = [], 0
    for block in _blocks(asked):
        sent = spark.sparkContext.broadcast(block)
        found = candidates.mapInArrow(_scorer(sent, first, k), schema)
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        done.append(materialize(ranked.select("query_id", "rank", "vec_id", "score"), "top"))
        sent.destroy()  # one block is out at a time
        first += len(block[0])
    if not done:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, done)
