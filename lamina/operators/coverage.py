"""Range tombstones: for each key the newest sequence number of a tombstone that covers it.

Tombstones are intervals [key, end_key). A sweep turns them into disjoint intervals with the largest
sequence number, so a key meets at most one. Up to DRIVER_TOMBSTONES are swept on the driver and
broadcast; more are swept in buckets of the key space and joined on the bucket.
"""

from __future__ import annotations

import bisect
import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..records import RANGE_TOMBSTONE

DRIVER_TOMBSTONES = 10_000
MOST_BUCKETS = 1024


def sweep(intervals: list[tuple[bytes, bytes, int]]) -> list[tuple[bytes, bytes, int]]:
    """Disjoint [lo, hi) with the largest seq covering each, in order."""
    starts = sorted(x for x in intervals if x[0] < x[1])
    edges = sorted({e for lo, hi, _ in starts for e in (lo, hi)})
    out: list[tuple[bytes, bytes, int]] = []
    heap: list[tuple[int, bytes]] = []
    at = 0
    for lo, hi in zip(edges, edges[1:], strict=False):
        while at < len(starts) and starts[at][0] <= lo:
            heapq.heappush(heap, (-starts[at][2], starts[at][1]))
            at += 1
        while heap and heap[0][1] <= lo:
            heapq.heappop(heap)
        if heap:
            seq = -heap[0][0]
            if out and out[-1][1] == lo and out[-1][2] == seq:
                out[-1] = (out[-1][0], hi, seq)
            else:
                out.append((lo, hi, seq))
    return out


def _bucket(key: Column, bounds: list[bytes], least: int = 0) -> Column:
    """How many bounds are at or below key: a binary search, as a tree of comparisons."""
    if not bounds:
        return F.lit(least)
    mid = len(bounds) // 2
    return F.when(key < F.lit(bounds[mid]), _bucket(key, bounds[:mid], least)).otherwise(_bucket(key, bounds[mid + 1 :], least + mid + 1))


def _spread(rows: list[tuple[int, bytes, bytes, int]], bounds: list[bytes]) -> list[tuple[int, int, bytes, bytes, int]]:
    """Disjoint intervals cut at the bounds, with their bucket."""
    out = []
    for cf, lo, hi, seq in rows:
        b = bisect.bisect_right(bounds, lo)
        while b < len(bounds) and bounds[b] < hi:
            out.append((cf, b, lo, bounds[b], seq))
            lo, b = bounds[b], b + 1
        out.append((cf, b, lo, hi, seq))
    return out


def disjoint_intervals(tombstones: DataFrame) -> tuple[DataFrame | None, list[bytes], bool]:
    """(cf_id, bucket, lo, hi, cov), the bounds of the buckets, and whether it is small."""
    spark = tombstones.sparkSession
    few = tombstones.select("cf_id", "key", "end_key", "seq").limit(DRIVER_TOMBSTONES + 1).collect()
    if not few:
        return None, [], True
    schema = "cf_id int, bucket int, lo binary, hi binary, cov long"
    if len(few) <= DRIVER_TOMBSTONES:
        swept = []
        for cf in sorted({r[0] for r in few}):
            swept += [(cf, lo, hi, s) for lo, hi, s in sweep([(bytes(r[1]), bytes(r[2]), r[3]) for r in few if r[0] == cf])]
        starts = sorted({lo for _, lo, _, _ in swept})
        step = max(1, int(len(starts) ** 0.5))
        bounds = starts[step::step][:MOST_BUCKETS]
        return spark.createDataFrame(_spread(swept, bounds), schema), bounds, True
    sample = tombstones.select("key").sample(min(1.0, 20.0 * MOST_BUCKETS / max(1, tombstones.count())), 1).limit(40 * MOST_BUCKETS).collect()
    keys = sorted({bytes(r[0]) for r in sample})
    bounds = keys[:: max(1, len(keys) // MOST_BUCKETS)][:MOST_BUCKETS]
    first, last = _bucket(F.col("key"), bounds), _bucket(F.col("end_key"), bounds)
    cut = tombstones.where("key < end_key").select("cf_id", "key", "end_key", "seq", F.explode(F.sequence(first, last)).alias("bucket"))
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<binary>")

    def pieces(pdf: pd.DataFrame) -> pd.DataFrame:
        out = sweep([(bytes(a), bytes(b), int(s)) for a, b, s in zip(pdf["lo"], pdf["hi"], pdf["seq"], strict=True)])
        cf, bucket = int(pdf["cf_id"].iloc[0]), int(pdf["bucket"].iloc[0])
        return pd.DataFrame([(cf, bucket, lo, hi, s) for lo, hi, s in out], columns=["cf_id", "bucket", "lo", "hi", "cov"])

    low = F.greatest("key", F.coalesce(F.try_element_at(edges, F.when(F.col("bucket") > 0, F.col("bucket"))), F.col("key")))
    high = F.least("end_key", F.coalesce(F.try_element_at(edges, F.col("bucket") + 1), F.col("end_key")))
    clipped = cut.select("cf_id", "bucket", "seq", low.alias("lo"), high.alias("hi")).where("lo < hi")
    return clipped.groupBy("cf_id", "bucket").applyInPandas(pieces, schema), bounds, False


def with_coverage(points: DataFrame, tombstones: DataFrame | None) -> DataFrame:
    """points with cov: the largest seq of a tombstone covering the row's key, 0 if there is none."""
    if tombstones is None:
        return points.withColumn("cov", F.lit(0).cast("long"))
    intervals, bounds, small = disjoint_intervals(tombstones)
    if intervals is None:
        return points.withColumn("cov", F.lit(0).cast("long"))
    right = intervals.select(F.col("cf_id").alias("_cf"), F.col("bucket").alias("_b"), "lo", "hi", F.col("cov").alias("_cov"))
    placed = points.withColumn("_bucket", _bucket(F.col("key"), bounds))
    meets = (F.col("cf_id") == F.col("_cf")) & (F.col("_bucket") == F.col("_b")) & (F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi"))
    joined = placed.join(F.broadcast(right) if small else right, meets, "left")
    return joined.select(*points.columns, F.coalesce("_cov", F.lit(0).cast("long")).alias("cov"))


def covering_seq(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """cf_id, key, cov for every key with a point record."""
    seen = log if as_of is None else log.where(F.col("seq") <= as_of)
    keys = seen.where(F.col("vt") != RANGE_TOMBSTONE).select("cf_id", "key").distinct()
    return with_coverage(keys, seen.where(F.col("vt") == RANGE_TOMBSTONE))
