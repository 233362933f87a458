"""Resolve: the visible value of every key of a change log as of a sequence number.

Records are grouped by (cf_id, key), combined before the shuffle as far as the operator allows; then
each key, not each record, gets the sequence number of the range tombstone that covers it. Without
merge operands that is one shuffle, and all stays in generated code. Operators that aggregate (sum,
max, min, last, set_union) find a key's newest base first, and aggregate the operands above it in a
second pass over the log: a hot key is combined before the shuffle in both. The others (append, Python
functions) need a key's operands together, as their result does.

Conditions on keys may be applied to the log; conditions on values, types or sequence numbers (but
for the snapshot) only hold above the aggregation, where Catalyst leaves them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..records import MERGE_OPERAND, RANGE_TOMBSTONE, TOMBSTONE, VALUE, KeyRange
from .coverage import with_coverage
from .merge import MergeOperator, merge_operator


#: Ranges of a transaction that are broadcast; with more the engine chooses the join itself.
MOST_RANGES = 10_000


def visible(log: DataFrame, as_of: int | None = None, key_range: KeyRange | None = None, cf_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Point records and range tombstones that matter for a snapshot, range and column family."""
    seen = log
    if cf_id is not None:
        seen = seen.where(F.col("cf_id") == cf_id)
    if as_of is not None:
        seen = seen.where(F.col("seq") <= as_of)
    points, tombstones = seen.where(F.col("vt") != RANGE_TOMBSTONE), seen.where(F.col("vt") == RANGE_TOMBSTONE)
    if key_range is not None:
        points = points.where(key_range.holds(F.col("key")))
        tombstones = tombstones.where(key_range.overlaps(F.col("key"), F.col("end_key")))
    return points, tombstones


def resolve(
    log: DataFrame,
    as_of: int | None = None,
    key_range: KeyRange | None = None,
    cf_id: int | None = None,
    merge: str | MergeOperator | Callable = "append",
    has_tombstones: bool = True,
    has_operands: bool = True,
) -> DataFrame:
    """cf_id, key, val of every visible key. The flags come from file statistics and only save work."""
    points, tombstones = visible(log, as_of, key_range, cf_id)
    operator = merge_operator(merge)
    is_base = F.col("vt").isin(TOMBSTONE, VALUE)
    base = F.max(F.when(is_base, F.struct("seq", "vt", "val"))).alias("b")
    listed = has_operands and operator.reduce is None
    operand = F.when(F.col("vt") == MERGE_OPERAND, F.struct("seq", "val"))
    heads = points.groupBy("cf_id", "key").agg(base, *([F.sort_array(F.collect_list(operand)).alias("o")] if listed else []))
    heads = with_coverage(heads, tombstones if has_tombstones else None)
    cut = F.greatest(F.coalesce("b.seq", F.lit(0).cast("long")), F.col("cov"))
    live = F.when((F.col("b.vt") == VALUE) & (F.col("b.seq") > F.col("cov")), F.col("b.val"))
    if not has_operands:
        return heads.select("cf_id", "key", live.alias("val")).where(F.col("val").isNotNull())
    if listed:
        above = F.transform(F.filter("o", lambda x: x["seq"] > F.col("cut")), lambda x: x["val"])
        ready = heads.withColumn("cut", cut).select("cf_id", "key", live.alias("base"), above.alias("ops")).where("base IS NOT NULL OR size(ops) > 0")
        value = F.when(F.size("ops") == 0, F.col("base")).otherwise(operator.fold(F.col("key"), F.col("base"), F.col("ops")))
        return ready.select("cf_id", "key", value.alias("val")).where(F.col("val").isNotNull())
    heads = heads.select("cf_id", "key", cut.alias("cut"), live.alias("base"))
    operands = points.where(F.col("vt") == MERGE_OPERAND).join(heads.select("cf_id", "key", "cut"), ["cf_id", "key"]).where("seq > cut")
    folded = operands.groupBy("cf_id", "key").agg(operator.reduce(F.col("val"), F.col("seq")).alias("folded"), F.count("*").alias("n"))
    joined = heads.join(folded, ["cf_id", "key"], "left").where("base IS NOT NULL OR n > 0")
    return joined.select("cf_id", "key", operator.combine(F.col("base"), F.col("folded")).alias("val")).where(F.col("val").isNotNull())


def latest_seq(log: DataFrame) -> DataFrame:
    """cf_id, key, seq of the newest record of any type that starts at each key."""
    return log.groupBy("cf_id", "key").agg(F.max("seq").alias("seq"))


def conflicts(reads: DataFrame, log: DataFrame, snapshot: int, ranges: bool = True) -> DataFrame:
    """Keys of a read set (cf_id, key) that the log has changed after the snapshot.

    With ranges, a newer range tombstone over a key is a change too; without, only one that starts there.
    """
    newer = log.where(F.col("seq") > snapshot)
    hit = reads.join(newer.select("cf_id", "key").distinct(), ["cf_id", "key"], "left_semi")
    if ranges:
        over = with_coverage(reads.select("cf_id", "key"), newer.where(F.col("vt") == RANGE_TOMBSTONE)).where("cov > 0").select("cf_id", "key")
        hit = hit.unionByName(over)
    return hit.distinct()


def range_conflicts(ranges: DataFrame, log: DataFrame, snapshot: int) -> DataFrame:
    """Ranges (cf_id, start, end) of a transaction that meet a newer record, point or range."""
    newer = log.where(F.col("seq") > snapshot).select(F.col("cf_id").alias("_cf"), F.col("key").alias("_k"), F.coalesce("end_key", F.concat("key", F.lit(b"\0"))).alias("_e"))
    meets = (F.col("cf_id") == F.col("_cf")) & (F.col("start") < F.col("_e")) & (F.col("_k") < F.col("end"))
    few = ranges.limit(MOST_RANGES + 1).count() <= MOST_RANGES
    return newer.join(F.broadcast(ranges) if few else ranges, meets).select(*ranges.columns).distinct()


def multi_get(resolved: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (cf_id, key) with their val; null where a key is absent."""
    return keys.join(resolved, ["cf_id", "key"], "left")
