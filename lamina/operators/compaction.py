"""Compaction as plain relations: what to keep, and which files to rewrite."""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.byte_functions import little_endian_u64
from ..records import MERGE_OPERAND, RANGE_TOMBSTONE, TOMBSTONE, VALUE, CompactionStyle, Options
from ..sources.segments import same_key_as_before


def expire(log: DataFrame, now_micros: int) -> DataFrame:
    """Values whose first eight bytes are a time at or before now become tombstones."""
    over = (F.col("vt") == VALUE) & (F.octet_length("val") >= 8) & (little_endian_u64(F.col("val")) <= F.lit(now_micros))
    vt = F.when(over, F.lit(TOMBSTONE)).otherwise(F.col("vt")).cast(log.schema["vt"].dataType)
    return log.withColumns({"vt": vt, "val": F.when(over, F.lit(b"")).otherwise(F.col("val"))})


def keep_needed(log: DataFrame, pinned: Sequence[int] = ()) -> DataFrame:
    """Records that the latest state or a pinned snapshot still reads.

    Range tombstones and operands stay. A value or tombstone stays if no newer one of its key exists,
    or if a pinned snapshot lies between the two.
    """
    base = F.col("vt").isin(TOMBSTONE, VALUE)
    newer = F.lead("seq").over(Window.partitionBy("cf_id", "key", "_base").orderBy("seq", "vt"))
    marked = log.withColumn("_base", base).withColumn("_next", newer)
    stays = ~F.col("_base") | F.col("_next").isNull()
    for p in pinned:
        stays = stays | ((F.col("seq") <= p) & (F.col("_next") > p))
    return marked.where(stays).select(*log.columns)


def keep_needed_small(log: pa.Table, pinned: Sequence[int] = ()) -> pa.Table:
    """keep_needed() for a table on the driver."""
    is_base = pc.is_in(log["vt"], pa.array([TOMBSTONE, VALUE], log["vt"].type))
    order = [("cf_id", "ascending"), ("key", "ascending"), ("seq", "descending"), ("vt", "descending")]
    bases = log.filter(is_base).sort_by(order).combine_chunks()
    older, seq = same_key_as_before(bases), bases["seq"].to_numpy()
    stays = ~older
    for p in pinned:
        stays |= older & (seq <= p) & (np.roll(seq, 1) > p)
    return pa.concat_tables([log.filter(pc.invert(is_base)), bases.filter(pa.array(stays))]).combine_chunks()


def folds_small(log: pa.Table, oldest_read: int) -> bool:
    """Whether fold_untouched() would fold anything in a table on the driver."""
    from .coverage import sweep

    tombstones = log.filter(pc.equal(log["vt"], RANGE_TOMBSTONE)).to_pylist()
    operands = log.filter(pc.and_(pc.equal(log["vt"], MERGE_OPERAND), pc.less_equal(log["seq"], oldest_read)))
    keys = operands.group_by(["cf_id", "key"]).aggregate([])
    for cf in pc.unique(keys["cf_id"]).to_pylist():
        covered = sweep([(r["key"], r["end_key"], r["seq"]) for r in tombstones if r["cf_id"] == cf])
        starts = [lo for lo, _, _ in covered]
        for key in keys.filter(pc.equal(keys["cf_id"], cf))["key"].to_pylist():
            i = bisect.bisect_right(starts, key) - 1
            if i < 0 or key >= covered[i][1]:
                return True
    return False


def fold_operands(log: DataFrame, oldest_read: int, merge) -> DataFrame:
    """Operands at or below the oldest snapshot that is still read, folded into values where a key has
    them; only for keys that no range tombstone meets, which the caller makes sure of."""
    from .resolve import resolve

    old = log.where((F.col("seq") <= oldest_read) & (F.col("vt") != RANGE_TOMBSTONE))
    keys = old.where(F.col("vt") == MERGE_OPERAND).select("cf_id", "key").distinct()
    mine = old.join(keys, ["cf_id", "key"], "left_semi")
    newest = mine.groupBy("cf_id", "key").agg(F.max("seq").alias("seq"))
    values = resolve(mine, merge=merge, has_tombstones=False).join(newest, ["cf_id", "key"])
    folded = values.select("cf_id", "key", "seq", F.lit(VALUE).cast("byte").alias("vt"), "val", F.lit(None).cast("binary").alias("end_key"))
    rest = log.join(keys, ["cf_id", "key"], "left_anti").unionByName(log.join(keys, ["cf_id", "key"], "left_semi").where((F.col("seq") > oldest_read) | (F.col("vt") == RANGE_TOMBSTONE)))
    return rest.unionByName(folded.select(*log.columns))


def fold_untouched(log: DataFrame, oldest_read: int, merge, has_tombstones: bool) -> DataFrame:
    """fold_operands() for the keys that no range tombstone of the log meets; the others stay as they are."""
    if not has_tombstones:
        return fold_operands(log, oldest_read, merge)
    from .coverage import covering_seq

    untouched = covering_seq(log).where("cov = 0").select("cf_id", "key")
    points, tombstones = log.where(F.col("vt") != RANGE_TOMBSTONE), log.where(F.col("vt") == RANGE_TOMBSTONE)
    folded = fold_operands(points.join(untouched, ["cf_id", "key"], "left_semi"), oldest_read, merge)
    return folded.unionByName(points.join(untouched, ["cf_id", "key"], "left_anti")).unionByName(tombstones)


def retained(files: DataFrame, max_bytes: int) -> DataFrame:
    """FIFO: the newest files whose sizes fit max_bytes together. Drops live data by design."""
    upward = Window.orderBy(F.desc("file_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return files.withColumn("_sum", F.sum("file_size").over(upward)).where(F.col("_sum") <= max_bytes).drop("_sum")


def level_target(options: Options, level: int) -> int:
    return options.level1_target_bytes * max(1, options.level_multiplier) ** (level - 1) if level else 2**63 - 1


def level_sizes(files: DataFrame) -> DataFrame:
    """level, n_files, bytes."""
    return files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("file_size").alias("bytes"))


def level_scores(files: DataFrame, options: Options) -> DataFrame:
    """level, bytes, target, score = bytes / target of the levels that can move down."""
    target = F.lit(float(options.level1_target_bytes)) * F.pow(F.lit(float(options.level_multiplier)), F.col("level") - 1)
    inner = level_sizes(files).where((F.col("level") >= 1) & (F.col("level") < options.max_levels - 1))
    return inner.select("level", "bytes", target.alias("target"), (F.col("bytes") / target).alias("score"))


def meets(a: dict, lo: bytes, hi: bytes) -> bool:
    return a["max_key"] >= lo and a["min_key"] <= hi


def overlapping(candidates: Iterable[dict], lo: bytes, hi: bytes) -> tuple[list[dict], bytes, bytes]:
    """Files that meet [lo, hi], widening the range by each one that does, to a fixpoint."""
    left, found = list(candidates), []
    while True:
        more = [f for f in left if meets(f, lo, hi)]
        if not more:
            return found, lo, hi
        found += more
        left = [f for f in left if f not in more]
        lo, hi = min(lo, *(f["min_key"] for f in more)), max(hi, *(f["max_key"] for f in more))


def overlapping_rows(candidates: DataFrame, lo, hi) -> DataFrame:
    """overlapping() for a catalog in rows of lo, hi: the range goes to its fixpoint by one aggregate a step."""
    while True:
        met = candidates.where((F.col("hi") >= F.lit(lo)) & (F.col("lo") <= F.lit(hi)))
        a, b = met.agg(F.least(F.min("lo"), F.lit(lo)), F.greatest(F.max("hi"), F.lit(hi))).first()
        if (a, b) == (lo, hi):
            return met
        lo, hi = a, b


def universal_pick(files: Iterable[dict], options: Options) -> list[dict]:
    """Oldest files whose sizes stay within the ratio of what is picked before; [] if too few.

    An iterable that is no list must come in the order of file_id; no more of it is read than decides.
    """
    least = max(2, options.universal_min_merge_width)
    most = max(least, options.universal_max_merge_width)
    picked: list[dict] = []
    total = 0
    for f in sorted(files, key=lambda f: f["file_id"]) if isinstance(files, list) else files:
        if f["level"] != 0:
            continue
        limit = max(1, total * max(1, options.universal_size_ratio) // 100)
        if len(picked) == most or picked and f["file_size"] > limit:
            break
        picked.append(f)
        total += f["file_size"]
    return picked if len(picked) >= least else []


def pick(files: Sequence[dict], options: Options) -> tuple[str, list[dict], int] | None:
    """The next compaction: (kind, inputs, target level), or None. A trigger is that a pick exists.

    kind: drop (FIFO), merge (rewrite the inputs at the target level), move (metadata only).
    """
    zero = [f for f in files if f["level"] == 0]
    if options.compaction_style is CompactionStyle.FIFO:
        total = sum(f["file_size"] for f in zero)
        gone = []
        for f in sorted(zero, key=lambda f: f["file_id"]):
            if not options.fifo_l0_max_bytes or total <= options.fifo_l0_max_bytes:
                break
            gone.append(f)
            total -= f["file_size"]
        return ("drop", gone, 0) if gone else None
    if options.compaction_style is CompactionStyle.UNIVERSAL:
        # as with the level count, a pick is due only above the least width
        chosen = universal_pick(files, options) if len(zero) > max(2, options.universal_min_merge_width) else []
        return ("merge", chosen, 0) if chosen else None
    if len(zero) > options.l0_slowdown_trigger:
        lo, hi = min(f["min_key"] for f in zero), max(f["max_key"] for f in zero)
        below, _, _ = overlapping([f for f in files if f["level"] == 1], lo, hi)
        return "merge", zero + below, 1
    best: tuple[int, int, int] | None = None
    for level in range(1, max(2, options.max_levels) - 1):
        size, target = sum(f["file_size"] for f in files if f["level"] == level), max(1, level_target(options, level))
        if size > target and (best is None or size * best[2] > best[1] * target):
            best = (level, size, target)
    if best is None:
        return None
    level, size, target = best
    first: list[dict] = []
    for f in files:  # in one go as many files as bring the level below its target
        if f["level"] == level and size > target:
            first.append(f)
            size -= f["file_size"]
    lo, hi = min(f["min_key"] for f in first), max(f["max_key"] for f in first)
    below, _, _ = overlapping([f for f in files if f["level"] == level + 1], lo, hi)
    return ("merge" if below else "move"), [*first, *below], level + 1


def stall_reason(files: Sequence[dict], options: Options, flushing: bool = False) -> str | None:
    """Why a writer would wait now: an unflushed buffer, then too many L0 files, then a due compaction."""
    zero = sum(f["level"] == 0 for f in files)
    if flushing:
        return "imm"
    if zero > options.l0_stop_trigger:
        return "l0_stop"
    return "compaction_needed" if pick(files, options) else None
