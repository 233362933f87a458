"""Mix sources to target weights by subset-sum budget fitting.

Every source gets a budget of words from its weight. Its documents are counted by exact length; a
length has three times its count to give. A proportional share of every length is taken, and a
bounded-knapsack dynamic program over what is free fills the budget that then remains. So many
documents of a length are taken once more than the others; which ones follows a seeded hash of the row.

Scale: texts are read once, for their lengths; then only (source, length) counts move, and sources are
numbered and given their targets by aggregates, so that no task holds all of them. The histogram of a
source has at most sqrt(2 * its words) rows, since its lengths are distinct. Choosing documents of a
length never sorts a whole length group: groups are counted by hash slot and whole slots are taken; in
the slot on the border whole hashes are, and equal rows, which share a hash, are taken by their number
within each part of the table.

Edge cases: a null source is a source of its own, placed last; null or empty texts have size 0, are
taken whole with their source and never change a budget; sources without words have target 0;
repeated rows are documents of their own and equal rows may be taken unequally; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, materialize, small_table

by_value(__name__)

WORD = r"[^\x20\x09-\x0D]+"
SLOTS = 1024
#: How often a document may be taken.
MOST = 3
#: Largest budget that the dynamic program fills; what is above it is filled by long documents first.
TABLE_WORDS = 1 << 16
BROADCAST_ROWS = 100_000


def _fill(lengths: np.ndarray, counts: np.ndarray, taken: np.ndarray, left: int) -> int:
    """Add to taken what comes nearest to left words, by a bounded knapsack; returns what is still left.

    Bit s of reach is set if s words can be made; counts go in as powers of two.
    """
    free = [(int(n), i) for i, n in enumerate(lengths) if 0 < n <= left and counts[i] > taken[i]]
    limit, reach, steps = (1 << (left + 1)) - 1, 1, []
    for n, i in sorted(free):
        have, pack = min(int(counts[i] - taken[i]), left // n), 1
        while have > 0:
            pack = min(pack, have)
            steps.append((n * pack, i, pack, reach))
            reach |= (reach << (n * pack)) & limit
            have -= pack
            pack *= 2
        if reach >> left & 1:
            break
    best = reach.bit_length() - 1
    left -= best
    for words, i, pack, before in reversed(steps):
        if not before >> best & 1:
            best -= words
            taken[i] += pack
    return left


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take, at most counts, so that their words come near budget.

    A proportional share of each length keeps the mix of short and long documents; long documents
    then bring the rest below the table's size, and the knapsack fills it. Where it can't be filled,
    some of what is taken goes back first: one of each length, then as much as the table holds.
    """
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return counts.astype(np.int64)
    taken = np.floor(counts * (budget / total)).astype(np.int64)
    left = budget - int((lengths * taken).sum())
    most = max(TABLE_WORDS, 2 * int(lengths.max()))  # so that a document fits as long as more is left
    long_first = np.argsort(-lengths, kind="stable")
    for i in long_first:
        if left <= most:
            break
        if lengths[i]:
            more = min(int(counts[i] - taken[i]), (left - most + int(lengths[i]) - 1) // int(lengths[i]), left // int(lengths[i]))
            taken[i] += more
            left -= more * int(lengths[i])
    best, least = taken, left + 1
    for back in (0, 1, budget):
        trial, rest = taken.copy(), left
        for i in long_first if back else ():
            if lengths[i] and rest + lengths[i] <= most:
                fewer = min(int(trial[i]), back, (most - rest) // int(lengths[i]))
                trial[i] -= fewer
                rest += fewer * int(lengths[i])
        rest = _fill(lengths, counts, trial, rest)
        if rest < least:
            best, least = trial, rest
        if not least:
            break
    return best


def _plan(hist: pd.DataFrame) -> pd.DataFrame:
    """One source's histogram with its target: copies of all documents of a length, and how many get
    one more. A document is taken MOST times at most, so a length has MOST times its count to give."""
    hist = hist.sort_values("size", ignore_index=True)
    n = hist["n"].to_numpy()
    units = fit_budget(hist["size"].to_numpy(), MOST * n, int(np.floor(float(hist["target"].iloc[0]) + 0.5)))
    return hist[["source_no", "size", "n"]].assign(copies=units // n, chosen=units % n)


def _numbered(totals: DataFrame) -> DataFrame:
    """totals with source_no, from 1 by code point, null last: ranges of sources, and counts of each."""
    placed = totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("_at", 33)
    before, rows = 0, []
    for p, n in sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect()):  # a row a partition
        rows.append((p, before - (p << 33) + 1))
        before += n
    shifts = small_table(totals.sparkSession, rows, "_part long, _shift long")
    return placed.withColumn("_part", part).join(F.broadcast(shifts), "_part").withColumn("source_no", (F.col("_at") + F.col("_shift")).cast("int")).drop("_part", "_shift", "_at")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """source, source_no, source_size, target for every source.

    Weights repeat over the sources by code point, null last. Targets share all words by weight and
    stop at most times the source's own; the excess is shared again until none is above. The level (a
    target for a weight of 1) only rises, so each step is one aggregate over the sources, until it stays.
    """
    totals = _numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") - 1) % len(weights) + 1)
    totals = materialize(totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most), "totals")
    every = totals.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = -1.0, -1
    while True:
        full = F.col("cap") < F.col("weight") * F.lit(level)
        n, held, rest = totals.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == stopped or rest is None:
            break
        stopped, level = n, (every - (held or 0)) / rest
    target = F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return totals.withColumn("target", target).select("source", "source_no", "source_size", "target")


def _sized(docs: DataFrame, doc_id: str, text: str, source: str, seed: int, carry: bool) -> DataFrame:
    """doc_id, source, size, the seeded hash of every row and its part; all its columns too, if carry."""
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col(source), F.col(text)).alias("_h"),
        F.spark_partition_id().alias("_part"),
        *own,
    )


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table of a few numbers a row if it has at most BROADCAST_ROWS rows; else join by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _border(rows: DataFrame, keys: list[str], by: str, need: str) -> DataFrame:
    """Of groups (keys), each with rows counted by `by`: the value of `by` in which the need-th row lies,
    and how many are needed of it. What lies before it is needed whole."""
    counts = rows.groupBy(*keys, by).agg(F.count("*").alias("_m"), F.first(need).alias(need))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("_before", before).where(f"_before < {need} AND {need} <= _before + _m").select(*keys, by, (F.col(need) - F.col("_before")).alias("need"), "_m")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row; taken is size times its copies.

    With carry, copies and a struct _row of all columns of docs come along.
    """
    sized = materialize(_sized(docs, doc_id, text, source, seed, carry), "sizes")  # the one pass over the texts
    sizes = sized.drop("_row")
    targets = _small(materialize(source_targets(sizes), "targets"))
    slot = F.pmod(F.shiftrightunsigned(F.col("_h"), 16), F.lit(SLOTS)).cast("int")

    def placed(rows: DataFrame) -> DataFrame:
        own = [c for c in rows.columns if c != "source"]
        return rows.join(targets, rows["source"].eqNullSafe(targets["source"])).select(rows["source"], *own, "source_no", "source_size", "target", slot.alias("_slot"))

    rows, key = placed(sizes), ["source_no", "size"]
    hist = rows.groupBy(*key).agg(F.count("*").alias("n"), F.first("target").alias("target"))
    plan = materialize(hist.groupBy("source_no").applyInPandas(_plan, "source_no int, size long, n long, copies long, chosen long"), "plan")
    some = _small(plan.where("chosen > 0 AND chosen < n").select(*key, "chosen"))
    # the slot on the border, then the hash in it, then how many of the rows with that hash each part gives
    slots = materialize(_border(rows.join(some, key), key, "_slot", "chosen").withColumnsRenamed({"_slot": "border", "need": "in_slot"}).drop("_m"), "slots")
    inside = rows.join(_small(slots), key).where("_slot = border")
    hashes = materialize(_border(inside, key, "_h", "in_slot").withColumnsRenamed({"_h": "border_h", "need": "in_hash"}), "hashes")
    choice = materialize(
        plan.join(slots.select(*key, "border"), key, "left").join(hashes, key, "left").select(
            *key,
            "copies",
            # every slot below border is taken whole, and in it every hash up to border_h, or below if tied
            F.when(F.col("chosen") == F.col("n"), F.lit(SLOTS)).otherwise(F.coalesce("border", F.lit(0))).alias("border"),
            "border_h",
            F.coalesce(F.col("in_hash") < F.col("_m"), F.lit(False)).alias("tied"),
        ),
        "choice",
    )
    out = ["doc_id", "source", "size", "source_size", "target"]

    def taken(rows: DataFrame, more) -> DataFrame:
        copies = F.col("copies") + more.cast("long")
        return rows.select(*out, (F.col("size") * copies).alias("taken"), *([copies.alias("copies"), "_row"] if carry else []))

    picked = placed(sized).join(_small(choice), key)
    on_border = (F.col("_slot") == F.col("border")) & F.col("border_h").isNotNull()
    equal = on_border & F.col("tied") & (F.col("_h") == F.col("border_h"))
    whole = taken(picked.where(~equal), (F.col("_slot") < F.col("border")) | F.coalesce(on_border & (F.col("_h") <= F.col("border_h")), F.lit(False)))
    tied = hashes.where("in_hash < _m").select(*key, "border_h", "in_hash")
    if tied.isEmpty():
        return whole
    same = rows.join(_small(tied), key).where(F.col("_h") == F.col("border_h"))
    parts = same.groupBy(*key, "_part").agg(F.count("*").alias("_m"), F.first("in_hash").alias("in_hash"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    given = materialize(parts.select(*key, "_part", (F.col("in_hash") - before).alias("_gives")), "given")
    rank = F.row_number().over(Window.partitionBy(*key, "_part").orderBy("_h"))
    ranked = picked.where(equal).join(_small(given), [*key, "_part"]).withColumn("_r", rank)
    return whole.unionByName(taken(ranked, F.col("_r") <= F.col("_gives")))


def mixed_documents(docs: DataFrame, **names) -> DataFrame:
    """The rows that the mix takes, with their columns and how often each is taken (copies)."""
    found = mix(docs, carry=True, **names).where("copies > 0 AND size > 0")
    return found.select("_row.*", F.col("copies").alias("mix_copies"), F.col("taken").alias("mix_words"), F.col("target").alias("mix_target"))
