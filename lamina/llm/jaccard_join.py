"""N-gram Jaccard join: pivots, Voronoi regions, triangle-inequality windows, exact recursion.

Documents are sets of 5-word shingles; two link at a Jaccard similarity of THRESHOLD percent or more,
that is at a distance of at most RADIUS, and Jaccard distance is a metric. Documents with equal sets
form one class and only classes are joined.

Pruning. Almost all classes of a corpus lie at distance 1 from each other, where no pivot tells them
apart. So those that can't link leave first, by what a link implies for shingles. (1) Under one order
of all shingles (those frequent in some shard last, else by hash), two linked sets share at least
need(n) of their first prefix(n) shingles. (2) Of those left, whole sets are compared: a link needs
THRESHOLD percent of a set's shingles to be in others.

Regions. What is left is joined by pivots, in rounds over all of it. Pivots are classes that come
first among the holders of each of their rarest shingles. Each class meets the pivots that it shares
such a shingle with, and its distance to them is measured. A class near enough to a pivot belongs to
the Voronoi region of its nearest one. A region's window is what lies at most RADIUS farther from the
pivot than its members: by the triangle inequality every partner of a member does, so boundary classes
are replicated into each region whose window holds them. A member leaves if all of its window is in
its component already; pivots leave too, as all their links are known. Whatever remains, members with
an open window and classes in no region, is joined recursively: the next round partitions it by more
pivots, taken from the smaller components, into smaller regions with smaller windows. In the last
round every class left is a pivot. So each class is a pivot or leaves settled, and the join is exact
for components; links inside a component that is known already are not looked for, so the links
themselves, and how many a document has, are not computed.

Scale: a shingle has one pivot a slot at most, so but for the last round a round's pairs are at most
the entries of the rarest shingles times its slots, and there is no pair list within a group of
copies. The last round has pairs between components only, and a bitmap of each set keeps those apart
that differ too much. A region of any size is measured in chunks.

Edge cases: null and empty texts have an empty set and link with nothing, their component is their
own id; a document of fewer than five words has its whole sequence as one shingle; repeated rows and
copies share a class; a null id keeps its row and never names a component unless all are null; an
empty table gives an empty result; extra columns pass through one_of_each(). Shingles, and classes,
are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from .common import by_value, discard, free_shuffles, lean, materialize, prepare, shards, small_table, text_bytes
from .components import components
from .hashing import TABLE, Powers, mix, running

by_value(__name__)

WORDS = 5
THRESHOLD = 75
RADIUS = 0.25
SHARD_BYTES = 8 << 20
#: Entries that one task compares at once.
PART_ENTRIES = 400_000
#: Frequent shingles that are put last; any set of them gives the same result.
MOST_FREQUENT = 200_000
#: Percent of similarity to a pivot that a round looks for. A region reaches as far as leaves RADIUS for
#: its window: in the first round members lie within RADIUS of their pivot, later ever nearer to it. The
#: last is THRESHOLD, with which only pivots are settled; all that is left then is one.
REACHES = (50, 62, 69, 75)
#: Shingles of a region that are measured against the pivot at once; a larger region is measured in chunks.
CHUNK_ENTRIES = 1 << 17
#: Each round has so many times the slots of the one before, and with them more pivots a shingle.
SLOTS_MORE = 4
BITMAP_LONGS = 8
BITS = [f"b{i}" for i in range(BITMAP_LONGS)]
#: Whole-number ids that are broadcast, 8 bytes each.
MOST_IDS = 1_000_000
#: Groups of classes in which counts come together.
HOMES = 256
PIECE = 1 << 20

BLOOM_FROM = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of every word; long texts are taken in pieces that end between words."""
    data = np.frombuffer(text, np.uint8)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word longer than a piece
                later = np.flatnonzero(_SPACE[data[end:]])
                end = end + int(later[0]) + 1 if len(later) else len(data)
        piece = data[at:end]
        edge = np.diff(np.concatenate([[0], (~_SPACE[piece]).astype(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = running(TABLE[piece])
        _, down = Powers.get(len(piece))
        out.append(mix((total[last] - total[first]) * down[first]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    w = word_hashes(text.lower())
    if not len(w):
        return w
    n = min(WORDS, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + w[i : len(w) - n + 1 + i]
    return np.unique(mix(h + np.uint64(n)))


def class_of(shingles: np.ndarray) -> int:
    """One number for a set; 0 for the empty one."""
    if not len(shingles):
        return 0
    return int(mix(mix(shingles * np.uint64(3) + np.uint64(1)).sum(dtype=np.uint64)[None] + np.uint64(len(shingles)))[0].view(np.int64)) or 1


def prefix(n):
    """How many of a set's first shingles are looked at; n may be an array."""
    return np.minimum(n, (3 * n) // 8 + 1)


def need(n):
    """How many of these lie among the other set's first ones too, whatever set links: THRESHOLD percent
    of n are shared in all. A set of 3 links with one of 4, whose prefix may hold only one of them."""
    return np.where(n < 5, 1, np.maximum(1, prefix(n) - (n - (THRESHOLD * n + 99) // 100)))


def _sets(shard: pa.RecordBatch) -> list[np.ndarray]:
    return [shingle_set(t) for t in text_bytes(shard, "text")]


# --- passes over the texts ---------------------------------------------------------------------


@lean
def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (doc, n, class), and for each shingle frequent in the shard (key, count)."""
    for shard in shards(batches, "text", SHARD_BYTES):
        sets = _sets(shard)
        classes = np.array([class_of(s) for s in sets], np.int64)
        sizes = np.array([len(s) for s in sets], np.int64)
        _, one = np.unique(classes, return_index=True)
        keys, counts = np.unique(np.concatenate([sets[i] for i in one] or [np.zeros(0, np.uint64)]), return_counts=True)
        often = counts >= max(8, len(one) // 500)
        keys, counts = keys[often].view(np.int64), counts[often]
        n, m = len(sets), len(keys)
        ids = shard.column(0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([ids, pa.nulls(m, ids.type)]),
                pa.array(np.concatenate([sizes, counts])),
                pa.array(np.concatenate([classes, keys])),
                pa.array(np.arange(n + m) < n),
            ],
            ["doc_id", "n", "code", "is_doc"],
        )


def _packed(keys: list[np.ndarray], owners: list[int], sizes: list[int], parts: int) -> pa.RecordBatch:
    """Entries (shingle, class, size of its set) of a shard, packed by part.

    Of a shingle's classes in a shard only the first goes on to be compared with other shards', so a
    shingle has as many entries in a part as there are shards at most; the others are known to be
    shared already and are dealt out evenly to parts from parts on. Rows: part, keys, classes, sizes,
    shared (whether the shard has another class with the key).
    """
    counts = [len(k) for k in keys]
    key = np.concatenate(keys)
    owner, size = np.repeat(np.array(owners, np.int64), counts), np.repeat(np.array(sizes, np.int32), counts)
    order = np.argsort(key, kind="stable")
    key, owner, size = key[order], owner[order], size[order]
    same = key[1:] == key[:-1]
    again = np.r_[False, same]
    shared = again | np.r_[same, False]
    spread = mix(key + owner.view(np.uint64)) % np.uint64(parts)
    part = np.where(again, spread + np.uint64(parts), key % np.uint64(parts)).astype(np.int64)
    by_part = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[by_part], np.arange(2 * parts + 1))
    full = np.flatnonzero(np.diff(cuts))
    columns = [[x[by_part[cuts[p] : cuts[p + 1]]].tobytes() for p in full] for x in (key, owner, size, shared)]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array(c, pa.binary()) for c in columns]], ["part", "keys", "classes", "sizes", "shared"])


PACKED = "part int, keys binary, classes binary, sizes binary, shared binary"


def _prefix_entries(frequent, parts: int):
    """Entries of every text's first shingles: hash order, the frequent ones last."""

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        for shard in shards(batches, "text", SHARD_BYTES):
            chosen: dict[int, np.ndarray] = {}
            for s in _sets(shard):
                if len(s):
                    chosen.setdefault(class_of(s), s)
            keys = []
            for s in chosen.values():
                if len(late):
                    place = np.minimum(np.searchsorted(late, s), len(late) - 1)
                    is_late = late[place] == s
                    s = np.concatenate([s[~is_late], s[is_late]])
                keys.append(s[: int(prefix(np.int64(len(s))))])
            if keys:
                yield _packed(keys, list(chosen), [len(s) for s in chosen.values()], parts)

    return work


def _set_entries(parts: int):
    """Entries of whole sets, from rows of class, n, set."""

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, "set", SHARD_BYTES):
            sets = [np.frombuffer(x, np.uint64) for x in shard.column(2).to_pylist()]
            yield _packed(sets, shard.column(0).to_pylist(), shard.column(1).to_pylist(), parts)

    return work


def _meet(parts: int, report):
    """Entries of a part from all shards, sorted by part: report() gets those whose shingle more than
    one class has."""

    def shared_of(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, owner, size, shared = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((owner, key))
        key, owner, size, shared = key[order], owner[order], size[order], shared[order]
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        fresh = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
        classes = np.bincount(group, weights=fresh)
        told = np.bincount(group, weights=shared) > 0
        keep = fresh & ((classes > 1) | told)[group]
        return report(key[keep], owner[keep], size[keep])

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for p, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if p != now and held:
                    yield shared_of(held)
                    held = []
                now = p
                entry = tuple(np.frombuffer(x, t) for x, t in zip(row, (np.uint64, np.int64, np.int32, bool), strict=True))
                if p >= parts:
                    yield report(*entry[:3])
                else:
                    held.append(entry)
        if held:
            yield shared_of(held)

    return work


def _memberships(key: np.ndarray, owner: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(owner), pa.array(size)], ["key", "class", "n"])


def _counts(key: np.ndarray, owner: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """How many shared shingles of each class a part has, packed by the class's home."""
    names, first, inverse = np.unique(owner, return_index=True, return_inverse=True)
    count, home = np.bincount(inverse, minlength=len(names)), names % HOMES
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(HOMES + 1))
    full = np.flatnonzero(np.diff(cuts))
    columns = [[x[order[cuts[h] : cuts[h + 1]]].tobytes() for h in full] for x in (names, size[first].astype(np.int64), count)]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array(c, pa.binary()) for c in columns]], ["home", "classes", "sizes", "counts"])


@lean
def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """class, n, shared: the counts of all parts; rows come by home."""

    def together(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        names, sizes, counts = (np.concatenate(x) for x in zip(*rows, strict=True))
        found, first, inverse = np.unique(names, return_index=True, return_inverse=True)
        return found, sizes[first], np.bincount(inverse, weights=counts, minlength=len(found)).astype(np.int64)

    def out(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in together(rows)], ["class", "n", "shared"])

    held, now, size = [], None, 0
    for batch in batches:
        for home, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if home != now and held:
                yield out(held)
                held, size = [], 0
            now = home
            held.append(tuple(np.frombuffer(x, np.int64) for x in row))
            size += len(held[-1][0])
            if size > 1 << 20:  # what is held grows with the classes, not with the parts
                held = [together(held)]
                size = len(held[0][0]) // 2
    if held:
        yield out(held)


def _met(packed: DataFrame, parts: int, report, schema: str) -> DataFrame:
    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_meet(parts, report), schema)


# --- the join by pivots ------------------------------------------------------------------------


def _distances(reach: int):
    """p, class, inter, union of every member within reach of its pivot.

    Rows come by region and chunk, the pivot's own (without a class) first. Whole stretches of members
    are looked up in the pivot's set at once.
    """

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            p, chunk, member = (batch.column(i) for i in range(3))
            pivots, chunks, is_pivot = p.to_numpy(), chunk.to_numpy(), member.is_null().to_numpy(zero_copy_only=False)
            names = member.fill_null(0).to_numpy()
            column = batch.column(3)
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 8
            keys = np.frombuffer(column.buffers()[2] or b"", np.uint64, count=int(ends[-1]))
            cuts = np.flatnonzero(np.r_[True, is_pivot[1:] | (pivots[1:] != pivots[:-1]) | (chunks[1:] != chunks[:-1])])
            out: list[tuple[np.ndarray, ...]] = []
            for a, b in zip(cuts, np.r_[cuts[1:], len(pivots)], strict=True):
                if is_pivot[a]:
                    own = keys[ends[a] : ends[a + 1]].copy()
                    a += 1
                if a == b:
                    continue
                flat, n = keys[ends[a] : ends[b]], np.diff(ends[a : b + 1]).astype(np.int64)
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                inter = np.diff(np.r_[0, np.cumsum(hit)][np.r_[ends[a:b], ends[b]] - ends[a]])
                union = n + len(own) - inter
                near = np.flatnonzero(100 * inter >= reach * union)
                out.append((pivots[a:b][near], names[a:b][near], inter[near], union[near]))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["p", "class", "inter", "union"])

    return work


def _rarest(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, class, place of the shingles by which sets are found, and class, n, known of each set.

    known is how many shingles of a set others hold as well; place numbers these, those that the
    fewest sets hold first. Two sets of a similarity of t percent share one that is among the first
    known - t% of n + 1 of both. t is the least of REACHES here; a larger t needs fewer.
    """
    parts = int(max(8, (sets.agg(F.sum("n")).first()[0] or 0) // PART_ENTRIES + 1))
    shared = materialize(_met(sets.mapInArrow(_set_entries(parts), PACKED), parts, _memberships, "key long, class long, n int"), "shared")
    held_by = shared.groupBy("key").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("class").orderBy("df", "key"))
    known = F.count("*").over(Window.partitionBy("class"))
    ranked = shared.join(held_by, "key").withColumn("place", place).withColumn("known", known.cast("int"))
    first = materialize(ranked.where(F.col("place") <= _reached(REACHES[0])).select("key", "class", "place", "n", "known"), "first")
    discard(shared)
    return first.select("key", "class", "place"), first.where("place = 1").select("class", "n", "known")


def _reached(reach: int):
    """How many of a set's shingles must be looked at for a similarity of reach percent."""
    return F.col("known") - F.ceil(F.lit(reach) * F.col("n") / 100) + 1


def _pivots(entries: DataFrame) -> DataFrame:
    """p, n of the classes that come first, in their slot, among the holders of each of their k shingles.

    Where components of several orders of magnitude hold a shingle, only those of the least have pivots
    there, so that outliers meet a large component, not its classes each other. Otherwise classes with
    few shingles of their own come first, as the middle of a group of near copies has.
    """
    least = entries.groupBy("key", "slot").agg(F.min(F.struct("order", "own", "h", "class", "k")).alias("least"))
    ahead = least.withColumn("smallest", F.min("least.order").over(Window.partitionBy("key"))).where(F.col("least.order") == F.col("smallest"))
    firsts = ahead.groupBy(F.col("least.class").alias("p")).agg(F.count("*").alias("c"), F.max("least.k").alias("k"))
    return firsts.where("c = k").select("p")


def _may_reach(reach: int):
    """What holds for a pair of reach percent at the first shingle that both have: similar sizes, and
    from there on enough shingles in both. Later shingles of a pair need not pass."""
    alike = (100 * F.col("n") >= reach * F.col("n_p")) & (100 * F.col("n_p") >= reach * F.col("n"))
    return alike & ((100 + reach) * F.least("rest", "rest_p") >= reach * (F.col("n") + F.col("n_p")))


@lean
def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """class, bits: for each of 64 * BITMAP_LONGS bits whether an odd number of shingles falls on it."""
    for batch in batches:
        out = np.zeros((batch.num_rows, BITMAP_LONGS), np.uint64)
        for row, s in zip(out, batch.column(1).to_pylist(), strict=True):
            h = mix(np.frombuffer(s, np.uint64) + np.uint64(5))
            odd = (np.bincount((h % np.uint64(64 * BITMAP_LONGS)).astype(np.int64), minlength=64 * BITMAP_LONGS) & 1).astype(np.uint8)
            row[:] = np.packbits(odd).view(np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[:, i].view(np.int64)) for i in range(BITMAP_LONGS)]], ["class", *BITS])


def _bitmaps_allow(reach: int):
    """Two sets differ in at least as many shingles as their bitmaps do in bits, and a pair of reach
    percent in at most (100 - reach) / (100 + reach) of both together."""
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_p"))) for b in BITS])
    return (100 + reach) * differ <= (100 - reach) * (F.col("n") + F.col("n_p"))


def _near(pairs: DataFrame, sets: DataFrame, reach: int) -> DataFrame:
    """p, class, inter, union of the pairs within reach; a large region is measured in several chunks."""
    members = pairs.join(sets, "class")
    many = pairs.groupBy("p").agg(F.sum("n").alias("total"))
    chunks = materialize(many.select("p", F.ceil(F.col("total") / CHUNK_ENTRIES).cast("int").alias("chunks")), "chunks")
    large = chunks.where("chunks > 1")
    n_large = large.count()
    if n_large:
        large = F.broadcast(large) if n_large <= 10_000 else large
        members = members.join(large, "p", "left").withColumn("chunk", F.pmod(F.xxhash64("class"), F.coalesce("chunks", F.lit(1))).cast("int"))
    else:
        members = members.withColumn("chunk", F.lit(0))
    own = chunks.join(sets.select(F.col("class").alias("p"), "set"), "p").select("p", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("class"), "set")
    rows = own.unionByName(members.select("p", "chunk", "class", "set"))
    return rows.repartition("p", "chunk").sortWithinPartitions("p", "chunk", F.asc_nulls_first("class")).mapInArrow(_distances(reach), "p long, class long, inter long, union long")


def _extended(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, component) with more links: only components that they join are looked at again."""
    ends = _labelled_by(label, _labelled_by(label, links, "u", "a"), "v", "b").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    ends = materialize(ends, "ends")
    if ends.isEmpty():
        return label
    joined = components(ends)
    moved = label.join(joined.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left")
    moved = moved.select("node", F.coalesce("_to", "component").alias("component"))
    return materialize(moved.unionByName(joined.join(label, "node", "left_anti")), "label")


def _labelled_by(label: DataFrame, classes: DataFrame, name: str, out: str) -> DataFrame:
    """classes with the component of the class in a column, the class itself where it has no link."""
    at = label.select(F.col("node").alias(name), F.col("component").alias("_c"))
    return classes.join(at, name, "left").withColumn(out, F.coalesce("_c", name)).drop("_c")


def join_by_pivots(sets: DataFrame, on_round=None) -> DataFrame:
    """node, component of the classes that link; sets has class, n, set.

    on_round is called after each round with its numbers of classes, pivots, members of Voronoi regions,
    replicas in windows, links and classes left, at the price of a few counts.
    """
    spark = sets.sparkSession
    first, alive = _rarest(sets)
    alive = materialize(alive.withColumns({"component": F.col("class"), "order": F.lit(0)}), "alive")
    linked = 100 * F.col("inter") >= THRESHOLD * F.col("union")
    label = small_table(spark, [], "node long, component long")
    for turn, reach in enumerate(REACHES):
        here = alive.withColumn("k", _reached(reach).cast("int")).where("k > 0").withColumn("own", F.col("n") - F.col("known"))
        slot = F.pmod(F.xxhash64("class", F.lit(-1 - turn)), F.lit(SLOTS_MORE**turn))
        entries = first.join(here, "class").where("place <= k").withColumns({"h": F.xxhash64("class", F.lit(turn)), "slot": slot, "rest": F.col("known") - F.col("place") + 1})
        whole = reach == THRESHOLD  # the last round: all that is left are pivots
        if whole:
            # of the components that hold a shingle, the largest need not ask the others
            rank = F.struct("order", "component")
            bits = sets.select("class", "set").join(here.select("class"), "class", "left_semi").mapInArrow(_bitmaps, "class long, " + ", ".join(f"{b} long" for b in BITS))
            entries = materialize(entries.join(materialize(bits, "bits"), "class"), "entries")
            most = entries.groupBy("key").agg(F.max(rank).alias("most"))
            asking = entries.join(most, "key").where(rank < F.col("most"))
            its_keys = asking.select("key", F.col("class").alias("p"), F.col("n").alias("n_p"), F.col("rest").alias("rest_p"), rank.alias("rank_p"), *[F.col(b).alias(f"{b}_p") for b in BITS])
            fit = (rank > F.col("rank_p")) & _may_reach(reach) & _bitmaps_allow(reach)
            pivots = None
        else:
            pivots = materialize(_pivots(entries), "pivots")
            its_keys = entries.join(pivots, F.col("class") == F.col("p")).select("key", "p", F.col("n").alias("n_p"), F.col("rest").alias("rest_p"))
            fit = (F.col("class") != F.col("p")) & _may_reach(reach)
        pairs = materialize(entries.drop("k", "known", "own", "h", "slot", "place").join(its_keys, "key").where(fit).select("class", "p", "n").distinct(), "pairs")
        near = materialize(_near(pairs, sets.select("class", "set"), reach), "near")
        free_shuffles(spark)
        links = near.where(linked).select(F.col("class").alias("u"), F.col("p").alias("v"))
        label = _extended(label, links)
        if whole:
            if on_round is not None:
                on_round({"classes": here.count(), "pivots": here.count(), "members": 0, "replicas": near.count(), "links": links.count(), "left": 0})
            return label
        # a region is its nearest pivot's; its window, whatever lies at most RADIUS farther from the pivot
        named = near.join(pivots.select(F.col("p").alias("class")), "class", "left_anti").withColumn("d", 1 - F.col("inter") / F.col("union"))
        inside = 100 * F.col("inter") >= (100 - THRESHOLD + reach) * F.col("union")
        homes = materialize(named.where(inside).groupBy("class").agg(F.min(F.struct("d", "p")).alias("home")).select("class", "home.d", "home.p"), "homes")
        placed = _labelled_by(label, _labelled_by(label, named, "class", "c"), "p", "c_p")
        foreign = placed.where("c <> c_p").groupBy("p").agg(F.min("d").alias("m"))
        open_ = homes.join(foreign, "p").where(F.col("d") + RADIUS >= F.col("m") - 1e-9).select("class")
        gone = pivots.select(F.col("p").alias("class")).unionByName(homes.join(open_, "class", "left_anti").select("class"))
        left = _labelled_by(label, here.select("class", "n", "known").join(gone, "class", "left_anti"), "class", "component")
        sizes = label.groupBy("component").agg(F.floor(F.log2(F.count("*"))).cast("int").alias("order"))
        after = materialize(left.join(sizes, "component", "left").select("class", "n", "known", "component", F.coalesce("order", F.lit(0)).alias("order")), "alive")
        if on_round is not None:
            members = homes.count()
            on_round({"classes": here.count(), "pivots": pivots.count(), "members": members, "replicas": named.count() - members, "links": links.count(), "left": after.count()})
        for old in (alive, pivots, pairs, near, homes):
            discard(old)
        alive = after
        free_shuffles(spark)
    return label


# --- the join ----------------------------------------------------------------------------------


@lean
def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """class, n, set from rows of class, text; another text under the same id is left out."""
    for batch in batches:
        sets = [shingle_set(t) for t in text_bytes(batch, "text")]
        right = pa.array([class_of(s) == c for s, c in zip(sets, batch.column(0).to_pylist(), strict=True)], pa.bool_())
        out = [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(out, ["class", "n", "set"]).filter(right)


def _candidates(plain: DataFrame, surveyed: DataFrame) -> DataFrame:
    """key, class, n for classes whose prefix shares enough with others', and the keys they share."""
    spark = plain.sparkSession
    top = surveyed.where("NOT is_doc").groupBy("code").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "code").limit(MOST_FREQUENT)
    late = np.sort(np.array([r["code"] for r in top.select("code").collect()], np.int64).view(np.uint64))
    # parts of about PART_ENTRIES entries; 3/8 of all shingles are entries
    shingles = surveyed.where("is_doc").agg(F.sum("n")).first()[0] or 0
    parts = int(max(8, shingles * 3 // 8 // PART_ENTRIES + 1))
    packed = plain.select("text").mapInArrow(_prefix_entries(spark.sparkContext.broadcast(late), parts), PACKED)
    member = materialize(_met(packed, parts, _memberships, "key long, class long, n int").distinct(), "member")
    free_shuffles(spark)
    n = F.col("n").cast("long")
    looked_at = F.least(n, F.floor(3 * n / 8) + 1)
    enough = F.when(n < 5, F.lit(1)).otherwise(F.greatest(F.lit(1), looked_at - (n - F.ceil(F.lit(THRESHOLD) * n / 100))))  # need()
    for _ in range(2):  # classes that cannot link leave, and with them what they alone shared
        stay = member.groupBy("class", "n").agg(F.count("*").alias("c")).where(F.col("c") >= enough).select("class")
        member = member.join(stay, "class")
        keys = member.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
        member = materialize(member.join(keys, "key", "left_semi").select("key", "class", "n"), "member")
    return member


def _texts_of(chosen: DataFrame, plain: DataFrame) -> DataFrame:
    """class, text of the chosen documents (rep is the id, or null).

    A Bloom filter of the chosen ids, of a fixed size at most, thins the texts before they are
    shuffled; the condition on c, and a threshold that the caller sets, let the optimiser put it there.
    """
    texts = plain.join(chosen.where("c >= 1"), F.col("doc_id") == F.col("rep")).select("class", "text")
    if not chosen.where("rep IS NULL").isEmpty():  # found by their class: texts without an id
        texts = texts.unionByName(chosen.where("rep IS NULL").join(plain.where("doc_id IS NULL").mapInArrow(_classed, "code long, text string"), F.col("class") == F.col("code")).select("class", "text"))
    return texts


@lean
def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [class_of(shingle_set(t)) for t in text_bytes(batch, "text")]
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), batch.column(batch.schema.get_field_index("text"))], ["code", "text"])


def _sets_of(member: DataFrame, plain: DataFrame, surveyed: DataFrame) -> DataFrame:
    """class, n, set of the candidate classes, cut to those that share THRESHOLD percent of all their
    shingles with others of them: a link needs as much with one class alone."""
    spark = plain.sparkSession
    one = surveyed.where("is_doc AND n > 0").groupBy("code").agg(F.min("doc_id").alias("rep"))
    keys = member.groupBy("class").agg(F.count("*").alias("c"))
    chosen = materialize(keys.join(one, F.col("class") == F.col("code")).select("rep", "class", "c"), "chosen")
    before = spark.conf.get(BLOOM_FROM)
    spark.conf.set(BLOOM_FROM, "0")
    try:
        sets = materialize(_texts_of(chosen, plain).mapInArrow(_set_rows, "class long, n int, set binary").dropDuplicates(["class"]), "sets")
    finally:
        spark.conf.set(BLOOM_FROM, before)
    free_shuffles(spark)
    for _ in range(2):
        parts = int(max(8, (sets.agg(F.sum("n")).first()[0] or 0) // PART_ENTRIES + 1))
        counted = _met(sets.mapInArrow(_set_entries(parts), PACKED), parts, _counts, "home int, classes binary, sizes binary, counts binary")
        by_home = counted.repartition("home").sortWithinPartitions("home").mapInArrow(_summed, "class long, n long, shared long")
        stay = by_home.where(F.col("shared") * 100 >= F.col("n") * THRESHOLD)
        left = materialize(sets.join(stay.select("class"), "class", "left_semi"), "sets")
        discard(sets)
        sets = left
        free_shuffles(spark)
    return sets


def class_labels(plain: DataFrame, surveyed: DataFrame) -> DataFrame:
    """class, label (one class of its component) for classes that link with others."""
    found = join_by_pivots(_sets_of(_candidates(plain, surveyed), plain, surveyed))
    return materialize(found.select(F.col("node").alias("class"), F.col("component").alias("label")), "labels")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class of every row.

    component_id is the smallest doc_id that links reach, itself included; class is the number of
    the document's set, so rows with one class are copies in the sense of the join.
    """
    return _labelled(docs, doc_id, text).drop("label")


def _labelled(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """near_duplicates() and label, a class that names the component; null for an empty set."""
    prepare(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    surveyed = materialize(plain.mapInArrow(_survey, f"doc_id {kind}, n long, code long, is_doc boolean"), "surveyed")
    labels = class_labels(plain, surveyed)
    rows = surveyed.where("is_doc").select("doc_id", F.col("n").alias("n_shingles"), F.col("code").alias("class"))
    # by class first, so that copies are combined before they are shuffled; tables cut what is joined
    # from what is aggregated, so that the engine can split a large group
    named = rows.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("first")).join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    named = materialize(named.select("class", "label", "first"), "classes")
    least = materialize(named.groupBy("label").agg(F.min("first").alias("component_id")), "least")
    whose = materialize(named.join(least, "label").select("class", "component_id", "label"), "whose")
    some = rows.where("n_shingles > 0").join(whose, "class").select("doc_id", "n_shingles", "component_id", "class", "label")
    none = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "class", F.lit(None).cast("long").alias("label"))
    return some.unionByName(none)


@lean
def _with_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of row, id, text with the class in place of the text."""
    for batch in batches:
        codes = pa.array([class_of(shingle_set(t)) for t in text_bytes(batch, "text")], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes], ["row", "id", "class"])


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group left, one with the smallest id; all columns stay.

    Rows without words stay. Where several rows of a group have its smallest id, or none has an id, the
    one whose JSON has the least SHA-256 stays.
    """
    found = _labelled(docs, doc_id, text)
    keeps = F.col("label").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = materialize(found.groupBy("doc_id").agg(F.count("*").alias("m"), F.count_if(keeps).alias("k")), "ids")
    # most ids are of one row that stays: where the others are few, no text is shuffled
    plain, others = "k > 0 AND m = 1 AND doc_id IS NOT NULL", ids.where("k = 0 OR m > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_other"))
    most = MOST_IDS if isinstance(docs.schema[doc_id].dataType, IntegralType) else 10_000
    if others.count() <= most:
        out = docs.join(F.broadcast(others), docs[doc_id].eqNullSafe(others["_other"]), "left_anti")
    else:
        kept = ids.where(plain).select(F.col("doc_id").alias("_kept"))
        out = docs.join(kept, docs[doc_id].eqNullSafe(kept["_kept"]), "left_semi")
    several = ids.where("k > 0 AND (m > 1 OR doc_id IS NULL)").select(F.col("doc_id").alias("_several"))
    n = several.count()
    if not n:
        return out
    # these ids do not tell rows apart; the class does
    several = F.broadcast(several) if n <= 10_000 else several
    rows = docs.join(several, docs[doc_id].eqNullSafe(several["_several"]), "left_semi")
    packed = rows.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = StructType([packed.schema["row"], packed.schema["id"], StructField("class", LongType())])
    classed = packed.mapInArrow(_with_class, schema)
    label = found.where(keeps).where("label IS NOT NULL").select(F.col("doc_id").alias("its_id"), F.col("class").alias("its_class"), "label").distinct()
    whose = classed.join(label, (F.col("class") == F.col("its_class")) & F.col("id").eqNullSafe(F.col("its_id")))
    one = whose.groupBy("label").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    wordless = classed.where("class = 0").select("row")
    return out.unionByName(one.select("row").unionByName(wordless).select("row.*"))
