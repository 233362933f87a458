"""Removal of repeated passages by suffix sorting with bucket-pointer refinement.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier: in a document of
smaller id, or earlier in the same one. Every such string has to be compared with all others of the
corpus; they are put into buckets that get finer step by step, and what is removed follows from the
bytes, never from a hash.

1. Initial q-gram buckets. A string's bucket is the q-gram of GRAM bytes in it whose hash is least
   (the first, of equal ones). Equal strings share it at the same offset. Neighbouring strings mostly
   have the same q-gram in common; such a run of starts is one row (bucket, document, first start,
   starts), and its stretch of text is compared as one. Buckets with one row are done. A shard of
   documents leaves out rows whose bytes it has seen already, before anything is shuffled, so that
   a passage found everywhere is sent once a shard.
2. The text of the other rows is fetched and each bucket refined. First whole stretches, by words of
   eight bytes: words get bucket pointers by their value, and with each pass pairs of neighbouring
   words get theirs by sorting on the pointers of both, which the pass before has made, until one
   pointer stands for the whole stretch. All rows of a stretch but the first are repeated as a whole.
3. Then, where a bucket holds different stretches around its q-gram, the suffixes within them: buckets
   of 8-grams are refined by sorting on the bucket pointers of later offsets, which the pass before has
   itself refined, so depth doubles with each pass and only buckets with more than one suffix are
   sorted again. Starts that share a bucket at depth LENGTH hold equal strings.
4. A bucket of more than LARGE rows is dealt out by its stretches for step 2, and what differs is not
   sorted at once: its strings move to finer buckets, by the q-gram of the next larger hash in them and
   its place, and steps 2 and 3 are done with those; so again, at most MOST_TURNS times, as long as a
   bucket is large.

Edge cases: null and empty texts have no bytes and keep nothing; texts below LENGTH keep all; rows
with the same id are documents of their own, in order of their text's hash, and null ids come last;
ids that are no whole numbers are ordered as their type is; a text repeated many times loses all but
its first row; very long texts are taken in overlapping pieces; an empty table gives an empty result;
extra columns pass through deduplicate().
"""

from __future__ import annotations

import hashlib
import time
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import by_value, free_shuffles, lean, materialize, prepare, shards, text_bytes
from .hashing import BASE, TABLE, Powers, mix, power, running

by_value(__name__)

LENGTH = 100
GRAM = 24
WINDOW = LENGTH - GRAM + 1
#: A q-gram's place within a piece fits the low bits of its rank.
PLACE = 20
PIECE = (1 << PLACE) - 256
SHARD_BYTES = 8 << 20
#: Text that is sorted at once.
SORT_BYTES = 2 << 20
LARGE = 4096
MOST_TURNS = 6


def gram_hashes(values: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place, put together from hashes of 2, 4, 8 and 16."""
    h, parts = values, {}
    n = 1
    while n < 16:
        h = h[:-n] * power(BASE, n) + h[n:]
        n *= 2
        parts[n] = h
    h = parts[16][: len(values) - GRAM + 1] * power(BASE, 8) + parts[8][16 : 16 + len(values) - GRAM + 1]
    return mix(h)


def rows_of_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bucket, stretch identity, first start and number of starts of every run in a piece of text."""
    values = TABLE[data]
    h = gram_hashes(values)
    low = np.uint64((1 << PLACE) - 1)
    rank = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    n = 1
    while 2 * n <= WINDOW:
        rank = np.minimum(rank[:-n], rank[n:])
        n *= 2
    least = np.minimum(rank[: len(rank) - (WINDOW - n)], rank[WINDOW - n :])
    place = (least & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    place = place[first]
    _, down = Powers.get(len(values))
    total = running(values)
    stretch = (total[last + LENGTH] - total[first]) * down[first]
    form = ((place - first) << 8 | (last - first)).astype(np.uint64)
    return h[place].view(np.int64), mix(stretch + mix(form + np.uint64(1))).view(np.int64), first, last - first + 1


def rows_of_text(text: bytes) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(text, np.uint8)
    out = []
    for at in range(0, max(1, len(data) - LENGTH + 1), PIECE - LENGTH + 1):
        piece = data[at : at + PIECE]
        if len(piece) >= LENGTH:
            bucket, stretch, first, count = rows_of_piece(piece)
            out.append((bucket, stretch, first + at, count))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _packed(first: np.ndarray, count: np.ndarray, done: np.ndarray | int) -> np.ndarray:
    """First start, number of starts, and whether a row is known to be repeated, in one number."""
    return (first << 32) | (count << 1) | done


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the stretches of data from a and from b are equal, compared eight bytes at a time."""
    words = np.ndarray(max(0, len(data) - 7), "<u8", data.tobytes(), strides=(1,))
    same = np.ones(len(a), bool)
    for at in range(0, int(sizes.max(initial=0)), 8):
        step = np.minimum(at, sizes - 8)  # the last word ends with the stretch
        same &= words[a + step] == words[b + step]
    return same


def _combined(data: np.ndarray, base: np.ndarray, bucket: np.ndarray, stretch: np.ndarray, did: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Rows of a shard in order of (did, first): those with the bytes of a row before them are done.

    base is where each row's document begins in data. A done row gets a bucket of its own, so that it
    meets nothing and is spread evenly.
    """
    key = mix(bucket.view(np.uint64) * np.uint64(3) + stretch.view(np.uint64))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    begin = np.r_[True, ordered[1:] != ordered[:-1]]
    leader = order[np.flatnonzero(begin)[np.cumsum(begin) - 1]]
    later = np.flatnonzero(~begin)
    mine, theirs = order[later], leader[later]
    equal = count[mine] == count[theirs]
    mine, theirs = mine[equal], theirs[equal]
    again = np.zeros(len(key), bool)
    again[mine] = _same_bytes(data, base[mine] + first[mine], base[theirs] + first[theirs], count[mine] + LENGTH - 1)
    # adjoining rows that are done are one
    begins = np.ones(len(key), bool)
    begins[1:] = ~(again[1:] & again[:-1] & (did[1:] == did[:-1]) & (first[1:] == first[:-1] + count[:-1]))
    at = np.flatnonzero(begins)
    bucket, did, first, again = bucket[at], did[at], first[at], again[at]
    count = np.add.reduceat(count, at)
    lone = mix(did.view(np.uint64) * np.uint64(BASE) + first.astype(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.where(again, lone, bucket)), pa.array(did), pa.array(_packed(first, count, again.astype(np.int64)))],
        ["bucket", "did", "pos"],
    )


ROW = "bucket long, did long, pos long"


@lean
def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in shards(batches, "text", SHARD_BYTES):
        ids = shard.column(0).to_numpy()
        texts = text_bytes(shard, "text")
        parts, held, at = [], [], 0
        for i in np.argsort(ids, kind="stable"):
            r = rows_of_text(texts[i])
            if len(r[0]):
                parts.append((np.full(len(r[0]), ids[i]), np.full(len(r[0]), at), *r))
                held.append(texts[i])
                at += len(texts[i])
        if parts:
            did, base, bucket, stretch, first, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield _combined(np.frombuffer(b"".join(held), np.uint8), base, bucket, stretch, did.astype(np.int64), first, count)


def settle(rows: DataFrame) -> DataFrame:
    """Rows that a shard knows to be repeated (done), and those that share their bucket with m - 1 others."""
    marked = rows.withColumn("m", F.count("*").over(Window.partitionBy("bucket"))).withColumn("done", F.col("pos") % 2 == 1)
    place = (F.shiftright("pos", 32).cast("int").alias("first"), (F.shiftright("pos", 1) % (1 << 31)).cast("int").alias("count"))
    return marked.where(F.col("done") | (F.col("m") > 1)).select("bucket", "m", "did", *place, "done")


def _dealt(pieces: list[bytes], m: np.ndarray) -> list[int]:
    """The part of each piece of a bucket of m rows: -1, or where its bytes put it if m is more than LARGE."""
    return [-1 if n <= LARGE else zlib.crc32(p) % (n // LARGE + 1) for p, n in zip(pieces, m.tolist(), strict=True)]


def stretch_pointers(pieces: list[bytes], bucket: np.ndarray) -> np.ndarray:
    """For each piece a pointer that is equal where the bucket and all bytes are equal.

    Words of eight bytes are the first level; each pass makes the pointer of twice the words from those
    of its halves, for pieces that are not yet alone with theirs.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    width = max(1, int(-(-sizes.max(initial=1) // 8)))
    width = 1 << (width - 1).bit_length()
    pointer = np.zeros(len(pieces), np.int64)
    _, pointer = np.unique(np.stack([bucket, sizes], 1), axis=0, return_inverse=True)
    pointer = pointer.reshape(-1)
    open_ = np.flatnonzero(np.bincount(pointer)[pointer] > 1)
    if not len(open_):
        return pointer
    table = np.zeros((len(open_), width * 8), np.uint8)
    for row, i in zip(table, open_.tolist(), strict=True):
        row[: sizes[i]] = np.frombuffer(pieces[i], np.uint8)
    level = np.unique(table.view("<u8"), return_inverse=True)[1].reshape(len(open_), width)
    while level.shape[1] > 1:
        pair = level[:, 0::2] << 32 | level[:, 1::2]
        level = np.unique(pair, return_inverse=True)[1].reshape(pair.shape)
    _, fine = np.unique(pointer[open_] << 32 | level[:, 0], return_inverse=True)
    pointer[open_] = len(pieces) + fine
    return pointer


def bucket_pointers(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each start a pointer that is equal where LENGTH bytes are equal, in the bytes' order.

    data must hold LENGTH bytes from every start.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    code = np.zeros(n, np.uint64)
    for j in range(8):
        code = code << np.uint64(8) | padded[j : j + n]
    order = np.argsort(code)
    pointer = np.zeros(n + LENGTH, np.int64)

    def point(order: np.ndarray, key: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Set pointers to the last place of each bucket; True where a bucket has more than one."""
        new = np.r_[True, key[1:] != key[:-1]]
        ends = np.r_[np.flatnonzero(new)[1:], len(order)] - 1
        sizes = np.diff(np.r_[-1, ends])
        pointer[order] = np.repeat(base[ends], sizes)
        return np.repeat(sizes > 1, sizes)

    if not n:
        return np.zeros(0, np.int64)
    open_ = point(order, code[order], np.arange(1, n + 1))
    spots = np.flatnonzero(open_)
    depth = 8
    while depth < LENGTH and len(spots):
        step = min(depth, LENGTH - depth)
        here = order[spots]
        key = pointer[here] << 32 | pointer[here + step]
        inner = np.argsort(key)
        order[spots] = here[inner]
        still = point(order[spots], key[inner], spots + 1)
        spots = spots[still]
        depth += step
    return pointer[starts]


def repeated_starts(segments: list[bytes], did: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Which starts of each segment hold a string that an earlier start (did, place) holds as well."""
    sizes = np.array([len(s) for s in segments], np.int64)
    base = np.cumsum(sizes) - sizes
    counts = sizes - LENGTH + 1
    data = np.frombuffer(b"".join(segments), np.uint8)
    inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(base, counts) + inner
    pointer = bucket_pointers(data, starts)
    order = np.lexsort((np.repeat(first, counts) + inner, np.repeat(did, counts), pointer))
    later = np.zeros(len(starts), bool)
    later[order[1:]] = pointer[order[1:]] == pointer[order[:-1]]
    return np.split(later, np.cumsum(counts)[:-1])


def _spans(first: int, flags: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans covered by the flagged starts, runs of starts together."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return [(first + int(a), first + int(b) - 1 + LENGTH) for a, b in zip(edge[::2], edge[1::2], strict=True)]


PIECES = "bucket long, part int, did long, first int, piece binary"
PIECE_COLUMNS = ["bucket", "part", "did", "first", "piece"]
FOUND = "did long, s int, e int, bucket long, piece binary"


def _fetch(open_rows: DataFrame, docs: DataFrame) -> DataFrame:
    """bucket, part, did, first, piece: the text of every open row."""
    wanted = open_rows.groupBy("did").agg(F.collect_list(F.struct("bucket", "m", "first", "count")).alias("rows"))

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch, "text")
            for did, rows, text in zip(batch.column(0).to_pylist(), batch.column(1), texts, strict=True):
                own = rows.values
                bucket, m, first, count = (own.field(i).to_numpy() for i in range(4))
                pieces = [text[f : f + c - 1 + LENGTH] for f, c in zip(first.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(_dealt(pieces, m), pa.int32()), pa.array(np.full(len(bucket), did, np.int64)), pa.array(first.astype(np.int32)), pa.array(pieces, pa.binary())], PIECE_COLUMNS)

    joined = wanted.join(docs, "did").select("did", "rows", "text")
    return joined.mapInArrow(_gathered(work), PIECES)


def _gathered(work):
    """Batches of one document each are put together before they go back to the engine."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for out in work(batches):
            held.append(out)
            rows += out.num_rows
            if rows >= 10_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


@lean
def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans to remove (did, s, e), from rows in order of bucket and part; whole buckets are sorted
    together, about SORT_BYTES at once.

    Of a bucket that is dealt out in parts (part is not -1) the different stretches come back whole, as
    rows of did, s, bucket and piece, to be put into finer buckets.
    """
    held: list[pa.RecordBatch] = []

    def flush(table: pa.Table) -> pa.RecordBatch:
        bucket, part, did, first = (table.column(c).to_numpy().astype(np.int64) for c in PIECE_COLUMNS[:4])
        pieces = table.column("piece").to_pylist()
        pointer = stretch_pointers(pieces, bucket)
        order = np.lexsort((first, did, pointer))
        later = np.zeros(len(order), bool)
        later[order[1:]] = pointer[order[1:]] == pointer[order[:-1]]
        out = [(did[i], first[i], first[i] + len(pieces[i]), None, None) for i in np.flatnonzero(later)]
        _, group, sizes = np.unique(np.where(later, -1, bucket), return_inverse=True, return_counts=True)
        differ = ~later & (part < 0) & (sizes[group.reshape(-1)] > 1)
        if differ.any():
            some = np.flatnonzero(differ)
            flags = repeated_starts([pieces[i] for i in some], did[some], first[some])
            out += [(did[i], s, e, None, None) for i, own in zip(some, flags, strict=True) if own.any() for s, e in _spans(int(first[i]), own)]
        out += [(did[i], first[i], None, bucket[i], pieces[i]) for i in np.flatnonzero(~later & (part >= 0))]
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["did", "s", "e", "bucket", "piece"])

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(4).nbytes
        if size >= SORT_BYTES:
            table = pa.Table.from_batches(held)
            bucket, part = table.column("bucket").to_numpy(), table.column("part").to_numpy()
            last = (bucket == bucket[-1]) & (part == part[-1])  # the last bucket may go on
            cut = len(last) - int(last.sum())
            if cut:
                yield flush(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                size = sum(b.column(4).nbytes for b in held)
    if held:
        yield flush(pa.Table.from_batches(held))


def _finer(turn: int):
    """Rows of did, s, bucket, piece to rows of finer buckets: each string of a piece goes to the bucket
    of its q-gram that comes next by hash after `turn` others, and its place; runs of starts stay together."""

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for did, first, bucket, piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                h = gram_hashes(TABLE[np.frombuffer(piece, np.uint8)])
                windows = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
                nth = np.argsort(windows, axis=1, kind="stable")[:, turn]
                place = nth + np.arange(len(windows))
                begin = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                for a, b in zip(begin.tolist(), np.r_[begin[1:], len(place)].tolist(), strict=True):
                    name = mix(np.array([bucket], np.int64).view(np.uint64) * np.uint64(BASE) + h[place[a]])
                    own = piece[a : b - 1 + LENGTH]
                    out.append((int(name.view(np.int64)[0]), zlib.crc32(own), did, first + a, own))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["bucket", "stretch", "did", "first", "piece"])

    return work


def repeated_spans(docs: DataFrame, on_step=None) -> DataFrame:
    """did, s, e: byte spans to remove (they may overlap); docs has did, unique and ordered, and text.

    on_step is called with the name of each step and its rows, at the price of a count.
    """
    rows = docs.mapInArrow(_bucket_rows, ROW)
    settled = materialize(settle(rows), "settled")
    del rows
    free_shuffles(docs.sparkSession)
    time.sleep(1)  # the engine deletes shuffle files on its own threads, and the next ones are as large
    end = (F.col("first") + F.col("count") + (LENGTH - 1)).cast("int")
    spans = [settled.where("done").select("did", F.col("first").alias("s"), end.alias("e"))]
    pieces = _fetch(settled.where("NOT done"), docs)
    turn = 0
    while True:
        turn += 1
        ordered = pieces.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
        found = materialize(ordered.mapInArrow(_sort_buckets, FOUND), "spans")
        del ordered, pieces
        free_shuffles(docs.sparkSession)
        spans.append(found.where("e IS NOT NULL").select("did", "s", "e"))
        if on_step is not None:
            on_step(f"refined {turn}", spans[-1].count())
        large = found.where("e IS NULL").select("did", "s", "bucket", "piece")
        if large.isEmpty():
            break
        finer = large.mapInArrow(_finer(turn), "bucket long, stretch long, did long, first int, piece binary")
        counted = finer.withColumn("m", F.count("*").over(Window.partitionBy("bucket"))).where("m > 1")
        part = F.when((F.col("m") > LARGE) & F.lit(turn < MOST_TURNS), F.pmod(F.col("stretch"), F.floor(F.col("m") / LARGE) + 1)).otherwise(F.lit(-1)).cast("int")
        pieces = counted.withColumn("part", part).select(*PIECE_COLUMNS)
    time.sleep(1)
    if on_step is not None:
        on_step("known to a shard", spans[0].count())
    return reduce(DataFrame.unionByName, spans)


def numbered(docs: DataFrame, doc_id: str, text: str, carry: bool = False) -> DataFrame:
    """docs' id and text with did: the id itself where ids are unique whole numbers, else the place in
    their order. With carry, all columns come along as a struct _row."""
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *own)
    if isinstance(docs.schema[doc_id].dataType, IntegralType):
        clash = plain.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
        if clash.isEmpty():
            return plain.withColumn("did", F.col("doc_id").cast("long"))
    order = plain.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return materialize(order.withColumn("did", F.monotonically_increasing_id()), "numbered")


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def _with_spans(docs: DataFrame, doc_id: str, text: str, carry: bool = False) -> DataFrame:
    """doc_id, text, spans of every row, and _row with carry."""
    prepare(docs.sparkSession)
    plain = numbered(docs, doc_id, text, carry)
    spans = repeated_spans(plain.select("did", "text"))
    lists = spans.groupBy("did").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return plain.join(lists, "did", "left").select("doc_id", "text", "spans", *(["_row"] if carry else []))


def removal_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, spans in zip(text_bytes(batch, "text"), batch.column(2).to_pylist(), strict=True):
                own = _merged(spans)
                out.append((len(t), sum(e - s for s, e in own), len(own), hashlib.sha256(kept_bytes(t, own)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = _with_spans(docs, doc_id, text)
    kind = docs.schema[doc_id].dataType.simpleString()
    return found.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with what is left of each text, null texts as they are; all columns stay. Bytes that no longer
    form a character are dropped here, though the report counts and digests them."""
    at = docs.columns.index(text)
    found = _with_spans(docs, doc_id, text, carry=True)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = found.select("_row.*", "spans").toDF(*names, "spans")

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, null = text_bytes(batch, f"c{at}"), batch.column(len(names)).to_pylist(), batch.column(at).is_null().to_pylist()
            left = [None if n else kept_bytes(t, _merged(s)).decode("utf-8", "ignore") for t, s, n in zip(texts, spans, null, strict=True)]
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(left, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return plain.mapInArrow(work, plain.drop("spans").schema).toDF(*docs.columns)
