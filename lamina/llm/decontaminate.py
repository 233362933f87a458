"""Benchmark decontamination with training suffix arrays.

Each shard of training documents gets a suffix array over its words, once; every benchmark suffix is
binary-searched in the array of every shard, which gives the verbatim matches with their locations,
the longest of them, and from those the documents to remove.

A shard numbers its words in order of first sight, and suffixes are ordered by their first `window`
words, packed into integers: q-gram buckets by the first of these, refined by the later ones. A
benchmark suffix is looked up by its own first words (all of it, if it is shorter than a window); one
with a word that the shard lacks has no match. Suffixes that hold a whole window give places; those
of one item that continue each other, in the document and in the item, are parts of one longer match.

Scale: documents never move; a shard is at most SHARD_BYTES of text, or one longer document. The
benchmark goes to the executors in blocks of at most BLOCK_WORDS words; every shard meets each block,
one after another, so its size bounds what is in memory, not what is searched.

Edge cases: null or empty texts have no words and no hits; items with a null id or no words are no
items, repeated items count once; an item shorter than a window is one window itself; documents with
null or repeated ids keep one row each; a shard may have fewer words than a window, or none; empty
tables give empty results or no hits; extra columns pass through decontaminate() and are otherwise
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, lean, prepare, shards

by_value(__name__)

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_WORDS = 500_000
#: Bytes of a word: digits, lower-case letters, and all of any character beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """bytes.lower() changes A-Z only."""
    return WORD.findall(text.lower())


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """UTF-8 bytes of one text after another; null is empty."""
    for text in batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()):
        yield text.as_py() or b""


class TestSet:
    """The distinct suffixes of a block of items, cut to a window: their words, lengths and owners.

    words are the block's distinct words; row s of suffixes has the places of its words in that list,
    -1 behind its end. The items that hold s, and where, are owner_item and owner_offset from
    owner_start[s] on. whole tells whether s is a window.
    """

    __test__ = False

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        place: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        whole: dict[tuple[int, ...], bool] = {}
        kept = list(dict.fromkeys((name, tuple(words)) for name, words in items))
        for item, (_, words) in enumerate(kept):
            ids = [place.setdefault(w, len(place)) for w in words]
            for at in range(len(ids)):
                own = tuple(ids[at : at + window])
                if at == 0 or len(own) == window:
                    owners.setdefault(own, []).append((item, at))
                    whole[own] = True
                else:  # too short for a window: searched, but it gives no place
                    owners.setdefault(own, [])
                    whole.setdefault(own, False)
        self.names, self.words, self.window = [name for name, _ in kept], list(place), window
        self.lengths = np.array([len(x) for x in owners], np.int64)
        self.suffixes = np.full((len(owners), window), -1, np.int32)
        for i, own in enumerate(owners):
            self.suffixes[i, : len(own)] = own
        self.whole = np.array([whole[x] for x in owners], bool)
        self.owner_start = np.cumsum([0, *[len(x) for x in owners.values()]])
        flat = np.array([x for own in owners.values() for x in own], np.int64).reshape(-1, 2)
        self.owner_item, self.owner_offset = flat[:, 0], flat[:, 1]


def _search(column: Callable[[np.ndarray], np.ndarray], lo: np.ndarray, hi: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of every value in its own sorted stretch [lo, hi) of column."""
    lo, hi = lo.copy(), hi.copy()
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) >> 1
        own = column(mid)
        below = own <= value[open_] if right else own < value[open_]
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
    return lo


class Shard:
    """The words of some texts, numbered from 1, and the array of their suffixes to `depth` words.

    The texts lie one after another with depth zeros behind each, text i from starts[i] on. key[p + l *
    pack] holds words l * pack and the following of the suffix at p, packed into one integer; order has
    the places of the suffixes, sorted. Words are taken in one text at a time, and only key and order
    stay: a worker's memory counts against its executor, beside all that earlier stages left there.
    """

    def __init__(self, words: Iterable[list[bytes]], depth: int):
        self.vocabulary: dict[bytes, int] = {}
        number, texts = self.vocabulary.setdefault, []
        for own in words:
            texts.append(np.fromiter((number(w, len(self.vocabulary) + 1) for w in own), np.int32, len(own)))
        self.sizes = [len(x) for x in texts]
        self.starts = np.cumsum([0, *[n + depth for n in self.sizes]])
        self.length = int(self.starts[-1])
        self.bits = max(1, (len(self.vocabulary) + 1).bit_length())
        self.pack = min(depth, 63 // self.bits)
        self.levels = -(-depth // self.pack)
        ids = np.zeros(self.length + self.pack + self.levels * self.pack, np.int32)
        for at, own in zip(self.starts.tolist(), texts, strict=False):
            ids[at : at + len(own)] = own
        del texts
        self.key = np.zeros(len(ids) - self.pack, np.int64)
        for j in range(self.pack):
            self.key <<= self.bits
            self.key |= ids[j : j + len(self.key)]
        start = np.flatnonzero(ids).astype(np.int32)
        del ids
        self.order = self._sorted(start, 0)
        first = self.key[self.order]
        differs = np.ones(len(first) + 1, bool)
        np.not_equal(first[1:], first[:-1], out=differs[1:-1])
        del first
        spot = np.flatnonzero(~(differs[:-1] & differs[1:]))  # a suffix alone in its bucket is in place
        if len(spot):
            rest = self.order[spot]
            for level in range(self.levels - 1, -1, -1):
                rest = self._sorted(rest, level)
            self.order[spot] = rest

    def _sorted(self, places: np.ndarray, level: int) -> np.ndarray:
        """Suffixes by one level of their keys; equal ones stay in their order."""
        return places[np.argsort(self.key[places + level * self.pack], kind="stable")]

    def find(self, tests: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The test suffixes that occur, and for each the stretch of the array that begins with it."""
        numbers = np.array([0, *map(self.vocabulary.get, tests.words, [0] * len(tests.words))], np.int32)
        ids = numbers[tests.suffixes + 1]
        behind = tests.suffixes < 0
        known = np.flatnonzero(((ids > 0) | behind).all(1)) if len(ids) else np.zeros(0, np.int64)
        ids, behind = ids[known], behind[known]
        room = self.levels * self.pack - ids.shape[1] if len(ids) else 0
        if room:
            ids = np.pad(ids, ((0, 0), (0, room)))
            behind = np.pad(behind, ((0, 0), (0, room)), constant_values=True)
        lo, hi = np.zeros(len(known), np.int64), np.full(len(known), len(self.order))
        for level in range(self.levels):
            column = lambda at, ahead=level * self.pack: self.key[self.order[at] + ahead]
            low, high = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
            for j in range(level * self.pack, (level + 1) * self.pack):
                open_end = behind[:, j] if len(known) else np.zeros(0, bool)
                word = ids[:, j] if len(known) else np.zeros(0, np.int64)
                low = low << self.bits | np.where(open_end, 0, word)
                high = high << self.bits | np.where(open_end, (1 << self.bits) - 1, word)
            new_lo = _search(column, lo, hi, low, False)
            lo, hi = new_lo, _search(column, new_lo, hi, high, True)
        found = lo < hi
        return known[found], lo[found], hi[found]


def scan(texts: Iterable[bytes], blocks: list, window: int = WINDOW) -> Iterator[tuple[int, np.ndarray, set[str], list[tuple[int, int, str, int]]]]:
    """For each text: its number of words, which are hit, the items, and the maximal matches.

    A match is (first word, number of words, item, first word in the item): verbatim, at least a window
    long, and not part of a longer one.
    """
    shard = Shard(map(words_of, texts), window)
    covered = np.zeros(shard.length + 1, np.int32)
    matches: list[set[tuple[int, int, str, int]]] = [set() for _ in shard.sizes]
    for block in blocks:
        tests: TestSet = block.value if hasattr(block, "value") else block
        suffix, lo, hi = shard.find(tests)
        places = tests.whole[suffix]
        suffix, lo, sizes = suffix[places], lo[places], (hi - lo)[places]
        at = shard.order[np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)].astype(np.int64)
        suffix = np.repeat(suffix, sizes)
        length = tests.lengths[suffix]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + length, -1)
        # every place with each item that owns its suffix, in order of item, shift and place
        n = (tests.owner_start[1:] - tests.owner_start[:-1])[suffix]
        owner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(tests.owner_start[suffix], n)
        at, length = np.repeat(at, n), np.repeat(length, n)
        item, offset = tests.owner_item[owner], tests.owner_offset[owner]
        order = np.lexsort((at, at - offset, item))
        at, length, item, offset = at[order], length[order], item[order], offset[order]
        if len(at):
            follows = (item[1:] == item[:-1]) & (at[1:] == at[:-1] + 1) & (offset[1:] == offset[:-1] + 1)
            begin = np.flatnonzero(np.r_[True, ~follows])
            end = np.r_[begin[1:], len(at)] - 1
            doc = np.searchsorted(shard.starts, at[begin], "right") - 1
            for d, a, z, i, o in zip(doc.tolist(), at[begin].tolist(), (at + length)[end].tolist(), item[begin].tolist(), offset[begin].tolist(), strict=True):
                matches[d].add((a - int(shard.starts[d]), z - a, tests.names[i], o))
        if len(blocks) > 1 and hasattr(block, "value"):
            block.__dict__.pop("_value", None)  # a worker holds one block at a time
    hit = np.cumsum(covered, out=covered) > 0
    for n, start, found in zip(shard.sizes, shard.starts.tolist(), matches, strict=False):
        yield n, hit[start : start + n], {m[2] for m in found}, sorted(found)


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, window: int) -> list:
    """The items in broadcasts of at most BLOCK_WORDS words (or one longer item)."""
    sc = benchmark.sparkSession.sparkContext
    out, held, size = [], [], 0
    rows = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("string"), text)
    for name, words in ((r[0], words_of(r[1].encode())) for r in rows.toLocalIterator()):
        if words:
            held.append((name, words))
            size += len(words)
        if size >= BLOCK_WORDS:
            out.append(sc.broadcast(TestSet(held, window)))
            held, size = [], 0
    if held:
        out.append(sc.broadcast(TestSet(held, window)))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, n_matches, matches.

    longest is the number of words of the longest verbatim match; matches holds every maximal match
    as (start, n_words, item_id, item_start). The digest is of the items' ids, sorted and joined by commas.
    """
    prepare(docs.sparkSession)
    blocks = benchmark_blocks(benchmark, item_id, item_text, window)

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "n_words", "item_id", "item_start")
        match = pa.list_(pa.struct([(n, pa.string() if n == "item_id" else pa.int64()) for n in names]))
        for shard in shards(batches, "text", SHARD_BYTES):
            out = []
            for n, hit, items, found in scan(texts_of(shard, "text"), blocks, window):
                digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
                out.append((n, int(hit.sum()), len(items), digest, bool(hit.any()), max((m[1] for m in found), default=0), len(found), [dict(zip(names, m, strict=True)) for m in found]))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), match]
            columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "n_matches", "matches"]
            yield pa.RecordBatch.from_arrays([shard.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], columns)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, n_matches long, matches array<struct<start:long,n_words:long,item_id:string,item_start:long>>"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without the rows that hold a window of any item; columns stay as they are."""
    prepare(docs.sparkSession)
    blocks = benchmark_blocks(benchmark, item_id, item_text, window)
    at = docs.columns.index(text)

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, f"c{at}", SHARD_BYTES):
            clean = [not hit.any() for _, hit, _, _ in scan(texts_of(shard, f"c{at}"), blocks, window)]
            yield shard.filter(pa.array(clean, pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(work, plain.schema).toDF(*docs.columns)
