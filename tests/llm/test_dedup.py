"""Jaccard join and repeated-passage removal against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import jaccard_join as J
from lamina.llm import substring_dedup as S
from lamina.llm.components import components


def brute_join(rows):
    split = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for _, t in rows:
        w = split.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(str((d, len(sets[i]), least.get(root(i)))) for i, (d, _) in enumerate(rows))


def near_copies(seed, groups=12, edits=(1, 12)):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [rng.choice(words) for _ in range(40)]  # a passage that unrelated texts share
    rows, n = [], 0
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.randrange(4, 150))]
        for _ in range(rng.choice([1, 1, 2, 5, 40 if g == 0 else 6])):
            text = list(base)
            for _ in range(rng.randrange(*edits)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.5:
                text[0:0] = shared
            rows.append((n, rng.choice([" ", "\n", "\t "]).join(text)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,chunk,frequent", [(1, 1 << 20, 200_000), (2, 300, 5), (3, 1500, 0), (4, 40, 200_000)])
def test_join_matches_brute_force(spark, monkeypatch, seed, chunk, frequent):
    monkeypatch.setattr(J, "CHUNK_ENTRIES", chunk)
    monkeypatch.setattr(J, "MOST_FREQUENT", frequent)
    monkeypatch.setattr(J, "PART_ENTRIES", 700)
    rows = near_copies(seed) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1004, "one TWO"), (None, "one two"), (5, "w1 w2 w3 w4 w5 w6"), (5, "w1 w2 w3 w4 w5 w6"), (None, "alone here")]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, component_id int").repartition(5)
    found = J.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(str(tuple(r)) for r in found) == brute_join(rows)


@pytest.mark.parametrize("seed", range(3))
def test_regions_and_windows_are_exact(spark, monkeypatch, seed):
    """The rounds alone, on sets at all distances: pivots, regions, windows and recursion all take part."""
    monkeypatch.setattr(J, "CHUNK_ENTRIES", 500)
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 300, 60).astype(np.uint64)) for _ in range(6)]
    sets = []
    for _ in range(150):
        s = base[rng.integers(len(base))]
        s = s[rng.random(len(s)) > rng.choice([0.02, 0.1, 0.3])]
        sets.append(np.unique(np.concatenate([s, rng.integers(0, 300, rng.integers(0, 8)).astype(np.uint64)])))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if 100 * inter >= 75 * (len(sets[i]) + len(sets[j]) - inter):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    rounds = []
    df = spark.createDataFrame([(i, len(s), s.tobytes()) for i, s in enumerate(sets)], "class long, n int, set binary")
    found = {r["node"]: r["component"] for r in J.join_by_pivots(df, rounds.append).collect()}
    assert [found.get(i, i) for i in range(len(sets))] == [root(i) for i in range(len(sets))]
    assert len(rounds) == 4 and all(r["pivots"] for r in rounds[:2])
    assert sum(r["members"] for r in rounds[:3]) > 0 and sum(r["replicas"] for r in rounds[:3]) > 0


def test_a_large_group_has_few_pairs(spark, monkeypatch):
    """Near copies of one text: what is measured stays far below the group's 180,000 pairs."""
    rng = np.random.default_rng(4)
    text = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(600):
        own = list(text)
        for at in rng.integers(0, 120, rng.integers(0, 4)):
            own[at] = f"x{i}"
        rows.append((i, " ".join(own)))
    rounds, join = [], J.join_by_pivots
    monkeypatch.setattr(J, "join_by_pivots", lambda sets: join(sets, rounds.append))
    found = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in found) == brute_join(rows)
    assert sum(r["members"] + r["replicas"] for r in rounds) < 18_000


def test_prefixes_never_lose_a_link():
    """need() shared shingles among the first prefix() ones are implied by a link."""
    rng = random.Random(3)
    for _ in range(3000):
        inter, a, b = rng.randrange(1, 60), rng.randrange(0, 16), rng.randrange(0, 16)
        if 100 * inter < 75 * (inter + a + b):
            continue
        kinds = ["both"] * inter + ["x"] * a + ["y"] * b
        rng.shuffle(kinds)
        nx, ny = inter + a, inter + b
        x, y = ([i for i, k in enumerate(kinds) if k in ("both", side)] for side in "xy")
        px, py = set(x[: int(J.prefix(np.int64(nx)))]), set(y[: int(J.prefix(np.int64(ny)))])
        assert len(px & py) >= 1
        shared_x = sum(kinds[i] == "both" and i in py for i in px)
        assert shared_x >= 1 and sum(kinds[i] == "both" for i in px) >= J.need(np.int64(nx))


def test_need_is_what_both_prefixes_share():
    """For all sizes and overlaps that link, as the shared shingles may come last in either set."""
    for nx in range(1, 200):
        for ny in range(max(1, 3 * nx // 4), 4 * nx // 3 + 2):
            for inter in range(1, min(nx, ny) + 1):
                if inter < max(nx, ny) and 100 * inter >= 75 * (nx + ny - inter):
                    least = min(int(J.prefix(np.int64(n))) - (n - inter) for n in (nx, ny))
                    assert least >= J.need(np.int64(nx)) and least >= J.need(np.int64(ny))


def test_short_texts_link(spark):
    """Texts of 7 words and the same with one word more, before or after: 3 of 4 shingles."""
    rows = []
    for g in range(30):
        words = [f"g{g}w{i}" for i in range(7)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join([f"g{g}x", *words] if g % 2 else [*words, f"g{g}x"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = J.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(str(tuple(r)) for r in found) == brute_join(rows)


def test_one_of_each_keeps_one(spark):
    text = " ".join(f"a{i}" for i in range(50))
    rows = [(3, text, "k"), (1, text + " x", "k"), (2, "other words entirely here now", "k"), (4, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    kept = J.one_of_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4]
    assert J.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("most", (1_000_000, 1))
def test_one_of_each_keeps_one_row(spark, monkeypatch, most):
    """Repeated rows, an id on several texts, null ids: one row of each group, in whatever order they come."""
    monkeypatch.setattr(J, "MOST_IDS", most)
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(50)) for x in "abcd")
    rows = [(1, a, "k"), (1, a, "k"), (1, a + " z", "k"), (7, a, "k"), (None, a, "k")]  # one group
    rows += [(1, b, "k"), (9, b, "k"), (9, d, "k"), (None, d + " z", "k")]  # ids 1 and 9 in two groups each
    rows += [(None, c, "k"), (None, c + " z", "m"), (None, c, "m")]  # a group without an id
    rows += [(3, None, "k"), (3, "", "k"), (None, " ", "k")]  # no words
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    kept = J.one_of_each(df.repartition(3)).collect()
    again = J.one_of_each(spark.createDataFrame(rows[::-1], df.schema)).collect()
    assert sorted(map(str, kept)) == sorted(map(str, again)) and len(kept) == 7
    assert sorted((r["text"][0], r["doc_id"] or 0) for r in kept if (r["text"] or "").strip()) == [("a", 1), ("b", 1), ("c", 0), ("d", 9)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    nodes = {x for u, v in links if u != v for x in (u, v)}
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {x: root(x) for x in nodes}


def brute_removal(rows):
    out, seen = {}, set()
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for i in order:
        t = (rows[i][1] or "").encode()
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - S.LENGTH + 1):
            w = t[s : s + S.LENGTH]
            if w in seen:
                gone[s : s + S.LENGTH] = True
            seen.add(w)
        runs = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
        out[rows[i][0]] = (len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def passages(seed):
    rng = random.Random(seed)
    alphabet = "abcdé \n"
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [make(n) for n in (60, 99, 100, 130, 400)]
    rows = []
    for i in range(40):
        text = make(rng.randrange(0, 300))
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            cut = rng.randrange(0, 30)
            at = rng.randrange(len(text) + 1)
            text = text[:at] + s[cut:] + text[at:]
        rows.append((i, text))
    rows += [(100, "z" * 350), (101, "z" * 120), (102, "xy" * 200), (103, rows[3][1]), (104, None), (105, ""), (106, make(50) + "z" * 99)]
    return rows


@pytest.mark.parametrize("large,shard,piece", [(4096, 8 << 20, (1 << 20) - 256), (2, 600, 400)])
def test_removal_matches_brute_force(spark, monkeypatch, large, shard, piece):
    monkeypatch.setattr(S, "LARGE", large)
    monkeypatch.setattr(S, "SHARD_BYTES", shard)
    monkeypatch.setattr(S, "PIECE", piece)
    monkeypatch.setattr(S, "SORT_BYTES", 3000)
    rows = passages(large)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, spans int").repartition(4)
    found = {r[0]: tuple(r[1:]) for r in S.removal_report(df).collect()}
    assert found == brute_removal(rows)


def test_repeated_and_null_ids(spark):
    rng = random.Random(6)
    t = "".join(rng.choice("abcdef") for _ in range(150))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "q" + t)], "doc_id long, text string")
    found = sorted((r["doc_id"] is None, r["doc_id"], r["n_removed"]) for r in S.removal_report(df).collect() if r["doc_id"] is not None)
    assert found == [(False, 1, 0), (False, 1, 150), (False, 2, 150)]
    assert S.removal_report(df.where("doc_id IS NULL")).first()["n_removed"] == 0
    assert S.removal_report(df.limit(0)).collect() == []
    left = {r["doc_id"]: r["text"] for r in S.deduplicate(df.where("doc_id = 2 OR doc_id IS NULL")).collect()}
    assert left == {2: "q" + t, None: ""}


def test_deduplicate_keeps_columns_and_orders_other_ids(spark):
    rng = random.Random(8)
    t = "".join(rng.choice("abcdef") for _ in range(150))
    df = spark.createDataFrame([("b", t, 1, "x"), ("a", t, 2, "y"), ("c", None, 3, "z"), (None, t + "!", 4, "w")], "doc_id string, text string, spans int, did string")
    left = S.deduplicate(df)
    assert left.columns == df.columns
    assert sorted((r["spans"], r["did"], r["text"]) for r in left.collect() if r["text"] is not None) == [(1, "x", ""), (2, "y", t), (4, "w", "!")]
    assert left.where("doc_id = 'c'").first()["text"] is None


def test_refinement_decides(spark, monkeypatch):
    """Passages in many documents, in shards of a few: what is removed between shards comes from sorted bytes,
    also where every hash of a stretch is the same."""
    monkeypatch.setattr(S, "SHARD_BYTES", 3000)
    rows = passages(7)
    df = spark.createDataFrame([(d, t) for d, t in rows], "did long, text string").repartition(4)
    steps = {}
    S.repeated_spans(df, lambda name, n: steps.update({name: n})).count()
    assert steps["refined 1"] > steps["known to a shard"] > 0
    plain = S.rows_of_piece
    monkeypatch.setattr(S, "rows_of_piece", lambda data: (plain(data)[0], np.zeros_like(plain(data)[1]), *plain(data)[2:]))
    found = {r[0]: tuple(r[1:]) for r in S.removal_report(df.select(F.col("did").alias("doc_id"), "text")).collect()}
    assert found == brute_removal(rows)


def test_stretch_pointers_tell_bytes_apart():
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 5))) * rng.randrange(1, 60) for _ in range(300)]
    bucket = np.array([rng.randrange(3) for _ in pieces])
    p = S.stretch_pointers(pieces, bucket)
    for i in range(300):
        for j in range(300):
            assert (p[i] == p[j]) == ((bucket[i], pieces[i]) == (bucket[j], pieces[j]))


def test_bucket_pointers_order_suffixes():
    rng = random.Random(9)
    data = bytes(rng.choice(b"ab") for _ in range(60)) * 6
    starts = np.arange(len(data) - S.LENGTH + 1)
    p = S.bucket_pointers(np.frombuffer(data, np.uint8), starts)
    for i in range(0, len(starts), 7):
        for j in range(0, len(starts), 5):
            a, b = data[i : i + S.LENGTH], data[j : j + S.LENGTH]
            assert (p[i] < p[j]) == (a < b) and (p[i] == p[j]) == (a == b)
