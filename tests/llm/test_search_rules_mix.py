"""URL rules, top-k search, source mixing and decontamination against brute force, and edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import decontaminate as D
from lamina.llm import mixing, topk, url_rules
from lamina.llm.oracles import ORACLES
from lamina.llm.queries import QUERIES
from tests.test_queries import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small, name):
    compare(spark, small, QUERIES[name], ORACLES[name])


def judged(spark, urls):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict_note string")
    rows = url_rules.judge_urls(df, [*url_rules.LISTED, *url_rules.DEFAULT_PATTERNS]).orderBy("page_id").collect()
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows]


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/x?a=/fr/", "http://a.example.com/en/", "http://a.net/es/1", "http://anet/es/1", "http://x.com", "http://x.com/", None, "", "no scheme", "http://spam-farm.example.org/a", "http://notspam-farmer.org/", "x://h/a://b/en", "http://example.com/EN/#f"]
    assert judged(spark, urls) == [
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("a.example.com", "/en/", "example.com/en/", "block"),
        ("a.net", "/es/1", "net/es/", "block"),
        ("anet", "/es/1", None, "allow"),
        ("x.com", "", None, "allow"),
        ("x.com", "/", "com/", "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("spam-farm.example.org", "/a", None, "block"),
        ("notspam-farmer.org", "/", None, "allow"),
        ("h", "/a://b/en", None, "allow"),
        ("example.com", "/EN/", "com/", "allow"),
    ]
    assert judged(spark, [])==[]


def test_rules_without_a_whole_token_are_always_tried(spark):
    rule = url_rules.Rule("tail", "block", "ab+c", ())
    df = spark.createDataFrame([("http://xabbc/",), ("http://xac/",)], "url string")
    assert [r["verdict"] for r in url_rules.judge_urls(df, [rule]).collect()] == ["block", "allow"]
    assert [r["verdict"] for r in url_rules.judge_urls(df, []).collect()] == ["allow", "allow"]


def test_thousands_of_rules(spark):
    """Every rule is found by its token, by host, subdomain and path, against a plain reading of the rules."""
    rng = random.Random(7)
    names = sorted({f"{rng.choice(['', 'a.', 'b.c.'])}h{rng.randrange(3000)}.{rng.choice(['test', 'org'])}/{rng.choice(['', 'x/', 'x/y/', 'z'])}" for _ in range(6000)})
    rules = [url_rules.host_path_rule(rng.choice(["allow", "block"]), n) for n in names]
    urls = [f"http://{rng.choice(['', 'a.', 'www.', 'b.c.'])}h{rng.randrange(3200)}.{rng.choice(['test', 'org'])}/{rng.choice(['', 'x/1', 'x/y/2', 'zz', 'w'])}" for _ in range(800)]

    def plain(url):
        host, _, path = url.split("://")[1].partition("/")
        fits = [r for r in rules for h, _, p in [r.name.partition("/")] if (host == h or host.endswith("." + h)) and ("/" + path).startswith("/" + p)]
        return max(((len(r.name), r.name, r.verdict) for r in fits), default=(0, None, "allow"))[1:]

    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [(r["rule"], r["verdict"]) for r in url_rules.judge_urls(df, rules).collect()] == [plain(u) for u in urls]


def test_clashing_columns_are_kept(spark):
    df = spark.createDataFrame([("http://a.net/es/", "mine", 7)], "url string, host string, Verdict int")
    [r] = url_rules.judge_urls(df, url_rules.LISTED).collect()
    assert r.asDict() == {"url": "http://a.net/es/", "host_given": "mine", "Verdict_given": 7, "host": "a.net", "path": "/es/", "rule": "net/es/", "verdict": "block"}


def test_keep_allowed_keeps_columns(spark):
    df = spark.createDataFrame([("http://a.net/es/", 1, 2), ("http://b.org/", 3, 4)], "url string, host int, rule int")
    assert [tuple(r) for r in url_rules.keep_allowed(df, url_rules.LISTED).collect()] == [("http://b.org/", 3, 4)]


def test_top_k_edges(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 3)
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 0.25]) for _ in range(3)], "e") for i in range(40)]
    rows += [(5, rows[5][1], "again"), (20, rows[20][1], "again"), (7, [1.0, 1.0, 1.0], "other"), (None, [1.0], "n"), (90, None, "n"), (91, [None, 1.0], "n"), (92, [float("nan")], "n"), (93, [float("inf")], "n"), (94, [], "n"), (95, [0.5], "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    found = topk.top_k(df, df.where("vec_id % 10 = 0"), k=5).collect()
    fine = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, qv in fine:
        if q % 10 == 0:
            scores = [(-sum(a * b for a, b in zip(qv, v)), i) for i, v in fine if i != q]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:5])]
    assert sorted(tuple(r) for r in found) == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).collect() == []


def test_scatter_equals_the_product():
    rng = np.random.default_rng(0)
    q, w = rng.integers(-3, 3, (5, 7)), rng.integers(-3, 3, (11, 7))
    assert (topk.accumulate(q, topk.postings(w), len(w)) == q @ w.T).all()


def test_huge_components_are_defined(spark):
    rows = [(0, [1.0]), (1, [1e300]), (2, [-1e300]), (3, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(df, df.where("vec_id = 0"), k=5).orderBy("rank").collect()
    wrapped = {1: -256, 2: 0, 3: 256 * 128}  # 256 times the largest and the least integer, in 64 bits
    assert [(r["vec_id"], r["score"]) for r in found] == sorted(wrapped.items(), key=lambda x: -x[1])


def test_budget_fits_are_near_and_within_counts():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = np.unique(rng.integers(0, 60, 12))
        counts = rng.integers(1, 9, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 5))
        taken = mixing.fit_budget(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        got = int((lengths * taken).sum())
        assert got <= budget and min(budget, total) - got <= lengths[lengths > 0].min(initial=60)


def test_budgets_beyond_the_table_are_cut_down_first(monkeypatch):
    monkeypatch.setattr(mixing, "TABLE_WORDS", 50)
    lengths, counts = np.array([3, 40, 700, 900]), np.array([30, 10, 5, 5])
    taken = mixing.fit_budget(lengths, counts, 5000)
    assert 5000 - int((lengths * taken).sum()) <= 3


def naive_targets(sizes, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * w[s] / sum(w[x] for x in order if x not in full) for s in order if s not in full}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s]) if s in full else share[s] for s in order}
        full |= over


def test_mix(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        source = rng.choice(["big"] * 8 + ["a", "é", "tiny", None])
        rows.append((i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 7, 7, 7, 50]))), source, i))
    rows += [(700, None, "a", 0), (701, "", "nothing", 0), (None, "one two", "a", 0), (3, rows[3][1], rows[3][2], 3), (702, "\u00a0x\x0by", "tiny", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    found = mixing.mix(df).collect()
    words = re.compile(r"[^\x20\x09-\x0D]+")
    sizes: dict = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(words.findall(t or ""))
    targets = naive_targets(sizes)
    assert len(found) == len(rows)
    taken: dict = {}
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 1, s
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    kept = mixing.mixed_documents(df)
    assert kept.columns == [*df.columns, "mix_copies", "mix_words", "mix_target"]
    assert kept.agg(F.sum("mix_words")).first()[0] == sum(taken.values())
    assert mixing.mix(df.limit(0)).collect() == []


@pytest.mark.parametrize("share", (1 / 3, 1.0))
def test_mix_splits_equal_rows(spark, share):
    """Rows that do not differ at all: as many are taken as the budget says, in reruns as well."""
    n = 600
    rows = [(None, "one two three", "a") if i < n * share else (i, " ".join("w" * (1 + i % 9)), "a") for i in range(n)]
    rows += [(1000 + i, "w " * 10, s) for i in range(100) for s in ("b", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    found = mixing.mix(df).collect()
    assert len(found) == len(rows)
    for s in "abc":
        own = [r for r in found if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < (3 if s == "a" else 10)  # their least lengths
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert mixing.mixed_documents(df).agg(F.sum("mix_words")).first()[0] == sum(r["taken"] for r in found)


def test_targets_of_many_sources(spark):
    rng = random.Random(5)
    sizes = {f"{rng.choice(['a', 'é', 'z', '𐐀', '｡'])}{i}": rng.choice([0, 1, 5, 50, 5000]) for i in range(300)} | {None: 7}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long").repartition(5)
    found = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = naive_targets(sizes)
    assert found.keys() == want.keys() and all(abs(found[s] - want[s]) < 1e-6 for s in want)
    assert mixing.source_targets(df.limit(0)).collect() == []


def brute_hits(docs, items):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: words.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    out = []
    for d, t in docs:
        w, hit, found = low(t), set(), set()
        for i, it in items:
            iw = low(it)
            if i is None or not iw:
                continue
            n = min(10, len(iw))
            for at in range(len(iw) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[at : at + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", (500_000, 15))
def test_decontamination_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    rng = random.Random(8)
    vocabulary = ["ab", "cd", "éf", "gh", "ij"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, text(30)), (2, text(12)), (10, text(3)), (11, "AB, cd"), (12, ""), (None, text(20)), (13, None), (2, "gh ij"), (14, "zz zz")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(40)]
    docs += [(50, items[0][1].upper().replace(" ", "-") + "!"), (51, None), (52, ""), (None, items[1][1]), (50, "zz Zz ZZ"), (53, text(9) + " " + items[0][1] + " " + text(4000))]
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_contamination(d, b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute_hits(docs, items)))
    left = D.decontaminate(d, b)
    assert left.columns == d.columns and left.count() == sum(not r["contaminated"] for r in found)
    assert D.find_contamination(d, b.limit(0)).where("contaminated").count() == 0
    few = D.find_contamination(spark.createDataFrame([(1, "alpha")], "doc_id long, text string"), spark.createDataFrame([(1, "alpha beta")], "item_id long, text string"))
    assert [(r["n_words"], r["longest"]) for r in few.collect()] == [(1, 0)]
    assert D.find_contamination(d.limit(0), b).count() == 0


def found_in(texts, items, blocks=1, window=10):
    cut = max(1, -(-len(items) // blocks))
    sets = [D.TestSet([(n, D.words_of(t.encode())) for n, t in items[i : i + cut]], window) for i in range(0, len(items), cut)]
    return list(D.scan([t.encode() for t in texts], sets, window))


def test_longest_matches_and_places():
    item = " ".join(f"w{i}" for i in range(25))
    [(n, hit, items, matches)] = found_in([f"x {item} y w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 z"], [("7", item)])
    assert (n, int(hit.sum()), items) == (38, 35, {"7"}) and matches == [(1, 25, "7", 0), (27, 10, "7", 0)]


def test_windows_that_only_adjoin_in_the_document_are_no_longer_match():
    w = [f"w{i}" for i in range(11)]
    [(n, hit, _, matches)] = found_in([" ".join(w)], [("a", " ".join([*w[:10], "x", *w[1:]]))])
    assert (n, int(hit.sum())) == (11, 11) and matches == [(0, 10, "a", 0), (1, 10, "a", 11)]


@pytest.mark.parametrize("doc,item", [("alpha", "alpha beta"), ("", "alpha"), ("alpha", "alpha"), ("a b", "b c d e f g h i j k l m"), ("a", "")])
def test_shards_of_few_words(doc, item):
    items = [("1", item)] if item else []
    [(n, hit, found, _)] = found_in([doc], items)
    assert n == len(doc.split()) and hit.tolist() == [w == item for w in doc.split()] and found == ({"1"} if doc == item else set())


def test_matches_are_all_maximal_common_stretches():
    rng = random.Random(3)
    for trial in range(60):
        window = rng.choice([2, 3, 10])
        text = lambda n: [rng.choice("abc") for _ in range(n)]
        docs, items = [text(rng.randrange(0, 40)) for _ in range(5)], [(str(i), text(rng.randrange(window, 30))) for i in range(4)]
        docs[0][3:3] = items[0][1]
        found = found_in([" ".join(d) for d in docs], [(n, " ".join(t)) for n, t in items], rng.choice([1, 3]), window)
        for d, (_, _, _, matches) in zip(docs, found, strict=True):
            want = set()
            for name, t in items:
                for i in range(len(d)):
                    for j in range(len(t)):
                        if i and j and d[i - 1] == t[j - 1]:
                            continue
                        n = 0
                        while i + n < len(d) and j + n < len(t) and d[i + n] == t[j + n]:
                            n += 1
                        if n >= window:
                            want.add((i, n, name, j))
            assert set(matches) == want
