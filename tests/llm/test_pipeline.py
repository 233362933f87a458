"""Each stage of the pipeline against what it must do with what the stage before kept."""

from __future__ import annotations

import corpus_pipeline as P
from lamina.llm import decontaminate, pii

from .test_dedup import brute_join
from .test_models import brute_spans
from .test_search_rules_mix import brute_hits, naive_targets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = []
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == before.columns
        steps.append((before.collect(), docs.collect()))
    (a, kept), (b, single), (c, clean), (d, masked), (e, mixed) = steps
    gone = {r["doc_id"] for r in a} - {r["doc_id"] for r in kept}
    assert len(gone) <= 0.02 * len(a)
    components = [x.strip("()").split(", ") for x in brute_join([(r["doc_id"], r["text"]) for r in b])]
    assert {r["doc_id"] for r in single} == {int(x[2]) for x in components}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute_hits([(r["doc_id"], r["text"]) for r in c], items)
    assert {r["doc_id"] for r in clean} == {h[0] for h in hits if not h[5]}
    assert any(h[5] for h in hits)
    texts = {r["doc_id"]: r["text"] for r in d}
    for r in masked:
        base = [(k, s, t) for k, s, t in brute_spans(texts[r["doc_id"]])]
        assert not brute_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert base or r["text"] == texts[r["doc_id"]] or "<" in r["text"]
    sizes: dict = {}
    for r in e:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    taken: dict = {}
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + r["mix_words"]
        assert r["mix_copies"] in (1, 2, 3)
    for s, t in naive_targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= 5
    assert decontaminate.WINDOW == 10 and pii.KINDS == ("email", "ip", "card", "phone")


def test_an_empty_corpus_passes_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
