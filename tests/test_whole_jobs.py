"""Queries over all of their table, on one larger than the bounds of the queries over a part."""

from __future__ import annotations

import random

from lamina.operators.compaction import overlapping, overlapping_rows
from lamina.plans.changelog import changelog
from lamina.plans.oracles import ORACLES
from lamina.plans.queries import QUERIES
from lamina.store import KVStore

from .test_queries import compare

MORE = "/root/testdata/sf0.01"


def test_flush_takes_the_whole_log(spark, monkeypatch):
    """Every operation is written and flushed, in many flushes, and the state is that of the whole log."""
    stores, flush = [], KVStore.flush

    def watched(self):
        stores.append(self)
        flush(self)

    monkeypatch.setattr(KVStore, "flush", watched)
    compare(spark, MORE, QUERIES["flush_roundtrip"], ORACLES["flush_roundtrip"])
    state = stores[-1]._state
    assert len(stores) > 4 and not state.inline
    assert state.last_seq == changelog(spark, MORE).count()


def test_overlap_widens_to_the_fixpoint(spark):
    """Against overlapping(), on chains of files that one step does not reach."""
    rng = random.Random(4)
    for _ in range(3):
        at = [*(rng.randrange(300) for _ in range(40)), 98, 106, 114]
        rows = [(i, x, x + (8 if i >= 40 else rng.randrange(9))) for i, x in enumerate(at)]
        want, _, _ = overlapping([{"file_id": i, "min_key": a, "max_key": b} for i, a, b in rows], 90, 100)
        found = overlapping_rows(spark.createDataFrame(rows, "file_id long, lo long, hi long"), 90, 100)
        assert sorted(r["file_id"] for r in found.collect()) == sorted(f["file_id"] for f in want)
        assert len(want) > sum(b >= 90 and a <= 100 for _, a, b in rows)


def test_overlap_query_starts_from_all_files(spark):
    compare(spark, MORE, QUERIES["overlapping_files"], ORACLES["overlapping_files"])


def test_conflicts_of_all_keys_read(spark):
    for name in ("txn_conflicts", "txn_conflicts_compat"):
        compare(spark, MORE, QUERIES[name], ORACLES[name])
        assert QUERIES[name](spark, MORE).count() > 0


def test_sequence_numbers_are_gapless_over_many_partitions(spark):
    """With partitions of ranges that a sample decides, which differ between two runs of one plan."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        compare(spark, MORE, QUERIES["batch_atomic_sequence"], ORACLES["batch_atomic_sequence"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_pinned_snapshot_outlives_compactions_that_writes_make_due(spark, monkeypatch):
    """With a compaction after each batch, as larger tables have it."""
    merged, run = [], KVStore._run

    def watched(self, kind, *args):
        merged.append(self.snapshot())
        self.options.l0_slowdown_trigger = 8
        run(self, kind, *args)

    def eager(self, *args):
        self.options.l0_slowdown_trigger = 0
        return due(self, *args)

    due = KVStore.compact
    monkeypatch.setattr(KVStore, "_run", watched)
    monkeypatch.setattr(KVStore, "compact", eager)
    compare(spark, MORE, QUERIES["store_get_as_of"], ORACLES["store_get_as_of"])
    assert len(merged) > 1 and max(merged) > 5000
