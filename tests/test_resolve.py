from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lamina.functions.byte_functions import little_endian_u64, prefix_successor
from lamina.operators import coverage
from lamina.operators.compaction import expire, fold_operands, keep_needed
from lamina.operators.coverage import sweep
from lamina.operators.resolve import conflicts, resolve
from lamina.records import RECORD, Bound, KeyRange, successor

from .model import Model, random_ops


def frame(spark, log):
    return spark.createDataFrame(log, RECORD)


def held(df):
    return {(r["cf_id"], bytes(r["key"])): bytes(r["val"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(6))
def test_random_histories_match_the_model(spark, seed):
    model = random_ops(seed, 250)
    log = frame(spark, model.log)
    for as_of in (None, 0, 40, 133, 10_000):
        assert held(resolve(log, as_of)) == model.state(as_of)


def test_many_tombstones_are_swept_in_buckets(spark, monkeypatch):
    model = random_ops(77, 400)
    monkeypatch.setattr(coverage, "DRIVER_TOMBSTONES", 3)
    assert held(resolve(frame(spark, model.log))) == model.state()


def test_key_ranges(spark):
    model = random_ops(3, 300)
    log, state = frame(spark, model.log), model.state()
    for r in (
        KeyRange.half_open(b"a", b"b"),
        KeyRange.closed(b"a", b"ab"),
        KeyRange(Bound(b"a", False), Bound(b"b\xff", False)),
        KeyRange(Bound(b"b")),
        KeyRange.prefix(b"\xff"),
        KeyRange.all(),
    ):
        assert held(resolve(log, key_range=r)) == {k: v for k, v in state.items() if r.contains(k[1])}


def test_a_range_delete_that_starts_before_the_scan_counts(spark):
    model = Model()
    for k in (b"a", b"b", b"c"):
        model.add(0, 1, k, b"x")
    model.add(0, 2, b"a", b"", b"z")
    assert held(resolve(frame(spark, model.log), key_range=KeyRange.half_open(b"b", b"d"))) == {}


@pytest.mark.parametrize("seed", (1, 2))
def test_compaction_keeps_what_is_read(spark, seed):
    model = random_ops(seed, 250)
    log = frame(spark, model.log)
    kept = keep_needed(log, (60, 140))
    assert kept.count() < len(model.log)
    for as_of in (None, 60, 140):
        assert held(resolve(kept, as_of)) == model.state(as_of)
    assert held(resolve(keep_needed(log))) == model.state()


def test_operands_fold_into_values(spark):
    model = Model()
    for i in range(6):
        model.add(0, 3, b"k", bytes([65 + i]))
    model.add(0, 1, b"other", b"v")
    folded = fold_operands(frame(spark, model.log), 4, "append")
    assert folded.where("vt = 3").count() == 2
    assert held(resolve(folded)) == model.state()


def test_commutative_merges_equal_their_fold(spark):
    rows = [(0, b"a", 1, 1, b"10", None), (0, b"a", 2, 3, b"5", None), (0, b"a", 3, 3, b"-7", None), (0, b"b", 4, 3, b"3", None), (0, b"c", 5, 0, b"", None)]
    log = frame(spark, rows)
    assert held(resolve(log, merge="sum")) == {(0, b"a"): b"8", (0, b"b"): b"3"}
    assert held(resolve(log, merge="max"))[(0, b"a")] == b"5"
    assert held(resolve(log, merge="last"))[(0, b"a")] == b"-7"


def test_python_merge_may_make_a_key_absent(spark):
    log = frame(spark, [(0, b"a", 1, 1, b"1", None), (0, b"a", 2, 3, b"2", None), (0, b"b", 3, 3, b"3", None)])
    found = resolve(log, merge=lambda key, existing, operands: None if key == b"b" else (existing or b"") + b"|" + b"".join(operands))
    assert held(found) == {(0, b"a"): b"1|2"}


def test_expired_values_become_tombstones(spark):
    old, new = (5).to_bytes(8, "little"), (2**64 - 1).to_bytes(8, "little")
    log = frame(spark, [(0, b"k", 1, 1, old + b"v", None), (0, b"n", 2, 1, new, None), (0, b"s", 3, 1, b"short", None), (0, b"o", 4, 3, old, None)])
    assert {bytes(r["key"]): r["vt"] for r in expire(log, 10).collect()} == {b"k": 0, b"n": 1, b"s": 1, b"o": 3}


def test_byte_functions(spark):
    keys = [b"", b"a", b"a\xff", b"\xff\xff", b"ab\x0f\xff", b"\x0f\xf0"]
    found = spark.createDataFrame([(k,) for k in keys], "k binary").select("k", prefix_successor(F.col("k")).alias("s")).collect()
    for r in found:
        s = None if r["s"] is None else bytes(r["s"])
        assert s == successor(bytes(r["k"]))
    n = spark.createDataFrame([(bytes(range(1, 9)) + b"x",), (b"1234567",)], "v binary").select(little_endian_u64(F.col("v")).alias("n")).collect()
    assert int(n[0]["n"]) == int.from_bytes(bytes(range(1, 9)), "little") and n[1]["n"] is None


def test_sweep_makes_disjoint_intervals():
    got = sweep([(b"a", b"m", 1), (b"c", b"f", 5), (b"e", b"z", 3), (b"q", b"q", 9)])
    assert got == [(b"a", b"c", 1), (b"c", b"f", 5), (b"f", b"z", 3)]


def test_conflicts_see_ranges_unless_told_not_to(spark):
    log = frame(spark, [(0, b"a", 1, 1, b"", None), (0, b"a", 2, 2, b"", b"c")])
    reads = spark.createDataFrame([(0, b"a"), (0, b"b"), (1, b"b")], "cf_id int, key binary")
    assert {bytes(r["key"]) for r in conflicts(reads, log, 1).collect()} == {b"a", b"b"}
    assert {bytes(r["key"]) for r in conflicts(reads, log, 1, ranges=False).collect()} == {b"a"}


def test_key_conditions_reach_the_scan(spark, small, tmp_path):
    path = f"file://{tmp_path}/log"
    frame(spark, random_ops(5, 200).log).write.parquet(path)
    log = spark.read.schema(RECORD).parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = resolve(log, key_range=KeyRange.half_open(b"a", b"b"), has_tombstones=False)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan


def test_empty_log(spark):
    assert resolve(frame(spark, [])).collect() == []
