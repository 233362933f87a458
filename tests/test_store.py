from __future__ import annotations

import random
import threading

import pytest

from lamina.errors import InvalidArgument, StoreError, StoreIOError
from lamina.records import Bound, CompactionStyle, Compression, KeyRange, Options
from lamina.sources.repair import repair
from lamina.store import KVStore, RateLimiter, WriteBatch

from .model import Model


def items(store, **kw):
    return dict(store.iterate(**kw))


def test_put_get_delete_reopen(spark, tmp_path):
    with KVStore(spark, str(tmp_path)) as db:
        db.put(b"k", b"v1")
        db.put(b"k", b"v2")
        db.put(b"", b"")
        db.delete(b"gone")
        assert db.get(b"k") == b"v2" and db.get(b"") == b"" and db.get(b"gone") is None
    again = KVStore(spark, str(tmp_path))
    assert items(again) == {b"": b"", b"k": b"v2"}
    with pytest.raises(StoreError):
        db.put(b"x", b"y")


def test_snapshots_read_the_past(spark, tmp_path):
    db = KVStore(spark, str(tmp_path))
    db.put(b"k", b"v1")
    snap = db.snapshot()
    db.put(b"k", b"v2")
    assert db.get(b"k", as_of=snap) == b"v1" and items(db, as_of=0) == {}


def test_pinned_snapshots_outlive_compaction(spark, tmp_path):
    db = KVStore(spark, str(tmp_path))
    db.put(b"k", b"v1")
    first = db.snapshot()
    db.pin(first)
    db.put(b"k", b"v2")
    second = db.snapshot()
    db.put(b"k", b"v3")
    db.compact_all()
    assert db.get(b"k", as_of=first) == b"v1" and db.get(b"k") == b"v3"
    with pytest.raises(InvalidArgument):
        db.get(b"k", as_of=second)
    db.unpin(first)


def test_delete_range(spark, tmp_path):
    db = KVStore(spark, str(tmp_path))
    for k in (b"a", b"b", b"c"):
        db.put(k, k)
    db.delete_range(KeyRange.half_open(b"b", b"c"))
    assert items(db) == {b"a": b"a", b"c": b"c"}
    db.delete_range(KeyRange.half_open(b"a", b"z"))
    db.put(b"b", b"new")
    assert items(db) == {b"b": b"new"}
    db.delete_range(KeyRange.half_open(b"z", b"a"))  # empty: nothing happens
    with pytest.raises(InvalidArgument):
        db.delete_range(KeyRange(Bound(b"a")))


def test_inclusive_bounds_are_exact_unless_compat():
    keys = KeyRange(Bound(b"a", False), Bound(b"c"))
    assert keys.normalised() == (b"a\0", b"c\0")
    assert keys.normalised(compat=True) == (b"b", b"d")
    with pytest.raises(InvalidArgument):
        KeyRange.closed(b"a", b"\xff").normalised(compat=True)


def test_merge_and_batches(spark, tmp_path):
    db = KVStore(spark, str(tmp_path))
    db.put(b"k", b"v1")
    db.merge(b"k", b"v2")
    cf = db.create_column_family("cf1")
    db.write_batch(WriteBatch().put(b"k", b"other", cf).merge(b"m", b"1").delete(b"k").merge(b"k", b"x"))
    assert db.get(b"k") == b"x" and db.get(b"k", cf) == b"other" and db.get(b"m") == b"1"
    with pytest.raises(InvalidArgument):
        db.put(b"k", b"v", 9)
    moved = WriteBatch().put(b"q", b"1").in_family(cf)
    db.write_batch(moved)
    assert db.get(b"q", cf) == b"1" and db.get(b"q") is None


def test_column_families_persist(spark, tmp_path):
    db = KVStore(spark, str(tmp_path))
    a = db.create_column_family("a")
    assert db.create_column_family("a") == a and db.column_family("zz") is None
    db.put(b"k", b"default")
    db.put(b"k", b"family", a)
    again = KVStore(spark, str(tmp_path))
    assert [c.name for c in again.list_column_families()] == ["default", "a"]
    assert again.get(b"k") == b"default" and again.get(b"k", again.column_family("a")) == b"family"


def test_transactions(spark, tmp_path):
    db = KVStore(spark, str(tmp_path))
    cf = db.create_column_family("cf")
    db.put(b"k", b"v1")
    t = db.begin_transaction()
    assert t.get(b"k") == b"v1"
    t.put(b"k", b"mine")
    assert t.get(b"k") == b"v1"  # not its own writes
    t.commit()
    assert db.get(b"k") == b"mine"
    t = db.begin_transaction()
    t.get(b"k")
    t.put(b"other", b"x")
    db.put(b"k", b"changed")
    with pytest.raises(InvalidArgument, match="conflict"):
        t.commit()
    assert db.get(b"other") is None
    t = db.begin_transaction()
    t.put(b"k", b"2")
    db.put(b"k", b"in another family", cf)
    t.commit()
    assert db.get(b"k") == b"2"


@pytest.mark.parametrize("flushed", (False, True))
def test_range_conflicts(spark, tmp_path, flushed):
    for compat in (False, True):
        db = KVStore(spark, str(tmp_path / str(compat)), Options(compat=compat))
        db.put(b"b", b"1")
        t, u = db.begin_transaction(), db.begin_transaction()
        t.get(b"b")
        t.put(b"x", b"1")
        u.delete_range(KeyRange.half_open(b"m", b"p"))
        db.delete_range(KeyRange.half_open(b"a", b"c"))
        db.put(b"n", b"1")
        if flushed:
            db.flush()
        for txn in (t, u):
            if compat:
                txn.commit()
            else:
                with pytest.raises(InvalidArgument):
                    txn.commit()


def test_two_writers_never_share_a_sequence_number(spark, tmp_path):
    stores = [KVStore(spark, str(tmp_path)) for _ in range(2)]

    def work(i):
        for j in range(20):
            stores[i].put(f"{i}-{j}".encode(), b"x")

    threads = [threading.Thread(target=work, args=(i,)) for i in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    db = KVStore(spark, str(tmp_path))
    seqs = [r["seq"] for r in db.raw_log().collect()]
    assert sorted(seqs) == list(range(1, 41)) and len(items(db)) == 40


@pytest.mark.parametrize("style", list(CompactionStyle))
def test_random_operations_with_flushes_match_the_model(spark, tmp_path, style):
    rng = random.Random(9)
    options = Options(compaction_style=style, l0_slowdown_trigger=2, level1_target_bytes=3000, level_multiplier=2, universal_size_ratio=500, compression=Compression.ZSTD, log_checkpoint_every=7)
    db, model = KVStore(spark, str(tmp_path), options), Model()
    cf = db.create_column_family("one")
    for step in range(60):
        key, c = bytes([97 + rng.randrange(6)]), rng.choice((0, cf.cf_id))
        kind = rng.randrange(10)
        if kind < 5:
            db.put(key, str(step).encode(), c)
            model.add(c, 1, key, str(step).encode())
        elif kind < 7:
            db.delete(key, c)
            model.add(c, 0, key)
        elif kind < 9:
            db.merge(key, b"+", c)
            model.add(c, 3, key, b"+")
        else:
            end = bytes([key[0] + 2])
            db.delete_range(KeyRange.half_open(key, end), c)
            model.add(c, 2, key, b"", end)
        if step % 12 == 11:
            db.flush()
            db.compact()
        if step == 30:
            db = KVStore(spark, str(tmp_path), options)
    want = model.state()
    assert {(c, k): v for c in (0, cf.cf_id) for k, v in db.iterate(cf=c)} == want
    db.compact_all()
    db.vacuum()
    db = KVStore(spark, str(tmp_path), options)
    assert {(c, k): v for c in (0, cf.cf_id) for k, v in db.iterate(cf=c)} == want


def test_obsolete_versions_go(spark, tmp_path):
    db = KVStore(spark, str(tmp_path))
    db.put(b"k", b"v1")
    db.put(b"k", b"v2")
    db.compact_all()
    assert db.raw_log().count() == 1
    kept = KVStore(spark, str(tmp_path / "k"), Options(drop_obsolete_versions_during_compaction=False))
    kept.put(b"k", b"v1")
    kept.put(b"k", b"v2")
    kept.compact_all()
    assert kept.raw_log().count() == 2


def test_ttl(spark, tmp_path):
    db = KVStore(spark, str(tmp_path), Options(ttl_filter_from_value_prefix_micros=True))
    db.put(b"k", (0).to_bytes(8, "little") + b"v")
    db.put(b"x", b"y")
    assert db.get(b"k") is not None and [r["key"] for r in db.scan(ttl_now=10).collect()] == [b"x"]
    db.compact_all(now_micros=10)
    assert items(db) == {b"x": b"y"}


def test_fifo_drops_the_oldest_files(spark, tmp_path):
    db = KVStore(spark, str(tmp_path), Options(compaction_style=CompactionStyle.FIFO, fifo_l0_max_bytes=1, auto_compact=False))
    for i in range(3):
        db.put(f"k{i}".encode(), b"x" * 80)
        db.flush()
    size = max(r["file_size"] for r in db.files().collect())
    db.options.fifo_l0_max_bytes = size * 2 + 10
    db.compact()
    assert set(items(db)) == {b"k1", b"k2"}


def test_trivial_move_and_split(spark, tmp_path):
    db = KVStore(spark, str(tmp_path), Options(l0_slowdown_trigger=1, level1_target_bytes=2000, level_multiplier=100, auto_compact=False, bloom_bits_per_key=0))
    for i in range(4):
        for j in range(10):
            db.put(f"{j}{i}".encode(), bytes(random.Random(i * 10 + j).randrange(256) for _ in range(80)))
        db.flush()
    db.compact()
    stats = {r["name"]: r["value"] for r in db.metrics().collect()}
    assert stats["compactions"] >= 1 and stats["trivial_moves"] >= 1
    assert {r["level"] for r in db.files().collect()} <= {1, 2} and len(items(db)) == 40


def test_ingest_checkpoint_repair(spark, tmp_path):
    a = KVStore(spark, str(tmp_path / "a"))
    a.put(b"k1", b"v1")
    a.put(b"k2", b"v2")
    a.flush()
    b = KVStore(spark, str(tmp_path / "b"))
    b.put(b"mine", b"1")
    b.put(b"k1", b"local")
    b.ingest([f"{tmp_path}/a/{r['path']}" for r in a.files().collect()], reassign_seq=True)
    assert items(b) == {b"mine": b"1", b"k1": b"v1", b"k2": b"v2"} and b.snapshot() == 4
    c = KVStore(spark, str(tmp_path / "c"))
    c.ingest([f"{tmp_path}/a/{r['path']}" for r in a.files().collect()], move=True)
    assert items(c) == {b"k1": b"v1", b"k2": b"v2"}
    c.put(b"k2", b"newer")
    c.create_checkpoint(str(tmp_path / "copy"))
    with pytest.raises(InvalidArgument):
        c.create_checkpoint(str(tmp_path / "copy"))
    c.delete(b"k1")
    assert items(KVStore(spark, str(tmp_path / "copy"))) == {b"k1": b"v1", b"k2": b"newer"}
    family = c.create_column_family("named")
    c.put(b"f", b"1", family)
    c.flush()
    for p in (tmp_path / "c" / "_log").iterdir():
        p.unlink()
    bad = tmp_path / "c" / "data" / "bad"
    bad.mkdir()
    (bad / "x.parquet").write_bytes(b"not parquet")
    report = repair(spark, str(tmp_path / "c"))
    assert report["set_aside"] == ["data/bad/x.parquet"]
    fixed = KVStore(spark, str(tmp_path / "c"))
    assert items(fixed) == {b"k2": b"newer"} and items(fixed, cf=fixed.column_family("named")) == {b"f": b"1"}


def test_write_ops_orders_by_ord_and_is_idempotent(spark, tmp_path):
    db = KVStore(spark, str(tmp_path))
    rows = [(i, 0, "put" if i % 3 else "merge", f"k{i % 5}".encode(), str(i).encode(), None) for i in range(100)]
    df = spark.createDataFrame(rows, "ord long, cf_id int, op string, key binary, value binary, end_key binary").repartition(5)
    db.write_ops(df, ("q", 0))
    db.write_ops(df, ("q", 0))
    model = Model()
    for _, _, op, k, v, _ in rows:
        model.add(0, 1 if op == "put" else 3, k, v)
    assert {(0, k): v for k, v in items(db).items()} == model.state() and db.snapshot() == 100
    with pytest.raises(InvalidArgument):
        db.write_ops(df.selectExpr("ord", "7 AS cf_id", "op", "key", "value", "end_key"))
    with pytest.raises(InvalidArgument):
        db.write_ops(df.selectExpr("ord", "cf_id", "'what' AS op", "key", "value", "end_key"))


def test_multi_get_table_and_properties(spark, tmp_path):
    db = KVStore(spark, str(tmp_path))
    seen = []
    db.set_event_listener(seen.append)
    db.put(b"a", b"1")
    db.flush()
    keys = spark.createDataFrame([(0, b"a"), (0, b"zz")], "cf_id int, key binary")
    assert {bytes(r["key"]): r["val"] and bytes(r["val"]) for r in db.multi_get(keys).collect()} == {b"a": b"1", b"zz": None}
    db.table(name="kv")
    assert spark.sql("SELECT count(*) AS n FROM kv").first()["n"] == 1
    stats = {r["name"]: r["value"] for r in db.property("lamina.stats").collect()}
    assert stats["puts"] == "1" and stats["flushes"] == "1" and stats["level_0_files"] == "1"
    assert db.property("lamina.options").count() >= 14 and db.property("lamina.other") is None
    assert [e[1] for e in seen] == ["flush"] and db.events().count() == 1
    assert [r["seq"] for r in db.latest_seq().collect()] == [1]


def test_unsynced_writes_are_seen_and_committed_on_close(spark, tmp_path):
    db = KVStore(spark, str(tmp_path), Options(sync=False))
    db.put(b"a", b"1")
    assert db.get(b"a") == b"1" and KVStore(spark, str(tmp_path)).get(b"a") is None
    db.close()
    assert KVStore(spark, str(tmp_path)).get(b"a") == b"1"


def test_rate_limiter_waits_for_tokens():
    now, slept = [0.0], []
    limiter = RateLimiter(100, clock=lambda: now[0], sleep=lambda s: slept.append(s))
    assert limiter.take(100) == 0 and limiter.take(50) == 0.5
    now[0] = 10
    assert limiter.take(100) == 0 and slept == [0.5]
    assert RateLimiter(0).take(10**9) == 0


def test_batch_sizes_follow_the_encoding():
    batch = WriteBatch().put(b"k", b"vv").delete(b"k").merge(b"k", b"o").delete_range(KeyRange.half_open(b"a", b"bc"))
    assert batch.encoded_size() == 4 + (13 + 1 + 2) + (9 + 1) + (13 + 1 + 1) + (13 + 1 + 2)


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ("commit:before", "commit:after", "flush:after_data", "compaction:after_data"))
def test_a_crash_leaves_one_version_or_the_next(spark, tmp_path, step):
    db = KVStore(spark, str(tmp_path))
    for i in range(5):
        db.put(f"k{i}".encode(), str(i).encode())
    before = items(db)

    def fault(at):
        if at == step:
            raise Crash(at)

    db.fault = db._log.fault = fault
    with pytest.raises(Crash):
        if step.startswith("commit"):
            db.put(b"new", b"1")
        else:
            db.compact_all() if step.startswith("flush") else None
            db.fault = db._log.fault = lambda s: None
            db.flush()
            db.fault = db._log.fault = fault
            db.compact_all()
    after = KVStore(spark, str(tmp_path))
    assert items(after) in (before, before | {b"new": b"1"})
    assert (b"new" in items(after)) == (step == "commit:after")
    after.put(b"later", b"1")
    after.vacuum()
    assert items(KVStore(spark, str(tmp_path)))[b"later"] == b"1"


OPS = "ord long, cf_id int, op string, key binary, value binary, end_key binary"


def puts(spark, name, n=20):
    return spark.createDataFrame([(i, 0, "put", f"{name}{i}".encode(), b"x", None) for i in range(n)], OPS)


def at_step(db, step, action):
    """Run action once when db reaches the step."""
    left = [action]

    def fault(at):
        if at == step and left:
            left.pop()()

    db.fault = db._log.fault = fault


@pytest.mark.parametrize("step", ("ops:after_data", "flush:after_data", "ingest:after_data", "compaction:after_data"))
def test_a_vacuum_leaves_what_another_writer_has_in_flight(spark, tmp_path, step):
    a, b = (KVStore(spark, str(tmp_path / "db")) for _ in range(2))
    a.put(b"k", b"1")
    if step.startswith("compaction"):
        a.flush()
    other = KVStore(spark, str(tmp_path / "other"))
    other.put(b"o", b"1")
    other.flush()
    at_step(a, step, b.vacuum)
    if step.startswith("ops"):
        a.write_ops(puts(spark, "a"))
    elif step.startswith("flush"):
        a.flush()
    elif step.startswith("ingest"):
        a.ingest([f"{tmp_path}/other/{r['path']}" for r in other.files().collect()], reassign_seq=True)
    else:
        a.compact_all()
    want = {b"k": b"1"} | ({f"a{i}".encode(): b"x" for i in range(20)} if step.startswith("ops") else {}) | ({b"o": b"1"} if step.startswith("ingest") else {})
    assert items(KVStore(spark, str(tmp_path / "db"))) == want
    assert not [n for n in a._files.list("_inflight") + a._files.list("_staging")]


def test_a_vacuum_leaves_renumbered_files_alone(spark, tmp_path):
    other = KVStore(spark, str(tmp_path / "other"))
    other.put(b"o", b"1")
    other.flush()
    a, b = (KVStore(spark, str(tmp_path / "db")) for _ in range(2))
    a.put(b"k", b"1")
    at_step(a, "commit:before", b.vacuum)
    a.ingest([f"{tmp_path}/other/{r['path']}" for r in other.files().collect()], reassign_seq=True)
    assert items(KVStore(spark, str(tmp_path / "db"))) == {b"k": b"1", b"o": b"1"}


def test_two_write_ops_side_by_side_both_end(spark, tmp_path):
    a, b = (KVStore(spark, str(tmp_path)) for _ in range(2))
    at_step(a, "ops:after_data", lambda: b.write_ops(puts(spark, "b")))
    a.write_ops(puts(spark, "a"))
    db = KVStore(spark, str(tmp_path))
    assert len(items(db)) == 40 and sorted(r["seq"] for r in db.raw_log().collect()) == list(range(1, 41))


def test_an_ingest_beside_a_write_keeps_its_numbers_apart(spark, tmp_path):
    other = KVStore(spark, str(tmp_path / "other"))
    other.put(b"k", b"theirs")
    other.flush()
    a, b = (KVStore(spark, str(tmp_path / "db")) for _ in range(2))
    at_step(a, "commit:before", lambda: b.put(b"k", b"mine"))
    a.ingest([f"{tmp_path}/other/{r['path']}" for r in other.files().collect()], reassign_seq=True)
    db = KVStore(spark, str(tmp_path / "db"))
    assert sorted(r["seq"] for r in db.raw_log().collect()) == [1, 2] and items(db) == {b"k": b"theirs"}


def test_a_pin_taken_during_a_compaction_holds(spark, tmp_path):
    a = KVStore(spark, str(tmp_path))
    a.put(b"k", b"1")
    seen = a.snapshot()
    a.put(b"k", b"2")
    a.flush()
    b = KVStore(spark, str(tmp_path))
    at_step(a, "compaction:after_data", lambda: b.pin(seen))
    a.compact_all()
    for db in (a, b, KVStore(spark, str(tmp_path))):
        db.refresh()
        assert db.get(b"k", as_of=seen) == b"1" and db.get(b"k") == b"2"


def test_a_pin_behind_a_compaction_is_refused(spark, tmp_path):
    a = KVStore(spark, str(tmp_path))
    a.put(b"k", b"1")
    seen = a.snapshot()
    a.put(b"k", b"2")
    b = KVStore(spark, str(tmp_path))
    a.compact_all()
    with pytest.raises(InvalidArgument):
        b.pin(seen)


def test_vacuum_deletes_what_nobody_needs(spark, tmp_path):
    db = KVStore(spark, str(tmp_path))
    db.put(b"k", b"1")
    db.flush()
    db.put(b"k", b"2")
    db.compact_all()
    assert len([n for n in db.vacuum() if n.endswith(".parquet")]) == 2
    (tmp_path / "data" / "dead").mkdir()
    (tmp_path / "data" / "dead" / "x.parquet").write_bytes(b"")
    (tmp_path / "_inflight" / "dead.json").write_text('{"folder": "data/dead", "at": 5}')
    assert db.vacuum(heed_marks_for=1e12) == [] and db.vacuum() == ["data/dead/x.parquet"]
    assert db._files.list("_inflight") == [] and items(db) == {b"k": b"2"}


def test_operands_are_folded_by_a_whole_compaction(spark, tmp_path):
    db = KVStore(spark, str(tmp_path), Options(merge_operator="sum"))
    for i in range(6):
        db.merge(b"a", str(i).encode())
        db.merge(b"c", b"1")
    db.delete_range(KeyRange.half_open(b"c", b"d"))
    db.merge(b"c", b"5")
    pinned = db.snapshot()
    db.pin(pinned)
    db.merge(b"a", b"10")
    before = items(db), items(db, as_of=pinned)
    db.compact_all()
    assert (items(db), items(db, as_of=pinned)) == before == ({b"a": b"25", b"c": b"5"}, {b"a": b"15", b"c": b"5"})
    assert db.raw_log().where("key = X'61'").count() == 2
    db.unpin(pinned)
    db.compact_all()
    assert db.raw_log().where("key = X'61'").count() == 1 and items(db) == before[0]


def test_a_stalled_write_waits_for_a_compaction(spark, tmp_path):
    options = Options(l0_slowdown_trigger=1, auto_compact=False, stall_wait_seconds=60)
    a, b = (KVStore(spark, str(tmp_path), options) for _ in range(2))
    for i in range(3):
        a._commit_ops([(0, 1, str(i).encode(), b"x", None)])
        a.flush()
    assert a.stall_reason()
    b.refresh()
    worker = threading.Thread(target=b.compact)
    worker.start()
    a.put(b"k", b"1")
    worker.join()
    assert not a.stall_reason() and len(items(a)) == 4


def test_multi_get_reads_only_files_that_may_hold_a_key(spark, tmp_path):
    db = KVStore(spark, str(tmp_path))
    for k in (b"a", b"m", b"z"):
        db.put(k, k)
        db.flush()
    keys = spark.createDataFrame([(0, b"m"), (0, b"n")], "cf_id int, key binary")
    found = db.multi_get(keys)
    assert {bytes(r["key"]): r["val"] and bytes(r["val"]) for r in found.collect()} == {b"m": b"m", b"n": None}
    assert len(found.inputFiles()) == 1
    assert db.multi_get(keys.limit(0)).count() == 0


class Faulty:
    """Files that fail at the n-th write_new of a commit: before it, torn in the middle, or after it."""

    def __init__(self, files, action):
        self._files, self.action, self.armed = files, action, True

    def __getattr__(self, name):
        return getattr(self._files, name)

    def write_new(self, name, data):
        if not self.armed or not name.endswith(".commit.json"):
            return self._files.write_new(name, data)
        self.armed = False
        if self.action == "torn":  # half of it, under the temporary name that it never leaves
            with open(self._files.path("_log/.torn.tmp"), "wb") as f:
                f.write(data[: len(data) // 2])
        if self.action == "after":
            self._files.write_new(name, data)
        raise StoreIOError({"full": "No space left on device"}.get(self.action, "input/output error"))


@pytest.mark.parametrize("action", ("before", "full", "torn", "after"))
@pytest.mark.parametrize("kind", ("put", "write_ops", "flush", "compact", "ingest", "family", "pin"))
def test_failing_commits(spark, tmp_path, kind, action):
    """Whatever fails and wherever: the old state or the new one, readable, and the store goes on."""
    db = KVStore(spark, str(tmp_path / "db"))
    db.put(b"a", b"1")
    if kind == "compact":
        db.flush()
    other = KVStore(spark, str(tmp_path / "other"))
    other.put(b"new0", b"x")
    other.flush()
    db._log._files = Faulty(db._files, action)
    do = {
        "put": lambda: db.put(b"new0", b"x"),
        "write_ops": lambda: db.write_ops(puts(spark, "new", 1)),
        "flush": db.flush,
        "compact": db.compact_all,
        "ingest": lambda: db.ingest([f"{tmp_path}/other/{r['path']}" for r in other.files().collect()], reassign_seq=True),
        "family": lambda: db.create_column_family("f"),
        "pin": lambda: db.pin(1),
    }[kind]
    with pytest.raises(StoreIOError):
        do()
    after = KVStore(spark, str(tmp_path / "db"))
    want = {b"a": b"1"} | ({b"new0": b"x"} if action == "after" and kind in ("put", "write_ops", "ingest") else {})
    assert items(after) == want
    after.vacuum()
    after.put(b"later", b"1")
    after.compact_all()
    after.vacuum()
    assert items(KVStore(spark, str(tmp_path / "db"))) == want | {b"later": b"1"}


def test_a_corrupt_commit_is_refused_and_repaired(spark, tmp_path):
    db = KVStore(spark, str(tmp_path))
    db.put(b"a", b"1")
    db.flush()
    db.put(b"b", b"2")
    newest = sorted((tmp_path / "_log").glob("*.commit.json"))[-1]
    newest.write_bytes(newest.read_bytes()[:-7])
    with pytest.raises(StoreError):
        KVStore(spark, str(tmp_path))
    repair(spark, str(tmp_path))
    assert items(KVStore(spark, str(tmp_path))) == {b"a": b"1"}


def test_repair_keeps_batches_beside_an_ingested_file_of_higher_numbers(spark, tmp_path):
    other = KVStore(spark, str(tmp_path / "other"))
    for i in range(9):
        other.put(b"o", str(i).encode())
    other.compact_all()
    db = KVStore(spark, str(tmp_path / "db"))
    db.put(b"a", b"1")
    db.ingest([f"{tmp_path}/other/{r['path']}" for r in other.files().collect()])
    db.put(b"b", b"2")
    want = items(db)
    repair(spark, str(tmp_path / "db"))
    assert items(KVStore(spark, str(tmp_path / "db"))) == want == {b"a": b"1", b"b": b"2", b"o": b"8"}


def test_log_points_do_not_repeat_what_is_buffered(spark, tmp_path):
    """A point grows with the number of batches, not their bytes, and a store reopens from it."""
    db = KVStore(spark, str(tmp_path), Options(log_checkpoint_every=4))
    for i in range(10):
        db.write_batch(WriteBatch([(0, 1, f"{i}-{j}".encode(), b"v" * 500, None) for j in range(20)]))
    points = sorted((tmp_path / "_log").glob("*.state.json"))
    assert len(points) == 2 and points[-1].stat().st_size < 2000
    assert db._state.inline_bytes == sum(len(k) + 9 + 500 for _, ops in db._state.inline for _, _, k, _, _ in ops)
    again = KVStore(spark, str(tmp_path))
    assert again._state == db._state and len(items(again)) == 200
    again.flush()
    assert not again._state.inline and not again._state.inline_bytes and len(items(KVStore(spark, str(tmp_path)))) == 200


def test_a_small_flush_runs_no_job_and_says_what_a_large_one_does(spark, tmp_path, monkeypatch):
    batch = WriteBatch([(1, 1, b"b", b"x", None), (0, 2, b"a", b"", b"zz"), (0, 3, b"a", b"", None), (0, 1, b"a", b"\0", None), (1, 0, b"", b"", None)])
    found = []
    for bound, name in ((1 << 20, "small"), (-1, "large")):
        monkeypatch.setattr("lamina.store.SMALL_FLUSH_BYTES", bound)
        db = KVStore(spark, str(tmp_path / name))
        db.create_column_family("cf1")
        db.write_batch(batch)
        spark.sparkContext.setJobGroup(name, "")
        db.flush()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(name)
        spark.sparkContext._jsc.clearJobGroup()
        assert bool(jobs) == (name == "large")
        again = KVStore(spark, str(tmp_path / name))
        facts = [{k: v for k, v in m.items() if k not in ("path", "file_size")} for m in again._state.files.values()]
        assert all(m["file_size"] == again._files.size(m["path"]) for m in again._state.files.values())
        found.append((facts, sorted(map(str, again.raw_log().collect())), items(again), items(again, cf=1)))
    assert found[0] == found[1]


@pytest.mark.parametrize("pins", [(), (20, 45)])
def test_a_small_merge_leaves_what_a_large_one_does(spark, tmp_path, monkeypatch, pins):
    """Random histories with all kinds of records, merged on the driver and by jobs; the driver must do its share."""
    found, own = [], []
    small = KVStore._merged_small
    monkeypatch.setattr(KVStore, "_merged_small", lambda self, *args: own.append(small(self, *args)) or own[-1])
    for bound, name in ((8 << 20, "small"), (-1, "large")):
        monkeypatch.setattr("lamina.store.SMALL_MERGE_BYTES", bound)
        rng = random.Random(7)
        db = KVStore(spark, str(tmp_path / name), Options(auto_compact=False, level1_target_bytes=3000))
        db.create_column_family("cf1")
        for p in pins:
            db.pin(p)
        db.write_batch(WriteBatch([(cf, 2, b"a", b"", b"z") for cf in (0, 1)]))
        for _ in range(3):
            ops = [(rng.randrange(2), rng.choice((0, 1, 3)), rng.choice(b"abcdefgh").to_bytes(), str(i).encode(), None) for i in range(30)]
            db.write_batch(WriteBatch([(c, vt, k, b"" if vt == 0 else v, e) for c, vt, k, v, e in ops]))
            db.flush()
        db.compact_all()
        found.append((sorted(map(str, db.raw_log().collect())), items(db), items(db, cf=1), [items(db, cf=1, as_of=p) for p in pins]))
    assert found[0] == found[1] and own[0] is not None and own[1] is None


@pytest.mark.parametrize("catalogs", [True, False])
def test_repair_takes_records_once_that_a_compaction_has_rewritten(spark, tmp_path, catalogs):
    db = KVStore(spark, str(tmp_path))
    for i in range(3):
        db.merge(b"k", str(i).encode())
        db.delete_range(KeyRange.half_open(b"k", b"l"))
        db.merge(b"k", b"x")
        db.merge(b"k", b"x")
        db.flush()
    db.put(b"gone", b"1")
    db.delete(b"gone")
    db.compact_all()
    db.merge(b"k", b"y")
    db.compact_all(2)
    want = items(db)
    db.close()
    for p in (tmp_path / "_log").iterdir():
        p.unlink()
    if not catalogs:  # as stores had them before they named what a rewrite replaces
        for p in (tmp_path / "data").glob("*/_segment.json"):
            p.write_text('{"families": [[0, "default"]]}')
    for _ in range(2):
        repair(spark, str(tmp_path))
        assert items(KVStore(spark, str(tmp_path))) == want == {b"k": b"xxy"}


def test_transaction_options_reach_the_write(spark, tmp_path):
    db = KVStore(spark, str(tmp_path))
    t = db.begin_transaction()
    t.set_write_options(sync=True)
    t.merge(b"m", b"1")
    t.delete_range(KeyRange.half_open(b"x", b"z"))
    t.commit()
    assert items(db) == {b"m": b"1"}
    t = db.begin_transaction()
    assert t.scan(KeyRange.half_open(b"a", b"n")).count() == 1
    t.put(b"q", b"1")
    db.put(b"c", b"1")  # into the range that was read
    with pytest.raises(InvalidArgument):
        t.commit()


def test_cached_segments_follow_the_store(spark, tmp_path):
    db = KVStore(spark, str(tmp_path), Options(block_cache_capacity_bytes=1 << 30))
    for i in range(4):
        db.put(f"k{i}".encode(), str(i).encode())
        db.flush()
        assert len(items(db)) == i + 1 and db.get(b"k0") == b"0"
    held = db._cached[1]
    assert held.storageLevel.useMemory and db.raw_log(key_range=KeyRange.closed(b"k1", b"k1"), cf_id=0).count() == 4
    seen = db.snapshot()
    db.pin(seen)
    db.delete(b"k1")
    db.compact_all()
    assert set(items(db)) == {b"k0", b"k2", b"k3"} and db.get(b"k1", as_of=seen) == b"1"
    assert db._cached[1] is not held and not held.storageLevel.useMemory
    db.close()
    assert db._cached is None


def test_auto_vacuum_deletes_compacted_files(spark, tmp_path):
    options = Options(auto_vacuum=True)
    db = KVStore(spark, str(tmp_path), options)
    for i in range(3):
        db.put(b"k", str(i).encode())
        db.flush()
    db.compact_all()
    assert {f"data/{n}" for n in db._files.list("data") if n.endswith(".parquet")} == set(db._state.files)
    (tmp_path / "data" / "dead").mkdir()
    (tmp_path / "data" / "dead" / "x.parquet").write_bytes(b"")
    assert items(KVStore(spark, str(tmp_path), options)) == {b"k": b"2"} and "dead/x.parquet" not in db._files.list("data")
