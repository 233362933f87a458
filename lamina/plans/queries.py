"""The driver queries: each operator of the engine over the canonical change logs.

Keys and values come out as strings, so that results compare with SQL's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.byte_functions import BATCH_OVERHEAD, LOG_RECORD_OVERHEAD, op_bytes, prefix_successor
from ..operators import compaction
from ..operators.coverage import covering_seq, with_coverage
from ..operators.merge import from_python
from ..operators.resolve import conflicts, latest_seq, multi_get, range_conflicts, resolve
from ..records import MERGE_OPERAND, RANGE_TOMBSTONE, TOMBSTONE, VALUE, Bound, CompactionStyle, KeyRange, Options
from ..sources.repair import repair
from ..store import KVStore, WriteBatch
from ..streaming.sink import write_stream
from .changelog import changelog, counter_log, order_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Operations of one batch that goes through a store's buffer.
BATCH_OPS = 400


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def shown(df: DataFrame) -> DataFrame:
    """Binary columns as strings; record types as plain integers."""
    return df.select(*[F.col(c).cast("string").alias(c) if t == "binary" else F.col(c).cast("int").alias(c) if t == "tinyint" else F.col(c) for c, t in df.dtypes])


def _register(name: str, make: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = make


@query
def latest_full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resolve(changelog(spark, sf_dir)))


for _name, _as_of in (("scan_as_of_snapshot", 3000), ("scan_as_of_zero", 0), ("scan_beyond_last", 10**9)):
    _register(_name, lambda s, d, a=_as_of: shown(resolve(changelog(s, d), as_of=a)))

_KEY = KeyRange.closed(b"000042", b"000042")
_register("point_get", lambda s, d: shown(resolve(changelog(s, d), key_range=_KEY, cf_id=0)))
_register("get_in_family", lambda s, d: shown(resolve(changelog(s, d), key_range=_KEY, cf_id=1)))
_register("get_as_of", lambda s, d: shown(resolve(changelog(s, d), as_of=5000, key_range=_KEY, cf_id=0)))

for _name, _range in (
    ("range_scan_half_open", KeyRange.half_open(b"000020", b"000060")),
    ("range_scan_inclusive", KeyRange.closed(b"000020", b"000060")),
    ("range_scan_exclusive", KeyRange(Bound(b"000020", False), Bound(b"000060", False))),
    ("range_scan_unbounded", KeyRange(Bound(b"000060"))),
    ("prefix_scan", KeyRange.prefix(b"00001")),
):
    _register(_name, lambda s, d, r=_range: shown(resolve(changelog(s, d), key_range=r)))
_register("range_scan_as_of", lambda s, d: shown(resolve(changelog(s, d), 4000, KeyRange.half_open(b"000020", b"000060"))))


@query
def multi_get_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([(cf, k) for cf in (0, 1) for k in (b"000003", b"000007", b"000011", b"000042", b"999999")], "cf_id int, key binary")
    return shown(multi_get(resolve(changelog(spark, sf_dir)), keys))


QUERIES["multi_get"] = QUERIES.pop("multi_get_keys")


@query
def reverse_top_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resolve(changelog(spark, sf_dir), cf_id=0).orderBy(F.desc("key")).limit(10))


@query
def cf_isolation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(changelog(spark, sf_dir)).groupBy("cf_id").agg(F.count("*").alias("n"))


@query
def put_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resolve(changelog(spark, sf_dir).where(F.col("vt") == VALUE), has_tombstones=False, has_operands=False))


@query
def delete_suppresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = changelog(spark, sf_dir).where(F.col("vt").isin(TOMBSTONE, VALUE))
    return shown(base.groupBy("cf_id", "key").agg(F.max_by("vt", "seq").alias("t")).where(F.col("t") == TOMBSTONE).select("cf_id", "key"))


def _heads(log: DataFrame) -> DataFrame:
    """cf_id, key, cov, newest base record (b), newest operand's seq (top)."""
    base = F.max(F.when(F.col("vt").isin(TOMBSTONE, VALUE), F.struct("seq", "vt", "val"))).alias("b")
    top = F.max(F.when(F.col("vt") == MERGE_OPERAND, F.col("seq"))).alias("top")
    return with_coverage(log.where(F.col("vt") != RANGE_TOMBSTONE).groupBy("cf_id", "key").agg(base, top), log.where(F.col("vt") == RANGE_TOMBSTONE))


@query
def delete_range_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose newest base is a value, hidden only by a range tombstone."""
    hidden = (F.col("b.vt") == VALUE) & (F.col("b.seq") <= F.col("cov")) & (F.coalesce("top", F.lit(0)) <= F.col("cov"))
    return shown(_heads(changelog(spark, sf_dir)).where(hidden).select("cf_id", "key", "cov"))


@query
def delete_range_then_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = (F.col("cov") > 0) & (F.col("b.vt") == VALUE) & (F.col("b.seq") > F.col("cov"))
    return shown(_heads(changelog(spark, sf_dir)).where(later).select("cf_id", "key", F.col("b.val").alias("val")))


@query
def covering_tombstone_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(covering_seq(changelog(spark, sf_dir)))


_register("merge_append", latest_full_scan)
_register("merge_sum", lambda s, d: shown(resolve(counter_log(s, d), merge="sum")))
for _merge in ("max", "min", "last", "set_union"):
    _register(f"merge_{_merge}", lambda s, d, m=_merge: shown(resolve(changelog(s, d), merge=m)))


@query
def merge_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined_length(key, existing, operands):
        return str(len((existing or b"") + b"".join(operands))).encode()

    # without operands a value stays as it is, so it is measured here
    found = resolve(changelog(spark, sf_dir), merge=from_python(joined_length))
    digits = F.col("val").cast("string").rlike("^[0-9]+$")
    return shown(found.withColumn("val", F.when(digits, F.col("val")).otherwise(F.octet_length("val").cast("string").cast("binary"))))


@query
def merge_no_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changelog(spark, sf_dir)
    heads = _heads(log)
    live = (F.col("b.vt") == VALUE) & (F.col("b.seq") > F.col("cov"))
    rootless = heads.where(~F.coalesce(live, F.lit(False))).select("cf_id", "key")
    return shown(resolve(log).join(rootless, ["cf_id", "key"], "left_semi"))


@query
def batch_atomic_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence numbers by ord within partitions of ordered ranges: no single task sorts the batch.

    The ranges follow from a sample that differs from run to run, so the placed rows are written once;
    their counts and their numbers come from the same partitions.
    """
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("ord"))
    staged = _folder(spark)
    rows.repartitionByRange("ord").sortWithinPartitions("ord").withColumn("at", F.monotonically_increasing_id()).write.parquet(staged)
    placed = spark.read.schema("ord long, at long").parquet(staged)
    counts = {r[0]: r[1] for r in placed.groupBy(F.shiftright("at", 33)).count().collect()}
    before, shift = 100, {}
    for p in sorted(counts):
        shift[p] = before - (p << 33)
        before += counts[p]
    if not shift:
        return placed.select("ord", F.col("at").alias("seq"))
    offset = F.element_at(F.create_map(*[F.lit(x) for p in sorted(shift) for x in (p, shift[p])]), F.shiftright("at", 33))
    return placed.select("ord", (F.col("at") + offset + 1).alias("seq"))


@query
def latest_seq_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(latest_seq(changelog(spark, sf_dir)))


def _read_set(log: DataFrame) -> DataFrame:
    """All keys read up to the transaction's snapshot."""
    return log.where("seq <= 9000").select("cf_id", "key").distinct()


@query
def txn_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changelog(spark, sf_dir)
    return shown(conflicts(_read_set(log), log, 9000))


@query
def txn_conflicts_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changelog(spark, sf_dir)
    return shown(conflicts(_read_set(log), log, 9000, ranges=False))


@query
def txn_range_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = spark.createDataFrame([(0, b"000010", b"000012"), (1, b"000100", b"000101"), (0, b"900000", b"900001")], "cf_id int, start binary, end binary")
    return shown(range_conflicts(held, changelog(spark, sf_dir), 9900))


_register("compact_keep_rule", lambda s, d: shown(compaction.keep_needed(changelog(s, d))))
_register("compact_keep_pinned", lambda s, d: shown(compaction.keep_needed(changelog(s, d), (1500, 3000, 7777)).select("cf_id", "key", "seq", "vt")))
_register("compact_preserves_resolve", lambda s, d: shown(resolve(compaction.keep_needed(changelog(s, d)))))


@query
def compact_folds_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operands up to the newest range tombstone stay; keys without any are folded, and read the same."""
    log = changelog(spark, sf_dir)
    untouched = covering_seq(log).where("cov = 0").select("cf_id", "key")
    folded = compaction.fold_operands(log.where(F.col("vt") != RANGE_TOMBSTONE).join(untouched, ["cf_id", "key"], "left_semi"), 2**62, "append")
    rest = log.join(untouched, ["cf_id", "key"], "left_anti").where(F.col("vt") != RANGE_TOMBSTONE).unionByName(log.where(F.col("vt") == RANGE_TOMBSTONE))
    return shown(resolve(folded.unionByName(rest)))


@query
def ttl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values led by their event's time, little-endian; the expired ones become tombstones."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    stamp = F.unhex(F.concat(*[F.substring(F.lpad(F.hex(micros), 16, "0"), 15 - 2 * i, 2) for i in range(8)]))
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.lit(0).alias("cf_id"), F.col("event_id").cast("string").cast("binary").alias("key"), F.col("event_id").alias("seq"), F.lit(VALUE).cast("byte").alias("vt"), F.concat(stamp, F.lit(b"v")).alias("val")
    )
    return compaction.expire(log, 1704500000000000).select("seq", F.col("vt").cast("int").alias("vt"))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file catalog made of lineitem: a file for each 64 orders."""
    number = F.floor(F.col("l_orderkey") / 64).cast("long")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(number.alias("file_id"), F.floor("l_extendedprice").cast("long").alias("p"), "l_partkey")
    files = lines.groupBy("file_id").agg(F.sum("p").alias("file_size"), F.min("l_partkey").alias("lo"), (F.min("l_partkey") + 40).alias("hi"))
    return files.withColumn("level", (F.col("file_id") % 4).cast("int"))


@query
def fifo_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _catalog(spark, sf_dir)
    half = files.agg(F.sum("file_size")).first()[0] // 2
    return compaction.retained(files, half).select("file_id", "file_size")


_register("level_sizes", lambda s, d: compaction.level_sizes(_catalog(s, d)))
_register("compaction_scores", lambda s, d: compaction.level_scores(_catalog(s, d), Options()))
_register("pick_level", lambda s, d: compaction.level_scores(_catalog(s, d), Options()).orderBy(F.desc("score")).limit(1).select("level"))


@query
def overlapping_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of level 1 that a merge of all files of level 0 takes, the range widened by each."""
    files = _catalog(spark, sf_dir)
    lo, hi = files.where("level = 0").agg(F.min("lo"), F.max("hi")).first()
    below = files.where("level = 1").select("file_id", "lo", "hi")
    return (below.limit(0) if lo is None else compaction.overlapping_rows(below, lo, hi)).select("file_id")


@query
def universal_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the catalog's L0 files a size-tiered merge takes: a fold over the files from the oldest
    on, as the store does over its own list, that ends with the first one that is too large."""
    rows = (r.asDict() for r in _catalog(spark, sf_dir).where("level = 0").orderBy("file_id").toLocalIterator())
    picked = compaction.universal_pick(rows, Options(universal_size_ratio=150))
    return spark.createDataFrame([(f["file_id"],) for f in picked], "file_id long")


@query
def vacuum_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _catalog(spark, sf_dir)
    return files.join(files.where("level > 0").select("file_id"), "file_id", "left_anti").select("file_id")


@query
def op_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("vt").isin(VALUE, MERGE_OPERAND), "puts").otherwise("deletes")
    return changelog(spark, sf_dir).groupBy(kind.alias("name")).agg(F.count("*").alias("value"))


@query
def write_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = op_bytes(F.col("vt"), F.col("key"), F.col("val"), F.col("end_key"))
    return changelog(spark, sf_dir).groupBy("cf_id").agg((F.sum(size) + BATCH_OVERHEAD + LOG_RECORD_OVERHEAD).alias("bytes"))


_register("raw_log_scan", lambda s, d: shown(changelog(s, d).orderBy("cf_id", "key", F.desc("seq"), "vt")))
_register("versions_of_key", lambda s, d: shown(changelog(s, d).where((F.col("cf_id") == 0) & (F.col("key") == F.lit(b"000042")) & (F.col("vt") != RANGE_TOMBSTONE)).select("seq", "vt", "val")))


@query
def latest_record_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = changelog(spark, sf_dir).where((F.col("vt") != RANGE_TOMBSTONE) & (F.col("seq") <= 6000))
    newest = points.groupBy("cf_id", "key").agg(F.max(F.struct("seq", "vt", "val")).alias("b"))
    return shown(newest.select("cf_id", "key", F.col("b.vt").alias("vt"), F.col("b.val").alias("val")))


def _orders(spark: SparkSession, sf_dir: str, as_of: int | None = None) -> DataFrame:
    return resolve(order_log(spark, sf_dir), as_of, has_tombstones=False, has_operands=False)


_register("order_state", lambda s, d: shown(_orders(s, d).select("key", "val")))
_register("order_state_as_of", lambda s, d: shown(_orders(s, d, 600_000).select("key", "val")))


@query
def order_state_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain SQL over a resolved view."""
    return spark.sql("SELECT CAST(val AS STRING) AS val, count(*) AS n FROM {state} GROUP BY 1", state=_orders(spark, sf_dir))


@query
def wide_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as values; every third key is deleted again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.lpad(F.col("doc_id").cast("string"), 12, "0").cast("binary")
    put = docs.select(F.lit(0).alias("cf_id"), key.alias("key"), F.col("doc_id").alias("seq"), F.lit(VALUE).cast("byte").alias("vt"), F.col("text").cast("binary").alias("val"), F.lit(None).cast("binary").alias("end_key"))
    gone = docs.where("doc_id % 3 = 0").select(F.lit(0).alias("cf_id"), key.alias("key"), (F.col("doc_id") + 10**9).alias("seq"), F.lit(TOMBSTONE).cast("byte").alias("vt"), F.lit(b"").alias("val"), F.lit(None).cast("binary").alias("end_key"))
    return shown(resolve(put.unionByName(gone), has_tombstones=False, has_operands=False).select("key", "val"))


_register("prefix_successor", lambda s, d: shown(changelog(s, d).select("key").distinct().select("key", prefix_successor(F.col("key")).alias("next_key"))))


# --- whole round trips through a store ----------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A fresh folder where the cluster shares files: its checkpoint folder, else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    base = base if "://" in base else base.removeprefix("file:")
    return f"{base.rstrip('/')}/lamina-store-{uuid.uuid4().hex}"


def _ops(log: DataFrame) -> DataFrame:
    op = F.element_at(F.create_map(*[F.lit(x) for x in (0, "delete", 1, "put", 2, "delete_range", 3, "merge")]), F.col("vt").cast("int"))
    return log.select(F.col("seq").alias("ord"), "cf_id", op.alias("op"), "key", F.col("val").alias("value"), "end_key")


def _filled(spark: SparkSession, sf_dir: str, parts: int = 1, pinned: int | None = None, **options) -> KVStore:
    """A store that has the change log written into it, in as many batches as parts.

    A snapshot to be read later is pinned first, as a large write makes a compaction due at once.
    """
    store = KVStore(spark, _folder(spark), Options(**options))
    store.create_column_family("cf1")
    if pinned is not None:
        store.pin(pinned)
    log = changelog(spark, sf_dir)
    last = log.agg(F.max("seq")).first()[0]
    for i in range(parts):
        lo, hi = last * i // parts, last * (i + 1) // parts
        store.write_ops(_ops(log.where((F.col("seq") > lo) & (F.col("seq") <= hi))))
    return store


def _both(store: KVStore) -> DataFrame:
    """What the default family and cf1 hold."""
    parts = [store.scan(cf=cf).select(F.lit(cf.cf_id).alias("cf_id"), "key", "val") for cf in store.list_column_families()]
    return shown(parts[0].unionByName(parts[1]))


_register("write_ops_roundtrip", lambda s, d: _both(_filled(s, d)))


def _through_buffer(store: KVStore, log: DataFrame) -> None:
    """Operations in order through the buffer, BATCH_OPS in a batch, then a last flush."""
    cf1 = store.create_column_family("cf1")
    batch = WriteBatch()
    rows = log.orderBy("seq").select("cf_id", "key", "vt", "val", "end_key")
    for cf_id, k, vt, val, end_key in rows.toLocalIterator(prefetchPartitions=True):
        cf, key = (cf1 if cf_id else 0), bytes(k)
        if vt == VALUE:
            batch.put(key, bytes(val), cf)
        elif vt == TOMBSTONE:
            batch.delete(key, cf)
        elif vt == MERGE_OPERAND:
            batch.merge(key, bytes(val), cf)
        else:
            batch.delete_range(KeyRange.half_open(key, bytes(end_key)), cf)
        if len(batch.ops) == BATCH_OPS:
            store.write_batch(batch)
            batch = WriteBatch()
    store.write_batch(batch)
    store.flush()


@query
def flush_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole change log, batch by batch, through the buffer, which is flushed whenever it is full."""
    store = KVStore(spark, _folder(spark), Options(memtable_max_bytes=1 << 15))
    _through_buffer(store, changelog(spark, sf_dir))
    return _both(store)


@query
def reopen_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir, 2)
    store.close()
    return _both(KVStore(spark, store.path))


@query
def list_column_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = KVStore(spark, _folder(spark))
    store.create_column_family("cf1")
    store.create_column_family("cf1")
    found = KVStore(spark, store.path).list_column_families()
    return spark.createDataFrame([(c.cf_id, c.name) for c in found], "cf_id int, name string")


@query
def ingest_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments written by a plain DataFrame, taken into a fresh store with their own numbers."""
    outside = _folder(spark)
    changelog(spark, sf_dir).repartition(2, "key").write.parquet(outside)
    files = [f for f in spark.read.parquet(outside).inputFiles()]
    store = KVStore(spark, _folder(spark))
    store.create_column_family("cf1")
    store.ingest(files)
    return _both(store)


@query
def checkpoint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    copy = _folder(spark)
    store.create_checkpoint(copy)
    store.delete_range(KeyRange.half_open(b"0", b"9"))  # the copy must not see this
    return _both(KVStore(spark, copy))


@query
def repair_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir, 2)
    store.close()
    for name in store._files.list("_log"):
        store._files.delete(f"_log/{name}")
    repair(spark, store.path)
    return _both(KVStore(spark, store.path))


@query
def leveled_compaction_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir, 3, l0_slowdown_trigger=1, level1_target_bytes=4096, level_multiplier=2)
    store.vacuum()
    return _both(store)


@query
def universal_compaction_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(_filled(spark, sf_dir, 4, compaction_style=CompactionStyle.UNIVERSAL, universal_size_ratio=1000))


def _levels_hold(store: KVStore) -> bool:
    """In no level above 0 do two files have a key in common; a range tombstone counts where it starts."""
    levels: dict[int, list[str]] = {}
    for m in store._state.files.values():
        levels.setdefault(m["level"], []).append(store._files.spark_path(m["path"]))
    for level, paths in levels.items():
        rows = store.spark.read.parquet(*paths).select("cf_id", "key", F.col("_metadata.file_path").alias("file"))
        if level and not rows.distinct().groupBy("cf_id", "key").count().where("count > 1").isEmpty():
            return False
    return True


@query
def store_versions_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of a key as a store's segments hold them."""
    store = _filled(spark, sf_dir, 2, drop_obsolete_versions_during_compaction=False)
    log = store.raw_log(key_range=_KEY, cf_id=0)
    return shown(log.where((F.col("cf_id") == 0) & (F.col("key") == F.lit(b"000042")) & (F.col("vt") != RANGE_TOMBSTONE)).select("seq", "vt", "val"))


@query
def store_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of a store's segments and buffer, nothing compacted away."""
    store = _filled(spark, sf_dir, 3, drop_obsolete_versions_during_compaction=False)
    return shown(store.raw_log())


@query
def store_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a store into which the change log was written in two batches."""
    store = _filled(spark, sf_dir, 2)
    return store.metrics().where("name IN ('puts', 'deletes', 'write_batches')")


@query
def store_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leveled compaction of a real store leaves: no level above its target, levels without overlaps,
    nothing due, and no file on disk that is not live after a vacuum."""
    store = _filled(spark, sf_dir, 3, l0_slowdown_trigger=1, level1_target_bytes=1 << 16, level_multiplier=4)
    store.vacuum()
    levels = compaction.level_scores(store.files(), store.options)
    due = levels.where("score > 1").count()
    on_disk = {f"data/{n}" for n in store._files.list("data") if n.endswith(".parquet")}
    facts = [("levels_apart", _levels_hold(store)), ("nothing_due", compaction.pick(list(store._state.files.values()), store.options) is None and not due), ("only_live_files", on_disk == set(store._state.files))]
    return spark.createDataFrame(facts, "name string, holds boolean")


@query
def store_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([(cf, k) for cf in (0, 1) for k in (b"000003", b"000007", b"000011", b"000042", b"999999")], "cf_id int, key binary")
    return shown(_filled(spark, sf_dir, 2).multi_get(keys))


@query
def store_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one transaction a family and key, in a store: those whose commit meets the writes made since."""
    store = _filled(spark, sf_dir)
    rows = []
    for i, (cf, key) in enumerate((cf, k) for cf in (0, 1) for k in (b"000003", b"000042")):
        txn = store.begin_transaction()
        txn.get(key, cf)
        txn.put(b"mine", str(i).encode(), 0)
        if key == b"000042":
            store.put(key, b"later", cf)
        try:
            txn.commit()
            rows.append((cf, key.decode(), "committed"))
        except InvalidArgument:
            rows.append((cf, key.decode(), "conflict"))
    return spark.createDataFrame(rows, "cf_id int, key string, outcome string")


@query
def store_operands_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after a compaction of everything, which folds the operands of untouched keys."""
    store = _filled(spark, sf_dir, 2)
    store.compact_all()
    return _both(store)


@query
def store_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store says of itself after two batches: counters, options, events, families."""
    store = _filled(spark, sf_dir, 2)
    store.put(b"x", b"1")
    store.flush()
    stats = store.property("lamina.stats").where("name IN ('puts', 'deletes', 'flushes')")
    options = store.property("lamina.options").where("name IN ('max_levels', 'l0_slowdown_trigger')")
    events = store.events().where("kind = 'flush'").select("kind", F.col("detail").alias("value"))
    families = spark.createDataFrame([("families", ",".join(c.name for c in store.list_column_families()))], "name string, value string")
    return stats.unionByName(options).unionByName(events.withColumnRenamed("kind", "name")).unionByName(families)


@query
def store_family_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every put of the change log, whatever its family, in batches that are moved to cf1."""
    store = KVStore(spark, _folder(spark))
    cf1 = store.create_column_family("cf1")
    batch = WriteBatch()
    puts = changelog(spark, sf_dir).where(F.col("vt") == VALUE).orderBy("seq").select("key", "val")
    for key, val in puts.toLocalIterator(prefetchPartitions=True):
        batch.put(bytes(key), bytes(val))
        if len(batch.ops) == BATCH_OPS:
            store.write_batch(batch.in_family(cf1))
            batch = WriteBatch()
    store.write_batch(batch.in_family(cf1))
    return _both(store)


@query
def store_get_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's own get with a snapshot, pinned across a compaction of everything."""
    store = _filled(spark, sf_dir, 2, pinned=5000)
    store.compact_all()
    rows = [(cf, k.decode(), store.get(k, cf, as_of=5000)) for cf in (0, 1) for k in (b"000003", b"000042", b"000077")]
    return shown(spark.createDataFrame(rows, "cf_id int, key string, val binary"))


@query
def stream_into_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log as a stream of files into a store, in micro-batches."""
    store = KVStore(spark, _folder(spark))
    store.create_column_family("cf1")
    source, log = _folder(spark), _ops(changelog(spark, sf_dir))
    last = log.agg(F.max("ord")).first()[0]
    for i in range(2):
        log.where((F.col("ord") > last * i // 2) & (F.col("ord") <= last * (i + 1) // 2)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    write_stream(stream, store, "events", _folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return _both(store)


