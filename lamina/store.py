"""KVStore: a multi-version key-value store on a folder, with every read a DataFrame.

Writes are commits of the transaction log. A small batch lies inside its commit; flush() turns what
has gathered into sorted segments, write_ops() writes a DataFrame of operations as segments at once.
Reads resolve the live segments and the batches not flushed; a DataFrame keeps the files it was made
with, whatever later compactions do, until vacuum().
"""

from __future__ import annotations

import json
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidArgument, StoreError
from .operators import compaction
from .operators.resolve import latest_seq, multi_get, resolve
from .records import MERGE_OPERAND, RANGE_TOMBSTONE, RECORD, RECORD_COLUMNS, TOMBSTONE, VALUE, KeyRange, Options
from .sources.files import files_at
from .sources.segments import as_arrow, describe, physical_key, read_segments, read_small, write_segments, write_small
from .sources.txlog import Op, State, TxLog, pack_ops

BATCH_OVERHEAD, RECORD_OVERHEAD = 4, 12
#: A buffer up to this size is written by the driver, for which a job would take longer.
SMALL_FLUSH_BYTES = 1 << 20
#: Segments up to this size together are merged by the driver.
SMALL_MERGE_BYTES = 8 << 20


@dataclass(frozen=True)
class ColumnFamily:
    cf_id: int
    name: str


DEFAULT = ColumnFamily(0, "default")


@dataclass
class WriteBatch:
    """Operations that are applied together and in order; cf is a column family or its number."""

    ops: list[Op] = field(default_factory=list)
    compat: bool = False

    def put(self, key: bytes, value: bytes, cf: ColumnFamily | int = DEFAULT) -> WriteBatch:
        self.ops.append((_number(cf), VALUE, key, value, None))
        return self

    def delete(self, key: bytes, cf: ColumnFamily | int = DEFAULT) -> WriteBatch:
        self.ops.append((_number(cf), TOMBSTONE, key, b"", None))
        return self

    def delete_range(self, keys: KeyRange, cf: ColumnFamily | int = DEFAULT) -> WriteBatch:
        bounds = keys.normalised(self.compat)
        if bounds:
            self.ops.append((_number(cf), RANGE_TOMBSTONE, bounds[0], b"", bounds[1]))
        return self

    def merge(self, key: bytes, operand: bytes, cf: ColumnFamily | int = DEFAULT) -> WriteBatch:
        self.ops.append((_number(cf), MERGE_OPERAND, key, operand, None))
        return self

    def in_family(self, cf: ColumnFamily | int) -> WriteBatch:
        """The same operations, all in one family."""
        return WriteBatch([(_number(cf), *op[1:]) for op in self.ops], self.compat)

    def encoded_size(self) -> int:
        return BATCH_OVERHEAD + sum((9 if vt == TOMBSTONE else 13) + len(k) + (len(e) if vt == RANGE_TOMBSTONE else 0 if vt == TOMBSTONE else len(v)) for _, vt, k, v, e in self.ops)


def _number(cf: ColumnFamily | int) -> int:
    return cf.cf_id if isinstance(cf, ColumnFamily) else cf


class RateLimiter:
    """A bucket of one second's bytes; 0 bytes a second means no limit."""

    def __init__(self, per_second: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.per_second, self._clock, self._sleep = per_second, clock, sleep
        self._tokens, self._at = float(per_second), clock()

    def take(self, n: int) -> float:
        """Wait until n bytes may be written; returns the seconds waited."""
        if not self.per_second:
            return 0.0
        now = self._clock()
        self._tokens = min(float(self.per_second), self._tokens + (now - self._at) * self.per_second) - n
        self._at = now
        wait = max(0.0, -self._tokens / self.per_second)
        if wait:
            self._sleep(wait)
        return wait


class Transaction:
    """Optimistic: reads at its snapshot (not its own writes), conflicts found at commit."""

    def __init__(self, store: KVStore):
        self._store, self._batch = store, WriteBatch(compat=store.options.compat)
        self.snapshot = store.snapshot()
        self._reads: set[tuple[int, bytes]] = set()
        self._ranges: list[tuple[int, bytes, bytes]] = []
        self.sync: bool | None = None

    def set_write_options(self, sync: bool | None = None) -> None:
        """How the commit is written; None is the store's own setting."""
        self.sync = sync

    def scan(self, keys: KeyRange, cf: ColumnFamily | int = DEFAULT) -> DataFrame:
        """key, val of a range with both bounds at the snapshot; what then changes in it is a conflict."""
        held = keys.normalised()
        if held is not None:
            self._ranges.append((_number(cf), *held))
        return self._store.scan(keys, cf, as_of=self.snapshot)

    def get(self, key: bytes, cf: ColumnFamily | int = DEFAULT) -> bytes | None:
        self._reads.add((_number(cf), key))
        return self._store.get(key, cf, as_of=self.snapshot)

    def put(self, key: bytes, value: bytes, cf: ColumnFamily | int = DEFAULT) -> None:
        self._batch.put(key, value, cf)

    def delete(self, key: bytes, cf: ColumnFamily | int = DEFAULT) -> None:
        self._batch.delete(key, cf)

    def merge(self, key: bytes, operand: bytes, cf: ColumnFamily | int = DEFAULT) -> None:
        self._batch.merge(key, operand, cf)

    def delete_range(self, keys: KeyRange, cf: ColumnFamily | int = DEFAULT) -> None:
        self._batch.delete_range(keys, cf)

    def commit(self) -> None:
        keys = self._reads | {(op[0], op[2]) for op in self._batch.ops}
        ranges = self._ranges + [(op[0], op[2], op[4]) for op in self._batch.ops if op[1] == RANGE_TOMBSTONE]
        self._store._write(self._batch, self.sync, lambda state: self._store._check(state, self.snapshot, keys, ranges))


class KVStore:
    """One handle on a store; several handles, also in other processes, may write the same folder."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None, fault: Callable[[str], None] = lambda step: None, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.options = spark, path, options or Options()
        self.fault, self._clock = fault, clock
        self._files = files_at(spark, path)
        self._files.make("data")
        self._log = TxLog(self._files, self.options.log_checkpoint_every, fault)
        self._state = self._log.state()
        self._waiting: list[Op] = []
        self._events: deque[tuple[int, str, str]] = deque(maxlen=self.options.event_log_capacity or 0)
        self._listener: Callable[[tuple[int, str, str]], None] | None = None
        self._limiter = RateLimiter(self.options.max_write_bytes_per_sec)
        self._stalls = 0
        self._closed = False
        self._cached: tuple[frozenset[str], DataFrame] | None = None
        if self.options.auto_vacuum:
            self.vacuum()

    # --- writes --------------------------------------------------------------------------------

    def put(self, key: bytes, value: bytes, cf: ColumnFamily | int = DEFAULT) -> None:
        self.write_batch(WriteBatch().put(key, value, cf))

    def delete(self, key: bytes, cf: ColumnFamily | int = DEFAULT) -> None:
        self.write_batch(WriteBatch().delete(key, cf))

    def delete_range(self, keys: KeyRange, cf: ColumnFamily | int = DEFAULT) -> None:
        self.write_batch(WriteBatch(compat=self.options.compat).delete_range(keys, cf))

    def merge(self, key: bytes, operand: bytes, cf: ColumnFamily | int = DEFAULT) -> None:
        self.write_batch(WriteBatch().merge(key, operand, cf))

    def write_batch(self, batch: WriteBatch, sync: bool | None = None) -> None:
        """All operations or none; sync decides whether the commit is written before this returns."""
        self._write(batch, sync, None)

    def _write(self, batch: WriteBatch, sync: bool | None, check: Callable[[State], None] | None) -> None:
        self._open()
        for cf in {op[0] for op in batch.ops}:
            if cf not in self._state.families:
                self.refresh()
            if cf not in self._state.families and not self.options.compat:
                raise InvalidArgument(f"no column family {cf}")
        self._limiter.take(RECORD_OVERHEAD + batch.encoded_size())
        reason = compaction.stall_reason(list(self._state.files.values()), self.options)
        if reason:
            self._stalls += 1
            self._event("stall", reason)
            if self.options.auto_compact:
                self.compact()
            else:
                self._wait_for_compaction()
        if not batch.ops:
            if check:
                self.refresh()
                check(self._state)
            return
        if check is None and not (self.options.sync if sync is None else sync):
            self._waiting += batch.ops
            if sum(len(op[2]) + len(op[3] or b"") for op in self._waiting) >= 1 << 20:
                self.sync()
        else:
            self._commit_ops(batch.ops, check)
        if self._state.inline_bytes >= self.options.memtable_max_bytes:
            self.flush()
            if self.options.auto_compact:
                self.compact()

    def _wait_for_compaction(self) -> None:
        """Wait for another handle to compact, at most stall_wait_seconds."""
        end = time.monotonic() + self.options.stall_wait_seconds
        while time.monotonic() < end:
            time.sleep(min(0.05, self.options.stall_wait_seconds))
            self.refresh()
            if not self.stall_reason():
                return

    def _commit_ops(self, ops: list[Op], check: Callable[[State], None] | None = None) -> None:
        """Waiting operations go first, in a commit of their own."""
        if self._waiting:
            waiting, self._waiting = self._waiting, []
            try:
                self._commit_ops(waiting)
            except Exception:
                self._waiting = waiting + self._waiting
                raise
        puts = sum(op[1] in (VALUE, MERGE_OPERAND) for op in ops)
        counters = {"puts": puts, "deletes": len(ops) - puts, "write_batches": 1, "stall_waits": self._stalls}

        def entry(state: State) -> dict:
            if check:
                check(state)
            start = state.last_seq + 1
            return {"ops": pack_ops(ops), "start_seq": start, "last_seq": start + len(ops) - 1, "counters": counters}

        self._commit(entry)
        self._stalls = 0

    def _commit(self, entry: Callable[[State], dict]) -> None:
        """Try until this writer is first: the entry is made anew on each newer state."""
        while True:
            after = self._log.commit(self._state, entry(self._state))
            if after is not None:
                self._state = after
                return
            self.refresh()

    def sync(self) -> None:
        """Commit what unsynced writes have left waiting."""
        if self._waiting:
            waiting, self._waiting = self._waiting, []
            self._commit_ops(waiting)

    def write_ops(self, ops: DataFrame, applied: tuple[str, int] | None = None) -> None:
        """Write a DataFrame of operations (ord, cf_id, op, key, value, end_key) as one batch.

        op is put, delete, delete_range or merge. Sequence numbers follow ord, whatever the partitions.
        With applied (a stream's id and batch number), a batch that is already in the log is skipped.
        """
        self._open()
        self.sync()
        self.refresh()
        if applied and self._state.applied.get(applied[0], -1) >= applied[1]:
            return
        vt = F.when(F.col("op") == "put", VALUE).when(F.col("op") == "delete", TOMBSTONE).when(F.col("op") == "delete_range", RANGE_TOMBSTONE).when(F.col("op") == "merge", MERGE_OPERAND)
        rows = ops.select("ord", F.col("cf_id").cast("int").alias("cf_id"), "key", vt.cast("byte").alias("vt"), F.coalesce("value", F.lit(b"")).alias("val"), "end_key")
        rows = rows.where(F.col("vt").isNull() | (F.col("vt") != RANGE_TOMBSTONE) | (F.col("key") < F.col("end_key")))
        with self._staging() as stage:
            staged = stage(rows.repartitionByRange("ord").sortWithinPartitions("ord").withColumn("_at", F.monotonically_increasing_id()))
            part = F.shiftright("_at", 33).alias("part")
            facts = staged.groupBy(part).agg(F.count("*").alias("n"), F.count_if(F.col("vt").isin(VALUE, MERGE_OPERAND)).alias("puts"), F.collect_set("cf_id").alias("cfs"), F.count_if(F.col("vt").isNull()).alias("bad")).collect()
            if any(r["bad"] for r in facts):
                raise InvalidArgument("op must be put, delete, delete_range or merge")
            unknown = {c for r in facts for c in r["cfs"]} - set(self._state.families)
            if unknown and not self.options.compat:
                raise InvalidArgument(f"no column family {sorted(unknown)}")
            counts = {r["part"]: r["n"] for r in facts}
            total, puts = sum(counts.values()), sum(r["puts"] for r in facts)
            if not total:
                if applied:
                    self._commit(lambda state: {"applied": {applied[0]: applied[1]}})
                return
            before, offsets = 0, {}
            for p in sorted(counts):
                offsets[p] = before - (p << 33)
                before += counts[p]
            while True:
                start = self._state.last_seq + 1
                numbered = self._shifted(staged, offsets).withColumn("seq", F.lit(start) + F.col("_at"))
                with self._in_flight() as folder:
                    metas = write_segments(numbered, self._files, max(1, staged.rdd.getNumPartitions()), self.options, self._state.families, folder)
                    self.fault("ops:after_data")
                    entry = {
                        "add": self._numbered(metas, 0),
                        "last_seq": start + total - 1,
                        "counters": {"puts": puts, "deletes": total - puts, "write_batches": 1},
                    }
                    if applied:
                        entry["applied"] = {applied[0]: applied[1]}
                    after = self._log.commit(self._state, entry)
                if after is not None:
                    self._state = after
                    break
                self.refresh()  # another writer took these numbers: the segment is left to vacuum()
                if applied and self._state.applied.get(applied[0], -1) >= applied[1]:
                    return
        if self.options.auto_compact:
            self.compact()

    @contextmanager
    def _staging(self) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """A folder of this write alone for tables between its steps, deleted at its end."""
        folder = f"_staging/{uuid.uuid4().hex}"

        def stage(df: DataFrame) -> DataFrame:
            path = self._files.spark_path(f"{folder}/{uuid.uuid4().hex}")
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        try:
            yield stage
        finally:
            self._files.delete(folder)

    @contextmanager
    def _in_flight(self) -> Iterator[str]:
        """A folder for data files that no commit names yet; vacuum() leaves it alone until this ends.

        The mark is there before the first file, and goes only after the commit. A writer that dies
        leaves its mark behind; vacuum() heeds it for a while.
        """
        name = uuid.uuid4().hex
        self._files.make("_inflight")
        self._files.write_new(f"_inflight/{name}.json", json.dumps({"folder": f"data/{name}", "at": self._clock()}).encode())
        try:
            yield f"data/{name}"
        finally:  # the files stay even after an error: a commit that raised may yet be in the log
            self._files.delete(f"_inflight/{name}.json")

    def _shifted(self, placed: DataFrame, offsets: dict[int, int]) -> DataFrame:
        """placed with _at moved by its partition's offset; one row a partition is broadcast."""
        by_part = self.spark.createDataFrame(sorted(offsets.items()), "_part long, _offset long")
        moved = placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(by_part), "_part")
        return moved.withColumn("_at", F.col("_at") + F.col("_offset")).drop("_part", "_offset")

    # --- reads ---------------------------------------------------------------------------------

    def refresh(self) -> None:
        """See what other writers have committed."""
        self._state = self._log.state(self._state)

    def snapshot(self) -> int:
        """The sequence number of now. It is not kept from compaction unless it is pinned."""
        self.sync()
        return self._state.last_seq

    def pin(self, seq: int) -> None:
        """Keep every version that a read as of seq needs."""

        def entry(state: State) -> dict:
            self._readable(seq, state)  # a compaction may have come in between
            return {"pinned": sorted({*state.pinned, seq})}

        self._commit(entry)

    def unpin(self, seq: int) -> None:
        self._commit(lambda state: {"pinned": [p for p in state.pinned if p != seq]})

    def _readable(self, as_of: int | None, state: State | None = None) -> None:
        state = state or self._state
        if as_of is not None and as_of < state.compacted_through and as_of not in state.pinned:
            raise InvalidArgument(f"versions as of {as_of} may be compacted away; pin a snapshot to keep it")

    def _buffered(self, state: State) -> list[tuple]:
        rows = [(op[0], op[2], start + i, op[1], op[3], op[4]) for start, ops in state.inline for i, op in enumerate(ops)]
        return rows + [(op[0], op[2], state.last_seq + 1 + i, op[1], op[3], op[4]) for i, op in enumerate(self._waiting)]

    def _live(self, as_of: int | None, key_range: KeyRange | None, cf_id: int | None) -> list[dict]:
        """Files that can hold a record for the read, by the statistics in the log."""
        lo, hi = b"", None
        if cf_id is not None:
            lo, hi = physical_key(cf_id, b""), physical_key(cf_id + 1, b"")
            if key_range is not None:
                lo = physical_key(cf_id, key_range.start.key or b"")
                hi = hi if key_range.end.key is None else physical_key(cf_id, key_range.end.key + b"\0")
        return [m for m in self._state.files.values() if (as_of is None or m["min_seq"] <= as_of) and m["max_key"] >= lo and (hi is None or m["min_key"] <= hi)]

    def raw_log(self, as_of: int | None = None, key_range: KeyRange | None = None, cf_id: int | None = None) -> DataFrame:
        """The records themselves, from segments and from batches not flushed."""
        return self._log_of(self._live(as_of, key_range, cf_id), self._buffered(self._state))

    def _log_of(self, files: list[dict], rows: list[tuple]) -> DataFrame:
        self._open()
        out = self._segments(files)
        return out.unionByName(self.spark.createDataFrame(as_arrow(rows), RECORD)) if rows else out

    def _segments(self, files: list[dict]) -> DataFrame:
        """The records of some live files, or of all of them from memory: reads filter what they need."""
        live = self._state.files
        if not files or sum(m["file_size"] for m in live.values()) > self.options.block_cache_capacity_bytes:
            return read_segments(self.spark, [self._files.spark_path(m["path"]) for m in files])
        if self._cached is None or self._cached[0] != frozenset(live):
            self._uncache()
            self._cached = frozenset(live), read_segments(self.spark, [self._files.spark_path(p) for p in live]).persist()
        return self._cached[1]

    def _uncache(self) -> None:
        if self._cached is not None:
            self._cached[1].unpersist()  # DataFrames made from it read the files again
            self._cached = None

    @staticmethod
    def _holds(files: list[dict], rows: list[tuple]) -> dict[str, bool]:
        """What resolve() has to look for, by the files' statistics and the batches' records."""
        return {
            "has_tombstones": any(m["n_range_tombstones"] for m in files) or any(r[3] == RANGE_TOMBSTONE for r in rows),
            "has_operands": any(m["n_operands"] for m in files) or any(r[3] == MERGE_OPERAND for r in rows),
        }

    def scan(self, key_range: KeyRange | None = None, cf: ColumnFamily | int = DEFAULT, as_of: int | None = None, ttl_now: int | None = None) -> DataFrame:
        """key, val of the visible keys in a range; order by key where order matters (see iterate)."""
        self._readable(as_of)
        n = _number(cf)
        files, rows = self._live(as_of, key_range, n), self._buffered(self._state)
        log = self._log_of(files, rows)
        if ttl_now is not None:
            log = compaction.expire(log, ttl_now)
        return resolve(log, as_of, key_range, n, self.options.merge_operator, **self._holds(files, rows)).select("key", "val")

    def iterate(self, key_range: KeyRange | None = None, cf: ColumnFamily | int = DEFAULT, as_of: int | None = None) -> Iterable[tuple[bytes, bytes]]:
        """(key, value) in key order; partitions come to the driver one at a time."""
        for r in self.scan(key_range, cf, as_of).orderBy("key").toLocalIterator():
            yield bytes(r["key"]), bytes(r["val"])

    def get(self, key: bytes, cf: ColumnFamily | int = DEFAULT, as_of: int | None = None) -> bytes | None:
        found = self.scan(KeyRange.closed(key, key), cf, as_of).collect()
        return bytes(found[0]["val"]) if found else None

    def multi_get(self, keys: DataFrame, as_of: int | None = None) -> DataFrame:
        """keys (cf_id, key) with their values; null where absent."""
        self._readable(as_of)
        wanted = keys.select("cf_id", "key").distinct()
        ends = wanted.agg(F.min(F.struct("cf_id", "key")).alias("lo"), F.max(F.struct("cf_id", "key")).alias("hi")).first()
        lo, hi = (physical_key(e["cf_id"], bytes(e["key"])) if e else b"" for e in ends)
        files, rows = [m for m in self._live(as_of, None, None) if m["max_key"] >= lo and m["min_key"] <= hi], self._buffered(self._state)
        log = self._log_of(files, rows)
        points = log.where(F.col("vt") != RANGE_TOMBSTONE).join(wanted, ["cf_id", "key"], "left_semi")
        found = resolve(points.unionByName(log.where(F.col("vt") == RANGE_TOMBSTONE)), as_of, merge=self.options.merge_operator, **self._holds(files, rows))
        return multi_get(found, keys)

    def latest_seq(self) -> DataFrame:
        return latest_seq(self.raw_log())

    def table(self, cf: ColumnFamily | int = DEFAULT, name: str | None = None, as_of: int | None = None) -> DataFrame:
        """A family as a DataFrame, and as a temporary view if a name is given, for SQL over it."""
        out = self.scan(cf=cf, as_of=as_of)
        if name:
            out.createOrReplaceTempView(name)
        return out

    # --- column families, transactions ---------------------------------------------------------

    def create_column_family(self, name: str) -> ColumnFamily:
        self.refresh()

        def entry(state: State) -> dict:
            return {"families": [] if name in state.families.values() else [(max(state.families) + 1, name)]}

        if self.column_family(name) is None:
            self._commit(entry)
        return self.column_family(name)

    def column_family(self, name: str) -> ColumnFamily | None:
        return next((ColumnFamily(i, n) for i, n in sorted(self._state.families.items()) if n == name), None)

    def list_column_families(self) -> list[ColumnFamily]:
        return [ColumnFamily(i, n) for i, n in sorted(self._state.families.items())]

    def begin_transaction(self) -> Transaction:
        self.refresh()
        return Transaction(self)

    def _check(self, state: State, snapshot: int, keys: set[tuple[int, bytes]], ranges: list[tuple[int, bytes, bytes]]) -> None:
        """Raise if anything in the read or write set has changed after the snapshot."""
        if state.last_seq <= snapshot:
            return
        newer = [r for r in self._buffered_only(state) if r[2] > snapshot]
        clash = any(self._clashes(r, keys, ranges) for r in newer)
        files = [m for m in state.files.values() if m["max_seq"] > snapshot]
        if not clash and files:
            log = read_segments(self.spark, [self._files.spark_path(m["path"]) for m in files]).where(F.col("seq") > snapshot)
            clash = self._clash_in_files(log, keys, ranges)
        if clash:
            raise InvalidArgument("transaction conflict")

    def _buffered_only(self, state: State) -> list[tuple]:
        return [(op[0], op[2], start + i, op[1], op[3], op[4]) for start, ops in state.inline for i, op in enumerate(ops)]

    def _clashes(self, record: tuple, keys: set[tuple[int, bytes]], ranges: list[tuple[int, bytes, bytes]]) -> bool:
        cf, key, _, vt, _, end = record
        if (cf, key) in keys:
            return True
        if self.options.compat:
            return False
        if vt == RANGE_TOMBSTONE and any(c == cf and key <= k < end for c, k in keys):
            return True
        stop = end if vt == RANGE_TOMBSTONE else key + b"\0"
        return any(c == cf and s < stop and key < e for c, s, e in ranges)

    def _clash_in_files(self, log: DataFrame, keys: set[tuple[int, bytes]], ranges: list[tuple[int, bytes, bytes]]) -> bool:
        from .operators.resolve import conflicts, range_conflicts

        if keys:
            reads = self.spark.createDataFrame(sorted(keys), "cf_id int, key binary")
            if not conflicts(reads, log, -1, ranges=not self.options.compat).isEmpty():
                return True
        if ranges and not self.options.compat:
            held = self.spark.createDataFrame(ranges, "cf_id int, start binary, end binary")
            return not range_conflicts(held, log, -1).isEmpty()
        return False

    # --- flush and compaction ------------------------------------------------------------------

    def _numbered(self, metas: Sequence[dict], level: int, first: int | None = None) -> list[dict]:
        start = self._state.next_file_id if first is None else first
        return [m | {"level": level, "file_id": start + i} for i, m in enumerate(metas)]

    def flush(self) -> None:
        """Turn committed batches into L0 segments."""
        self._open()
        self.sync()
        while self._state.inline:
            rows = self._buffered_only(self._state)
            through = max(r[2] for r in rows)
            with self._in_flight() as folder:
                if self._state.inline_bytes <= SMALL_FLUSH_BYTES:
                    metas = write_small(as_arrow(rows), self._files, 1, self.options, self._state.families, folder)
                else:
                    metas = write_segments(self.spark.createDataFrame(as_arrow(rows), RECORD), self._files, 1, self.options, self._state.families, folder)
                self.fault("flush:after_data")
                entry = {"add": self._numbered(metas, 0), "flushed_through": through, "counters": {"flushes": 1}}
                after = self._log.commit(self._state, entry)
            if after is not None:
                self._state = after
                self._event("flush", f"{len(rows)} records")
                return
            self.refresh()

    def compact(self, now_micros: int | None = None) -> int:
        """Run due compactions, at most 4 * max_levels (8 at least); returns how many were made."""
        self._open()
        for done in range(max(8, 4 * max(2, self.options.max_levels))):
            files = sorted(self._state.files.values(), key=lambda m: m["file_id"])
            chosen = compaction.pick(files, self.options)
            if chosen is None:
                break
            self._run(*chosen, now_micros)
        else:
            done += 1
        if done and self.options.auto_vacuum:
            self.vacuum()
        return done

    def compact_all(self, level: int = 1, now_micros: int | None = None) -> None:
        """Rewrite every live segment at one level."""
        self.flush()
        files = list(self._state.files.values())
        if files:
            self._run("merge", files, level, now_micros, True)
            if self.options.auto_vacuum:
                self.vacuum()

    def _run(self, kind: str, inputs: list[dict], level: int, now_micros: int | None, fold: bool = False) -> None:
        gone = [m["path"] for m in inputs]
        while not any(p not in self._state.files for p in gone):  # else another writer's compaction stands
            pinned = set(self._state.pinned)
            with self._in_flight() as folder:
                entry = self._rewritten(kind, inputs, level, now_micros, folder, fold)
                while True:
                    after = self._log.commit(self._state, entry)
                    if after is not None:
                        self._state = after
                        self._event({"drop": "fifo_drop", "move": "trivial_move"}.get(kind, "compaction"), f"{len(gone)} files to level {level}")
                        return
                    self.refresh()
                    if any(p not in self._state.files for p in gone) or set(self._state.pinned) - pinned:
                        break  # a snapshot pinned meanwhile may need what the rewrite has dropped
                    if kind == "merge":
                        entry = entry | {"add": self._numbered(entry["add"], level)}

    def _rewritten(self, kind: str, inputs: list[dict], level: int, now_micros: int | None, folder: str, fold: bool = False) -> dict:
        """The commit that replaces the inputs; for a merge, the new segments are written into folder."""
        gone = [m["path"] for m in inputs]
        if kind == "drop":
            return {"remove": gone, "compacted_through": max(m["max_seq"] for m in inputs), "counters": {"compactions": 1}}
        if kind == "move":
            return {"remove": gone, "add": [m | {"level": level} for m in inputs], "counters": {"trivial_moves": len(inputs)}}
        limit = max(1, compaction.level_target(self.options, level) // 2) if level else 2**62
        n = max(1, sum(m["file_size"] for m in inputs) // limit)
        metas = self._merged_small(inputs, n, folder, fold)
        if metas is None:
            metas = self._merged(inputs, n, now_micros, folder)
        self.fault("compaction:after_data")
        return {
            "remove": gone,
            "add": self._numbered(metas, level),
            "counters": {"compactions": 1},
            "compacted_through": max(m["max_seq"] for m in inputs) if self.options.drop_obsolete_versions_during_compaction or self.options.ttl_filter_from_value_prefix_micros else 0,
        }

    def _folds(self, inputs: list[dict]) -> bool:
        """Whether nothing older lies elsewhere: operands become values, or they would grow for ever."""
        return len(inputs) == len(self._state.files) and any(m["n_operands"] for m in inputs)

    def _merged_small(self, inputs: list[dict], n: int, folder: str, fold: bool) -> list[dict] | None:
        """The merge of small inputs on the driver; None where it is not small, or has more to do than to merge.

        Operands are folded only if asked; else they wait, unfolded, for a merge that is not small.
        """
        if sum(m["file_size"] for m in inputs) > SMALL_MERGE_BYTES or self.options.ttl_filter_from_value_prefix_micros:
            return None
        gone = [m["path"] for m in inputs]
        log = read_small(self._files, gone)
        if self.options.drop_obsolete_versions_during_compaction:
            log = compaction.keep_needed_small(log, self._state.pinned)
            if fold and self._folds(inputs) and compaction.folds_small(log, min(self._state.pinned, default=2**62)):
                return None
        return write_small(log, self._files, n, self.options, self._state.families, folder, gone)

    def _merged(self, inputs: list[dict], n: int, now_micros: int | None, folder: str) -> list[dict]:
        gone = [m["path"] for m in inputs]
        log = read_segments(self.spark, [self._files.spark_path(p) for p in gone])
        if self.options.ttl_filter_from_value_prefix_micros:
            log = compaction.expire(log, int(self._clock() * 1e6) if now_micros is None else now_micros)
        if self.options.drop_obsolete_versions_during_compaction:
            log = compaction.keep_needed(log, self._state.pinned)
            if self._folds(inputs):
                tombstones = any(m["n_range_tombstones"] for m in inputs)
                log = compaction.fold_untouched(log, min(self._state.pinned, default=2**62), self.options.merge_operator, tombstones)
        return write_segments(log, self._files, n, self.options, self._state.families, folder, gone)

    def vacuum(self, heed_marks_for: float = 7 * 86400.0) -> list[str]:
        """Delete files that the newest state does not refer to; older DataFrames may lose theirs.

        What a write has in flight stays. The order makes this safe: files are listed first, then the
        marks of writes in flight, then the state; a write that ended in between is in the state. Marks
        older than heed_marks_for seconds are those of writers that died.
        """
        self._open()
        found = [f"data/{n}" for n in self._files.list("data")]
        busy = set()
        for name in self._files.list("_inflight"):
            if not name.endswith(".json"):
                continue
            try:
                mark = json.loads(self._files.read(f"_inflight/{name}"))
            except FileNotFoundError:
                continue  # that write has just ended
            if mark["at"] >= self._clock() - heed_marks_for:
                busy.add(mark["folder"])
            else:
                self._files.delete(f"_inflight/{name}")
        self.refresh()
        live = {m["path"] for m in self._state.files.values()}
        folders = {p.rsplit("/", 1)[0] for p in live}
        gone = [n for n in found if n not in live and "/".join(n.split("/")[:2]) not in busy and not (n.rsplit("/", 1)[0] in folders and not n.endswith(".parquet"))]
        for name in gone:
            self._files.delete(name)
        for name in self._files.list("_log"):
            if name.endswith(".tmp"):
                self._files.delete(f"_log/{name}")
        return gone

    # --- ingest, backup ------------------------------------------------------------------------

    def ingest(self, paths: Sequence[str], move: bool = False, reassign_seq: bool = False) -> list[int]:
        """Add segment files written elsewhere to L0, with their own sequence numbers or new ones."""
        self._open()
        self.sync()
        added: list[dict] = []
        with self._in_flight() as folder, self._staging() as stage:
            names = []
            for i, source in enumerate(paths):
                name = f"{folder}/{i}-{source.rsplit('/', 1)[-1]}"
                self._files.copy_in(source, name, move)
                names.append(name)
            metas = describe(self.spark, self._files, names)
            self.fault("ingest:after_data")
            ranked = self._renumbered(names, stage) if reassign_seq and metas else None

            def entry(state: State) -> dict:
                mine = metas
                if ranked is not None:
                    mine = self._write_renumbered(names, *ranked, state.last_seq, folder)
                added[:] = self._numbered(mine, 0, state.next_file_id)
                return {"add": added, "last_seq": max((m["max_seq"] for m in mine), default=0)}

            self._commit(entry)
        self._event("ingest", f"{len(added)} files")
        return [m["file_id"] for m in added]

    def _renumbered(self, names: list[str], stage: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict[int, int]]:
        """The distinct sequence numbers of some files in order (seq, _at), and each partition's offset."""
        log = read_segments(self.spark, [self._files.spark_path(n) for n in names])
        ranked = stage(log.select("seq").distinct().orderBy("seq").withColumn("_at", F.monotonically_increasing_id()))
        parts = {r[0]: r[1] for r in ranked.groupBy(F.shiftright("_at", 33)).count().collect()}
        before, offsets = 0, {}
        for p in sorted(parts):
            offsets[p] = before - (p << 33)
            before += parts[p]
        return ranked, offsets

    def _write_renumbered(self, names: list[str], ranked: DataFrame, offsets: dict[int, int], last_seq: int, folder: str) -> list[dict]:
        log = read_segments(self.spark, [self._files.spark_path(n) for n in names])
        fresh = self._shifted(ranked, offsets).select(F.col("seq").alias("_old"), (F.lit(last_seq + 1) + F.col("_at")).alias("_new"))
        log = log.join(fresh, log["seq"] == fresh["_old"]).withColumn("seq", F.col("_new")).select(*RECORD_COLUMNS)
        return write_segments(log, self._files, len(names), self.options, self._state.families, f"{folder}/{uuid.uuid4().hex}")

    def create_checkpoint(self, path: str) -> None:
        """A store of its own with the same content; the folder must be empty."""
        self._open()
        self.sync()
        there = files_at(self.spark, path)
        there.make("")
        if there.list(""):
            raise InvalidArgument("checkpoint folder is not empty")
        for m in self._state.files.values():
            there.copy_in(self._files.path(m["path"]), m["path"])
        there.make("_log")
        there.write_new(f"_log/{self._state.version:020d}.state.json", json.dumps(self._state.to_json()).encode())
        self._event("checkpoint", path)

    # --- introspection -------------------------------------------------------------------------

    def metrics(self) -> DataFrame:
        """name, value of every counter."""
        return self.spark.createDataFrame([(k, v) for k, v in self._state.counters.items()], "name string, value long")

    def events(self) -> DataFrame:
        return self.spark.createDataFrame(list(self._events), "at_micros long, kind string, detail string")

    def files(self) -> DataFrame:
        """The live files with their statistics."""
        columns = ("level", "file_id", "path", "file_size", "min_key", "max_key", "min_seq", "max_seq", "n_records", "n_range_tombstones", "n_operands")
        schema = "level int, file_id long, path string, file_size long, min_key binary, max_key binary, min_seq long, max_seq long, n_records long, n_range_tombstones long, n_operands long"
        return self.spark.createDataFrame([tuple(m[c] for c in columns) for m in self._state.files.values()], schema)

    def property(self, name: str) -> DataFrame | None:
        """stats or options as (name, value); None for any other property."""
        kind = name.rpartition(".")[2]
        if kind == "stats":
            rows = [(k, str(v)) for k, v in self._state.counters.items()]
            for level in range(max(2, self.options.max_levels)):
                own = [m["file_size"] for m in self._state.files.values() if m["level"] == level]
                rows += [(f"level_{level}_files", str(len(own))), (f"level_{level}_bytes", str(sum(own)))]
        elif kind == "options":
            rows = [(k, v.name if isinstance(v, Enum) else str(v)) for k, v in asdict(self.options).items()]
        else:
            return None
        return self.spark.createDataFrame(rows, "name string, value string")

    def stall_reason(self) -> str | None:
        return compaction.stall_reason(list(self._state.files.values()), self.options)

    def set_event_listener(self, listener: Callable[[tuple[int, str, str]], None] | None) -> None:
        self._listener = listener

    def _event(self, kind: str, detail: str) -> None:
        event = (int(self._clock() * 1e6), kind, detail)
        self._events.append(event)
        if self._listener:
            self._listener(event)

    def _open(self) -> None:
        if self._closed:
            raise StoreError("the store is closed")

    def close(self) -> None:
        """Commit what is waiting; the handle can't be used afterwards."""
        if not self._closed:
            self.sync()
            self._uncache()
            self._closed = True

    def __enter__(self) -> KVStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()
