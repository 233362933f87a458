"""The logical record of the change log, bounds of key ranges, and the options of a store."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidArgument

#: Record types; fixed values.
TOMBSTONE, VALUE, RANGE_TOMBSTONE, MERGE_OPERAND = 0, 1, 2, 3

RECORD = T.StructType(
    [
        T.StructField("cf_id", T.IntegerType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("seq", T.LongType()),
        T.StructField("vt", T.ByteType()),
        T.StructField("val", T.BinaryType()),
        T.StructField("end_key", T.BinaryType()),
    ]
)
RECORD_COLUMNS = RECORD.fieldNames()


class CompactionStyle(Enum):
    LEVELED = "leveled"
    FIFO = "fifo"
    UNIVERSAL = "universal"


class Compression(Enum):
    NONE = "none"
    LZ4 = "lz4_raw"
    ZSTD = "zstd"


@dataclass
class Options:
    """Settings of a store; the defaults are fixed values."""

    sync: bool = True
    memtable_max_bytes: int = 64 << 20
    l0_slowdown_trigger: int = 8
    l0_stop_trigger: int = 12
    max_levels: int = 4
    level1_target_bytes: int = 4 << 20
    level_multiplier: int = 10
    compaction_style: CompactionStyle = CompactionStyle.LEVELED
    fifo_l0_max_bytes: int = 0
    universal_min_merge_width: int = 2
    universal_max_merge_width: int = 8
    universal_size_ratio: int = 20
    bloom_bits_per_key: int = 10
    compression: Compression = Compression.NONE
    merge_operator: str | object = "append"
    max_write_bytes_per_sec: int = 0
    #: A handle keeps the live segments in the executors' memory while they are no larger; 0 keeps none.
    block_cache_capacity_bytes: int = 0
    event_log_capacity: int = 256
    log_checkpoint_every: int = 64
    drop_obsolete_versions_during_compaction: bool = True
    ttl_filter_from_value_prefix_micros: bool = False
    #: Compact without being asked once a flush makes it due.
    auto_compact: bool = True
    #: Delete files that nothing refers to when a store is opened and after its compactions.
    auto_vacuum: bool = False
    #: How long a stalled write waits for another handle to compact, where auto_compact is off.
    stall_wait_seconds: float = 0.0
    #: Reproduce the historical bounds and checks of delete_range and transactions.
    compat: bool = False


@dataclass(frozen=True)
class Bound:
    key: bytes | None = None
    inclusive: bool = True


@dataclass(frozen=True)
class KeyRange:
    """A range of keys; a bound without a key is open."""

    start: Bound = field(default_factory=Bound)
    end: Bound = field(default_factory=Bound)

    @staticmethod
    def all() -> KeyRange:
        return KeyRange()

    @staticmethod
    def half_open(start: bytes | None, end: bytes | None) -> KeyRange:
        return KeyRange(Bound(start), Bound(end, False))

    @staticmethod
    def closed(start: bytes | None, end: bytes | None) -> KeyRange:
        return KeyRange(Bound(start), Bound(end))

    @staticmethod
    def prefix(head: bytes) -> KeyRange:
        """All keys that begin with head."""
        stop = successor(head)
        return KeyRange(Bound(head), Bound(stop, False) if stop is not None else Bound())

    def holds(self, key: Column) -> Column:
        """The predicate on a binary column; it reaches the Parquet scan."""
        out = F.lit(True)
        if self.start.key is not None:
            low = F.lit(self.start.key)
            out = key >= low if self.start.inclusive else key > low
        if self.end.key is not None:
            high = F.lit(self.end.key)
            end = key <= high if self.end.inclusive else key < high
            out = end if self.start.key is None else out & end
        return out

    def contains(self, key: bytes) -> bool:
        if self.start.key is not None and (key < self.start.key or key == self.start.key and not self.start.inclusive):
            return False
        return self.end.key is None or key < self.end.key or key == self.end.key and self.end.inclusive

    def overlaps(self, start: Column, end: Column) -> Column:
        """Whether the interval [start, end) meets this range."""
        out = F.lit(True)
        if self.end.key is not None:
            high = F.lit(self.end.key)
            out = start <= high if self.end.inclusive else start < high
        if self.start.key is not None:
            out = out & (end > F.lit(self.start.key))
        return out

    def normalised(self, compat: bool = False) -> tuple[bytes, bytes] | None:
        """[start, end) of a range delete, or None if it is empty.

        Exclusive starts and inclusive ends use the next key, key + one zero byte; with compat the
        next key that does not begin with it.
        """
        if self.start.key is None or self.end.key is None:
            raise InvalidArgument("a range delete needs both bounds")

        def after(key: bytes) -> bytes:
            if not compat:
                return key + b"\0"
            found = successor(key)
            if found is None:
                raise InvalidArgument("no key follows this bound")
            return found

        start = self.start.key if self.start.inclusive else after(self.start.key)
        end = after(self.end.key) if self.end.inclusive else self.end.key
        return (start, end) if start < end else None


def successor(key: bytes) -> bytes | None:
    """The least key above all keys that begin with key: None for empty or all-0xFF keys."""
    head = key.rstrip(b"\xff")
    return head[:-1] + bytes([head[-1] + 1]) if head else None
