"""Column functions on binary keys and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def little_endian_u64(value: Column) -> Column:
    """The first eight bytes as an unsigned little-endian number, DECIMAL(20,0); null if shorter."""
    swapped = F.concat(*[F.hex(F.substring(value, 9 - i, 1)) for i in range(1, 9)])
    return F.when(F.octet_length(value) >= 8, F.conv(swapped, 16, 10).cast("decimal(20,0)"))


def prefix_successor(key: Column) -> Column:
    """The least key above all that begin with key; null for empty or all-0xFF keys."""
    head = F.regexp_extract(F.hex(key), "^((?:..)*?)(?:FF)*$", 1)
    last = F.conv(F.right(head, F.lit(2)), 16, 10).cast("int") + 1
    raised = F.concat(F.substring(head, F.lit(1), F.length(head) - 2), F.lpad(F.hex(last), 2, "0"))
    return F.when(F.length(head) >= 2, F.unhex(raised))


def op_bytes(vt: Column, key: Column, value: Column, end_key: Column) -> Column:
    """Bytes a record takes in an encoded batch; fixed overheads by type."""
    k = F.octet_length(key)
    return (
        F.when(vt == 0, 9 + k)
        .when(vt == 2, 13 + k + F.coalesce(F.octet_length(end_key), F.lit(0)))
        .otherwise(13 + k + F.coalesce(F.octet_length(value), F.lit(0)))
        .cast("long")
    )


BATCH_OVERHEAD, LOG_RECORD_OVERHEAD = 4, 12
