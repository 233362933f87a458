"""Merge operators: what becomes of a base value and the operands written after it.

An operator is a Catalyst expression over (key, base or null, operands oldest first) or a Python
function with the same arguments, which runs in Arrow batches. A null result means that the key is
absent. Operators whose operands aggregate say how; then no row ever holds all operands of a key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MergeOperator:
    """fold: the expression; reduce: an aggregate over operands and their sequence numbers, and combine of
    base and its result."""

    name: str
    fold: Callable[[Column, Column, Column], Column]
    reduce: Callable[[Column, Column], Column] | None = None
    combine: Callable[[Column, Column], Column] | None = None


def _number(value: Column) -> Column:
    return value.cast("string").try_cast("decimal(38,0)")


def _as_bytes(number: Column) -> Column:
    return number.cast("string").cast("binary")


def _append(key: Column, base: Column, operands: Column) -> Column:
    return F.aggregate(operands, F.coalesce(base, F.lit(b"")), lambda a, x: F.concat(a, x))


def _sum(key: Column, base: Column, operands: Column) -> Column:
    start = F.coalesce(_number(base), F.lit(0).cast("decimal(38,0)"))
    return _as_bytes(F.aggregate(operands, start, lambda a, x: (a + F.coalesce(_number(x), F.lit(0))).cast("decimal(38,0)")))


APPEND = MergeOperator("append", _append)
SUM = MergeOperator(
    "sum",
    _sum,
    lambda v, seq: F.sum(_number(v)),
    lambda base, x: F.when(base.isNotNull() | x.isNotNull(), _as_bytes((F.coalesce(_number(base), F.lit(0)) + F.coalesce(x, F.lit(0))).cast("decimal(38,0)"))),
)
MAX = MergeOperator("max", lambda k, b, o: F.greatest(b, F.array_max(o)), lambda v, seq: F.max(v), lambda base, x: F.greatest(base, x))
MIN = MergeOperator("min", lambda k, b, o: F.least(b, F.array_min(o)), lambda v, seq: F.min(v), lambda base, x: F.least(base, x))
LAST = MergeOperator("last", lambda k, b, o: F.coalesce(F.try_element_at(o, F.lit(-1)), b), lambda v, seq: F.max_by(v, seq), lambda base, x: F.coalesce(x, base))


def _set_union(key: Column, base: Column, operands: Column) -> Column:
    """Members separated by commas; the result is sorted."""
    every = F.concat(F.array(F.coalesce(base.cast("string"), F.lit(""))), F.transform(operands, lambda x: x.cast("string")))
    members = F.array_distinct(F.flatten(F.transform(every, lambda x: F.split(x, ","))))
    return F.array_join(F.array_sort(F.filter(members, lambda m: m != "")), ",").cast("binary")


def _set_combined(base: Column, operands: Column) -> Column:
    """A value without operands stays as it is."""
    return F.when(operands.isNull() | (F.size(operands) == 0), base).otherwise(_set_union(base, base, operands))


#: The distinct operands of a key are about as large as its result.
SET_UNION = MergeOperator("set_union", _set_union, lambda v, seq: F.collect_set(v), _set_combined)
BUILT_IN = {m.name: m for m in (APPEND, SUM, MAX, MIN, LAST, SET_UNION)}


def from_python(function: Callable[[bytes, bytes | None, list[bytes]], bytes | None], name: str = "python") -> MergeOperator:
    """An operator from full_merge(key, existing, operands); it must be deterministic."""

    @F.pandas_udf("binary")
    def full_merge(key: pd.Series, base: pd.Series, operands: pd.Series) -> pd.Series:
        return pd.Series([function(bytes(k), None if b is None else bytes(b), [bytes(x) for x in o]) for k, b, o in zip(key, base, operands, strict=True)], dtype=object)

    return MergeOperator(name, lambda k, b, o: full_merge(k, b, o))


def merge_operator(given: str | MergeOperator | Callable) -> MergeOperator:
    if isinstance(given, MergeOperator):
        return given
    if isinstance(given, str):
        return BUILT_IN[given]
    return from_python(given)
