"""Segments: Parquet files of records sorted by key and falling sequence number, with statistics."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptError
from ..records import MERGE_OPERAND, RANGE_TOMBSTONE, RECORD, RECORD_COLUMNS, Compression, Options

ARROW_TYPES = (pa.int32(), pa.binary(), pa.int64(), pa.int8(), pa.binary(), pa.binary())


def physical_key(cf_id: int, key: bytes) -> bytes:
    """Column family and key in one string of bytes, so that families lie side by side."""
    return cf_id.to_bytes(4, "big") + key


def as_arrow(rows: Sequence[tuple]) -> pa.Table:
    """Records on the driver as one table, a column at a time."""
    return pa.table([pa.array(column, t) for column, t in zip(zip(*rows, strict=True), ARROW_TYPES, strict=True)], names=RECORD_COLUMNS)


def read_segments(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).parquet(*paths)


def write_segments(records: DataFrame, files, n_files: int, options: Options, families: dict[int, str], folder: str | None = None, replaces: Sequence[str] = ()) -> list[dict]:
    """Write records as n_files sorted files of disjoint key ranges and return what is known of each.

    All versions of a key are in one file. A catalog goes beside the files, so that a store can be
    rebuilt from its segments alone: the families, and for a rewrite the files that it replaces.
    """
    folder = folder or f"data/{uuid.uuid4().hex}"
    writer = (
        records.select(*RECORD_COLUMNS)
        .repartitionByRange(max(1, n_files), "cf_id", "key")
        .sortWithinPartitions("cf_id", "key", F.desc("seq"), "vt")
        .write.option("compression", options.compression.value if isinstance(options.compression, Compression) else options.compression)
    )
    if options.bloom_bits_per_key:
        ndv = 1 << 20  # a file splits long before it has more keys
        fpp = max(1e-6, min(0.5, 0.6185**options.bloom_bits_per_key))  # of an optimal filter with so many bits a key
        writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer = writer.option("parquet.bloom.filter.fpp#key", str(fpp)).option("parquet.bloom.filter.expected.ndv#key", str(ndv))
    writer.parquet(files.spark_path(folder))
    names = [f"{folder}/{n}" for n in files.list(folder) if n.endswith(".parquet")]
    write_catalog(files, folder, families, names, replaces)
    return describe(records.sparkSession, files, names)


def read_small(files, names: Sequence[str]) -> pa.Table:
    """The records of few small segments, on the driver."""
    schema = pa.schema(list(zip(RECORD_COLUMNS, ARROW_TYPES, strict=True)))
    return pa.concat_tables([pq.read_table(io.BytesIO(files.read(n)), columns=RECORD_COLUMNS).cast(schema) for n in names]).combine_chunks()


def write_small(records: pa.Table, files, n_files: int, options: Options, families: dict[int, str], folder: str, replaces: Sequence[str] = ()) -> list[dict]:
    """write_segments() for few records, on the driver without a job.

    Without Bloom filters: a file is a single small row group.
    """
    records = records.sort_by([("cf_id", "ascending"), ("key", "ascending"), ("seq", "descending"), ("vt", "ascending")]).combine_chunks()
    starts = np.flatnonzero(~same_key_as_before(records))
    at = [0, *(int(starts[min(np.searchsorted(starts, len(records) * i // n_files), len(starts) - 1)]) for i in range(1, n_files if len(starts) else 0)), len(records)]
    kind = options.compression.value if isinstance(options.compression, Compression) else options.compression
    files.make(folder)
    out = []
    for lo, hi in zip(at, at[1:], strict=False):
        if lo == hi:
            continue
        part, name, buffer = records.slice(lo, hi - lo), f"{folder}/part-{len(out):05d}.parquet", io.BytesIO()
        pq.write_table(part, buffer, compression=kind.removesuffix("_raw"))
        files.write_new(name, buffer.getvalue())
        first_cf, last_cf = part["cf_id"][0].as_py(), part["cf_id"][-1].as_py()
        ends = part.filter(pc.equal(part["cf_id"], last_cf))
        seqs = pc.min_max(part["seq"])
        out.append(
            {
                "path": name,
                "file_size": len(buffer.getvalue()),
                "min_key": physical_key(first_cf, part["key"][0].as_py()),
                "max_key": physical_key(last_cf, pc.max(pc.coalesce(ends["end_key"], ends["key"])).as_py()),
                "min_seq": seqs["min"].as_py(),
                "max_seq": seqs["max"].as_py(),
                "n_records": len(part),
                "n_range_tombstones": pc.sum(pc.equal(part["vt"], RANGE_TOMBSTONE), min_count=0).as_py(),
                "n_operands": pc.sum(pc.equal(part["vt"], MERGE_OPERAND), min_count=0).as_py(),
            }
        )
    write_catalog(files, folder, families, [m["path"] for m in out], replaces)
    return out


def same_key_as_before(records: pa.Table) -> np.ndarray:
    """Whether a row has the family and key of the row before it."""
    out = np.zeros(len(records), bool)
    if len(records) > 1:
        cf, key = records["cf_id"].combine_chunks(), records["key"].combine_chunks()
        out[1:] = pc.and_(pc.equal(cf[1:], cf[:-1]), pc.equal(key[1:], key[:-1])).to_numpy(zero_copy_only=False)
    return out


def write_catalog(files, folder: str, families: dict[int, str], names: Sequence[str], replaces: Sequence[str] = ()) -> None:
    files.write_new(f"{folder}/_segment.json", json.dumps({"families": sorted(families.items()), "files": list(names), "replaces": list(replaces)}).encode())


def describe(spark: SparkSession, files, names: list[str]) -> list[dict]:
    """Statistics of segment files, found by one aggregation over them; empty files are left out."""
    if not names:
        return []
    given = spark.read.parquet(*[files.spark_path(n) for n in names])
    missing = set(RECORD_COLUMNS) - set(given.columns)
    if missing:
        raise CorruptError(f"a segment lacks {sorted(missing)}")
    rows = given.select(*[F.col(f.name).cast(f.dataType) for f in RECORD.fields], F.col("_metadata.file_path").alias("_path"))
    last = F.struct("cf_id", F.coalesce("end_key", "key").alias("key"))
    found = rows.groupBy("_path").agg(
        F.min(F.struct("cf_id", "key")).alias("lo"),
        F.max(last).alias("hi"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
        F.count("*").alias("n_records"),
        F.count_if(F.col("vt") == RANGE_TOMBSTONE).alias("n_range_tombstones"),
        F.count_if(F.col("vt") == MERGE_OPERAND).alias("n_operands"),
    )
    by_end = {n.rsplit("/", 2)[-2] + "/" + n.rsplit("/", 1)[-1]: n for n in names}
    out = []
    for r in found.collect():
        name = by_end["/".join(r["_path"].split("/")[-2:])]
        out.append(
            {
                "path": name,
                "file_size": files.size(name),
                "min_key": physical_key(r["lo"]["cf_id"], bytes(r["lo"]["key"])),
                "max_key": physical_key(r["hi"]["cf_id"], bytes(r["hi"]["key"])),
                **{k: r[k] for k in ("min_seq", "max_seq", "n_records", "n_range_tombstones", "n_operands")},
            }
        )
    return sorted(out, key=lambda m: m["min_key"])
