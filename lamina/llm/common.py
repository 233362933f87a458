"""Helpers that the corpus operators share: session settings, shared-folder tables and batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import json
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch; with the longest texts near 1 MB a batch stays within 256 MB.
BATCH_ROWS = 256


def by_value(module: str) -> None:
    """Ship a module's functions inside the task, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by rows; texts vary too much in length for the default of 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


_own_folder: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode where none is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="lamina-")
    return _own_folder[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lamina-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget(paths_kept: int = 0) -> None:
    """Delete the tables written so far, but for the first paths_kept."""
    while len(_written) > paths_kept:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; its scratch folder goes with it
            return


atexit.register(forget)


def discard(df: DataFrame) -> None:
    """Delete one table written by materialize() that no later plan reads."""
    files = set(df.inputFiles()[:1])
    for entry in list(_written):
        spark, path = entry
        tail = path.rsplit("/", 1)[-1]
        if any(tail in f for f in files):
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            _written.remove(entry)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table, made by the JVM: createDataFrame() of a list runs Python workers of a
    second kind on the executors, and the process that forks them stays in memory to the session's end."""
    names = [field.split()[0] for field in schema.split(",")]
    held = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    made = spark.range(1).select(F.from_json(F.lit(held), f"array<struct<{', '.join(':'.join(f.split()) for f in schema.split(','))}>>").alias("held"))
    return made.select(F.inline("held"))


def lean(work: Callable) -> Callable:
    """Work on batches that leaves a worker process no larger than it must be: workers are reused, and
    what their allocators hold back counts against the executor while it does other things."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from work(batches)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return run


def shards(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Join batches until the bytes of a string column pass limit; one longer row is a shard by itself."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(column)).nbytes
        if size >= limit:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size, batch = [], 0, None  # the caller works on one copy of the texts, not on two
            yield whole
    if held:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held = batch = None
        yield whole


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    return [b or b"" for b in col.to_pylist()]


def lower_ascii(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def learnable(modulus: int, left_out: int):
    """Rows a model may learn from: crc32 of doc_id as text, modulo modulus, is not left_out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != left_out


def held_out(modulus: int, left_out: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == left_out, F.lit(False))
