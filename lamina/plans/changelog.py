"""The canonical change log: the events table read as operations on two column families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..records import MERGE_OPERAND, RANGE_TOMBSTONE, TOMBSTONE, VALUE


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cf_id, key, seq, vt, val, end_key from events.

    Signups and purchases are values, views and clicks merge operands, errors deletes; every tenth
    error deletes the five keys from its own. Keys are zero-padded, so that byte order is well defined.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    vt = (
        F.when(kind.isin("signup", "purchase"), VALUE)
        .when(kind.isin("view", "click"), MERGE_OPERAND)
        .when((kind == "error") & (F.col("event_id") % 10 == 0), RANGE_TOMBSTONE)
        .otherwise(TOMBSTONE)
        .cast("byte")
    )
    padded = lambda n: F.lpad(n.cast("string"), 6, "0").cast("binary")
    return e.select(
        F.when(F.col("value") < 50, 0).otherwise(1).cast("int").alias("cf_id"),
        padded(F.col("user_id")).alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        vt.alias("vt"),
        F.when(kind == "error", F.lit("")).otherwise(F.substring(kind, 1, 1)).cast("binary").alias("val"),
        F.when(vt == RANGE_TOMBSTONE, padded(F.col("user_id") + 5)).alias("end_key"),
    )


def counter_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log with whole numbers as values: a value is its number, an operand adds to it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") + 1).alias("seq"), F.floor("value").cast("long").cast("string").cast("binary").alias("_n"))
    log = changelog(spark, sf_dir)
    numbered = log.join(e, "seq")
    return numbered.withColumn("val", F.when(F.col("vt").isin(VALUE, MERGE_OPERAND), F.col("_n")).otherwise(F.col("val"))).select(*log.columns)


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines as upserts of an order's state: a large key space, several versions a key."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # a line that occurs more than once is one version
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"), F.max("l_linestatus").alias("l_linestatus"))
    key = lambda c: F.lpad(c.cast("string"), 12, "0").cast("binary")
    none = F.lit(None).cast("binary")
    first = orders.select(F.lit(0).alias("cf_id"), key(F.col("o_orderkey")).alias("key"), (F.col("o_orderkey") * 100).alias("seq"), F.lit(VALUE).cast("byte").alias("vt"), F.col("o_orderstatus").cast("binary").alias("val"), none.alias("end_key"))
    later = lines.select(
        F.lit(0).alias("cf_id"),
        key(F.col("l_orderkey")).alias("key"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
        F.when(F.col("l_returnflag") == "R", TOMBSTONE).otherwise(VALUE).cast("byte").alias("vt"),
        F.when(F.col("l_returnflag") == "R", F.lit("")).otherwise(F.col("l_linestatus")).cast("binary").alias("val"),
        none.alias("end_key"),
    )
    return first.unionByName(later)
