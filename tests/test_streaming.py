from __future__ import annotations

from lamina.records import RECORD
from lamina.store import KVStore
from lamina.streaming.sink import latest_values, write_stream

from .model import Model

OPS = "ord long, cf_id int, op string, key binary, value binary, end_key binary"


def test_a_stream_into_a_store_survives_a_rerun(spark, tmp_path):
    source = f"file://{tmp_path}/ops"
    model = Model()
    for part in range(2):
        rows = [(part * 10 + i, 0, "put" if i % 2 else "merge", f"k{i % 3}".encode(), f"{part}{i}".encode(), None) for i in range(10)]
        for _, _, op, k, v, _ in rows:
            model.add(0, 1 if op == "put" else 3, k, v)
        spark.createDataFrame(rows, OPS).coalesce(1).write.mode("append").parquet(source)
    store = KVStore(spark, str(tmp_path / "db"))
    for _ in range(2):  # the second run begins with no checkpoint of its own and must change nothing
        stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)
        write_stream(stream, store, "q", f"file://{tmp_path}/cp{_}").trigger(availableNow=True).start().awaitTermination()
    assert store.snapshot() == 20
    assert {(0, k): v for k, v in store.iterate()} == model.state()


def test_latest_values_keep_the_newest_by_seq(spark, tmp_path):
    source = f"file://{tmp_path}/log"
    for rows in ([(0, b"a", 5, 1, b"new", None), (0, b"b", 1, 1, b"x", None)], [(0, b"a", 3, 1, b"late", None), (0, b"b", 2, 0, b"", None)]):
        spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(source)
    q = latest_values(stream).writeStream.format("memory").queryName("latest").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.sql("SELECT * FROM latest").collect():
        k = bytes(r["key"])
        if k not in last or r["seq"] >= last[k][0]:
            last[k] = (r["seq"], None if r["val"] is None else bytes(r["val"]))
    assert last == {b"a": (5, b"new"), b"b": (2, None)}
