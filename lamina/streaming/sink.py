"""Structured Streaming: operations into a store, and a stateful view of the latest values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..store import KVStore


def write_stream(ops: DataFrame, store: KVStore, query_id: str, checkpoint: str) -> DataStreamWriter:
    """A writer of a stream of operations (ord, cf_id, op, key, value, end_key) into a store.

    Each micro-batch is one commit that carries the query's id and the batch's number, so a batch
    that runs again after a failure changes nothing. Order within a batch comes from ord alone.
    """

    def each(batch: DataFrame, number: int) -> None:
        store.write_ops(batch, applied=(query_id, number))

    return ops.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


class LatestValue(StatefulProcessor):
    """Keeps the newest value or tombstone of each key by seq; records may come out of order.

    Range tombstones touch many keys and so don't fit here; they go through the store.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._newest = handle.getValueState("newest", "seq long, vt int, val binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._newest.get() if self._newest.exists() else None
        best = tuple(held) if held is not None else None
        for pdf in rows:
            for seq, vt, val in zip(pdf["seq"], pdf["vt"], pdf["val"], strict=True):
                if best is None or seq > best[0]:
                    best = (int(seq), int(vt), val)
        if best is not None:
            self._newest.update(best)
            yield pd.DataFrame({"cf_id": [key[0]], "key": [key[1]], "seq": [best[0]], "val": [best[2] if best[1] == 1 else None]})

    def close(self) -> None:
        pass


def latest_values(records: DataFrame) -> DataFrame:
    """cf_id, key, seq, val after each micro-batch for the keys in it; val is null when deleted."""
    return records.groupBy("cf_id", "key").transformWithStateInPandas(
        statefulProcessor=LatestValue(), outputStructType="cf_id int, key binary, seq long, val binary", outputMode="Update", timeMode="None"
    )
