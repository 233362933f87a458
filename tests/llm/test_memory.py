"""What a worker holds counts against its executor, beside what earlier stages left there."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa

from lamina.llm import decontaminate as D
from lamina.llm import jaccard_join, mixing
from lamina.llm.common import shards, small_table


def test_the_array_of_a_shard_takes_a_bounded_multiple_of_its_texts():
    rng = random.Random(9)
    item = " ".join(f"w{i}" for i in range(12))
    word = lambda: rng.choice(["benchmark", "corpus", "shard", "suffix", f"number{rng.randrange(900)}"])
    texts = [" ".join(word() for _ in range(300)) for _ in range(600)]
    texts[5] += f" {item} and more"
    held = [t.encode() for t in texts]
    sets = [D.TestSet([("1", D.words_of(item.encode()))], 10)]
    tracemalloc.start()
    found = [int(hit.sum()) for _, hit, _, _ in D.scan(held, sets)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[5] == sum(found) == 12
    assert most < 8 * sum(map(len, held))


def test_a_shard_holds_one_copy_of_its_texts():
    batches = (pa.RecordBatch.from_pydict({"text": ["x" * 1000] * 100}) for _ in range(40))
    before, most = pa.total_allocated_bytes(), 0
    for whole in shards(batches, "text", 1_000_000):
        most = max(most, pa.total_allocated_bytes() - before)
        assert whole.num_rows == 1000
        del whole
    assert most < 1_500_000


def test_stages_start_no_python_workers_of_a_second_kind(spark, monkeypatch):
    def refuse(*a, **k):
        raise AssertionError("a list becomes a table through Python workers on the executors")

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    single = jaccard_join.one_of_each(docs)
    assert 0 < single.count() <= docs.count()
    assert mixing.mixed_documents(single).count() > 0


def test_small_tables(spark):
    rows = [(0, -(1 << 62)), (7 << 33, 5)]
    made = small_table(spark, rows, "_part long, _shift long")
    assert made.dtypes == [("_part", "bigint"), ("_shift", "bigint")] and sorted(map(tuple, made.collect())) == rows
    assert small_table(spark, [], "node long, component long").collect() == []
