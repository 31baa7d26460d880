import numpy as np
import pytest
from pyspark.sql import functions as F
from test_vectors import QUERY, got, products

from packledger.llm import hnsw, topk, vectors


@pytest.fixture
def table(prepared):
    return prepared.read.parquet("/root/testdata/sf0.001/embeddings.parquet")


@pytest.mark.parametrize("module, search", [(hnsw, hnsw.neighbours), (topk, topk.inner_products)])
def test_copies_of_queries_are_not_gathered(table, module, search, monkeypatch):
    """Blocks for every shard are no side that Spark may gather for its small size, nor are the lists found."""
    plans = []
    ranked = vectors.ranked

    def seen(*args):
        plans.append(ranked(*args))
        return plans[-1]
    monkeypatch.setattr(vectors, "ranked", seen)
    rows = got(search(table, QUERY, shard=60))
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert rows and "MapInArrow" in plan and "Broadcast" not in plan


def test_a_shard_is_loaded_once_for_all_blocks(prepared):
    """Every block meets every shard that has vectors, whatever comes first."""
    blocks = prepared.createDataFrame([(b, [[float(b)]]) for b in range(7)], "block int, vs array<array<double>>")
    index = prepared.createDataFrame([(0, 10), (2, 30)], "shard int, n int")  # none has come to shard 1
    loads = prepared.sparkContext.accumulator(0)

    def load(row):
        loads.add(1)
        n = row["n"].as_py()
        return lambda q: (np.zeros(1, np.int32), np.array([n + int(q[0, 0])]), np.array([1]))

    rows = vectors.searched(blocks, index, 3, "long", load).collect()
    assert sorted((r["block"], r["vec_id"]) for r in rows) == sorted((b, n + b) for b in range(7) for n in (10, 30))
    assert loads.value == 2


def test_shards_grow_beyond_a_few(prepared, table, monkeypatch):
    monkeypatch.setattr(topk, "FEW", 2)
    monkeypatch.setattr(topk, "LARGEST", 90)
    monkeypatch.setattr(topk, "LANES", 3)
    held = prepared.range(1000).select(F.array("id").alias("v"))
    for size, few, largest, n in ((100, None, 0, 10), (100, 20, 500, 10), (100, 4, 200, 5), (100, 4, 500, 4), (300, 2, 10, 4)):
        assert vectors.shards(held, size, few, largest)[1] == n
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    assert got(topk.inner_products(table, QUERY, shard=30)) == products(rows)
