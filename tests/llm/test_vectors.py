import math
import random

import numpy as np
import pytest

from packledger.llm import hnsw, topk

KIND = "vec_id long, embedding array<float>, label string, v int, ids string, shard string, score string, r int"
QUERY = "vec_id % 50 = 0"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *(None,) * 6) for i, v in rows], KIND)


def usable(rows, zero):
    out = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not (zero or any(v)):
            continue
        out[i, tuple(np.float32(v).tolist())] = None
    width = max((len(v) for _, v in out), default=0)
    return [(i, np.array([*v, *[0.0] * (width - len(v))])) for i, v in out]


def products(rows, k=5):
    rows = [(i, [math.floor(256 * x) for x in v.tolist()]) for i, v in usable(rows, True)]
    out = []
    for i, q in rows:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def cosines(rows):
    rows = usable(rows, False)
    return {i: sorted((-(q @ v) / math.sqrt(q @ q) / math.sqrt(v @ v), j) for j, v in rows if j != i)
            for i, q in rows if i % 50 == 0}


def odd_rows():
    rng = random.Random(4)
    hot = [0.5, 0.25, -0.125, 0.75]
    rows = [(i, hot) for i in range(100, 160)]
    rows += [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(160, 260)]
    return rows + [(0, None), (50, [0.0] * 4), (300, [1.0, None, 0.0, 0.0]), (350, [math.nan, 1.0, 0.0, 0.0]),
                   (400, [math.inf, 1.0, 0.0, 0.0]), (450, [1.0, 0.5]), (451, [1.0, 0.5, 0.0, 0.0]), (None, hot),
                   (500, [1e30, 1.0, 1.0, 1.0]), (200, rows[60][1]), (160, rows[60][1]), (551, [])][:-1]


def got(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_products_of_the_table(prepared):
    table = prepared.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    for shard in (topk.SHARD, 60):
        assert got(topk.inner_products(table, QUERY, shard=shard)) == products(rows)


def test_products_of_odd_rows(prepared):
    rows = [r for r in odd_rows() if r[0] != 500]
    assert got(topk.inner_products(frame(prepared, rows), QUERY, shard=30)) == products(rows)
    assert got(topk.inner_products(frame(prepared, []), QUERY)) == []
    assert got(topk.inner_products(frame(prepared, [(50, [1.0])]), QUERY)) == []
    two = [(50, [1.0, 2.0]), (51, [3.0])]
    assert got(topk.inner_products(frame(prepared, two), QUERY)) == products(two)


def test_bounds_hold_and_large_numbers_stay_exact():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-300, 300, (40, 13)).astype(float), rng.integers(-300, 300, (70, 13)).astype(float)
    for s in topk.resolutions(13):
        assert (topk.profile(a, s) @ topk.profile(b, s).T >= a @ b.T - 1e-6).all()
    big = rng.integers(-2 ** 28, 2 ** 28, (300, 6)).astype(float)
    pos, ids, score = topk.best(big[:5], big, 4, np.arange(300), np.arange(301))
    for q in range(5):
        exact = sorted((-sum(int(x) * int(y) for x, y in zip(big[q], v)), j) for j, v in enumerate(big))[:4]
        assert [(-s, j) for s, j in zip(score[pos == q].tolist(), ids[pos == q].tolist())] == exact


def test_neighbours_of_the_table(prepared):
    table = prepared.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id < 2000")
    true = cosines([(r["vec_id"], r["embedding"]) for r in table.collect()])
    rows = got(hnsw.neighbours(table, QUERY, shard=500))
    assert len(rows) == 5 * len(true)
    hits = 0
    for q, rank, v, score in rows:
        assert score == pytest.approx(-dict((j, s) for s, j in true[q])[v], rel=1e-12)
        hits += v in {j for _, j in true[q][:5]}
    assert hits / len(rows) >= 0.9
    for q in true:
        mine = [(-s, v) for i, _, v, s in rows if i == q]
        assert mine == sorted(mine)


def test_neighbours_of_odd_rows(prepared):
    rows = odd_rows()
    true = cosines(rows)
    found = got(hnsw.neighbours(frame(prepared, rows), QUERY, shard=40))
    # a query that is there twice has both lists
    assert {q for q, *_ in found} == set(true)
    for q in set(true) - {200}:
        mine = [(v, s) for i, _, v, s in found if i == q]
        assert [v for v, _ in mine] == [j for _, j in true[q][:5]] or \
            [s for _, s in mine] == pytest.approx([-s for s, _ in true[q][:5]], abs=1e-12)
    assert [v for i, _, v, _ in found if i == 100] == [101, 102, 103, 104, 105]
    assert got(hnsw.neighbours(frame(prepared, []), QUERY)) == []
    assert got(hnsw.neighbours(frame(prepared, [(50, [1.0])]), QUERY)) == []


def test_graph_survives_its_flat_form():
    x = hnsw.units(np.random.default_rng(3).normal(size=(400, 8)))
    g = hnsw.Graph(x)
    h = hnsw.Graph.of(x, **g.flat())
    for q in x[::40]:
        assert g.search(q).tolist() == h.search(q).tolist()
        assert g.search(q)[0] == int(np.argmax(x.astype(np.float32) @ q.astype(np.float32)))
