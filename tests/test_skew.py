"""Ordering primitives against brute force, with one key holding a third of the rows."""
import random

import pytest
from pyspark.sql import functions as F

from packledger.functions import skew


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{rnd.randrange(40)}")
        rows.append((key, rnd.randrange(500), i, rnd.choice([0, 1, 1]), rnd.choice([None, rnd.randrange(4000) / 4])))
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "key string, t int, ord int, flag int, v double").repartition(7)


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def order():
    return [F.col("t"), F.col("ord")]


def test_numbered(table):
    rows, df = table
    got = {r.ord: r.rn for r in skew.numbered(df, ["key"], order(), F.floor(F.col("t") / 20)).collect()}
    want = {r[2]: i for g in grouped(rows).values() for i, r in enumerate(g, 1)}
    assert got == want


def test_numbered_overall(table):
    rows, df = table
    got = {r.ord: r.rn for r in skew.numbered(df, [], order(), F.floor(F.col("t") / 20)).collect()}
    assert got == {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), 1)}


def test_running_sum(table):
    rows, df = table
    got = {r.ord: r.s for r in skew.running_sum(df, ["key"], order(), F.floor(F.col("t") / 20), F.col("flag"), "s").collect()}
    want = {}
    for g in grouped(rows).values():
        total = 0
        for r in g:
            total += r[3]
            want[r[2]] = total
    assert got == want


def test_previous(table):
    rows, df = table
    out = skew.previous(df, ["key"], order(), F.floor(F.col("t") / 20), F.struct("ord"), "p")
    got = {r.ord: (r.p.ord if r.p else None) for r in out.collect()}
    want = {}
    for g in grouped(rows).values():
        for a, b in zip([None, *g], g):
            want[b[2]] = a[2] if a else None
    assert got == want


def test_medians_and_ranks(table):
    import statistics
    rows, df = table
    got = {r.key: r.m for r in skew.exact_median(df, ["key"], F.col("v"), "m", 10.0).collect()}
    vals = {}
    for r in rows:
        if r[4] is not None:
            vals.setdefault(r[0], []).append(r[4])
    assert got == {k: statistics.median(v) for k, v in vals.items()}
    top = skew.value_at_rank(df, ["key"], F.col("v"), {"least": F.lit(1), "upper": F.floor(F.col("n") / 2) + 1}).collect()
    assert {r.key: (r.least, r.upper) for r in top} == {k: (min(v), sorted(v)[len(v) // 2]) for k, v in vals.items()}


def test_first_per_key_prunes_before_the_shuffle(table):
    _, df = table
    plan = skew.first_per_key(df, ["key"], order())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_ranked_divides_a_hot_key_whatever_its_order_values_are(spark):
    from packledger.functions.skew import ranked
    rng = random.Random(6)
    rows = [("hot" if i % 3 else f"k{i % 50}", rng.randrange(10 ** 15) if i % 2 else i % 4, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "key string, ord long, id long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranked(df, ["key"], [F.col("ord").desc(), F.col("id")])
        found = {r["id"]: r["rn"] for r in got.collect()}
        held = df.repartitionByRange("key", F.col("ord").desc(), "id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in held) < 2 * len(rows) / 8  # no task has more than its share
    by_key = {}
    for key, ord_, id_ in sorted(rows, key=lambda r: (-r[1], r[2])):
        by_key[key] = by_key.get(key, 0) + 1
        assert found.pop(id_) == by_key[key]
    assert not found and ranked(df.limit(0), ["key"], [F.col("id")]).count() == 0
    alone = {r["id"]: r["rn"] for r in ranked(df, [], [F.col("id").desc()]).collect()}
    assert alone == {i: 6000 - i for i in range(6000)}


def test_dealt_moves_small_dense_inputs_only(spark, tmp_path):
    spark.range(20_000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("t")).coalesce(1).write.parquet(
        str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    out = skew.dealt(one)
    assert out.schema == one.schema and out.count() == 20_000
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() == cores
    wide = one.repartition(cores + 3)  # read in as many parts as there are cores: left alone
    assert skew.dealt(wide) is wide
    unknown = spark.createDataFrame([(1, "x")], "id long, t string").coalesce(1)
    assert skew.dealt(unknown) is unknown
    few = one.limit(1).coalesce(1)
    assert skew.dealt(few) is few


def test_texts_of_parts_are_read_in_several_tasks(spark, tmp_path):
    from packledger.plans import q_specs
    spark.range(40_000).selectExpr(
        "id AS p_partkey", "CAST(id % 50 AS INT) AS p_size", "md5(CAST(id AS STRING)) AS p_name", "id * 1.5D AS p_retailprice",
        "'Brand' AS p_brand").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = q_specs.x20(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 1
    assert q_specs._part(spark, str(tmp_path), t="p_name").agg({"k": "sum"}).first()[0] == sum(range(40_000))


def test_verdicts_are_reached_once_and_in_several_tasks(spark, tmp_path):
    """One narrow part file: rows are dealt out, and no filter carries the cascade below the column that holds it."""
    import re
    from packledger.plans import q_models as Q
    spark.range(40_000).selectExpr(
        "id AS p_partkey", "CAST(id % 50 AS INT) AS p_size", "md5(CAST(id AS STRING)) AS p_name", "id * 1.5D AS p_retailprice").coalesce(
        1).write.parquet(f"{tmp_path}/part.parquet")
    for query in (Q.n01b, Q.n05):
        df = query(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 1, query
        steps = re.split(r"\n[ :]*\+- ", df._jdf.queryExecution().optimizedPlan().toString())
        assert any("shoulder bag" in s for s in steps)
        assert not any("shoulder bag" in s for s in steps if s.startswith("Filter")), query
