"""Round trips, and results that must not depend on partitioning."""
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from packledger.functions import text as T
from packledger.operators import models as M, prices as P
from packledger.plans import bindings as B


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(2, 119), st.integers(2, 119), st.integers(2, 119), st.integers(5, 1490)), min_size=5, max_size=20))
def test_rendered_figures_come_back(spark, cases):
    rows = [(f"Size {a} x {b} x {c} cm, capacity {v / 10:.1f} L", sorted([a, b, c], reverse=True), v / 10) for a, b, c, v in cases]
    df = spark.createDataFrame(rows, "t string, dims array<int>, v double")
    bad = df.where((T.dims(F.col("t"))["dims"].cast("array<int>") != F.col("dims")) | (T.volume(F.col("t")) != F.col("v")))
    assert bad.count() == 0


@pytest.mark.parametrize("parts", [1, 13])
def test_merge_does_not_depend_on_partitions(spark, data, parts):
    from packledger.plans.q_models import _listings
    out = M.merge_models(_listings(spark, data).repartition(parts), B.view(spark, data, "variant").repartition(parts))
    got = sorted(map(str, out.bags.collect())), sorted(map(str, out.variants.collect()))
    base = M.merge_models(_listings(spark, data), B.view(spark, data, "variant"))
    assert got == (sorted(map(str, base.bags.collect())), sorted(map(str, base.variants.collect())))


def test_moves_with_rebase_and_rebound(spark):
    rows = [("b1", "s", None, "2026-01-01", 1, 90.0, 100.0, False), ("b1", "s", None, "2026-01-02", 2, 100.0, 90.0, False),
            ("b2", "s", None, "2026-01-01", 3, 36.0, 40.0, False), ("b2", "t", None, "2026-01-01", 4, 390.0, 400.0, False),
            ("b3", "s", None, "2026-01-01", 5, 50.0, 100.0, False), ("b3", "s", None, "2026-01-03", 6, 259.0, None, True),
            ("b4", "s", None, "2025-01-01", 7, 1.0, 2.0, False)]
    df = spark.createDataFrame(rows, "bag_id string, sku string, color string, ts string, ord int, price double, prev_price double, "
                               "rebased boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.bag_id: (r.direction, r.previous_price, r.price) for r in P.moves_since(df, "2026-01-01 00:00:00").collect()}
    assert got == {"b2": ("down", 40.0, 36.0)}
