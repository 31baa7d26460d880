"""Stated cases for models, prices, browse, the gate and crawl history."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from packledger.operators import (alerts as A, browse as W, crawlops as O, models as M, prices as P,
                                  quality as V)
from packledger.plans import bindings as B
from packledger.schemas import BAG, VARIANT, conform


def bags(spark, rows):
    """Bags from dicts; what is not given is null or empty."""
    names = sorted({k for r in rows for k in r})
    kinds = {**BAG, "pk": "bigint"}
    df = spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows],
                               ", ".join(f"{k} {kinds[k]}" for k in names))
    out = conform(df, BAG)
    for c, t in BAG.items():
        if t == "array<string>":
            out = out.withColumn(c, F.coalesce(c, F.array().cast(t)))
    return out.withColumn("on_sale", F.coalesce("on_sale", F.lit(False))).withColumn(
        "in_stock", F.coalesce("in_stock", F.lit(True)))


def variants(spark, rows):
    names = sorted({k for r in rows for k in r})
    df = spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows],
                               ", ".join(f"{k} {VARIANT[k]}" for k in names))
    return conform(df, VARIANT)


def test_one_model_of_thirteen_colours(spark):
    words = ["Black", "Navy", "Olive", "Green", "Grey", "White", "Tan", "Brown", "Red", "Orange", "Yellow", "Purple", "Pink"]
    b = bags(spark, [{"id": f"m__p{i}", "brand_slug": "m", "brand": "M", "name": f"Stash Pouch - {w}", "ord": i, "url": f"u{i}",
                      "volume_l": 3.0 if i == 4 else None, "volume_source": "title" if i == 4 else None} for i, w in enumerate(words)])
    v = variants(spark, [{"bag_id": f"m__p{i}", "pos": 0, "sku": f"s{i}", "price": 10.0 + i} for i in range(13)])
    out = M.merge_models(b, v)
    row = out.bags.first()
    assert (out.bags.count(), row.name, row.merged_from, row.variant_count) == (1, "Stash Pouch", 13, 13)
    assert (row.id, row.volume_l, row.volume_source, row.price_min, row.price_max) == ("m__p4", 3.0, "title", 10.0, 22.0)
    assert out.values.where("kind = 'colors'").count() == 13
    assert [r.pos for r in out.variants.orderBy("pos").collect()] == list(range(13))


@pytest.mark.parametrize("sizes,names", [
    (["20L", "26L", "35L", "35L"], ["CIVIC 20L", "CIVIC 26L", "CIVIC 35L"]),
    (["20L", "26L", None], ["CIVIC 26L"]), (["20L", "20L"], ["CIVIC 26L"])])
def test_size_split(spark, sizes, names):
    b = bags(spark, [{"id": "e__civic", "brand_slug": "e", "brand": "E", "name": "CIVIC 26L", "ord": 1, "volume_l": 26.0, "dims_cm": [1.0]}])
    v = variants(spark, [{"bag_id": "e__civic", "pos": i, "size": s, "price": 100.0 + i} for i, s in enumerate(sizes)])
    out, moved = M.split_sizes(b, v)
    rows = out.orderBy("volume_l").collect()
    assert [r.name for r in rows] == names
    if len(names) > 1:
        assert [r.legacy_slug for r in rows] == [None, "civic-26l", None]
        assert [r.id for r in rows] == ["e__civic-20l", "e__civic-26l", "e__civic-35l"]
        assert all(r.dims_cm is None and r.split_from == "e__civic" for r in rows)
        assert {r.bag_id: r.n for r in moved.groupBy("bag_id").agg(F.count("*").alias("n")).collect()}["e__civic-35l"] == 2


def test_cross_product_collapses_to_pairs(spark):
    rows = [{"bag_id": "z__haul", "pos": i, "color": f"c{i % 21}", "price": 300.0 + 50 * (i % 2), "available": i == 239,
             "options": {"Torso": f"t{i % 6}"}} for i in range(241)]
    out = M.collapse_variants(variants(spark, rows), 25)
    # 21 colours and 2 prices, each pair once; the available one lends its stock to its pair
    assert out.variants.count() == len({(r["color"], r["price"]) for r in rows})
    assert out.variants.where("available").count() == 1
    assert out.axes.count() == 6
    for n in (25, 26):  # no size at which bags begin to be treated otherwise
        some = variants(spark, rows[:n])
        assert M.collapse_variants(some, 0).variants.count() == len({(r["color"], r["price"]) for r in rows[:n]})


def test_repeated_sku_is_not_a_key(spark):
    v = variants(spark, [{"bag_id": "c__allpa", "pos": 0, "sku": "A28", "color": "Red", "price": 190.0},
                         {"bag_id": "c__allpa", "pos": 1, "sku": "A28", "color": "Blue", "price": 205.0},
                         {"bag_id": "c__allpa", "pos": 2, "sku": "B1", "price": 205.0}])
    assert [r.key for r in P.variant_key(v).orderBy("pos").collect()] == [
        "c__allpa::#0:Red", "c__allpa::#1:Blue", "c__allpa::B1"]


def test_rebase_and_stock_change(spark):
    now = "2026-02-01 00:00:00"
    cur = spark.createDataFrame([("k1", "b", None, "s", 259.0, None, True, "USD@us"), ("k2", "b", None, "t", 50.0, None, False, "USD@default"),
                                 ("k3", "b", None, "u", 50.0, None, True, "USD@default")],
                                "key string, bag_id string, split_from string, sku string, price double, compare_at double, available boolean, basis string")
    old = spark.createDataFrame([("k1", 2500.0, None, True, "DKK@default", None, 100.0, None), ("k2", 50.0, None, True, None, None, 40.0, None),
                                 ("k3", 50.0, None, True, None, None, 40.0, None)],
                                "key string, price double, compare_at double, available boolean, basis string, first_seen timestamp_ntz, low double, last_change timestamp_ntz")
    rows = {r.key: r for r in P.diff_state(cur, old, now).collect()}
    assert set(rows) == {"k1", "k2"}
    assert (rows["k1"].rebased, rows["k1"].prev_price, rows["k1"].direction) == (True, None, None)
    assert (rows["k2"].delta, rows["k2"].direction) == (0.0, "up")
    state = {r.key: r for r in P.upsert_state(P.diff_state(cur, old, now), old).collect()}
    assert (state["k1"].low, state["k2"].low, state["k3"].low) == (259.0, 40.0, 40.0)


def test_watch_on_the_line_before_the_split(spark):
    ev = spark.createDataFrame([(f"e__civic-{s}", "e__civic", "e", p, -d, "down", i) for i, (s, p, d) in enumerate(
        [("20l", 150.0, 10.0), ("26l", 180.0, 30.0), ("35l", None, 50.0)])],
        "bag_id string, split_from string, brand_slug string, price double, delta double, direction string, ord int")
    subs = spark.createDataFrame([(1, "a@x.co", "u", "e__civic", None, None), (2, "b@x.co", "u", None, None, None),
                                  (3, "c@x.co", "u", None, "e", 160.0), (4, "d@x.co", "u", "e__civic-20l", "other", None)],
                                 "id int, email string, unsub_token string, watch_bag string, watch_brand string, max_price double").withColumn(
        "confirmed_at", F.current_timestamp())
    got = {(r.subscription_id, r.alert_key, r.bag_id) for r in A.steepest(subs, ev).collect()}
    # one alert for the line; an empty watch, an unknown price and a wrong brand give none
    assert got == {(1, "e__civic", "e__civic-26l"), (3, "e__civic", "e__civic-20l")}


def test_lifted_and_every_of_facets(spark):
    rows = [{"id": f"x__{i}", "brand": "X", "brand_slug": "x", "name": f"B{i}", "category": "daypack", "ord": i, "color_families": c, "features": f,
             "dims_cm": [50.0, 30.0, 20.0], "volume_l": None if i == 2 else 10.0, "variant_count": 1, "laptop_in": 16.0} for i, (c, f) in enumerate(
        [(["black"], ["rfid"]), (["green"], ["rfid"]), (["black", "green"], [])])]
    base = W.browse_rows(bags(spark, rows), B.airlines(spark))
    count = lambda q: {(r.group, r.value): r.n for r in W.facet_counts(W.marked(base, W.parse_filter(q))).collect()}
    black = count("color=black")
    assert (black["colors", "black"], black["colors", "green"], black["features", "rfid"]) == (2, 2, 1)
    assert count("feat=rfid")["colors", "green"] == 1
    assert [count("laptopMin=16")["laptop", str(n)] for n in (13, 16)] == [3, 3]
    assert W.totals(W.marked(base, W.parse_filter("volMin=0"))).first().total == 2
    assert W.parse_filter("per=60&scope=brand:x").scope == ("brand", "x")
    assert W.parse_filter("per=5000").per == 5000
    assert len(W.parse_filter("fav=" + ",".join(f"x__{i}" for i in range(200))).fav) == 200
    for bad in ("per=0", "per=x", "scope=brand:", "scope=shop:x"):
        with pytest.raises(ValueError):
            W.parse_filter(bad)


def test_brand_drop_and_swept_volume(spark):
    was = bags(spark, [{"id": f"a{i}", "brand_slug": "a", "ord": i} for i in range(88)] + [{"id": f"b{i}", "brand_slug": "b", "ord": i} for i in range(800)])
    now = was.where("NOT (brand_slug = 'a' AND ord < 36)")
    assert [(r.severity, r.subject) for r in V.check_brand_drop(now, was).collect()] == [("fail", "a")]
    assert not [r for r in V.check_regression(now, was).collect() if r.severity == "fail"]
    swept = bags(spark, [{"id": f"p{i}", "brand_slug": "u", "ord": i, "volume_l": 30.0, "volume_source": "product-page", "price_min": 10.0 + i} for i in range(31)])
    assert V.check_swept(swept).first().measure == 1.0


def test_erosion_calibration(spark):
    rnd, rows, start = random.Random(1), [], dt.datetime(2026, 1, 1)
    for n in range(22):
        night = start + dt.timedelta(days=n)
        for slug, count in (("steady", 100), ("noisy", int(100 * (1 + rnd.uniform(-.08, .08)))), ("slow", int(400 * .97 ** n)),
                            ("fast", int(400 * .94 ** n)), ("dark", 0), ("young", 10 if n > 18 else None)):
            if count is not None:
                rows.append((slug, night, n, "shopify", "ok", count))
    log = spark.createDataFrame(rows, "slug string, night timestamp_ntz, ord int, platform string, status string, product_count int")
    got = {r.slug: round(r["drop"], 2) for r in O.erosion(log).collect()}
    assert set(got) == {"slow", "fast"} and .24 < got["slow"] < .30 and .42 < got["fast"] < .50
    assert [(r.slug, r.nights_dark, r.capped) for r in O.dark(log).collect()] == [("dark", 22, True)]


def test_streaks(spark):
    night = dt.datetime(2026, 1, 1)
    rows = [("a", "ok"), ("a", "http_500"), ("a", "http_500"), ("b", "http_500"), ("b", "todo"), ("b", "empty"), ("c", "ok")]
    log = spark.createDataFrame([(s, st, night + dt.timedelta(days=i), i) for i, (s, st) in enumerate(rows)],
                                "slug string, status string, night timestamp_ntz, ord int")
    assert {r.slug: r.fail_streak for r in O.fail_streak(log).collect()} == {"a": 2, "b": 1, "c": 0}
    assert [r.fail_streak for r in O.running_streak(log).orderBy("ord").collect()] == [0, 1, 2, 1, 0, 1, 0]


def test_free_suffixes_of_crowded_stems(spark):
    import random
    rng = random.Random(8)
    taken = {"a", "b-2", "b-3", "c", *(f"c-{k}" for k in range(2, 3000)), "d", "d-02", "d-1", "d-x", "d-99999999999"}
    taken |= {f"e-{rng.randrange(2, 4000)}" for _ in range(1500)}
    rows = [(rng.randrange(10 ** 12), rng.choice(["a", "b", "c", "d", "e", "e", "e", "f", "g-2"])) for _ in range(3000)]
    got = {r["ord"]: r["id"] for r in M.uniq_id(spark.createDataFrame(rows, "ord long, candidate string"),
                                               spark.createDataFrame([(t,) for t in taken], "id string")).collect()}
    held = {}
    for ord_, stem in sorted(rows):
        n = held.get(stem, 1)
        name = stem if n == 1 else f"{stem}-{n}"
        while name in taken:
            n += 1
            name = f"{stem}-{n}"
        held[stem] = n + 1
        assert got[ord_] == name, (stem, n)
