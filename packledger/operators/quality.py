"""The publish gate.  Every check returns findings: (severity, check, subject, measure)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as X
from ..functions.skew import value_at_rank

SEVERITY = {"note": 0, "warn": 1, "fail": 2}


def _finding(df: DataFrame, severity, check, subject: Column, measure: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    check = F.lit(check) if isinstance(check, str) else check
    return df.select(severity.alias("severity"), check.alias("check"),
                     subject.cast("string").alias("subject"),
                     measure.cast("double").alias("measure"))


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def check_required(bags: DataFrame, required: list[str] = X.REQUIRED_FIELDS) -> DataFrame:
    one = bags.agg(*[F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) == "").alias(f)
                     for f in required])
    long = one.unpivot([], required, "field", "missing").where(F.col("missing") > 0)
    return _finding(long, "fail", F.concat(F.lit("required:"), "field"), F.col("field"),
                    F.col("missing"))


def check_unique(bags: DataFrame) -> DataFrame:
    ids = bags.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    slugs = bags.groupBy("brand_slug", "slug").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > 1)
    return _union(_finding(ids, "fail", "unique:id", F.col("id"), F.col("n")),
                  _finding(slugs, "fail", "unique:permalink",
                           F.concat_ws("/", "brand_slug", "slug"), F.col("n")))


def check_bounds(bags: DataFrame, limits: dict = X.FIELD_BOUNDS,
                 max_share: float = 0.01) -> DataFrame:
    """Values outside their range per field; severity follows the share over all fields."""
    out = lambda f, lo, hi: F.count_if(F.col(f).isNotNull() & ~F.col(f).between(lo, hi))
    one = bags.agg(F.count(F.lit(1)).alias("n"),
                   *[out(f, lo, hi).alias(f) for f, (lo, hi) in limits.items()])
    one = one.withColumn("bad", sum(F.col(f) for f in limits))
    long = one.unpivot(["n", "bad"], list(limits), "field", "hits").where(F.col("hits") > 0)
    severity = F.when(F.col("bad") / F.col("n") > max_share, "fail").otherwise("warn")
    return _finding(long, severity, F.lit("bounds"), F.col("field"), F.col("hits"))


def check_shape(bags: DataFrame) -> DataFrame:
    lo, hi = X.DIM_BOUNDS
    total = F.aggregate("dims_cm", F.lit(0.0), lambda a, v: a + v)
    misshapen = ~F.size("dims_cm").between(2, 3) | ~F.forall(
        "dims_cm", lambda v: F.coalesce(v.between(lo, hi), F.lit(False)))
    skewed = F.abs(F.col("linear_cm") - total) > 1.0
    bad_dims = F.col("dims_cm").isNotNull() & (misshapen | F.coalesce(skewed, F.lit(False)))
    one = bags.agg(F.count_if(F.col("price_min") > F.col("price_max")).alias("price-order"),
                   F.count_if(bad_dims).alias("dims"),
                   F.count_if(F.coalesce("variant_count", F.lit(0)) == 0).alias("variants"))
    long = one.unpivot([], one.columns, "check", "n").where(F.col("n") > 0)
    return _finding(long, F.when(F.col("check") == "variants", "warn").otherwise("fail"),
                    F.col("check"), F.col("check"), F.col("n"))


def check_splits(bags: DataFrame) -> DataFrame:
    """One legacy claimant per split model, two members at least, no live path shadowed."""
    claim = F.coalesce("legacy_slug", F.lit("")) != ""
    groups = bags.where(F.col("split_from").isNotNull()).groupBy("split_from").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(claim).alias("claims"))
    live = bags.select(F.col("brand_slug").alias("__b"), F.col("slug").alias("__s")).distinct()
    shadow = bags.where(claim).join(live, (F.col("brand_slug") == F.col("__b"))
                                    & (F.col("legacy_slug") == F.col("__s")), "left_semi")
    return _union(
        _finding(shadow, "fail", "split:shadowed", F.col("id"), F.lit(1)),
        _finding(groups.where(F.col("claims") != 1), "fail", "split:legacy",
                 F.col("split_from"), F.col("claims")),
        _finding(groups.where(F.col("n") < 2), "fail", "split:orphan", F.col("split_from"),
                 F.col("n")))


def active(log: DataFrame) -> DataFrame:
    return log.where(~F.coalesce("platform", F.lit("")).isin(X.DORMANT))


def check_freshness(log: DataFrame, now, stale: int = 3, fail: int = 14) -> DataFrame:
    """Age of the last good fetch per active brand."""
    seconds = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(
        F.col("fetched_at").cast("timestamp"))
    ok = active(log).where((F.col("status") == "ok") & F.col("fetched_at").isNotNull()).withColumn(
        "age", F.floor(seconds / 86400))
    return _finding(ok.where(F.col("age") >= stale), F.when(F.col("age") >= fail, "fail")
                    .otherwise("warn"), F.lit("freshness"), F.col("slug"), F.col("age"))


def check_streaks(log: DataFrame, warn: int = 3, block: int = 10,
                  waived: DataFrame | None = None) -> DataFrame:
    """Nights in a row without a fetch; a waiver turns a block into a warning."""
    spark = log.sparkSession
    waived = waived if waived is not None else spark.createDataFrame([], "slug string")
    mark = waived.select(F.col("slug").alias("__w")).distinct()
    streak = F.coalesce("fail_streak", F.lit(0))
    bad = active(log).where(F.col("status") != "ok").withColumn("nights", streak).join(
        mark, F.col("slug") == F.col("__w"), "left")
    blocked = (F.col("nights") >= block) & F.col("__w").isNull()
    rows = _finding(bad.where(F.col("nights") >= warn), F.when(blocked, "fail").otherwise("warn"),
                    F.lit("fetch:failing"), F.col("slug"), F.col("nights"))
    spent = bad.where(F.col("nights") >= block).select(F.col("slug").alias("__s"))
    idle = mark.join(spent, F.col("__w") == F.col("__s"), "left_anti")
    return _union(rows, _finding(idle, "warn", "allow:failing-brands", F.col("__w"), F.lit(0)))


def check_currency(bags: DataFrame, ceiling: float = 1000.0, least: int = 5) -> DataFrame:
    """Brands said to price in dollars whose upper median is implausible."""
    usd = bags.where((F.upper(F.coalesce("currency", F.lit("USD"))) == "USD")
                     & (F.col("price_min") > 0))
    median = value_at_rank(usd, ["brand_slug"], F.col("price_min"),
                           {"median": F.floor(F.col("n") / 2) + 1}, 10.0)
    hit = median.where((F.col("n") >= least) & (F.col("median") > ceiling))
    mix = bags.groupBy(F.coalesce("currency_source", F.lit("unknown")).alias("s")).agg(
        F.count(F.lit(1)).alias("n"))
    return _union(_finding(hit, "fail", "currency", F.col("brand_slug"), F.col("median")),
                  _finding(mix, "note", "currency:provenance", F.col("s"), F.col("n")))


def check_roster(bags: DataFrame, roster: DataFrame) -> DataFrame:
    """Declared currencies that the evidence disagrees with."""
    said = bags.groupBy("brand_slug").agg(F.min_by(F.struct(
        F.upper(F.coalesce("currency", F.lit("USD"))).alias("currency"), "currency_source"),
        "ord").alias("got"))
    want = roster.where(F.coalesce("currency", F.lit("")) != "").select(
        F.col("slug").alias("brand_slug"), F.upper("currency").alias("want"))
    hit = want.join(said, "brand_slug").where(
        (F.col("got.currency") != F.col("want"))
        & F.col("got.currency_source").isin("feed", "product-page", "locale"))
    return _finding(hit, "warn", "currency:roster", F.col("brand_slug"), F.lit(1))


def _sizes(bags: DataFrame, name: str) -> DataFrame:
    return bags.where(F.coalesce("brand_slug", F.lit("")) != "").groupBy("brand_slug").agg(
        F.count(F.lit(1)).alias(name))


def check_brand_drop(bags: DataFrame, base: DataFrame, warn: float = 0.25, fail: float = 0.4,
                     least: int = 5, excused: DataFrame | None = None) -> DataFrame:
    """Fall of each brand's catalogue against the published one."""
    df = _sizes(base, "was").where(F.col("was") >= least).join(
        _sizes(bags, "now"), "brand_slug", "left")
    if excused is not None:
        df = df.join(excused.select("brand_slug"), "brand_slug", "left_anti")
    drop = (F.col("was") - F.coalesce("now", F.lit(0))) / F.col("was")
    hit = df.withColumn("drop", drop).where(F.col("drop") > warn)
    return _finding(hit, F.when(F.col("drop") > fail, "fail").otherwise("warn"),
                    F.lit("drop:brand"), F.col("brand_slug"), F.col("drop"))


def check_swept(bags: DataFrame, share: float = 0.6, least: int = 4,
                prices: int = 3) -> DataFrame:
    """One volume repeated over a brand's page-read volumes at several prices."""
    swept = bags.where(F.col("volume_source").isin(X.SWEPT_VOLUME_SOURCES)
                       & (F.coalesce("volume_l", F.lit(0.0)) != 0))
    per = swept.groupBy("brand_slug", "volume_source", "volume_l").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("price_min").alias("prices"))
    top = per.groupBy("brand_slug", "volume_source").agg(
        F.sum("n").alias("total"),
        F.max_by(F.struct("n", "prices"), F.struct("n", "prices", "volume_l")).alias("t"))
    hit = top.where((F.col("total") >= least) & (F.col("t.n") / F.col("total") >= share)
                    & (F.col("t.prices") >= prices))
    return _finding(hit, "warn", "volume:swept", F.concat_ws("/", "brand_slug", "volume_source"),
                    F.col("t.n") / F.col("total"))


def check_density(bags: DataFrame, floor: float = 5.0) -> DataFrame:
    """Bags too light for their own capacity, by what the weight was read from."""
    thin = bags.where((F.col("weight_g") != 0) & (F.col("volume_l") != 0)
                      & (F.col("weight_g") / F.col("volume_l") < floor))
    per = thin.groupBy(F.coalesce("weight_source", F.lit("?")).alias("s")).agg(
        F.count(F.lit(1)).alias("n"))
    return _finding(per, "warn", "density:implausible", F.col("s"), F.col("n"))


def removed_orphans(base: DataFrame, roster: DataFrame) -> DataFrame:
    """Brands the published catalogue held only through sources since removed."""
    gone = roster.where(F.col("platform") == "removed").select(F.col("slug").alias("__g"))
    marked = base.withColumn("__s", F.substring_index(F.coalesce("source", F.lit("")), ":", 1)).join(
        gone, F.col("__s") == F.col("__g"), "left")
    return marked.groupBy("brand_slug").agg(F.bool_and(F.col("__g").isNotNull()).alias("o")).where(
        "o").select("brand_slug")


def check_brands_gone(bags: DataFrame, base: DataFrame, allowed: DataFrame,
                      excused: DataFrame) -> DataFrame:
    """Brands that left the catalogue, by name; allowances nobody used."""
    now = bags.select("brand_slug").distinct()
    gone = base.where(F.coalesce("brand_slug", F.lit("")) != "").select("brand_slug").distinct() \
        .join(now, "brand_slug", "left_anti")
    ok = allowed.select("brand_slug").distinct().withColumn("__a", F.lit(True))
    out = excused.select("brand_slug").distinct().withColumn("__x", F.lit(True))
    df = gone.join(ok, "brand_slug", "left").join(out, "brand_slug", "left")
    severity = F.when(F.col("__a").isNotNull() | F.col("__x").isNotNull(), "note").otherwise("fail")
    unused = ok.join(gone, "brand_slug", "left_anti")
    return _union(_finding(df, severity, F.lit("drop:brand_count"), F.col("brand_slug"), F.lit(1)),
                  _finding(unused, "warn", "allow:brands-gone", F.col("brand_slug"), F.lit(0)))


def catalogue_measures(bags: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    pct = lambda f: F.when(n > 0, F.bround(F.lit(100.0) * F.count(f) / n, 0)).otherwise(0.0)
    one = bags.agg(n.cast("double").alias("bag_count"),
                   F.sum("variant_count").cast("double").alias("sku_count"),
                   *[pct(f).alias("coverage:" + f) for f in X.COVERAGE_FIELDS])
    return one.unpivot([], one.columns, "metric", "value")


def check_regression(bags: DataFrame, base: DataFrame, max_drop: float = 0.25,
                     max_points: float = 10.0) -> DataFrame:
    """Totals against the published catalogue: counts by share, coverage by points."""
    now = catalogue_measures(bags)
    was = catalogue_measures(base).withColumnRenamed("value", "was")
    df = now.join(was, "metric")
    covered = F.startswith("metric", F.lit("coverage:"))
    fell = F.when(covered, F.col("was") - F.col("value") > max_points).otherwise(
        F.col("value") < F.col("was") * (1 - max_drop))
    moved = F.col("value") != F.col("was")
    hit = df.where(fell | moved)
    name = F.when(covered, F.col("metric")).otherwise(F.concat(F.lit("drop:"), "metric"))
    return _finding(hit, F.when(fell, "fail").otherwise("note"), name, F.col("metric"),
                    F.col("value"))


CHECKS = {
    "required": check_required, "unique": check_unique, "bounds": check_bounds,
    "shape": check_shape, "splits": check_splits, "currency": check_currency,
    "swept": check_swept, "density": check_density,
}


def structural(bags: DataFrame) -> DataFrame:
    """All the checks that need nothing but the catalogue."""
    return _union(*[check(bags) for check in CHECKS.values()])


def gate(findings: DataFrame) -> DataFrame:
    """Verdict: counts per severity and whether the publish is blocked."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return findings.agg(n("note").alias("notes"), n("warn").alias("warnings"),
                        n("fail").alias("failures"), (n("fail") > 0).alias("blocking"))
