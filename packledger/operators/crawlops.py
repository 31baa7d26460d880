"""Crawl-log analytics: streaks, erosion, outages, breakers, shards."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed as X
from ..functions.skew import numbered, running_sum, top_k, value_at_rank


def resets() -> Column:
    """A good night or a declared state starts the count again."""
    return F.col("status").isin(["ok", *X.NOT_ATTEMPTED])


def fail_streak(log: DataFrame) -> DataFrame:
    """Nights failed in a row up to the last one, per brand.

    The last reset is an aggregate; the nights after it are counted.
    """
    at = F.struct("night", "ord")
    last = log.groupBy("slug").agg(F.max(F.when(resets(), at)).alias("__reset"),
                                   F.max(at).alias("__end"))
    side = last.select(F.col("slug").alias("__s"), "__reset")
    after = log.join(side, F.col("slug") == F.col("__s")).where(
        F.col("__reset").isNull() | (at > F.col("__reset")))
    n = after.groupBy("slug").agg(F.count(F.lit(1)).alias("n"))
    return last.join(n, "slug", "left").select(
        "slug", F.coalesce("n", F.lit(0).cast("bigint")).alias("fail_streak"),
        F.col("__end.night").alias("night"))


def running_streak(log: DataFrame) -> DataFrame:
    """The streak as it stood on every night."""
    order = [F.col("night"), F.col("ord")]
    bucket = F.date_trunc("month", "night")
    df = running_sum(log, ["slug"], order, bucket, resets().cast("int"), "__series")
    df = numbered(df, ["slug", "__series"], order, bucket, "__n")
    # the opening series has no reset row in it
    return df.withColumn("fail_streak", F.col("__n") - F.when(F.col("__series") > 0, 1)
                         .otherwise(0)).drop("__series", "__n")


def _recent(history: DataFrame, window: int) -> DataFrame:
    """The last ``window + 1`` nights of each brand, newest first."""
    live = top_k(history, ["slug"], [F.desc("night"), F.desc("ord")], window + 1)
    return live


def _windows(history: DataFrame, window: int, min_obs: int) -> DataFrame:
    rows = _recent(history, window)
    first, prior = F.col("rn") == 1, (F.col("rn") > 1) & F.col("product_count").isNotNull()
    lead = F.min(F.when(F.coalesce("product_count", F.lit(0)) != 0, F.col("rn")))
    out = rows.groupBy("slug").agg(
        F.count(F.lit(1)).alias("nights"), F.max(F.when(first, F.col("product_count"))).alias(
            "latest"), F.max(F.when(first, F.coalesce("platform", F.lit("")))).alias("platform"),
        F.count_if(prior).alias("priors"),
        # at most ``window`` values per brand reach this aggregate
        F.expr("percentile(CASE WHEN rn > 1 THEN product_count END, 0.5)").alias("baseline"),
        lead.alias("__lead"))
    return out.where(~F.col("platform").isin(X.HISTORY_DORMANT) & (F.col("nights") >= min_obs)
                     & F.col("latest").isNotNull() & (F.col("priors") >= min_obs - 1))


def erosion(history: DataFrame, window: int = 21, min_obs: int = 5,
            threshold: float = 0.20) -> DataFrame:
    """Brands whose latest count sits below the median of their own recent nights."""
    df = _windows(history, window, min_obs).where(F.col("baseline") > 0)
    drop = (F.col("baseline") - F.col("latest")) / F.col("baseline")
    return df.withColumn("drop", drop).where(F.col("drop") > threshold).select(
        "slug", "baseline", "latest", "drop", "priors").orderBy(F.desc("drop"), "slug")


def dark(history: DataFrame, window: int = 21, min_obs: int = 5) -> DataFrame:
    """Brands that give nothing and whose own baseline is nothing: nights dark."""
    df = _windows(history, window, min_obs).where(
        (F.col("baseline") <= 0) & (F.col("latest") <= 0))
    nights = F.coalesce(F.col("__lead") - 1, F.col("nights").cast("int"))
    return df.select("slug", nights.cast("bigint").alias("nights_dark"),
                     F.col("__lead").isNull().alias("capped")).orderBy(
        F.desc("nights_dark"), "slug")


def first_run(attempts: DataFrame, bad: Column, n: int, keys: list[str],
              bucket: Column | None = None, distinct: str | None = None) -> DataFrame:
    """Where each key first shows ``n`` bad outcomes in a row (or ``n`` distinct stores).

    Islands are numbered with a bucketed running count, so a long log is not
    ordered in one task.
    """
    order = [F.col("ts"), F.col("ord")]
    bucket = F.date_trunc("hour", "ts") if bucket is None else bucket
    df = attempts.withColumn("__bad", F.coalesce(bad, F.lit(False)))
    df = running_sum(df, keys, order, bucket, (~F.col("__bad")).cast("int"), "__island")
    df = df.where("__bad")
    if distinct is None:
        df = numbered(df, [*keys, "__island"], order, bucket, "__nth")
        hit = df.where(F.col("__nth") == n)
    else:
        firsts = df.groupBy(*keys, "__island", distinct).agg(
            F.min(F.struct("ts", "ord")).alias("__at"))
        firsts = firsts.withColumns({"ts": F.col("__at.ts"), "ord": F.col("__at.ord")})
        firsts = numbered(firsts, [*keys, "__island"], order, F.date_trunc("hour", "ts"), "__nth")
        hit = firsts.where(F.col("__nth") == n)
    agg = [F.min(F.struct("ts", "ord")).alias("__first")]
    out = hit.groupBy(*keys).agg(*agg) if keys else hit.agg(*agg)
    return out.where(F.col("__first").isNotNull()).select(
        *keys, F.col("__first.ts").alias("tripped_at"), F.col("__first.ord").alias("tripped_ord"))


def stride_shard(rows: DataFrame, index: int, count: int, order: list[Column],
                 bucket: Column) -> DataFrame:
    """Every ``count``-th row from ``index`` on, in list order."""
    if count < 1 or not 0 <= index < count:
        raise ValueError(f"shard {index}/{count} is out of range")
    df = numbered(rows, [], order, bucket, "__at")
    return df.where((F.col("__at") - 1) % count == index).drop("__at")


def prune_list(held: DataFrame, owned: DataFrame, key: str = "slug") -> DataFrame:
    """Held catalogues that this shard does not own."""
    return held.join(owned.select(key), key, "left_anti")


def cost_by_brand(log: DataFrame) -> DataFrame:
    """Seconds and seconds per product, per brand, dearest first."""
    out = log.groupBy("slug").agg(
        F.sum(F.col("elapsed_s").cast("decimal(18,3)")).cast("double").alias("elapsed_s"),
        F.sum(F.col("product_count").cast("bigint")).alias("products"),
        F.count(F.lit(1)).alias("nights"), F.count_if(F.col("status") == "ok").alias("ok_nights"))
    return out.withColumn("s_per_product", F.when(
        F.col("products") > 0, F.col("elapsed_s") / F.col("products")))


def status_tally(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def stale(catalogues: DataFrame, now, max_age_hours: float) -> DataFrame:
    """Catalogues old enough to fetch again; one never fetched is always due."""
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(
        F.col("fetched_at").cast("timestamp"))) / 3600.0
    return catalogues.where(F.col("fetched_at").isNull() | (age >= max_age_hours))


def merge_logs(parts: DataFrame, prev: DataFrame) -> DataFrame:
    """Fold part logs (slug, status, part, …) into one; the last part wins, streaks carry on."""
    last = top_k(parts, ["slug"], [F.desc("part")], 1).drop("rn", "part")
    before = prev.select(F.col("slug").alias("__s"), F.col("fail_streak").alias("__f"))
    done = last.join(before, F.col("slug") == F.col("__s"), "left").withColumn(
        "fail_streak", F.when(resets(), F.lit(0).cast("bigint")).otherwise(
            F.coalesce("__f", F.lit(0)).cast("bigint") + 1)).drop("__s", "__f")
    kept = prev.join(last.select("slug"), "slug", "left_anti")
    return done.unionByName(kept.withColumn("fail_streak", F.col("fail_streak").cast("bigint")),
                            allowMissingColumns=True)


def build_history(versions: DataFrame) -> DataFrame:
    """Every version of the log as rows, one per (version, slug); notes are skipped."""
    rows = versions.where(F.col("slug").isNotNull() & ~F.startswith("slug", F.lit("_")))
    return top_k(rows, ["version", "slug"], [F.desc("ord")], 1).drop("rn")
