"""Change data capture on prices: keys, state, the change log, and what reads it.

The ledger only holds changes.  Rows carry ``ord`` so that "first" and "last"
are total orders; every first/last is an ordered aggregate that combines before
the shuffle, so one busy key does not become one long sort.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from ..functions.skew import numbered, top_k, value_at_rank

OBSERVED = ["price", "compare_at", "available"]


def truthy(col) -> Column:
    """Zero reads as not stated."""
    return F.nullif(F.col(col) if isinstance(col, str) else col, F.lit(0.0))


def _or(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


# --- identity ---------------------------------------------------------------

def ambiguous(variants: DataFrame) -> DataFrame:
    """(bag_id, sku) pairs that sit on more than one variant and so identify none."""
    return (variants.where(F.coalesce("sku", F.lit("")) != "").groupBy("bag_id", "sku")
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))


def variant_key(variants: DataFrame) -> DataFrame:
    """Add ``key``: the SKU when it names one variant, else position and label."""
    twice = ambiguous(variants).select(F.col("bag_id").alias("__b"), F.col("sku").alias("__s"))
    df = variants.join(twice, (F.col("bag_id") == F.col("__b")) & (F.col("sku") == F.col("__s")),
                       "left")
    label = _or(F.col("color"), F.col("title"), F.col("pos").cast("string"))
    good = (F.coalesce("sku", F.lit("")) != "") & F.col("__s").isNull()
    return df.withColumn("key", F.when(good, F.concat("bag_id", F.lit("::"), "sku")).otherwise(
        F.concat("bag_id", F.lit("::#"), F.col("pos").cast("string"), F.lit(":"), label))
    ).drop("__b", "__s")


def basis(currency: Column, market: Column) -> Column:
    return F.concat(_or(currency, F.lit("USD")), F.lit("@"), _or(market, F.lit("default")))


def adopt_split(current: DataFrame, state: DataFrame) -> DataFrame:
    """Attach the last state of each key, or of the same SKU under the pre-split id."""
    def side(prefix: str) -> DataFrame:
        return state.select(F.col("key").alias(prefix + "key"), F.struct(
            *[c for c in state.columns if c != "key"]).alias(prefix + "row"))

    old = F.when((F.coalesce("sku", F.lit("")) != "") & F.col("split_from").isNotNull(),
                 F.concat("split_from", F.lit("::"), "sku"))
    df = current.join(side("__p"), F.col("key") == F.col("__pkey"), "left")
    # rows with nothing to adopt get a key of their own that no state has, so that
    # they do not all meet on null
    df = df.withColumn("__old", F.coalesce(F.when(F.col("__pkey").isNull(), old),
                                           F.concat(F.lit("\x00"), "key")))
    df = df.join(side("__a"), F.col("__old") == F.col("__akey"), "left")
    return df.withColumn("prev", F.coalesce("__prow", "__arow")).withColumn(
        "adopted", F.col("__pkey").isNull() & F.col("__akey").isNotNull()).drop(
        "__pkey", "__prow", "__old", "__akey", "__arow")


# --- change detection -------------------------------------------------------

def rebase(df: DataFrame) -> DataFrame:
    """Flag keys whose currency or market changed; a state without a basis agrees."""
    moved = F.col("prev").isNotNull() & (F.coalesce("prev.basis", "basis") != F.col("basis"))
    return df.withColumn("rebased", moved).withColumn(
        "prev", F.when(~F.col("rebased"), F.col("prev")))


def direction(delta: Column) -> Column:
    """A stock change with the same price reads ``up``."""
    return F.when(delta < 0, "down").when(delta.isNotNull(), "up")


def diff_state(current: DataFrame, state: DataFrame, now) -> DataFrame:
    """Ledger rows of this run: first sightings, re-bases and changes of price or stock."""
    now = F.lit(now).cast("timestamp_ntz") if not isinstance(now, Column) else now
    df = rebase(adopt_split(current, state))
    same = F.lit(True)
    for c in OBSERVED:
        same = same & F.col(c).eqNullSafe(F.col("prev." + c))
    df = df.where(~(F.col("prev").isNotNull() & same))
    prev_price = F.col("prev.price")
    delta = F.round(truthy("price") - truthy(prev_price), 2)
    return (df.withColumn("ts", now).withColumn("prev_price", prev_price)
            .withColumn("delta", delta).withColumn("direction", direction(F.col("delta")))
            .withColumn("is_change", F.col("prev").isNotNull()))


def upsert_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    """New state: changed keys rewritten, the rest kept.

    First sighting and the running low survive a change; a re-base forgets both.
    """
    price = truthy("price")
    fresh = rows.select(
        "key", "price", "compare_at", "available", "basis",
        F.coalesce("prev.first_seen", "ts").alias("first_seen"),
        F.coalesce(F.least(price, truthy("prev.low")), "price").alias("low"),
        F.col("ts").alias("last_change"))
    both = state.select(*[F.col(c).alias("__o_" + c) for c in state.columns]).join(
        fresh, F.col("__o_key") == F.col("key"), "full_outer")
    return both.select(*[F.when(F.col("key").isNotNull(), F.col(c)).otherwise(
        F.col("__o_" + c)).alias(c) for c in state.columns])


def stamp_basis(state: DataFrame, current: DataFrame) -> DataFrame:
    """Fill the basis of kept rows that predate it."""
    side = current.select(F.col("key").alias("__k"), F.col("basis").alias("__b"))
    return state.join(side, F.col("key") == F.col("__k"), "left").withColumn(
        "basis", F.coalesce("basis", "__b")).select(*state.columns)


def forget(state: DataFrame, brands: list[str]) -> DataFrame:
    """State without the named brands: their next observation is a baseline."""
    return state.where(~F.substring_index("key", "__", 1).isin(list(brands)))


# --- reading the ledger -----------------------------------------------------

IDENT = ["bag_id", "sku", "color"]


def _at() -> Column:
    return F.struct("ts", "ord")


def net_ends(ledger: DataFrame, since) -> DataFrame:
    """Per (bag, sku, colour): the price carried into the window and the price now.

    A re-base starts the series again.
    """
    rows = ledger.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz")).withColumn("at", _at())
    marks = rows.groupBy(*IDENT).agg(
        F.max(F.when(F.col("rebased"), F.col("at"))).alias("reset"), F.min("at").alias("seen"))
    marks = marks.select(*[F.col(c).alias("__" + c) for c in IDENT], "reset", "seen")
    same = F.lit(True)
    for c in IDENT:
        same = same & F.col(c).eqNullSafe(F.col("__" + c))
    live = rows.join(marks, same).where(F.col("reset").isNull() | (F.col("at") >= F.col("reset")))
    ref, cur = truthy("prev_price"), truthy("price")
    return live.groupBy(*IDENT).agg(
        F.min("seen").alias("seen"),
        F.min_by(ref, F.when(ref.isNotNull(), F.col("at"))).alias("ref"),
        F.max_by(cur, F.when(cur.isNotNull(), F.col("at"))).alias("cur"))


def moves_since(ledger: DataFrame, since) -> DataFrame:
    """Net move per bag across the window: the deepest proportional one of its variants."""
    ends = net_ends(ledger, since).where(F.col("ref") != F.col("cur"))
    return ends.groupBy("bag_id").agg(F.min_by(
        F.struct("ref", "cur"), F.struct(F.col("cur") / F.col("ref"), F.col("seen"))).alias("m")
    ).select("bag_id", F.when(F.col("m.cur") < F.col("m.ref"), "down").otherwise("up")
             .alias("direction"), F.col("m.ref").alias("previous_price"),
             F.col("m.cur").alias("price"))


def annotate(bags: DataFrame, keyed: DataFrame, state: DataFrame, moves: DataFrame) -> DataFrame:
    """Lowest price ever, last change, net direction and whether it is at its lowest."""
    known = adopt_split(keyed, state).where(F.col("prev").isNotNull())
    seen = known.groupBy("bag_id").agg(
        F.round(F.min(truthy("prev.price")), 2).alias("__now"),
        F.round(F.min(truthy("prev.low")), 2).alias("lowest_ever"),
        F.max("prev.last_change").alias("price_changed_at"))
    move = moves.select(F.col("bag_id").alias("__mb"), F.col("direction").alias("price_direction"),
                        "previous_price")
    return (bags.join(seen, bags["id"] == seen["bag_id"], "left").drop("bag_id")
            .join(move, F.col("id") == F.col("__mb"), "left").drop("__mb")
            .withColumn("at_lowest", F.coalesce(F.col("__now") <= F.col("lowest_ever"),
                                                F.lit(False))).drop("__now"))


EVENT_CONTEXT = ["brand_slug", "slug", "split_from", "category", "currency", "url", "image",
                 "lowest_ever", "at_lowest"]


def run_events(rows: DataFrame, bags: DataFrame) -> DataFrame:
    """Price moves of this run with the context of their bag."""
    context = [c for c in EVENT_CONTEXT if c in bags.columns]
    side = bags.select(F.col("id").alias("__id"), *[F.col(c).alias("__" + c) for c in context])
    base = rows.where(F.col("direction").isNotNull()).drop(*context)
    return base.join(side, F.col("bag_id") == F.col("__id"), "left").select(
        *base.columns, *[(F.coalesce("__currency", F.lit("USD")) if c == "currency"
                          else F.col("__" + c)).alias(c) for c in context])


def tracking_meta(rows: DataFrame, state: DataFrame) -> DataFrame:
    ran = rows.agg(F.count(F.lit(1)).alias("appended"), F.count_if("is_change").alias("changes"),
                   F.count_if("rebased").alias("rebased"))
    held = state.agg(F.count(F.lit(1)).alias("tracked"))
    return (ran.unpivot([], ran.columns, "metric", "value")
            .unionByName(held.unpivot([], held.columns, "metric", "value")))


def history_rows(ledger: DataFrame, bags: DataFrame, variants: DataFrame) -> DataFrame:
    """A bag's own rows, plus its parent's rows for the SKUs it now holds."""
    own = ledger.withColumn("owner", F.col("bag_id"))
    held = variants.where(F.coalesce("sku", F.lit("")) != "").select(
        F.col("bag_id").alias("__b"), F.col("sku").alias("__s")).distinct()
    kids = bags.where(F.col("split_from").isNotNull()).select(
        F.col("id").alias("__id"), F.col("split_from").alias("__parent"))
    claim = kids.join(held, F.col("__id") == F.col("__b")).select("__id", "__parent", "__s")
    inherited = ledger.join(claim, (F.col("bag_id") == F.col("__parent"))
                            & (F.col("sku") == F.col("__s")))
    return own.unionByName(inherited.withColumn("owner", F.col("__id")).select(*own.columns))


def price_series(rows: DataFrame, bag: str = "bag_id") -> DataFrame:
    """Lowest price per bag and day of change."""
    return (rows.where(F.col("price").isNotNull())
            .groupBy(F.col(bag).alias("bag_id"), F.to_date("ts").alias("day"))
            .agg(F.min("price").alias("price")))


def price_changes(rows: DataFrame, bag: str = "bag_id", k: int | None = None) -> DataFrame:
    """Every move with its place ``rn`` from the newest of its bag; with ``k``, the newest k."""
    moved = rows.where(F.col("direction").isNotNull()).withColumn("__bag", F.col(bag))
    order = [F.desc("ts"), F.asc("ord")]
    if k is not None:
        return top_k(moved, ["__bag"], order, k).drop("__bag")
    return numbered(moved, ["__bag"], order, -F.unix_date(F.to_date("ts")), "rn").drop("__bag")


def price_spans(series: DataFrame) -> DataFrame:
    """Validity of each price: it holds from its day up to the next change."""
    w = Window.partitionBy("bag_id").orderBy("day")   # one row per day and bag
    return series.select("bag_id", F.col("day").alias("valid_from"),
                         F.lead("day").over(w).alias("valid_to"), "price")


def price_as_of(series: DataFrame, asks: DataFrame) -> DataFrame:
    """Price that held on each asked (bag_id, day); null before the first change."""
    marks = series.select("bag_id", "day", "price", F.lit(False).alias("asked")).unionByName(
        asks.select("bag_id", "day").distinct().select(
            "bag_id", "day", F.lit(None).cast("double").alias("price"),
            F.lit(True).alias("asked")))
    w = Window.partitionBy("bag_id").orderBy("day", "asked").rowsBetween(
        Window.unboundedPreceding, 0)
    return (marks.withColumn("price", F.last("price", ignorenulls=True).over(w))
            .where("asked").select("bag_id", "day", "price"))


def history_summary(series: DataFrame) -> DataFrame:
    return series.groupBy("bag_id").agg(
        F.min("price").alias("lowest"), F.max("price").alias("highest"),
        F.count(F.lit(1)).alias("changes"), F.min("day").alias("since"))


def tracking_since(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.min("ts").alias("since"))


def deepest_cut(variants: DataFrame) -> DataFrame:
    """Deepest discount per bag with both price ends; the first variant wins a tie."""
    off = S.discount(F.col("price"), F.col("compare_at"))
    cut = variants.withColumn("off", off).where(F.col("off").isNotNull())
    return cut.groupBy("bag_id").agg(F.max_by(
        F.struct("off", "price", F.col("compare_at").alias("was")),
        F.struct("off", -F.col("pos"))).alias("c")).select("bag_id", "c.*")


def sale_strip(bags: DataFrame, k: int | None = None, least: float = 0.05) -> DataFrame:
    """Models whose price fell lately by 5 % or more; with ``k``, the deepest k."""
    off = F.lit(1.0) - F.col("price_min") / F.col("previous_price")
    fell = ((F.col("price_direction") == "down") & (F.col("price_min") > 0)
            & (F.col("previous_price") > F.col("price_min")))
    rows = bags.where(fell).withColumn("off", off).where(F.col("off") >= least)
    return rows if k is None else rows.orderBy(F.desc("off"), "price_min", "id").limit(k)


def sale_stats(bags: DataFrame, cuts: DataFrame) -> DataFrame:
    """Deepest and rank-median discount in whole percent, counts of models and brands."""
    on = bags.where(F.coalesce("on_sale", F.lit(False)))
    offs = on.join(cuts, on["id"] == cuts["bag_id"]).select("off")
    percent = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("int")
    ranks = value_at_rank(offs, [], F.col("off"), {
        "deepest": F.col("n"), "median": F.col("n") - F.floor(F.col("n") / 2)}, 0.001)
    totals = on.agg(F.count(F.lit(1)).alias("models"),
                    F.countDistinct("brand_slug").alias("brands"))
    picked = ranks.select(percent("deepest").alias("deepest_pct"),
                          percent("median").alias("median_pct"))
    both = totals.unionByName(picked, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
