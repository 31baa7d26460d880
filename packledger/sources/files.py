"""Readers and writers of the catalogue's files and tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed as X, scalars as S
from ..functions.rules import matches
from ..functions.skew import first_per_key, top_k
from ..schemas import LEDGER, STATE, conform

RAW = ("slug string, name string, domain string, platform string, status string, locale string, "
       "country string, fetched_at string, products array<string>, _bad string")


# --- raw catalogues, roster, hints, rulings ---------------------------------

def read_raw(spark: SparkSession, path: str, lines: bool = False):
    """(products, unreadable): one document per file, or per line; a torn one is recorded.

    Products stay JSON text under their platform, in feed order (file, position).
    """
    docs = (spark.read.schema(RAW).option("multiLine", not lines).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_bad").json(path)
            .withColumn("file", F.input_file_name()))
    # the reader wants a second column next to the corrupt one
    torn = F.col("_bad").isNotNull() & F.coalesce(F.length("slug") >= 0, F.lit(True))
    unreadable = docs.where(torn).select(F.regexp_extract("file", r"([^/]+)$", 1).alias("file"))
    good = docs.where(F.col("_bad").isNull() & F.col("slug").isNotNull())
    products = good.select(
        "slug", "name", "domain", F.coalesce("platform", F.lit("shopify")).alias("platform"),
        "locale", "country", F.col("fetched_at").try_cast("timestamp").alias("fetched_at"), "file",
        F.posexplode("products").alias("pos", "product"))
    return products, unreadable


ROSTER = ("slug string, name string, domain string, platform string, locale string, "
          "country string, currency string, note string, crawl struct<sitemap:string,"
          "product:string,shelf:string,delay:double,shelf_scoped:boolean>")


def read_roster(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(ROSTER).option("multiLine", not lines).json(path)


HINTS = ("slug string, products map<string, struct<category:string,bag_votes:int,"
         "accessory_votes:int,in:array<string>,is_bag:boolean>>")


def read_hints(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(slug, product_id, hint_category, hint_is_bag); files without hints are tolerated."""
    docs = spark.read.schema(HINTS).option("multiLine", not lines).option(
        "mode", "DROPMALFORMED").json(path)
    return docs.select("slug", F.explode("products").alias("product_id", "h")).select(
        "slug", "product_id", F.col("h.category").alias("hint_category"),
        F.col("h.is_bag").alias("hint_is_bag"))


def read_rulings(spark: SparkSession, path: str, valid: list[str]) -> DataFrame:
    """(brand, key, value) of reviewed rulings; notes are skipped, an unknown value fails the run."""
    text = spark.read.text(path, wholetext=True)
    brands = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("brand", "e"))
    rows = (brands.where(~F.startswith("brand", F.lit("_")))
            .select("brand", F.explode(F.from_json("e", "map<string,string>")).alias("key", "value")))
    known = F.col("value").isNull() | F.col("value").isin(list(valid))
    complaint = F.concat(F.lit("unknown ruling: "), "brand", F.lit("/"), "key", F.lit(" -> "), "value")
    return rows.select("brand", S.norm_key(F.col("key")).alias("key"), F.when(
        known, F.col("value")).otherwise(F.raise_error(complaint).cast("string")).alias("value"))


# --- ledger, state, cache ---------------------------------------------------

def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Change log as JSON lines; a torn last line is dropped."""
    return spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path)


def append_ledger(rows: DataFrame, path: str, run: str) -> None:
    """This run's rows, one folder per run and month; a repeated run replaces its own rows."""
    cols = [c.split()[0] for c in LEDGER.split(", ")]
    have = [c for c in cols if c in rows.columns]
    rows.select(*have, "ord", F.trunc("ts", "month").alias("dt")).write.mode("overwrite").partitionBy(
        "dt").parquet(f"{path}/run={run}")


def save_state(state: DataFrame, path: str, run: str) -> None:
    """One immutable snapshot per run; keys in order inside each file."""
    conform(state, STATE).repartition("key").sortWithinPartitions("key").write.mode(
        "overwrite").parquet(f"{path}/run={run}")


def finished_runs(spark: SparkSession, path: str, within: str = "") -> list[str]:
    """Runs below a folder whose write was committed, in order; a lost run's folder is passed over."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(n[4:] for n in names if n.startswith("run=") and fs.exists(
        jvm.org.apache.hadoop.fs.Path(f"{path}/{n}{within}/_SUCCESS")))


def load_state(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """The named snapshot, or the latest one that was committed; empty before the first run."""
    schema = ", ".join(f"{c} {t}" for c, t in STATE.items())
    if run is None:
        runs = finished_runs(spark, path)
        if not runs:
            return spark.createDataFrame([], schema)
        run = runs[-1]
    return spark.read.schema(schema).parquet(f"{path}/run={run}")


def write_cache(cache: DataFrame, path: str) -> None:
    cache.write.mode("overwrite").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# --- dimensions -------------------------------------------------------------

AIRLINES = ("airlines array<struct<iata:string,name:string,region:string,carry_on_cm:array<int>,"
            "carry_on_linear_cm:int,personal_cm:array<int>,weight_kg:double,source:string,"
            "checked:string>>")


def read_airlines(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(AIRLINES).option("multiLine", True).json(path)
    return doc.select(F.explode("airlines").alias("a")).select("a.*")


#: Dated groups of rates, at the top or inside one more element; attributes in any order and quotes.
_RATE = "_currency:string,_rate:string"
_RATES = f"Cube array<struct<_time:string,Cube:array<struct<_time:string,{_RATE},Cube:array<struct<{_RATE}>>>>>>"


def read_fx(spark: SparkSession, path: str):
    """(rates, missing): reference rates per euro as units per dollar, and needed codes absent.

    A document that is not well-formed gives no rates.
    """
    text = spark.read.text(path, wholetext=True)
    day = lambda x: F.struct(x["_time"].alias("_time"), F.transform(x["Cube"], lambda c: F.struct(
        c["_currency"].alias("_currency"), c["_rate"].alias("_rate"))).alias("Cube"))
    dated = lambda xs: F.transform(F.filter(xs, lambda x: x["_time"].isNotNull()), day)
    none = F.array().cast(f"array<struct<_time:string,Cube:array<struct<{_RATE}>>>>")
    top = F.col("top")
    found = F.concat(F.coalesce(dated(top), none), F.coalesce(F.flatten(F.transform(
        top, lambda x: F.coalesce(dated(x["Cube"]), none))), none))
    days = text.select(F.from_xml("value", _RATES, {"mode": "PERMISSIVE"})["Cube"].alias("top")).select(
        F.explode(found).alias("day"))
    cells = F.transform(F.filter("day.Cube", lambda c: c["_currency"].rlike("^[A-Z]{3}$")), lambda c: F.struct(
        c["_currency"].alias("currency"), c["_rate"].try_cast("double").alias("per_eur")))
    euro = F.struct(F.lit("EUR").alias("currency"), F.lit(1.0).alias("per_eur"))
    stated = days.select(
        F.col("day._time").try_cast("date").alias("date"),
        F.array_append(cells, euro).alias("cells")).withColumn("__u", F.get(F.filter(
            "cells", lambda c: c["currency"] == "USD"), F.lit(0))["per_eur"])
    rates = (stated.where(F.col("date").isNotNull() & F.col("__u").isNotNull())
             .select("date", "__u", F.explode("cells").alias("c"))
             .where(F.col("c.per_eur").isNotNull())
             .select("date", "c.currency", F.round(F.col("c.per_eur") / F.col("__u"), 6)
                     .alias("per_usd")))
    needed = spark.createDataFrame([(c,) for c in X.FX_NEEDED], "currency string")
    return rates, needed.join(rates.select("currency"), "currency", "left_anti")


# --- sheets, sinks ----------------------------------------------------------

def read_worklist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option(
        "multiLine", True).csv(path)


def write_worklist(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option(
        "escape", '"').csv(path)


def write_catalogue(bags: DataFrame, variants: DataFrame, meta: DataFrame, path: str, run: str) -> None:
    """A version of its own per run; it counts from the moment its last table is committed."""
    for name, rows in (("bags", bags), ("variants", variants), ("meta", meta)):
        rows.write.mode("overwrite").parquet(f"{path}/run={run}/{name}")


def read_catalogue(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table of the latest whole version, none before the first."""
    runs = finished_runs(spark, path, "/meta")
    return spark.read.parquet(f"{path}/run={runs[-1]}/{name}") if runs else None


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Quarantine, in order of reason, brand and title."""
    rejects.orderBy("reason", "brand_slug", F.coalesce("title", F.lit(""))).write.mode(
        "overwrite").parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").parquet(path)


def baseline(spark: SparkSession, path: str, require: bool = False) -> DataFrame | None:
    """The published catalogue to compare against; absent is an error only when required."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        if require:
            raise FileNotFoundError(f"no published catalogue at {path}") from None
        return None


# --- pages, images, relations -----------------------------------------------

def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages (gzip is opened by the reader), keyed by file name."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)\.html(?:\.gz)?$", 1).alias("page_key"),
        F.col("value").alias("html"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("url"), "length", "content")


def read_table(spark: SparkSession, url: str, name: str, key: str, bounds: list[int],
               **options) -> DataFrame:
    """A relational table over JDBC, split on key ranges so that it is read in parallel."""
    cuts = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(bounds, bounds[1:])]
    cuts += [f"{key} < {bounds[0]} OR {key} IS NULL", f"{key} >= {bounds[-1]}"]
    return spark.read.jdbc(url, name, predicates=cuts, properties=options)


def append_table(rows: DataFrame, url: str, name: str, **options) -> None:
    rows.write.jdbc(url, name, mode="append", properties=options)


# --- discovery --------------------------------------------------------------

def sitemap_urls(bodies: DataFrame, patterns: dict[str, str]):
    """(urls, children, refusals) of fetched sitemap bodies (url, status, body).

    A listed address goes to the first pattern it matches; child sitemaps are
    set apart; refused requests are counted by status.
    """
    locs = F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    listed = bodies.where(F.col("status") == 200).select(F.explode(locs).alias("loc"))
    child = matches(F.col("loc"), r"\.xml(?:\.gz)?(?:$|[?#])")
    route = F.coalesce(*[F.when(F.col("loc").rlike(p), n) for n, p in patterns.items()])
    urls = (listed.where(~child).withColumn("route", route).where(F.col("route").isNotNull())
            .select("route", F.col("loc").alias("url")).distinct())
    refused = bodies.where(F.col("status") != 200).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"))
    return urls, listed.where(child).select(F.col("loc").alias("url")).distinct(), refused


def lookup(bags: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """Bags by id in the order asked (a list, or a table of id and place); unknown ids are left out."""
    if isinstance(ids, list):
        ids = bags.sparkSession.createDataFrame(list(zip(ids, range(len(ids)))), "id string, place int")
    return bags.join(ids.select("id", "place"), "id").select(*bags.columns, "place").orderBy("place")


def dedupe_feed(items: DataFrame) -> DataFrame:
    """One row per SKU across overlapping shelves: the widest shelf that lists it."""
    size = items.groupBy("shelf").agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed(
        "shelf", "__s")
    ranked = items.where(F.coalesce("sku", F.lit("")) != "").join(
        size, F.col("shelf") == F.col("__s")).drop("__s")
    return first_per_key(ranked, ["sku"], [F.desc("__n"), F.col("shelf"), F.col("ord")]).drop("__n")


def frontier(candidates: DataFrame, seen: DataFrame, n: int | None = None) -> DataFrame:
    """Candidate addresses not held yet, in order, at most ``n``."""
    fresh = candidates.join(seen.select("url"), "url", "left_anti").orderBy("ord")
    return fresh if n is None else fresh.limit(n)
