"""Faceted browse over the catalogue.

A filter is a plain record that turns into Column predicates.  Facet counts are
one pass: each row carries the list of groups it fails, and a row counts for all
groups when it fails none, or for the one lifted group it fails.
"""
from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed as X, scalars as S
from . import carryon as K
from .prices import deepest_cut

GROUPS = ["categories", "brands", "features", "materials", "colors", "airlines", "laptop"]
LIFTED = ["categories", "brands", "materials", "colors", "laptop"]
RANGES = {"volMin": ("volume_l", ">="), "volMax": ("volume_l", "<="),
          "priceMin": ("price_cmp", ">="), "priceMax": ("price_cmp", "<="),
          "weightMin": ("weight_g", ">="), "weightMax": ("weight_g", "<="),
          "linearMax": ("linear_cm", "<="), "laptopMin": (None, None)}
PER_DEFAULT = 60


@dataclass(frozen=True)
class Filter:
    """One browse question.  ``scope`` is ('brand'|'airline', value), ('sale', '') or None."""
    terms: tuple = ()
    scope: tuple | None = None
    cat: tuple = ()
    brand: tuple = ()
    feat: tuple = ()
    mat: tuple = ()
    color: tuple = ()
    airline: tuple = ()
    volMin: float | None = None
    volMax: float | None = None
    priceMin: float | None = None
    priceMax: float | None = None
    weightMin: float | None = None
    weightMax: float | None = None
    linearMax: float | None = None
    laptopMin: float | None = None
    carryon: bool = False
    underseat: bool = False
    stock: bool = False
    sale: bool = False
    fav: tuple = ()
    favonly: bool = False
    sort: str = "brand"
    page: int = 0
    per: int = PER_DEFAULT

    @property
    def filtered(self) -> bool:
        plain = Filter(scope=self.scope, sort=self.sort, page=self.page, per=self.per,
                       fav=self.fav)
        return self != plain


LISTS = ("cat", "brand", "feat", "mat", "color", "airline")


def parse_filter(query: str) -> Filter:
    """Query string to filter; unreadable bounds are ignored, a bad page or scope is refused."""
    p = dict(parse_qsl(query.lstrip("?"), keep_blank_values=True))
    items = lambda k: tuple(x.strip() for x in p.get(k, "").split(",") if x.strip())
    presets = items("preset")
    f = Filter(terms=tuple(p.get("q", "").lower().split()), carryon="carryon" in presets,
               underseat="underseat" in presets, stock=p.get("stock") == "1",
               sale=p.get("sale") == "1", favonly=p.get("favonly") == "1",
               fav=items("fav"), sort=p.get("sort") or "brand",
               **{k: items(k) for k in LISTS})
    for k in RANGES:
        try:
            n = float(p.get(k) or 0) if k in p else None
        except ValueError:
            n = None
        if n is not None and n == n and abs(n) != float("inf"):
            f = replace(f, **{k: n})
    per = p.get("per", str(PER_DEFAULT))
    if not per.isdigit() or int(per) < 1:
        raise ValueError("per must be a whole number from 1 on")
    page = p.get("page", "0")
    f = replace(f, per=int(per), page=int(page) if page.isdigit() else 0)
    raw = p.get("scope")
    if raw:
        kind, _, value = raw.partition(":")
        if raw != "sale" and (kind not in ("brand", "airline") or not value):
            raise ValueError("scope must be brand:<slug>, airline:<slug> or sale")
        f = replace(f, scope=(kind, value))
    return f


def to_params(f: Filter) -> str:
    """The canonical query string of a filter; defaults are left out."""
    out = []
    if f.terms:
        out.append(("q", " ".join(f.terms)))
    out += [(k, ",".join(getattr(f, k))) for k in LISTS if getattr(f, k)]
    presets = [n for n in ("carryon", "underseat") if getattr(f, n)]
    if presets:
        out.append(("preset", ",".join(presets)))
    out += [(k, f"{getattr(f, k):g}") for k in RANGES if getattr(f, k) is not None]
    out += [(k, "1") for k in ("stock", "sale", "favonly") if getattr(f, k)]
    if f.sort != "brand":
        out.append(("sort", f.sort))
    if f.scope:
        out.append(("scope", f.scope[0] if f.scope[0] == "sale" else ":".join(f.scope)))
    return urlencode(out)


# --- projection -------------------------------------------------------------

def underseat() -> Column:
    d = F.sort_array("dims_cm", asc=False)
    side = lambda i, most: F.get(d, F.lit(i)) <= most
    a, b, c = X.UNDERSEAT_CM
    return F.coalesce((F.size("dims_cm") >= 3) & side(0, a) & side(1, b) & side(2, c),
                      F.lit(False))


def browse_rows(bags: DataFrame, airlines: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """What a browse question reads: haystack, comparison price, densities, presets, flags."""
    empty = F.array().cast("array<string>")
    arr = lambda c: F.coalesce(F.col(c), empty)
    df = K.carriers_fitting(bags, airlines)
    if cuts is not None:
        side = cuts.select(F.col("bag_id").alias("__b"), F.col("off").alias("__off"))
        df = df.join(side, F.col("id") == F.col("__b"), "left").withColumn(
            "discount", F.when(F.col("on_sale"), F.col("__off"))).drop("__b", "__off")
    else:
        df = df.withColumn("discount", F.lit(None).cast("double"))
    n = K.carriers(airlines).agg(F.count_if(K.publishes(F.col))).scalar()
    hay = F.lower(F.concat_ws(" ", "brand", "name", "category", arr("materials"),
                              arr("features"), arr("colors"), arr("tags")))
    fits_all = (F.size("airlines") == n) & (n > 0)
    return df.withColumns({
        "hay": hay, "price_cmp": F.coalesce("price_usd_approx", "price_min"),
        "features": F.when(fits_all, F.array_union(arr("features"), F.array(
            F.lit(X.FIT_FEATURE)))).otherwise(arr("features")),
        "materials": arr("materials"), "colour_set": arr("color_families"),
        "carryon": F.coalesce((F.col("linear_cm") != 0) & (
            F.col("linear_cm") <= X.COMMON_CARRYON_CM), F.lit(False)),
        "underseat": underseat(),
        "no_dims": ~F.coalesce(F.size("dims_cm") >= 3, F.lit(False)),
        "features_unknown": ~F.coalesce(F.col("features_source") == "product-page", F.lit(False)),
        "no_colour": F.size(arr("color_families")) == 0,
        "gpl": S.grams_per_litre(F.col("weight_g"), F.col("volume_l")),
        "ppl": S.price_per_litre(F.coalesce("price_usd_approx", "price_min"), F.col("volume_l")),
    })


# --- predicates -------------------------------------------------------------

def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def search(terms) -> Column:
    """Every term is a substring of the haystack."""
    out = F.lit(True)
    for t in terms:
        out = out & F.contains("hay", F.lit(t))
    return out


def any_of(col: str, wanted) -> Column:
    return F.lit(True) if not wanted else _yes(F.col(col).isin(list(wanted)))


def any_in(col: str, wanted) -> Column:
    return F.lit(True) if not wanted else _yes(
        F.arrays_overlap(F.col(col), F.array(*[F.lit(w) for w in wanted])))


def every_of(col: str, wanted) -> Column:
    return F.lit(True) if not wanted else _yes(F.size(F.array_except(
        F.array(*[F.lit(w) for w in wanted]), F.col(col))) == 0)


def ranges(f: Filter) -> Column:
    """Bounds; an unknown figure is outside every bound."""
    out = F.lit(True)
    for k, (col, op) in RANGES.items():
        bound = getattr(f, k)
        if col and bound is not None:
            out = out & _yes(F.col(col) >= bound if op == ">=" else F.col(col) <= bound)
    return out


def laptop_min(bound) -> Column:
    return F.lit(True) if bound is None else _yes(F.col("laptop_in") >= bound)


def presets(f: Filter) -> Column:
    out = F.lit(True)
    for on, col in ((f.carryon, "carryon"), (f.underseat, "underseat"), (f.stock, "in_stock"),
                    (f.sale, "on_sale")):
        if on:
            out = out & _yes(F.col(col))
    return out


def scope(rows: DataFrame, f: Filter, airlines: DataFrame | None = None) -> DataFrame:
    """Rows of the scope.  A scope value nothing carries is refused."""
    if f.scope is None:
        return rows
    kind, value = f.scope
    if kind == "sale":
        return rows.where(_yes(F.col("on_sale")))
    if kind == "brand":
        known = rows.where(F.col("brand_slug") == value)
        if known.isEmpty():
            raise ValueError(f"unknown brand scope {value!r}")
        return known
    if airlines is not None and airlines.where(
            S.slugify(F.col("name")) == value).isEmpty():
        raise ValueError(f"unknown airline scope {value!r}")
    return rows.where(F.array_contains("airlines", value))


def fixed_predicate(f: Filter) -> Column:
    out = search(f.terms) & ranges(f) & presets(f)
    return out & F.col("id").isin(list(f.fav)) if f.favonly else out


def group_tests(f: Filter) -> dict[str, Column]:
    return {"categories": any_of("category", f.cat), "brands": any_of("brand_slug", f.brand),
            "features": every_of("features", f.feat), "materials": any_in("materials", f.mat),
            "colors": any_in("colour_set", f.color), "airlines": every_of("airlines", f.airline),
            "laptop": laptop_min(f.laptopMin)}


def marked(rows: DataFrame, f: Filter) -> DataFrame:
    """Rows with ``fixed`` and the ``failed`` groups — all the later answers read these."""
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(g))
                                       for g, ok in group_tests(f).items()]))
    return rows.withColumn("fixed", fixed_predicate(f)).withColumn("failed", failed).withColumn(
        "hit", F.col("fixed") & (F.size("failed") == 0))


# --- order and page ---------------------------------------------------------

def sort(key: str) -> list[Column]:
    """Sort keys; unknown figures last whichever way the order runs."""
    up = lambda c: [F.col(c).asc_nulls_last()]
    down = lambda c: [F.col(c).desc_nulls_last()]
    labels = S.label_order(F.col("brand")) + S.label_order(F.col("name"))
    table = {"brand": labels, "price-asc": up("price_cmp"), "price-desc": down("price_cmp"),
             "vol-asc": up("volume_l"), "vol-desc": down("volume_l"),
             "weight-asc": up("weight_g"), "weight-desc": down("weight_g"), "gpl": up("gpl"),
             "gpl-desc": down("gpl"), "ppl": up("ppl"), "ppl-desc": down("ppl"),
             "discount": down("discount") + labels, "discount-asc": up("discount") + labels}
    return table.get(key, labels) + [F.col("ord").asc()]


def page(rows: DataFrame, f: Filter):
    """(page rows, pinned favourites); pinned ones do not take part in paging."""
    hits = rows.where("hit")
    order = sort(f.sort)
    if not f.fav:
        return hits.orderBy(*order).offset(f.page * f.per).limit(f.per), None
    pinned = F.col("id").isin(list(f.fav))
    favs = hits.where(pinned).orderBy(*order) if f.page == 0 else None
    return hits.where(~pinned).orderBy(*order).offset(f.page * f.per).limit(f.per), favs


CARD = ["id", "slug", "name", "brand", "brand_slug", "category", "currency", "in_stock",
        "on_sale", "price_min", "price_max", "price_usd_approx", "volume_l", "volume_source",
        "dims_cm", "dims_source", "linear_cm", "weight_g", "weight_source", "laptop_in",
        "features", "features_source", "materials", "colors", "color_families",
        "variant_count", "image", "url", "discount"]
CARD_VARIANT = ["sku", "title", "color", "color_family", "price", "compare_at", "available",
                "image"]


def project(cards: DataFrame, variants: DataFrame) -> DataFrame:
    """Card columns, one row per variant (``v_`` columns), a bag without variants once."""
    side = variants.select(F.col("bag_id").alias("__b"), F.col("pos").alias("v_pos"),
                           *[F.col(c).alias("v_" + c) for c in CARD_VARIANT])
    have = [c for c in CARD if c in cards.columns]
    return cards.select(*have).join(side, F.col("id") == F.col("__b"), "left").drop("__b")


# --- counts -----------------------------------------------------------------

def _values(rows: DataFrame) -> dict[str, Column]:
    one = lambda c: F.array_compact(F.array(F.col(c)))
    steps = F.array(*[F.lit(n) for n in X.LAPTOP_STEPS])
    return {"categories": one("category"), "brands": one("brand_slug"),
            "features": F.col("features"), "materials": F.col("materials"),
            "colors": F.col("colour_set"), "airlines": F.col("airlines"),
            "laptop": F.coalesce(F.transform(F.filter(
                steps, lambda n: F.col("laptop_in") >= n), lambda n: n.cast("string")),
                F.array().cast("array<string>"))}


def _tagged(values: Column, group: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(group).alias("group"), v.alias("value")))


def _pairs(rows: DataFrame, keep=None) -> Column:
    parts = []
    for g, values in _values(rows).items():
        pairs = _tagged(values, g)
        parts.append(pairs if keep is None else F.when(keep(g), pairs).otherwise(
            F.slice(pairs, 1, 0)))
    return F.concat(*parts)


def facet_counts(rows: DataFrame) -> DataFrame:
    """Live count per (group, value) of marked rows, in one pass and one aggregation."""
    n, first = F.size("failed"), F.get("failed", F.lit(0))
    counted = rows.where(F.col("fixed") & ((n == 0) | ((n == 1) & first.isin(LIFTED))))
    pairs = _pairs(rows, lambda g: (n == 0) | (first == g))
    return (counted.select(F.explode(pairs).alias("p")).select("p.group", "p.value")
            .groupBy("group", "value").agg(F.count(F.lit(1)).alias("n")))


def facet_shape(scoped: DataFrame) -> DataFrame:
    """Every option of the scope with its place: by count, by name, or by size step."""
    counts = (scoped.select(F.explode(_pairs(scoped)).alias("p")).select("p.group", "p.value")
              .groupBy("group", "value").agg(F.count(F.lit(1)).alias("total")))
    names = scoped.groupBy("brand_slug").agg(F.min_by("brand", "ord").alias("label"))
    counts = counts.join(names, (F.col("group") == "brands")
                         & (F.col("value") == F.col("brand_slug")), "left").drop("brand_slug")
    label = F.coalesce("label", "value")
    named = F.col("group").isin("brands", "airlines")
    # one row per option of a vocabulary: ranking these is small work
    w = Window.partitionBy("group").orderBy(
        F.when(F.col("group") == "laptop", F.col("value").try_cast("int")),
        F.when(named, label.rlike("^[0-9]")), F.when(named, F.lower(label)),
        F.desc("total"), "value")
    return counts.withColumn("place", F.row_number().over(w)).select(
        "group", "value", label.alias("label"), "place", "total")


def facets(scoped: DataFrame, rows: DataFrame) -> DataFrame:
    """Options of the scope with live counts; zeros stay on the list."""
    live = facet_counts(rows).withColumnRenamed("n", "__n")
    return facet_shape(scoped).join(live, ["group", "value"], "left").select(
        "group", "value", "label", "place", F.coalesce("__n", F.lit(0).cast("bigint")).alias("n"))


def totals(rows: DataFrame) -> DataFrame:
    hit = rows.where("hit")
    return hit.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("brand_slug").alias("brands"),
                   F.coalesce(F.sum(F.col("variant_count").cast("bigint")), F.lit(0)).alias("skus"))


def caveats(rows: DataFrame, f: Filter) -> DataFrame:
    """Non-matches that might have matched had we known more, per kind of filter in use."""
    stated = [x for x in f.feat if x != X.FIT_FEATURE]
    out = rows.where(~F.col("hit"))
    count = lambda on, c: F.count_if(F.col(c)) if on else F.lit(0).cast("bigint")
    return out.agg(count(stated or f.mat, "features_unknown").alias("no_feature"),
                   count(f.color, "no_colour").alias("no_colour"),
                   count(f.airline or len(stated) != len(f.feat), "no_dims").alias("no_dims"))


def scope_stats(scoped: DataFrame) -> DataFrame:
    """Slider bounds, coverage and size of a scope."""
    top = lambda c: F.coalesce(F.greatest(F.max(F.col(c).cast("double")), F.lit(0.0)), F.lit(0.0))
    return scoped.agg(
        top("volume_l").alias("max_volume"), top("price_cmp").alias("max_price"),
        top("weight_g").alias("max_weight"), F.count(F.lit(1)).alias("bags"),
        F.countDistinct("brand_slug").alias("brands"),
        F.coalesce(F.sum(F.col("variant_count").cast("bigint")), F.lit(0)).alias("skus"),
        *[F.count(c).alias("have_" + c) for c in X.COVERAGE_FIELDS])


# --- comparison sheet -------------------------------------------------------

COMPARED = {"price": ("price_cmp", "min"), "volume": ("volume_l", "max"),
            "weight": ("weight_g", "min"), "linear": ("linear_cm", "min"),
            "gpl": ("gpl", "min"), "ppl": ("ppl", "min")}
SHOWN = ["brand", "category", "laptop_in", "variant_count", "in_stock"]


def compare(rows: DataFrame, ids: list[str]) -> DataFrame:
    """(metric, id, value, differs, best) for the chosen bags, in the chosen order."""
    place = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("id"))
    chosen = rows.where(F.col("id").isin(list(ids))).withColumn("at", place)
    cells = [F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("number"),
                      F.col(c).cast("string").alias("text"), F.lit(best).alias("best"))
             for m, (c, best) in COMPARED.items()]
    cells += [F.struct(F.lit(c).alias("metric"), F.lit(None).cast("double").alias("number"),
                       F.col(c).cast("string").alias("text"), F.lit(None).cast("string")
                       .alias("best")) for c in SHOWN]
    long = chosen.select("id", "at", F.explode(F.array(*cells)).alias("c")).select("id", "at", "c.*")
    per = long.groupBy("metric").agg(
        F.count_distinct(F.coalesce("text", F.lit("—"))).alias("__d"),
        F.count("number").alias("__n"), F.min("number").alias("__lo"), F.max("number").alias("__hi"))
    target = F.when(F.col("best") == "min", F.col("__lo")).otherwise(F.col("__hi"))
    wins = F.col("best").isNotNull() & (F.col("__n") > 1) & (F.col("number") == target)
    out = long.join(per, "metric").withColumn("__w", wins)
    first = out.groupBy("metric").agg(F.min(F.when(F.col("__w"), F.col("at"))).alias("__first"))
    return out.join(first, "metric").select(
        "metric", "id", "text", (F.col("__d") > 1).alias("differs"),
        F.coalesce(F.col("__w") & (F.col("at") == F.col("__first")), F.lit(False)).alias("best"))
