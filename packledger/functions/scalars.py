"""Scalar column expressions: keys, identifiers, units and display forms."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed as X
from .rules import lookup, matches, rx
from .text import nearest


def norm_key(col: Column) -> Column:
    """Whitespace-collapsed, trimmed, case-folded."""
    s = F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\s+", " "))
    return F.replace(F.lower(s), F.lit("ß"), F.lit("ss"))


def product_key(url: Column) -> Column:
    """Last path segment of a product address."""
    path = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)[?#].*$", "")
    path = F.regexp_replace(path, r"/+$", "")
    return norm_key(F.try_element_at(F.split(path, "/"), F.lit(-1)))


def slugify(col: Column) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^a-z0-9]+", "-")
    return F.regexp_replace(s, r"^-+|-+$", "")


def alnum(col: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^a-z0-9]+", "")


def alnum_label(col: Column) -> Column:
    """As :func:`alnum`, with parenthesised remarks left out."""
    s = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"\([^)]*\)", "")
    return F.regexp_replace(s, r"[^a-z0-9]+", "")


def is_part_number(col: Column) -> Column:
    s = F.trim(F.coalesce(col, F.lit("")))
    return (s != "") & s.rlike(X.PART_NUMBER) & s.rlike(r"\d")


def name_without_volumes(col: Column) -> Column:
    s = F.regexp_replace(F.coalesce(col, F.lit("")), rx(X.NAME_VOLUME), "")
    s = F.regexp_replace(s, r"(?U)\s{2,}", " ")
    return F.trim(F.regexp_replace(s, r"^[ \-–—|,&/+:;]+|[ \-–—|,&/+:;]+$", ""))


def plain_number(col: Column) -> Column:
    """26.0 -> 26, 2.5 -> 2.5."""
    return F.regexp_replace(col.cast("decimal(18,6)").cast("string"), r"\.?0+$", "")


def size_label(volume: Column) -> Column:
    return F.concat(plain_number(volume), F.lit("L"))


def id_brand(col: Column) -> Column:
    return F.when(F.contains(col, F.lit("__")), F.substring_index(col, "__", 1)).otherwise("unknown")


def id_model(col: Column) -> Column:
    at = F.instr(col, "__")
    return F.when(at > 0, F.substr(col, at + 2)).otherwise(col)


def bag_path(brand_slug: Column, slug: Column) -> Column:
    return F.concat(F.lit("/bags/"), brand_slug, F.lit("/"), slug, F.lit("/"))


def host(url: Column) -> Column:
    h = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.regexp_replace(h, r"^www\.", "")


def registrable(host_col: Column) -> Column:
    """Last two labels, three under the usual second-level suffixes."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(host_col, F.lit(""))), r"^www\.", ""),
                    r"\.")
    n = F.size(parts)
    deep = (n > 2) & F.get(parts, n - 2).isin("co", "com", "org", "net", "ac")
    take = F.when(deep, 3).otherwise(2)
    return F.array_join(F.slice(parts, F.greatest(n - take + 1, F.lit(1)), take), ".")


def url_handle(url: Column) -> Column:
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return alnum_label(F.try_element_at(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(-1)))


def store_grams(value: Column) -> Column:
    """A shipping weight of unstated unit: 20 or less is kilograms."""
    n = F.nullif(value.cast("string").try_cast("double"), F.lit(0.0))
    g = F.when(n <= 20, n * 1000.0).otherwise(n)
    lo, hi = X.WEIGHT_BOUNDS
    return F.when(g.between(lo, hi), F.bround(g, 0).cast("int"))


def minor_unit_price(raw: Column, minor: Column) -> Column:
    value = F.nullif(F.trim(raw.cast("string")), F.lit("")).try_cast("double")
    return F.round(value / F.pow(F.lit(10.0), F.coalesce(minor, F.lit(2))), 2)


def grams_per_litre(weight: Column, volume: Column) -> Column:
    return F.when((weight != 0) & (volume != 0), weight / volume)


def price_per_litre(price: Column, volume: Column) -> Column:
    return F.when((price != 0) & (volume != 0), price / volume)


def discount(price: Column, was: Column) -> Column:
    """Share off the list price, null unless the list price is higher."""
    return F.when((price != 0) & (was > price), F.lit(1.0) - price / was)


def to_utc(col: Column) -> Column:
    """ISO text with an offset or Z to a UTC timestamp without zone; unreadable is null."""
    return F.to_utc_timestamp(col.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")


def email_digest(col: Column) -> Column:
    return F.sha2(F.lower(F.trim(col)), 256)


def requester_digest(day: Column, address: Column) -> Column:
    return F.sha2(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("|"), address), 256)


def valid_email(col: Column) -> Column:
    return F.coalesce(col.rlike(X.EMAIL_SHAPE) & (F.length(col) <= 254), F.lit(False))


def currency_symbol(code: Column) -> Column:
    c = F.upper(F.coalesce(F.nullif(code, F.lit("")), F.lit("USD")))
    return F.coalesce(lookup(X.CURRENCY_SYMBOL, c), F.concat(c, F.lit(" ")))


def price_text(n: Column, code: Column) -> Column:
    whole = n == F.floor(n)
    digits = F.when(whole, n.cast("bigint").cast("string")).otherwise(
        n.cast("decimal(18,2)").cast("string"))
    return F.when(n.isNull(), "—").otherwise(F.concat(currency_symbol(code), digits))


def price_range_text(lo: Column, hi: Column, code: Column) -> Column:
    return (F.when(lo.isNull(), "—").when(hi.isNull() | (hi == lo), price_text(lo, code))
            .otherwise(F.concat(price_text(lo, code), F.lit(" – "), price_text(hi, code))))


def fixed_text(x: Column, digits: int) -> Column:
    """A fixed number of decimals, nearest to the exact binary value (see ``nearest``)."""
    unit = 10 ** digits
    return (nearest(x, digits, ties_up=True) / F.lit(unit)).cast(f"decimal(18,{digits})").cast("string")


def weight_text(g: Column) -> Column:
    return F.when(g >= 1000, F.concat(fixed_text(g / 1000.0, 2), F.lit(" kg"))).when(
        g.isNotNull(), F.concat(g.cast("string"), F.lit(" g")))


def weight_imperial_text(g: Column) -> Column:
    lb, oz = 453.59237, 28.349523
    return F.when(g >= lb, F.concat(fixed_text(g / lb, 1), F.lit(" lb"))).when(
        g.isNotNull(), F.concat(F.floor(g / oz + 0.5).cast("string"), F.lit(" oz")))


def dims_text(dims: Column, inches: bool = False) -> Column:
    unit = " in" if inches else " cm"
    parts = F.transform(dims, lambda v: fixed_text(v / X.CM_PER_IN if inches else v, 1))
    return F.when(F.size(dims) > 0, F.concat(F.array_join(parts, " × "), F.lit(unit)))


def thumb_url(url: Column) -> Column:
    """Ask the image host for a small render; other hosts are left alone."""
    h = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(width|height)(=|$)"))
    want = F.array_append(kept, F.lit(f"width={X.THUMB_WIDTH}"))
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    frag = F.regexp_extract(url, r"(#.*)$", 1)
    ours = (h == "cdn.shopify.com") | h.endswith(".cdn.shopify.com")
    return F.when(ours, F.concat(base, F.lit("?"), F.array_join(want, "&"), frag)).otherwise(url)


def storefront_url(raw: Column, most: int | None = None) -> Column:
    """A cleaned storefront address, or null when it is not one; with ``most``, null when longer than that."""
    s = F.regexp_replace(F.trim(raw), r"(?U)\s+", " ")
    s = F.when((s != "") & (F.lit(True) if most is None else F.length(s) <= most), s)
    full = F.when(matches(s, r"^https?://"), s).otherwise(F.concat(F.lit("https://"), s))
    h = F.try_parse_url(full, F.lit("HOST"))
    bare = F.try_parse_url(full, F.lit("PATH"))
    full = F.when(F.coalesce(bare, F.lit("")) == "", F.concat(full, F.lit("/"))).otherwise(full)
    return F.when(F.contains(h, F.lit(".")), full)


def clean_text(raw: Column, most: int) -> Column:
    """Trimmed, whitespace collapsed; empty or over-long is null."""
    s = F.regexp_replace(strip(raw), r"(?U)\s+", " ")
    return F.when((s != "") & (F.length(s) <= most), s)


def strip(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")


def filled_text(raw: Column) -> Column:
    """Trimmed; empty is null."""
    return F.nullif(strip(raw), F.lit(""))


def locale_currency(locale: Column) -> Column:
    """USD from ``en-us``; null without a known region."""
    parts = F.split(F.lower(F.regexp_replace(locale, r"^/+|/+$", "")), r"[-_]")
    return F.when(F.size(parts) > 1, lookup(X.LOCALE_CURRENCY, F.try_element_at(parts, F.lit(-1))))


def collated(col: Column) -> Column:
    """Text that compares as a reader sorts it: accents and case only decide between equal letters."""
    return F.collate(F.coalesce(col, F.lit("")), "UNICODE")


def label_order(col: Column) -> list[Column]:
    """Sort keys that list names opening with a digit after all the others, each by collation."""
    return [F.coalesce(col, F.lit("")).rlike(r"^[0-9]").asc(), collated(col).asc()]


def labelled(table: dict, key: Column) -> Column:
    """Display label of an enum value, the value itself when it has none."""
    return F.coalesce(lookup(table, key), key)
