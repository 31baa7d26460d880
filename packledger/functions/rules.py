"""Compile ordered rule tables into Column expressions.

Patterns are always literals, so the JVM compiles each one once per task.
"""
from pyspark.sql import Column, functions as F


def rx(pattern: str) -> str:
    """Case-insensitive, Unicode-aware form of a fixed pattern."""
    return "(?iU)" + pattern


def matches(col: Column, pattern: str) -> Column:
    """True/false, never null: a missing text matches nothing."""
    return F.coalesce(col.rlike(rx(pattern)), F.lit(False))


def first_match(col: Column, rules) -> Column:
    """Name of the first rule that matches, else null."""
    return F.coalesce(*[F.when(matches(col, p), F.lit(n)) for n, p in rules])


def all_matches(col: Column, rules) -> Column:
    """Names of all the rules that match, in rule order."""
    return F.array_compact(F.array(*[F.when(matches(col, p), F.lit(n)) for n, p in rules]))


def let(value: Column, body) -> Column:
    """Bind an expression once and use it many times inside ``body``.

    Without the binding a pattern cascade would repeat its input per rule.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def once(value: Column) -> Column:
    """The value as a column that is evaluated where it is made, and only there.

    A filter on a plain column is copied below it, as far as the scan, with the
    whole cascade in it.  What might differ at each call stays where it is.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed table, null when the key is absent."""
    return F.try_element_at(literal_map(table), key)
