"""Comparison of a Spark result with a SQL result, order-insensitive."""
import decimal
import math

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows(names, values):
    names, order = list(names), sorted(names)
    at = [names.index(n) for n in order]
    out = [tuple(norm(r[i]) for i in at) for r in values]
    return order, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def connect(folder):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con
