"""Session settings, tables and written intermediates shared by the operators."""
from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from packledger.durable import scratch_path
from packledger.session import ship, tune


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package and bound an Arrow batch by rows and by bytes.

    Both bounds are on a batch, not on a row: a text of any length still travels whole.
    """
    ship(spark)
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once below the shared folder and read back from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


_KEPT: dict[tuple, Any] = {}


def kept(operator: str, key: str, make: Callable[[], Any]) -> Any:
    """What an operator keeps in a worker process between tasks, made once.

    Workers serve one operator after another; what the one before kept is let go.
    """
    if (operator, key) not in _KEPT:
        for old in [k for k in _KEPT if k[0] != operator]:
            del _KEPT[old]
        _KEPT[operator, key] = make()
    return _KEPT[operator, key]
