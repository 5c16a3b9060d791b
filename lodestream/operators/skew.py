"""Keys that hold far more rows than others: finding them with a proven size bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, key: str, share: float = 0.01) -> list:
    """The keys holding at least ``share`` of all rows, in key order.

    One partial aggregation; there can be at most 1/share such keys, so what reaches the driver is
    bounded whatever the input. Null keys are never heavy. Empty input: none.
    """
    return heavy_of_states(df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), key, "__n", share)


def heavy_of_states(states: DataFrame, key: str, n: str, share: float) -> list:
    """``heavy_keys`` from states that stand for n rows each; several states may have one key."""
    sums = states.groupBy(F.col(key).alias("k")).agg(F.sum(n).alias("n"))
    total = states.agg(F.sum(n)).first()[0]
    if not total:
        return []
    return sorted(r[0] for r in sums.filter(F.col("k").isNotNull() & (F.col("n") >= total * share)).select("k").collect())


def is_heavy(key: Column, heavy: list) -> Column:
    return key.isin(*heavy) if heavy else F.lit(False)
