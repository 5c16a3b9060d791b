"""Eager aggregation: per-key results and joins that do not suffer from keys with very many rows.

Every input is reduced to one compact state per key before it meets anything else, so after the
map-side combine a key with a third of all rows is as light as any other. Joins then join states:
row counts multiply, sums scale by the other side's count, and a roll-up finishes. Distinct counts
first remove repeated (key, value) pairs, which spreads a heavy key over as many tasks as it has
values, and count pairs afterwards.

Null keys: kept as their own group by ``key_states``, never matched by ``join_states``. Empty
inputs give empty results. Columns not named are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_states(df: DataFrame, keys: dict[str, Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """One state per key: n rows and the named sums."""
    src = df.select(*(c.alias(k) for k, c in keys.items()), *(c.alias(k) for k, c in (sums or {}).items()))
    aggs = [F.count(F.lit(1)).alias("n"), *(F.sum(k).alias(k) for k in (sums or {}))]
    return src.groupBy(*keys).agg(*aggs)


def rows_and_distinct(df: DataFrame, key: Column, value: Column, names: tuple[str, str, str]) -> DataFrame:
    """(key, rows, distinct non-null values) without collecting the values of a key in one task."""
    k, n, d = names
    pairs = df.select(key.alias("k"), value.alias("v")).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("k").agg(
        F.sum("n").alias(n), F.count("v").alias(d)
    ).withColumnRenamed("k", k)


def join_states(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    keep_left: list[str] = (),
    keep_right: list[str] = (),
    left_sums: list[str] = (),
    right_sums: list[str] = (),
) -> DataFrame:
    """The inner join of the rows behind two state tables, aggregated without building the joined rows.

    ``n`` of the result is the number of joined rows; a sum over the left side's rows counts each of
    them once per partner on the right, and the other way round.
    """
    l = left.select(*on, *keep_left, F.col("n").alias("ln"), *left_sums)
    r = right.select(*on, *keep_right, F.col("n").alias("rn"), *right_sums)
    j = l.join(r, on)
    return j.select(
        *on,
        *keep_left,
        *keep_right,
        (F.col("ln") * F.col("rn")).alias("n"),
        *((F.col(c) * F.col("rn")).alias(c) for c in left_sums),
        *((F.col(c) * F.col("ln")).alias(c) for c in right_sums),
    )


def roll_up(states: DataFrame, by: list[str], sums: list[str] = ()) -> DataFrame:
    return states.groupBy(*by).agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums))


def shares(tables: dict[str, tuple[DataFrame, str]], share: float) -> DataFrame:
    """(table_name, key_value, n) of the non-null keys that hold at least ``share`` of all rows of a table.

    The rows of a table are joined with its total, but as states: one per key on the left, one per
    table on the right, rolled up from the same key states, so each table is read and reduced once.
    Rows with a null key count towards the total.
    """
    out = None
    for name, (df, key) in tables.items():
        s = key_states(df, {"table_name": F.lit(name), "key_value": F.col(key).cast("string")})
        out = s if out is None else out.unionByName(s)
    totals = roll_up(out, ["table_name"])  # a row per table
    joined = out.select("table_name", "key_value", F.col("n").alias("own")).join(F.broadcast(totals), "table_name")
    # null keys fail a test that needs both sides: pushed below the join it would part the two uses of the states
    own = F.when(F.col("key_value").isNotNull(), F.col("own"))
    return joined.filter(own >= F.col("n") * F.lit(share * (1 - 1e-12))).select("table_name", "key_value", F.col("own").alias("n"))
