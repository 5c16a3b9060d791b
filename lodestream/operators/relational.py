"""Relational building blocks: statistics per group, upserts, deduplication, lookups.

Nulls: a null group key is a group of its own in statistics; null keys never match in joins and
upserts. Repeated rows: reduced where a docstring says so, else counted. Empty inputs give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """One row per key, the first by ``order`` (a total order makes it deterministic); only ``keep`` columns.

    A map-side aggregate of one struct per key, so a heavy key is reduced before the shuffle.
    """
    rest = [c for c in keep if c not in keys]
    packed = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), *rest)
    best = df.groupBy(*keys).agg(F.min(packed).alias("b"))
    return best.select(*keys, *(F.col(f"b.{c}").alias(c) for c in rest))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns; every column is kept."""
    cols = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in cols if c not in order])).alias("b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"b.{c}").alias(c) for c in df.columns])


def outcome_stats(df: DataFrame, by: list[str], status: str, phase: str | None = None, value: str | None = None) -> DataFrame:
    """Per group: trials, counts by phase, completed, stopped, success rate (null without finished trials), mean value."""
    done = F.count_if(F.col(status) == "COMPLETED")
    stopped = F.count_if(F.col(status).isin("TERMINATED", "WITHDRAWN"))
    aggs = [F.count(F.lit(1)).alias("trials")]
    if phase:
        aggs += [F.count_if(F.col(phase).rlike(f"(?i)phase ?{n}")).alias(f"phase{n}") for n in (1, 2, 3)]
    if value:
        aggs.append(F.round(F.avg(value), 4).alias(f"mean_{value}"))
    aggs += [done.alias("completed"), stopped.alias("stopped")]
    out = df.groupBy(*by).agg(*aggs)
    return out.withColumn(
        "success_rate", F.round(F.try_divide(F.col("completed"), F.col("completed") + F.col("stopped")), 6)
    )


def left_chain(fact: DataFrame, dims: list[tuple[DataFrame, str]]) -> DataFrame:
    """Left joins of dimensions on keys named alike on both sides; small dimensions are broadcast by their statistics."""
    return reduce(lambda acc, d: acc.join(d[0], d[1], "left"), dims, fact)


def joined_distinct(df: DataFrame, by: list[str], value: str, sep: str = "|") -> DataFrame:
    """Per group the distinct non-null values in order, as one text: (by..., values)."""
    pairs = df.filter(F.col(value).isNotNull()).select(*by, value).distinct()
    return pairs.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(value)), sep).alias("values"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Existing rows whose key does not come in, and the last incoming row of each key."""
    fresh = keep_last(incoming.dropna(subset=keys), keys, order)
    return existing.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert_counts(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """One row: added, updated and total number of keys."""
    old = existing.select(F.col(key).alias("k"), F.lit(1).alias("o"), F.lit(0).alias("n"))
    new = incoming.select(F.col(key).alias("k"), F.lit(0).alias("o"), F.lit(1).alias("n"))
    per = old.unionByName(new).filter("k is not null").groupBy("k").agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return per.agg(
        F.count_if((F.col("n") == 1) & (F.col("o") == 0)).alias("added"),
        F.count_if((F.col("n") == 1) & (F.col("o") == 1)).alias("updated"),
        F.count(F.lit(1)).alias("total"),
    )


def not_cached(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted rows whose key is not cached; null keys are never cached."""
    return wanted.join(cached.select(*keys).distinct(), keys, "left_anti")


def either_end(df: DataFrame, value: str, ends: tuple[tuple[str, str], ...], kind: str | None = None) -> DataFrame:
    """Rows where one end equals the value, letter case ignored, and has the type if one is given."""
    v = value.lower()
    conds = [(F.lower(n) == v) & ((F.col(t) == kind) if kind else F.lit(True)) for n, t in ends]
    return df.filter(reduce(lambda a, b: a | b, conds))


def containing(df: DataFrame, col: str, query: str, regex: bool = False) -> DataFrame:
    """Letter case ignored; the query is literal text unless regex is asked for."""
    return df.filter(F.col(col).rlike(f"(?i){query}") if regex else F.lower(col).contains(query.lower()))


def before(df: DataFrame, day: Column, cutoff: str) -> DataFrame:
    """Rows dated strictly before the cutoff; undated rows are left out."""
    return df.filter(day.isNotNull() & (day < F.lit(cutoff).cast("date")))


#: Parts of column names that give away a trial's outcome, lower case without separators.
LEAKING = """
overallstatus laststatus lastknownstatus whystopped
resultssection resultsposted resultsposteddate resultsfirstposted resultsfirstsubmitted
completiondate primarycompletiondate studycompletiondate dispositionmodule statusverifieddate
""".split()


def is_leaking(name: str) -> bool:
    """Whether a column name contains one of the parts; case, hyphens and underscores do not matter."""
    flat = name.lower().replace("-", "").replace("_", "")
    return any(p in flat for p in LEAKING)


def leaking_name(c: Column) -> Column:
    """``is_leaking`` for names that are data."""
    return F.translate(F.lower(c), "-_", "").rlike("|".join(LEAKING))


def without_leaking(df: DataFrame) -> DataFrame:
    """Drops columns whose name gives away an outcome; decided at plan time."""
    return df.drop(*(c for c in df.columns if is_leaking(c)))


def with_columns_present(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Adds missing columns as nulls of the given type."""
    for name, kind in wanted.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def aliased(df: DataFrame, aliases: dict[str, Iterable[str]]) -> DataFrame:
    """One column per name from the first of its aliases that is present and not null; absent: null text."""
    cols = []
    for name, options in aliases.items():
        have = [F.col(o) for o in options if o in df.columns]
        cols.append((F.coalesce(*have) if have else F.lit(None).cast("string")).alias(name))
    return df.select(*cols)


def filled_columns(df: DataFrame, least: int = 2) -> list[str]:
    """Names of the columns with at least ``least`` non-null values, from one aggregation."""
    row = df.agg(*(F.count(c).alias(c) for c in df.columns)).first()
    return [c for c in df.columns if row[c] >= least]


def first_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits the groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def share_of_total(df: DataFrame, by: list[str], value: Column, name: str = "share") -> DataFrame:
    """Per group sum and its share of the whole; two aggregations, no window over all rows."""
    per = df.groupBy(*by).agg(F.sum(value).alias("amount"))
    total = per.agg(F.sum("amount").alias("t")).first()["t"]
    return per.withColumn(name, F.round(F.try_divide(F.col("amount").cast("double"), F.lit(total).cast("double")), 6))


def merged(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer merge where the right side wins."""
    r = right.select(*keys, *(F.col(v).alias(f"__{v}") for v in values), F.lit(True).alias("__has"))
    j = left.select(*keys, *values).join(r, keys, "full")
    return j.select(*keys, *(F.when(F.col("__has"), F.col(f"__{v}")).otherwise(F.col(v)).alias(v) for v in values))


def missing_rate(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: cells, missing cells and their rate over the columns."""
    miss = reduce(lambda a, b: a + b, (F.count_if(F.col(c).isNull()) for c in cols))
    return df.agg((F.count(F.lit(1)) * len(cols)).alias("cells"), miss.alias("missing")).withColumn(
        "rate", F.round(F.try_divide(F.col("missing"), F.col("cells")), 6)
    )


def missing_per_column(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, missing): null counts per column, in one pass."""
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in cols))
    return one.unpivot([], cols, "column_name", "missing")
