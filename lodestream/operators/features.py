"""Feature tables: long and wide forms, encoders, content-addressed store, splits.

The long form is (trial_id, feature, sub, value). Nulls stay nulls in the wide form and encode to
zeros; values outside a fixed vocabulary encode to zeros as well. Repeated long rows: the greatest value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.evaluation import percentiles


def wide(long: DataFrame, names: list[str]) -> DataFrame:
    """One column 'feature--sub' per known name; the list is given, so no pass is spent on finding it."""
    named = long.select("trial_id", F.concat_ws("--", "feature", F.coalesce("sub", F.lit("value"))).alias("name"), "value")
    return named.groupBy("trial_id").pivot("name", names).agg(F.max("value"))


def long(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(trial_id, feature, sub, value) from wide columns named feature--sub; nulls are left out."""
    u = df.select(key, *(F.col(c).cast("string").alias(c) for c in cols)).unpivot(key, cols, "name", "value")
    return u.filter("value is not null").select(
        F.col(key).alias("trial_id"), F.split_part("name", F.lit("--"), F.lit(1)).alias("feature"), F.split_part("name", F.lit("--"), F.lit(2)).alias("sub"), "value"
    )


def one_hot(c: Column, vocabulary: list[str], prefix: str) -> list[Column]:
    """A 0/1 column per vocabulary entry; anything else gives all zeros."""
    return [F.coalesce((c == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in vocabulary]


def multi_hot(c: Column, vocabulary: list[str], prefix: str) -> list[Column]:
    """Counts of each vocabulary entry in a list."""
    return [_count_of(c, v).alias(f"{prefix}_{v}") for v in vocabulary]


def _count_of(c: Column, v: str) -> Column:
    n = F.size(F.filter(c, lambda x: x == F.lit(v)))
    return F.when(c.isNull(), 0).otherwise(n)


def imputed(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numeric nulls replaced by the column's median; a column of nulls stays null."""
    med = percentiles(df, dict.fromkeys(cols, 0.5))
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(med[c])) for c in cols})


def missing_work(trials: DataFrame, groups: DataFrame, store: DataFrame, block: int = 10_000) -> DataFrame:
    """Trials x feature groups without those that the store holds: (trial_id, group, plan_hash) to compute.

    The plan's groups are laid out beside each trial in blocks of bounded size, a few rows in practice.
    """
    plan = [(r["group"], r["plan_hash"]) for r in groups.select("group", "plan_hash").distinct().toLocalIterator()]
    ids, want = trials.select("trial_id"), None
    for i in range(0, len(plan), block):
        lit = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(h).alias("plan_hash")) for g, h in plan[i : i + block]])
        part = ids.select("trial_id", F.inline(lit))
        want = part if want is None else want.unionByName(part)
    if want is None:
        want = ids.limit(0).select("trial_id", F.lit("").alias("group"), F.lit("").alias("plan_hash"))
    return want.join(store.select("trial_id", "group", "plan_hash").distinct(), ["trial_id", "group", "plan_hash"], "left_anti")


def capped_groups(features: DataFrame, group: str, order: str, cap: int = 5) -> DataFrame:
    """Groups cut into numbered parts of at most ``cap``; a feature in several groups stays in the first by name."""
    first = features.groupBy(order).agg(F.min(group).alias(group))
    w = Window.partitionBy(group).orderBy(order)
    return first.withColumn("part", F.floor((F.row_number().over(w) - 1) / cap).cast("int"))


SMALL = "__small__"


def stratified_split(df: DataFrame, key: str, strata: list[str], seed: int = 42, shares: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """df's key and strata with ``stratum`` and split train/val/test, in quotas per stratum by a seeded hash of the key.

    A stratum is its values joined by _; those of a single row are one stratum, SMALL. Rows are numbered within
    (stratum, hash bucket) so that no stratum is ordered in one task; buckets are filled one after the other from
    their counts. Shares that do not lie between 0 and 1 together are a ValueError.
    """
    if min(shares) < 0 or sum(shares) > 1:
        raise ValueError("shares of train and val are at least 0 and together at most 1")
    name = F.concat_ws("_", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in strata))
    s = df.select(key, *strata, name.alias("__name")).withColumn("h", F.xxhash64(F.lit(seed), key)).withColumn("b", F.pmod("h", F.lit(64)))
    single = s.groupBy("__name").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("__name", F.lit(SMALL).alias("__small"))
    s = s.join(single, "__name", "left").withColumn("stratum", F.coalesce("__small", "__name"))
    counts = s.groupBy("stratum", "b").agg(F.count(F.lit(1)).alias("n"))
    wc = Window.partitionBy("stratum").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("stratum", "b", F.coalesce(F.sum("n").over(wc), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("stratum")).alias("total"))
    w = Window.partitionBy("stratum", "b").orderBy("h", key)
    j = s.join(counts, ["stratum", "b"]).withColumn("at", (F.col("offset") + F.row_number().over(w) - 1) / F.col("total"))
    split = F.when(F.col("at") < shares[0], "train").when(F.col("at") < shares[0] + shares[1], "val").otherwise("test")
    return j.select(key, *strata, "stratum", split.alias("split"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in order of a seeded hash of the key: the same rows wherever it runs."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
