"""Monitoring of predictions: metrics, daily counts, drift.

Log rows: (ts, entity, model, probability, latency). Null probabilities and latencies are left out of
means and quantiles; empty logs give counts of 0 and null means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators.evaluation import ks_p_value, ks_statistic, percentiles

LEAST_ROWS, LEAST_HALF, P_VALUE, MISSING, LATENCY = 10, 5, 0.05, 0.10, 1.5


def metrics(log: DataFrame) -> DataFrame:
    """One row: count, mean probability and latency, linear p99 of latency, distinct entities."""
    p99 = percentiles(log, {"latency": 0.99})["latency"]
    return log.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("probability"), 6).alias("mean_probability"),
        F.round(F.avg("latency"), 6).alias("mean_latency"),
        F.round(F.lit(p99).cast("double"), 6).alias("p99_latency"),
        F.count_distinct("entity").alias("entities"),
    )


def counts_by(log: DataFrame, by: str) -> DataFrame:
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def daily_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def halves(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows up to the median time and those after it."""
    mid = percentiles(log.select(F.unix_micros("ts").alias("t")), {"t": 0.5})["t"]
    early = F.unix_micros("ts") <= F.lit(mid)
    return log.filter(early), log.filter(~early)


def drift(log: DataFrame, features: list[str] = ()) -> dict:
    """Verdict on the newer against the older half: which columns drifted, missing rate, latency ratio."""
    n = log.count()
    if n < LEAST_ROWS:
        return {"status": "insufficient", "rows": n, "drifted": []}
    old, new = halves(log)
    drifted = []
    for c in ("probability", *features):
        k = ks_statistic(old.select(F.col(c).alias("x")), new.select(F.col(c).alias("x"))).first()
        if min(k["n_a"], k["n_b"]) >= LEAST_HALF and k["d"] is not None and ks_p_value(k["d"], k["n_a"], k["n_b"]) < P_VALUE:
            drifted.append(c)
    cols = list(features)
    missing = 0.0
    if cols:
        gone = sum(new.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in cols)).first())
        missing = gone / max(1, new.count() * len(cols))
    a, b = old.agg(F.avg("latency")).first()[0], new.agg(F.avg("latency")).first()[0]
    slower = bool(a and b and b / a > LATENCY)
    status = "drift" if drifted or missing > MISSING or slower else "stable"
    return {"status": status, "rows": n, "drifted": drifted, "missing": missing, "slower": slower}
