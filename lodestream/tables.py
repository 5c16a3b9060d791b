"""Reading the Parquet tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Column


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; column pruning and filters reach the scan because nothing is cached here."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm_ref(c: Column | str) -> Column:
    """An id as it is compared: letter case and surrounding blanks ignored, blank is null."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.lower(F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    return F.when(t != "", t)
