"""Structured Streaming jobs: file sources, watermarked windows, upserts per batch, keyed state.

Each job runs with availableNow, so a finite input ends it, and continues from its checkpoint. A batch
that is delivered twice changes nothing: upserts replace by key, in a folder per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.relational import upsert
from lodestream.session import checkpoint_dir


def file_stream(spark: SparkSession, folder: str, like: str, glob: str | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder, with the schema of an existing file."""
    r = spark.readStream.schema(spark.read.parquet(like).schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(folder)


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(start, event_type, n, total): tumbling windows; rows later than the watermark are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n): sessions that end after a gap."""
    return (
        events.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is available to Parquet and ends."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def drain_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def upsert_sink(table_dir: str, keys: list[str], order: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the last row of each key, in buckets of keys.

    A batch rewrites only the buckets that it has keys of, into a folder of its number; the newest folder of
    each bucket is the table. A batch that comes again rewrites its own folder from those before, so a rerun
    after a failure gives the same table.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        b = batch.dropna(subset=keys).withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = {r[0] for r in b.select("__bucket").distinct().collect()}  # at most ``buckets``
        older = {k: v for k, v in newest(spark, table_dir, below=number).items() if k in touched}
        existing = _read(spark, table_dir, older).withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")) if older else b.limit(0)
        upsert(existing, b, keys, order).write.mode("overwrite").partitionBy("__bucket").parquet(f"{table_dir}/v={number:09d}")

    return sink


def newest(spark: SparkSession, table_dir: str, below: int | None = None) -> dict[int, int]:
    """{bucket: number of the newest finished batch that wrote it}, of batches below a number if one is given."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[int, int] = {}
    if not fs.exists(path):
        return out
    for folder in (x.getPath() for x in fs.listStatus(path)):
        if not folder.getName().startswith("v=") or not fs.exists(jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            continue
        n = int(folder.getName()[2:])
        if below is None or n < below:
            for b in (x.getPath().getName() for x in fs.listStatus(folder)):
                if b.startswith("__bucket="):
                    out[int(b[9:])] = max(n, out.get(int(b[9:]), -1))
    return out


def _read(spark: SparkSession, table_dir: str, parts: dict[int, int]) -> DataFrame:
    return spark.read.parquet(*(f"{table_dir}/v={n:09d}/__bucket={b}" for b, n in sorted(parts.items())))


def latest(spark: SparkSession, table_dir: str) -> DataFrame:
    """The table that ``upsert_sink`` keeps; no batch yet is a ValueError."""
    parts = newest(spark, table_dir)
    if not parts:
        raise ValueError(f"no finished batch below {table_dir}")
    return _read(spark, table_dir, parts)


def running_state(events: DataFrame) -> DataFrame:
    """(user_id, n, last_type) per user after each batch, from keyed state of a few values."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, last_ts, last_type = state.get if state.exists else (0, None, None)
        for pdf in batches:
            n += len(pdf)
            top = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            if last_ts is None or top["ts"] >= pd.Timestamp(last_ts):
                last_ts, last_type = top["ts"].isoformat(), top["event_type"]
        state.update((n, last_ts, last_type))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_type": [last_type]})

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id bigint, n bigint, last_type string", "n bigint, ts string, kind string", "update", "NoTimeout"
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    import uuid

    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
