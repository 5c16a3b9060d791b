"""Attributes as known at event time: an as-of join that hot entities can not slow down.

For each event the version of its entity with the latest date strictly before the event's date,
the largest version id among equals. Steps:

1. Events and versions shrink to one state per entity and quarter (rows, last version) by a map-side
   combine; all that follows about hot entities is read from these states.
2. Entities that hold at least ``share`` of all rows (at most 1/share of them) are cut into shards
   of consecutive calendar quarters with about ``share`` of the rows each; the events of a quarter
   that alone exceeds that are dealt over several copies of its shard.
3. The last version before each shard's start is carried into it, so every shard has all it needs.
4. Events and versions of a shard, reduced to one version per date, are merged in date order by one
   window. Any other entity is a single shard.

Only the quarter map of the hot entities is broadcast: at most 1/share entities with one row for
each quarter of a calendar, whatever the size of the data.

Defined cases: events or versions without entity or date never match; versions that repeat count
once; an event that repeats yields a row each time; no row comes out for an event without a match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.skew import heavy_of_states, is_heavy
from lodestream.session import cut_lineage

#: An entity is sharded from this share of all events and versions on.
HOT_SHARE = 0.002


def as_of(events: DataFrame, versions: DataFrame, hot_share: float = HOT_SHARE) -> DataFrame:
    """events (entity, day, event_id) and versions (entity, day, version_id) -> (event_id, version_id)."""
    e = events.select("entity", "day", "event_id").filter("entity is not null and day is not null")
    v = versions.select("entity", "day", "version_id").filter("entity is not null and day is not null and version_id is not null")
    q, version = _quarter(F.col("day")).alias("q"), F.struct("day", "version_id")
    states = cut_lineage(
        e.select("entity", q, F.lit(None).cast(v.select(version.alias("x")).schema["x"].dataType).alias("last"))
        .unionByName(v.select("entity", q, version.alias("last")))
        .groupBy("entity", "q")
        .agg(F.count(F.lit(1)).alias("n"), F.max("last").alias("last"))
    )
    hot = heavy_of_states(states, "entity", "n", hot_share)
    v = v.groupBy("entity", "day").agg(F.max("version_id").alias("version_id"))
    if not hot:
        return _merge(e.select("*", F.lit(0).alias("shard"), F.lit(0).alias("copy")), v.select("*", F.lit(0).alias("shard"), F.lit(0).alias("copy")))
    total = states.agg(F.sum("n")).first()[0]
    quarters = cut_lineage(_quarter_map(states.filter(is_heavy(F.col("entity"), hot)), max(1, int(total * hot_share))))
    near = F.broadcast(quarters.select("entity", "q", "shard", "copies"))
    e, v = (x.withColumn("q", q).join(near, ["entity", "q"], "left") for x in (e, v))
    shard, copies = F.coalesce("shard", F.lit(0)).alias("shard"), F.coalesce("copies", F.lit(1)).alias("copies")
    e = e.select("entity", shard, F.pmod(F.xxhash64("event_id"), copies).cast("int").alias("copy"), "day", "event_id")
    v = v.select("entity", shard, copies, "day", "version_id").unionByName(_carry(quarters))
    v = v.select("entity", "shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "day", "version_id")
    return _merge(e, v)


def _quarter(day: Column) -> Column:
    return F.year(day) * 4 + F.quarter(day)


def _quarter_map(states: DataFrame, target: int) -> DataFrame:
    """(entity, q, n, last, shard, copies) of the hot entities: shards of consecutive quarters with about target rows."""
    w = Window.partitionBy("entity").orderBy("q")
    shard = F.floor((F.sum("n").over(w) - F.col("n")) / F.lit(target)).cast("int")
    own = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(target)).cast("int"))
    plan = states.withColumns({"shard": shard, "own": own})
    return plan.withColumn("copies", F.max("own").over(Window.partitionBy("entity", "shard"))).drop("own")


def _carry(quarters: DataFrame) -> DataFrame:
    """(entity, shard, copies, day, version_id): for each shard the last version of all earlier ones."""
    shards = quarters.groupBy("entity", "shard", "copies").agg(F.max("last").alias("last"))
    before = Window.partitionBy("entity").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = shards.select("entity", "shard", "copies", F.max("last").over(before).alias("c")).filter("c is not null")
    return carry.select("entity", "shard", "copies", "c.day", "c.version_id")


def _merge(e: DataFrame, v: DataFrame) -> DataFrame:
    """Local merge of each shard: the last version seen before the event; equal days: events come first."""
    rows = e.select(
        "entity", "shard", "copy", "day", F.lit(0).alias("side"), "event_id", F.lit(None).cast("bigint").alias("version_id")
    ).unionByName(
        v.select("entity", "shard", "copy", "day", F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("event_id"), "version_id")
    )
    w = (
        Window.partitionBy("entity", "shard", "copy")
        .orderBy("day", "side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("seen", F.last("version_id", ignorenulls=True).over(w))
        .filter("side = 0 and seen is not null")
        .select("event_id", F.col("seen").alias("version_id"))
    )
