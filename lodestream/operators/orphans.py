"""References to records that do not exist, or not at the time of reference.

A reference at time t to key k is an orphan unless some version of k in the target table is valid at
t: added no later than t, and not removed, or removed later than t. Ids are compared ignoring letter
case and surrounding blanks; a null or blank id is no reference; a reference without a time can not be
shown to be early or late, so it is an orphan only if the key is absent altogether.

1. References shrink to one state per key and quarter (rows, first and last time), target versions to
   one per key and quarter in which they begin (latest end). A key with a third of all rows costs as
   many states as the calendar has quarters.
2. Keys that hold at least ``share`` of the references (at most 1/share of them) are split off and
   checked against a broadcast of only their own target states; all other keys meet in a shuffle.
   An anti-join gives the states of absent keys; for the rest the versions begun in earlier quarters
   count by their latest end alone (carried in), so most states are settled or orphan as a whole.
3. Rows are fetched for the states that are not settled, and judged by the carried-in end. Only rows in
   a quarter in which a version of their key begins are merged with those versions in time order, dealt
   over copies where there are many.

Defined cases: empty inputs give empty results; a version without a start was always there, one
without an end still is; repeated rows are orphans each; columns not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.skew import heavy_of_states, is_heavy
from lodestream.session import cut_lineage
from lodestream.tables import norm_ref

#: A key is heavy from this share of all references on; at most 1/HEAVY_SHARE keys are.
HEAVY_SHARE = 0.01
#: References of one key and quarter that are merged with its versions in one task.
PER_MERGE = 200_000

_NO_TIME, _EVER = -1, -(2**31)
_STATE = ["table_name", "target", "key", "q"]


def quarter_number(at: Column) -> Column:
    return F.year(at) * 4 + F.quarter(at) - 1


def quarter_text(q: Column) -> Column:
    return F.when(q != _NO_TIME, F.concat(F.floor(q / 4), F.lit("Q"), q % 4 + 1))


def references(df: DataFrame, table_name: str, target: str | Column, row_id: str, key: str, at: str) -> DataFrame:
    """(table_name, target, row_id, key, at, q) of the rows that refer to something."""
    to = F.lit(target) if isinstance(target, str) else target
    return df.select(
        F.lit(table_name).alias("table_name"),
        to.alias("target"),
        F.col(row_id).cast("bigint").alias("row_id"),
        norm_ref(key).alias("key"),
        F.col(at).alias("at"),
        F.coalesce(quarter_number(F.col(at)), F.lit(_NO_TIME)).alias("q"),
    ).filter(F.col("key").isNotNull() & F.col("target").isNotNull())


def versions(df: DataFrame, target: str, key: str, added: str, removed: str) -> DataFrame:
    """(target, key, from, to, q): the spans in which a record of the key was valid, and the quarter they begin in."""
    end_of_time = F.timestamp_micros(F.lit(2**63 - 1))
    return df.select(
        F.lit(target).alias("target"),
        norm_ref(key).alias("key"),
        F.col(added).alias("from"),
        F.coalesce(F.col(removed), end_of_time).alias("to"),
        F.coalesce(quarter_number(F.col(added)), F.lit(_EVER)).alias("q"),
    ).filter(F.col("key").isNotNull())


def _open_states(refs: DataFrame, target: DataFrame, share: float) -> tuple[DataFrame, list]:
    """(states that hold orphans or may hold some, heavy keys).

    The states: (table_name, target, key, q, n, whole, carry, inner). whole: all rows are orphans; else those
    from ``carry`` on are, but for the versions that begin in the quarter itself if ``inner``.
    """
    states = cut_lineage(
        refs.groupBy(*_STATE).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    )
    heavy = heavy_of_states(states, "key", "n", share)
    begun = target.groupBy("target", "key", F.col("q").alias("begin")).agg(F.max("to").alias("end"), F.min("from").alias("first"))
    hot = is_heavy(F.col("key"), heavy)
    carry = F.max(F.when(F.col("begin") < F.col("q"), F.col("end")))
    inner = F.max(F.when(F.col("begin") == F.col("q"), F.col("first")))
    lo, hi = F.col("lo"), F.col("hi")
    out = None
    for own, there in ((states.filter(~hot), begun.filter(~hot)), (states.filter(hot), F.broadcast(begun.filter(hot)))):
        absent = own.join(there, ["target", "key"], "left_anti").select(
            *_STATE, "n", F.lit(True).alias("whole"), F.lit(None).cast("timestamp").alias("carry"), F.lit(False).alias("inner")
        )
        present = (
            own.filter(lo.isNotNull())
            .join(there, ["target", "key"])
            .groupBy(*_STATE, "n", "lo", "hi")
            .agg(carry.alias("carry"), inner.alias("first"))
            .filter(F.col("carry").isNull() | (F.col("carry") <= hi))
            .withColumn("late", F.col("carry").isNull() | (F.col("carry") <= lo))
            .withColumn("inner", F.col("first").isNotNull() & (F.col("first") <= hi))
            .select(*_STATE, "n", (F.col("late") & ~F.col("inner")).alias("whole"), "carry", "inner")
        )
        both = absent.unionByName(present)
        out = both if out is None else out.unionByName(both)
        if not heavy:
            break
    return cut_lineage(out), heavy


def _rows_of(refs: DataFrame, target: DataFrame, states: DataFrame, heavy: list) -> DataFrame:
    """(table_name, row_id, q) of the orphans among the references in some open states."""
    hot = is_heavy(F.col("key"), heavy)
    # of heavy keys at most one state for each quarter and table: small by construction
    rows = refs.filter(~hot).join(states.filter(~hot), _STATE)
    if heavy:
        rows = rows.unionByName(refs.filter(hot).join(F.broadcast(states.filter(hot)), _STATE))
    # the references are read once for both uses below; only rows that are orphans or may be are kept
    rows = cut_lineage(
        rows.filter(F.col("whole") | F.col("carry").isNull() | (F.col("at") >= F.col("carry"))).select(*_STATE, "row_id", "at", "n", "whole", "inner")
    )
    copies = F.ceil(F.col("n") / F.lit(PER_MERGE)).cast("int")
    open_rows = rows.filter("inner and not whole").select(
        *_STATE, F.pmod(F.xxhash64("row_id"), copies).cast("int").alias("copy"), F.col("at").alias("t"), F.lit(1).alias("side"), "row_id",
        F.lit(None).cast("timestamp").alias("to"),
    )
    begun = (
        target.groupBy("target", "key", "q", "from").agg(F.max("to").alias("to"))
        .join(states.filter("inner and not whole").select(*_STATE, copies.alias("copies")), ["target", "key", "q"])
        .select(
            *_STATE, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("from").alias("t"), F.lit(0).alias("side"),
            F.lit(None).cast("bigint").alias("row_id"), "to",
        )
    )
    so_far = Window.partitionBy(*_STATE, "copy").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = (
        open_rows.unionByName(begun)
        .withColumn("end", F.max("to").over(so_far))
        .filter("side = 1 and (end is null or end <= t)")
    )
    return rows.filter("whole or not inner").select("table_name", "row_id", "q").unionByName(judged.select("table_name", "row_id", "q"))


def orphan_rows(refs: DataFrame, target: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """(table_name, row_id, period) of each orphan reference."""
    states, heavy = _open_states(refs, target, share)
    return _rows_of(refs, target, states, heavy).select("table_name", "row_id", quarter_text(F.col("q")).alias("period"))


def orphan_counts(refs: DataFrame, target: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """(table_name, period, orphans): number of orphans per table and period; only mixed states go back to their rows."""
    states, heavy = _open_states(refs, target, share)
    whole = states.filter("whole").groupBy("table_name", "q").agg(F.sum("n").alias("n"))
    mixed = _rows_of(refs, target, states.filter("not whole"), heavy).groupBy("table_name", "q").agg(F.count(F.lit(1)).alias("n"))
    out = whole.unionByName(mixed).groupBy("table_name", "q").agg(F.sum("n").alias("orphans"))
    return out.select("table_name", quarter_text(F.col("q")).alias("period"), "orphans")
