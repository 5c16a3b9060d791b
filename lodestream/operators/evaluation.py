"""Quality measures: classification, ranking, span matching, curves, confusion, sweeps.

Nulls: rows with a null label or score are left out. A measure whose denominator is 0 is 0, as the
reports of this domain expect; single-class input has ROC-AUC 0. Ties in scores share their mean rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.session import cut_lineage


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": _ratio(2 * tp, 2 * tp + fp + fn)}


def label_stats(pairs: DataFrame) -> DataFrame:
    """(gold, pred) -> per label tp, fp, fn, precision, recall, f1; a null gold is a false alarm, a null pred a miss."""
    both = F.array(F.struct(F.col("gold").alias("label"), F.lit("g").alias("side")), F.struct(F.col("pred").alias("label"), F.lit("p").alias("side")))
    hit = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))
    long = pairs.select(hit.alias("hit"), F.explode(both).alias("x")).select("hit", "x.*").filter("label is not null")
    agg = long.groupBy("label").agg(
        F.count_if((F.col("side") == "g") & F.col("hit")).alias("tp"),
        F.count_if((F.col("side") == "p") & ~F.col("hit")).alias("fp"),
        F.count_if((F.col("side") == "g") & ~F.col("hit")).alias("fn"),
    )
    return agg.select("*", *(F.round(c, 6).alias(k) for k, c in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()))


def averages(stats: DataFrame) -> DataFrame:
    """One row: micro, macro and support-weighted F1."""
    micro = prf(F.sum("tp"), F.sum("fp"), F.sum("fn"))["f1"]
    support = F.col("tp") + F.col("fn")
    return stats.agg(
        F.round(micro, 6).alias("micro_f1"),
        F.round(F.avg("f1"), 6).alias("macro_f1"),
        F.round(_ratio(F.sum(F.col("f1") * support), F.sum(support)), 6).alias("weighted_f1"),
    )


def confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """Rows by gold label, a column for each label and one for no prediction."""
    pred = F.when(F.col("pred").isin(*labels), F.col("pred")).otherwise("none")
    return pairs.filter("gold is not null").select("gold", pred.alias("pred")).groupBy("gold").pivot("pred", [*labels, "none"]).count().fillna(0)


def running_sums(df: DataFrame, by: str, sums: list[str], falling: bool = False) -> DataFrame:
    """df with running sums in order of ``by`` (columns named run_<sum>), without a single ordered task.

    Rows are range-partitioned; the sums of each partition (a few numbers each) become the offsets of
    those after it. The partitioning is fixed by a checkpoint before both are read.
    """
    key = F.desc(by) if falling else F.asc(by)
    parts = cut_lineage(df.repartitionByRange(key).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    totals = parts.groupBy("__part").agg(*(F.sum(c).alias(c) for c in sums))
    offsets = totals.select("__part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).cast("double").alias(f"__from_{c}") for c in sums))
    w = Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.join(F.broadcast(offsets), "__part")
    return out.withColumns({f"run_{c}": F.sum(c).over(w) + F.col(f"__from_{c}") for c in sums}).drop("__part", *(f"__from_{c}" for c in sums))


#: Distinct values from which a percentile is taken from running counts in place of one task.
PERCENTILE_BOUND = 1_000_000


def percentiles(df: DataFrame, shares: dict[str, float], bound: int = PERCENTILE_BOUND) -> dict[str, float | None]:
    """{column: exact percentile, linear between neighbours} of numeric columns; nulls do not count, no value gives None.

    One pass tells how many distinct values each column has. Up to the bound they fit one task; beyond it the
    values are counted, range-partitioned and numbered by running sums, and only the two neighbours are fetched.
    """
    cols = {c: F.col(c).cast("double") for c in shares}
    sizes = df.agg(*(F.approx_count_distinct(x).alias(c) for c, x in cols.items())).first().asDict()
    few = [c for c in shares if sizes[c] <= bound]
    out = df.agg(*(F.percentile(cols[c], shares[c]).alias(c) for c in few)).first().asDict() if few else {}
    for c in shares:
        if c in out:
            continue
        per = df.select(cols[c].alias("x")).filter("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        run = cut_lineage(running_sums(per, "x", ["n"]))
        at = (run.agg(F.max("run_n")).first()[0] - 1) * shares[c]
        low, high = math.floor(at), math.ceil(at)
        a, b = run.agg(F.min(F.when(F.col("run_n") > low, F.col("x"))), F.min(F.when(F.col("run_n") > high, F.col("x")))).first()
        out[c] = a + (b - a) * (at - low)
    return out


def _score_steps(scored: DataFrame) -> DataFrame:
    """One row per distinct score with cumulative counts from the highest: (score, pos, neg, tp, fp)."""
    per = scored.filter("label is not null and score is not null").groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    run = running_sums(per, "score", ["pos", "neg"], falling=True)
    return run.select("score", "pos", "neg", F.col("run_pos").alias("tp"), F.col("run_neg").alias("fp"))


def curve_metrics(scored: DataFrame) -> DataFrame:
    """(label 0/1, score) -> one row: roc_auc with ties at half, average_precision as a sum of steps."""
    s = _score_steps(scored)
    return s.agg(
        F.round(_ratio(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), F.sum("pos") * F.sum("neg")), 6).alias("roc_auc"),
        F.round(_ratio(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("pos")), 6).alias("average_precision"),
    )


def threshold_metrics(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold tp, fp, fn and measures; the rows are read once, whatever the number of thresholds."""
    s = scored.filter("label is not null and score is not null")
    t = F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold")
    hit = F.col("score") >= F.col("threshold")
    agg = s.select("label", "score", t).groupBy("threshold").agg(
        F.count_if(hit & (F.col("label") == 1)).alias("tp"),
        F.count_if(hit & (F.col("label") != 1)).alias("fp"),
        F.count_if(~hit & (F.col("label") == 1)).alias("fn"),
    )
    return agg.select("*", *(F.round(c, 6).alias(k) for k, c in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()))


def ranking_metrics(judged: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """judged (query_id, rank from 1, relevance), relevant (query_id, relevant) -> one row: mrr, recall_k, ndcg_k."""
    j = judged.filter(F.col("rank") <= k)
    per = j.groupBy("query_id").agg(
        F.min(F.when(F.col("relevance") > 0, F.col("rank"))).alias("first"),
        F.sum((F.col("relevance") > 0).cast("int")).alias("hits"),
        F.sum(F.col("relevance") / F.log2(F.col("rank") + 1.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(F.col("relevant").cast("int"), F.lit(1)))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    q = relevant.join(per, "query_id", "left").select(
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        _ratio(F.coalesce(F.col("hits"), F.lit(0)), F.col("relevant")).alias("recall"),
        F.when(F.col("relevant") > 0, F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"),
    )
    return q.agg(F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("recall"), 6).alias(f"recall_{k}"), F.round(F.avg("ndcg"), 6).alias(f"ndcg_{k}"))


def _cells(df: DataFrame, width: int, name: str) -> DataFrame:
    """Every row once for each cell of the line that its span touches."""
    first, last = F.floor(F.col(f"{name}.start") / width), F.floor((F.col(f"{name}.end") - 1) / width)
    return df.withColumn("cell", F.explode(F.sequence(first, F.greatest(first, last))))


def overlapping(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Spans (doc_id, start, end, ...) of both sides that overlap in the same document.

    The line of a document is cut into cells as wide as the mean span, so spans meet by document and cell, and
    a long document is no hot key; all spans together touch at most twice as many cells as there are spans. A
    pair comes out in the cell where its overlap begins.
    """
    g = gold.select("doc_id", F.struct("start", "end", "label", "id").alias("g"))
    p = pred.select("doc_id", F.struct("start", "end", "label", "id", "score").alias("p"))
    both = gold.select("start", "end").unionByName(pred.select("start", "end")).filter(F.col("end") > F.col("start"))
    width = max(1, math.ceil(both.agg(F.avg(F.col("end") - F.col("start"))).first()[0] or 1))
    g = _cells(g.filter("g.end > g.start"), width, "g")
    p = _cells(p.filter("p.end > p.start"), width, "p")
    begin = F.greatest("g.start", "p.start")
    j = g.join(p, ["doc_id", "cell"]).filter((begin < F.least("g.end", "p.end")) & (F.floor(begin / width) == F.col("cell")))
    return j.drop("cell")


def _chains(spans: DataFrame) -> DataFrame:
    """spans (doc_id, start, end, ...) with ``chain``: spans of different chains of a document do not overlap, even through others."""
    w = Window.partitionBy("doc_id").orderBy("start", F.desc("end"))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.coalesce(F.col("start") >= reach, F.lit(True)), 1).otherwise(0)
    return spans.withColumn("__new", new).withColumn("chain", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def _label_fits(accepted: dict[str, list[str]] | None) -> Column:
    """Equal labels, or one of the accepted labels where the gold label has a list of them."""
    fits = F.col("g.label") == F.col("p.label")
    for label, others in (accepted or {}).items():
        fits = F.when(F.col("g.label") == label, F.col("p.label").isin(*others)).otherwise(fits)
    return fits


def greedy_matches(
    gold: DataFrame, pred: DataFrame, same_label: bool = True, strategy: str = "relaxed", accepted: dict[str, list[str]] | None = None
) -> DataFrame:
    """(doc_id, gold_id, pred_id): each gold span in order takes the best scored free prediction that it fits.

    Strategies: strict (equal spans), relaxed (overlapping spans), text_only (equal text but for letter case,
    which needs a column text on both sides). Scores that are null or not positive count as 1e-9; among
    equals the first span wins. accepted: the predicted labels that do for a gold label, in place of its own.

    The order makes it sequential among spans that compete for the same predictions, so what is resolved by
    itself is a chain of overlapping spans, or all of one place or text; only fitting pairs reach that step, in
    order, and a task holds no more than the ids of one chain.
    """
    if strategy not in ("strict", "relaxed", "text_only"):
        raise ValueError(f"unknown strategy: {strategy}")
    g = gold.select("doc_id", F.struct("*").alias("g"))
    p = pred.select("doc_id", F.struct("*").alias("p"))
    if strategy == "relaxed":
        ends = gold.select("doc_id", "start", "end").unionByName(pred.select("doc_id", "start", "end")).distinct()
        chains = _chains(ends.filter("end > start")).select("doc_id", F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("chain").cast("string").alias("group"))
        pairs = overlapping(gold, pred).withColumns({"__s": F.col("g.start"), "__e": F.col("g.end")}).join(chains, ["doc_id", "__s", "__e"])
    elif strategy == "strict":
        keys = lambda c: [F.col(f"{c}.start").alias("start"), F.col(f"{c}.end").alias("end")]
        pairs = g.select("*", *keys("g")).join(p.select("*", *keys("p")), ["doc_id", "start", "end"]).withColumn("group", F.concat_ws("-", "start", "end"))
    else:
        low = lambda c: F.lower(f"{c}.text").alias("low")
        pairs = g.select("*", low("g")).join(p.select("*", low("p")), ["doc_id", "low"]).withColumn("group", F.col("low"))
    if same_label:
        pairs = pairs.filter(_label_fits(accepted))
    kind = gold.schema["doc_id"].dataType.simpleString()
    flat = pairs.select(
        "doc_id", "group", F.col("g.start").alias("gs"), F.col("g.end").alias("ge"), F.col("g.id").alias("gid"), F.col("p.id").alias("pid"),
        F.greatest(F.col("p.score"), F.lit(1e-9)).alias("score"), F.col("p.start").alias("ps"), F.col("p.end").alias("pe"),
    )

    order = ["doc_id", "group", "gs", "ge", "gid", F.desc("score"), "ps", "pe", "pid"]

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, taken, done = None, set(), set()  # of one group, whose rows follow each other
        for pdf in batches:
            found, gids, pids = [], pdf["gid"].tolist(), pdf["pid"].tolist()
            for n, key in enumerate(zip(pdf["doc_id"], pdf["group"], strict=True)):
                if key != here:
                    here, taken, done = key, set(), set()
                gid, pid = gids[n], pids[n]
                if gid not in done and pid not in taken:
                    done.add(gid)
                    taken.add(pid)
                    found.append(n)
            yield pdf.iloc[found][["doc_id", "gid", "pid"]].set_axis(["doc_id", "gold_id", "pred_id"], axis=1)

    return flat.repartition("doc_id", "group").sortWithinPartitions(*order).mapInPandas(resolve, f"doc_id {kind}, gold_id bigint, pred_id bigint")


def matched_labels(gold: DataFrame, pred: DataFrame, strategy: str, accepted: dict[str, list[str]] | None = None) -> DataFrame:
    """(gold, pred) for label_stats: a match counts for its gold label; the rest of both sides stands alone.

    Golds without a label (those that a label map leaves out) are not counted.
    """
    gold = gold.filter("label is not null")
    m = greedy_matches(gold, pred, strategy=strategy, accepted=accepted)
    g = gold.select("doc_id", F.col("id").alias("gold_id"), F.col("label").alias("gold")).join(m, ["doc_id", "gold_id"], "left")
    p = pred.select("doc_id", F.col("id").alias("pred_id"), F.col("label").alias("pred")).join(m, ["doc_id", "pred_id"], "left_anti")
    hits = g.select("gold", F.when(F.col("pred_id").isNotNull(), F.col("gold")).alias("pred"))
    return hits.unionByName(p.select(F.lit(None).cast("string").alias("gold"), "pred"))


def gold_ladder(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(doc_id, id, verdict): exact, wrong_label, partial or not_found, the best that any prediction reaches."""
    o = overlapping(gold, pred)
    same_span = (F.col("g.start") == F.col("p.start")) & (F.col("g.end") == F.col("p.end"))
    level = F.when(same_span & (F.col("g.label") == F.col("p.label")), 3).when(same_span, 2).otherwise(1)
    best = o.groupBy("doc_id", F.col("g.id").alias("id")).agg(F.max(level).alias("level"))
    verdict = F.when(F.col("level") == 3, "exact").when(F.col("level") == 2, "wrong_label").when(F.col("level") == 1, "partial").otherwise("not_found")
    return gold.select("doc_id", "id").join(best, ["doc_id", "id"], "left").select("doc_id", "id", verdict.alias("verdict"))


def _text_pairs() -> dict[str, Column]:
    """Tests of a gold span g and a prediction p of the same document; null texts and labels fit nothing."""
    g, p = F.lower("g.text"), F.lower("p.text")
    tests = {
        "label": F.col("g.label") == F.col("p.label"),
        "text": g == p,
        # greatest and least skip nulls
        "overlap": F.col("p.start").isNotNull() & F.col("p.end").isNotNull() & (F.greatest("g.start", "p.start") < F.least("g.end", "p.end")),
        "part": F.contains(g, p) | F.contains(p, g),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in tests.items()}


def _with_predictions(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(doc_id, g, p): every gold span beside every prediction of its document, p null where there is none."""
    g = gold.select("doc_id", F.struct("start", "end", "label", "id", "text").alias("g"))
    return g.join(pred.select("doc_id", F.struct("start", "end", "label", "id", "text").alias("p")), "doc_id", "left")


def six_way_ladder(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(doc_id, id, verdict) of spans with text; the first that any prediction of the document reaches.

    matched_exact: text and label; matched_relaxed: overlap and label; wrong_label: text only;
    partial_span: overlap only; text_found_no_label: one text inside the other; not_found.
    """
    t = _text_pairs()
    level = (
        F.when(t["label"] & t["text"], 5).when(t["label"] & t["overlap"], 4).when(t["text"], 3)
        .when(t["overlap"], 2).when(t["part"], 1).otherwise(0)
    )
    names = ["not_found", "text_found_no_label", "partial_span", "wrong_label", "matched_relaxed", "matched_exact"]
    best = _with_predictions(gold, pred).groupBy("doc_id", F.col("g.id").alias("id")).agg(F.max(level).alias("level"))
    return best.select("doc_id", "id", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("level") + 1).alias("verdict"))


def span_recall(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Whatever the predicted label: golds found by text and by overlap, per label and, with label null, of all.

    Golds without a label are not counted.
    """
    t = _text_pairs()
    per = _with_predictions(gold.filter("label is not null"), pred).groupBy("doc_id", "g.id", "g.label").agg(
        F.max(t["text"]).alias("text"), F.max(t["overlap"]).alias("span")
    )
    counts = [F.count("*").alias("total"), F.count_if("text").alias("text_matched"), F.count_if("span").alias("span_matched")]
    both = per.groupBy("label").agg(*counts).unionByName(per.agg(*counts).withColumn("label", F.lit(None).cast("string")))
    pct = lambda c: F.round(100 * F.col(c) / F.greatest("total", F.lit(1)), 1)
    return both.select("*", pct("text_matched").alias("text_recall_pct"), pct("span_matched").alias("span_recall_pct"))


def quartile_diagnosis(docs: DataFrame, gold: DataFrame, pred: DataFrame, misses: int = 10) -> DataFrame:
    """The documents (doc_id) at the quartiles of their number of golds, those without any included.

    (quartile, doc_id, golds, text_matched, relaxed_matched, missed): golds with a label, those with a
    prediction of the same label and text, or the same label and an overlap, and the first that have no
    such text, each with the first text of the same label that is a part of it or has it as a part.
    """
    sizes = docs.select("doc_id").distinct().join(gold.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    ordered = sizes.select("doc_id", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "doc_id").alias("k"), F.lit(1).alias("one"))
    ranks = running_sums(ordered, "k", ["one"]).select("doc_id", (F.col("run_one") - 1).cast("bigint").alias("at"))
    n = ranks.count()
    picks = ranks.select("doc_id", F.explode(F.array(*[F.struct(F.lit(q).alias("quartile"), F.lit(q * n // 4).cast("bigint").alias("place")) for q in (1, 2, 3)])).alias("q"), "at")
    picks = picks.filter("at = q.place").select("doc_id", "q.quartile")
    few = F.broadcast(picks.select("doc_id").distinct())
    t = _text_pairs()
    first = F.min(F.when(t["label"] & t["part"], F.struct("p.start", "p.end", "p.id", "p.text")))
    per = _with_predictions(gold.join(few, "doc_id", "left_semi").filter("label is not null"), pred.join(few, "doc_id", "left_semi")).groupBy(
        "doc_id", "g.start", "g.end", "g.id", "g.text", "g.label"
    ).agg(F.max(t["label"] & t["text"]).alias("hit"), F.max(t["label"] & t["overlap"]).alias("relaxed"), first.alias("first"))
    missed = F.array_sort(F.collect_list(F.when(~F.col("hit"), F.struct("start", "end", "id", "text", "label", F.col("first.text").alias("partial")))))
    found = per.groupBy("doc_id").agg(
        F.count("*").alias("golds"), F.count_if("hit").alias("text_matched"), F.count_if("relaxed").alias("relaxed_matched"), F.slice(missed, 1, misses).alias("missed")
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("golds", "text_matched", "relaxed_matched")]
    return picks.join(found, "doc_id", "left").select("quartile", "doc_id", *zero, "missed")


def ks_statistic(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the largest distance between the two distributions of column x, and both sizes."""
    both = a.select("x", F.lit(1).alias("in_a")).unionByName(b.select("x", F.lit(0).alias("in_a"))).filter("x is not null")
    per = both.groupBy("x").agg(F.sum("in_a").alias("a"), F.sum(1 - F.col("in_a")).alias("b"))
    run = running_sums(per, "x", ["a", "b"])
    n_a, n_b = (x or 0 for x in both.agg(F.sum("in_a"), F.sum(1 - F.col("in_a"))).first())
    gap = F.abs(F.try_divide(F.col("run_a"), F.lit(float(n_a))) - F.try_divide(F.col("run_b"), F.lit(float(n_b))))
    return run.agg(F.lit(n_a).cast("bigint").alias("n_a"), F.lit(n_b).cast("bigint").alias("n_b"), F.round(F.max(gap), 6).alias("d"))


def ks_p_value(d: float, n: int, m: int) -> float:
    """Two-sided p-value by the asymptotic series."""
    if not n or not m:
        return 1.0
    en = math.sqrt(n * m / (n + m))
    lam = (en + 0.12 + 0.11 / en) * d
    if lam < 1e-3:
        return 1.0
    total = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    return min(1.0, max(0.0, total))


def without_overlaps(spans: DataFrame) -> DataFrame:
    """Per document the spans kept when, by start and falling length, each must begin after the last kept one ends.

    Spans that overlap, directly or through others, are resolved together; a document is a series of such chains.
    """
    chains = _chains(spans.select("doc_id", "start", "end", "id").filter("start is not null and end is not null"))
    items = F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("minus_end"), "id")))
    kept = F.aggregate(
        items,
        F.struct(F.lit(-(2**62)).alias("at"), F.array().cast("array<bigint>").alias("ids")),
        lambda acc, x: F.when(
            x["start"] >= acc["at"], F.struct((-x["minus_end"]).alias("at"), F.array_append(acc["ids"], x["id"]).alias("ids"))
        ).otherwise(acc),
        lambda acc: acc["ids"],
    )
    return chains.groupBy("doc_id", "chain").agg(kept.alias("ids")).select("doc_id", F.explode("ids").alias("id"))
