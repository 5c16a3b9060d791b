"""Queries of the text problems, with SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm import leaks, names, packing, review, split
from lodestream.tables import table

# ---- 2: splitting oversized items ---------------------------------------------------------------


def _p2_items(spark: SparkSession, d: str) -> DataFrame:
    trials = table(spark, d, "ctg_trials").select(
        F.struct(F.lit("ctg_trials").alias("table_name"), F.col("trial_row_id").alias("item_id")).alias("item"),
        F.col("detailed_description").alias("text"),
    )
    chunks = table(spark, d, "passages").select(
        F.struct(F.lit("passages").alias("table_name"), F.col("passage_id").alias("item_id")).alias("item"), "text"
    )
    return trials.unionByName(chunks).withColumn("item", F.to_json("item"))


def _open_item(df: DataFrame) -> DataFrame:
    item = F.from_json("item", "table_name string, item_id bigint")
    return df.withColumn("item", item).select("item.table_name", "item.item_id", *[c for c in df.columns if c != "item"])


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _open_item(split.split_items(_p2_items(spark, d), "item", "text", oversized_only=True))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).filter("piece = 0 and pieces > 1").select("table_name", "item_id")


def p2_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per table: oversized items, their characters, and pieces that break a rule: too long, a gap, too little repeated, another text."""
    cut = p2_pieces(spark, d)
    texts = _open_item(_p2_items(spark, d)).withColumnRenamed("text", "source")
    w = Window.partitionBy("table_name", "item_id").orderBy("piece")
    j = cut.join(texts, ["table_name", "item_id"]).withColumn("before", F.coalesce(F.lag("end").over(w), F.lit(0)))
    size = F.col("end") - F.col("start")
    near = (F.col("overlap") >= F.least(F.lit(split.OVERLAP - split.OVERLAP // 4), "start")) & (F.col("overlap") <= split.OVERLAP)
    same = F.col("text") == F.col("source").substr(F.col("start") - F.col("overlap") + 1, size + F.col("overlap"))
    return j.groupBy("table_name").agg(
        F.count_if(F.col("piece") == 0).alias("items"),
        F.sum(size).alias("characters"),
        F.count_if((F.length("text") > split.LIMIT) | (size <= 0)).alias("too_long"),
        F.count_if(F.col("start") != F.col("before")).alias("gaps"),
        F.count_if(~F.when(F.col("piece") == 0, F.col("overlap") == 0).otherwise(near)).alias("too_little"),
        F.count_if(~same).alias("other_text"),
    )


# ---- 4: variant spellings -----------------------------------------------------------------------


def _p4_linked(spark: SparkSession, d: str) -> DataFrame:
    studies = table(spark, d, "aact_studies")
    sponsors = studies.select(F.lit("sponsor").alias("kind"), F.col("sponsor_name").alias("name"))
    drugs = studies.select(F.lit("drug").alias("kind"), F.col("intervention_name").alias("name"))
    reported = table(spark, d, "faers").select(F.lit("drug").alias("kind"), F.col("drug_name").alias("name"))
    return names.link_names(sponsors.unionByName(drugs).unionByName(reported))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per spelling with its class and the number of other spellings of it."""
    linked = _p4_linked(spark, d)
    sizes = linked.groupBy("kind", "entity").agg((F.count(F.lit(1)) - 1).alias("links"))
    return linked.join(sizes, ["kind", "entity"]).select("kind", "name", "entity", "links")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(_p4_linked(spark, d))


# ---- 7: filling containers ----------------------------------------------------------------------


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return packing.pack(packing.count_tokens(docs, "doc_id", "text"), "doc_id", docs.count())


def p7_fill_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, d))


def p7_audit(spark: SparkSession, d: str) -> DataFrame:
    """One row: texts packed, containers above the capacity, texts cut without need, texts whose parts do not add up."""
    packed = p7_containers(spark, d)
    over = packed.groupBy("container").agg(F.sum("tokens").alias("used")).agg(F.count_if(F.col("used") > packing.CAPACITY)).first()[0]
    sized = packing.count_tokens(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("tokens", "whole")
    per = packed.groupBy("doc_id").agg(F.sum("tokens").alias("got"), F.count(F.lit(1)).alias("parts"), F.max("part").alias("last")).join(sized, "doc_id", "full")
    return per.agg(
        F.lit(over).alias("over"),
        F.count("parts").alias("texts"),
        F.count_if((F.col("parts") > 1) & (F.col("whole") <= packing.CAPACITY)).alias("cut_without_need"),
        F.count_if(~F.equal_null("got", "whole") | (F.col("last") != F.col("parts") - 1)).alias("unequal"),
    )


# ---- 8: evaluation texts in training texts ------------------------------------------------------


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(
        table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text"
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


# ---- 9: abusive, hateful or sexual content ------------------------------------------------------


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, float]:
    model = review.train(table(spark, d, "review_examples"), "example_id", "text", "label")
    return review.score(table(spark, d, "documents"), "doc_id", "text", model, keep=("source",)), model.found_at


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)[0].select("doc_id", "score", "sentence")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    scored, found_at = _scored(spark, d)
    return scored.filter(F.col("score") >= found_at).select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    scored, found_at = _scored(spark, d)
    return review.rates(scored, "source", found_at)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": p2_found,
        "p2_pieces": p2_pieces,
        "p2_audit": p2_audit,
        "p4_found": p4_found,
        "p4_classes": p4_classes,
        "p7_containers": p7_containers,
        "p7_fill_report": p7_fill_report,
        "p7_audit": p7_audit,
        "p8_found": p8_found,
        "p8_leaks": p8_leaks,
        "p9_found": p9_found,
        "p9_scores": p9_scores,
        "p9_rates": p9_rates,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
          select 'ctg_trials' as table_name, trial_row_id as item_id from ctg_trials where length(detailed_description) > 1200
          union all select 'passages', passage_id from passages where length(text) > 1200""",
        "p2_audit": """
          select table_name, count(*)::bigint as items, sum(n)::bigint as characters, 0::bigint as too_long, 0::bigint as gaps, 0::bigint as too_little, 0::bigint as other_text
          from (select 'ctg_trials' as table_name, length(detailed_description) as n from ctg_trials union all select 'passages', length(text) from passages) where n > 1200 group by 1""",
        "p7_audit": "select 0::bigint as over, count(*)::bigint as texts, 0::bigint as cut_without_need, 0::bigint as unequal from documents",
    }


#: Queries that SQL can not state, and what checks them.
CHECKED = {
    "p2_pieces": "p2_audit, by SQL",
    "p4_found": "tests/llm/test_names.py: classes, blocks against brute force",
    "p4_classes": "tests/llm/test_names.py: classes, blocks against brute force",
    "p7_containers": "p7_audit, by SQL",
    "p7_fill_report": "tests/llm/test_packing.py: the rule against brute force",
    "p8_found": "tests/llm/test_leaks.py: against every alignment",
    "p8_leaks": "tests/llm/test_leaks.py: against every alignment",
    "p9_found": "tests/llm/test_review.py: held-out accuracy",
    "p9_scores": "tests/llm/test_review.py: held-out accuracy",
    "p9_rates": "tests/llm/test_review.py: rates of a frame",
}
