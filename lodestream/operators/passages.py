"""Rows to text passages: one builder per source, all giving (text, source, doc_id, date).

Null or blank fields leave their sentence out; rows without any content give no passage. Grouped
builders order their lines by stated keys, so a rerun gives the same text, and cap what the format
caps (thirty edges a node, ten targets a relation, ten drugs a sponsor).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.relational import first_n


def said(label: str, c: Column, end: str = ".") -> Column:
    """'label: value.' or null where the value is null or blank."""
    t = F.trim(c.cast("string"))
    return F.when(t != "", F.concat(F.lit(f"{label}: "), t, F.lit(end)))


def as_passage(df: DataFrame, source: str, doc_id: Column, date: Column, *parts: Column) -> DataFrame:
    """Joins the parts with blanks; rows without any part or without an id give none."""
    text = F.concat_ws(" ", *parts)
    return df.select(
        text.alias("text"), F.lit(source).alias("source"), doc_id.alias("doc_id"), date.cast("string").alias("date")
    ).filter((F.col("text") != "") & F.col("doc_id").isNotNull())


def trial_passages(trials: DataFrame) -> DataFrame:
    c = F.col
    return as_passage(
        trials,
        "ctg",
        c("nct_id"),
        c("start_date"),
        said("Title", c("brief_title")),
        said("Official title", c("official_title")),
        said("Phase", c("phases")),
        said("Type", c("study_type")),
        said("Conditions", F.replace(c("conditions"), F.lit("|"), F.lit(", "))),
        said("Sponsor", c("lead_sponsor")),
        said("Summary", c("brief_summary")),
        said("Eligibility", c("eligibility_criteria")),
    )


def event_passages(events: DataFrame) -> DataFrame:
    """One passage per drug: its events by falling count; the first quarter stands for its date."""
    named = events.filter(F.trim("drug_name") != "")
    lines = named.filter("event is not null").groupBy("drug_name", "event").agg(F.sum("event_count").alias("n"))
    line = F.concat(F.col("event"), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    body = lines.groupBy("drug_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "event", line.alias("l")))), lambda x: x["l"]), "; ").alias("body")
    )
    when = named.groupBy("drug_name").agg(F.min("report_quarter").alias("quarter"))
    both = body.join(when, "drug_name")
    return as_passage(
        both, "faers", F.concat(F.lit("faers-"), F.replace(F.lower("drug_name"), F.lit(" "), F.lit("_"))), F.col("quarter"),
        F.concat(F.lit("Adverse events reported for "), F.col("drug_name"), F.lit(": "), F.col("body"), F.lit(".")),
    )


def sponsor_passages(studies: DataFrame) -> DataFrame:
    """One passage per sponsor and condition: studies, outcomes, latest start, at most ten drugs."""
    g = ["sponsor_name", "condition_name"]
    s = studies.filter("sponsor_name <> '' and condition_name <> ''")
    stats = s.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("overall_status") == "COMPLETED").alias("done"),
        F.count_if(F.col("overall_status").isin("TERMINATED", "WITHDRAWN")).alias("failed"),
        F.max("start_date").alias("latest"),
    )
    drugs = s.filter("intervention_name <> ''").select(*g, "intervention_name").distinct()
    drugs = first_n(drugs, g, [F.col("intervention_name")], 10).groupBy(*g).agg(
        F.array_join(F.array_sort(F.collect_list("intervention_name")), ", ").alias("drugs")
    )
    j = stats.join(drugs, g, "left")
    rate = F.bround(F.try_divide(F.col("done") * 100, F.col("done") + F.col("failed")), 0).cast("int")
    c = F.col
    return as_passage(
        j, "aact",
        F.concat(F.lit("aact-"), F.replace(F.lower("sponsor_name"), F.lit(" "), F.lit("_")), F.lit("-"), F.replace(F.lower("condition_name"), F.lit(" "), F.lit("_"))),
        c("latest"),
        F.concat(c("sponsor_name"), F.lit(" ran "), c("n").cast("string"), F.lit(" studies in "), c("condition_name"), F.lit(".")),
        F.concat(F.lit("Completed "), c("done").cast("string"), F.lit(", stopped "), c("failed").cast("string"), F.lit(".")),
        F.concat(F.lit("Success rate "), rate.cast("string"), F.lit(" percent.")),
        said("Interventions", c("drugs")),
    )


def molecule_passages(molecules: DataFrame) -> DataFrame:
    c = F.col
    return as_passage(
        molecules.filter("pref_name <> ''"), "chembl", c("chembl_id"),
        F.when(c("first_approval").isNotNull(), F.concat(c("first_approval").cast("string"), F.lit("-01-01"))),
        F.concat(c("pref_name"), F.lit(".")),
        said("Type", c("molecule_type")),
        F.when(c("max_phase").isNotNull(), F.concat(F.lit("Highest phase: "), c("max_phase").cast("int").cast("string"), F.lit("."))),
        said("Mechanism", c("mechanism_of_action")),
        said("Targets", F.replace(c("target_names"), F.lit("|"), F.lit(", "))),
        F.when(c("black_box_warning"), F.lit("Carries a boxed warning.")),
        F.when(c("withdrawn_flag"), F.lit("Withdrawn.")),
    )


def graph_passages(edges: DataFrame, per_node: int = 30, per_relation: int = 10) -> DataFrame:
    """One passage per head node of edges that touch a drug or disease."""
    near = edges.filter(F.col("x_type").isin("drug", "disease") | F.col("y_type").isin("drug", "disease"))
    near = near.filter("x_name is not null and y_name is not null")
    g = ["x_name", "x_type", "x_id"]
    some = first_n(near.select(*g, "display_relation", "y_name", "edge_id"), g, [F.col("edge_id")], per_node)
    rel = some.groupBy(*g, "display_relation").agg(F.slice(F.array_sort(F.collect_set("y_name")), 1, per_relation).alias("ys"))
    line = F.concat("display_relation", F.lit(": "), F.array_join("ys", ", "))
    body = rel.groupBy(*g).agg(F.array_join(F.array_sort(F.collect_list(line)), "; ").alias("body"))
    return as_passage(
        body, "primekg",
        F.concat(F.lit("primekg-"), F.replace(F.lower("x_type"), F.lit("/"), F.lit("-")), F.lit("-"), F.col("x_id")),
        F.lit("2000-01-01"),
        F.concat("x_name", F.lit(" ("), F.col("x_type"), F.lit(") "), F.col("body"), F.lit(".")),
    )


def label_passages(documents: DataFrame) -> DataFrame:
    """Texts that are passages already."""
    return as_passage(
        documents, "drugsfda", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.to_date("posted_at"), F.trim("text")
    )


#: Builders by source; callers may register their own.
BUILDERS = {
    "ctg": trial_passages,
    "faers": event_passages,
    "aact": sponsor_passages,
    "chembl": molecule_passages,
    "primekg": graph_passages,
    "drugsfda": label_passages,
}


def all_passages(tables: dict[str, DataFrame]) -> DataFrame:
    """All passages of the sources given; unknown sources raise KeyError, no source ValueError."""
    parts = [BUILDERS[s](df) for s, df in tables.items()]
    if not parts:
        raise ValueError("no source given")
    return reduce(DataFrame.unionByName, parts)
