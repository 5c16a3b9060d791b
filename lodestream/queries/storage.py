"""Queries that write to the shared folder and read back, and driver-side search over Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import evaluation as E
from lodestream.operators import features as FE
from lodestream.operators import records as X
from lodestream.operators import search as S
from lodestream.sources import connectors as C
from lodestream.streaming.jobs import scratch
from lodestream.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("select row_id, overall_status, enrollment from aact_studies where agency_class = 'INDUSTRY'")
def delimited_studies(spark: SparkSession, d: str) -> DataFrame:
    """SRC-04, SRC-05, SNK-06, FLT-03: delimited text with a header and a given schema; empty fields are null."""
    path = scratch(spark, "delimited")
    a = table(spark, d, "aact_studies").select("row_id", "overall_status", "enrollment", "agency_class")
    a.write.option("sep", "|").option("header", True).csv(path)
    r = C.delimited(spark, path, "row_id bigint, overall_status string, enrollment int, agency_class string", required=("row_id",))
    return r.filter("agency_class = 'INDUSTRY'").drop("agency_class")


@query("select chembl_id, pref_name, max_phase from molecules")
def json_molecules(spark: SparkSession, d: str) -> DataFrame:
    """SRC-21, SNK-07: JSON records with a given schema."""
    path = scratch(spark, "json")
    C.write_json(table(spark, d, "molecules").select("chembl_id", "pref_name", "max_phase"), path)
    return C.json_records(spark, path, "chembl_id string, pref_name string, max_phase double", multi_line=False)


@query("select c_custkey from customer where c_custkey % 3 = 1 and c_nationkey = 7")
def pruned_split(spark: SparkSession, d: str) -> DataFrame:
    """SRC-03, SPL-03, SNK-01, SRC-01, SRC-02: a table written by split and phase; a filter reads one folder and one column."""
    path = scratch(spark, "splits")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("phase"), F.element_at(F.array(F.lit("test"), F.lit("train"), F.lit("val")), F.pmod("c_custkey", F.lit(3)).cast("int") + 1).alias("split"))
    c.write.partitionBy("phase", "split").parquet(path)
    return C.split_table(spark, path, 7, "train").select("c_custkey")


@query("select cast(ts as date) as dt, count(*)::bigint as n from events group by 1")
def daily_log(spark: SparkSession, d: str) -> DataFrame:
    """SNK-02, SNK-05: appends to a table by day, in two runs; each run is committed as a whole."""
    path = scratch(spark, "log")
    e = table(spark, d, "events").select("event_id", "ts")
    for half in (0, 1):
        C.append_by_day(e.filter(F.col("event_id") % 2 == half), path)
    return spark.read.parquet(path).groupBy("dt").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id::varchar as pmid, lang as title, source as journal from documents where lang is not null")
def xml_articles(spark: SparkSession, d: str) -> DataFrame:
    """SRC-14, SRC-13: article XML to rows."""
    docs = table(spark, d, "documents").filter("lang is not null")
    xml = F.format_string("<A><PMID>%d</PMID><ArticleTitle>%s</ArticleTitle><Journal><Title>%s</Title></Journal></A>", "doc_id", "lang", "source")
    return C.articles_from_xml(docs.select(xml.alias("x")), "x").select("pmid", "title", "journal")


@query("select vec_id, label from embeddings")
def embedding_upsert(spark: SparkSession, d: str) -> DataFrame:
    """SNK-03, GR-02, GR-25, FLT-04: only ids that are not stored yet are added."""
    path = scratch(spark, "vectors")
    v = table(spark, d, "embeddings").select("vec_id", "label")
    v.filter("vec_id % 2 = 0").write.parquet(path)
    have = spark.read.parquet(path)
    v.join(have.select("vec_id"), "vec_id", "left_anti").write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("select event_type as run, round(avg(value), 6) as value from events group by 1 order by 2 desc, 1 limit 2")
def run_log(spark: SparkSession, d: str) -> DataFrame:
    """SNK-11, SRC-24: measures of runs are logged, and the best two runs by one of them."""
    path = scratch(spark, "runs")
    per = table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("top"))
    for r in per.collect():  # one row per kind of event
        C.log_run(spark, path, r["event_type"], {"mean": r["mean"], "top": r["top"]})
    return C.best_run(spark, path, "mean", 2)


_EDGES = "select x_index::varchar as src, y_index::varchar as dst, edge_id::double as weight from primekg where x_index is not null and y_index is not null"


@query(_EDGES)
def graph_file(spark: SparkSession, d: str) -> DataFrame:
    """SRC-22, SNK-04: edges written as GraphML and read back."""
    path = scratch(spark, "graphml")
    kg = table(spark, d, "primekg").filter("x_index is not null and y_index is not null")
    C.write_graphml(kg.select(F.col("x_index").cast("string").alias("src"), F.col("y_index").cast("string").alias("dst"), F.col("edge_id").alias("weight")), path)
    return C.read_graphml(spark, path)


@query("""select nct_id, array_to_string([brief_title] || list_filter(string_split(coalesce(conditions, ''), '|'), lambda x: x <> ''), chr(10)) as text
from ctg_trials where brief_title is not null""")
def assembled_texts(spark: SparkSession, d: str) -> DataFrame:
    """SRC-19: document texts from their passages, of one or several texts each."""
    conditions = F.filter(F.split(F.coalesce("conditions", F.lit("")), r"\|"), lambda x: x != "")
    passages = F.array(F.struct(F.array("brief_title").alias("text")), F.struct(conditions.alias("text")))
    docs = table(spark, d, "ctg_trials").filter("brief_title is not null").select("nct_id", passages.alias("passages"))
    return C.assembled_texts(docs, "nct_id", "passages")


@query("""select unnest(['# Regions', '', '## region', '', '| r_regionkey | r_name |', '|---|---|'] || list('| ' || r_regionkey || ' | ' || r_name || ' |' order by r_regionkey) || ['']) as line from region""")
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """SNK-08: a Markdown report of small results."""
    text = C.markdown_report("Regions", {"region": table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")})
    return spark.createDataFrame([(x,) for x in text.split("\n")], "line string")


@query("select report_id, drug_name, received_at from faers where received_at is not null")
def incremental_load(spark: SparkSession, d: str) -> DataFrame:
    """SNK-12, STM-01, STM-03: a source taken over in three runs from its saved day on; what is there already is left out."""
    rows = table(spark, d, "faers").select("report_id", "drug_name", "received_at")
    state, target = scratch(spark, "state"), scratch(spark, "faers")
    bounds = rows.select(F.percentile_approx("received_at", [0.3, 0.6], 1000)).first()[0]
    for upto in (*bounds, None):
        C.take_over(spark, state, "faers", rows.filter(F.col("received_at") <= F.lit(upto)) if upto else rows, "received_at", target)
    return spark.read.parquet(target)


@query("""select chembl_id as application_number, pref_name as brand_name, upper(molecule_type) as active_ingredients, 'Rx' as marketing_status, '2005-02-04' as approval_date, coalesce(first_in_class, false) as is_orphan from molecules where pref_name <> '' and molecule_type <> ''""")
def flat_approvals(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-09: nested approval applications to one row each."""
    m = table(spark, d, "molecules").filter("pref_name <> '' and molecule_type <> ''")
    product = lambda brand, status, name: F.struct(brand.alias("brand_name"), status.alias("marketing_status"), F.array(F.struct(name.alias("name"))).alias("active_ingredients"))
    none = F.lit(None).cast("string")
    sub = F.struct(
        F.lit("ORIG").alias("submission_type"), F.lit("AP").alias("submission_status"), F.lit("20050204").alias("submission_status_date"),
        F.array(F.struct(F.when(F.col("first_in_class"), "Orphan").alias("code"))).alias("submission_property_type"),
    )
    nested = m.select(
        F.col("chembl_id").alias("application_number"),
        F.array(product(F.lit(""), none, F.col("molecule_type")), product(F.col("pref_name"), F.lit("Rx"), F.upper("molecule_type"))).alias("products"),
        F.array(sub).alias("submissions"),
        F.struct(F.array(none).alias("brand_name"), F.array(none).alias("generic_name")).alias("openfda"),
    )
    return X.flat_approvals(nested)


@query("""select nct_id as doc_id, unnest(range(len(c)))::int as start, c[unnest(range(len(c))) + 1] as text from (select trial_row_id, nct_id, list_filter(string_split(coalesce(conditions, ''), '|'), lambda x: x <> '') as c from ctg_trials)""")
def annotation_rows(spark: SparkSession, d: str) -> DataFrame:
    """SRC-18, SRC-19: entities with offsets, one row each."""
    c = F.filter(F.split(F.coalesce("conditions", F.lit("")), r"\|"), lambda x: x != "")
    docs = table(spark, d, "ctg_trials").select(
        F.col("nct_id").alias("doc_id"),
        F.array(F.struct(F.lit("condition").alias("label"), F.transform(c, lambda x, i: F.array(i, i + F.length(x))).alias("offsets"), c.alias("text"))).alias("entities"),
    )
    return X.annotations(docs).filter("text is not null").select("doc_id", "start", "text")


@query("select p_partkey, round_even(p_retailprice, 0) as whole, round_even(p_retailprice / 7, 2) as part, regexp_matches(lower(p_name), 'part.?1') as hit from part")
def banker_rounding(spark: SparkSession, d: str) -> DataFrame:
    """MTH-02, STR-07: ties to even, and a pattern test."""
    return table(spark, d, "part").select("p_partkey", F.bround("p_retailprice", 0).alias("whole"), F.bround(F.col("p_retailprice") / 7, 2).alias("part"), F.col("p_name").rlike("(?i)part.?1").alias("hit"))


@query("""select c_custkey::varchar as trial_id, f as feature, '' as sub, v as value from (
  select c_custkey, 'segment' as f, c_mktsegment as v from customer union all select c_custkey, 'nation', c_nationkey::varchar from customer where c_custkey % 2 = 0) where v is not null""")
def changed_feature_set(spark: SparkSession, d: str) -> DataFrame:
    """FE-07: features added to and removed from the long table."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("trial_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    old = FE.long(c, "trial_id", ["segment", "balance"])
    add = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("trial_id"), F.lit("nation").alias("feature"), F.lit("").alias("sub"), F.col("c_nationkey").cast("string").alias("value"))
    return old.filter("feature <> 'balance'").unionByName(add)


@query()
def feature_search(spark: SparkSession, d: str) -> DataFrame:
    """FE-08, ML-07, PO-04, PO-05, PO-08, PO-11, PO-12: tree search over feature sets; each set is scored by a Spark job, once."""
    li = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") > 40000).cast("int").alias("label"))
    cols = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"}

    def evaluate(names: tuple[str, ...]) -> tuple[list[float], list[str]]:
        score = sum((F.col(cols[n]) for n in names), F.lit(0.0))
        auc = E.curve_metrics(li.select("label", F.round(score, 2).alias("score"))).first()["roc_auc"]
        return [auc, 1 - len(names) / 50], [n for n in cols if n not in names]

    best = S.tree_search((), evaluate, 6)
    return spark.createDataFrame([(sorted(best.features), best.own[0], best.own[1])], "features array<string>, accuracy double, parsimony double")


@query()
def isolated_updates(spark: SparkSession, d: str) -> DataFrame:
    """STM-07: sources updated side by side; a source that fails does not stop the others."""
    jobs = {t: (lambda t=t: table(spark, d, t).count()) for t in ("faers", "molecules", "no_such_table")}
    out = X.run_all(jobs)
    return spark.createDataFrame([(k, ok, int(v) if ok else None) for k, (ok, v) in sorted(out.items())], "source string, ok boolean, n bigint")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
