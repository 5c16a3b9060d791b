"""Queries of nested records, lookups, budgets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import evaluation as E
from lodestream.operators import passages as P
from lodestream.operators import records as X
from lodestream.operators import relational as R
from lodestream.streaming.jobs import scratch
from lodestream.tables import norm_ref, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _j(camel: str, snake: str) -> str:
    paths = [f"$.protocolSection.{camel}", f"$.{camel}", f"$.{snake}"]
    return "coalesce(" + ", ".join(f"json_extract_string(j, '{p}')" for p in paths) + ")"


def _l(camel: str, snake: str) -> str:
    paths = [f"$.protocolSection.{camel}", f"$.{camel}", f"$.{snake}"]
    return "cast(coalesce(" + ", ".join(f"json_extract(j, '{p}')" for p in paths) + ") as varchar[])"


@query(f"""
with r as (select record_id, try_cast(protocol_section as json) as j from protocols),
f as (select record_id, {_j('identificationModule.nctId', 'identification_module.nct_id')} as nct_id,
 {_j('identificationModule.briefTitle', 'identification_module.brief_title')} as brief_title,
 {_j('statusModule.startDateStruct.date', 'status_module.start_date')} as start_date,
 {_j('designModule.studyType', 'design_module.study_type')} as study_type,
 {_l('designModule.phases', 'design_module.phases')}[1] as phase,
 array_to_string({_l('conditionsModule.conditions', 'conditions_module.conditions')}, '|') as conditions,
 {_j('sponsorCollaboratorsModule.leadSponsor.name', 'sponsor_collaborators_module.lead_sponsor_name')} as lead_sponsor, cast(null as date) as completion_date
 from r where j is not null)
select * from f where nct_id <> ''""")
def flat_protocols(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-05, PRJ-07: nested records to flat rows; the completion date is always null. Unreadable records are left out."""
    p = table(spark, d, "protocols").filter(F.try_parse_json("protocol_section").isNotNull())
    return X.flat_trials(p, "record_id", "protocol_section")


@query("select trial_row_id, nct_id as id, coalesce(official_title, brief_title) as title, study_type as kind from ctg_trials")
def remapped_trials(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-06, PRJ-08: flat columns into nested modules by a mapping; the first mapping that has a value wins."""
    t = table(spark, d, "ctg_trials")
    m = {"trial_row_id": "idModule.row", "nct_id": "idModule.nctId", "official_title": "idModule.title", "brief_title": "idModule.title", "study_type": "designModule.studyType", "unknown": "x.y"}
    n = X.nested_by_mapping(t, m)
    return n.select(F.col("idModule.row").alias("trial_row_id"), F.col("idModule.nctId").alias("id"), F.col("idModule.title").alias("title"), F.col("designModule.studyType").alias("kind"))


@query("""select trial_row_id, list_filter([case when coalesce(trim(official_title), '') = '' then 'official_title' end, case when coalesce(trim(start_date), '') = '' then 'start_date' end], lambda x: x is not null) as lacks
from ctg_trials where coalesce(trim(official_title), '') = '' or coalesce(trim(start_date), '') = ''""")
def rejected_trials(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-10: rows that lack required values, with what they lack."""
    return X.accepted_and_rejected(table(spark, d, "ctg_trials"), ["official_title", "start_date"])[1].select("trial_row_id", "lacks")


@query("""select row_id, ((phase is not null)::int + (enrollment is not null)::int + (brief_title is not null)::int)::int as cells from aact_studies where lower(trim(nct_id)) = (select min(lower(trim(nct_id))) from aact_studies where trim(nct_id) like 'NCT%')""")
def study_details(spark: SparkSession, d: str) -> DataFrame:
    """GR-21, FLT-01, FLT-11: the rows of one id without empty cells and without leaking columns."""
    a = R.without_leaking(table(spark, d, "aact_studies"))
    low = a.filter(F.trim("nct_id").like("NCT%")).agg(F.min(F.lower(F.trim("nct_id")))).first()[0]
    return a.filter(norm_ref("nct_id") == low).select("row_id", F.size(X.present_cells(a, ["phase", "enrollment", "brief_title"])).alias("cells"))


@query("select event_type, count(*)::bigint as n from events where event_type not in ('error', 'signup') and ts >= (select max(ts) - interval 7 day from events) group by 1")
def trailing_week(spark: SparkSession, d: str) -> DataFrame:
    """FLT-12, FLT-13, STM-05, DT-06: some labels left out, the last seven days only."""
    e = table(spark, d, "events")
    end = e.agg(F.max("ts")).first()[0]
    return e.filter(~F.col("event_type").isin("error", "signup") & (F.col("ts") >= F.lit(end).cast("timestamp_ntz") - F.expr("interval 7 days"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""with c as (select intervention_type as label, count(*) as n from aact_studies group by 1)
select l.label, coalesce(n, 0)::bigint as n, case when coalesce(n, 0) = 0 then 'none' when n < 100 then 'few' else 'enough' end as bucket from (values ('DRUG'), ('BIOLOGICAL'), ('DEVICE'), ('GENETIC')) l(label) left join c using (label)""")
def label_gaps(spark: SparkSession, d: str) -> DataFrame:
    """AGG-15."""
    c = table(spark, d, "aact_studies").groupBy(F.col("intervention_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return X.gap_buckets(c, ["DRUG", "BIOLOGICAL", "DEVICE", "GENETIC"])


@query("""select agency_class, round(avg((phase is null)::int), 6) as none_rate, mode(case when why_stopped is null then 'none' when regexp_matches(lower(why_stopped), 'fund|sponsor|business') then 'money' when regexp_matches(lower(why_stopped), 'enrol|recruit|accru') then 'enrolment' else 'other' end) as commonest
from aact_studies group by 1 having avg((phase is null)::int) >= 0.05""")
def failure_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """AGG-16, SRT-06: rate of missing values and commonest reason per group; rates under 5 % are left out."""
    why = F.lower("why_stopped")
    reason = F.when(why.isNull(), "none").when(why.rlike("fund|sponsor|business"), "money").when(why.rlike("enrol|recruit|accru"), "enrolment").otherwise("other")
    g = table(spark, d, "aact_studies").groupBy("agency_class").agg(F.avg(F.col("phase").isNull().cast("int")).alias("r"), F.mode(reason).alias("commonest"))
    return g.filter("r >= 0.05").select("agency_class", F.round("r", 6).alias("none_rate"), "commonest")


@query("select event_type as feature, round(avg(abs(value - 50)), 4) as mean_abs, count(*)::bigint as n from events group by 1")
def mean_contributions(spark: SparkSession, d: str) -> DataFrame:
    """AGG-19, SRT-04."""
    e = table(spark, d, "events").select(F.col("event_type").alias("feature"), F.abs(F.col("value") - 50).alias("v"))
    return e.groupBy("feature").agg(F.round(F.avg("v"), 4).alias("mean_abs"), F.count(F.lit(1)).alias("n"))


@query("""select user_id, round(avg(case when event_type = 'view' then value end) - avg(case when event_type = 'click' then value end), 4) as gain, (count(*) filter (where event_type = 'view'))::bigint as views from events group by 1""")
def paired_means(spark: SparkSession, d: str) -> DataFrame:
    """AGG-25, EV-05, EV-10: paired means of two variants per seed, and their difference."""
    e = table(spark, d, "events")
    m = lambda t: F.avg(F.when(F.col("event_type") == t, F.nanvl("value", F.lit(None).cast("double"))))
    return e.groupBy("user_id").agg(F.round(m("view") - m("click"), 4).alias("gain"), F.count_if(F.col("event_type") == "view").alias("views"))


@query("""with l as (select lower(drug_name) as k, count(*) as n from faers where drug_name <> '' group by 1)
select sum(n)::bigint as lookups, sum(case when k in (select lower(pref_name) from molecules) then n else 0 end)::bigint as hits, round(sum(case when k in (select lower(pref_name) from molecules) then n else 0 end) / sum(n), 6) as rate from l""")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """AGG-26, AGG-29, ML-10: lookups, hits and their rate; lookups shrink to one row per key first."""
    l = table(spark, d, "faers").filter("drug_name <> ''").groupBy(F.lower("drug_name").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    m = table(spark, d, "molecules").filter("pref_name is not null").select(F.lower("pref_name").alias("k"), F.lit(1).alias("hit")).distinct()
    j = l.join(m, "k", "left")
    hits = F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0))
    return j.agg(F.sum("n").alias("lookups"), hits.alias("hits"), F.round(hits / F.sum("n"), 6).alias("rate"))


@query("select l_orderkey, arg_min(l_linenumber, (l_discount, l_linenumber)) as riskiest, max(l_extendedprice) as largest from lineitem group by 1")
def top_risks(spark: SparkSession, d: str) -> DataFrame:
    """AGG-28."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct("l_discount", "l_linenumber")).alias("riskiest"), F.max("l_extendedprice").alias("largest"))


@query("""select doc_id, nct_id, used::bigint as used from (select doc_id, nct_id, sum(greatest(length(text), 1)) over (partition by nct_id order by doc_id rows between unbounded preceding and current row) as used
 from documents where nct_id is not null and text is not null) where used <= 8000""")
def text_budget(spark: SparkSession, d: str) -> DataFrame:
    """WIN-11: texts of a trial until 8,000 characters are full."""
    docs = table(spark, d, "documents").filter("nct_id is not null and text is not null").select("doc_id", "nct_id", F.length("text").alias("n"))
    return X.within_budget(docs, "nct_id", "doc_id", F.col("n"), 8000).select("doc_id", "nct_id", "used")


@query("""select drug_name, event, sum(event_count)::bigint as n from faers where lower(trim(drug_name)) = 'zabuvuvutomab' and received_at < timestamp '2016-01-01' and event is not null group by 1, 2 order by n desc, event, drug_name limit 10""")
def drug_event_report(spark: SparkSession, d: str) -> DataFrame:
    """SRC-15, SRC-12: the commonest events of one drug before a date."""
    f = table(spark, d, "faers").filter((F.lower(F.trim("drug_name")) == "zabuvuvutomab") & (F.col("received_at") < F.lit("2016-01-01").cast("timestamp_ntz")) & F.col("event").isNotNull())
    return f.groupBy("drug_name", "event").agg(F.sum("event_count").alias("n")).orderBy(F.desc("n"), "event", "drug_name").limit(10)


@query("""select doc_id, lang from documents where doc_id % 10 = 0 union all (select doc_id, lang from documents where doc_id % 10 <> 0 order by doc_id limit 200)""")
def judged_collection(spark: SparkSession, d: str) -> DataFrame:
    """SRC-20: all judged documents and a capped number of others."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return X.judged_and_some(docs, docs.filter("doc_id % 10 = 0").select("doc_id"), "doc_id", 200)


@query("select user_id, max(value) as best, arg_max(event_id, (value, -event_id)) as run from events group by 1 order by best desc, user_id limit 100")
def best_runs(spark: SparkSession, d: str) -> DataFrame:
    """SRC-24, ML-08, SRT-08: the best run of each name, at most a hundred, by its metric."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("best"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("run"))
    return e.orderBy(F.desc("best"), "user_id").limit(100)


@query("""with t as (select user_id, sum(value) as total, count(*) as visits from events group by 1), p as (select sum(visits) as pv from t)
select user_id, round(total / visits + 0.5 * sqrt(ln(greatest(pv, 1)) / visits), 5) as ucb, greatest(2, least(8, floor(log2(visits) + 2)))::int as branching from t, p""")
def ucb_scores(spark: SparkSession, d: str) -> DataFrame:
    """PO-05, PO-09, MTH-01: upper confidence bounds and adaptive branching, as column expressions."""
    t = table(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("visits"))
    pv = table(spark, d, "events").count()
    b = F.greatest(F.lit(2), F.least(F.lit(8), F.floor(F.log2(F.col("visits").cast("double")) + 2).cast("int")))
    return t.select("user_id", F.round(X.ucb_columns(t, "total", "visits", F.lit(pv), 0.5), 5).alias("ucb"), b.alias("branching"))


@query("""with c as (select n_name, r_name, count(*) as n, sum(c_acctbal) as s from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2)
select n_name as node, n::bigint as visits, round(s / n, 4) as mean from c union all select r_name, sum(n)::bigint, round(sum(s) / sum(n), 4) from c group by 1 union all select 'ROOT', sum(n)::bigint, round(sum(s) / sum(n), 4) from c""")
def values_to_root(spark: SparkSession, d: str) -> DataFrame:
    """PO-06: sums carried from leaves to the root, as states of (visits, sum) per level."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("s"))
    leaf = c.join(table(spark, d, "nation"), "n_nationkey").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    up = leaf.select(F.explode(F.array("n_name", "r_name", F.lit("ROOT"))).alias("node"), "n", "s")
    return up.groupBy("node").agg(F.sum("n").alias("visits"), F.round(F.sum("s") / F.sum("n"), 4).alias("mean"))


@query("""with l as (select gold, case when v = 'a' then pa else pb end as pred, v from (select l_returnflag as gold, case when l_linenumber % 3 = 0 then 'N' else l_returnflag end as pa, case when l_linenumber % 2 = 0 then 'N' else l_returnflag end as pb from lineitem), (values ('a'), ('b')) x(v)),
s as (select v, lab, 2.0 * count(*) filter (where gold = lab and pred = lab) / nullif(count(*) filter (where gold = lab) + count(*) filter (where pred = lab), 0) as f1 from l, (values ('A'), ('N'), ('R')) y(lab) group by 1, 2)
select lab as label, round(max(f1) filter (where v = 'b') - max(f1) filter (where v = 'a'), 5) as delta_f1 from s group by 1""")
def variant_deltas(spark: SparkSession, d: str) -> DataFrame:
    """EV-05, EV-12: F1 of two variants per label, and the difference."""
    li = table(spark, d, "lineitem")
    stats = []
    for n in (3, 2):
        pred = F.when(F.col("l_linenumber") % n == 0, "N").otherwise(F.col("l_returnflag"))
        stats.append(E.label_stats(li.select(F.col("l_returnflag").alias("gold"), pred.alias("pred"))).select("label", "f1"))
    j = stats[0].withColumnRenamed("f1", "a").join(stats[1].withColumnRenamed("f1", "b"), "label")
    return j.select("label", F.round(F.col("b") - F.col("a"), 5).alias("delta_f1"))


@query("select vec_id, label, place::int as place from (values (0, 7), (1, 3), (2, 11)) t(place, vec_id) join embeddings using (vec_id)")
def vectors_in_order(spark: SparkSession, d: str) -> DataFrame:
    """GR-24."""
    return X.in_order_of([7, 3, 11], table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")


@query("""select 'Title: ' || trim(brief_title) || '.' || case when trim(brief_summary) <> '' then ' Abstract: ' || trim(brief_summary) || '.' else '' end as text, 'pubmed' as source, trial_row_id::varchar as doc_id, start_date as date from ctg_trials where trim(brief_title) <> ''""")
def article_passages(spark: SparkSession, d: str) -> DataFrame:
    """PSG-02, STR-12: an article's title and abstract as a passage."""
    t = table(spark, d, "ctg_trials").filter(F.trim("brief_title") != "")
    return P.as_passage(t, "pubmed", F.col("trial_row_id").cast("string"), F.col("start_date"), P.said("Title", F.col("brief_title")), P.said("Abstract", F.col("brief_summary")))


@query("select passage_id, left(date, 4) || '-' || substr(date, 5, 2) || '-' || substr(date, 7, 2) as iso from passages where regexp_matches(date, '^\\d{8}$')")
def packed_dates(spark: SparkSession, d: str) -> DataFrame:
    """DT-03: YYYYMMDD to ISO, without a calendar check."""
    p = table(spark, d, "passages").filter(F.col("date").rlike(r"^\d{8}$"))
    return p.select("passage_id", F.regexp_replace("date", r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3").alias("iso"))


@query("""select 'molecules' as source, false as rebuilt, count(*)::bigint as n from molecules union all select 'ctg_trials', false, count(*)::bigint from ctg_trials
union all select 'faers', true, count(*)::bigint from faers where drug_name is not null""")
def rebuilt_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """STM-09, SNK-12: in a second run only the source whose rows differ is rebuilt."""
    folder = scratch(spark, "snapshots")
    run = lambda s: X.rebuild_changed(spark, f"{folder}/state", s, lambda name, df: df.write.mode("overwrite").parquet(f"{folder}/{name}"))
    sources = {t: table(spark, d, t) for t in ("molecules", "faers", "ctg_trials")}
    run(sources)
    done = run(sources | {"faers": sources["faers"].filter("drug_name is not null")})
    rows = [(t, again, spark.read.parquet(f"{folder}/{t}").count()) for t, again in done.items()]
    return spark.createDataFrame(rows, "source string, rebuilt boolean, n bigint")


_STUDY_TEXTS = ["why_stopped", "intervention_description", "official_title", "agency_class", "source"]


@query("select unnest([" + ", ".join(f"case when count({c}) >= 2 then '{c}' end" for c in _STUDY_TEXTS) + "]) as name from aact_studies where overall_status = 'COMPLETED'")
def filled_columns(spark: SparkSession, d: str) -> DataFrame:
    """FLT-14: columns with at least two values, null in place of the others."""
    s = table(spark, d, "aact_studies").filter("overall_status = 'COMPLETED'").select(*_STUDY_TEXTS)
    good = R.filled_columns(s)
    return spark.createDataFrame([(c if c in good else None,) for c in _STUDY_TEXTS], "name string")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
