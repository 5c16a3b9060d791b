"""Queries of the relational part: scans, filters, joins, aggregations, upserts, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions import text as T
from lodestream.functions.dates import iso_day, parse_partial
from lodestream.operators import relational as R
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


_STUDY = """
with one as (
  select k, arg_min(overall_status, row_id) as overall_status, arg_min(phase, row_id) as phase, arg_min(sponsor_name, row_id) as sponsor_name
  from (select lower(trim(nct_id)) as k, row_id, coalesce(overall_status, '') as overall_status, coalesce(phase, '') as phase, coalesce(sponsor_name, '') as sponsor_name from aact_studies where trim(nct_id) <> '') group by k)
"""


@query(
    _STUDY
    + """select sponsor_name, count(*)::bigint as trials,
  count(*) filter (where regexp_matches(lower(phase), 'phase ?1'))::bigint as phase1,
  count(*) filter (where regexp_matches(lower(phase), 'phase ?2'))::bigint as phase2,
  count(*) filter (where regexp_matches(lower(phase), 'phase ?3'))::bigint as phase3,
  count(*) filter (where overall_status = 'COMPLETED')::bigint as completed,
  count(*) filter (where overall_status in ('TERMINATED', 'WITHDRAWN'))::bigint as stopped,
  round(count(*) filter (where overall_status = 'COMPLETED') / nullif(count(*) filter (where overall_status in ('COMPLETED', 'TERMINATED', 'WITHDRAWN')), 0), 6) as success_rate
from one group by 1"""
)
def sponsor_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01: one row per trial first, then outcome counts and success rate per sponsor."""
    s = table(spark, d, "aact_studies").select(
        norm_ref("nct_id").alias("k"), "row_id", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("overall_status", "phase", "sponsor_name"))
    )
    one = R.one_per_key(s.filter("k is not null"), ["k"], [F.col("row_id")], ["overall_status", "phase", "sponsor_name"])
    return R.outcome_stats(one, ["sponsor_name"], "overall_status", "phase")


@query("""
with one as (
  select k, condition_name, arg_min(overall_status, row_id) as overall_status, arg_min(e, row_id) as e
  from (select lower(trim(nct_id)) as k, row_id, coalesce(overall_status, '') as overall_status, coalesce(enrollment, -1) as e, condition_name from aact_studies
        where trim(nct_id) <> '' and condition_name is not null) group by 1, 2)
select condition_name, count(*)::bigint as trials, round(avg(nullif(e, -1)), 4) as mean_enrollment,
  round(count(*) filter (where overall_status = 'COMPLETED') / nullif(count(*) filter (where overall_status in ('COMPLETED', 'TERMINATED', 'WITHDRAWN')), 0), 6) as success_rate
from one group by 1""")
def condition_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG-02: one row per trial and condition, then counts, mean enrolment and success rate."""
    s = table(spark, d, "aact_studies").select(
        norm_ref("nct_id").alias("k"), "row_id", "condition_name",
        F.coalesce(F.col("overall_status"), F.lit("")).alias("overall_status"), "enrollment",
    )
    s = s.filter("k is not null and condition_name is not null")
    one = R.one_per_key(s, ["k", "condition_name"], [F.col("row_id")], ["overall_status", "enrollment"])
    return R.outcome_stats(one, ["condition_name"], "overall_status", value="enrollment").drop("completed", "stopped")


@query("""
select o_orderkey, c_name, n_name, r_name from orders left join customer on o_custkey = c_custkey
left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def left_join_chain(spark: SparkSession, d: str) -> DataFrame:
    """JN-01: a chain of left joins from a fact table to its dimensions."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    out = R.left_chain(o, [(c, "c_custkey"), (n, "n_nationkey"), (r, "r_regionkey")])
    return out.select("o_orderkey", "c_name", "n_name", "r_name")


@query("""
select p_partkey, p_name, s.suppliers, s.quantity, o.first_ship from part
left join (select l_partkey, count(distinct l_suppkey)::bigint as suppliers, round(sum(l_quantity), 2) as quantity from lineitem group by 1) s on p_partkey = s.l_partkey
left join (select l_partkey, min(l_shipdate) as first_ship from lineitem group by 1) o on p_partkey = o.l_partkey""")
def aggregated_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """JN-02: dimensions are aggregated to one row per key before they are joined, so nothing fans out."""
    li = table(spark, d, "lineitem")
    both = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count_distinct("l_suppkey").alias("suppliers"),
        F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.min("l_shipdate").alias("first_ship"),
    )
    return table(spark, d, "part").select("p_partkey", "p_name").join(both, "p_partkey", "left")


@query("""
select m.chembl_id, m.pref_name, count(a.row_id)::bigint as studies from molecules m
join aact_studies a on lower(trim(a.intervention_name)) = lower(m.pref_name) group by 1, 2""")
def studies_per_molecule(spark: SparkSession, d: str) -> DataFrame:
    """JN-03: inner join on a folded name; study rows are counted per name before the join."""
    m = table(spark, d, "molecules").select("chembl_id", "pref_name", F.lower("pref_name").alias("k"))
    a = table(spark, d, "aact_studies").groupBy(F.lower(F.trim("intervention_name")).alias("k")).agg(F.count("row_id").alias("studies"))
    return m.join(a, "k").select("chembl_id", "pref_name", "studies")


@query("""
select l_suppkey, string_agg(l_returnflag, '|' order by l_returnflag) as "values" from (select distinct l_suppkey, l_returnflag from lineitem) group by 1""")
def joined_flags(spark: SparkSession, d: str) -> DataFrame:
    """AGG-03: distinct values of a group as one ordered text."""
    return R.joined_distinct(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag")


@query("""select drug_name, arg_min(report_quarter, report_id) as first_quarter from faers where drug_name is not null and report_quarter is not null group by 1""")
def first_quarter(spark: SparkSession, d: str) -> DataFrame:
    """AGG-04: the first non-null value of a group by a stated order."""
    f = table(spark, d, "faers").filter("drug_name is not null and report_quarter is not null")
    return f.groupBy("drug_name").agg(F.min_by("report_quarter", "report_id").alias("first_quarter"))


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "ctg_trials").select("trial_row_id", "nct_id", "brief_title", "first_posted_at")
    cut = F.lit("2015-01-01").cast("timestamp")
    late = table(spark, d, "ctg_trials").select("trial_row_id", "nct_id", F.upper("brief_title").alias("brief_title"), "first_posted_at")
    old = R.keep_last(t.filter(F.col("first_posted_at") < cut), ["nct_id"], ["trial_row_id"])
    return old, late.filter(F.col("first_posted_at") >= F.lit("2013-01-01").cast("timestamp"))


_HALVES = """
with old as (select * from (select trial_row_id, nct_id, brief_title, first_posted_at, row_number() over (partition by nct_id order by trial_row_id desc) as rn
    from ctg_trials where first_posted_at < timestamp '2015-01-01') where rn = 1),
new as (select * from (select trial_row_id, nct_id, upper(brief_title) as brief_title, first_posted_at, row_number() over (partition by nct_id order by trial_row_id desc) as rn
    from ctg_trials where first_posted_at >= timestamp '2013-01-01') where rn = 1)
"""


@query(
    _HALVES
    + """select trial_row_id, nct_id, brief_title, first_posted_at from old where nct_id not in (select nct_id from new)
union all select trial_row_id, nct_id, brief_title, first_posted_at from new"""
)
def upsert_trials(spark: SparkSession, d: str) -> DataFrame:
    """JN-04, STM-02: incoming rows replace those of the same key, all others stay."""
    old, new = _halves(spark, d)
    return R.upsert(old, new, ["nct_id"], ["trial_row_id"])


@query(
    _HALVES
    + """select (select count(*) from new where nct_id not in (select nct_id from old))::bigint as added,
  (select count(*) from new where nct_id in (select nct_id from old))::bigint as updated,
  (select count(*) from (select nct_id from old union select nct_id from new))::bigint as total"""
)
def upsert_counts(spark: SparkSession, d: str) -> DataFrame:
    """JN-05, AGG-08: numbers of added, updated and total keys from one aggregation."""
    old, new = _halves(spark, d)
    return R.upsert_counts(old, new, "nct_id")


@query("""select distinct lower(trim(drug_name)) as name from faers where drug_name is not null
and lower(trim(drug_name)) not in (select lower(trim(intervention_name)) from aact_studies where intervention_name is not null)""")
def names_not_cached(spark: SparkSession, d: str) -> DataFrame:
    """JN-06, STM-03: names to fetch, less those that are there already."""
    name = lambda c: F.lower(F.trim(F.col(c))).alias("name")
    want = table(spark, d, "faers").filter("drug_name is not null").select(name("drug_name")).distinct()
    have = table(spark, d, "aact_studies").filter("intervention_name is not null").select(name("intervention_name"))
    return R.not_cached(want, have, ["name"])


@query("""select user_id, event_type, event_id, ts, value from (
  select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1""")
def last_event_per_user(spark: SparkSession, d: str) -> DataFrame:
    """WIN-01: the last row of each key."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return R.keep_last(e, ["user_id", "event_type"], ["ts", "event_id"])


@query("""select edge_id, x_name, y_name from primekg where (lower(x_name) = 'zentalin' and x_type = 'drug') or (lower(y_name) = 'zentalin' and y_type = 'drug')""")
def edges_of_drug(spark: SparkSession, d: str) -> DataFrame:
    """FLT-06: an endpoint of a name and type on either side."""
    kg = table(spark, d, "primekg")
    return R.either_end(kg, "Zentalin", (("x_name", "x_type"), ("y_name", "y_type")), "drug").select("edge_id", "x_name", "y_name")


@query("""select relation, count(*)::bigint as edges from primekg where x_type in ('drug', 'disease') or y_type in ('drug', 'disease') group by 1""")
def edges_touching_drug_or_disease(spark: SparkSession, d: str) -> DataFrame:
    """FLT-07."""
    kg = table(spark, d, "primekg")
    return kg.filter(F.col("x_type").isin("drug", "disease") | F.col("y_type").isin("drug", "disease")).groupBy("relation").agg(F.count(F.lit(1)).alias("edges"))


@query("select chembl_id, pref_name from molecules where contains(lower(mechanism_of_action), 'inhibitor') and max_phase >= 1.0")
def molecules_by_mechanism(spark: SparkSession, d: str) -> DataFrame:
    """FLT-02, FLT-05: a literal text search, letter case ignored, and a threshold."""
    m = table(spark, d, "molecules").filter(F.col("max_phase") >= 1.0)
    return R.containing(m, "mechanism_of_action", "Inhibitor").select("chembl_id", "pref_name")


@query("select p_partkey, p_name from part where regexp_matches(lower(p_name), '^[a-m].*[a-z]{4,}$')")
def parts_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    """FLT-05: the same with a regular expression, on request only."""
    return R.containing(table(spark, d, "part"), "p_name", "^[A-M].*[a-z]{4,}$", regex=True).select("p_partkey", "p_name")


@query("""select passage_id, doc_id, date from passages where regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}') and try_cast(left(date, 10) as date) < date '2015-06-01' and source in ('ctg', 'pubmed')""")
def passages_before(spark: SparkSession, d: str) -> DataFrame:
    """FLT-08, FLT-09, DT-01: strictly before a cutoff, from some sources; undated rows never match."""
    p = table(spark, d, "passages").filter(F.col("source").isin("ctg", "pubmed"))
    return R.before(p, iso_day("date"), "2015-06-01").select("passage_id", "doc_id", "date")


_LEAK_NAMES = """
overallStatus overall_status overallstatus completion_date completionDate completiondate resultsPosted results_posted resultsposted
whyStopped why_stopped whystopped primaryCompletionDate primary_completion_date resultsSection results_section statusVerifiedDate
status_verified_date dispositionModule disposition_module last_status lastKnownStatus Study-Completion-Date
briefTitle nctId studyType phase eligibilityCriteria startDate conditions interventions enrollment white_label outcome_measures
""".split()
_LEAK_PARTS = "overallstatus|laststatus|lastknownstatus|whystopped|resultssection|resultsposted|resultsfirst(posted|submitted)|completiondate|dispositionmodule|statusverifieddate"


@query(f"""select f.trial_row_id, n.name, regexp_matches(replace(replace(lower(n.name), '-', ''), '_', ''), '{_LEAK_PARTS}') as leaks
from ctg_trials f, (values {", ".join(f"('{n}')" for n in _LEAK_NAMES)}) n(name)""")
def leaking_fields(spark: SparkSession, d: str) -> DataFrame:
    """FLT-10: field names of delivered records, told apart by what they give away."""
    name = F.explode(F.array(*map(F.lit, _LEAK_NAMES))).alias("name")
    return table(spark, d, "ctg_trials").select("trial_row_id", name).select("trial_row_id", "name", R.leaking_name(F.col("name")).alias("leaks"))


@query("select * exclude (overall_status, completion_date, why_stopped) from aact_studies")
def studies_without_leaks(spark: SparkSession, d: str) -> DataFrame:
    """FLT-10: columns that give away the outcome are dropped at plan time."""
    return R.without_leaking(table(spark, d, "aact_studies"))


@query("select trial_row_id, nct_id, brief_title, cast(null as date) as completion_date, cast(null as varchar) as secondary_id from ctg_trials where lower(trim(nct_id)) = 'nct10257421' or nct_id = (select min(nct_id) from ctg_trials)")
def trial_lookup(spark: SparkSession, d: str) -> DataFrame:
    """FLT-01, PRJ-03: rows by id, with columns that are missing added as nulls."""
    t = table(spark, d, "ctg_trials").select("trial_row_id", "nct_id", "brief_title")
    low = t.agg(F.min("nct_id")).first()[0]
    hit = t.filter((norm_ref("nct_id") == "nct10257421") | (F.col("nct_id") == low))
    return R.with_columns_present(hit, {"completion_date": "date", "secondary_id": "string"})


@query("select trial_row_id as id, brief_title as title, lead_sponsor as sponsor, cast(null as varchar) as sex from ctg_trials")
def aliased_columns(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-01, PRJ-04: columns by the first alias that is present."""
    return R.aliased(
        table(spark, d, "ctg_trials"),
        {"id": ["trialRowId", "trial_row_id"], "title": ["briefTitle", "brief_title"], "sponsor": ["leadSponsor", "lead_sponsor"], "sex": ["sex"]},
    )


@query("select event_id, try_cast(json_extract_string(props, '$.k') as int) as k, try_cast(event_type as double) as bad from events")
def lenient_casts(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-02, JSN-01: what can not be cast is null."""
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.col("event_type").try_cast("double").alias("bad"))


@query("""select c_custkey, o_orderkey, o_orderdate, rank from (select o_custkey as c_custkey, o_orderkey, o_orderdate,
  row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::int as rank from orders) where rank <= 3""")
def first_three_orders(spark: SparkSession, d: str) -> DataFrame:
    """WIN-04: the first rows of each group."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return R.first_n(o, ["c_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 3)


@query("""select event, sum(event_count)::bigint as amount, round(sum(event_count)::double / (select sum(event_count) from faers)::double, 6) as share from faers group by 1""")
def event_shares(spark: SparkSession, d: str) -> DataFrame:
    """AGG-24: amounts and their share of the whole."""
    return R.share_of_total(table(spark, d, "faers"), ["event"], F.col("event_count"))


@query("""select l_orderkey, l_linenumber, round(l_quantity / sum(l_quantity) over (partition by l_orderkey), 6) as weight from lineitem""")
def normalised_weights(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10: each value as a share of its group."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    total = F.sum("l_quantity").over(Window.partitionBy("l_orderkey"))
    return li.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") / total, 6).alias("weight"))


@query("""select p_partkey, round((p_retailprice - lo) / nullif(hi - lo, 0), 6) as scaled from part, (select min(p_retailprice) as lo, max(p_retailprice) as hi from part)""")
def min_max_scaled(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11: values between 0 and 1; a constant column gives ones."""
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    lo, hi = p.agg(F.min("p_retailprice"), F.max("p_retailprice")).first()
    scaled = F.lit(1.0) if lo == hi else F.round((F.col("p_retailprice") - F.lit(lo)) / F.lit(hi - lo if lo is not None else None), 6)
    return p.select("p_partkey", scaled.alias("scaled"))


@query("""select source, count(*)::bigint as n, count(*) > 0 as present from passages group by 1""")
def rows_per_source(spark: SparkSession, d: str) -> DataFrame:
    """AGG-09: rows per source."""
    return table(spark, d, "passages").groupBy("source").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 0).alias("present"))


@query("""select (count(*) * 4)::bigint as cells, (count(*) - count(overall_status) + count(*) - count(phase) + count(*) - count(enrollment) + count(*) - count(why_stopped))::bigint as missing,
  round((count(*) * 4 - count(overall_status) - count(phase) - count(enrollment) - count(why_stopped)) / (count(*) * 4), 6) as rate from aact_studies""")
def missing_cells(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18: share of missing cells over some columns."""
    return R.missing_rate(table(spark, d, "aact_studies"), ["overall_status", "phase", "enrollment", "why_stopped"])


@query("""select 'phase' as column_name, (count(*) - count(phase))::bigint as missing from aact_studies union all
select 'why_stopped', (count(*) - count(why_stopped))::bigint from aact_studies""")
def missing_by_column(spark: SparkSession, d: str) -> DataFrame:
    """AGG-16, AGG-23, FLT-14: null counts per column by one aggregation and an unpivot."""
    return R.missing_per_column(table(spark, d, "aact_studies"), ["phase", "why_stopped"])


@query("""
with l as (select lower(trim(nct_id)) as k, max(enrollment) as e from aact_studies where trim(nct_id) <> '' group by 1),
     r as (select lower(trim(nct_id)) as k, count(*)::int as e from documents where trim(nct_id) <> '' group by 1)
select k, case when r.k is not null then r.e else l.e end as e from l full join r using (k)""")
def merged_right_wins(spark: SparkSession, d: str) -> DataFrame:
    """JN-12, MAP-01: a full merge where the right side wins."""
    l = table(spark, d, "aact_studies").select(norm_ref("nct_id").alias("k"), "enrollment").filter("k is not null").groupBy("k").agg(F.max("enrollment").alias("e"))
    r = table(spark, d, "documents").select(norm_ref("nct_id").alias("k")).filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).cast("int").alias("e"))
    return R.merged(l, r, ["k"], ["e"])


@query("""select 'both' as side, count(*)::bigint as keys from (select lower(pref_name) from molecules where pref_name is not null intersect select lower(drug_name) from faers where drug_name is not null)
union all select 'molecules only', count(*)::bigint from (select lower(pref_name) from molecules where pref_name is not null except select lower(drug_name) from faers where drug_name is not null)""")
def key_set_sizes(spark: SparkSession, d: str) -> DataFrame:
    """SET-03, SET-04: distinct key sets, their intersection and difference."""
    m = table(spark, d, "molecules").filter("pref_name is not null").select(F.lower("pref_name").alias("k"))
    f = table(spark, d, "faers").filter("drug_name is not null").select(F.lower("drug_name").alias("k"))
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias("keys")).select(F.lit(side).alias("side"), "keys")
    return count(m.intersect(f), "both").unionByName(count(m.subtract(f), "molecules only"))


@query("""select chembl_id, t[1] as first_target, len(list_distinct(t))::int as targets from (
  select chembl_id, list_filter(string_split(coalesce(target_names, ''), '|'), lambda x: x <> '') as t from molecules)""")
def targets_per_molecule(spark: SparkSession, d: str) -> DataFrame:
    """SET-06, STR-02: a joined text as a list without repetitions, in order, at most ten."""
    t = F.array_distinct(T.listed(F.col("target_names")))
    return table(spark, d, "molecules").select("chembl_id", F.try_element_at(F.slice(t, 1, 10), F.lit(1)).alias("first_target"), F.size(t).alias("targets"))


@query("select source, doc_id, text, count(*)::bigint as copies from passages group by 1, 2, 3 having count(*) > 1")
def redelivered_passages(spark: SparkSession, d: str) -> DataFrame:
    """SET-02, PSG-09: repeated (source, doc_id, text)."""
    p = table(spark, d, "passages").groupBy("source", "doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    return p.filter("copies > 1")


@query("select 'ctg_trials' as t, count(*)::bigint as n from ctg_trials union all select 'faers', count(*)::bigint from faers union all select 'molecules', count(*)::bigint from molecules")
def union_of_counts(spark: SparkSession, d: str) -> DataFrame:
    """SET-01."""
    out = None
    for t in ("ctg_trials", "faers", "molecules"):
        c = table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n")
        out = c if out is None else out.unionByName(c)
    return out


@query("select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 30")
def top_parts(spark: SparkSession, d: str) -> DataFrame:
    """SRT-01, SRT-02: the best rows of all, kept per partition first."""
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(30)


@query("select p_brand, arg_max(p_partkey, (p_retailprice, -p_partkey)) as best from part group by 1")
def best_part_per_brand(spark: SparkSession, d: str) -> DataFrame:
    """SRT-03, SRT-05, SRT-10: arg-max per group."""
    return table(spark, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("best"))


@query("""select relation, x_type, y_type, count(*)::bigint as edges, count(distinct x_index)::bigint as heads from primekg group by 1, 2, 3""")
def edge_census(spark: SparkSession, d: str) -> DataFrame:
    """AGG-27: inventory counts with distinct keys."""
    return table(spark, d, "primekg").groupBy("relation", "x_type", "y_type").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("x_index").alias("heads"))


@query("""select l_returnflag, sum(case when l_linestatus = 'F' then 1 else 0 end)::bigint as "F", sum(case when l_linestatus = 'O' then 1 else 0 end)::bigint as "O" from lineitem group by 1""")
def pivoted_status(spark: SparkSession, d: str) -> DataFrame:
    """AGG-14, AGG-22: a pivot over known columns."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).fillna(0)


@query("""select round(corr(l_quantity, l_extendedprice), 6) as quantity_price, round(corr(l_quantity, l_discount), 6) as quantity_discount, round(corr(l_extendedprice, l_tax), 6) as price_tax from lineitem""")
def correlations(spark: SparkSession, d: str) -> DataFrame:
    """AGG-20."""
    li = table(spark, d, "lineitem")
    return li.agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("quantity_price"),
        F.round(F.corr("l_quantity", "l_discount"), 6).alias("quantity_discount"),
        F.round(F.corr("l_extendedprice", "l_tax"), 6).alias("price_tax"),
    )


@query("""select least(20, floor(score * 20)::int + 1) as bin, count(*)::bigint as n from passages where score is not null group by 1""")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AGG-21: twenty equal bins over 0 to 1."""
    p = table(spark, d, "passages").filter("score is not null")
    b = F.least(F.lit(20), F.floor(F.col("score") * 20).cast("int") + 1)
    return p.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""select event_type, 'max' as stat, max(value) as v from events group by 1 union all select event_type, 'min', min(value) from events group by 1""")
def melted_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG-23: wide to long."""
    w = table(spark, d, "events").groupBy("event_type").agg(F.max("value").alias("max"), F.min("value").alias("min"))
    return w.unpivot(["event_type"], ["max", "min"], "stat", "v")


@query("""select trial_row_id, case
 when regexp_matches(trim(start_date), '^\\d{4}-\\d{2}-\\d{2}$') then try_cast(trim(start_date) as date)
 when regexp_matches(trim(start_date), '^\\d{4}-\\d{2}$') then try_cast(trim(start_date) || '-01' as date)
 when regexp_matches(trim(start_date), '^\\d{4}$') and trim(start_date) <> '0000' then try_cast(trim(start_date) || '-01-01' as date)
 when regexp_matches(trim(start_date), '^[A-Za-z]+ \\d{1,2}, \\d{4}$') then cast(try_strptime(trim(start_date), '%B %d, %Y') as date)
 when regexp_matches(trim(start_date), '^[A-Za-z]+ \\d{4}$') then cast(try_strptime(trim(start_date), '%B %Y') as date) end as start_day from ctg_trials""")
def start_days(spark: SparkSession, d: str) -> DataFrame:
    """DT-01 to DT-05: dates as typed, as the first day of the period they name."""
    return table(spark, d, "ctg_trials").select("trial_row_id", parse_partial("start_date")["first"].alias("start_day"))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
