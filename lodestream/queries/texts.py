"""Queries of scalar text functions, validation and passage building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import text as T
from lodestream.functions import validate as V
from lodestream.operators import passages as P
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


_SENTENCES = r"""
  select doc_id, list_filter(list_transform(string_split_regex(regexp_replace(trim(text, ' '), '([.!?])[ \t\n\v\f\r]+', '\1' || chr(1), 'g'), chr(1) || '+|\n+'),
    lambda x: trim(x, ' ')), lambda x: length(x) >= 10) as s from documents where text is not null"""


@query(f"select doc_id, len(s)::int as sentences, s[1] as first, s[-1] as last from ({_SENTENCES})")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """STR-01 over all texts; SQL has no look-behind and marks the ends first."""
    s = T.sentences(F.col("text"))
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", s.alias("s"))
    return docs.select("doc_id", F.size("s").alias("sentences"), F.try_element_at("s", F.lit(1)).alias("first"), F.try_element_at("s", F.lit(-1)).alias("last"))


@query("""select doc_id, ((length(text) - length(replace(text, 'mg', ''))) / 2)::int as n from documents where text is not null""")
def substring_count(spark: SparkSession, d: str) -> DataFrame:
    """STR-08."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.occurrences(F.col("text"), F.lit("mg")).alias("n"))


@query("select doc_id, 'passage-' || md5(text) as content_id from documents where text is not null")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    """HSH-01, GR-01."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.content_id("passage-", F.col("text")).alias("content_id"))


@query("select row_id, left(sha256('name=' || coalesce(trim(intervention_name), '') || ';phase=' || coalesce(trim(phase), '')), 16) as plan_hash from aact_studies")
def plan_hashes(spark: SparkSession, d: str) -> DataFrame:
    """HSH-02, PO-10, FE-04: canonical content hashes."""
    return table(spark, d, "aact_studies").select("row_id", T.canonical_hash(("phase", F.col("phase")), ("name", F.col("intervention_name"))).alias("plan_hash"))


_PHASE_SQL = """case
  when regexp_full_match({0}, '(PHASE|P)?1|PHASEI') then 'PHASE1' when regexp_full_match({0}, '(PHASE|P)?2|PHASEII') then 'PHASE2'
  when regexp_full_match({0}, '(PHASE|P)?3|PHASEIII') then 'PHASE3' when regexp_full_match({0}, '(PHASE|P)?4|PHASEIV') then 'PHASE4'
  when regexp_full_match({0}, 'EARLYP(HASE)?1') then 'EARLY_PHASE1' else upper({1}) end"""
_TYPE_SQL = """case upper(trim({0})) when 'INT' then 'INTERVENTIONAL' when 'OBS' then 'OBSERVATIONAL' else upper(trim({0})) end"""


def _phase_sql(c: str) -> str:
    return _PHASE_SQL.format(f"replace(replace(replace(upper({c}), ' ', ''), '-', ''), '_', '')", c)


@query(f"select trial_row_id, {_phase_sql('phases')} as phase, {_TYPE_SQL.format('study_type')} as study_type from ctg_trials")
def normalised_trials(spark: SparkSession, d: str) -> DataFrame:
    """STR-03, STR-05, STR-06."""
    return table(spark, d, "ctg_trials").select("trial_row_id", T.phase_code(F.col("phases")).alias("phase"), T.study_type_code(F.col("study_type")).alias("study_type"))


_SPELLINGS = ["Phase {0}", "phase-{0}", "PHASE_{0}", "p{0}", " {0} ", "early phase {0}", "EarlyP{0}", "Phase {0}/2"]


@query(f"""select row_id, f, {_phase_sql("replace(f, '{0}', right(phase, 1))")} as phase, {_TYPE_SQL.format("left(intervention_type, 3)")} as kind
from aact_studies, (values {", ".join(f"('{x}')" for x in _SPELLINGS)}) v(f) where phase is not null""")
def respelled_phases(spark: SparkSession, d: str) -> DataFrame:
    """STR-03, STR-05, STR-06 on every way to write a phase."""
    s = table(spark, d, "aact_studies").filter("phase is not null").select("row_id", "phase", "intervention_type", F.explode(F.array(*map(F.lit, _SPELLINGS))).alias("f"))
    typed = F.replace("f", F.lit("{0}"), F.right("phase", F.lit(1)))
    return s.select("row_id", "f", T.phase_code(typed).alias("phase"), T.study_type_code(F.left("intervention_type", F.lit(3))).alias("kind"))


@query("select doc_id, len(regexp_extract_all(text, '(?s).{900}[^ \n]*|.+'))::int as chunks from documents where text is not null")
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    """STR-09, GR-04."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(T.chunks_at_blanks(F.col("text"), 900)).alias("chunks"))


_QUOTED = r"""'"' || replace(replace(replace(replace(replace({0}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"'"""


@query(f"""select passage_id, concat_ws(chr(10), 'text: ' || {_QUOTED.format("text")}, 'source: ' || {_QUOTED.format("source")}, 'doc_id: ' || {_QUOTED.format("doc_id")},
  'passage: ' || passage_id) || chr(10) as block from passages""")
def yaml_blocks(spark: SparkSession, d: str) -> DataFrame:
    """STR-16: a passage as a block of YAML."""
    c = F.col
    block = T.yaml_block({"text": c("text"), "source": c("source"), "doc_id": c("doc_id"), "passage": c("passage_id")}, {"text", "source", "doc_id"})
    return table(spark, d, "passages").select("passage_id", block.alias("block"))


@query("""select doc_id, (i - 1)::int as chunk, coalesce(list_sum(list_transform(c[1:i - 1], lambda x: length(x))), 0)::bigint as start, length(c[i])::bigint as size,
  coalesce(list_sum(list_transform(c[1:i - 1], lambda x: length(x))), 0)::bigint + nullif(instr(c[i], 'mg'), 0) - 1 as hit from (
  select doc_id, c, unnest(range(1, len(c) + 1)) as i from (select doc_id, regexp_extract_all(text, '(?s).{900}[^ \n]*|.+') as c from documents where text is not null))""")
def chunk_places(spark: SparkSession, d: str) -> DataFrame:
    """GR-04: chunks with their place, and what is found in a chunk placed in the whole text again."""
    chunks = T.chunk_spans(table(spark, d, "documents"), "doc_id", "text", 900)
    hit = F.nullif(F.instr("text", "mg"), F.lit(0)) - 1
    return chunks.select("doc_id", "chunk", "start", F.length("text").cast("bigint").alias("size"), T.rebased(hit, F.col("start")).alias("hit"))


@query("""select passage_id, nullif(regexp_extract(upper(doc_id), '^(NDA|ANDA|BLA)', 1), '') as kind, case when length(text) > 200 then left(text, 197) || '...' else text end as short from passages where source = 'drugsfda'""")
def application_types(spark: SparkSession, d: str) -> DataFrame:
    """STR-10, STR-15."""
    p = table(spark, d, "passages").filter("source = 'drugsfda'")
    return p.select("passage_id", T.application_type(F.col("doc_id")).alias("kind"), T.truncated(F.col("text")).alias("short"))


@query("""select chembl_id, array_to_string(list_transform(range(len(pref_name)), lambda i: case when i = 0 or not regexp_matches(lower(pref_name)[i], '\\p{L}') then upper(pref_name[i + 1]) else lower(pref_name[i + 1]) end), '') as name,
  pref_name as bare from molecules""")
def title_cased(spark: SparkSession, d: str) -> DataFrame:
    """STR-04, STR-14: title case after any non-letter; quotes stripped."""
    m = table(spark, d, "molecules")
    return m.select("chembl_id", T.title_case(F.col("pref_name")).alias("name"), T.unquoted(F.concat(F.lit('"'), F.col("pref_name"), F.lit('"'))).alias("bare"))


@query("""select trial_row_id, unnest(list_filter(string_split(coalesce(conditions, ''), '|'), lambda x: trim(x) <> '')) as condition from ctg_trials""")
def exploded_conditions(spark: SparkSession, d: str) -> DataFrame:
    """SRC-25, ARR-01, STR-02."""
    return table(spark, d, "ctg_trials").select("trial_row_id", F.explode(T.listed(F.col("conditions"))).alias("condition"))


@query("""select row_id, case when intervention_type in ('DRUG', 'BIOLOGICAL') then intervention_type end as category,
  case when regexp_matches(enrollment::varchar, '^-?\\d+$') then enrollment end as whole,
  try_cast(regexp_extract(intervention_description, '^(\\d+(\\.\\d+)?)', 1) as double) as number from aact_studies""")
def validated_features(spark: SparkSession, d: str) -> DataFrame:
    """VAL-01: typed validation of raw values; what does not fit its type is null."""
    s = table(spark, d, "aact_studies")
    return s.select(
        "row_id",
        V.categorical(F.col("intervention_type"), ["DRUG", "BIOLOGICAL"]).alias("category"),
        V.whole(F.col("enrollment").cast("string")).cast("int").alias("whole"),
        V.number(F.regexp_extract("intervention_description", r"^(\d+(\.\d+)?)", 1)).alias("number"),
    )


@query("""select trial_row_id, list_filter([case when official_title is null then 'no official title' end, case when start_date is null then 'no start date' end,
  case when conditions is null then 'no conditions' end, case when detailed_description is null then 'no description' end], lambda x: x is not null) as warnings from ctg_trials""")
def alignment_warnings(spark: SparkSession, d: str) -> DataFrame:
    """VAL-02: what a record lacks, as a list of messages."""
    t = table(spark, d, "ctg_trials")
    checks = {"no official title": "official_title", "no start date": "start_date", "no conditions": "conditions", "no description": "detailed_description"}
    return t.select("trial_row_id", V.warnings({m: F.col(c).isNull() for m, c in checks.items()}).alias("warnings"))


@query("""select chembl_id, len(list_intersect(t, ['X', 'ZOKOLITU', 'VIGUTIBA']))::int as shared, len(t) > 0 and len(list_intersect(t, ['X', 'ZOKOLITU', 'VIGUTIBA'])) = len(t) as covered from (
  select chembl_id, list_distinct(list_filter(string_split(coalesce(target_names, ''), '|'), lambda x: x <> '')) as t from molecules)""")
def set_checks(spark: SparkSession, d: str) -> DataFrame:
    """ARR-03, SET-05, VAL-03: intersections and subset tests of lists."""
    t = F.array_distinct(T.listed(F.col("target_names")))
    want = F.array(*[F.lit(x) for x in ("X", "ZOKOLITU", "VIGUTIBA")])
    return table(spark, d, "molecules").select(
        "chembl_id", F.size(F.array_intersect(t, want)).alias("shared"), ((F.size(t) > 0) & (F.size(F.array_except(t, want)) == 0)).alias("covered")
    )


_CTG = """
select concat_ws(' ', {p}) as text, 'ctg' as source, nct_id as doc_id, start_date as date from ctg_trials where concat_ws(' ', {p}) <> '' and nct_id is not null""".format(
    p=", ".join(
        f"case when trim({c}) <> '' then '{lab}: ' || trim({c}) || '.' end"
        for lab, c in (
            ("Title", "brief_title"), ("Official title", "official_title"), ("Phase", "phases"), ("Type", "study_type"),
            ("Conditions", "replace(conditions, '|', ', ')"), ("Sponsor", "lead_sponsor"), ("Summary", "brief_summary"), ("Eligibility", "eligibility_criteria"),
        )
    )
)


@query(_CTG)
def trial_passages(spark: SparkSession, d: str) -> DataFrame:
    """PSG-01, STR-11, STR-13."""
    return P.trial_passages(table(spark, d, "ctg_trials"))


@query("""
with l as (select drug_name, event, sum(event_count)::bigint as n from faers where trim(drug_name) <> '' and event is not null group by 1, 2),
b as (select drug_name, string_agg(event || ' (' || n || ')', '; ' order by n desc, event) as body from l group by 1),
q as (select drug_name, min(report_quarter) as date from faers where trim(drug_name) <> '' group by 1)
select 'Adverse events reported for ' || drug_name || ': ' || body || '.' as text, 'faers' as source, 'faers-' || replace(lower(drug_name), ' ', '_') as doc_id, date from b join q using (drug_name)""")
def event_passages(spark: SparkSession, d: str) -> DataFrame:
    """PSG-03, AGG-05."""
    return P.event_passages(table(spark, d, "faers"))


@query("""
with s as (select * from aact_studies where sponsor_name <> '' and condition_name <> ''),
st as (select sponsor_name, condition_name, count(*) as n, count(*) filter (where overall_status = 'COMPLETED') as done,
  count(*) filter (where overall_status in ('TERMINATED', 'WITHDRAWN')) as failed, max(start_date) as latest from s group by 1, 2),
dr as (select sponsor_name, condition_name, string_agg(intervention_name, ', ' order by intervention_name) as drugs from (
  select *, row_number() over (partition by sponsor_name, condition_name order by intervention_name) as rn from (select distinct sponsor_name, condition_name, intervention_name from s where intervention_name <> '')) where rn <= 10 group by 1, 2)
select concat_ws(' ', sponsor_name || ' ran ' || n || ' studies in ' || condition_name || '.', 'Completed ' || done || ', stopped ' || failed || '.',
  'Success rate ' || round_even(done * 100 / nullif(done + failed, 0), 0)::int || ' percent.', case when trim(drugs) <> '' then 'Interventions: ' || trim(drugs) || '.' end) as text, 'aact' as source,
  'aact-' || replace(lower(sponsor_name), ' ', '_') || '-' || replace(lower(condition_name), ' ', '_') as doc_id, latest::varchar as date
from st left join dr using (sponsor_name, condition_name)""")
def sponsor_passages(spark: SparkSession, d: str) -> DataFrame:
    """PSG-04, AGG-06."""
    return P.sponsor_passages(table(spark, d, "aact_studies"))


@query("""
select concat_ws(' ', pref_name || '.', case when trim(molecule_type) <> '' then 'Type: ' || trim(molecule_type) || '.' end,
  'Highest phase: ' || max_phase::int || '.', case when trim(mechanism_of_action) <> '' then 'Mechanism: ' || trim(mechanism_of_action) || '.' end,
  case when trim(target_names) <> '' then 'Targets: ' || trim(replace(target_names, '|', ', ')) || '.' end,
  case when black_box_warning then 'Carries a boxed warning.' end, case when withdrawn_flag then 'Withdrawn.' end) as text,
  'chembl' as source, chembl_id as doc_id, first_approval || '-01-01' as date from molecules where pref_name <> ''""")
def molecule_passages(spark: SparkSession, d: str) -> DataFrame:
    """PSG-05."""
    return P.molecule_passages(table(spark, d, "molecules"))


@query("""
with near as (select * from primekg where (x_type in ('drug', 'disease') or y_type in ('drug', 'disease')) and x_name is not null and y_name is not null),
top as (select * from (select *, row_number() over (partition by x_name, x_type, x_id order by edge_id) as rn from near) where rn <= 30),
rel as (select x_name, x_type, x_id, display_relation, list_slice(list_sort(list(distinct y_name)), 1, 10) as ys from top group by all),
body as (select x_name, x_type, x_id, string_agg(l, '; ' order by l) as body from (select *, display_relation || ': ' || array_to_string(ys, ', ') as l from rel) group by all)
select x_name || ' (' || x_type || ') ' || body || '.' as text, 'primekg' as source, 'primekg-' || replace(lower(x_type), '/', '-') || '-' || x_id as doc_id, '2000-01-01' as date from body""")
def graph_passages(spark: SparkSession, d: str) -> DataFrame:
    """PSG-06, AGG-07."""
    return P.graph_passages(table(spark, d, "primekg"))


_EVERY = ("trial_passages", "event_passages", "sponsor_passages", "molecule_passages", "graph_passages")


@query(
    "select source, count(*)::bigint as passages, sum(length(text))::bigint as characters from ("
    + " union all ".join(f"select source, text from ({SQL[n]})" for n in _EVERY)
    + " union all select 'drugsfda', trim(text) from documents where trim(text) <> '') group by 1"
)
def all_passages(spark: SparkSession, d: str) -> DataFrame:
    """PSG-07, PSG-08, PSG-10: passages per source, from one registry of builders."""
    t = {"ctg": "ctg_trials", "faers": "faers", "aact": "aact_studies", "chembl": "molecules", "primekg": "primekg", "drugsfda": "documents"}
    all_ = P.all_passages({s: table(spark, d, n) for s, n in t.items()})
    return all_.groupBy("source").agg(F.count(F.lit(1)).alias("passages"), F.sum(F.length("text")).alias("characters"))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
