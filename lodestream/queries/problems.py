"""Queries of the general data problems, with SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.dates import parse_partial
from lodestream.operators import asof, eager, nested, orphans
from lodestream.tables import norm_ref, table

#: A key that holds this share of a table's rows counts as heavy in p5_found.
P5_SHARE = 0.01


# ---- 1: deeply nested records -------------------------------------------------------------------


def _protocols(spark: SparkSession, d: str) -> DataFrame:
    return nested.label_nodes(table(spark, d, "protocols"), "record_id", "protocol_section")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found_children(_protocols(spark, d), "record_id")


def p1_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.node_table(_protocols(spark, d), "record_id")


def _child(child: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.child_table(_protocols(spark, d), "record_id", child).drop("pre", "post", "parent")

    return query


# ---- 3: orphan references -----------------------------------------------------------------------


def _refs(spark: SparkSession, d: str) -> DataFrame:
    studies = orphans.references(
        table(spark, d, "aact_studies"), "aact_studies", "ctg_trials", "row_id", "nct_id", "loaded_at"
    )
    target = F.when(F.col("source") == "ctg", "ctg_trials").when(F.col("source") == "chembl", "molecules")
    chunks = orphans.references(table(spark, d, "passages"), "passages", target, "passage_id", "doc_id", "indexed_at")
    return studies.unionByName(chunks)


def _targets(spark: SparkSession, d: str) -> DataFrame:
    trials = orphans.versions(table(spark, d, "ctg_trials"), "ctg_trials", "nct_id", "first_posted_at", "removed_at")
    molecules = orphans.versions(table(spark, d, "molecules"), "molecules", "chembl_id", "added_at", "removed_at")
    return trials.unionByName(molecules)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_rows(_refs(spark, d), _targets(spark, d)).select("table_name", "row_id")


def p3_orphans_per_quarter(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(_refs(spark, d), _targets(spark, d))


# ---- 5: a few keys holding most records ---------------------------------------------------------


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return eager.shares(
        {"primekg": (table(spark, d, "primekg"), "x_name"), "aact_studies": (table(spark, d, "aact_studies"), "nct_id")},
        P5_SHARE,
    ).select("table_name", "key_value")


def p5_edges_per_name(spark: SparkSession, d: str) -> DataFrame:
    return eager.rows_and_distinct(
        table(spark, d, "primekg"), F.col("x_name"), F.col("y_index"), ("x_name", "edges", "neighbours")
    )


def p5_rows_per_trial(spark: SparkSession, d: str) -> DataFrame:
    return eager.rows_and_distinct(
        table(spark, d, "aact_studies"),
        F.col("nct_id"),
        F.col("intervention_name"),
        ("nct_id", "studies", "interventions"),
    )


def p5_two_step_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths x - y - z by the relations of their two edges, where y ends one edge and starts another."""
    kg = table(spark, d, "primekg")
    into = eager.key_states(kg, {"node": F.col("y_index"), "first_relation": F.col("relation")})
    out_of = eager.key_states(kg, {"node": F.col("x_index"), "second_relation": F.col("relation")})
    joined = eager.join_states(into, out_of, ["node"], ["first_relation"], ["second_relation"])
    return eager.roll_up(joined, ["first_relation", "second_relation"]).withColumnRenamed("n", "paths")


def p5_study_documents(spark: SparkSession, d: str) -> DataFrame:
    """Study rows joined with documents of the same trial, per document source: pairs, enrolment, characters."""
    studies = eager.key_states(
        table(spark, d, "aact_studies"),
        {"trial": norm_ref("nct_id")},
        {"enrollment": F.coalesce(F.col("enrollment"), F.lit(0)).cast("bigint")},
    )
    docs = eager.key_states(
        table(spark, d, "documents"),
        {"trial": norm_ref("nct_id"), "source": F.col("source")},
        {"chars": F.coalesce(F.col("n_chars"), F.lit(0))},
    )
    joined = eager.join_states(studies, docs, ["trial"], [], ["source"], ["enrollment"], ["chars"])
    out = eager.roll_up(joined, ["source"], ["enrollment", "chars"])
    return out.select("source", F.col("n").alias("pairs"), "enrollment", "chars")


# ---- 6: attributes as known at event time -------------------------------------------------------


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "evidence_requests").select(
        norm_ref("doc_id").alias("entity"),
        parse_partial("start_date")["first"].alias("day"),
        F.col("request_id").alias("event_id"),
    )
    versions = table(spark, d, "passages").select(
        norm_ref("doc_id").alias("entity"),
        parse_partial("date")["last"].alias("day"),
        F.col("passage_id").alias("version_id"),
    )
    return asof.as_of(events, versions).select(
        F.col("event_id").alias("request_id"), F.col("version_id").alias("passage_id")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_sites": _child("location"),
        "p1_collaborators": _child("collaborator"),
        "p1_outcomes": _child("secondary_outcome"),
        "p1_nodes": p1_nodes,
        "p3_found": p3_found,
        "p3_orphans_per_quarter": p3_orphans_per_quarter,
        "p5_found": p5_found,
        "p5_edges_per_name": p5_edges_per_name,
        "p5_rows_per_trial": p5_rows_per_trial,
        "p5_two_step_paths": p5_two_step_paths,
        "p5_study_documents": p5_study_documents,
        "p6_found": p6_found,
    }


# ---- SQL ----------------------------------------------------------------------------------------

_P1_SRC = """
with rec as (
  select record_id, try_cast(protocol_section as json) as j from protocols
), own as (
  select record_id, coalesce(j->'protocolSection', j->'protocol_section', j) as s from rec where json_type(j) = 'OBJECT'
), lists as (
  select record_id, 'location' as child,
         coalesce(s->'contactsLocationsModule', s->'contacts_locations_module')->'locations' as l from own
  union all
  select record_id, 'collaborator',
         coalesce(coalesce(s->'sponsorCollaboratorsModule', s->'sponsor_collaborators_module')->'collaborators',
                  coalesce(s->'sponsorCollaboratorsModule', s->'sponsor_collaborators_module')->'collaborator_names') from own
  union all
  select record_id, 'secondary_outcome',
         coalesce(s->'outcomesModule'->'secondaryOutcomes', s->'outcomes_module'->'secondary_outcomes') from own
), opened as (
  select record_id, child,
         case when json_type(l) = 'VARCHAR' and (l->>'$') similar to '\\s*[\\[{].*'
              then coalesce(try_cast(l->>'$' as json), l) else l end as l
  from lists where l is not null and json_type(l) <> 'NULL'
), items as (
  select record_id, child, unnest(generate_series(0, json_array_length(l)::bigint - 1)) as pos, l from opened where json_type(l) = 'ARRAY'
), elements as (
  select record_id, child, pos, json_extract(l, '$[' || pos || ']') as e from items
  union all
  select record_id, child, 0, l from opened where json_type(l) <> 'ARRAY'
), children as (
  select record_id, child, pos::bigint as pos,
         case when json_type(e) = 'OBJECT' then null else e->>'$' end as own_text,
         e->>'facility' as facility, e->>'city' as city, e->>'state' as state, e->>'country' as country,
         e->>'name' as name, e->>'class' as class,
         e->>'measure' as measure, e->>'description' as description,
         coalesce(e->>'timeFrame', e->>'time_frame') as time_frame
  from elements
)
"""

_FILLED = "(coalesce(trim({0}), '') <> '')"


def _filled(*cols: str) -> str:
    return "(" + " or ".join(_FILLED.format(c) for c in cols) + ")"


_SITE = _filled("own_text", "facility", "city", "state", "country")
_NAME = _filled("own_text", "name")
_OUTCOME = _filled("own_text", "measure", "description", "time_frame")

_REF_SQL = """
with refs as (
  select 'aact_studies' as table_name, 'ctg_trials' as target, row_id, lower(trim(nct_id)) as k, loaded_at as ts from aact_studies
  union all
  select 'passages', case source when 'ctg' then 'ctg_trials' else 'molecules' end, passage_id, lower(trim(doc_id)), indexed_at
  from passages where source in ('ctg', 'chembl')
), targets as (
  select 'ctg_trials' as target, lower(trim(nct_id)) as k, first_posted_at as a, removed_at as r from ctg_trials
  union all select 'molecules', lower(trim(chembl_id)), added_at, removed_at from molecules
), orphan as (
  select * from refs where k <> '' and not exists (
    select 1 from targets t where t.target = refs.target and t.k = refs.k
      and (refs.ts is null or ((t.a is null or t.a <= refs.ts) and (t.r is null or t.r > refs.ts))))
)
"""


def _date_sql(col: str, last: bool) -> str:
    """DuckDB: the first or last day of the period that a text names."""
    t = f"trim({col})"
    end = lambda e, n: f"cast({e} + interval {n} month - interval 1 day as date)" if last else f"cast({e} as date)"
    d = lambda x: f"try_cast({x} as date)"
    month = f"coalesce(try_strptime({t}, '%B %Y'), try_strptime({t}, '%b %Y'))"
    return f"""case
      when regexp_matches({t}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}([T ].*)?$') then {d(f"left({t}, 10)")}
      when regexp_matches({t}, '^\\d{{8}}$') then {d(f"left({t}, 4) || '-' || substr({t}, 5, 2) || '-' || substr({t}, 7, 2)")}
      when regexp_matches({t}, '^[A-Za-z]+ \\d{{1,2}}, \\d{{4}}$') then cast(try_strptime({t}, '%B %d, %Y') as date)
      when regexp_matches({t}, '^\\d{{4}}-\\d{{2}}$') then {end(d(f"{t} || '-01'"), 1)}
      when regexp_matches({t}, '^[A-Za-z]+ \\d{{4}}$') then {end(f"cast({month} as date)", 1)}
      when regexp_matches({t}, '^\\d{{4}}-?Q[1-4]$') then {end(d(f"left({t}, 4) || '-' || lpad(cast(cast(right({t}, 1) as int) * 3 - 2 as varchar), 2, '0') || '-01'"), 3)}
      when regexp_matches({t}, '^\\d{{4}}$') and {t} <> '0000' then {end(d(f"{t} || '-01-01'"), 12)}
    end"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1_SRC
        + f"""select record_id, child, pos from children where
          (child = 'location' and {_SITE}) or (child = 'collaborator' and {_NAME}) or (child = 'secondary_outcome' and {_OUTCOME})""",
        "p1_sites": _P1_SRC
        + f"select record_id, pos, coalesce(own_text, facility) as facility, city, state, country from children where child = 'location' and {_SITE}",
        "p1_collaborators": _P1_SRC
        + f"select record_id, pos, coalesce(own_text, name) as name, class from children where child = 'collaborator' and {_NAME}",
        "p1_outcomes": _P1_SRC
        + f"select record_id, pos, coalesce(own_text, measure) as measure, description, time_frame from children where child = 'secondary_outcome' and {_OUTCOME}",
        "p3_found": _REF_SQL + "select table_name, row_id from orphan",
        "p3_orphans_per_quarter": _REF_SQL
        + "select table_name, concat(year(ts), 'Q', quarter(ts)) as period, count(*)::bigint as orphans from orphan group by 1, 2",
        "p5_found": """
          select 'primekg' as table_name, x_name as key_value from primekg where x_name is not null
          group by x_name having count(*) >= 0.01 * (select count(*) from primekg)
          union all
          select 'aact_studies', nct_id from aact_studies where nct_id is not null
          group by nct_id having count(*) >= 0.01 * (select count(*) from aact_studies)""",
        "p5_edges_per_name": "select x_name, count(*)::bigint as edges, count(distinct y_index)::bigint as neighbours from primekg group by 1",
        "p5_rows_per_trial": "select nct_id, count(*)::bigint as studies, count(distinct intervention_name)::bigint as interventions from aact_studies group by 1",
        "p5_two_step_paths": """
          with i as (select y_index as node, relation, count(*) as n from primekg group by 1, 2),
               o as (select x_index as node, relation, count(*) as n from primekg group by 1, 2)
          select i.relation as first_relation, o.relation as second_relation, sum(i.n * o.n)::bigint as paths
          from i join o using (node) group by 1, 2""",
        "p5_study_documents": """
          select d.source, count(*)::bigint as pairs, sum(coalesce(a.enrollment, 0))::bigint as enrollment, sum(coalesce(d.n_chars, 0))::bigint as chars
          from aact_studies a join documents d on lower(trim(a.nct_id)) = lower(trim(d.nct_id))
          where trim(a.nct_id) <> '' group by 1""",
        "p6_found": f"""
          with e as (select request_id, lower(trim(doc_id)) as k, {_date_sql("start_date", False)} as day from evidence_requests),
          v as (select passage_id, lower(trim(doc_id)) as k, {_date_sql("date", True)} as day from passages)
          select request_id, passage_id from (
            select e.request_id, v.passage_id, row_number() over (partition by e.request_id order by v.day desc, v.passage_id desc) as rn
            from e join v on e.k = v.k and v.day < e.day) where rn = 1""",
    }
