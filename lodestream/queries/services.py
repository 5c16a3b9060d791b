"""Queries against paged services; a table stands behind the service, so that nothing needs a network."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.sources import services as SV
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


def _service(d: str, name: str, key: str, **more: str) -> dict[str, str]:
    return {"service": "table", "path": f"{d}/{name}.parquet", "key": key, "first_wait": "0", **more}


@query("select trial_row_id, nct_id, phases from ctg_trials where study_type in ('INTERVENTIONAL', 'Interventional', 'OBSERVATIONAL')")
def service_search(spark: SparkSession, d: str) -> DataFrame:
    """SRC-08: accepted values and fields are the service's work; pages by token."""
    o = _service(d, "ctg_trials", "trial_row_id", page_size="1000", **{"where.study_type": "INTERVENTIONAL,Interventional,OBSERVATIONAL"})
    return SV.search(spark, o, "trial_row_id bigint, nct_id string, phases string")


@query("select trial_row_id, brief_title from ctg_trials where nct_id = (select min(nct_id) from ctg_trials)")
def service_lookup(spark: SparkSession, d: str) -> DataFrame:
    """SRC-09: the records of one id."""
    one = table(spark, d, "ctg_trials").agg(F.min("nct_id")).first()[0]
    return SV.search(spark, _service(d, "ctg_trials", "trial_row_id", **{"ids.nct_id": json.dumps([one])}), "trial_row_id bigint, brief_title string")


@query("select trial_row_id, nct_id from ctg_trials where first_posted_at >= '2015-01-01' and first_posted_at < '2020-07-01'")
def service_range(spark: SparkSession, d: str) -> DataFrame:
    """SRC-10: a range of days."""
    o = _service(d, "ctg_trials", "trial_row_id", **{"since.first_posted_at": "2015-01-01", "until.first_posted_at": "2020-07-01"})
    return SV.search(spark, o, "trial_row_id bigint, nct_id string")


@query("select count(*)::bigint as total from aact_studies where overall_status in ('COMPLETED', 'TERMINATED')")
def service_count(spark: SparkSession, d: str) -> DataFrame:
    """SRC-11: the number alone; no record is read."""
    return SV.count(spark, _service(d, "aact_studies", "row_id", **{"where.overall_status": "COMPLETED,TERMINATED"}))


@query("select passage_id from passages where source = 'pubmed' and indexed_at >= '2018-01-01' order by passage_id limit 10000")
def service_ids(spark: SparkSession, d: str) -> DataFrame:
    """SRC-12: ids from a day on, up to the service's own limit of 10,000."""
    o = _service(d, "passages", "passage_id", **{"where.source": "pubmed", "since.indexed_at": "2018-01-01"})
    return SV.search_ids(spark, o, "passage_id", "bigint")


@query("select t.trial_row_id, t.nct_id from ctg_trials t where nct_id in (select nct_id from evidence_requests)")
def service_batches(spark: SparkSession, d: str) -> DataFrame:
    """SRC-13: many ids in batches of 200, asked for by the executors."""
    got = SV.fetch_by_ids(table(spark, d, "evidence_requests"), "nct_id", _service(d, "ctg_trials", "trial_row_id"), "nct_id", batch=200)
    return got.select(F.from_json("record", "trial_row_id bigint, nct_id string").alias("r")).select("r.*")


_DRUG = "(select drug_name from faers where drug_name <> '' group by 1 order by count(*) desc, 1 limit 1)"


@query(f"select event as term, sum(event_count)::bigint as n from faers where drug_name = {_DRUG} and event is not null and received_at < '2022-01-01' group by 1 order by n desc, 1 limit 100")
def service_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """SRC-15: counts by term for one drug, received before a day."""
    named = table(spark, d, "faers").filter("drug_name <> ''").groupBy("drug_name").count().orderBy(F.desc("count"), "drug_name").first()
    o = _service(d, "faers", "report_id", **{"where.drug_name": json.dumps([named[0] if named else ""]), "until.received_at": "2022-01-01"})
    return SV.count_by_term(spark, o, "event", "event_count", 100)


@query("select chembl_id, pref_name from molecules")
def service_skips(spark: SparkSession, d: str) -> DataFrame:
    """SRC-16: pages by records passed over, until one is short."""
    return SV.search(spark, _service(d, "molecules", "chembl_id", page_by="skip", page_size="7"), "chembl_id string, pref_name string")


@query("""select name, synonym, null::varchar as error from (
  select intervention_name as name, condition_name as synonym, row_number() over (partition by intervention_name order by condition_name) as r
  from (select distinct intervention_name, condition_name from aact_studies where condition_name is not null and intervention_name in (select drug_name from faers where drug_name <> ''))) where r <= 50""")
def service_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """SRC-17: up to fifty related names of each name."""
    o = _service(d, "aact_studies", "row_id", fields="intervention_name,condition_name")
    return SV.synonyms(table(spark, d, "faers"), "drug_name", o, "intervention_name", "condition_name")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
