"""Nested records to flat rows and back, rejects, lookups, budgets and small reports.

Nulls: a missing module, field or list gives null (or an empty list where a docstring says so).
"""

from __future__ import annotations

import hashlib
import json
import time
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.operators.relational import first_n
from lodestream.session import checkpoint_dir


def json_at(c: str, *paths: str) -> Column:
    """The first of several JSON paths that holds something."""
    return F.coalesce(*(F.get_json_object(c, f"$.{p}") for p in paths))


def json_list(c: Column) -> Column:
    """A JSON list of texts as an array; null where there is none."""
    return F.from_json(c, "array<string>")


def flat_trials(records: DataFrame, key: str, json_col: str) -> DataFrame:
    """One flat row per readable record, from the trial's own protocol part in any of its key styles."""

    def both(camel: str, snake: str) -> Column:
        return json_at(json_col, f"protocolSection.{camel}", camel, snake)

    phases = json_list(both("designModule.phases", "design_module.phases"))
    conditions = json_list(both("conditionsModule.conditions", "conditions_module.conditions"))
    flat = records.select(
        key,
        both("identificationModule.nctId", "identification_module.nct_id").alias("nct_id"),
        both("identificationModule.briefTitle", "identification_module.brief_title").alias("brief_title"),
        both("statusModule.startDateStruct.date", "status_module.start_date").alias("start_date"),
        both("designModule.studyType", "design_module.study_type").alias("study_type"),
        F.try_element_at(phases, F.lit(1)).alias("phase"),
        F.array_join(conditions, "|").alias("conditions"),
        both("sponsorCollaboratorsModule.leadSponsor.name", "sponsor_collaborators_module.lead_sponsor_name").alias("lead_sponsor"),
        F.lit(None).cast("date").alias("completion_date"),
    )
    return flat.filter("nct_id <> ''")


def nested_by_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """One struct column per module from {column: 'module.field'}; the first mapped column that is not null wins."""
    modules: dict[str, dict[str, list[Column]]] = {}
    for col, path in mapping.items():
        if col in df.columns:
            module, _, field = path.partition(".")
            modules.setdefault(module, {}).setdefault(field, []).append(F.col(col))
    return df.select(*(F.struct(*(F.coalesce(*cs).alias(f) for f, cs in fields.items())).alias(m) for m, fields in modules.items()))


def accepted_and_rejected(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that have all required values, and the others with the names of what they lack."""
    lacks = F.filter(F.array(*(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in required)), lambda x: x.isNotNull())
    marked = df.withColumn("lacks", lacks)
    return marked.filter(F.size("lacks") == 0).drop("lacks"), marked.filter(F.size("lacks") > 0)


def flat_approvals(df: DataFrame) -> DataFrame:
    """Approval applications (nested products and submissions) to one row each.

    First non-empty brand and marketing status over the products; distinct ingredient names, falling
    back on generic names; the original submission that was approved first; orphan flag.
    """
    first_text = lambda arr, f: F.try_element_at(F.filter(F.transform(arr, f), lambda x: x.isNotNull() & (x != "")), F.lit(1))
    ingredients = F.array_distinct(F.flatten(F.transform(F.coalesce("products", F.array()), lambda p: F.transform(F.coalesce(p["active_ingredients"], F.array()), lambda a: F.upper(a["name"])))))
    ingredients = F.filter(ingredients, lambda x: x.isNotNull() & (x != ""))
    generic = F.coalesce(F.col("openfda.generic_name"), F.array())
    originals = F.filter("submissions", lambda s: (s["submission_type"] == "ORIG") & (s["submission_status"] == "AP"))
    original = F.try_element_at(F.array_sort(F.transform(originals, lambda s: F.struct(s["submission_status_date"].alias("day"), s.alias("s")))), F.lit(1))["s"]
    return df.select(
        "application_number",
        F.coalesce(first_text(F.col("products"), lambda p: p["brand_name"]), F.try_element_at(F.col("openfda.brand_name"), F.lit(1))).alias("brand_name"),
        F.array_join(F.when(F.size(ingredients) > 0, ingredients).otherwise(generic), "|").alias("active_ingredients"),
        first_text(F.col("products"), lambda p: p["marketing_status"]).alias("marketing_status"),
        F.regexp_replace(F.substring(original["submission_status_date"], 1, 8), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3").alias("approval_date"),
        F.coalesce(F.exists(original["submission_property_type"], lambda t: t["code"] == "Orphan"), F.lit(False)).alias("is_orphan"),
    )


def annotations(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, text, label) from entities with several offsets each."""
    e = docs.select("doc_id", F.explode("entities").alias("e"))
    return e.select("doc_id", F.col("e.label").alias("label"), F.explode(F.arrays_zip(F.col("e.offsets").alias("o"), F.col("e.text").alias("t"))).alias("z")).select(
        "doc_id", F.get(F.col("z.o"), F.lit(0)).alias("start"), F.get(F.col("z.o"), F.lit(1)).alias("end"), F.col("z.t").alias("text"), "label"
    )


def present_cells(df: DataFrame, cols: list[str]) -> Column:
    """The non-null cells of a row as a map."""
    return F.map_filter(F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull())


def judged_and_some(docs: DataFrame, judged: DataFrame, key: str, cap: int) -> DataFrame:
    """All judged documents and the first ``cap`` others by key."""
    rest = docs.join(judged, key, "left_anti").orderBy(key).limit(cap)
    return docs.join(judged, key, "left_semi").unionByName(rest)


def within_budget(df: DataFrame, by: str, order: str, size: Column, budget: int) -> DataFrame:
    """The first rows of each group while their sizes add up to at most the budget.

    Sizes are at least 1, so no group needs more rows than the budget: the rest is cut off before the
    shuffle, whatever a group holds.
    """
    s = df.withColumn("__size", F.greatest(size, F.lit(1)))
    some = first_n(s, [by], [F.col(order)], budget)
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return some.withColumn("used", F.sum("__size").over(w)).filter(F.col("used") <= budget).drop("__size", "rank")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that changes when the rows do, whatever their order: count and sum of row hashes."""
    h = F.xxhash64(*df.columns).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("hash_sum"))


def rebuild_changed(spark: SparkSession, state: str, sources: dict[str, DataFrame], rebuild: Callable[[str, DataFrame], None]) -> dict[str, bool]:
    """Rebuilds the snapshot sources whose rows differ from those of the last run; {source: whether it was rebuilt}.

    The state (source, n, hash_sum, at) is written after each rebuild, so a run that fails is made up for by the next.
    """
    schema = "source string, n bigint, hash_sum string, at bigint"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
    known = {}
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        last = spark.read.schema(schema).json(state).groupBy("source").agg(F.max_by(F.struct("n", "hash_sum"), "at").alias("f"))
        known = {r["source"]: tuple(r["f"]) for r in last.collect()}  # a row per source
    out = {}
    for name, df in sources.items():
        f = fingerprint(df).first()
        now = (f["n"], str(f["hash_sum"]))
        out[name] = known.get(name) != now
        if out[name]:
            rebuild(name, df)
            spark.createDataFrame([(name, *now, time.time_ns())], schema).coalesce(1).write.mode("append").json(state)
    return out


def in_order_of(ids: list[int], df: DataFrame, key: str) -> DataFrame:
    """The rows of some ids with their place in the list (a list from a caller, so of a caller's size)."""
    lit = df.sparkSession.createDataFrame(list(enumerate(ids)), f"place int, `{key}` bigint")
    return lit.join(df, key)


def gap_buckets(counts: DataFrame, labels: list[str]) -> DataFrame:
    """(label, n, bucket) for every label of a list: none, few (below 100) or enough."""
    want = counts.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    j = want.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
    return j.withColumn("bucket", F.when(F.col("n") == 0, "none").when(F.col("n") < 100, "few").otherwise("enough"))


def ucb_columns(df: DataFrame, total: str, visits: str, parent_visits: Column, c: float) -> Column:
    """mean + c * sqrt(ln(max(parent visits, 1)) / visits); null where there are no visits (stands for infinity)."""
    mean = F.try_divide(F.col(total).cast("double"), F.col(visits))
    return mean + c * F.sqrt(F.try_divide(F.log(F.greatest(parent_visits, F.lit(1)).cast("double")), F.col(visits)))


def memo_key(tag: str, arguments: dict) -> str:
    """A key of a function's tag and its arguments, whatever their order: tag/hash, so results lie together by tag."""
    text = json.dumps(arguments, sort_keys=True, default=str)
    return f"{tag}/{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def forget(spark: SparkSession, tag: str, folder: str | None = None) -> None:
    """Removes all results stored under a tag."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder or checkpoint_dir(spark)}/memo/{tag}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def memoised(spark: SparkSession, key: str, compute: Callable[[], DataFrame], folder: str | None = None) -> DataFrame:
    """The table stored under a key, computed and written first if it is not there yet."""
    path = f"{folder or checkpoint_dir(spark)}/memo/{key}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_all(jobs: dict[str, Callable[[], object]], threads: int = 7) -> dict[str, tuple[bool, object]]:
    """Runs jobs side by side; a failure stays with its own job: {name: (ok, result or error text)}."""

    def safe(f: Callable[[], object]) -> tuple[bool, object]:
        try:
            return True, f()
        except Exception as e:  # noqa: BLE001 - one source must not stop the others
            return False, f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(jobs) or 1))) as pool:
        return dict(zip(jobs, pool.map(safe, jobs.values()), strict=True))
