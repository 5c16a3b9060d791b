"""Paged record services as Spark sources: filters, projection, counts and ids are left to the service.

A service is a function ask(request) -> response. Requests and responses are plain dictionaries:

request: ``where`` {field: [accepted values]}, ``since`` {field: least value}, ``until`` {field: value above all},
``ids`` {field: [values]}, ``fields`` [names] (empty: all), ``size``, and ``token`` (where the page begins, None at first)
or ``skip`` (records passed over); ``count`` True asks for the number alone.
response: ``records`` [dictionary], ``next`` (token or None), ``total``.

``http`` speaks to JSON services by configurable parameter names; ``table`` serves a Parquet table, so that a
pipeline can be tried, and tested, without a network. Register others in ``SERVICES``.

Failures: a request is tried again with doubling waits; the last failure is raised by the sources, and kept as a
row by ``fetch_by_ids``, so no gap goes unnoticed. A service's "not found" is an empty answer.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Largest page that services grant.
PAGE_LIMIT = 1000
#: Most ids that an id search returns.
ID_LIMIT = 10_000


class NotFound(Exception):
    """The service knows nothing that fits."""


def http(request: dict, options: dict) -> dict:
    """A JSON service. Options: url; names of parameters (size_param, token_param, skip_param, fields_param, count_param,
    range_param) and of parts of the answer (records, next, total); extra parameters as query.NAME."""
    from urllib.error import HTTPError
    from urllib.parse import urlencode
    from urllib.request import urlopen

    q = {k[6:]: v for k, v in options.items() if k.startswith("query.")}
    q[options.get("size_param", "pageSize")] = 0 if request.get("count") else request["size"]
    q |= {k: ",".join(map(str, v)) for part in ("where", "ids") for k, v in request.get(part, {}).items()}
    for k in {*request.get("since", {}), *request.get("until", {})}:
        low, high = request.get("since", {}).get(k, "MIN"), request.get("until", {}).get(k, "MAX")
        q[options.get("range_param", "filter.advanced")] = f"AREA[{k}]RANGE[{low},{high}]"
    if request.get("fields"):
        q[options.get("fields_param", "fields")] = ",".join(request["fields"])
    if request.get("count"):
        q[options.get("count_param", "countTotal")] = "true"
    if request.get("token"):
        q[options.get("token_param", "pageToken")] = request["token"]
    if "skip" in request:
        q[options.get("skip_param", "skip")] = request["skip"]
    try:
        with urlopen(f"{options['url']}?{urlencode(q)}", timeout=60) as r:
            body = json.load(r)
    except HTTPError as e:
        if e.code == 404:
            raise NotFound(str(e)) from e
        raise
    return {
        "records": body.get(options.get("records", "records"), []),
        "next": body.get(options.get("next", "nextPageToken")),
        "total": body.get(options.get("total", "totalCount")),
    }


def table(request: dict, options: dict) -> dict:
    """Serves the Parquet table at options['path'] in order of options['key'], as a service with pages would."""
    import pyarrow.dataset as ds

    keep = None
    for part in ("where", "ids"):
        for k, v in request.get(part, {}).items():
            e = ds.field(k).cast("string").isin([str(x) for x in v])
            keep = e if keep is None else keep & e
    for k, v in request.get("since", {}).items():
        e = ds.field(k).cast("string") >= str(v)
        keep = e if keep is None else keep & e
    for k, v in request.get("until", {}).items():
        e = ds.field(k).cast("string") < str(v)
        keep = e if keep is None else keep & e
    data = ds.dataset(options["path"], format="parquet")
    if request.get("count"):
        return {"records": [], "next": None, "total": data.count_rows(filter=keep)}
    names = list(request.get("fields") or [n for n in data.schema.names])
    got = data.to_table(columns=sorted({*names, options["key"]}), filter=keep).sort_by(options["key"])
    at = int(request.get("skip") or request.get("token") or 0)
    page = got.slice(at, request["size"]).select(names).to_pylist()
    if "key" in options and options.get("strict") == "true" and not got.num_rows:
        raise NotFound("no record fits")
    end = at + len(page)
    return {"records": page, "next": str(end) if end < got.num_rows else None, "total": got.num_rows}


SERVICES: dict[str, Callable[[dict, dict], dict]] = {"http": http, "table": table}


def retried(ask: Callable, attempts: int = 5, first_wait: float = 2.0, most: float = 60.0, least_gap: float = 0.0) -> Callable:
    """Tries again with doubling waits and keeps a least time between requests; the last failure is raised."""
    last = [0.0]

    def run(*args):
        wait = first_wait
        for i in range(attempts):
            gap = last[0] + least_gap - time.monotonic()
            if gap > 0:
                time.sleep(gap)
            last[0] = time.monotonic()
            try:
                return ask(*args)
            except NotFound:
                raise
            except Exception:
                if i == attempts - 1:
                    raise
                time.sleep(min(wait, most))
                wait *= 2
        return None

    return run


def _asker(options: dict) -> Callable[[dict], dict]:
    ask = SERVICES[options.get("service", "http")]
    tried = retried(lambda request: ask(request, options), first_wait=float(options.get("first_wait", 2)), least_gap=float(options.get("least_gap", 0)))

    def run(request: dict) -> dict:
        try:
            return tried(request)
        except NotFound:
            return {"records": [], "next": None, "total": 0}

    return run


def request_of(options: dict) -> dict:
    """The request that a source's options state: where.F, since.F, until.F and ids.F, fields, page_size, page_by, count."""
    out: dict[str, Any] = {"size": min(PAGE_LIMIT, int(options.get("page_size", PAGE_LIMIT)))}
    for part in ("where", "since", "until", "ids"):
        named = {k[len(part) + 1 :]: v for k, v in options.items() if k.startswith(f"{part}.")}
        if named:
            # several values as a JSON list, or joined by commas
            out[part] = {k: json.loads(v) if v.startswith("[") else v.split(",") for k, v in named.items()} if part in ("where", "ids") else named
    if options.get("fields"):
        out["fields"] = options["fields"].split(",")
    return out


def pages(ask: Callable[[dict], dict], request: dict, by: str = "token", max_pages: int = 1_000_000) -> Iterator[list[dict]]:
    """Pages until there is no next token, or, counted by records passed over, until a page is short."""
    at: Any = 0 if by == "skip" else None
    for _ in range(max_pages):
        got = ask({**request, by: at})
        yield got["records"]
        if by == "skip":
            at += len(got["records"])
            if len(got["records"]) < request["size"]:
                return
        else:
            at = got["next"]
            if not at:
                return


class ServiceSource(DataSource):
    """format('service'): records as JSON text, or with option count the number of records alone.

    Options: service, its own options, those of ``request_of``, page_by (token or skip), max_pages, first_wait, least_gap.
    """

    @classmethod
    def name(cls) -> str:
        return "service"

    def schema(self) -> str:
        return "total bigint" if str(self.options.get("count", "")).lower() == "true" else "record string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ServiceReader(dict(self.options))


class _ServiceReader(DataSourceReader):
    """One partition for each slice of ids; all else is one walk through the pages, which know no other order."""

    def __init__(self, options: dict):
        self.o = options

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        ask, request = _asker(self.o), request_of(self.o)
        if str(self.o.get("count", "")).lower() == "true":
            yield (int(ask({**request, "count": True})["total"]),)
            return
        for page in pages(ask, request, self.o.get("page_by", "token"), int(self.o.get("max_pages", 1_000_000))):
            for r in page:
                yield (json.dumps(r, default=str),)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ServiceSource)


def search(spark: SparkSession, options: dict[str, str], schema: str) -> DataFrame:
    """The records of a search as columns; the fields of the schema are all that the service is asked for."""
    register(spark)
    names = spark.createDataFrame([], schema).columns
    got = spark.read.format("service").options(**{**options, "fields": ",".join(names)}).load()
    return got.select(F.from_json("record", schema).alias("r")).select("r.*")


def count(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """(total): the number of records that fit, without reading any."""
    register(spark)
    return spark.read.format("service").options(**{**options, "count": "true"}).load()


def search_ids(spark: SparkSession, options: dict[str, str], field: str, kind: str, at_most: int = ID_LIMIT) -> DataFrame:
    """The ids of the records that fit, in the service's order, at most ``at_most``, which is the services' own limit."""
    size = min(PAGE_LIMIT, at_most)
    return search(spark, {**options, "page_size": str(size), "max_pages": str(-(-at_most // size))}, f"{field} {kind}").limit(at_most)


def fetch_by_ids(ids: DataFrame, col: str, options: dict[str, str], field: str, batch: int = 200) -> DataFrame:
    """(batch, record, error): the records of many ids, asked for in batches by the executors.

    A batch that fails after all tries gives one row with the error and no record, and does not stop the others.
    """
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = _asker(options)
        for pdf in frames:
            values, rows = pdf["id"].tolist(), []
            for i in range(0, len(values), batch):
                part = values[i : i + batch]
                name = f"{part[0]}..{part[-1]}"
                request = {**request_of(options), "ids": {field: part}, "size": PAGE_LIMIT}
                try:
                    rows += [(name, json.dumps(r, default=str), None) for page in pages(ask, request) for r in page]
                except Exception as e:  # noqa: BLE001 - kept as a row
                    rows.append((name, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["batch", "record", "error"])

    wanted = ids.select(F.col(col).cast("string").alias("id")).filter("id <> ''").distinct()
    return wanted.mapInPandas(run, "batch string, record string, error string")


def count_by_term(spark: SparkSession, options: dict[str, str], term: str, weight: str | None = None, top: int | None = None) -> DataFrame:
    """(term, n) of the records that fit, most frequent first; a service that finds nothing gives no rows."""
    schema = f"{term} string" + (f", {weight} bigint" if weight else "")
    n = F.sum(weight) if weight else F.count(F.lit(1))
    out = search(spark, options, schema).filter(F.col(term).isNotNull()).groupBy(F.col(term).alias("term")).agg(n.alias("n"))
    return out.orderBy(F.desc("n"), "term").limit(top) if top else out


def synonyms(names: DataFrame, col: str, options: dict[str, str], field: str, value: str, at_most: int = 50) -> DataFrame:
    """(name, synonym, error): up to ``at_most`` synonyms per name, in alphabetical order; a failed batch is a row with its error."""
    from pyspark.sql import Window

    got = fetch_by_ids(names, col, options, field)
    r = F.from_json("record", f"{field} string, {value} string")
    w = Window.partitionBy("name").orderBy("synonym")
    rows = got.select(r[field].alias("name"), r[value].alias("synonym"), "error")
    known = rows.filter("synonym is not null").select("name", "synonym").distinct().withColumn("rank", F.row_number().over(w))
    return known.filter(F.col("rank") <= at_most).select("name", "synonym", F.lit(None).cast("string").alias("error")).unionByName(
        rows.filter("error is not null")
    )
