"""Sources and sinks beyond Parquet: delimited text, JSON, XML text, SQLite, graph files, reports; ``services`` has paged services.

Schemas are always given, so nothing is read twice to infer them. The SQLite source is a Python data
source; its partitions are read on executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lodestream.session import cut_lineage


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "|", required: tuple[str, ...] = ()) -> DataFrame:
    """Delimited text with a header; empty fields are null; missing required columns raise ValueError."""
    df = spark.read.option("sep", sep).option("header", True).option("nullValue", "").option("enforceSchema", False).schema(schema).csv(path)
    gone = [c for c in required if c not in df.columns]
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return df


def json_records(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    return spark.read.option("multiLine", multi_line).schema(schema).json(path)


def split_table(spark: SparkSession, path: str, phase: int, split: str) -> DataFrame:
    """A table partitioned by phase and split; the filter prunes partitions."""
    return spark.read.parquet(path).filter((F.col("phase") == phase) & (F.col("split") == split))


def articles_from_xml(df: DataFrame, xml: str) -> DataFrame:
    """(pmid, title, abstract, journal, year, mesh_terms) of article XML held in a text column; bad XML gives nulls."""
    x = lambda p: F.nullif(F.xpath_string(F.col(xml), F.lit(p)), F.lit(""))
    good = F.col(xml).isNotNull()
    return df.filter(good).select(
        x("//PMID").alias("pmid"),
        x("//ArticleTitle").alias("title"),
        F.array_join(F.xpath(F.col(xml), F.lit("//AbstractText/text()")), " ").alias("abstract"),
        x("//Journal/Title").alias("journal"),
        x("//PubDate/Year").alias("year"),
        F.array_join(F.xpath(F.col(xml), F.lit("//MeshHeading/DescriptorName/text()")), "|").alias("mesh_terms"),
    )


class SqliteSource(DataSource):
    """format('sqlite_table'): options path, table, key (integer) and parts; one key range per partition."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        import sqlite3

        kinds = {"INTEGER": "bigint", "REAL": "double"}
        with sqlite3.connect(self.options["path"]) as con:
            cols = con.execute(f'pragma table_info("{self.options["table"]}")').fetchall()
        return ", ".join(f"`{c[1]}` {kinds.get(c[2].upper(), 'string')}" for c in cols)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(dict(self.options), schema.fieldNames())


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.o, self.names = options, names

    def partitions(self) -> list[InputPartition]:
        import sqlite3

        with sqlite3.connect(self.o["path"]) as con:
            lo, hi = con.execute(f'select min("{self.o["key"]}"), max("{self.o["key"]}") from "{self.o["table"]}"').fetchone()
        if lo is None:
            return [InputPartition((0, 0))]
        n = int(self.o.get("parts", 4))
        step = max(1, -(-(hi - lo + 1) // n))
        return [InputPartition((a, a + step)) for a in range(lo, hi + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import sqlite3

        lo, hi = partition.value
        cols = ", ".join(f'"{c}"' for c in self.names)
        with sqlite3.connect(self.o["path"]) as con:
            sql = f'select {cols} from "{self.o["table"]}" where "{self.o["key"]}" >= ? and "{self.o["key"]}" < ?'
            yield from con.execute(sql, (lo, hi))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_by_day(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends to a table partitioned by day; Spark commits the files of a run at once."""
    df.withColumn("dt", F.to_date(ts)).write.partitionBy("dt").mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def log_run(spark: SparkSession, path: str, run: str, metrics: dict[str, float]) -> None:
    """Appends a run's metrics, one row each."""
    rows = [(run, k, float(v)) for k, v in sorted(metrics.items())]
    spark.createDataFrame(rows, "run string, metric string, value double").coalesce(1).write.mode("append").parquet(path)


def best_run(spark: SparkSession, path: str, metric: str, limit: int = 1) -> DataFrame:
    """(run, value) of the runs with the largest value of a metric; ties go to the first name."""
    return spark.read.parquet(path).filter(F.col("metric") == metric).orderBy(F.desc("value"), "run").limit(limit).select("run", "value")


def assembled_texts(docs: DataFrame, key: str, passages: str) -> DataFrame:
    """(key, text): the texts of a document's passages (structs with a list ``text``), one per line; none gives an empty text."""
    parts = F.flatten(F.transform(F.coalesce(F.col(passages), F.array()), lambda p: F.coalesce(p["text"], F.array())))
    return docs.select(key, F.array_join(parts, "\n").alias("text"))


_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def _escaped(c: str) -> Column:
    out = F.coalesce(F.col(c).cast("string"), F.lit(""))
    for ch, code in _ESCAPES:
        out = F.replace(out, F.lit(ch), F.lit(code))
    return out


def write_graphml(edges: DataFrame, path: str) -> None:
    """Weighted undirected edges (src, dst, weight) as GraphML: the parts of the folder, in order of their names, are the file."""
    node = F.format_string('<node id="%s"/>', "id")
    edge = F.format_string('<edge source="%s" target="%s"><data key="weight">%s</data></edge>', "s", "t", "w")
    ends = edges.select(_escaped("src").alias("s"), _escaped("dst").alias("t"), F.col("weight").cast("double").cast("string").alias("w"))
    ids = ends.select(F.col("s").alias("id")).unionByName(ends.select(F.col("t").alias("id"))).distinct()
    spark = edges.sparkSession
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
    head += '<key id="weight" for="edge" attr.name="weight" attr.type="double"/>\n<graph edgedefault="undirected">'
    frame = spark.createDataFrame([(0, head), (3, "</graph>\n</graphml>")], "part int, line string")
    lines = frame.unionByName(ids.select(F.lit(1).alias("part"), node.alias("line"))).unionByName(ends.select(F.lit(2).alias("part"), edge.alias("line")))
    lines.orderBy("part", "line").select("line").write.mode("overwrite").text(path)


def read_graphml(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight) of a GraphML file or folder; an edge without a weight has weight 1."""
    schema = "_source string, _target string, data array<struct<_key string, _VALUE double>>"
    e = spark.read.format("xml").option("rowTag", "edge").schema(schema).load(path)
    w = F.try_element_at(F.filter("data", lambda x: x["_key"] == "weight"), F.lit(1))["_VALUE"]
    return e.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.coalesce(w, F.lit(1.0)).alias("weight"))


def markdown_report(title: str, sections: dict[str, DataFrame], at_most: int = 100) -> str:
    """A report of small results, one section each."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown_table(df, at_most)}" for name, df in sections.items())]) + "\n"


def markdown_table(df: DataFrame, at_most: int = 100) -> str:
    """The first rows of a small result as a Markdown table; a note tells when rows were left out."""
    rows = df.limit(at_most + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:at_most]]
    if len(rows) > at_most:
        lines.append(f"\nOnly the first {at_most} rows are shown.")
    return "\n".join(lines)


def saved_progress(spark: SparkSession, path: str) -> dict[str, str]:
    """{source: the latest day up to which it was taken over}; nothing yet: empty."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return {}
    rows = spark.read.schema("source string, last_updated string").json(path).groupBy("source").agg(F.max("last_updated").alias("d"))
    return {r["source"]: r["d"] for r in rows.collect()}  # one row per source


def save_progress(spark: SparkSession, path: str, source: str, day: str) -> None:
    """Adds a line to the state, to be called after the data of the source are committed: a lost run is taken over again."""
    spark.createDataFrame([(source, day)], "source string, last_updated string").coalesce(1).write.mode("append").json(path)


def take_over(spark: SparkSession, state: str, source: str, rows: DataFrame, day: str, target: str) -> int:
    """Appends the rows of a source from its saved day on to a table, then moves the day on; returns the rows added.

    The saved day is taken over again, as a day may have been incomplete, so rows of it that are there already are left out.
    """
    since = saved_progress(spark, state).get(source)
    d = F.to_date(day)
    fresh = rows.filter(d.isNotNull() if since is None else d >= F.lit(since).cast("date"))
    if since is not None:
        seen = spark.read.parquet(target).filter(d >= F.lit(since).cast("date"))
        fresh = fresh.join(seen, rows.columns, "left_anti")
    fresh = cut_lineage(fresh)
    n, last = fresh.agg(F.count(F.lit(1)), F.max(d)).first()
    if n:
        fresh.write.mode("append").parquet(target)
        save_progress(spark, state, source, str(last))
    return n
