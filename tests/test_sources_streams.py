import datetime as dt
import sqlite3
import time

import pytest

from pyspark.sql import functions as F

from lodestream.operators import models as M
from lodestream.sources import connectors as C
from lodestream.sources import services as SV
from lodestream.streaming import jobs
from tests.conftest import rows


def test_delimited_text(spark, tmp_path):
    (tmp_path / "s.txt").write_text("nct_id|phase|enrollment\nN1||5\nN2|P1|\n")
    df = C.delimited(spark, str(tmp_path / "s.txt"), "nct_id string, phase string, enrollment int", required=("nct_id",))
    assert rows(df) == [("N1", None, 5), ("N2", "P1", None)]


def test_xml_articles(spark):
    x = "<A><PMID>7</PMID><ArticleTitle>T</ArticleTitle><AbstractText>a</AbstractText><AbstractText>b</AbstractText><MeshHeading><DescriptorName>m</DescriptorName></MeshHeading></A>"
    df = spark.createDataFrame([(x,), (None,)], "x string")
    r = C.articles_from_xml(df, "x").collect()
    assert len(r) == 1 and (r[0]["pmid"], r[0]["title"], r[0]["abstract"], r[0]["mesh_terms"], r[0]["journal"]) == ("7", "T", "a b", "m", None)


def test_sqlite_partitions(spark, tmp_path):
    path = str(tmp_path / "m.db")
    with sqlite3.connect(path) as con:
        con.execute("create table mol (id integer, name text, phase real)")
        con.executemany("insert into mol values (?, ?, ?)", [(i, f"m{i}", i / 2) for i in range(1, 24)])
    C.register(spark)
    df = spark.read.format("sqlite_table").options(path=path, table="mol", key="id", parts="4").load()
    assert df.rdd.getNumPartitions() == 4
    assert df.count() == 23 and df.agg(F.sum("phase")).first()[0] == 138.0


def test_requests_are_retried_and_kept_apart():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("down")
        return "ok"

    assert SV.retried(flaky, first_wait=0.0)(1) == "ok" and len(calls) == 3
    with pytest.raises(OSError):
        SV.retried(lambda: (_ for _ in ()).throw(OSError("down")), attempts=2, first_wait=0.0)()
    begin = time.monotonic()
    kept = SV.retried(lambda: None, least_gap=0.05)
    kept(), kept(), kept()
    assert time.monotonic() - begin >= 0.1


def test_pages_by_token_and_by_records_passed_over():
    data = [{"n": i} for i in range(25)]

    def ask(r):
        at = int(r.get("skip") or r.get("token") or 0)
        part = data[at : at + r["size"]]
        return {"records": part, "next": str(at + len(part)) if at + len(part) < len(data) else None}

    for by in ("token", "skip"):
        for size in (5, 7, 25, 100):
            assert [r["n"] for p in SV.pages(ask, {"size": size}, by) for r in p] == list(range(25)), (by, size)
    assert len(list(SV.pages(ask, {"size": 5}, max_pages=2))) == 2


def test_failed_batches_are_rows_and_not_found_is_empty(spark, tmp_path):
    spark.createDataFrame([(i, f"n{i}") for i in range(6)], "id int, name string").write.parquet(str(tmp_path / "t"))
    ids = spark.createDataFrame([(str(i),) for i in range(6)] + [(None,), ("",)], "id string").coalesce(1)
    o = {"service": "table", "path": str(tmp_path / "t"), "key": "id", "first_wait": "0"}
    got = SV.fetch_by_ids(ids, "id", o, "id", batch=4)
    assert got.filter("record is not null").count() == 6 and got.filter("error is not null").count() == 0
    bad = SV.fetch_by_ids(ids, "id", {**o, "path": str(tmp_path / "gone")}, "id", batch=10)
    assert [r["record"] for r in bad.collect()] == [None] and "FileNotFound" in bad.first()["error"]
    none = SV.search(spark, {**o, "where.id": "77", "strict": "true"}, "id int")
    assert none.count() == 0
    assert SV.count(spark, {**o, "where.id": "1,2,77"}).first()[0] == 2


def test_graphml_is_well_formed(spark, tmp_path):
    from xml.etree import ElementTree

    e = spark.createDataFrame([("a<b", 'c"&d', 2.5), ("x", "y", None)], "src string, dst string, weight double")
    C.write_graphml(e, str(tmp_path / "g"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    assert len(ElementTree.fromstring(text.encode()).findall(".//{*}node")) == 4
    assert rows(C.read_graphml(spark, str(tmp_path / "g"))) == [("a<b", 'c"&d', 2.5), ("x", "y", 1.0)]


def test_progress_moves_after_the_data(spark, tmp_path):
    state, target = str(tmp_path / "state"), str(tmp_path / "t")
    day = lambda n: dt.datetime(2024, 1, n)
    a = spark.createDataFrame([(1, day(1)), (2, day(2)), (3, None)], "id int, ts timestamp")
    b = spark.createDataFrame([(2, day(2)), (4, day(2)), (5, day(3))], "id int, ts timestamp")
    assert C.saved_progress(spark, state) == {}
    assert [C.take_over(spark, state, "s", x, "ts", target) for x in (a, a, b, b)] == [2, 0, 2, 0]
    assert C.saved_progress(spark, state) == {"s": "2024-01-03"} and spark.read.parquet(target).count() == 4


def test_append_by_day(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), 1), (dt.datetime(2024, 1, 2), 2)], "ts timestamp, v int")
    for _ in range(2):
        C.append_by_day(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).filter("dt = '2024-01-01'").count() == 2


def test_model_store(spark, tmp_path):
    df = spark.range(40).select((F.col("id") % 4).cast("double").alias("a"), (F.col("id") % 4 > 1).cast("int").alias("label"))
    m, _ = M.train_all(df, ["a"], ["logistic"])
    for v in ("1", "2"):
        M.save_version(m["logistic"], str(tmp_path), "l", v, {"auc": 1.0})
    assert M.latest_version(str(tmp_path), "l") == "2"
    assert M.predict(M.load_version(str(tmp_path), "l"), df, ["a"], ["label"]).count() == 40


def test_stream_equals_batch_and_reruns(spark, tmp_path):
    src = tmp_path / "in"
    ts = dt.datetime(2024, 1, 1)
    rows1 = [(i, ts + dt.timedelta(hours=i), i % 3, "view", float(i)) for i in range(30)]
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    spark.createDataFrame(rows1, schema).coalesce(1).write.parquet(str(src / "a"))
    s = lambda: jobs.file_stream(spark, str(src / "*"), str(src / "a"))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    sink = jobs.upsert_sink(out, ["user_id"], ["ts", "event_id"])
    jobs.drain_batches(s(), sink, ck, "append")
    assert {r["event_id"] for r in jobs.latest(spark, out).collect()} == {27, 28, 29}
    spark.createDataFrame([(99, ts + dt.timedelta(days=9), 1, "buy", 1.0)], schema).coalesce(1).write.parquet(str(src / "b"))
    jobs.drain_batches(s(), sink, ck, "append")
    assert {r["event_id"] for r in jobs.latest(spark, out).collect()} == {27, 99, 29}
    sink(spark.createDataFrame([(99, ts + dt.timedelta(days=9), 1, "buy", 1.0)], schema), 1)  # delivered again
    assert jobs.latest(spark, out).count() == 3


def test_sessions_and_state(spark, tmp_path):
    ts = dt.datetime(2024, 1, 1)
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    data = [(i, ts + dt.timedelta(minutes=m), 1, t, 1.0) for i, (m, t) in enumerate([(0, "a"), (10, "b"), (90, "c")])] + [(9, ts + dt.timedelta(days=5), 2, "z", 1.0)]
    src = str(tmp_path / "in")
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(src)
    jobs.drain(jobs.session_counts(jobs.file_stream(spark, src, src)), str(tmp_path / "s"), str(tmp_path / "sc"))
    assert rows(spark.read.parquet(str(tmp_path / "s")), "user_id", "n") == [(1, 1), (1, 2)]
    got = {}
    jobs.drain_batches(jobs.running_state(jobs.file_stream(spark, src, src)), lambda b, i: got.update({r["user_id"]: (r["n"], r["last_type"]) for r in b.collect()}), str(tmp_path / "k"))
    assert got == {1: (3, "c"), 2: (1, "z")}
