import datetime as dt
import random

import pytest

from lodestream.operators import asof, eager, orphans
from pyspark.sql import functions as F
from tests.conftest import rows

T = dt.datetime


def _refs(spark, data):
    df = spark.createDataFrame(data, "row_id bigint, nct_id string, loaded_at timestamp, key string")
    return orphans.references(df, "r", "t", "row_id", "nct_id", "loaded_at")


def _target(spark, data):
    df = spark.createDataFrame(data, "nct_id string, a timestamp, r timestamp, key int")
    return orphans.versions(df, "t", "nct_id", "a", "r")


@pytest.mark.parametrize("share", [0.01, 0.2, 2.0])
def test_orphans_against_brute_force(spark, share):
    rnd = random.Random(3)
    day = lambda: T(2020, 1, 1) + dt.timedelta(days=rnd.randrange(400))
    targets = [(f"N{i}", day(), day() if i % 3 == 0 else None, 1) for i in range(8)] + [("n1 ", T(2020, 5, 1), None, 2), (None, None, None, 3)]
    keys = ["N0"] * 30 + [f"n{i}" for i in range(8)] + [" N1", "x", "", "  ", None, "N9"]
    data = [(i, rnd.choice(keys), day() if i % 20 else None, "clash") for i in range(300)]

    def bad(k, t):
        k = (k or "").strip().lower()
        v = [(a, r) for n, a, r, _ in targets if n and n.strip().lower() == k]
        if not k:
            return False
        return not v or (t is not None and not any((a is None or a <= t) and (r is None or r > t) for a, r in v))

    want = sorted(i for i, k, t, _ in data if bad(k, t))
    refs, target = _refs(spark, data), _target(spark, targets)
    got = orphans.orphan_rows(refs, target, share)
    assert sorted(r["row_id"] for r in got.collect()) == want
    per = rows(got.groupBy("table_name", "period").agg(F.count("*").alias("n")))
    assert rows(orphans.orphan_counts(refs, target, share)) == per


@pytest.mark.parametrize("per_merge", [1, 7])
def test_orphans_in_the_quarter_of_a_version_are_dealt_over_copies(spark, monkeypatch, per_merge):
    monkeypatch.setattr(orphans, "PER_MERGE", per_merge)
    hour = lambda n: T(2021, 2, 1) + dt.timedelta(hours=n)
    spans = [("k", hour(n), hour(n + 3), 1) for n in range(0, 100, 10)] + [("k", T(2019, 1, 1), T(2019, 1, 2), 1), ("j", None, hour(5), 1)]
    data = [(n, "k", hour(n), "") for n in range(100)] + [(200 + n, "j", hour(n), "") for n in range(10)] * 2
    want = sorted([n for n in range(100) if n % 10 > 2] + [200 + n for n in range(5, 10)] * 2)
    refs, target = _refs(spark, data), _target(spark, spans)
    for share in (0.01, 2.0):
        assert sorted(r["row_id"] for r in orphans.orphan_rows(refs, target, share).collect()) == want
        assert rows(orphans.orphan_counts(refs, target, share)) == [("r", "2021Q1", len(want))]


def test_orphans_of_empty_tables(spark):
    none = _target(spark, [])
    assert orphans.orphan_rows(_refs(spark, []), none).count() == 0
    assert orphans.orphan_counts(_refs(spark, [(1, "a", T(2020, 1, 1), "")]), none).collect()[0]["orphans"] == 1


@pytest.mark.parametrize("share", [2.0, 0.1, 0.02])
def test_as_of_against_brute_force(spark, share):
    rnd = random.Random(5)
    day = lambda: dt.date(2019, 1, 1) + dt.timedelta(days=rnd.randrange(900)) if rnd.random() > 0.05 else None
    ent = ["hot"] * 12 + ["a", "b", None]
    ev = [(rnd.choice(ent), day(), i, 1) for i in range(400)] + [("hot", dt.date(2020, 2, 2), 1000 + i, 1) for i in range(60)]
    ve = [(rnd.choice(ent), day(), i, 2) for i in range(150)] + [("hot", dt.date(2020, 2, 2), 900, 2), ("hot", dt.date(2020, 2, 1), 901, 2)] * 2
    e = spark.createDataFrame(ev, "entity string, day date, event_id bigint, shard int")
    v = spark.createDataFrame(ve, "entity string, day date, version_id bigint, copy int")
    want = []
    for k, d, i, _ in ev:
        c = [(x, n) for n2, x, n, _ in ve if n2 == k and k and d and x and x < d]
        if c:
            want.append((i, max(c)[1]))
    assert rows(asof.as_of(e, v, share)) == sorted(want)
    assert asof.as_of(e.limit(0), v, share).count() == 0
    assert asof.as_of(e, v.limit(0), share).count() == 0


def test_eager_join_equals_plain_join(spark):
    rnd = random.Random(7)
    a = spark.createDataFrame([(rnd.choice(["h"] * 5 + ["x", None]), rnd.randrange(5), "e") for _ in range(200)], "k string, v int, n string")
    b = spark.createDataFrame([(rnd.choice(["h", "x", "y", None]), rnd.choice("pq"), rnd.randrange(3)) for _ in range(80)], "k string, g string, w int")
    plain = rows(a.select("k", "v").join(b, "k").groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.sum("w").alias("w")))
    la = eager.key_states(a, {"k": F.col("k")}, {"v": F.col("v")})
    lb = eager.key_states(b, {"k": F.col("k"), "g": F.col("g")}, {"w": F.col("w")})
    assert rows(eager.roll_up(eager.join_states(la, lb, ["k"], [], ["g"], ["v"], ["w"]), ["g"], ["v", "w"])) == plain


def test_shares_count_nulls_and_meet_the_bound(spark):
    d = [("a",)] * 7 + [("b",)] * 92 + [(None,)] * 600 + [("",)]
    df = spark.createDataFrame(d, "k string")
    assert rows(eager.shares({"t": (df, "k")}, 0.01), "key_value", "n") == [("a", 7), ("b", 92)]
    assert eager.shares({"t": (df.limit(0), "k")}, 0.01).count() == 0


def test_rows_and_distinct(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), (None, 2)], "k string, v int")
    assert rows(eager.rows_and_distinct(df, F.col("k"), F.col("v"), ("k", "n", "d"))) == [(None, 1, 1), ("a", 3, 1)]
