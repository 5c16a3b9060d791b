"""The entity graph: mentions, search, hubs, stored results."""

import pytest
from pyspark.sql import functions as F

from lodestream.operators import graph as G
from lodestream.operators import records as X
from lodestream.streaming import jobs
from tests.conftest import rows


def passages(spark):
    data = [(1, "Heart failure, heart-failure and aspirin."), (2, "aspirin ASPIRIN"), (3, None), (4, ""), (5, "no name of note")]
    return spark.createDataFrame(data, "passage_id bigint, text string")


def test_mentions_of_several_words(spark):
    e = spark.createDataFrame([("Heart Failure",), ("aspirin",), ("Aspirin",), ("failure",), ("",), (None,), (" - ",)], "entity string")
    got = rows(G.mentions(passages(spark), e))
    assert got == [(1, "Aspirin", 1), (1, "Heart Failure", 2), (1, "aspirin", 1), (1, "failure", 2), (2, "Aspirin", 2), (2, "aspirin", 2)]
    spans = rows(G.mention_spans(passages(spark), e).filter("entity = 'Heart Failure'"), "start", "end")
    assert spans == [(0, 2), (2, 4)]
    assert G.mentions(passages(spark), e.limit(0)).count() == 0


def test_recognition_falls_back(spark):
    none = spark.createDataFrame([], "entity string")
    assert rows(G.recognised(passages(spark), none, "asp[a-z]+")) == [(1, "aspirin", 1), (2, "aspirin", 2)]
    with pytest.raises(ValueError):
        G.recognised(passages(spark))


def test_known_mentions_stay(spark):
    a = spark.createDataFrame([(1, "x", 3)], "passage_id int, entity string, n int")
    b = spark.createDataFrame([(1, "x", 9), (1, "y", 1), (2, "z", 1)], "passage_id int, entity string, n int")
    assert rows(G.merged_mentions(a, b)) == [(1, "x", 3), (2, "z", 1)]


@pytest.mark.parametrize("hub", [1, 2, 10**6])
def test_hubs_change_nothing(spark, monkeypatch, hub):
    monkeypatch.setattr(G, "HUB", hub)
    e = spark.createDataFrame([("h", c, float(i + 1)) for i, c in enumerate("abcdefg")] + [("a", "b", 1.0)], "src string, dst string, weight double")
    r = spark.createDataFrame([("a", 1.0), ("lost", 1.0)], "node string, weight double")
    got = {x["node"]: x["rank"] for x in G.personalised_pagerank(e, r, 0.5, 6).collect()}
    edges = {}
    for s, d, w in [("h", c, float(i + 1)) for i, c in enumerate("abcdefg")] + [("a", "b", 1.0)]:
        edges[s, d] = edges[d, s] = w
    rank = {"a": 0.5, "lost": 0.5}
    for _ in range(6):
        back = rank.get("lost", 0.0)
        nxt = {n: 0.5 * (0.5 + 0.5 * back) for n in ("a", "lost")}
        for (s, d), w in edges.items():
            total = sum(x for (p, _), x in edges.items() if p == s)
            nxt[d] = nxt.get(d, 0.0) + 0.5 * rank.get(s, 0.0) * w / total
        rank = nxt
    assert got == pytest.approx(rank) and sum(got.values()) == pytest.approx(1.0)


def test_containment_against_brute_force(spark):
    q = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["c"]), (3, []), (4, ["zz"])], "query_id bigint, words array<string>")
    p = spark.createDataFrame([(i, ["a"] * (i % 2) + ["b"] * (i % 3) + ["c"] * (i % 5 == 0)) for i in range(40)], "passage_id bigint, words array<string>")
    sets = {r["passage_id"]: set(r["words"]) for r in p.collect()}
    want = []
    for k, ws in ((1, {"a", "b"}), (2, {"c"})):
        best = sorted(((-len(ws & s) / len(ws), i) for i, s in sets.items() if ws & s))[:5]
        want += [(k, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    for block in (1, 8192):
        assert rows(G.containment_rank(q, p.repartition(3), 5, block)) == sorted(want)
    assert G.containment_rank(q.limit(0), p, 5).count() == 0 and G.containment_rank(q, p.limit(0), 5).count() == 0


def test_search_needs_no_entities(spark):
    none = spark.createDataFrame([], "entity string, score double")
    dense = spark.createDataFrame([(1, 0.2), (2, 0.9), (3, None), (4, 0.9)], "passage_id bigint, similarity double")
    assert rows(G.search(none, none, none, none, dense, none, 2)) == [(2, 0.9, 1), (4, 0.9, 2)]


def test_index_is_checked_written_and_read(spark, tmp_path):
    e = spark.createDataFrame([("aspirin",)], "entity string")
    with pytest.raises(ValueError):
        G.build_index(passages(spark).drop("text"), e, str(tmp_path / "i"))
    G.build_index(passages(spark), e, str(tmp_path / "i"))
    t = G.load_index(spark, str(tmp_path / "i"))
    assert t["passages"].filter("date is null").count() == 5 and t["mentions"].count() == 2 and t["edges"].count() == 2 + 4


def test_vectors_of_length_one(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0])], "id int, vec array<float>")
    got = G.missing_vectors(v, v.filter("id = 4"), "id", "vec").collect()
    assert [(r["id"], r["vec"]) for r in got] == [(1, [0.6, 0.8])]


def test_results_are_stored_by_tag_and_arguments(spark, tmp_path):
    calls = []

    def work():
        calls.append(1)
        return spark.range(3)

    key = X.memo_key("search", {"k": 1, "source": "a"})
    assert key == X.memo_key("search", {"source": "a", "k": 1}) != X.memo_key("search", {"source": "b", "k": 1})
    for _ in range(2):
        assert X.memoised(spark, key, work, str(tmp_path)).count() == 3
    assert len(calls) == 1
    X.forget(spark, "search", str(tmp_path))
    X.memoised(spark, key, work, str(tmp_path))
    assert len(calls) == 2


def test_only_changed_sources_are_rebuilt(spark, tmp_path):
    done = []
    run = lambda s: X.rebuild_changed(spark, str(tmp_path / "state"), s, lambda n, df: done.append(n))
    a, b = spark.range(3), spark.range(4)
    assert run({"a": a, "b": b}) == {"a": True, "b": True}
    assert run({"a": a, "b": b}) == {"a": False, "b": False}
    assert run({"a": a, "b": b.union(spark.range(1))}) == {"a": False, "b": True} and done == ["a", "b", "b"]


def test_upserts_rewrite_only_their_buckets(spark, tmp_path):
    out = str(tmp_path / "t")
    sink = jobs.upsert_sink(out, ["k"], ["v"], buckets=8)
    frame = lambda d: spark.createDataFrame(d, "k string, v int")
    sink(frame([(f"k{i}", i) for i in range(40)] + [(None, 1)]), 0)
    sink(frame([("k1", 100), ("k1", 99), ("new", 5)]), 1)
    sink(frame([("k1", 100), ("k1", 99), ("new", 5)]), 1)
    first, second = (len(list((tmp_path / "t" / f"v={n:09d}").glob("__bucket=*"))) for n in (0, 1))
    assert first > 4 and second <= 2
    got = {r["k"]: r["v"] for r in jobs.latest(spark, out).collect()}
    assert len(got) == 41 and got["k1"] == 100 and got["new"] == 5 and got["k7"] == 7
    assert jobs.latest(spark, out).columns == ["k", "v"]
    with pytest.raises(ValueError):
        jobs.latest(spark, str(tmp_path / "none"))


def test_typed_names_stand_for_the_last_canonical_one(spark):
    n = spark.createDataFrame([("B", "Beta", "x|y"), ("A", "Alpha", "x"), ("C", " ", "z"), ("D", None, "z")], "o string, name string, syn string")
    syn = G.synonym_table(n, "name", "syn", "o")
    typed = spark.createDataFrame([("X ",), ("q",), (None,)], "drug string")
    assert [r["canonical"] for r in G.normalised(typed, "drug", syn).orderBy(F.col("drug").asc_nulls_last()).collect()] == ["beta", "q", None]
