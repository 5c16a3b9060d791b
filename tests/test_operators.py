import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestream.functions import text as T
from lodestream.functions import validate as V
from lodestream.operators import evaluation as E
from lodestream.operators import features as FE
from lodestream.operators import graph as G
from lodestream.operators import models as M
from lodestream.operators import monitoring as MO
from lodestream.operators import passages as P
from lodestream.operators import relational as R
from lodestream.operators import search as S
from tests.conftest import rows


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr).first()[0]


def test_text_functions(spark):
    assert one(spark, T.sentences(F.col("a")), a="First one here. Second one!\nshort\nThird line of it") == ["First one here.", "Second one!", "Third line of it"]
    assert one(spark, T.title_case(F.col("a")), a="o'neil mc-coy") == "O'Neil Mc-Coy"
    assert one(spark, T.occurrences(F.col("a"), F.lit("aa")), a="aaaa") == 2
    assert one(spark, T.occurrences(F.col("a"), F.lit("")), a="aaaa") == 0
    for a, want in ((" Phase II ", "PHASE2"), ("P1", "PHASE1"), ("phase-III", "PHASE3"), ("EARLY_P1", "EARLY_PHASE1"), ("iv", "IV"), ("", "")):
        assert one(spark, T.phase_code(F.col("a")), a=a) == want
    assert one(spark, T.study_type_code(F.col("a")), a=" obs ") == "OBSERVATIONAL"
    assert one(spark, T.phase_code(F.col("a")), a="odd") == "ODD"
    assert one(spark, T.unquoted(F.col("a")), a="\"'x'\"") == "x"
    assert len(one(spark, T.truncated(F.col("a")), a="y" * 300)) == 200
    a, b = (one(spark, T.canonical_hash(*p), a=" v ") for p in ([("x", F.col("a")), ("y", F.lit("1"))], [("y", F.lit("1")), ("x", F.col("a"))]))
    assert a == b and len(a) == 16


def test_validation(spark):
    assert one(spark, V.whole(F.col("a")), a="-12") == -12
    assert one(spark, V.whole(F.col("a")), a="1.0") is None
    assert one(spark, V.number(F.col("a")), a="1e5") is None
    assert one(spark, V.boolean(F.col("a")), a="TRUE") is True
    assert one(spark, V.categorical(F.col("a"), ["x"]), a="None") is None
    assert one(spark, V.multi_categorical(F.col("a"), ["x", "y"]), a='["y", "x"]') == ["y", "x"]
    assert one(spark, V.multi_categorical(F.col("a"), ["x"]), a='["z"]') is None


def test_upsert_and_keep_last(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (None, "n", 1)], "k int, v string, o int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1), (None, "x", 9)], "k int, v string, o int")
    assert rows(R.upsert(old, new, ["k"], ["o"]), "k", "v") == [(None, "n"), (1, "a"), (2, "d"), (3, "e")]
    assert rows(R.upsert_counts(old, new, "k")) == [(1, 1, 3)]
    assert R.upsert(old.limit(0), new.limit(0), ["k"], ["o"]).count() == 0


def test_leaking_columns():
    assert R.is_leaking("overall_status") and R.is_leaking("resultsPosted") and R.is_leaking("whyStopped")
    assert R.is_leaking("last-known_status") and R.is_leaking("dispositionModule") and not R.is_leaking("white_label") and not R.is_leaking("outcomes")
    assert not R.is_leaking("brief_title") and not R.is_leaking("start_date")


def test_pagerank_golden(spark):
    e = spark.createDataFrame([("p1", "a", 1.0), ("p2", "a", 0.5), ("p2", "b", 0.5), ("x", "x", 9.0), (None, "a", 1.0)], "src string, dst string, weight double")
    r = spark.createDataFrame([("a", 1.0), ("zz", -1.0)], "node string, weight double")
    got = {x["node"]: round(x["rank"], 6) for x in G.personalised_pagerank(e, r, 0.5, 30).collect()}
    assert got == {"a": 0.636364, "p1": 0.212121, "p2": 0.121212, "b": 0.030303}


def test_pagerank_keeps_mass_of_isolated_resets(spark):
    e = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    r = spark.createDataFrame([("a", 1.0), ("lone", 1.0)], "node string, weight double")
    got = G.personalised_pagerank(e, r, 0.5, 30).agg(F.sum("rank")).first()[0]
    assert abs(got - 1) < 1e-6
    with pytest.raises(ValueError):
        G.personalised_pagerank(e, r.limit(0))


def test_top_k_ties_nulls_and_blocks(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "id bigint, vec array<double>")
    q = d.select(F.col("id").alias("query_id"), "vec").filter("id in (1, 3, 4)")
    want = [(1, 1, 1), (1, 2, 2), (3, 3, 1), (3, 1, 2)]
    for block in (1, 100):
        assert sorted(rows(G.top_k_vectors(d, q, 2, block), "query_id", "id", "rank")) == sorted(want)
    assert G.top_k_vectors(d.limit(0), q.limit(0), 2).count() == 0


def test_front_and_volume(spark):
    pts = [(1, 3.0, 1.0), (2, 1.0, 3.0), (3, 2.0, 2.0), (4, 1.0, 1.0), (5, 2.0, 2.0), (6, None, 9.0)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    front = S.front_2d(df, "id", "x", "y")
    assert [r[0] for r in rows(front)] == [1, 2, 3, 5]
    assert S.hypervolume_2d(front, "x", "y").first()[0] == 6.0
    assert S.hypervolume([[3, 1], [1, 3], [2, 2]], [0, 0]) == 6.0
    assert S.contributions([[3.0, 1.0], [1.0, 3.0]], [0.0, 0.0]) == [2.0, 2.0]
    assert S.front_of([[0.9, 0.1, 0.5], [0.1, 0.9, 0.5], [0.5, 0.5, 0.5], [0.3, 0.3, 0.3]]) == [0, 1, 2]
    assert S.front_2d(df.limit(0), "id", "x", "y").count() == 0
    assert S.branching(1) == 2 and S.branching(10**9) == 8


def test_tree_search_finds_good_features():
    gain = {"a": 0.2, "b": 0.1, "c": -0.1}

    def evaluate(fs):
        return [0.5 + sum(gain[f] for f in fs), 1 - len(fs) / 50], [f for f in "abc" if f not in fs]

    best = S.tree_search((), evaluate, 40)
    assert set(best.features) == {"a", "b"}


def test_curves_golden(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.7), (None, 0.1), (1, None)], "label int, score double")
    assert E.curve_metrics(df).first()["roc_auc"] == 0.625
    assert E.curve_metrics(df.filter("label = 1")).first()["roc_auc"] == 0.0
    a = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    b = spark.createDataFrame([(2.5,), (3.5,)], "x double")
    assert E.ks_statistic(a, b).first()["d"] == round(2 / 3, 6)
    assert E.ks_statistic(a.limit(0), b).first()["n_a"] == 0


def test_matching_and_overlaps(spark):
    g = spark.createDataFrame([("d", 0, 5, "x", 1), ("d", 3, 9, "x", 2)], "doc_id string, start bigint, end bigint, label string, id bigint")
    p = spark.createDataFrame([("d", 1, 4, "x", 10, 0.9), ("d", 4, 9, "x", 11, 0.5), ("d", 5, 9, "y", 12, 0.99)], "doc_id string, start bigint, end bigint, label string, id bigint, score double")
    assert rows(E.greedy_matches(g, p)) == [("d", 1, 10), ("d", 2, 11)]
    s = spark.createDataFrame([("d", 0, 5, 1), ("d", 0, 9, 2), ("d", 4, 12, 3), ("d", 9, 10, 4)], "doc_id string, start bigint, end bigint, id bigint")
    assert rows(E.without_overlaps(s)) == [("d", 2), ("d", 4)]


def test_split_invariants(spark):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") == 0, "lone").otherwise((F.col("id") % 3).cast("string")).alias("s"))
    a = FE.stratified_split(df, "id", ["s"]).collect()
    assert sorted(r["id"] for r in a) == list(range(500))
    assert [r["split"] for r in a if r["s"] == "lone"] == ["train"]
    share = sum(r["split"] == "train" for r in a) / 500
    assert abs(share - 0.6) < 0.02
    b = FE.stratified_split(df.repartition(7), "id", ["s"]).collect()
    assert {(r["id"], r["split"]) for r in a} == {(r["id"], r["split"]) for r in b}


def test_features_long_wide(spark):
    long = spark.createDataFrame([("t", "f", "a", "1"), ("t", "f", "a", "2"), ("u", "g", None, "x")], "trial_id string, feature string, sub string, value string")
    w = FE.wide(long, ["f--a", "g--value"])
    assert rows(w) == [("t", "2", None), ("u", None, "x")]
    assert rows(FE.long(w, "trial_id", ["f--a", "g--value"])) == [("t", "f", "a", "2"), ("u", "g", "value", "x")]


def test_models_and_drift(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 20).cast("double").alias("a"), F.when(F.col("id") % 7 > 0, F.lit(1.0)).alias("b"), (F.col("id") % 20 > 10).cast("int").alias("label"))
    models, failed = M.train_all(df, ["a", "b"], ["logistic", "gbt"])
    assert not failed
    p = M.predict(models["gbt"], df, ["a", "b"], ["id", "label"])
    assert p.filter("predicted = label").count() > 190
    assert M.objectives(1.2, 0) == (1.0, 1.0)
    t0 = dt.datetime(2024, 1, 1)
    log = [(t0 + dt.timedelta(hours=i), "e", "m", 0.3 if i < 30 else 0.8, 1.0) for i in range(60)]
    schema = "ts timestamp, entity string, model string, probability double, latency double"
    assert MO.drift(spark.createDataFrame(log, schema))["status"] == "drift"
    assert MO.drift(spark.createDataFrame([(*r[:3], 0.5, 1.0) for r in log], schema))["status"] == "stable"
    assert MO.drift(spark.createDataFrame(log[:5], schema))["status"] == "insufficient"
    x = spark.createDataFrame([(t0, "e", "m", None, v) for v in (1.0, 2.0, 10.0)], schema)
    assert MO.metrics(x).first()["p99_latency"] == 9.84


def test_passages_skip_empty_rows(spark):
    s = "nct_id string, start_date string, brief_title string, official_title string, phases string, study_type string, conditions string, lead_sponsor string, brief_summary string, eligibility_criteria string"
    df = spark.createDataFrame([("N1", "2020", "T", None, "", None, "a|b", None, None, None), ("N2", *[None] * 9), (None, "2020", "T", *[None] * 7)], s)
    assert rows(P.trial_passages(df), "doc_id", "text") == [("N1", "Title: T. Conditions: a, b.")]
    with pytest.raises(ValueError):
        P.all_passages({})


def test_text_ladder_and_strategies(spark):
    cols = "doc_id string, start bigint, end bigint, label string, id bigint, text string"
    g = spark.createDataFrame([("d", 10 * i, 10 * i + 5, "x", i, t) for i, t in enumerate(["Alpha", "beta", "gamma", "delta", "eps", "zeta"])] + [("e", 0, 5, "x", 9, "alpha"), ("d", 90, 95, None, 7, "nolabel")], cols)
    p = spark.createDataFrame([
        ("d", 70, 75, "x", 20, "ALPHA", 0.0), ("d", 12, 18, "x", 21, "other", None), ("d", 70, 75, "y", 22, "Gamma", 0.5),
        ("d", 32, 38, "y", 23, "more", 0.5), ("d", 80, 85, "y", 24, "epsilon", 0.5), ("d", 10, 15, "z", 25, "q", 0.9),
    ], cols + ", score double")
    got = {(r["doc_id"], r["id"]): r["verdict"] for r in E.six_way_ladder(g, p).collect()}
    want = ["matched_exact", "matched_relaxed", "wrong_label", "partial_span", "text_found_no_label", "not_found"]
    assert [got["d", i] for i in range(6)] == want and got["e", 9] == got["d", 7] == "not_found"
    r = {x["label"]: x for x in E.span_recall(g, p).collect()}
    assert (r[None]["total"], r[None]["text_matched"], r[None]["span_matched"], r["x"]["text_recall_pct"]) == (7, 2, 2, 28.6)
    assert rows(E.greedy_matches(g, p)) == [("d", 1, 21)]
    assert rows(E.greedy_matches(g, p, strategy="text_only")) == [("d", 0, 20)]
    assert rows(E.greedy_matches(g, p, strategy="strict")) == []
    assert rows(E.greedy_matches(g, p, strategy="strict", accepted={"x": ["x", "z"]})) == [("d", 1, 25)]
    assert rows(E.greedy_matches(g, p, accepted={"x": ["y"]})) == [("d", 3, 23)]
    s = {x["label"]: (x["tp"], x["fp"], x["fn"]) for x in E.label_stats(E.matched_labels(g, p, "strict", {"x": ["x", "z"]})).collect()}
    assert s == {"x": (1, 2, 6), "y": (0, 3, 0)}
    docs = spark.createDataFrame([("a",), ("b",), ("d",), ("e",)], "doc_id string")
    q = {x["quartile"]: x for x in E.quartile_diagnosis(docs, g, p).collect()}
    assert [q[i]["doc_id"] for i in (1, 2, 3)] == ["b", "e", "d"] and q[1]["golds"] == 0
    assert (q[3]["golds"], q[3]["text_matched"], q[3]["relaxed_matched"]) == (6, 1, 1)
    assert [m["text"] for m in q[3]["missed"]] == ["beta", "gamma", "delta", "eps", "zeta"] and q[3]["missed"][0]["partial"] is None


def test_equal_scores_go_to_the_first_span(spark):
    g = spark.createDataFrame([("d", 0, 9, "x", 1)], "doc_id string, start bigint, end bigint, label string, id bigint")
    p = spark.createDataFrame([("d", 5, 7, "x", 10, 0.5), ("d", 1, 3, "x", 11, 0.5)], "doc_id string, start bigint, end bigint, label string, id bigint, score double")
    assert rows(E.greedy_matches(g, p)) == [("d", 1, 11)]


def test_sentences_are_used_once(spark):
    inc = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "a"), (4, "b"), (4, "d"), (1, "b")], "sentence_id bigint, entity string")
    sim = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, 0.1), (4, 0.5)], "sentence_id bigint, similarity double")
    seeds = spark.createDataFrame([("a", 1.0)], "entity string, score double")
    got = {r["entity"]: (round(r["score"], 6), r["tier"]) for r in G.spread_sentences(seeds, inc, sim, 2, 0.2, top_sentences=2).collect()}
    # hop 1: sentences 1 and 2; hop 2: a (0.9) has only 3 left, b (0.5) only 4
    assert got == {"a": (1.99, 1), "b": (0.75, 2), "c": (0.4, 1), "d": (0.25, 2)}
    p = spark.createDataFrame([(1, "Aspirin helped them. No aspirin here, but zinc zinc.\nAspirin helped them.")], "passage_id int, text string")
    e = spark.createDataFrame([("aspirin",), ("zinc",)], "entity string")
    m = G.sentence_mentions(p, e).collect()
    assert len(m) == 3 and len({r["sentence_id"] for r in m}) == 2
