"""Search, models and matching: what SQL can not check."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import evaluation as E
from lodestream.operators import features as FE
from lodestream.operators import models as M
from lodestream.operators import search as S
from tests.conftest import rows

GAIN = {"a": 0.2, "b": 0.1, "c": -0.1}


def step(calls=None):
    """Suggestions name features to add; the score is the sum of their gains."""

    def evaluate(features, suggestion):
        now = tuple(sorted({*features, suggestion})) if suggestion else features
        if calls is not None:
            calls.append(now)
        return [0.5 + sum(GAIN[f] for f in now), 1 - len(now) / 50], [f for f in "abc" if f not in now], now

    return evaluate


@pytest.mark.parametrize("mode", S.MODES)
@pytest.mark.parametrize("deep", [False, True])
def test_search_finds_the_best_set(mode, deep):
    best = S.TreeSearch(step(), mode=mode, deep=deep).run(30)
    assert set(best.features) == {"a", "b"}


@pytest.mark.parametrize("mode", S.MODES)
def test_values_are_those_of_the_tables(spark, mode):
    """The values that the search leaves at its nodes are what node_values works out from its evaluations."""
    s = S.TreeSearch(step(), mode=mode, ref=(0.45, 0.0))
    s.run(12)
    at = {id(n): i for i, n in enumerate(s.nodes)}

    def path(n):
        return ([] if n.parent is None else path(n.parent)) + [at[id(n)]]

    nodes = spark.createDataFrame([(at[id(n)], path(n)) for n in s.nodes], "node_id int, path array<int>")
    evals = spark.createDataFrame([(at[id(n)], k, *v) for n in s.nodes for k, (_, v) in enumerate(n.history)], "node_id int, seq int, x double, y double")
    got = {r["node_id"]: r for r in S.node_values(nodes, evals, ["x", "y"], mode, (0.45, 0.0)).collect()}
    for n in s.nodes:
        if n.visits:
            r = got[at[id(n)]]
            assert r["visits"] == n.visits and [r["x"], r["y"]] == pytest.approx(n.value)
    assert len(got) == sum(n.visits > 0 for n in s.nodes)


def test_a_search_goes_on_from_its_state_without_evaluating_again():
    states, calls = [], []
    whole = S.TreeSearch(step())
    whole.run(20, states.append)
    half = S.TreeSearch(step(calls)).resume(states[9])
    half.run(20)
    assert half.state() == whole.state()
    again = []
    S.TreeSearch(step(again)).resume(states[-1]).run(20)
    assert again == [] and len(calls) < 20


def test_used_up_suggestions_are_passed_over():
    def evaluate(features, suggestion):
        # the second time the root's list is shorter
        return [0.6, 1.0], ["x"], features

    s = S.TreeSearch(evaluate, branch=3)
    s._visit(s.root, 0)
    s.root.suggestions = ["x", "y", "z"]
    s._expand(s.root)
    s.root.suggestions = ["x"]
    assert [s.exhausted(c) for c in s.root.children] == [False, True, True]
    assert s._visit(s.root.children[2], 1) is None and s.root.visits == 1
    assert [c.label for c in s.root.children] == ["suggestion_0: x", "suggestion_1: y", "suggestion_2: z"]
    s.root.suggestions = []
    assert not s.exhausted(s.root.children[2])


def test_vectors_are_padded_and_bad_ones_are_no_answer():
    s = S.TreeSearch(lambda f, x: ([float("nan")] if x else [0.7], ["x"], (*f, x) if x else f))
    s.run(3)
    assert s.root.own == [0.7, 0.0] and s.best() is s.root
    with pytest.raises(ValueError):
        S.TreeSearch(step(), mode="median")


def test_keys_know_place_parent_and_features():
    k = S.node_key(1, [0, 1], "p", ["b", "a"])
    assert k == S.node_key(1, [0, 1], "p", ["a", "b"]) and len(k) == 16
    assert len({k, S.node_key(2, [0, 1], "p", ["a", "b"]), S.node_key(1, [1, 0], "p", ["a", "b"]), S.node_key(1, [0, 1], "q", ["a", "b"]), S.node_key(1, [0, 1], "p", ["a"])}) == 5


def volume(points, ref):
    """Exact, by cells between all coordinates."""
    cuts = [sorted({r, *(max(p[i], r) for p in points)}) for i, r in enumerate(ref)]
    total = 0.0
    for cell in itertools.product(*(zip(c, c[1:]) for c in cuts)):
        if any(all(p[i] >= hi for i, (_, hi) in enumerate(cell)) for p in points):
            total += float(np.prod([hi - lo for lo, hi in cell]))
    return total


def test_contributions_of_three_objectives_against_the_exact_volume():
    pts = [[0.9, 0.2, 0.4], [0.5, 0.8, 0.3], [0.3, 0.5, 0.9], [0.2, 0.2, 0.2], [0.9, 0.2, 0.4]]
    ref = [0.1, 0.1, 0.1]
    own = pts[:4]
    whole = volume(own, ref)
    want = [whole - volume(own[:i] + own[i + 1 :], ref) for i in range(4)]
    got = S.contributions(pts, ref)
    assert got[:4] == pytest.approx(want, abs=0.01) and got[4] == got[0]
    assert S.contributions([[0.05, 0.9, 0.9]], ref) == [0.0] and S.contributions([], ref) == []
    assert S.contributions([[2.0, 1.0], [1.0, 2.0], [1.0 + 1e-12, 2.0]], [0.0, 0.0]) == pytest.approx([1.0, 1.0, 1.0])


def test_fronts_of_many_objectives(spark):
    rnd = random.Random(2)
    pts = [(i, *(float(rnd.randrange(6)) for _ in range(3))) for i in range(200)] + [(900, None, 9.0, 9.0)]
    df = spark.createDataFrame(pts, "id int, a double, b double, c double").repartition(5)
    good = [p for p in pts if p[1] is not None]
    want = sorted(p[0] for p in good if not any(all(x >= y for x, y in zip(q[1:], p[1:])) and q[1:] != p[1:] for q in good))
    assert sorted(r["id"] for r in S.front_nd(df, "id", ["a", "b", "c"]).collect()) == want
    assert S.front_nd(df.limit(0), "id", ["a", "b"]).count() == 0
    with pytest.raises(ValueError):
        S.front_nd(df, "id", ["a", "b", "c"], bound=1)


def test_best_node_ties(spark):
    c = [(1, 3, 1, 0.9, 0.5), (2, 2, 2, 0.9, 0.5), (3, 2, 3, 0.9 - 1e-12, 0.5 + 1e-12), (4, 1, 4, 0.6, 0.6), (5, 0, 5, 0.1, 0.1)]
    df = spark.createDataFrame(c, "node_id int, n_features int, created int, x double, y double")
    assert S.best_node(df, "x", "y").first()["node_id"] == 2
    assert S.best_node(df.limit(0), "x", "y").count() == 0


@pytest.mark.parametrize("strategy", ["strict", "relaxed", "text_only"])
def test_greedy_matches_against_a_loop(spark, strategy):
    rnd = random.Random(8)
    span = lambda i: (rnd.choice("dde"), *(lambda s: (s, s + rnd.randrange(1, 9)))(rnd.randrange(60)), rnd.choice("xy"), i, rnd.choice("abAB"))
    gold, pred = [span(i) for i in range(60)], [(*span(100 + i), rnd.choice([0.1, 0.5, None])) for i in range(60)]
    cols = "doc_id string, start bigint, end bigint, label string, id bigint, text string"
    g, p = spark.createDataFrame(gold, cols), spark.createDataFrame(pred, cols + ", score double")

    def fits(a, b):
        if a[0] != b[0] or a[3] != b[3]:
            return False
        if strategy == "strict":
            return a[1:3] == b[1:3]
        return max(a[1], b[1]) < min(a[2], b[2]) if strategy == "relaxed" else a[5].lower() == b[5].lower()

    free, want = set(range(60)), []
    for a in sorted(gold, key=lambda a: (a[0], a[1], a[2], a[4])):
        able = [j for j in free if fits(a, pred[j])]
        if able:
            j = min(able, key=lambda j: (-max(pred[j][6] or 1e-9, 1e-9), pred[j][1], pred[j][2], pred[j][4]))
            free.discard(j)
            want.append((a[0], a[4], pred[j][4]))
    assert rows(E.greedy_matches(g, p, strategy=strategy)) == sorted(want)
    if strategy == "relaxed":
        pairs = {(r["g"]["id"], r["p"]["id"]) for r in E.overlapping(g, p).collect()}
        assert pairs == {(a[4], b[4]) for a in gold for b in pred if a[0] == b[0] and max(a[1], b[1]) < min(a[2], b[2])}


def test_percentiles_beyond_one_task(spark):
    rnd = random.Random(1)
    x = [rnd.choice([None, rnd.random(), float(rnd.randrange(5))]) for _ in range(400)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(x)], "x double, i int")
    have = [v for v in x if v is not None]
    for bound in (0, 10**6):
        got = E.percentiles(df, {"x": 0.37, "i": 0.5}, bound)
        assert got["x"] == pytest.approx(np.quantile(have, 0.37)) and got["i"] == 199.5
    assert E.percentiles(df.limit(0), {"x": 0.5}) == {"x": None}


def test_split_merges_single_rows(spark):
    df = spark.createDataFrame([(i, "a" if i < 50 else f"s{i}") for i in range(60)], "id int, k string")
    got = FE.stratified_split(df, "id", ["k"])
    assert got.count() == 60 and {r["stratum"] for r in got.filter("id >= 50").collect()} == {FE.SMALL}
    assert rows(got.groupBy("stratum", "split").count()) == [("__small__", "test", 2), ("__small__", "train", 6), ("__small__", "val", 2), ("a", "test", 10), ("a", "train", 30), ("a", "val", 10)]
    with pytest.raises(ValueError):
        FE.stratified_split(df, "id", ["k"], shares=(0.9, 0.2))


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(6)
    data = [(i, rnd.random(), rnd.random(), None if i % 9 == 0 else rnd.random()) for i in range(400)]
    return spark.createDataFrame([(i, a, b, c, int(a + 0.3 * b > 0.65)) for i, a, b, c in data], "id int, a double, b double, c double, label int")


def test_contributions_add_up(spark, labelled):
    cols = ["a", "b", "c"]
    models, failures = M.train_all(labelled, cols, ["logistic", "no_such"])
    assert set(models) == {"logistic"} and set(failures) == {"no_such"}
    few = labelled.limit(12)
    base = {"a": 0.5, "b": 0.5, "c": 0.5}
    score = lambda df: models["logistic"].transform(df).withColumn("p", F.get(M.vector_to_array("probability"), F.lit(1)))
    got = M.contributions(few, "id", cols, score, base, pairs=True).collect()
    full = {r["id"]: r["p"] for r in score(few.select("id", *(F.coalesce(c, F.lit(0.5)).alias(c) for c in cols))).collect()}
    for r in got:
        assert r["base"] + sum(r[c] for c in cols) == pytest.approx(full[r["id"]])
        if few.filter(f"id = {r['id']} and c is null").count():
            assert r["c"] == pytest.approx(0.0)
    assert len(got) == 12 and abs(got[0]["a*b"]) < 1
    with pytest.raises(ValueError):
        M.contributions(few, "id", [], score, base)
    why = M.explained(models["logistic"], few, "id", cols, 2).collect()
    assert len(why) == 12 and all(len(r["effects"].split("; ")) == 2 and r["predicted"] in (0, 1) for r in why)


def test_growing_stops_by_validation_rows(labelled):
    marked = labelled.withColumn("held", F.col("id") % 4 == 0)
    models, failures = M.train_all(marked, ["a", "b"], ["gbt"], {"gbt": {"size": "full", "validation": "held"}})
    assert not failures and models["gbt"].stages[-1].getNumTrees < 300


def test_store_stages_and_retraining(spark, labelled, tmp_path):
    store = str(tmp_path / "store")
    train, valid = labelled.filter("id % 3 <> 0"), labelled.filter("id % 3 = 0")
    assert M.resolve_model(store, "logistic") is None
    kept, own = M.retrain(train, valid, ["a", "b", "c"], "logistic", store, "v1", rollouts=4)
    assert "a" in kept and own[0] > 0.9
    M.save_version(M.pipeline("logistic", ["a"]).fit(M.as_doubles(train, ["a", "label"])), store, "logistic", "v2", {"roc_auc": 0.8})
    assert M.latest_version(store, "logistic") == "v2" and M.latest_version(store, "logistic", "staging") == "v1"
    M.promote(store, "logistic", "v2", "staging")
    M.promote(store, "logistic", "v1", "production")
    assert rows(M.versions(store, "logistic").select("version", "stage")) == [("v1", "production"), ("v2", "staging")]
    assert M.resolve_model(store, "logistic").endswith("/models/logistic/v1")
    M.load_version(store, "logistic", "v2").write().save(f"{store}/phases/2/logistic")
    assert M.resolve_model(store, "logistic", phase=2).endswith("/phases/2/logistic")
    for bad in ("v9", "v2"):
        with pytest.raises(ValueError):
            M.promote(store, "logistic", bad, "staging" if bad == "v9" else "champion")


def test_the_feature_that_decides_comes_first(spark, labelled):
    models, _ = M.train_all(labelled, ["a", "b", "c"], ["gbt"])
    assert M.importance(models["gbt"], ["a", "b", "c"], spark).first()["feature"] == "a"
