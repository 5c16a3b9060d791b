import numpy as np
import pytest

from lodestream.llm import review as R
from lodestream.tables import table


@pytest.fixture(scope="module")
def model(spark, sf):
    return R.train(table(spark, sf, "review_examples"), "example_id", "text", "label")


def worst(model, text):
    return max((model.score(s) for s in R.sentences(text)), default=0.0)


def test_cleaning_undoes_disguises():
    same = ["you idiot", "you 1d10t", "you i d i o t", "you id_iot", "you idіоt", "you idi​ot", "YOU IDIOOOOT"]
    for s in same:
        assert "idiot" in R.clean(s)[0], s
    assert R.clean("a u g l y a s s h o l e and")[0] == ["a", "ugly", "asshole", "and"]
    assert R.clean("p a t h e t i c x")[0][0] == "patheticx"
    assert R.clean("5mg of HbA1c at p=0.3")[0][:2] == ["5mg", "of"]


def test_short_disguises_and_long_spellings():
    for w, plain in (("sh1t", "shit"), ("p1g", "plg"), ("stup1d", "stupid"), ("idi0t", "idiot"), ("los3r", "loser"), ("bl33d", "bleed")):
        assert R.clean(f"you {w}")[0] in (["you", plain], ["you", plain.replace("l", "i")]), w
    assert R.clean("take 5mg of ab12 at b6 or t4x")[0] == ["take", "5mg", "of", "ab12", "at", "b6", "or", "t4x"]
    assert R._classes_of("sh*t") == ("coarse",) and R._classes_of("p*lls") == () and R._classes_of("q*zz") == ()
    spelled = " ".join("youareanidiotandaworthlessbastardwhoshouldrotinhell")
    assert {"idiot", "worthless", "bastard", "rot", "hell"} <= set(R.clean(spelled)[0])


@pytest.mark.parametrize("text", ["You are a pathetic worthless idiot.", "Du bist ein Arschloch.", "Eres un imbécil de mierda.", "Cette femme est une salope.", "Fine day.\nI will kill you, bastard.", "you are a m***n"])
def test_finds(model, text):
    assert worst(model, text) >= model.found_at


@pytest.mark.parametrize("text", ["", "Sexual dysfunction was reported by 12 men.", "The compound kills tumour cells.", "This damn cough keeps me awake.", "History of sexual abuse was recorded.", "The pig insulin model worked."])
def test_leaves_alone(model, text):
    assert worst(model, text) < model.found_at


def test_held_out_accuracy(spark, sf):
    ex = [(r["text"], r["label"]) for r in table(spark, sf, "review_examples").orderBy("example_id").collect()]
    m = R.fit(ex[::2])
    right = [(worst(m, t) >= m.found_at) == (lab != "clean") for t, lab in ex[1::2]]
    assert np.mean(right) > 0.93


def test_scorer_equals_the_model(spark, sf, model):
    texts = [r["text"] for r in table(spark, sf, "documents").limit(300).collect()] + [
        "you i d i o t", "a b c d", "x y", "you id_iot! #1 p=0.3 HbA1c", "vous êtes nuls\u00a0! i\u200bdiot", "people from Xyria are dirt", "¨ ´", "",
    ]
    scorer = R.Scorer(model)
    for t in texts:
        for s in R.sentences(t or ""):
            assert scorer.score(s) == pytest.approx(model.score(s), abs=1e-12), s


def test_cross_validated_grade_lies_between(spark, sf):
    ex = [(r["text"], r["label"]) for r in table(spark, sf, "review_examples").orderBy("example_id").collect()]
    held = R.held_out(ex)
    at = R.cross_validated(ex)
    assert np.mean([(s >= at) == y for s, y in held]) > 0.99


def test_thresholds_are_ordered_and_shared(model):
    assert all(a < b for a, b in zip(model.thetas, model.thetas[1:]))
    assert all(model.weights[c] >= 0 for c in ("insult", "sex") if c in model.weights)


def test_frame(spark, model):
    df = spark.createDataFrame([(1, None, "a", 9), (2, "", "a", 9), (3, "Nice.\nYou stupid moron!", None, 9)], "doc_id bigint, text string, source string, score int")
    got = {r["doc_id"]: r for r in R.score(df, "doc_id", "text", model, ("source",)).collect()}
    assert got[1]["score"] == got[2]["score"] == 0.0 and got[3]["score"] > 1 and got[3]["sentence"] == 1
    rates = {r["source"]: r["found"] for r in R.rates(R.score(df, "doc_id", "text", model, ("source",)), "source", model.found_at).collect()}
    assert rates == {"a": 0, None: 1}
    assert R.score(df.limit(0), "doc_id", "text", model).count() == 0
    with pytest.raises(ValueError):
        R.fit([("x", "clean")])
