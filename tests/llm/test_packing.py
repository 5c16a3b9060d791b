import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm import packing as P


def brute(sizes, cap):
    """The rule, worked out in full for every open container."""
    boxes, out = [], []
    for s in sizes:
        if s == 0:
            boxes = boxes or [cap]
            out.append(0)
            continue
        count = np.bincount([g for g in boxes], minlength=cap + 1)
        best = None
        for g in sorted({g for g in boxes if g >= s}) + [None]:
            c = count.copy()
            if g is not None:
                c[g] -= 1
            c[(cap if g is None else g) - s] += 1
            cost = int((c[1:] ** 2).sum())
            if best is None or cost < best[0]:
                best = (cost, g)
        g = best[1]
        if g is None:
            boxes.append(cap - s)
            out.append(len(boxes) - 1)
        else:
            i = max(j for j, x in enumerate(boxes) if x == g)
            boxes[i] -= s
            out.append(i)
    return boxes, out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=60))
def test_rule_against_brute_force(sizes):
    got = P.sum_of_squares(np.array(sizes, dtype=np.int64), 12)
    boxes, _ = brute(sizes, 12)
    used = np.bincount(got, weights=sizes) if len(sizes) else np.zeros(0)
    assert (used <= 12).all()
    assert sorted(12 - used) == sorted(boxes)


def test_pack_frame(spark):
    d = [(i, 300 + 37 * (i % 19)) for i in range(400)] + [(1000, 5000), (1001, 0), (1002, None), (1003, 1024)]
    df = spark.createDataFrame(d, "doc_id bigint, tokens bigint")
    out = P.pack(df, "doc_id", len(d), per_shard=150).toPandas()
    assert out.groupby("container")["tokens"].sum().max() <= 1024
    whole = dict(d)
    for k, g in out.groupby("doc_id"):
        n = whole[k] or 0
        assert g["tokens"].sum() == n and len(g) == max(1, -(-n // 1024))
        assert sorted(g["token_start"]) == [1024 * i for i in range(len(g))]
    assert P.pack(df.limit(0), "doc_id", 0).count() == 0


def test_little_space_is_left(spark):
    rng = np.random.default_rng(1)
    sizes = np.clip(rng.gamma(2, 120, 20_000).astype(int), 1, 1024)
    got = P.sum_of_squares(sizes[P.placing_order(sizes)], 1024)
    assert 1 - sizes.sum() / ((got.max() + 1) * 1024) < 0.004


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "id bigint, text string")
    got = {r["id"]: r["tokens"] for r in P.count_tokens(df, "id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


def test_both_libraries_count_alike():
    texts = ["", "  two  blanks\n\n\tand tabs ", "It's 12,345.6 µg/m² naïve ﬁ", "日本語 текст ﷽", "a" * 3000, "<|endoftext|>", "x\u200by\u00a0z"]
    assert P.token_counter(P.tokenizer_path())(texts) == P.token_counter(P.tokenizer_path("byte_bpe_50k.json"))(texts)


def test_a_packing_is_given_up_above_its_bound():
    sizes = np.array([6, 6, 6])
    assert P.sum_of_squares(sizes, 10, 2) is None and P.sum_of_squares(sizes, 10, 3).max() == 2
    assert sorted(P.best_packing(np.array([5, 7, 3, 5]), 10)) == [0, 0, 1, 1]
