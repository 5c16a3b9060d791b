import random

from lodestream.llm import leaks as L

ITEM = " ".join(f"word{i} six-minute 7.{i}5" if i % 5 == 0 else f"tok{i}" for i in range(60))


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame(items, "item_id bigint, text string, doc_id int")
    return d, i


def test_spans_and_disguises(spark):
    w = ITEM.split()
    rep = w[:30]
    rep[5], rep[14], rep[23] = "other", "other", "other"
    docs = [
        (1, "start " + " ".join(w[10:35]) + " end", 0),
        (2, "start " + " ".join(w[10:34]) + " end", 0),
        (3, " ".join(rep), 0),
        (4, " ".join(["zz" if i % 6 == 0 else x for i, x in enumerate(w[:40])]), 0),
        (5, "a " + " ".join(w[10:40]).upper().replace("-", " - ").replace(" ", "\n") + "!", 0),
        (6, ITEM.replace("-", "‑").replace(" ", "  "), 0),
        (7, None, 0), (8, "", 0), (9, ITEM, 0), (9, ITEM, 0),
        (10, " ".join(w[:15] + ["gap"] + w[15:27]), 0),
    ]
    items = [(1, ITEM, 0), (2, "too short to leak", 0), (3, None, 0)]
    d, i = frames(spark, docs, items)
    for bound in (L.INDEX_BOUND, 0):
        got = sorted(tuple(r)[:2] for r in L.find_leaks(d, "doc_id", "text", i, "item_id", "text", bound).collect())
        assert got == [(1, 1), (3, 1), (5, 1), (6, 1), (9, 1)]
    assert L.find_leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0
    assert L.find_leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0


def test_no_span_is_missed():
    """Random spans with one word in ten replaced are found wherever they lie."""
    rnd = random.Random(11)
    w = [f"v{rnd.randrange(10**6)}" for _ in range(80)]
    ix = L.ItemIndex([(1, " ".join(w))])
    for _ in range(300):
        n = rnd.randrange(25, 61)
        a = rnd.randrange(0, 80 - n)
        span = w[a : a + n]
        for j in rnd.sample(range(1, n - 1), n // 10):
            span[j] = "x"
        text = " ".join(["q"] * rnd.randrange(5) + span + ["r"] * rnd.randrange(5))
        assert ix.search(text, L.HashCache()), (n, a)


def test_winnowing_keeps_one_hash_per_window():
    toks = [str(i % 7) for i in range(50)]
    h, at = L.kept_hashes(toks, L.HashCache())
    assert len(h) == len(at) and (at[1:] - at[:-1] <= L.W).all()
    assert len(L.kept_hashes(toks[:3], L.HashCache())[0]) == 0
    assert len(L.kept_hashes(toks[: L.K], L.HashCache())[0]) == 1


def test_replaced_words_of_several_tokens():
    w = [f"w{i}" for i in range(30)]
    w[15], w[20] = "30", "patients"
    ix = L.ItemIndex([(1, " ".join(w))])

    def found(at: int, *new: str) -> bool:
        return bool(ix.search("start " + " ".join([*w[:at], *new, *w[at + 1 :]]) + " end", L.HashCache()))

    for at in (14, 15):
        for word in ("follow-up", "30.5", "patient's", "treat-\nment", "a-b/c.d", "1,234.5", "follow - up"):
            assert found(at, word), (at, word)
    assert found(20, "patient's") and found(20, "pati-\nents") and found(15, "x-30.5")
    assert not found(15, "gap", "30") and not found(15, "30", "gap") and not found(14, "one", "two")
    assert not found(14, "gap", "-", w[14]) and not found(14, w[14], "-", "gap")


def test_no_span_with_long_replacements_is_missed():
    rnd = random.Random(5)
    w = [f"v{rnd.randrange(10**6)}" + rnd.choice(["", "", "-b", ".5"]) for _ in range(80)]
    ix = L.ItemIndex([(1, " ".join(w))])
    for _ in range(300):
        n = rnd.randrange(25, 61)
        a = rnd.randrange(0, 80 - n)
        span = w[a : a + n]
        for j in rnd.sample(range(1, n - 1), n // 10):
            span[j] = rnd.choice(["x", "follow-up", "30.5", "a-b-c", "treat-\nment", span[j].split("-")[0] + "-z"])
        text = " ".join(["q"] * rnd.randrange(5) + span + ["r"] * rnd.randrange(5))
        assert ix.search(text, L.HashCache()), (n, a)


def test_later_stretch_at_the_same_distance(spark):
    w = [f"w{i}" for i in range(100)]
    masked = w[:12] + [f"other{i}" for i in range(20)] + w[32:72]
    twice = w[:12] + ["x"] * 12 + w[24:40] + ["y"] * 12 + w[52:80]
    d, i = frames(spark, [(1, " ".join(masked), 0), (2, " ".join(twice), 0), (3, " ".join(w[:12] + ["x"] * 20 + w[32:56]), 0)], [(1, " ".join(w), 0)])
    for bound in (L.INDEX_BOUND, 0):
        got = sorted(tuple(r) for r in L.find_leaks(d, "doc_id", "text", i, "item_id", "text", bound).collect())
        assert got == [(1, 1, 32, 72), (2, 1, 52, 80)]


def test_phrases_of_many_items_and_documents(spark):
    """Items that share a phrase are searched for in blocks, the others by a join: the same rows as from one index."""
    phrase = " ".join(f"shared{i}" for i in range(12))
    texts = [phrase + " " + " ".join(f"i{n}w{j}" for j in range(30)) for n in range(12)] + [" ".join(f"solo{n}x{j}" for j in range(30)) for n in range(3)]
    docs = [(n, f"{phrase} {texts[n % 15]} end" if n % 2 else f"only {phrase} here", 0) for n in range(45)]
    d, i = frames(spark, docs, [(n, t, 0) for n, t in enumerate(texts)] + [(3, texts[14], 0)])
    find = lambda *a: sorted(tuple(r) for r in L.find_leaks(d, "doc_id", "text", i, "item_id", "text", *a).collect())
    want = find()
    assert len(want) > 20
    for bound, common in ((400, 5), (0, 5), (0, 0), (0, 100)):
        assert find(bound, common) == want


def test_same_as_every_alignment_by_place():
    """Masked and intact stretches at the same distance: a leak is found exactly where the rule has one."""
    rnd = random.Random(3)
    w = [f"v{i}" for i in range(120)]
    ix = L.ItemIndex([(1, " ".join(w))])
    hits = 0
    for _ in range(400):
        same = []
        while len(same) < len(w):
            same += [True] * rnd.randrange(4, 18) + [False] * rnd.choice([2, 3, 9, 20])
        same = same[: len(w)]
        want = any(
            same[a] and same[b - 1] and 10 * same[a:b].count(False) <= b - a for a in range(len(w)) for b in range(a + 25, len(w) + 1)
        )
        hits += want
        assert bool(ix.search(" ".join(x if ok else "z" for x, ok in zip(w, same, strict=True)), L.HashCache())) == want
    assert 40 < hits < 360
