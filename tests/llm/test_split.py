from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm import split as S


def check(t, limit, overlap):
    parts = S.split_text(t, limit, overlap)
    assert "".join(t[a:b] for _, a, b in parts) == t
    assert all(b - f <= limit for f, a, b in parts)
    assert all(a - f <= overlap for f, a, b in parts)
    return parts


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n#-1́", max_size=400), st.integers(20, 60), st.integers(0, 15))
def test_round_trip(t, limit, overlap):
    check(t, limit, overlap)


def test_cuts_at_structure():
    secs = [f"## Part {i}\n" + "Some words here. " * 20 + "\n\n" for i in range(6)]
    t = "".join(secs)
    parts = check(t, 500, 0)
    starts = {t.index(s) for s in secs}
    assert starts <= {a for _, a, _ in parts}


def test_descends_only_where_needed_and_merges_siblings():
    t = "\n\n".join(["tiny one."] * 5 + ["Long sentence number. " * 60] + ["tiny two."] * 5)
    parts = check(t, 400, 40)
    assert len(parts) < 8
    assert all(t[a - 1].isspace() for _, a, _ in parts[1:])


def test_overlap_is_near_what_was_asked():
    parts = check("word " * 2000, 1200, 120)
    assert all(85 <= a - f <= 120 for f, a, _ in parts[1:])


def test_no_boundary_long_and_exact_sizes():
    assert len(check("x" * 100_000, 1200, 120)) == 93
    assert len(check("y" * 1200, 1200, 120)) == 1
    assert len(check("y" * 1201, 1200, 120)) == 2
    assert S.split_text("") == [(0, 0, 0)]


def test_frame(spark):
    df = spark.createDataFrame([(1, "a" * 1300, "x"), (2, "short", "y"), (3, None, "z"), (4, "", "w")], "id bigint, text string, piece string")
    out = S.split_items(df, "id", "text").collect()
    assert sorted((r["id"], r["piece"], r["pieces"]) for r in out) == [(1, 0, 2), (1, 1, 2), (2, 0, 1), (4, 0, 1)]
    assert {r["id"] for r in S.split_items(df, "id", "text", oversized_only=True).collect()} == {1}
    assert S.split_items(df.limit(0), "id", "text").count() == 0
