import datetime as dt

import pytest

from lodestream.functions.dates import iso_day, parse_partial

D = dt.date
CASES = [
    ("2015-03-23", D(2015, 3, 23), D(2015, 3, 23)), ("2015/3/2", D(2015, 3, 2), D(2015, 3, 2)), ("20150323", D(2015, 3, 23), D(2015, 3, 23)),
    ("2015-03-23T10:11:12", D(2015, 3, 23), D(2015, 3, 23)), ("March 3, 2015", D(2015, 3, 3), D(2015, 3, 3)), ("3 Mar 2015", D(2015, 3, 3), D(2015, 3, 3)),
    (" 2016-02 ", D(2016, 2, 1), D(2016, 2, 29)), ("february 2015", D(2015, 2, 1), D(2015, 2, 28)), ("2015-Q2", D(2015, 4, 1), D(2015, 6, 30)),
    ("2015Q4", D(2015, 10, 1), D(2015, 12, 31)), ("Q1 2015", D(2015, 1, 1), D(2015, 3, 31)), ("2015", D(2015, 1, 1), D(2015, 12, 31)),
    ("2015-02-30", None, None), ("0000-00-00", None, None), ("2015-13", None, None), ("Foo 2015", None, None), ("February 30, 2015", None, None),
    ("N/A", None, None), ("", None, None), (None, None, None), ("2015Q5", None, None), ("n.d.", None, None), ("12015-01-01", None, None),
]


def test_parse_partial(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, s string")
    got = {r["i"]: (r["p"]["first"], r["p"]["last"]) if r["p"] else (None, None) for r in df.select("i", parse_partial("s").alias("p")).collect()}
    for i, (text, first, last) in enumerate(CASES):
        assert got[i] == (first, last), text


@pytest.mark.parametrize("text,want", [("2015-03", None), ("2015-03-23 x", D(2015, 3, 23)), (None, None)])
def test_iso_day(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(iso_day("s")).first()[0] == want
