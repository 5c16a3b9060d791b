from pyspark.sql import functions as F

from lodestream.operators import records as X
from tests.conftest import rows


def test_flat_approvals(spark):
    schema = """application_number string, products array<struct<brand_name:string,marketing_status:string,active_ingredients:array<struct<name:string>>>>,
      submissions array<struct<submission_type:string,submission_status:string,submission_status_date:string,submission_property_type:array<struct<code:string>>>>,
      openfda struct<brand_name:array<string>,generic_name:array<string>>"""
    full = ("NDA1", [("", None, [("abc",), ("ABC",)]), ("Brand", "Rx", [("d",)])], [("ORIG", "AP", "20050204", [("Orphan",)]), ("ORIG", "AP", "20010101", None), ("SUPPL", "AP", "19990101", None)], (["x"], ["g"]))
    bare = ("NDA2", None, None, (["OnlyFda"], ["gen"]))
    got = {r["application_number"]: r for r in X.flat_approvals(spark.createDataFrame([full, bare], schema)).collect()}
    assert (got["NDA1"]["brand_name"], got["NDA1"]["active_ingredients"], got["NDA1"]["marketing_status"], got["NDA1"]["approval_date"]) == ("Brand", "ABC|D", "Rx", "2001-01-01")
    assert (got["NDA2"]["brand_name"], got["NDA2"]["active_ingredients"], got["NDA2"]["is_orphan"]) == ("OnlyFda", "gen", False)


def test_annotations(spark):
    schema = "doc_id string, entities array<struct<label:string,offsets:array<array<int>>,text:array<string>>>"
    df = spark.createDataFrame([("d", [("drug", [[0, 3], [5, 9]], ["abc", "defg"])]), ("e", []), ("f", None)], schema)
    assert rows(X.annotations(df)) == [("d", 0, 3, "abc", "drug"), ("d", 5, 9, "defg", "drug")]


def test_budget_is_exact_and_empty_texts_count_one(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([3, 0, 4, 9, 1])], "g string, id int, n int")
    assert [r[1] for r in rows(X.within_budget(df, "g", "id", F.col("n"), 8))] == [0, 1, 2]


def test_fingerprint_ignores_order_only(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert X.fingerprint(a).first() == X.fingerprint(a.orderBy(F.desc("k")).repartition(3)).first()
    assert X.fingerprint(a).first() != X.fingerprint(a.withColumn("v", F.lit("y"))).first()


def test_memo_and_isolated_failures(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert X.memoised(spark, "k", compute, str(tmp_path)).count() == 3
    assert len(calls) == 1
    out = X.run_all({"good": lambda: 1, "bad": lambda: 1 / 0})
    assert out["good"] == (True, 1) and out["bad"][0] is False and "ZeroDivisionError" in out["bad"][1]


def test_rejects_and_mapping(spark):
    df = spark.createDataFrame([(1, "a", None), (2, " ", "b")], "id int, x string, y string")
    good, bad = X.accepted_and_rejected(df, ["x", "y"])
    assert good.count() == 0 and rows(bad, "id", "lacks") == [(1, ["y"]), (2, ["x"])]
    n = X.nested_by_mapping(df, {"y": "m.f", "x": "m.f", "gone": "z.z"})
    assert rows(n.select("m.f")) == [("a",), ("b",)]
