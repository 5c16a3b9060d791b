import json

from lodestream.operators import nested as N
from tests.conftest import rows

RECORD = {
    "protocolSection": {
        "contactsLocationsModule": {"locations": [{"facility": "A", "city": None}, None, {"state": " "}, {"country": "FR"}]},
        "sponsor_collaborators_module": {"collaborator_names": ["X", "", "Y"]},
        "outcomesModule": {"primaryOutcomes": [{"measure": "no"}], "secondaryOutcomes": '[{"measure": "m"}, {"timeFrame": "1 w"}]'},
    },
    "resultsSection": {"locations": [{"city": "no"}], "outcomesModule": {"secondaryOutcomes": [{"measure": "no"}]}},
}


def found(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "record_id bigint, j string")
    return rows(N.found_children(N.label_nodes(df, "record_id", "j"), "record_id"))


def test_children_and_positions(spark):
    got = found(spark, json.dumps(RECORD))
    want = [("collaborator", 0), ("collaborator", 2), ("location", 0), ("location", 3), ("secondary_outcome", 0), ("secondary_outcome", 1)]
    assert [(c, p) for _, c, p in got] == want


def test_bare_section_single_child_and_text_child(spark):
    r = {"contactsLocationsModule": {"locations": {"city": "B"}}, "sponsorCollaboratorsModule": {"collaborators": "Z Inc"}}
    assert found(spark, json.dumps(r)) == [(0, "collaborator", 0), (0, "location", 0)]


def test_unreadable_records_have_no_children(spark):
    deep = "[" * 100_000
    assert found(spark, None, "", "{", "null", "3", "[]", "{}", deep, json.dumps({"protocolSection": None})) == []


def test_labels_are_intervals_by_brute_force():
    nodes = N.label_record(json.dumps(RECORD))
    by_pre = {n[0]: n for n in nodes}
    for pre, post, depth, parent, *_ in nodes:
        inside = [m for m in nodes if pre < m[0] and m[1] < post]
        assert len(inside) == post - pre + depth
        assert [m[0] for m in inside] == list(range(pre + 1, pre + 1 + len(inside)))
        if parent is not None:
            assert by_pre[parent][0] < pre and by_pre[parent][1] > post


def test_child_table_fields_and_extra_columns(spark):
    df = spark.createDataFrame([(7, json.dumps(RECORD), 1)], "record_id bigint, j string, pos int")
    lab = N.label_nodes(df, "record_id", "j")
    assert rows(N.child_table(lab, "record_id", "location"), "record_id", "pos", "facility", "country") == [(7, 0, "A", None), (7, 3, None, "FR")]
    assert rows(N.child_table(lab, "record_id", "secondary_outcome"), "measure", "time_frame") == [(None, "1 w"), ("m", None)]


def test_many_children_and_empty_table(spark):
    big = {"protocolSection": {"contactsLocationsModule": {"locations": [{"city": f"c{i}"} for i in range(3000)]}}}
    assert len(found(spark, json.dumps(big))) == 3000
    empty = spark.createDataFrame([], "record_id bigint, j string")
    assert N.found_children(N.label_nodes(empty, "record_id", "j"), "record_id").count() == 0
