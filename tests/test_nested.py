import json


from gritmill.plans.nested_queries import R
from gritmill.operators.nested import REACH, SCORE, NestedTables, elements, emit, nested_children, visit, whole_document
from pyspark.sql import types as T


def children(payload, tables=(SCORE,)):
    return [(t, p, label) for t, p, _, label, _ in visit(whole_document(payload), tables)]


GATE = {"gate_name": "g", "evidence": [{"file": "a"}, None, {"line": 1}]}


def test_forms_of_lists_are_walked_alike():
    flat = [("score", (0,), "F"), ("gate", (0, 0), "g"), ("evidence", (0, 0, 0), "a"), ("evidence", (0, 0, 1), "")]
    for gates in ([GATE], [[GATE]], {"items": [GATE]}, GATE, {"g": GATE}, json.dumps([GATE]), [None, GATE], [json.dumps(GATE)]):
        for top in ([{"fix_status": "F", "gate_results": gates}], {"fixStatus": "F", "gateResults": gates}):
            assert children(json.dumps({"validations": top})) == flat


def test_damage_gives_nothing():
    for bad in (None, "", "  ", "{", '{"validations":[', "<html>", '{"a":NaN}', '"x"', "{}{}", "[" * 5000):
        assert children(bad) == []


def test_marks_and_wrapped_documents():
    doc = json.dumps({"validations": [{"raw_score": 1}]})
    assert children("﻿" + doc) == children(json.dumps(doc)) == [("score", (0,), "")]


def test_only_own_reaches():
    p = json.dumps({"profile": {"reaches": [{"name": "p"}]}, "reached_by": [{"name": "r"}], "reaches": [{"name": "x", "via": {"name": "v"}}, None, {"kind": 3}]})
    assert children(p, (REACH,)) == [("reach", (0,), "x"), ("reach", (1,), "")]


def test_unknown_single_object_is_no_element():
    assert list(elements({}, SCORE.fields)) == []
    assert list(elements([{}], SCORE.fields)) == [{}]


def test_rows_once_with_extra_columns_nulls_and_empty_tables(spark):
    p = json.dumps({"validations": [{"fix_status": "Fixed", "gate_results": [GATE]}]})
    v = spark.createDataFrame([(1, p, "x", "t"), (1, p, "x", "t"), (2, None, None, None), (None, p, "y", "u")], "record_id long, payload string, label string, tag string")
    c = spark.createDataFrame([], "record_id long, payload string")
    rows = nested_children(v, c).collect()
    assert len(rows) == 8 and {r.record_id for r in rows} == {1, None}
    assert nested_children(v.limit(0), c).count() == 0


def test_tables_link_and_round_trip(spark, tmp_path):
    p = json.dumps({"validations": [{"fix_status": "Fixed", "gate_results": [dict(GATE, status="pass")]}]})
    v = spark.createDataFrame([(7, p)], "record_id long, payload string")
    t = NestedTables(emit(v, (SCORE,), "record_id"))
    t.write(str(tmp_path / "t"))
    back = NestedTables(spark.read.parquet(str(tmp_path / "t")))
    gate = back.table("gate", T.StructType([T.StructField("status", T.StringType())])).collect()
    assert [(r.record_id, list(r.path), list(r.parent_path), r.status) for r in gate] == [(7, [0, 0], [0], "pass")]


def test_four_tables_in_any_spelling(spark, tmp_path):
    gates = [{"GateName": "g", "gate-name": None, "STATUS": "pass", "evidence": {"0": {"File": "f", "LINE": 3}}}]
    doc = {"Validations": [{"RawScore": 1, "fixStatus": "Fixed", "gateResults": gates}]}
    other = {"reaches": [{"Name": "n", "via": {"a": 1}}, None, {"name": "m"}]}
    rows = [(1, json.dumps(doc)), (1, json.dumps(doc)), (2, None)]
    spark.createDataFrame(rows, "record_id long, payload string").write.parquet(str(tmp_path / "validation_raw.parquet"))
    spark.createDataFrame([(7, json.dumps(other))], "record_id long, payload string").write.parquet(str(tmp_path / "context_raw.parquet"))
    got = {n: sorted(map(tuple, R.queries[f"p3_{n}_table"](spark, str(tmp_path)).collect())) for n in ("score", "gate", "evidence", "reach")}
    assert got["score"] == [(1, "0", "1", "Fixed", None, None)] and got["gate"] == [(1, "0/0", "0", "g", "pass", None, None, None)]
    assert got["evidence"] == [(1, "0/0/0", "0/0", "f", "3", None)] and got["reach"] == [(7, "0", "n", None, None, '{"a":1}'), (7, "1", "m", None, None, None)]
