import json

from gritmill.llm.queries import R


def test_all_three_kinds_are_masked(spark, tmp_path):
    evidence = [{"Snippet": 'a\npassword = "walnut-9-x"'}, {"file": "f"}, {"snippet": "x = 1 \ud800"}]
    payload = json.dumps({"validations": [{"gate_results": [{"gate_name": "g", "evidence": evidence}]}]})
    rows = {
        "validation_raw": ([(1, payload), (1, payload), (2, None), (3, "{")], "record_id long, payload string"),
        "sinks": ([(3, 'pwd = "q1w2e3r4t5"'), (3, 'pwd = "q1w2e3r4t5"'), (4, None), (5, "")], "sink_id long, snippet string"),
        "cited_operations": ([(6, 'token = "q9w8e7r6t5"'), (7, "x = y")], "op_id long, snippet string"),
    }
    for name, (data, ddl) in rows.items():
        spark.createDataFrame(data, ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = sorted((tuple(r) for r in R.queries["p1_redacted"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(
        [
            ("evidence", 1, 0, 0, 0, 'a\npassword = "REDACTED"'), ("evidence", 1, 0, 0, 1, None), ("evidence", 1, 0, 0, 2, "x = 1 " + "\ufffd" * 3),
            ("sink", 3, -1, -1, -1, 'pwd = "REDACTED"'), ("sink", 4, -1, -1, -1, None), ("sink", 5, -1, -1, -1, ""),
            ("cited_operation", 6, -1, -1, -1, 'token = "REDACTED"'), ("cited_operation", 7, -1, -1, -1, "x = y"),
        ],
        key=str,
    )
