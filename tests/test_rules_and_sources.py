"""Rules, configuration and manifests on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from gritmill.functions import config as C
from gritmill.functions import rules as U
from gritmill.operators import scope as P
from gritmill.sources import manifests as M

YAML = """
# a remark
name: "A: policy"   # behind
mode: filter
none: ~
list:
  - 1
  - -2.5
  - 'it''s'
  - k: v
    deep:
    - x
    - {a: [1, two], "b": true}
  -
    - nested
text: |
  one

  two # kept
folded: >-
  a
  b
flow: [a, "b, c", {d: 1}]
url: http://h:80/x#y
"""


def test_yaml():
    assert C.read_yaml(YAML) == {
        "name": "A: policy", "mode": "filter", "none": None, "list": [1, -2.5, "it's", {"k": "v", "deep": ["x", {"a": [1, "two"], "b": True}]}, ["nested"]],
        "text": "one\n\ntwo # kept\n", "folded": "a b", "flow": ["a", "b, c", {"d": 1}], "url": "http://h:80/x#y",
    }
    assert C.read_yaml("") is None and C.read_yaml("- a") == ["a"] and C.read_yaml("7") == 7
    for bad in ("a: 1\na: 2", "a:\n\t- b", "a: &x 1", "a: [1", "a: 1\n  b: 2"):
        with pytest.raises(C.ConfigError):
            C.read_yaml(bad)


def test_merge_and_variables():
    assert C.deep_merge({"a": {"b": 1, "c": [1]}, "d": 2}, {"a": {"c": [2], "e": None}, "d": None}) == {"a": {"b": 1, "c": [2], "e": None}, "d": 2}
    assert C.expand({"a": ["x${V}y", 1]}, {"V": "1"}.get) == {"a": ["x1y", 1]}
    with pytest.raises(C.ConfigError, match=r"a\.b\[0\]: NO is not set"):
        C.expand({"a": {"b": ["${NO}"]}}, {}.get)


def test_policies_and_rules():
    text = "name: p\nscope_mode: filter\nrequirements:\n- id: R1\n  cwes: [CWE-79]\n- id: R2\n  title: T\n  vuln_classes:\n  - injection\n"
    policy = C.read_policy(text)
    assert policy["scope_mode"] == "filter" and [r["id"] for r in policy["requirements"]] == ["R1", "R2"] and policy["requirements"][0]["title"] == "R1"
    for bad in ("scope_mode: filter", "name: p\nscope_mode: x", "name: p\nrequirements:\n- id: R1", "name: p\nrequirements:\n- id: R\n  cwes: [1]\n- id: R\n  cwes: [2]"):
        with pytest.raises(C.ConfigError):
            C.read_policy(bad)
    pack = "rules:\n- id: r\n  languages: [python, go]\n  pattern-either:\n  - pattern: os.system(...)\n  - pattern: $X.execute(...)\n  - pattern: eval(...)\n  - pattern: request.args\n  metadata: {cwe: CWE-78, sink_kind: exec}\n- id: s\n  languages: [java]\n  pattern: a()\n"
    rows = C.read_rules(pack, ["python"])
    assert [(r["kind"], r["name"], r["language"], r["cwe"]) for r in rows] == [
        ("qualified", "os.system", "python", "CWE-78"), ("receiver_method", "execute", "python", "CWE-78"), ("bare_call", "eval", "python", "CWE-78"), ("module_attr", "request.args", "python", "CWE-78"),
    ]


def plain_keys(text):
    import re

    stack, out = [], []
    for line in text.split("\n"):
        m = re.match(r"^( *)(?:- +)?([\w.\-]+)\s*:", line)
        if not m or line.lstrip().startswith("#"):
            continue
        stack = [s for s in stack if s[0] < len(m[1])] + [(len(m[1]), m[2])]
        out.append(".".join(k for _, k in stack))
    return out


def test_keys_and_packed_texts(spark):
    text = "a:\n  b: 1\n  # x: 2\n  c:\n    - d: 1\n      e: 2\nf: 3\n\n  g : 1\nno key here"
    rows = [(text, "p"), (None, None), ("", "p")]
    got = spark.createDataFrame(rows, "t string, p string").select(U.indented_keys(F.col("t")).alias("k"), U.setting_keys(F.col("t")).alias("s")).collect()
    assert got[0].k == plain_keys(text) and got[1].k is None and got[2].k == [] and got[0].s == ["a", "b", "c", "e", "f", "g"]
    packed = [
        ("see data:image/png;base64,AAAA== and data:a/b;base64, end", "x"), ("a\x00b", "x.bin"), ("a\x00b", None), ("\ufffd" + "a" * 9, "x"), ("\ufffd\ufffd" + "a" * 8, "x"), (None, "x"), ("", "x"),
        ("a" * 8192 + "\x00", "x"),
    ]
    got = [r[0] for r in spark.createDataFrame(packed, "t string, p string").select(U.packed_text(F.col("t"), F.col("p"))).collect()]
    note = "[binary content elided: {} is not text]"
    assert got == ["see [data-uri image/png elided: 6 chars] and [data-uri a/b elided] end", note.format("x.bin"), note.format("file"), packed[3][0], note.format("x"), None, "", packed[7][0]]


def test_sources_and_skips(spark):
    rows = [("src/a.py",), ("docs/x.py",), ("a/README",), ("x.d.ts",), ("conf/app.xml",), ("app.xml",), ("k8s/a.yaml",), ("a.tf",), ("yarn.lock",), (None,)]
    got = spark.createDataFrame(rows, "p string").select(U.skip_reason(F.col("p")), U.is_source(F.col("p")), U.is_iac(F.col("p"))).collect()
    assert [r[0] for r in got] == [None, "directory", "name", "extension", None, None, None, None, "name", None]
    assert [r[1] for r in got] == [True, True, False, False, True, False, True, True, False, None]
    assert [r[2] for r in got] == [False, False, False, False, False, False, True, True, False, None]


def test_manifest_files(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# head\n\n1, repo, /srv/a\n2,other,https://h/x.git,base.json\n")
    (tmp_path / "m.csv").write_text('\ufeffAppID,RepoName,URL,Extra\n1,"a, b",/srv/a,x\n,,,\n2,c,/srv/b,\n')
    read = lambda n: sorted((r.line, r.app_id, r.repo_name, r.path, r.baseline) for r in M.read_manifest(spark, str(tmp_path / n)).collect())
    assert read("m.txt") == [(3, "1", "repo", "/srv/a", ""), (4, "2", "other", "https://h/x.git", "base.json")]
    assert read("m.csv") == [(2, "1", "a, b", "/srv/a", ""), (4, "2", "c", "/srv/b", "")]
    for bad, why in (("1,a", "fields"), ("1,,x", "blank"), ("1,a,x\n2,b,x", "duplicate")):
        (tmp_path / "bad.txt").write_text(bad)
        with pytest.raises(Exception, match=f"manifest line .: {why}"):
            M.read_manifest(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "bad.csv").write_text("AppID,x\n1,2\n")
    with pytest.raises(ValueError, match="repo_name, path"):
        M.read_manifest(spark, str(tmp_path / "bad.csv"))


def test_unknown_baseline_stops(spark):
    docs = spark.createDataFrame([(json.dumps({"other": 1}),)], "text string")
    with pytest.raises(Exception, match="neither runs nor findings"):
        M.baseline_documents(docs).collect()


def test_reaches_are_appended_once(spark):
    into = spark.createDataFrame([(1, "a", 0)], "app int, name string, ord int")
    found = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "b", 2), (2, "a", 4)], "app int, name string, ord int")
    assert sorted(tuple(r) for r in P.appended(into, found, "app", "name").collect()) == [(1, "a", 0), (1, "b", 2), (2, "a", 4)]
