import pytest

from gritmill.llm.handwritten import not_handwritten, origin, plain_path, with_origin

ROWS = [
    ("src/a.py", None, 10, 300, "handwritten"), (None, None, 1, 1, "unknown"), ("", "", None, None, "noncode"), ("docs/x.md", "DO NOT EDIT", 1, 99999, "noncode"),
    ("vendor/x/a.go", None, None, None, "vendored"), ("app/vendors/a.rb", None, 9, 300, "handwritten"), ("NODE_MODULES\\x\\a.js ", None, 1, 1, "vendored"),
    ("node%5Fmodules/x/a.js", None, 1, 1, "vendored"), ("js/libs/lib-1.2.3.umd.js", None, 9, 9, "vendored"), ("src/release/x-1.2.3-notes-y.ts", None, 9, 9, "handwritten"),
    ("a/b.min.js", None, 1, 9, "minified"), ("src/math/min_plan.js", None, 9, 300, "handwritten"), ("a/main.x.80da4ae3.chunk.js", None, 1, 9, "minified"),
    ("a/x.pb.go", None, 9, 9, "generated"), ("src/codegen/x.rs", "mentions generator settings", 9, 9, "handwritten"), ("a/x.py", "first line says DO NOT EDIT", 9, 9, "generated"),
    ("a/x.ts", "verbatim copy of libx", 9, 9, "vendored"), ("a/x.ts", None, 1, 5000, "minified"), ("a/x.ts", None, 100, 14000, "handwritten"), ("a/x_hexdump.h", None, 99, 99, "data"),
    ("a/x.ts", None, 2, 9_000_000, "data"), ("a/package-lock.json", None, 1, 1, "noncode"),
]


@pytest.mark.parametrize(("path", "remark", "lines", "size", "kind"), ROWS)
def test_origin(path, remark, lines, size, kind):
    assert origin(path, remark, lines, size) == kind


def test_one_spelling():
    assert plain_path(" ./A//B/./c.PY\t") == plain_path("a\\b\\c.py") == "/a/b/c.py"


def test_rows_once_and_as_written(spark):
    rows = [(i % 3, p, r, n, b, "x") for i, (p, r, n, b, _) in enumerate(ROWS)]
    df = spark.createDataFrame(rows + rows, "scan_id int, path string, detail string, n_lines long, n_bytes long, origin_col string")
    got = sorted(tuple(r) for r in not_handwritten(df, ["scan_id", "path"]).collect())
    assert got == sorted({(i % 3, p) for i, (p, *_, k) in enumerate(ROWS) if k in ("generated", "minified", "vendored", "data")})
    assert with_origin(df.limit(0), ["path"]).count() == 0
