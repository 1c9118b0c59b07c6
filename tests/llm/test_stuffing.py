import pytest

from gritmill.llm.stuffing import page_shapes, stuffed, stuffed_pages

SPAM = [
    "cheap scanner " * 30, "\n".join(f"Click here: https://a{i}.example/x/{i}" for i in range(12)), "#one #two #three #one #two #three #four #one",
    "SKU-1 | cargo hook | 69.99 | in stock\nitem 3; tag a; tag b; tag c\nlib edition, 4 seats, 3 credits", "Home | Login | Home | Sitemap | Login | Home | Next | Home | Login | Sitemap",
    "<ul><li><a href='http://a/b'>x y</a></li><li><a href='http://a/c'>z</a></li></ul>", "便宜 渗透测试 漏洞扫描 便宜 渗透测试 漏洞扫描 便宜 渗透测试 漏洞扫描 便宜 渗透测试 漏洞扫描",
    "The old parser was slow in tests.\n\n" + "license key near me " * 30,
]
FINE = [
    None, "", "   \n ", "ok", "LGTM", "The archive is unpacked before its entries are checked. See https://a.example/x for more.", "数据库 没有 检查。其他租户可以读取表中的数据。",
    "\n".join(f"2025-01-0{i}T00:00:0{i}Z INFO x took {i} ms" for i in range(1, 9)), "\n".join(f"src/a{i}.py,{i},CWE-{i},low,2" for i in range(30)),
    "\n".join(f"x{i} = call(a, b[{i}]);" for i in range(20)), "Terms used\nCWE-1: The token is checked twice before use.\nrelay: A service that forwards each request.",
    "set -euo pipefail\ncurl -fsS https://a.example/health\ncd /srv/x\ncurl -fsS https://b.example/health\ndone",
]


@pytest.mark.parametrize("text", SPAM)
def test_spam(text):
    assert stuffed(text)


@pytest.mark.parametrize("text", FINE)
def test_fine(text):
    assert not stuffed(text)


def test_every_copy_once(spark):
    rows = [(i, t, 9) for i, t in enumerate(SPAM + FINE)] + [(0, SPAM[0], 9), (99, SPAM[0], 9), (None, SPAM[0], 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, share int")
    assert sorted(str(r.doc_id) for r in stuffed_pages(df).collect()) == sorted([str(i) for i in range(len(SPAM))] + ["99", "None"])
    assert stuffed_pages(df.limit(0)).count() == 0 and page_shapes(df).count() == len(rows)
