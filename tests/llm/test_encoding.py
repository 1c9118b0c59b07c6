"""The encoder against the vocabulary's own library, and its round trip; packing against its bounds."""

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gritmill.llm import bpe
from gritmill.llm.packing import pack_histogram, packed

TEXTS = [
    None, "", " ", "\n\n  x", "Hello world's we'll THEY'RE", "naïve café—“smart quotes”…", "数据库 查询語句，没有 检查。", "ﬁnal ﬂow ‮rtl‬", "\u0001\x00\x7f", "a" * 3000, "xyz" * 400,
    "١٢٣ ½ Ⅷ", "tab\there\r\nand nbsp em　wide", "👩‍👩‍👧‍👦🏳️‍🌈", "snake_case camelCaseWord HTTPServer2", "Пользователь не найден",
]


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_vocabulary(bpe.default_vocabulary()), special_tokens={})


def test_ids_and_round_trip(spark, own):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[4], "x"), (None, TEXTS[4], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(df, "text", ["doc_id"])
    want = sorted((str(i), own.encode_ordinary(t or "")) for i, t, _ in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in out.collect()) == want
    back = bpe.encode(df.select("doc_id", "text"), "text", ["doc_id", "text"]).select("text", bpe.Encoder().decode(F.col("ids")).alias("t"))
    assert back.where(F.coalesce("text", F.lit("")) != F.col("t")).count() == 0
    sizes = bpe.token_counts(df, "text", ["doc_id"])
    assert sorted((str(r.doc_id), r.size) for r in sizes.collect()) == sorted((i, len(x)) for i, x in want)


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), "text", ["doc_id"]).count() == 0


def test_short_and_long_folds_agree(spark, own):
    words = ["abcdefgh", "Schwachstellen", "aaaa", "x", "行目で文字列"]
    e = bpe.Encoder()
    df = spark.createDataFrame([(w,) for w in words], "w string")
    both = df.select("w", e.ranks.bind(lambda f: bpe._fold_short(F.col("w"), f)).alias("s"), e.ranks.bind(lambda f: bpe._fold_long(F.col("w"), f)).alias("l")).collect()
    assert all(list(r.s) == list(r.l) == own.encode_ordinary(r.w) for r in both)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 64), st.integers(1, 40), max_size=20))
def test_packing_keeps_everything(counts):
    s = pack_histogram(counts, 64)
    fill, got = {}, {}
    for size, first, each, window, number in s.intervals:
        assert first == got.get(size, 0)
        got[size] = first + each * number
        for w in range(window, window + number):
            fill[w] = fill.get(w, 0) + each * size
    assert got == {k: v for k, v in counts.items() if k}
    assert all(v <= 64 for v in fill.values()) and len(fill) == s.windows
    room = sum(k * v for k, v in counts.items())
    assert s.windows <= 2 * -(-room // 64) + 1  # no two windows could be one


def test_packed_rows(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, "word " * 40), (4, "word " * 40), (None, "x")], "doc_id long, text string")
    w = spark.createDataFrame([(1, "n", 16, "t"), (2, "m", 64, "t")], "window_id int, window_name string, capacity_tokens int, tokenizer string")
    rows = packed(df, w).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, None}
    fill = {}
    for r in rows:
        fill[r.window_id, r.window_no] = fill.get((r.window_id, r.window_no), 0) + r.tokens
    cap = {1: 16, 2: 64}
    assert all(v <= cap[k[0]] for k, v in fill.items())
    big = [r for r in rows if r.doc_id == 4 and r.window_id == 1]
    assert len(big) == 6 and sorted(r.tokens for r in big)[-4:] == [16] * 4
    assert packed(df.limit(0), w).count() == 0 and packed(df, w.limit(0)).count() == 0
