"""Byte-pair encoding of a corpus by a public vocabulary, on the JVM.

The vocabulary becomes literal maps of the plan: two-choice hash tables, so that a
lookup costs two probes at most. A text is cut into
words by one regular expression. Words that are pieces themselves are looked up
where they stand. Of the others the *distinct* ones are encoded once, by a fold
over their byte array that merges the pair of least rank, and joined back.

Defined results
---------------
* null and empty texts have an empty list; every input row gives one row;
* rows with equal texts, equal or null ids each keep their row;
* texts and words of any length are encoded whole;
* ``decode`` of the ids gives back the text, byte for byte.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable
from functools import lru_cache

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritmill.tables import written

NO_RANK = 2_147_483_647
# Fixed value: white space as Unicode defines it, for an engine whose \s is ASCII.
_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Fixed value: the word pattern of the vocabulary, with that white space spelled out
# and letters first, which no other branch can begin with.
WORD_PATTERN = (
    r" ?\p{L}++|'(?:[stmd]|re|ve|ll)| ?\p{N}++| ?[^" + _SPACE + r"\p{L}\p{N}]++|[" + _SPACE + r"]+(?![^" + _SPACE + r"])|[" + _SPACE + r"]+"
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def read_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def _slots(key: str, slots: int) -> tuple[int, int]:
    data = key.encode()
    return xxhash.xxh64_intdigest(data, seed=42) & (slots - 1), zlib.crc32(data) & (slots - 1)


def _hashed(entries: list[tuple[str, object]]) -> tuple[int, str, str]:
    """A two-choice (cuckoo) table of the entries: its slots, and two JSON arrays; every key lies in one of its two slots."""
    slots = 1 << max(4, (5 * len(entries) // 2).bit_length())
    keys: list = [None] * slots
    values: list = [None] * slots
    for key, value in reversed(entries):  # who comes last keeps its first slot: the entries are sorted by frequency
        at = _slots(key, slots)[0]
        for _ in range(2_000):
            key, keys[at] = keys[at], key
            value, values[at] = values[at], value
            if key is None:
                break
            one, two = _slots(key, slots)
            at = two if at == one else one
        else:
            raise ValueError("the table is too full")
    dump = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    return slots, dump(keys), dump(values)


@lru_cache(maxsize=4)
def _maps(path: str) -> tuple[tuple[int, str, str], tuple[int, str, str], str]:
    vocabulary = read_vocabulary(path)
    whole = []
    for piece, rank in vocabulary.items():
        try:
            whole.append((piece.decode("utf-8"), rank))
        except UnicodeDecodeError:
            continue
    pieces = [""] * (max(vocabulary.values()) + 1)
    for piece, rank in vocabulary.items():
        pieces[rank] = piece.hex()
    return _hashed(whole), _hashed([(p.hex().upper(), r) for p, r in vocabulary.items()]), json.dumps(pieces)


class Table:
    """A literal table of a plan. ``bind`` gives it to an expression as one value, so the plan holds it once, however often it is asked."""

    def __init__(self, hashed: tuple[int, str, str], kind: str):
        self.slots = hashed[0]
        self.literal = F.struct(
            F.from_json(F.lit(hashed[1]), "array<string>").alias("k"), F.from_json(F.lit(hashed[2]), f"array<{kind}>").alias("v")
        )

    def bind(self, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
        """``body`` gets a function from a key to its value, else null."""
        mask = F.lit(self.slots - 1).cast("bigint")

        def find(table: Column, key: Column) -> Column:
            one, two = F.xxhash64(key).bitwiseAND(mask).cast("int"), F.crc32(key).bitwiseAND(mask).cast("int")
            keys, values = table["k"], table["v"]
            return F.when(F.get(keys, one) == key, F.get(values, one)).when(F.get(keys, two) == key, F.get(values, two))

        return _bound(self.literal, lambda table: body(lambda key: find(table, key)))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once: a lambda expression has no common subexpressions."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


class Encoder:
    """Column expressions over the literal maps of one vocabulary."""

    def __init__(self, path: str | None = None):
        self.path = path or default_vocabulary()
        whole, ranks, pieces = _maps(self.path)
        self.whole = Table(whole, "int")
        self.ranks = Table(ranks, "int")
        self._pieces = F.from_json(F.lit(pieces), "array<string>")

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))

    def word_ids(self, word: Column) -> Column:
        """Ids of one word."""
        return self.ranks.bind(lambda find: fold_merges(word, find))

    def decode(self, ids: Column) -> Column:
        """The text of ids: their binary pieces, concatenated."""
        text = _bound(self._pieces, lambda pieces: F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))
        return F.unhex(text).cast("string")


# Bytes of a word up to which all its pairs are ranked anew for every merge;
# beyond, ranks are carried along and only the two neighbours of a merge are asked.
SHORT_WORD = 48


def fold_merges(word: Column, find: Callable[[Column], Column]) -> Column:
    """Ids of a word: a fold over its byte array that merges the leftmost pair of least rank until none is left."""
    return F.when(F.octet_length(word) <= SHORT_WORD, _fold_short(word, find)).otherwise(_fold_long(word, find))


def _fold_short(word: Column, find: Callable[[Column], Column]) -> Column:
    def rank(piece: Column) -> Column:
        return F.coalesce(find(piece), F.lit(NO_RANK))

    def merged(p: Column, k: Column) -> Column:
        joined = F.transform(p, lambda x, i: F.when(i == k, F.concat(x, F.get(p, k + 1))).when(i != k + 1, x))
        return F.struct(F.filter(joined, lambda x: x.isNotNull()).alias("p"), F.lit(True).alias("more"))

    def step(s: Column, _: Column) -> Column:
        p = s["p"]

        def least(ranks: Column) -> Column:
            at = F.when(F.array_min(ranks) < NO_RANK, F.array_position(ranks, F.array_min(ranks)).cast("int") - 1)
            return _bound(at, lambda k: F.when(k.isNull(), F.struct(p.alias("p"), F.lit(False).alias("more"))).otherwise(merged(p, k)))

        ranks = F.transform(p, lambda x, i: F.when(F.get(p, i + 1).isNull(), F.lit(NO_RANK)).otherwise(rank(F.concat(x, F.get(p, i + 1)))))
        return F.when(s["more"], _bound(ranks, least)).otherwise(s)

    def folded(parts: Column) -> Column:
        first = F.struct(parts.alias("p"), F.lit(True).alias("more"))
        many = F.aggregate(F.sequence(F.lit(1), F.size(parts)), first, step, lambda s: s["p"])
        return F.transform(many, lambda w: rank(w))

    return _bound(F.regexp_extract_all(F.hex(word), F.lit(".."), F.lit(0)), folded)


def _fold_long(word: Column, find: Callable[[Column], Column]) -> Column:
    none = F.array().cast("array<int>")

    def rank(piece: Column) -> Column:
        return F.coalesce(find(piece), F.lit(NO_RANK))

    def merged(s: Column, k: Column) -> Column:
        p, r = s["p"], s["r"]

        def placed(joined: Column) -> Column:
            left = F.when(k > 0, F.array(rank(F.concat(F.get(p, k - 1), joined)))).otherwise(none)
            right = F.when(k + 2 < F.size(p), F.array(rank(F.concat(joined, F.get(p, k + 2))))).otherwise(none)
            return F.struct(
                F.concat(F.slice(p, F.lit(1), k), F.array(joined), F.slice(p, k + 3, F.size(p))).alias("p"),
                F.concat(F.slice(r, F.lit(1), F.greatest(k - 1, F.lit(0))), left, right, F.slice(r, k + 3, F.size(p))).alias("r"),
            )

        return _bound(F.concat(F.get(p, k), F.get(p, k + 1)), placed)

    def step(s: Column, _: Column) -> Column:
        def at_least(least: Column) -> Column:
            return F.when(least < NO_RANK, _bound(F.array_position(s["r"], least).cast("int") - 1, lambda k: merged(s, k))).otherwise(s)

        return _bound(F.array_min(s["r"]), at_least)

    def folded(parts: Column) -> Column:
        pairs = F.zip_with(F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts) - 1), lambda a, b: F.concat(a, b))
        first = F.struct(parts.alias("p"), F.transform(pairs, lambda w: rank(w)).alias("r"))
        many = F.aggregate(F.sequence(F.lit(2), F.size(parts)), first, step, lambda s: s["p"])
        return F.transform(F.when(F.size(parts) > 1, many).otherwise(parts), lambda w: rank(w))

    return _bound(F.regexp_extract_all(F.hex(word), F.lit(".."), F.lit(0)), folded)


# Words of the second literal map, and the longest of them in bytes: what is
# collected and sent with the plan is bounded by their product, about 4 MB.
FREQUENT_WORDS = 1 << 16
FREQUENT_BYTES = 48
_PLAN_TEXT = "65536"


def _quiet(spark: SparkSession) -> None:
    """Keep the text of the literal maps out of plan descriptions and event logs."""
    spark.conf.set("spark.sql.maxPlanStringLength", _PLAN_TEXT)


def cut_words(df: DataFrame, text_col: str, keep: list[Column], encoder: Encoder, counts_only: bool = False) -> DataFrame:
    """Per row its ids as far as words are pieces, ``-k`` standing for the k-th of ``missing``, its other distinct words.

    With ``counts_only``: ``known``, the number of the former, and ``missing`` with
    repetitions. Values used twice are bound by ``_bound``: the optimizer would
    put a column's whole expression in each place, lambda bodies included.
    """

    def count(words: Column) -> Column:
        missing = encoder.whole.bind(lambda find: F.filter(words, lambda w: find(w).isNull()))
        return _bound(missing, lambda m: F.struct((F.size(words) - F.size(m)).alias("known"), m.alias("missing")))

    def place(words: Column) -> Column:
        return _bound(encoder.whole.bind(lambda find: F.transform(words, lambda w: find(w))), lambda ids: fill(words, ids))

    def fill(words: Column, ids: Column) -> Column:
        missing = F.array_distinct(F.filter(words, lambda _, n: F.get(ids, n).isNull()))
        return _bound(
            missing,
            lambda m: F.struct(
                F.transform(ids, lambda i, n: F.coalesce(i, -F.array_position(m, F.get(words, n)).cast("int"))).alias("ids"), m.alias("missing")
            ),
        )

    words = encoder.words(F.col(text_col))
    if counts_only:
        cut = _bound(words, count)
    else:
        cut = _bound(words, place)
    return df.select(*keep, cut.alias("_cut")).select(*keep, "_cut.*")


def frequent_words(cut: DataFrame, encoder: Encoder) -> Table:
    """The commonest missing words of the whole corpus with their ids, as a second literal map."""
    counts = cut.select(F.explode("missing").alias("word")).groupBy("word").count().where(F.octet_length("word") <= FREQUENT_BYTES)
    top = counts.orderBy(F.desc("count"), "word").limit(FREQUENT_WORDS).select("word")
    rows = top.repartition(8).select("word", encoder.word_ids(F.col("word")).alias("ids")).collect()
    return Table(_hashed([(r["word"], list(r["ids"])) for r in rows]), "array<int>")


def _solved(missing: Column, frequent: Table, encoder: Encoder) -> Column:
    """Ids of each missing word: looked up if it is common, else folded."""
    return frequent.bind(
        lambda known: encoder.ranks.bind(
            lambda find: F.transform(missing, lambda w: F.coalesce(known(w), fold_merges(w, find)))
        )
    )


def encode(df: DataFrame, text_col: str, keep: list[str], path: str | None = None) -> DataFrame:
    """``keep`` and ``ids`` of every row.

    One pass cuts the texts and writes them to the shared folder; the missing
    words are counted over all of them, the commonest encoded once and looked up,
    the others folded where they stand. No row is shuffled.
    """
    _quiet(df.sparkSession)
    encoder = Encoder(path)
    cut = written(cut_words(df, text_col, [F.col(c) for c in keep], encoder), "cut")
    solved = _solved(F.col("missing"), frequent_words(cut, encoder), encoder)
    ids = _bound(solved, lambda s: F.flatten(F.transform("ids", lambda i: F.when(i >= 0, F.array(i)).otherwise(F.get(s, -i - 1)))))
    return cut.select(*keep, ids.alias("ids"))


def token_counts(df: DataFrame, text_col: str, keep: list[str], path: str | None = None) -> DataFrame:
    """``keep`` and ``size``, the number of ids, of every row."""
    _quiet(df.sparkSession)
    encoder = Encoder(path)
    cut = written(cut_words(df, text_col, [F.col(c) for c in keep], encoder, counts_only=True), "cut")
    solved = _solved(F.col("missing"), frequent_words(cut, encoder), encoder)
    return cut.select(*keep, (F.col("known") + F.aggregate(solved, F.lit(0), lambda a, b: a + F.size(b))).alias("size"))
