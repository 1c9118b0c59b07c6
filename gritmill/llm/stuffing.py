"""Keyword-stuffed pages, link lists and tag lists.

Every line of a page is reduced to a *shape*: buckets of its words, capitals,
separators, links, tags and of the words a phrase of it repeats, and how it ends.
Lines of one shape are grouped, and the page is flagged when the ``FEW_SHAPES``
largest groups of non-sentence shapes hold most of it. Disguised words (spaced
letters, digits for letters, underscores, stars) are read as plain ones first.

Words without sentence structure only count when they come again and again; less
repetition is enough when one shape of them fills the page, but some is always
needed, so a short remark or a heading never counts. A sentence is one in form only,
and has the shape of a *refrain*, when a phrase that comes again within it makes up
a good part of it; refrains count when the page repeats the same few phrases.

Defined results
---------------
* null, empty or blank text, and one of less than ``MIN_ITEMS`` links, tags, menu
  entries and words: no case;
* copies of a text under several ids are each judged, the same way;
* texts are read whole, whatever their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAM_SHARE = 0.5
# Links, tags, menu entries and keywords that make a list of them.
MIN_ITEMS = 2
# Part of a sentence's words that a phrase repeated within it must hold, and times the page must say one.
ECHO_SHARE = 0.3
REFRAINS = 3
REPEAT = 2.0
# Shape groups that may hold the page together.
FEW_SHAPES = 6

_LINK = re.compile(
    r"<a\s[^>]*href=[^>]*>.*?</a>|<loc>.*?</loc>|\[[^\]\n]*\]\([^)\s]*\)|(?:https?|ftp)://[^\s,;|)>\]\"'，、。]+|www\.[^\s,;|)>\]\"'，、。]+"
    r"|(?<![\w/.])(?:[\w\-]+/)+[\w\-]+\.html?(?![\w/,])",
    re.I | re.S,
)
_HTML = re.compile(r"</?(?:ul|ol|li|p|div|span|br|td|tr|table|url|urlset|nav|a)\b[^>]*>", re.I)
_TAG = re.compile(r"(?<![\w&])#[^\W\d_][\w\-]*")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_ASCII_WORD = re.compile(r"[a-z]+(?:['\-][a-z]+)*")  # the same for lower ASCII, where it is faster
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_NUM = re.compile(r"\d+(?:[.,:]\d+)*")
_SEP = re.compile(r"[|;,•·»›/，、；｜]|\s[-–—>/]\s|>>|::")
_MENU_SEP = re.compile(r"[|·•»›｜]|\s[-–—>/]\s|>>|::")
_SPLIT = re.compile(r"(?<=[.!?])\s+(?=[\"“'(\[]?[A-ZÀ-ÞА-ЯЁ])|(?<=[。！？])")
_STAMP = re.compile(r"^\W*(?:\d{4}-\d\d-\d\d[T ]\d\d:|\d\d:\d\d:\d\d|\[\d{4}-|[A-Z][a-z]{2} \d+ \d\d:)")
_CODE = re.compile(r"[{}<>=$\\`]|\w\(|\)\s*[;:{]|\w\[|\w_\w|^\s*(?:[+\-]{1,2}\s|@@|#include|//|/\*|\d+ \| )|;\s*$|\"[^\"]*\"\s*[:,)]|^\s*(?:def|class|func|public|private|return|import|const|let|var|if|for|end)\b(?!.*[.!?]$)")
# Marks of code that no disguise of words has.
_HARD_CODE = re.compile(r"[{}<>=\\`\"]|\w\(|\)\s*[;:{]|\w\[|;\s*$|//|/\*|\w[.:/]\w|^\s*(?:[+\-]{1,2}\s|@@|#include|\d+ \| )")
_SHELL = re.compile(r"^\s*(?:\d+ \| |[+\-] ?)?\s*(?:curl|wget|tar|cd|echo|export|set -|done|for \w+ in|fi|do|sudo|rm|cp|mv|mkdir|docker|kubectl|pip|npm|git|source|chmod)\b(?!.*[.!?]$)")
_JOINED = re.compile(r"^\W*[^\W\d_]+(?:_[^\W\d_]+)+\W*$")
_FIELD = re.compile(r"^\s*-?\s*[\w.\-]+\s*[:=]\s*\S*$|^\s*[\w\-]+:\s*$")
_PATHROW = re.compile(r"^[^\s,]+(?:,[^\s,]*){2,}$")
_PRODUCT = re.compile(r"(?i)^\W*(?:sku|item|art|ref|prod|model|artikel|article|articulo|nr|no)[\s.\-:#]*\d|\b\d+[.,]\d\d\b.*\|?\s*(?:in stock|sold out|auf lager|en stock|em estoque|в наличии|有货|在庫)|\bedition\b.*\b\d+ (?:seats?|credits?|users?)|\btags? \w+[;,]")
_LABEL = re.compile(r"^\W*[^\W\d_]+(?: [^\W\d_]+)?\s*[:：]\s*")
_NAV = re.compile(r"(?i)^\W*(?:more [\w ]+ links?|click here|\d+ (?:hits?|results?|treffer|links?)|[\w ]+ (?:>>|»)|next|previous|home|top|menu|sitemap|back to [\w ]+)\W*$")
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_HEADING = re.compile(r"^\s*#{1,6}\s")


# Disguises: letters apart, digits and marks for letters, names joined by underscores, marks around words.
_APART = re.compile(r"(?<!\S)[^\W\d_](?: [^\W\d_]){2,}(?!\S)")
_DISGUISED = re.compile(r"(?<!\S)[^\W_]*(?:[^\W\d_][0134578+@$!]|[0134578+@$!][^\W\d_])[^\W_]*(?:[+@$!][^\W_]*)*(?!\S)|(?<!\S)[0134578+@$!]*[0134578][+@$!][0134578+@$!]*(?!\S)|(?<!\S)[+@$!][0134578]+[+@$!]?(?!\S)")
_UNDERSCORED = re.compile(r"(?<!\S)[^\W\d_]+(?:_[^\W\d_]+)+(?!\S)")
_DECORATED = re.compile(r"[★☆✦✪✿❤♥►▶✔✓◆●■~]+")
_LEET = str.maketrans("0134578+@$!", "oieastbtasi")


def plain_words(line: str) -> str:
    """A line with disguised words in plain letters; the marks around words become separators."""
    line = _DECORATED.sub("|", line)
    line = _APART.sub(lambda m: m[0].replace(" ", ""), line)
    line = _DISGUISED.sub(lambda m: m[0].translate(_LEET), line)
    return _UNDERSCORED.sub(lambda m: m[0].replace("_", " "), line)


# Signs that a disguised line can't be without.
_SUSPECT = re.compile(r"[★☆✦✪✿❤♥►▶✔✓◆●■~_]|[^\W\d_][134578+@$!][^\W\d_]|(?<!\S)[^\W\d_] [^\W\d_] ")


def _disguised(line: str) -> bool:
    """Whether a line is written in disguised words, without any mark of code beside them."""
    if not _SUSPECT.search(line) or _HARD_CODE.search(line):
        return False
    return bool(_DECORATED.search(line) or _APART.search(line) or len(_DISGUISED.findall(line)) >= 2 or "_" in line and len(_UNDERSCORED.findall(line)) >= 2)


def _bucket(n: int) -> int:
    return n if n < 4 else 4 + min(4, (n - 4) // 4)


def _units(line: str) -> list[str]:
    if line.isascii() and "\t" not in line and ". " not in line and "! " not in line and "? " not in line:
        return [line]
    parts = [p for p in _SPLIT.split(line) if p and p.strip()]
    return parts or [line]


def echo(bare: str, low: list[str], cjk: int) -> tuple[float, str, int]:
    """Part of a unit that phrases repeated within it hold, the commonest of them and its number: word pairs and long words, or runs of three signs."""
    if cjk * 2 > len(bare):
        signs = "".join(_CJK.findall(bare))
        grams = [signs[i : i + 3] for i in range(len(signs) - 2)]
        return (0.0, "", 0) if len(set(grams)) == len(grams) else _covered(grams, 3, len(signs), lambda g: True)
    long = [w for w in low if len(w) >= 4]
    if len(set(long)) == len(long):  # no phrase with a long word comes again
        return 0.0, "", 0
    pairs = list(zip(low, low[1:]))
    held = _covered(pairs, 2, len(low), lambda p: len(p[0]) >= 4 or len(p[1]) >= 4)
    alone = _covered(low, 1, len(low), lambda w: len(w) >= 5)
    return held if held[0] >= alone[0] else alone


def _covered(grams: list, width: int, n: int, counts: Callable) -> tuple[float, str, int]:
    if len(set(grams)) == len(grams):
        return 0.0, "", 0
    number = Counter(grams)
    again = {g for g, k in number.items() if k > 1 and counts(g)}
    if not again:
        return 0.0, "", 0
    places = {i + d for i, g in enumerate(grams) if g in again for d in range(width)}
    most = max(again, key=lambda g: (number[g], g))
    return len(places) / n, most if isinstance(most, str) else " ".join(most), number[most]


_ENDS = frozenset(".!?…。！？")


def _ended(bare: str) -> bool:
    tail = bare.rstrip().rstrip("\"'”’)]")
    return tail[-1:] in _ENDS and tail != "" or not bare.isascii() and ("。" in bare or "！" in bare or "？" in bare)


# Signs that a sentence without links, tags, tables and code has none of.
_SIGNS = frozenset("<>#|~★☆✦✪✿❤♥►▶✔✓◆●■;:`{}[]=\\$+@_·•»›、，；｜")


def _sentence(line: str) -> tuple[str, tuple, list[str], tuple[str, int]] | None:
    """What ``shape`` gives for a plain sentence of more than eight words, sooner; None for any other unit."""
    if not _SIGNS.isdisjoint(line) or not _ended(line) or "www." in line or ".htm" in line:
        return None
    low = line.lower()
    plain = line.isascii()
    words = _ASCII_WORD.findall(low) if plain else _WORD.findall(low)
    n = len(words)
    if n <= 8 or not plain and _CJK.search(line) or n <= 12 and len(line) < 80 and _NAV.match(line):
        return None
    if line[:1] in "[ADFJMNOS0123456789" and _STAMP.match(line):
        return None
    if 3 * (low.count(",") if " - " not in low and " / " not in low and plain else len(_SEP.findall(line))) > n:
        return None
    held, phrase, times = echo(line, words, 0)
    return None if held >= ECHO_SHARE else ("sentence", (), words, (phrase, times))


def shape(line: str) -> tuple[str, tuple, list[str], tuple[str, int]]:
    """Kind, shape, words and repeated phrase of one unit of a line; only marks that can be there are looked for."""
    none = ("", 0)
    if sentence := _sentence(line):
        return sentence
    if line[:3].strip()[:1].isdigit() and _STAMP.match(line) or line[:1] in "[ADFJMNOS" and _STAMP.match(line):
        return "log", (), [], none
    if _disguised(line):
        line = plain_words(line)
    markup = "<" in line
    links = _LINK.findall(line) if markup or "://" in line or "www." in line or ".htm" in line or "](" in line else []
    rest = _LINK.sub(" ", line) if links else line
    if markup:
        rest = _HTML.sub(" ", rest)
    tags = len(_TAG.findall(rest)) if "#" in rest else 0
    bare = _TAG.sub(" ", rest) if tags else rest
    low = bare.lower()
    plain = bare.isascii()
    words = _ASCII_WORD.findall(low) if plain else _WORD.findall(low)
    cjk = 0 if plain else len(_CJK.findall(bare))
    n = max(len(words), cjk // 2) if cjk else len(words)
    ended = _ended(bare)
    seps = len(_SEP.findall(bare))

    def form(held: float = 0.0) -> tuple:
        caps = sum(w[:1].isupper() for w in _WORD.findall(bare))
        return _bucket(n), _bucket(caps), _bucket(seps), _bucket(len(_NUM.findall(bare))), min(len(links), 3), min(tags, 3), int(4 * held), ended

    if not ended and _SHELL.match(line):
        return "code", (), words, none
    if links and not (_CODE.search(bare) and re.search(r"[(\"'`=]\s*$", line[: line.find(links[0])] if links[0] in line else "")):
        if n <= 5 * len(links) and not (ended and n > 5) or not ended and n <= 3 * len(links):
            return "link", form(), words, none
    if n <= 12 and len(rest) < 80 and _NAV.match(rest):
        return "nav", form(), words, none
    if tags >= 2 and 2 * tags >= n:
        return "tag", form(), words, none
    if not (ended and n > 8) and _PRODUCT.search(bare):
        return "tag", form(), words, none
    if ended and n >= 3 and seps * 3 <= n:
        held, phrase, times = echo(bare, words, cjk)
        return ("refrain", form(held), words, (phrase, times)) if held >= ECHO_SHARE else ("sentence", (), words, none)
    if ended and n > 8 and _PRODUCT.search(bare):
        return "sentence", (), words, none
    if _PATHROW.match(line.strip()) or len(_NUM.findall(bare)) >= max(3, n):
        return "table", (), words, none
    if _JOINED.match(bare):
        return "words", form(), re.split(r"[\W_]+", low.strip()), none
    code = bool(_CODE.search(bare))
    if not ended and seps >= 6 and 6 * seps >= n:
        # Menus: short items between marks that no enumeration in prose has; rows of a table begin with theirs.
        if 2 * len(_MENU_SEP.findall(bare)) >= n and line.strip()[:1] != "|" and not (code and _HARD_CODE.search(bare.replace(" > ", " / "))):
            return "nav", form(), words, none
        if not code:
            return "list", form(), words, none
    if code or _FIELD.match(line):
        return "code", (), words, none
    return ("words", form(), words, none) if n else ("blank", (), words, none)


_NEVER = frozenset(("sentence", "log", "code", "table", "heading", "blank"))


def spam_share(text: str | None) -> tuple[float, int, float]:
    """Share of the text in the few largest groups of non-sentence shapes, number of all of those groups, repetition of words."""
    if not text or not text.strip():
        return 0.0, 0, 0.0
    size: Counter = Counter()
    lines: Counter = Counter()
    words: Counter = Counter()
    phrases: Counter = Counter()
    items = total = 0
    fenced = False
    for line in text.splitlines():
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if not line.strip():
            continue
        for unit in _units(line):
            kind, form, found, phrase = shape(unit) if not fenced else ("code", (), [], ("", 0))
            if kind == "words" and _HEADING.match(unit):
                kind = "heading"
            weight = len(unit.strip())
            total += weight
            if kind in _NEVER:
                continue
            size[kind, form] += weight
            lines[kind, form] += 1
            items += max(1, form[4] + form[5], form[2] + 1 if kind == "nav" else 0) if kind in ("link", "nav", "tag") else len(found)
            if kind in ("words", "list"):
                words.update(found)
            elif kind == "refrain":
                phrases[phrase[0]] += phrase[1]
    if not total or items < MIN_ITEMS:
        return 0.0, 0, 0.0
    n = sum(words.values())
    repeat = n / len(words) if words else 0.0
    loose_lines = sum(v for (k, _), v in lines.items() if k == "words")
    counted = {"link", "nav", "tag"}
    one = max((v for (k, _), v in size.items() if k == "words"), default=0) > SPAM_SHARE * total
    if n >= 10 and (repeat >= REPEAT or loose_lines >= 5 and repeat >= 1.3 or one and n >= 20 and repeat >= 1.5):
        counted.add("words")
    if n >= 10 and repeat >= 1.25:
        counted.add("list")
    if max(phrases.values(), default=0) >= REFRAINS:
        counted.add("refrain")
    forms = Counter()
    for (k, f), v in size.items():
        if k in counted:
            forms[k, f] += v
    return sum(v for _, v in forms.most_common(FEW_SHAPES)) / total, len(forms), repeat


def stuffed(text: str | None) -> bool:
    """Whether a page consists mainly of keywords, links or tags."""
    return spam_share(text)[0] > SPAM_SHARE


def stuffed_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of the pages made to catch searches. No shuffle but that of the ids found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            keep = pa.array([stuffed(t) for t in b.column(1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([ids.filter(keep)], names=[id_col])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).where(F.col(text_col) != "").mapInArrow(run, f"{id_col} {kind}").distinct()


def page_shapes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Share, number of shapes and repetition that each page is judged by; nulls and blanks give zeros."""

    @F.pandas_udf("share double, shapes int, repetition double")
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([spam_share(t) for t in texts], columns=["share", "shapes", "repetition"])

    return df.select(id_col, measure(F.col(text_col)).alias("m")).select(id_col, "m.*")
