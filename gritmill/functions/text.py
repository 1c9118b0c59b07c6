"""Scalar functions over names, references, paths and texts: Column in, Column out. Nulls stay null unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weakness -> class of vulnerability.
CLASS_OF_CWE = {
    416: "use-after-free", 122: "heap-overflow", 121: "stack-overflow", 134: "format-string", 190: "integer-overflow", 191: "integer-overflow",
    843: "type-confusion", 362: "race-condition", 367: "race-condition", 74: "injection", 77: "injection", 78: "injection", 79: "injection",
    89: "injection", 90: "injection", 94: "injection", 95: "injection", 643: "injection", 611: "injection", 918: "injection", 22: "injection",
    434: "injection", 502: "unsafe-deserialization", 840: "logic-flaw", 841: "logic-flaw", 862: "logic-flaw", 863: "logic-flaw", 284: "logic-flaw",
    285: "logic-flaw", 287: "logic-flaw", 200: "info-leak", 209: "info-leak", 311: "info-leak", 312: "info-leak", 319: "info-leak", 532: "info-leak",
}
# Ending -> language.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go",
    "cs": "csharp", "php": "php", "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "rs": "rust", "kt": "kotlin", "swift": "swift",
}
TEST_PATH = r"(?i)(^|/)(tests?|__tests__|mocks?|examples?|fixtures?|samples?|testdata)(/|$)|_test\.|\.test\.|\.spec\.|Test\.java$|Tests\.cs$"
WHITE = r"[ \t\r\n\x0b\x0c]+"


def lookup(values: dict, key: Column, default: object = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    found = table[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def norm_name(c: Column) -> Column:
    """Trimmed, lower case, hyphens and spaces as underscores; null is empty."""
    return F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), "- ", "__")


def coerce_enum(c: Column, valid: list[str], alias: dict[str, str], default: str) -> Column:
    """A value as it is if valid, else normalized, else by its alias, else the default."""
    raw, k = F.trim(F.coalesce(c, F.lit(""))), norm_name(c)
    return F.when(raw.isin(valid), raw).when(k.isin(valid), k).otherwise(lookup(alias, k, default) if alias else F.lit(default))


def coerce_int(c: Column, default: int) -> Column:
    t = F.trim(c)
    return F.coalesce(F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint")), F.lit(default).cast("bigint"))


def coerce_confidence(c: Column, default: float) -> Column:
    """Percent signs dropped; whole 2..10 are tenths, 2..100 percents; kept within 0 and 1."""
    t = F.trim(F.regexp_replace(F.trim(c), r"%+$", ""))
    f = t.try_cast("double")
    scaled = F.when((f >= 2) & (f <= 10) & (f == F.floor(f)), f / 10).when((f >= 2) & (f <= 100), f / 100).otherwise(f)
    return F.when(f.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))


def cwe_number(c: Column) -> Column:
    return F.regexp_extract(F.trim(c), r"^(?i:cwe-)?(\d+)$", 1).try_cast("bigint")


def vuln_class(c: Column) -> Column:
    """Class of a CWE written CWE-n in any case; other for the rest and for null."""
    named = F.regexp_extract(F.upper(F.trim(c)), r"^CWE-(\d+)$", 1).try_cast("int")
    return F.coalesce(lookup(CLASS_OF_CWE, named), F.lit("other"))


def normalize_ref(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.replace(F.trim(c), F.lit("\\"), F.lit("/")), r"^(?:\./)+", ""), F.lit(""))


def ref_file(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(.*):[1-9]\d*$", 1), F.lit(""))


def ref_line(c: Column) -> Column:
    return F.regexp_extract(c, r"^.*:([1-9]\d*)$", 1).try_cast("bigint")


def app_id(c: Column) -> Column:
    t = F.trim(c)
    return F.when(F.regexp_replace(t, "^0+", "") == "", F.lit("0")).otherwise(F.regexp_replace(t, "^0+", ""))


def top_level_dir(c: Column) -> Column:
    return F.when(F.instr(c, "/") > 0, F.split_part(c, F.lit("/"), F.lit(1))).otherwise(F.lit("(repo root)"))


def language_of(path: Column) -> Column:
    return lookup(LANGUAGES, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def with_commas(c: Column) -> Column:
    return F.format_number(c, 0)


def nonblank_lines(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\s\p{Z}]")))).cast("bigint")


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start .. max(end, start), cut at the end of the text; null before line 1 or past the end."""
    lines = F.split(text, "\n")
    n = F.greatest(start, end) - start + 1
    return F.when((start >= 1) & (start <= F.size(lines)), F.array_join(F.slice(lines, start.cast("int"), n.cast("int")), "\n"))


def fnmatch_regex(glob: str) -> str:
    """A shell pattern whose star crosses slashes, as an anchored expression."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and "]" in glob[i + 2 :]:
            j = glob.index("]", i + 2)
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = j
        else:
            out.append(re.escape(ch))
        i += 1
    return "^" + "".join(out) + "$"


def first_glob(path: Column, globs: list[str]) -> Column:
    """The first glob a path matches; a leading ``**/`` is also tried on the name alone."""
    name = F.substring_index(path, "/", -1)
    hit = None
    for g in globs:
        ok = path.rlike(fnmatch_regex(g))
        if g.startswith("**/"):
            ok = ok | name.rlike(fnmatch_regex(g[3:]))
        hit = F.when(ok, F.lit(g)) if hit is None else hit.when(ok, F.lit(g))
    return hit if hit is not None else F.lit(None).cast("string")


def scrub_url(c: Column) -> Column:
    return F.regexp_replace(c, r"([A-Za-z][A-Za-z0-9+.\-]*://)[^/@\s]*@", "$1***@")


def origin_key(c: Column) -> Column:
    """host/path of a repository address in lower case, without user, port and .git; null for files and blanks."""
    t = F.trim(c)
    url = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:]+)(?::\d+)?/+(.+)$"
    scp = r"^(?:[^/@:]+@)?([^/:@]+):(?!//)(.+)$"
    host = F.when(t.rlike(url), F.regexp_extract(t, url, 1)).when(t.rlike(scp), F.regexp_extract(t, scp, 1))
    path = F.when(t.rlike(url), F.regexp_extract(t, url, 2)).when(t.rlike(scp), F.regexp_extract(t, scp, 2))
    tidy = F.regexp_replace(F.regexp_replace(path, r"^/+|/+$", ""), r"\.git$", "")
    return F.when(~t.rlike("(?i)^file:") & (tidy != ""), F.lower(F.concat_ws("/", host, tidy)))


def md_cell(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), WHITE, " "))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def csv_field(c: Column) -> Column:
    return F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WHITE, " "))


def fingerprint(*parts: Column) -> Column:
    """SHA-1 of the parts with a NUL between them."""
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.chr(F.lit(0)), p)
    return F.sha1(joined)


def remediation_section(markdown: Column) -> Column:
    section = F.regexp_extract(markdown, r"(?s)## Remediation(.*?)(?:\n## |$)", 1)
    return F.coalesce(F.regexp_replace(section, r"^\s+|\s+$", ""), F.lit(""))


def comment_marker_id(body: Column) -> Column:
    return F.nullif(F.regexp_extract(body, r"<!-- finding:([0-9a-f]+) -->", 1), F.lit(""))


def route_path(c: Column) -> Column:
    """Cut at ? or #, empty segments dropped, parameters in one spelling."""
    base = F.regexp_replace(F.split_part(F.split_part(c, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), r":(\w+)", "{$1}")
    segments = F.filter(F.split(base, "/"), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(segments, "/"))
