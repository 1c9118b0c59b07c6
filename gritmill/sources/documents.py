"""Files as rows: bounded text reads, office documents, syntax facts of Python sources."""

from __future__ import annotations

import ast
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PARTS = re.compile(r"(?:word/document|ppt/slides/slide\d+|xl/sharedStrings|xl/worksheets/sheet\d+)\.xml$")
MAX_PART = 50_000_000


def bounded_texts(spark: SparkSession, folder: str, max_bytes: int = 1 << 20) -> DataFrame:
    """path, length and text of all files up to a size; invalid bytes become replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("length") <= max_bytes)
    return files.select("path", "length", F.decode("content", "UTF-8").alias("text"))


def office_text(content: bytes | None) -> str | None:
    """Text of a docx, pptx or xlsx; None if it is none of them. Parts are bounded and read one at a time."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            found = []
            for info in sorted((i for i in z.infolist() if _PARTS.search(i.filename)), key=lambda i: i.filename):
                xml = z.open(info).read(MAX_PART).decode("utf-8", "replace")
                xml = re.sub(r"</(?:w:p|a:p|si|row)>", "\n", xml)
                found.append(re.sub(r"<[^>]+>", "", xml))
            return "\n".join(found).strip() if found else None
    except (zipfile.BadZipFile, OSError, RuntimeError, KeyError):
        return None


def office_texts(files: DataFrame) -> DataFrame:
    """path and text of office documents given as ``binaryFile`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [office_text(c) for c in b["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def python_facts(source: str | None) -> list[tuple[str, str, int, int]]:
    """(kind, name, first line, last line) of the definitions and calls of a Python source; none if it does not parse."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.append(("def", node.name, node.lineno, node.end_lineno or node.lineno))
        elif isinstance(node, ast.Call):
            name = node.func.attr if isinstance(node.func, ast.Attribute) else node.func.id if isinstance(node.func, ast.Name) else ""
            if name:
                out.append(("call", name, node.lineno, node.end_lineno or node.lineno))
    return out


def code_facts(files: DataFrame) -> DataFrame:
    """Definitions and calls of ``path, text`` rows: Python by its grammar, other languages by patterns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                facts = python_facts(text) if str(path).endswith(".py") else pattern_facts(text)
                rows += [(path, *f) for f in facts]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "line_start", "line_end"])

    return files.select("path", "text").mapInPandas(run, "path string, kind string, name string, line_start bigint, line_end bigint")


_DEF = re.compile(r"\b(?:function|func|def|fn|fun|class|interface|struct)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)")
_CALL = re.compile(r"(?<![\w.])(?:[A-Za-z_]\w*\.)*([A-Za-z_]\w*)\s*\(")
_KEYWORDS = frozenset("if for while switch return catch function func def fn fun and or not in elif else new await typeof sizeof".split())


def pattern_facts(text: str | None) -> list[tuple[str, str, int, int]]:
    out = []
    for n, line in enumerate((text or "").split("\n"), 1):
        defs = {m[1] for m in _DEF.finditer(line)}
        out += [("def", d, n, n) for d in sorted(defs)]
        out += [("call", m[1], n, n) for m in _CALL.finditer(line) if m[1] not in defs and m[1] not in _KEYWORDS]
    return out
