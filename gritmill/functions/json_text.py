"""JSON in prose and its shape: salvage of the first balanced object, key paths, shape hashes."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def salvage(text: str | None) -> str | None:
    """The first balanced object or array in a text; one cut off is closed after its last complete value; None if there is none."""
    if not text:
        return None
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    try:
        value, _ = json.JSONDecoder().raw_decode(text, start)
        return json.dumps(value, ensure_ascii=False)
    except (ValueError, RecursionError):
        pass
    stack, quoted, escaped, good = [], False, False, None
    for i in range(start, len(text)):
        ch = text[i]
        if quoted:
            escaped, quoted = (False, quoted) if escaped else (ch == "\\", ch != '"')
            continue
        if ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]":
            if not stack or stack.pop() != ch:
                return None
            good = (i + 1, list(stack))
    if good is None:
        return None
    closed = text[start : good[0]] + "".join(reversed(good[1]))
    try:
        return json.dumps(json.loads(closed), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


def key_paths(value: object, prefix: str = "") -> list[str]:
    """Paths like ``a.b[]`` of all keys, in order of appearance, each once."""
    out: dict[str, None] = {}

    def walk(v: object, at: str) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                path = f"{at}.{k}" if at else str(k)
                out[path] = None
                walk(x, path)
        elif isinstance(v, list):
            for x in v:
                walk(x, at + "[]")

    walk(value, prefix)
    return list(out)


@F.pandas_udf(T.StringType())
def salvaged(texts: pd.Series) -> pd.Series:
    return texts.map(salvage, na_action="ignore")


@F.pandas_udf(T.StringType())
def shape_hash(texts: pd.Series) -> pd.Series:
    """SHA-1 of the sorted key paths of a JSON document; null if it is none."""

    def one(t: str) -> str | None:
        try:
            keys = key_paths(json.loads(t))
        except (ValueError, RecursionError):
            return None
        return hashlib.sha1("\n".join(sorted(set(keys))).encode("utf-8", "replace")).hexdigest()

    return texts.map(one, na_action="ignore")
