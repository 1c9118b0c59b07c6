"""Deeply nested semi-structured records as related flat tables.

One depth-first pass over every document emits one tagged row per nested object:
the table tag, the record, the object's position path (its primary key within
the record), its parent's path, its label and its own scalar fields as JSON. The
tagged rows can be written partitioned by tag, and each table gets its schema
when it is read from the tag (``NestedTables.table``).

Producers spell keys differently and hold a list as a list, a list of lists, an
object of numbered or named objects, ``{"items": …}``, one bare object, or as a
JSON string of any of these; all forms are walked alike.

Defined results
---------------
* a payload that is null, damaged, or not one whole JSON document gives no rows;
* positions count objects only, from 0 within their parent in document order;
* a record delivered twice gives each row once (``distinct``), the least label if
  the deliveries differ; a null record id is a value like any other;
* columns of the input other than the id and the payload are ignored, whatever
  their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_STRING_DEPTH = 4
_WRAPPERS = frozenset("items item values list data elements entries results records".split())


@dataclass(frozen=True)
class NestedTable:
    """A table of the nest: the key it hangs from, its label, its known fields and its children."""

    tag: str
    key: str
    label: str
    fields: frozenset[str]
    children: tuple["NestedTable", ...] = field(default=())


EVIDENCE = NestedTable("evidence", "evidence", "file", frozenset({"file", "line", "snippet"}))
GATE = NestedTable("gate", "gateresults", "gatename", frozenset({"gatename", "status", "summary", "evidence", "details", "confidence"}), (EVIDENCE,))
SCORE = NestedTable("score", "validations", "fixstatus", frozenset({"rawscore", "fixstatus", "justification", "gateresults", "hascriticalfailure"}), (GATE,))
REACH = NestedTable("reach", "reaches", "name", frozenset({"name", "kind", "authenticated", "via"}))

# The fields as the tables name them; any spelling with the same letters and digits is one of them.
FIELD_NAMES = (
    "raw_score fix_status justification has_critical_failure gate_name status summary details confidence file line snippet name kind authenticated via"
).split()
_NAMED = {n.replace("_", ""): n for n in FIELD_NAMES}

EMITTED = pa.schema(
    [
        ("tag", pa.string()),
        ("record_id", pa.int64()),
        ("path", pa.list_(pa.int32())),
        ("parent_path", pa.list_(pa.int32())),
        ("label", pa.string()),
        ("payload", pa.string()),
    ]
)
EMITTED_DDL = "tag string, record_id bigint, path array<int>, parent_path array<int>, label string, payload string"


def canonical_key(key: str) -> str:
    return re.sub(r"[^a-z0-9]", "", key.lower())


def _strict(text: str) -> Any:
    def refuse(name: str) -> None:
        raise ValueError(name)

    return json.loads(text, parse_constant=refuse)


def whole_document(payload: str | None) -> Any:
    """The document of a payload, through a byte-order mark and string wrappers; None if damaged."""
    if payload is None:
        return None
    value: Any = payload
    for _ in range(MAX_STRING_DEPTH):
        try:
            value = _strict(value.lstrip("﻿ \t\r\n"))
        except (ValueError, RecursionError):
            return None
        if not isinstance(value, str):
            return value
    return None


def elements(held: Any, known: frozenset[str], inside: bool = False, depth: int = 0) -> Iterator[dict]:
    """The objects a list stands for, however it is held."""
    if isinstance(held, str):
        text = held.lstrip("﻿ \t\r\n")
        if text[:1] in ("[", "{", '"') and depth < MAX_STRING_DEPTH:
            try:
                yield from elements(_strict(text), known, inside, depth + 1)
            except (ValueError, RecursionError):
                return
    elif isinstance(held, list):
        for one in held:
            yield from elements(one, known, True, depth)
    elif isinstance(held, dict):
        if any(canonical_key(k) in known for k in held):
            yield held
        elif len(held) == 1 and canonical_key(next(iter(held))) in _WRAPPERS:
            yield from elements(next(iter(held.values())), known, False, depth)
        elif held and all(v is None or isinstance(v, (dict, list)) for v in held.values()):
            for one in held.values():
                yield from elements(one, known, True, depth)
        elif inside:
            yield held


def _by_key(obj: dict, key: str) -> Any:
    found = None
    for k, v in obj.items():
        if canonical_key(k) == key and (found is None or v is not None):
            found = v
    return found


def _own(obj: dict, below: set[str]) -> dict:
    """An object's own fields under the names of the tables; of two spellings of one the later value that is not null."""
    own: dict = {}
    for k, v in obj.items():
        key = canonical_key(k)
        name = _NAMED.get(key, k)
        if key not in below and (name not in own or v is not None):
            own[name] = v
    return own


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def visit(doc: Any, tables: tuple[NestedTable, ...], parent: tuple[int, ...] = ()) -> Iterator[tuple[str, tuple[int, ...], tuple[int, ...], str, dict]]:
    """Depth-first emission of (tag, path, parent path, label, own scalar fields)."""
    if not isinstance(doc, dict):
        return
    for t in tables:
        for i, obj in enumerate(elements(_by_key(doc, t.key), t.fields)):
            below = {c.key for c in t.children}
            own = _own(obj, below)
            yield t.tag, (*parent, i), parent, _text(_by_key(obj, t.label)), own
            if t.children:
                yield from visit(obj, t.children, (*parent, i))


def emit(df: DataFrame, tables: tuple[NestedTable, ...], id_col: str, payload_col: str = "payload", with_payload: bool = True) -> DataFrame:
    """Tagged rows of every nested object of every record, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in EMITTED]
            for rid, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for tag, path, parent, label, own in visit(whole_document(payload), tables):
                    row = (tag, rid, path, parent, label, json.dumps(own, ensure_ascii=False) if with_payload else None)
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
                if len(out[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(_sound(c), f.type) for c, f in zip(out, EMITTED, strict=True)], schema=EMITTED)
                    out = [[] for _ in EMITTED]
            yield pa.RecordBatch.from_arrays([pa.array(_sound(c), f.type) for c, f in zip(out, EMITTED, strict=True)], schema=EMITTED)

    return df.select(F.col(id_col).cast("bigint"), F.col(payload_col).cast("string")).mapInArrow(run, EMITTED_DDL)


def _sound(values: list) -> list:
    """Lone surrogates from JSON escapes can't be UTF-8; they become the replacement character."""
    if values and any(isinstance(v, str) and not v.isascii() for v in values):
        return [v.encode("utf-8", "surrogatepass").decode("utf-8", "replace") if isinstance(v, str) and not v.isascii() else v for v in values]
    return values


class NestedTables:
    """The related flat tables of emitted rows."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def distinct(self) -> DataFrame:
        keys = ["tag", "record_id", "path", "parent_path"]
        one = self.rows.groupBy(*keys).agg(F.min(F.struct("label", "payload")).alias("one"))  # both of one delivery
        return one.select(*keys, "one.label", "one.payload")

    def table(self, tag: str, schema: T.StructType) -> DataFrame:
        """One table with its schema applied to the payload; ``path`` is its key, ``parent_path`` the link."""
        rows = self.rows.where(F.col("tag") == tag)
        return rows.select("record_id", "path", "parent_path", "label", F.from_json("payload", schema).alias("own")).select(
            "record_id", "path", "parent_path", "label", "own.*"
        )

    def write(self, path: str, mode: str = "overwrite") -> None:
        self.rows.write.mode(mode).partitionBy("tag").parquet(path)


def nested_children(validation: DataFrame, context: DataFrame) -> DataFrame:
    """Scores, gates and evidence of validation records and reaches of contexts, each once, with its positions."""
    rows = emit(validation, (SCORE,), "record_id", with_payload=False).unionByName(
        emit(context, (REACH,), "record_id", with_payload=False)
    )
    flat = rows.select(F.col("tag").alias("child_kind"), "record_id", *_positions(), "label")
    keys = ["child_kind", "record_id", "score_pos", "item_pos", "evidence_pos"]
    return flat.groupBy(*keys).agg(F.min("label").alias("label"))


def _positions() -> list:
    reach = F.col("tag") == "reach"

    def at(i: int):
        return F.coalesce(F.get("path", F.lit(i)), F.lit(-1))

    return [
        F.when(reach, F.lit(-1)).otherwise(at(0)).cast("int").alias("score_pos"),
        F.when(reach, at(0)).otherwise(at(1)).cast("int").alias("item_pos"),
        F.when(reach, F.lit(-1)).otherwise(at(2)).cast("int").alias("evidence_pos"),
    ]
