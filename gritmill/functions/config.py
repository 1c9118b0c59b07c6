"""Configuration on the driver: merging of settings, variables of the environment, and a reader for plain YAML."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any


class ConfigError(ValueError):
    pass


def deep_merge(base: Any, over: Any) -> Any:
    """``over`` laid on ``base``: maps key by key, anything else replaced; null removes nothing and replaces nothing."""
    if isinstance(base, dict) and isinstance(over, dict):
        merged = dict(base)
        for key, value in over.items():
            merged[key] = deep_merge(base[key], value) if key in base else value
        return merged
    return base if over is None else over


_VARIABLE = re.compile(r"\$\{([A-Za-z_]\w*)\}")


def expand(value: Any, getenv: Callable[[str], str | None], path: str = "") -> Any:
    """``${NAME}`` in all texts replaced by the environment's values; an unset one is an error that names its place."""
    if isinstance(value, dict):
        return {k: expand(v, getenv, f"{path}.{k}" if path else str(k)) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, getenv, f"{path}[{i}]") for i, v in enumerate(value)]
    if not isinstance(value, str):
        return value

    def put(m: re.Match) -> str:
        got = getenv(m[1])
        if got is None:
            raise ConfigError(f"{path}: {m[1]} is not set")
        return got

    return _VARIABLE.sub(put, value)


_KEY = re.compile(r"""^("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#:\[\]{},&*!|>%@`"'][^:#]*?|[^\s#:\[\]{},&*!|>%@`"'](?:[^:]|:(?!\s))*?)\s*:(?:\s+|$)""")
_NUMBER = re.compile(r"^[+-]?(?:\d+|\d*\.\d+(?:[eE][+-]?\d+)?|\d+\.\d*(?:[eE][+-]?\d+)?)$")


def _scalar(text: str) -> Any:
    t = text.strip()
    if t[:1] == '"' and t[-1:] == '"' and len(t) > 1:
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[1], m[1]), t[1:-1])
    if t[:1] == "'" and t[-1:] == "'" and len(t) > 1:
        return t[1:-1].replace("''", "'")
    if t in ("", "~", "null", "Null", "NULL"):
        return None
    if t in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return t.lower() == "true"
    if t[:1] in "[{":
        value, rest = _flow(t)
        if rest.strip():
            raise ConfigError(f"text after a closed list or map: {rest.strip()!r}")
        return value
    if t[:1] in "&*!%@`":
        raise ConfigError(f"not supported: {t!r}")
    if _NUMBER.match(t):
        return float(t) if "." in t else int(t)
    return t


def _flow(text: str) -> tuple[Any, str]:
    """A list or map in brackets, and what follows it."""
    opened, rest = text[0], text[1:].lstrip()
    out: Any = [] if opened == "[" else {}
    close = "]" if opened == "[" else "}"
    while True:
        if not rest:
            raise ConfigError("a list or map is not closed")
        if rest[0] == close:
            return out, rest[1:]
        key = None
        if opened == "{":
            m = re.match(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^:,{}\[\]]+):\s*""", rest)
            if not m:
                raise ConfigError(f"no key at {rest!r}")
            key, rest = _scalar(m[1]), rest[m.end() :]
        if rest[:1] in ("[", "{"):
            value, rest = _flow(rest)
        else:
            m = re.match(r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\[\]{}]*)""", rest)
            value, rest = _scalar(m[0]), rest[m.end() :]
        if opened == "[":
            out.append(value)
        else:
            out[key] = value
        rest = rest.lstrip()
        if rest[:1] == ",":
            rest = rest[1:].lstrip()
        elif rest[:1] != close:
            raise ConfigError("a comma is missing")


def _uncommented(line: str) -> str:
    quote = ""
    for i, ch in enumerate(line):
        if quote:
            quote = "" if ch == quote and line[i - 1 : i] != "\\" else quote
        elif ch in "\"'" and (i == 0 or line[i - 1] in " \t[{,:"):
            quote = ch
        elif ch == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i]
    return line


class _Lines:
    def __init__(self, text: str):
        self.raw = text.lstrip("\ufeff").splitlines()
        self.at = 0

    def peek(self) -> tuple[int, str] | None:
        """Indent and content of the next line that says something."""
        while self.at < len(self.raw):
            line = _uncommented(self.raw[self.at]).rstrip()
            if "\t" in line[: len(line) - len(line.lstrip())]:
                raise ConfigError(f"line {self.at + 1}: a tab in the indent")
            if line.strip() and line.strip() not in ("---", "..."):
                return len(line) - len(line.lstrip()), line.strip()
            self.at += 1
        return None


def read_yaml(text: str) -> Any:
    """Plain YAML: maps, lists, lists and maps in brackets, quoted and bare scalars, block texts, remarks. Keys that come twice,
    tabs in the indent, anchors, aliases and tags are errors."""
    lines = _Lines(text)
    first = lines.peek()
    if first is None:
        return None
    value = _block(lines, first[0])
    if lines.peek() is not None:
        raise ConfigError(f"line {lines.at + 1}: the indent fits nothing above")
    return value


def _block(lines: _Lines, indent: int) -> Any:
    _, content = lines.peek()
    if content == "-" or content.startswith("- "):
        return _list(lines, indent)
    if _KEY.match(content):
        return _map(lines, indent)
    lines.at += 1
    return _scalar(content)


def _list(lines: _Lines, indent: int) -> list:
    out = []
    while (nxt := lines.peek()) and nxt[0] == indent and (nxt[1] == "-" or nxt[1].startswith("- ")):
        rest = nxt[1][1:].strip()
        if not rest:
            lines.at += 1
            deeper = lines.peek()
            out.append(_block(lines, deeper[0]) if deeper and deeper[0] > indent else None)
        elif rest.startswith("- ") or _KEY.match(rest):
            inner = indent + len(nxt[1]) - len(rest)
            lines.raw[lines.at] = " " * inner + rest
            out.append(_block(lines, inner))
        else:
            out.append(_value(lines, rest, indent))
    return out


def _map(lines: _Lines, indent: int) -> dict:
    out: dict = {}
    while (nxt := lines.peek()) and nxt[0] == indent and (m := _KEY.match(nxt[1])):
        key = _scalar(m[1])
        if key in out:
            raise ConfigError(f"line {lines.at + 1}: {key!r} comes twice")
        rest = nxt[1][m.end() :].strip()
        if rest:
            out[key] = _value(lines, rest, indent)
            continue
        lines.at += 1
        deeper = lines.peek()
        nested = deeper and (deeper[0] > indent or deeper[0] == indent and (deeper[1] == "-" or deeper[1].startswith("- ")))
        out[key] = _block(lines, deeper[0]) if nested else None
    return out


def _value(lines: _Lines, rest: str, indent: int) -> Any:
    """A scalar behind a key or a dash; a block text takes the deeper lines that follow."""
    lines.at += 1
    m = re.match(r"^([|>])([+-]?)\d*$", rest)
    if not m:
        while rest[:1] in "[{" and rest.count("[") + rest.count("{") > rest.count("]") + rest.count("}") and lines.at < len(lines.raw):
            rest += " " + _uncommented(lines.raw[lines.at]).strip()
            lines.at += 1
        return _scalar(rest)
    held = []
    while lines.at < len(lines.raw) and (not lines.raw[lines.at].strip() or len(lines.raw[lines.at]) - len(lines.raw[lines.at].lstrip()) > indent):
        held.append(lines.raw[lines.at])
        lines.at += 1
    while held and not held[-1].strip():
        held.pop()
    margin = min((len(x) - len(x.lstrip()) for x in held if x.strip()), default=0)
    body = [x[margin:] for x in held]
    text = "\n".join(body) if m[1] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(body))
    return text + ("" if m[2] == "-" else "\n")


def read_policy(text: str) -> dict:
    """A compliance policy: name, guidance, scope mode (annotate or filter) and requirements with their weaknesses and classes."""
    doc = read_yaml(text)
    if not isinstance(doc, dict) or not doc.get("name"):
        raise ConfigError("a policy needs a name")
    mode = doc.get("scope_mode", "annotate")
    if mode not in ("annotate", "filter"):
        raise ConfigError(f"no scope mode: {mode!r}")
    wanted = doc.get("requirements") or []
    seen: set = set()
    out = []
    for r in wanted:
        if not isinstance(r, dict) or not r.get("id") or r["id"] in seen:
            raise ConfigError("a requirement needs an id of its own")
        seen.add(r["id"])
        cwes, classes = [str(c) for c in r.get("cwes") or []], [str(c) for c in r.get("vuln_classes") or []]
        if not cwes and not classes:
            raise ConfigError(f"{r['id']} names no weakness and no class")
        out.append({"id": str(r["id"]), "title": str(r.get("title") or r["id"]), "cwes": cwes, "vuln_classes": classes})
    return {"name": str(doc["name"]), "guidance": str(doc.get("guidance") or ""), "scope_mode": mode, "requirements": out}


def read_rules(text: str, languages: list[str]) -> list[dict]:
    """Call patterns of a rule pack for the languages at hand: one row per rule and pattern, with its kind.

    ``a.b.c(...)`` with a module is qualified, ``$X.m(...)`` a method of any receiver, ``f(...)`` a bare call, ``m.attr`` an attribute.
    """
    out = []
    for rule in (read_yaml(text) or {}).get("rules") or []:
        spoken = set(rule.get("languages") or [])
        if not spoken & set(languages):
            continue
        patterns = [p["pattern"] for p in rule["pattern-either"]] if "pattern-either" in rule else [rule["pattern"]]
        meta = rule.get("metadata") or {}
        for p in patterns:
            called = re.match(r"^\s*(?:\$\w+\.)?([\w.:$]+?)\s*\(", p)
            name = (called[1] if called else p.strip()).rsplit("$", 1)[-1]
            kind = "receiver_method" if re.match(r"^\s*\$\w+\.", p) else "module_attr" if not called else "qualified" if "." in name else "bare_call"
            row = {"rule": str(rule["id"]), "kind": kind, "name": name, "cwe": meta.get("cwe"), "sink_kind": meta.get("sink_kind"), "family": meta.get("semantic_family")}
            out += [{**row, "language": lang} for lang in sorted(spoken & set(languages))]
    return out
