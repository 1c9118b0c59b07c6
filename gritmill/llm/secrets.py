"""Credentials embedded in source code and configuration.

The operator reads excerpts of code lexically: a scanner splits lines into
identifiers, operators, quoted literals (over several lines too) and bare words,
literals that are assigned or passed to a credential-named identifier are judged,
and only the *contents* of a guilty literal are masked, so quotes, indentation,
viewer line numbers and diff marks stay as they were. The mask is one plain word,
which is as good a scalar, URL part or shell word as what it stands for.

An automaton over the whole excerpt first finds the lines that hold any part of a
credential name, of an issued shape or of a header; no rule can say anything about
the others, unless a literal, a key or a block that began above goes on in them.

Defined results
---------------
* null or empty excerpt: no case, and ``redact`` gives it back unchanged;
* a repeated row gives each of its lines once (the output is distinct);
* lines are counted from 1 and end at line feeds only;
* an excerpt of any length is read whole.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritmill.operators.nested import SCORE, _sound, canonical_key, visit, whole_document

MASK = "REDACTED"

# Words that make an identifier a credential name, in the
# languages the texts use.
_CREDENTIAL = (
    r"password|passwd|passwort|kennwort|passphrase|passcode|pass_?word|mot_?de_?passe|contrase(?:n|ñ)a|"
    r"clave_?secreta|senha|пароль|密码|密碼|口令|パスワード|pwd|pword|secret|token|credential|credentials|"
    r"api_?key|apikey|access_?key|account_?key|auth_?key|private_?key|signing_?key|master_?key|hmac_?key|"
    r"encryption_?key|encrypt_?key|crypto_?key|cookie_?key|session_?key|license_?key|shared_?key|secret_?key|"
    r"storage_?key|client_?key|service_?key|deploy_?key|webhook_?key|jwt_?key|app_?key|aes_?key|"
    r"handshake|bearer|authorization|db_?pass|root_?pass|user_?pass|admin_?pass|smtp_?pass|ssh_?pass|"
    r"vault_?pin|pin_?code|otp_?seed|totp_?seed|salt|jwt|x-vault-token|auth"
)
_NAME = re.compile(rf"(?<![a-z])(?:{_CREDENTIAL})(?![a-z])")
_BARE_NAME = re.compile(r"^(?:pass|pin|pw|cred|creds|pwd)$")

# Last words that turn a credential name into a name of
# something public about it.
_ABOUT = frozenset(
    "id ids name names url uri hash hashes digest checksum fingerprint policy length len field fields version ref refs "
    "path paths file files dir ttl expiry expires expire timeout type types provider selector label placeholder prefix "
    "suffix count limit list row rows host port enabled regex pattern format min max age reset column index service "
    "store issuer endpoint algorithm algo kind size rotation hint error message env var alias arn location strength "
    "rounds public pub valid required manager factory page form input model schema table repo test case header".split()
)
_ABOUT_FIRST = frozenset("csrf xsrf min max public pub verify valid is has no show hide forgot reset change next num".split())

# Published shapes of issued credentials.
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_\-]{18,}|"
    r"xox[abeoprs]-[A-Za-z0-9\-]{12,}|[srp]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{33,}|SK[0-9a-f]{32}(?![0-9a-f])|"
    r"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|npm_[A-Za-z0-9]{24,}|dop_v1_[0-9a-f]{32,}|"
    r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"
    r")"
)
_ISSUED_START = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]|gh[pousr]_[A-Za-z0-9]|github_pat_|glpat-|xox[abeoprs]-|[srp]k_(?:live|test)_|AIza[A-Za-z0-9]|SG\.[A-Za-z0-9]|npm_[A-Za-z0-9]|dop_v1_")
_URL = re.compile(r"[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s\"'`<>:/@]*:([^\s\"'`<>@/]+)@")
_DSN = re.compile(
    r"(?i)(?<![a-z0-9_])(?:password|passwd|pwd|accountkey|sharedaccesskey|sharedaccesssignature|access_token|auth_token|"
    r"api_?key|token|secret|client_secret|sig|key|signature)=([^\s;&\"'`<>,)]+)"
)
_SCHEME = re.compile(r"(?i)\b(basic|bearer|token|apikey|digest)\s+([A-Za-z0-9+/=_\-.~!@#$%^&*?]{6,})")
_COOKIE = re.compile(r"(?i)\b(?:session|sid|sessionid|auth|jwt|token|jsessionid|phpsessid)=([A-Za-z0-9+/=_\-.%!@#$^*?]{8,})")
_HEADER = re.compile(r"(?i)(?<![\w-])(authorization|proxy-authorization|cookie|set-cookie|x-api-key|api-key|private-token|x-auth-token|"
                     r"x-vault-token|x-access-token)(?![\w-])")
_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PREFIX = re.compile(r"^(?:[ \t]*\d+[ \t]*[|:│][ \t]?|[+\-](?![+\-]{2}) ?)?")

# Values without any content of their own, or that refer to another place.
_BLANK = re.compile(r"(?i)^(?:x+|[*.\-_#?0•]*|<.*>|\[.*\]|\{.*\}|\$.*|%.*%|@[\w.:]+@?|env:.*|vault:.*|ref[:+].*|!.*)$")
# Words of which placeholders are made; a value of nothing else is one.
_PLACEHOLDER_WORDS = frozenset(
    "a access add an api apikey app auth basic bearer blank bool change changeme changeit client credential credentials db config default dummy empty "
    "enter env environment example examples fake false fill fixme foo from generate generated get goes bar baz here hidden hunter id in insert int is it "
    "key keys masked me must my n name nil none not null of optional or os pass passphrase password passwd pin place placeholder private put pwd redacted "
    "ref removed replace replaceme request required sample secret secrets self service set settings some something str string tbd test text that the this "
    "to todo token tokens true undefined unset use user username value variable vault with x xx xxx your yours".split()
)
_COMMON_NUMBERS = frozenset(("", "1", "12", "123", "1234"))
_MASKED = re.compile(r"(?i)x{6,}|\*{4,}|•{3,}|\.{4,}|redacted")
_SAMPLE = re.compile(r"(?i)x{6,}|\*{4,}|example|placeholder|dummy|redacted")
_TEMPLATE = re.compile(r"^(?:\$\{?[A-Za-z_]|\{\{|%[A-Za-z_(]|<[%?a-zA-Z]|#\{|\$\(|@\{|!\w)")
_VERSION = re.compile(r"^[~^v]?\d+(?:\.\d+)*$")
_WORD = re.compile(r"^[A-Za-z_]+$")

# One lexical token: a quoted literal, an identifier, an operator or a bare word.
_LEX = re.compile(
    r"(?P<str>(?P<q>\"\"\"|'''|\"(?!\"\")|'(?!'')|`)(?P<body>(?:\\.|(?!(?P=q))[^\n])*)(?P=q))"
    r"|(?P<open>(?P<oq>\"\"\"|'''|[\"'`])(?P<obody>[^\n]*))"
    r"|(?P<id>[^\W\d][\w]*(?:[.\-][^\W\d][\w]*)*)"
    r"|(?P<op>\|\||\?\?|:=|=>|==|!=|<=|>=|->|::|[=:(){}\[\],;+.&|?<>@!*/%\\$~^\-#])"
    r"|(?P<num>\d[\w.]*)"
    r"|(?P<other>\S)"
)


def _words(name: str) -> list[str]:
    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return [w for w in re.split(r"[\W_\d]+", parts.lower()) if w]


def credential_name(name: str) -> bool:
    """Whether an identifier names a credential itself, not a fact about one."""
    words = _words(name)
    if not words or words[-1] in _ABOUT or words[0] in _ABOUT_FIRST:
        return False
    joined = "_".join(words)
    return bool(_NAME.search(joined)) or bool(_BARE_NAME.match(words[-1])) or bool(
        re.search(r"(?:password|passwd|secret|token|apikey|credential)s?$", joined)
    )


def _encoded_secret(value: str) -> bool:
    try:
        return len(base64.b64decode(value, validate=True)) >= 6
    except (binascii.Error, ValueError):
        return False


def placeholder(value: str) -> bool:
    """Whether a whole value stands for one that is to come, or for one kept elsewhere."""
    if _BLANK.match(value):
        return True
    letters = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
    words = [w for w in re.split(r"[^a-z]+", letters.lower()) if w]
    return bool(words) and all(w in _PLACEHOLDER_WORDS for w in words) and re.sub(r"\D", "", value) in _COMMON_NUMBERS


# Names whose values are digits only, or several words.
_PIN_NAME = re.compile(r"(?:^|_)(?:pin|passcode|otp|pin_?code)$")
_PHRASE_NAME = re.compile(r"(?:^|_)(?:passphrase|pass_phrase|mnemonic|seed_phrase)$")


def usable_literal(value: str, name: str = "") -> bool:
    """Whether a literal given to a credential name would grant access."""
    value = value.strip()
    if name and (value.isdigit() or " " in value):
        joined = "_".join(_words(name))
        if value.isdigit() and len(value) >= 4 and _PIN_NAME.search(joined):
            return len(set(value)) > 1
        if " " in value and _PHRASE_NAME.search(joined):
            return len(value.split()) >= 3 and not placeholder(value) and not _TEMPLATE.search(value) and value[-1:] not in ".?:"
    if len(value) < 5 or placeholder(value) or _MASKED.search(value) or _TEMPLATE.match(value) or _VERSION.match(value):
        return False
    if _ISSUED_START.match(value):  # also the first part of one that is put together
        return True
    if "${" in value or "{{" in value or "#{" in value or " " in value and not value.startswith("-----"):
        return False
    if re.match(r"^[a-z]+://", value) or re.match(r"^[\w.\-]+(?:/[\w.\-]+){1,}$", value) and not re.search(r"\d{2}|[A-Z]{2}|\+", value):
        return False
    if value.count(",") >= 2 or re.match(r"^[\w.]+\(.*\)?$", value):
        return False
    if not name and _WORD.match(value) and not re.search(r"[a-z][A-Z]{2}|[A-Z]{2}[a-z]", value):
        return False  # a word alone grants access only if it is the quoted value of a name
    if re.match(r"^[A-Za-z_][\w.]*\[", value):
        return False
    if "." in value and re.match(r"^[a-z_]+(?:\.[a-z_]+)+$", value):
        return False
    if "_" in value and _WORD.match(value) and (value.isupper() or value.islower()):
        return False
    return not credential_name(value) or bool(re.search(r"\d", value))


def _issued_ok(value: str) -> bool:
    body = re.sub(r"^[A-Za-z]+[_\-.]", "", value)
    return not _SAMPLE.search(value) and len(set(body)) >= 6


def _lines(text: str) -> Iterator[tuple[int, int]]:
    start = 0
    while True:
        end = text.find("\n", start)
        if end < 0:
            yield start, len(text)
            return
        yield start, end
        start = end + 1


def _in_text(text: str, base: int, out: list[tuple[int, int]]) -> None:
    """Credentials that carry their own mark, wherever they stand."""
    for m in _ISSUED.finditer(text):
        if _issued_ok(m[0]):
            out.append((base + m.start(), base + m.end()))
    if "://" in text:
        for m in _URL.finditer(text):
            if _password(m[1]):
                out.append((base + m.start(1), base + m.end(1)))
    if "=" in text:
        for m in _DSN.finditer(text):
            if _in_connection(text, m) and _password(m[1]):
                out.append((base + m.start(1), base + m.end(1)))


def _password(value: str) -> bool:
    return len(value) >= 4 and not (
        placeholder(value) or _MASKED.search(value) or _TEMPLATE.match(value) or "${" in value or "{{" in value or "(" in value
    )


def _in_connection(text: str, m: re.Match) -> bool:
    """A key=value pair counts inside a connection string or a query string."""
    before, after = text[: m.start()], text[m.end() :]
    if before[-1:] in "?&":
        return "://" in before or before[-1:] == "&"
    return bool(re.search(r"[\w ]=[^;=]+;\s*$", before) or re.search(r"(?:^|[\s\"'`])\w+=\S+\s$", before)) and bool(
        re.search(r"(?i)(?:server|host|database|user id|uid|user|endpoint|accountname|dbname|data source|sharedaccesskeyname)=", before + after)
    )


def _headers(line: str, base: int, out: list[tuple[int, int]]) -> None:
    m = _HEADER.search(line)
    if not m:
        if "-u " in line or "--user" in line:
            for u in re.finditer(r"(?:-u|--user)[ =][\"']?[\w.\-]+:([^\s\"']+)", line):
                if _password(u[1]):
                    out.append((base + u.start(1), base + u.end(1)))
        return
    rest, at = line[m.end() :], m.end()
    kind = m[1].lower()
    if "cookie" in kind:
        for c in _COOKIE.finditer(rest):
            if usable_literal(c[1]):
                out.append((base + at + c.start(1), base + at + c.end(1)))
        return
    found = False
    for s in _SCHEME.finditer(rest):
        value = s[2].rstrip(".")
        if s[1].lower() == "basic" and not _encoded_secret(value):
            continue
        if usable_literal(value):
            out.append((base + at + s.start(2), base + at + s.start(2) + len(value)))
            found = True
    if not found and "auth" not in kind.replace("x-auth", "x-"):
        v = re.match(r"[\"']?\]?\s*(?:[:=,]|=>)\s*[\"'`]?([A-Za-z0-9+/=_\-.]{8,})", rest)
        if v and usable_literal(v[1]) and re.search(r"\d", v[1]):
            out.append((base + at + v.start(1), base + at + v.end(1)))


class _Token:
    __slots__ = ("kind", "text", "start", "end", "body", "open")

    def __init__(self, kind: str, text: str, start: int, end: int, body: tuple[int, int] | None, open: str = ""):  # noqa: A002
        self.kind, self.text, self.start, self.end, self.body, self.open = kind, text, start, end, body, open


def _tokens(line: str, base: int) -> list[_Token]:
    found = []
    for m in _LEX.finditer(line):
        kind = m.lastgroup
        if m["str"] is not None:
            found.append(_Token("str", m["body"], base + m.start(), base + m.end(), (base + m.start("body"), base + m.end("body"))))
        elif m["open"] is not None:
            found.append(_Token("str", m["obody"], base + m.start(), base + m.end(), (base + m.start("obody"), base + m.end("obody")), m["oq"]))
        elif m["id"] is not None:
            found.append(_Token("id", m["id"], base + m.start(), base + m.end(), None))
        elif m["op"] is not None:
            found.append(_Token("op", m["op"], base + m.start(), base + m.end(), None))
        else:
            found.append(_Token(kind or "other", m[0], base + m.start(), base + m.end(), None))
    return found


_ASSIGN = {"=", ":", ":=", "=>"}
_DECODERS = re.compile(r"(?i)(?:b64|base64|atob|decode|unhex|fromhex|getdecoder)")
_BARE_VALUE = re.compile(
    r"^\s*(?:export\s+|set\s+|ENV\s+|ARG\s+|-\s+|--|\$env:)?[\"']?([\w.\-]+)[\"']?\s*(?:=|:\s|:$)\s*([^\s\"'`#<>(){}\[\],;]\S*)\s*(?:#.*|//.*)?[\"'`)}\]>;,]*\s*$"
)
_FLAG = re.compile(r"--?([A-Za-z][\w\-]*)[ =]([^\s\"'`]+)")
_XML = re.compile(r"<([\w.:\-]+)[^>]*>([^<>]+)</\1>")
_XML_ATTR = re.compile(r"(?i)(?:key|name)=[\"']([^\"']+)[\"'][^>]*?value=[\"']([^\"']+)[\"']")


def _assigned(line: str, base: int, toks: list[_Token], out: list[tuple[int, int]]) -> tuple[_Token | None, _Token | None, str]:
    """Literals assigned or passed to credential names; the last one, and one that goes on in the next line with its name, are returned."""
    last = goes_on = None
    named = ""
    for i, t in enumerate(toks):
        name = t.text if t.kind == "id" else t.text if t.kind == "str" and re.match(r"^[\w.\-]+$", t.text) else ""
        if not name or not credential_name(name):
            continue
        j, steps = i + 1, 0
        while j < len(toks) and toks[j].kind == "op" and toks[j].text in "])" and steps < 3:
            j, steps = j + 1, steps + 1
        # a type between name and value: name: str = "x", name string = "x"
        if j + 1 < len(toks) and toks[j].kind == "op" and toks[j].text == ":" and toks[j + 1].kind == "id" and j + 2 < len(toks) and toks[j + 2].text == "=":
            j += 2
        elif j + 1 < len(toks) and toks[j].kind == "id" and toks[j].text in ("string", "String", "str") and toks[j + 1].text == "=":
            j += 1
        if j >= len(toks):
            continue
        # Go's second result, a C# accessor list, Ruby's ||=
        if j + 2 < len(toks) and toks[j].text == "," and toks[j + 1].kind == "id" and toks[j + 2].text == ":=":
            j += 2
        elif toks[j].text == "{" and (m := re.match(r"\{\s*get;[^}]*\}\s*", line[toks[j].start - base :])):
            at = toks[j].start + m.end()
            j = next((x for x in range(j, len(toks)) if toks[x].start >= at), j)
        elif j + 1 < len(toks) and toks[j].text in ("||", "??", "+", "&") and toks[j + 1].text == "=":
            j += 1
        op = toks[j]
        passed = op.kind == "op" and (op.text == "," and t.kind == "str" or op.text == "(" and t.kind == "id")
        if not (op.kind == "op" and (op.text in _ASSIGN or passed)):
            continue
        depth = 0
        for k in range(j + 1, len(toks)):
            v = toks[k]
            if v.kind == "op":
                if v.text in "([{":
                    depth += 1
                elif v.text in ")]}":
                    depth -= 1
                    if depth < 0:
                        break
                elif v.text in (";",) or v.text == "," and depth <= 0 and not passed:
                    break
                elif v.text in ("=", ":=", "=>") and depth <= 0:
                    break
                continue
            if v.kind == "str":
                expr = line[toks[j].end - base : v.start - base]
                if v.open in ('"""', "'''", "`") and k == len(toks) - 1:
                    goes_on, named = v, name
                elif _usable_in(expr, v, passed, name):
                    out.append(v.body)
                    last = v
                    continue
                if passed and op.text == "(":
                    continue
    return last, goes_on, named


# Names whose values people choose, plain words among them.
_CHOSEN_NAME = re.compile(r"(?i)pass|pwd|pw$|secret|kennwort|senha|contrase|парол|密码|密碼|口令|パスワード|pin$|phrase|mnemonic")


def _usable_in(expr: str, v: _Token, passed: bool, name: str) -> bool:
    value = v.text
    name = name if _CHOSEN_NAME.search(name) else ""
    if _DECODERS.search(expr):
        return _encoded_secret(value) or usable_literal(value)
    e = expr.strip()
    if e in ("", "(", "f", "b", "r", "u", "@", "new String(", "str(", "String(", "[]byte(", "[]rune(") or re.search(r"(?:\|\||\?\?|\bor|:)\s*\(?$", e) or e.endswith("+") or e.endswith("."):
        return usable_literal(value, name)
    if re.search(r"(?i)(?:getenv|environ\.get|get_?or|fetch|default|lookup|config|get)\b[^)]*,\s*$", e):
        return usable_literal(value)
    if re.search(r"(?i)\b(?:setpassword|setsecret|new\s+\w*(?:credential|secret|password|key)\w*|secretstring|bytes|encode|buffer\.from|hash|hmac)\W*\($", e):
        return usable_literal(value)
    if passed and re.match(r"^\(?[^()]*,?\s*$", e):
        return usable_literal(value) and bool(re.search(r"\d", value))
    return False


_DEFAULT = re.compile(r"\$\{([\w.\-]+?):-?([^{}$]+)\}")
_PAIR = re.compile(r"(?i)\bname[\"']?\s*[:=]\s*[\"']?([\w.\-]+)[\"']?\s*,\s*[\"']?value[\"']?\s*[:=]\s*[\"']?([^\s\"',}]+)")
_XML_VALUE = re.compile(r"<value>([^<>\s]+)</value>")
_XML_NAME = re.compile(r"(?i)<\w+\s[^>]*\b(?:name|key)=[\"']([\w.\-]+)[\"'][^>]*(?<!/)>\s*$")
_PAIR_NAME = re.compile(r"(?i)^\s*-?\s*[\"']?(?:name|key)[\"']?\s*[:=]\s*[\"']?([\w.\-]+)[\"']?,?\s*$")
_PAIR_VALUE = re.compile(r"(?i)^\s*[\"']?value[\"']?\s*[:=]\s*[\"']?([^\s\"',}]+)[\"']?,?\s*$")
_ENV = re.compile(r"^\s*(?:ENV|ARG)\s+([\w.\-]+)\s+(\S+)\s*$")
_PIPED = re.compile(r"echo\s+(?:-n\s+)?[\"']?([^\s\"']+)[\"']?\s*\|.*--?([\w\-]+?)-stdin")
_SHORT_P = re.compile(r"\b(?:mysql|mysqldump|mysqladmin|mariadb|sshpass|docker login|az login|podman login|helm registry login)\b.*?\s-p\s?[\"']?([^\s\"']+)")
_COMMENT = re.compile(r"(?:^|\s)(?:#|//|--|/\*|<!--|;|%)\s*(.*)$")
# How people write a credential into a remark.
_REMARK = re.compile(
    r"(?i)\b(?:passwords?|passwort|kennwort|senha|contrase(?:n|ñ)a|mot de passe|pw|pwd|pass|secret|token|api key|key|login|creds?|credentials?|rotate|pin)\b"
    r"[^\n]*?(?:\b(?:was|is|ist|token|to)\s+|[:=/]\s*)([^\s\"'`(),;]{5,})"
)
# The shapes of words with digits or marks that people choose.
_CHOSEN = re.compile(r"^(?=.*\d)(?:[A-Za-z]+(?:-[a-z]+)+-\d+|[A-Za-z]+[!?@#$%&*^_][\w!?]{1,}|[A-Za-z]+\d{2,}[A-Za-z]*[!?#%*&@$]?|\w*[a-z]\d[a-z]\w*[!?_#%-]?\d*|[\w+/=\-.!?@#$%&*]{12,})$")


def _remarks(line: str, base: int, out: list[tuple[int, int]]) -> None:
    m = _COMMENT.search(line)
    if not m:
        return
    body, at = m[1], m.start(1)
    for r in _REMARK.finditer(body):
        value = r[1].rstrip(".,")
        if usable_literal(value) and _CHOSEN.match(value) and "." not in value.strip(".") and "/" not in value[:-1].rstrip("="):
            out.append((base + at + r.start(1), base + at + r.start(1) + len(value)))
    use = re.search(r"(?i)\b(?:token|password|secret|key)\s+([^\s\"'`(),;]{6,})\s+(?:until|for|instead|on)\b", body)
    if use and usable_literal(use[1]) and _CHOSEN.match(use[1]):
        out.append((base + at + use.start(1), base + at + use.end(1)))
    # a remark that names the credential beside an unnamed literal
    name = body.strip().rstrip("*/->").strip()
    if re.match(r"^[\w.\-]+$", name) and credential_name(name):
        for t in _tokens(line[: m.start()], base):
            if t.kind == "str" and usable_literal(t.text) and re.search(r"\d", t.text):
                out.append(t.body)


def _pairs(line: str, base: int, name: str, out: list[tuple[int, int]]) -> None:
    for m in _DEFAULT.finditer(line):
        if credential_name(m[1]) and usable_literal(m[2]):
            out.append((base + m.start(2), base + m.end(2)))
    for m in _PAIR.finditer(line):
        if credential_name(m[1]) and usable_literal(m[2]):
            out.append((base + m.start(2), base + m.end(2)))
    m = name and (_PAIR_VALUE.match(line) or _XML_VALUE.search(line))
    if m and credential_name(name) and usable_literal(m[1]):
        out.append((base + m.start(1), base + m.end(1)))
    m = _ENV.match(line)
    if m and credential_name(m[1]) and usable_literal(m[2]):
        out.append((base + m.start(2), base + m.end(2)))
    m = _PIPED.search(line)
    if m and credential_name(m[2]) and usable_literal(m[1]):
        out.append((base + m.start(1), base + m.end(1)))
    m = _SHORT_P.search(line)
    if m and usable_literal(m[1]):
        out.append((base + m.start(1), base + m.end(1)))


_CONT = re.compile(r"(?:\+|\.|\\|&|\.\.|<<|~)\s*$")


# Parts that every credential name, issued shape, header, flag and remark has one of, in lower case.
_TELLING = (
    "pass kennwort contrase clave senha парол 密码 密碼 口令 パスワード pw secret token cred key handshake bearer auth pin otp salt jwt vault login rotate "
    "cookie session sid sig= mnemonic phrase -u --user @ begin akia asia ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- xox sk_ pk_ rk_ aiza sg. npm_ dop_v1_ eyj "
    "sk0 sk1 sk2 sk3 sk4 sk5 sk6 sk7 sk8 sk9 ska skb skc skd ske skf"
).split() + [" -p", " -p "]


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for part in _TELLING:
        a.add_word(part, len(part))
    a.make_automaton()
    return a


_PARTS = _automaton()


def _telling_ends(text: str) -> list[int] | None:
    """Places of telling parts, ascending; None if lower case has other places."""
    low = text.lower()
    if len(low) != len(text):
        return None
    return [end for end, _ in _PARTS.iter(low)]


def _literal_lines(text: str, lines: list[tuple[int, int]], n: int, first: _Token, name: str) -> tuple[int, list[tuple[int, int]]]:
    """The spans of a literal that begins at the end of line n and goes on, and the number of the line it ends in; none if it isn't usable."""
    quote, spans, at = first.open, [first.body] if first.text.strip() else [], n + 1
    while at < len(lines):
        a, b = lines[at]
        a += _PREFIX.match(text[a:b]).end()
        end = text.find(quote, a, b)
        stop = b if end < 0 else end
        held = text[a:stop]
        if held.strip():
            lead = len(held) - len(held.lstrip())
            spans.append((a + lead, a + len(held.rstrip())))
        if end >= 0:
            words = [text[x:y].strip() for x, y in spans]
            usable = words and (all(re.match(r"^\S{4,}$", w) for w in words) and usable_literal("".join(words)) or usable_literal(" ".join(words), name))
            return (at, spans) if usable else (n, [])
        at += 1
    return n, []


def find_secrets(text: str | None) -> list[tuple[int, int]]:
    """Character spans of literal secrets in an excerpt, in order, without overlap."""
    if not text:
        return []
    ends = _telling_ends(text)
    if ends == []:
        return []
    out: list[tuple[int, int]] = []
    lines = list(_lines(text))
    inside = cont = wrapped = False
    pair_name, pair_indent = "", 0
    block_indent = -1
    literal_end, told = -1, 0
    for n, (a, b) in enumerate(lines):
        if ends is not None:
            while told < len(ends) and ends[told] < a:
                told += 1
            telling = told < len(ends) and ends[told] < b
            if not (telling or inside or cont or pair_name or block_indent >= 0):
                continue
        if n <= literal_end:
            continue
        raw = text[a:b]
        skip = _PREFIX.match(raw).end()
        line, base = raw[skip:], a + skip
        if inside:
            out.append((base, b))
            if _END.search(line):
                inside = False
            continue
        m = _BEGIN.search(line)
        if m:
            e = _END.search(line, m.end())
            out.append((base + m.start(), base + e.end() if e else b))
            inside = e is None
            continue
        if block_indent >= 0:
            indent = len(line) - len(line.lstrip())
            value = line.strip()
            if value and indent > block_indent and re.match(r"^\S{6,}$", value) and (_encoded_secret(value) or usable_literal(value)):
                s = base + line.index(value)
                out.append((s, s + len(value)))
                continue
            block_indent = -1
        if not line.strip():
            continue
        named = _PAIR_NAME.match(line) or _XML_NAME.search(line)
        indent = len(line) - len(line.lstrip())
        if named:
            pair_name, pair_indent = named[1], indent
        elif pair_name and indent < pair_indent and not line.lstrip().startswith(("#", "//", "--", "<!--")):
            pair_name = ""  # the object that was named has ended
        found: list[tuple[int, int]] = []
        toks = _tokens(line, base)
        if cont:
            first = next((t for t in toks if not (t.kind == "op" and t.text in "+.&\\")), None)
            if first and first.kind == "str" and len(first.text) >= 2:
                found.append(first.body)
            elif first and re.match(r"^\s*[A-Za-z0-9+/=_\-.]{4,}[\"'`)};,]*\s*\\?$", line):
                v = re.search(r"[A-Za-z0-9+/=_\-.]{4,}", line)
                found.append((base + v.start(), base + v.end()))
            else:
                cont = False
            if found:
                cont = bool(_CONT.search(line)) or wrapped and toks[-1].kind == "str"
                out += found
                continue
        _in_text(line, base, found)
        _headers(line, base, found)
        last, goes_on, name = _assigned(line, base, toks, found)
        if goes_on:
            literal_end, spans = _literal_lines(text, lines, n, goes_on, name if _CHOSEN_NAME.search(name) else "")
            found += spans
        _pairs(line, base, "" if named else pair_name, found)
        if "#" in line or "//" in line or "--" in line or "/*" in line or ";" in line:
            _remarks(line, base, found)
        bare = _BARE_VALUE.match(line)
        if bare and credential_name(bare[1]) and not re.match(r"^[A-Za-z_][\w.]*\(", bare[2]):
            value = bare[2].rstrip("\"'`)}];,>").rstrip("\\")
            if usable_literal(value) and (re.search(r"\d", value) or re.search(r"[^\w.\-]", value)):
                found.append((base + bare.start(2), base + bare.start(2) + len(value)))
        for f in _FLAG.finditer(line):
            value = f[2].rstrip("\\,;)")
            if credential_name(f[1]) and usable_literal(value) and re.search(r"\d", value):
                found.append((base + f.start(2), base + f.start(2) + len(value)))
        if "<" in line:
            for x in _XML.finditer(line):
                if credential_name(x[1]) and usable_literal(x[2]):
                    found.append((base + x.start(2), base + x.end(2)))
            for x in _XML_ATTR.finditer(line):
                if credential_name(x[1]) and usable_literal(x[2]):
                    found.append((base + x.start(2), base + x.end(2)))
        block = re.match(r"^(\s*)[\"']?([\w.\-]+)[\"']?\s*:\s*[|>][+\-]?\d*\s*$", line)
        if block and credential_name(block[2]):
            block_indent = len(block[1])
        if found:
            out += found
            end = line.rstrip()
            wrapped = last is not None and toks[-1] is last and "(" in line and line.count("(") > line.count(")")
            cont = (wrapped or bool(_CONT.search(end))) and (last is not None or any(b2 >= base + len(end) - 4 for _, b2 in found))
    return _merged(out)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for s, e in sorted(x for x in spans if x[1] > x[0]):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged


def secret_lines(text: str | None) -> list[int]:
    """Numbers of the lines that hold any part of a secret."""
    spans = find_secrets(text)
    if not spans:
        return []
    at, found, n = 0, set(), 1
    for s, e in spans:
        n += text.count("\n", at, s)
        at = s
        found.update(range(n, n + 1 + text.count("\n", s, e)))
    return sorted(found)


def redact(text: str | None, mask: str = MASK) -> str | None:
    """The excerpt with the contents of every secret masked, line by line."""
    if not text:
        return text
    parts, at = [], 0
    for s, e in find_secrets(text):
        parts += [text[at:s], "\n".join(mask if x.strip() else x for x in text[s:e].split("\n"))]
        at = e
    return "".join([*parts, text[at:]])


CASE = "snippet_kind string, record_id bigint, score_pos int, item_pos int, evidence_pos int, line_no int"
_CASE = pa.schema(
    [("snippet_kind", pa.string()), ("record_id", pa.int64()), *((n, pa.int32()) for n in ("score_pos", "item_pos", "evidence_pos", "line_no"))]
)


MASKED_ROW = "snippet_kind string, record_id bigint, score_pos int, item_pos int, evidence_pos int, snippet string"
_MASKED_ROW = pa.schema([*list(_CASE)[:-1], ("snippet", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema = _CASE) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(_sound(list(c)), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _excerpts(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield _batch([(kind, i, -1, -1, -1, n) for i, t in zip(ids, texts, strict=True) for n in secret_lines(t)])

    return run


def _held(b: pa.RecordBatch) -> Iterator[tuple]:
    """Record, position path and snippet of every piece of evidence of a batch of payloads."""
    for rid, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
        for tag, path, _, _, own in visit(whole_document(payload), (SCORE,)):
            if tag == "evidence":
                yield rid, path, next((v for k, v in own.items() if canonical_key(k) == "snippet" and isinstance(v, str)), None)


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _batch([("evidence", rid, *path, n) for rid, path, snippet in _held(b) for n in secret_lines(snippet)])


def _masked_excerpts(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield _batch([(kind, i, -1, -1, -1, redact(t)) for i, t in zip(ids, texts, strict=True)], _MASKED_ROW)

    return run


def _masked_evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _batch([("evidence", rid, *path, redact(snippet)) for rid, path, snippet in _held(b)], _MASKED_ROW)


def secret_cases(validation: DataFrame, sinks: DataFrame, cited: DataFrame) -> DataFrame:
    """Each line of each excerpt that holds a secret, once. Only the ids and the excerpts are read; nothing but cases is shuffled."""
    found = validation.select("record_id", F.col("payload")).mapInArrow(_evidence, CASE)
    for df, key, kind in ((sinks, "sink_id", "sink"), (cited, "op_id", "cited_operation")):
        found = found.unionByName(df.select(F.col(key).cast("bigint"), "snippet").where(F.col("snippet") != "").mapInArrow(_excerpts(kind), CASE))
    return found.distinct()


def redacted_excerpts(validation: DataFrame, sinks: DataFrame, cited: DataFrame) -> DataFrame:
    """Every excerpt of all three kinds with its secrets masked, once; keyed as ``secret_cases``. Null and empty ones stay as they are."""
    found = validation.select("record_id", F.col("payload")).mapInArrow(_masked_evidence, MASKED_ROW)
    for df, key, kind in ((sinks, "sink_id", "sink"), (cited, "op_id", "cited_operation")):
        found = found.unionByName(df.select(F.col(key).cast("bigint"), "snippet").mapInArrow(_masked_excerpts(kind), MASKED_ROW))
    return found.distinct()


def redacted(df: DataFrame, column: str) -> DataFrame:
    """The frame with the secrets of one text column masked."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(redact, na_action="ignore")

    return df.withColumn(column, mask(F.col(column)))
