"""Rules over paths, weaknesses, names and texts as expressions, each with its fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gritmill.functions import text as X

# Names, endings and folders that the pass over left files skips.
SKIP_NAMES = (
    "license changelog changes authors contributors notice readme codeowners .gitignore .gitattributes .editorconfig .prettierrc .prettierignore .eslintignore "
    ".dockerignore package-lock.json yarn.lock pnpm-lock.yaml poetry.lock pipfile.lock go.sum cargo.lock composer.lock"
).split()
SKIP_ENDINGS = (
    ".md .mdx .txt .rst .adoc .png .jpg .jpeg .gif .svg .ico .webp .woff .woff2 .ttf .eot .css .scss .sass .less .lock .log .map .min.js .min.css .snap .d.ts "
    ".csv .tsv .xls .xlsx .po .pot .mo"
).split()
SKIP_FOLDERS = "__snapshots__ __fixtures__ fixtures __mocks__ mocks docs doc examples example samples".split()
# Paths of infrastructure code, by file name, ending and folder.
IAC = (
    r"(?i)(?:^|/)(?:Dockerfile|Containerfile|Jenkinsfile)(?:\.[\w.-]+)?$"
    r"|(?:^|/)(?:docker-compose(?:[\w.-]*)?|Chart|kustomization|\.gitlab-ci|cloudbuild|azure-pipelines|buildspec|appspec|serverless)\.ya?ml$"
    r"|\.(?:tf|tfvars|hcl|bicep)$|(?:^|/)\.github/workflows/[^/]+\.ya?ml$"
    r"|(?:^|/)(?:k8s|kubernetes|helm|charts?|manifests?|deploy(?:ments?)?|cloudformation|cfn)/.+\.(?:ya?ml|tpl|json)$"
    r"|(?:^|/)(?:ansible|playbooks?|roles|group_vars|host_vars)/.+\.ya?ml$"
)
# Configuration that counts as source.
CONFIG_NAMES = (
    "web.xml struts.xml struts-config.xml applicationcontext.xml spring-security.xml beans.xml faces-config.xml shiro.ini security.xml ejb-jar.xml jboss-web.xml "
    "weblogic.xml androidmanifest.xml info.plist"
).split()
CONFIG_ENDINGS = (".xml", ".properties")
CONFIG_FOLDERS = "web-inf meta-inf resources conf config".split()
# Threat letters by the kind of an entry point.
STRIDE = {"network": "S T R I D E", "framework": "S T R I D E", "ipc": "T I E", "file": "T I D", "cli": "T E", "deserialization": "T E"}
STRIDE_ELSE = "T I"
# Size bands by lines of code, below the number.
SIZES = [(2000, "small"), (8000, "medium")]
SIZE_ELSE = "large"
# Weakness -> its public name.
CWE_NAMES = {
    20: "Improper Input Validation",
    22: "Improper Limitation of a Pathname to a Restricted Directory (Path Traversal)",
    73: "External Control of File Name or Path",
    74: "Improper Neutralization of Special Elements in Output (Injection)",
    77: "Improper Neutralization of Special Elements used in a Command (Command Injection)",
    78: "Improper Neutralization of Special Elements used in an OS Command (OS Command Injection)",
    79: "Improper Neutralization of Input During Web Page Generation (Cross-site Scripting)",
    89: "Improper Neutralization of Special Elements used in an SQL Command (SQL Injection)",
    90: "Improper Neutralization of Special Elements used in an LDAP Query (LDAP Injection)",
    94: "Improper Control of Generation of Code (Code Injection)",
    95: "Improper Neutralization of Directives in Dynamically Evaluated Code (Eval Injection)",
    119: "Improper Restriction of Operations within the Bounds of a Memory Buffer",
    120: "Buffer Copy without Checking Size of Input (Classic Buffer Overflow)",
    121: "Stack-based Buffer Overflow",
    122: "Heap-based Buffer Overflow",
    125: "Out-of-bounds Read",
    134: "Use of Externally-Controlled Format String",
    190: "Integer Overflow or Wraparound",
    200: "Exposure of Sensitive Information to an Unauthorized Actor",
    209: "Generation of Error Message Containing Sensitive Information",
    269: "Improper Privilege Management",
    276: "Incorrect Default Permissions",
    284: "Improper Access Control",
    285: "Improper Authorization",
    287: "Improper Authentication",
    294: "Authentication Bypass by Capture-replay",
    295: "Improper Certificate Validation",
    306: "Missing Authentication for Critical Function",
    311: "Missing Encryption of Sensitive Data",
    312: "Cleartext Storage of Sensitive Information",
    319: "Cleartext Transmission of Sensitive Information",
    326: "Inadequate Encryption Strength",
    327: "Use of a Broken or Risky Cryptographic Algorithm",
    330: "Use of Insufficiently Random Values",
    345: "Insufficient Verification of Data Authenticity",
    347: "Improper Verification of Cryptographic Signature",
    352: "Cross-Site Request Forgery (CSRF)",
    362: "Concurrent Execution using Shared Resource with Improper Synchronization (Race Condition)",
    367: "Time-of-check Time-of-use (TOCTOU) Race Condition",
    384: "Session Fixation",
    400: "Uncontrolled Resource Consumption",
    416: "Use After Free",
    426: "Untrusted Search Path",
    434: "Unrestricted Upload of File with Dangerous Type",
    444: "Inconsistent Interpretation of HTTP Requests (HTTP Request Smuggling)",
    476: "NULL Pointer Dereference",
    489: "Active Debug Code",
    502: "Deserialization of Untrusted Data",
    522: "Insufficiently Protected Credentials",
    532: "Insertion of Sensitive Information into Log File",
    552: "Files or Directories Accessible to External Parties",
    601: "URL Redirection to Untrusted Site (Open Redirect)",
    611: "Improper Restriction of XML External Entity Reference",
    639: "Authorization Bypass Through User-Controlled Key",
    640: "Weak Password Recovery Mechanism for Forgotten Password",
    643: "Improper Neutralization of Data within XPath Expressions (XPath Injection)",
    668: "Exposure of Resource to Wrong Sphere",
    693: "Protection Mechanism Failure",
    732: "Incorrect Permission Assignment for Critical Resource",
    770: "Allocation of Resources Without Limits or Throttling",
    787: "Out-of-bounds Write",
    798: "Use of Hard-coded Credentials",
    829: "Inclusion of Functionality from Untrusted Control Sphere",
    840: "Business Logic Errors",
    841: "Improper Enforcement of Behavioral Workflow",
    843: "Access of Resource Using Incompatible Type (Type Confusion)",
    862: "Missing Authorization",
    863: "Incorrect Authorization",
    915: "Improperly Controlled Modification of Dynamically-Determined Object Attributes",
    918: "Server-Side Request Forgery (SSRF)",
    923: "Improper Restriction of Communication Channel to Intended Endpoints",
    1021: "Improper Restriction of Rendered UI Layers or Frames",
    1104: "Use of Unmaintained Third Party Components",
    1188: "Initialization of a Resource with an Insecure Default",
    1236: "Improper Neutralization of Formula Elements in a CSV File",
    1333: "Inefficient Regular Expression Complexity",
    1390: "Weak Authentication",
}
# Class of vulnerability -> the weakness that stands for it.
CWE_OF_CLASS = {
    "use-after-free": 416, "heap-overflow": 122, "stack-overflow": 121, "format-string": 134, "integer-overflow": 190, "type-confusion": 843,
    "race-condition": 362, "injection": 74, "unsafe-deserialization": 502, "logic-flaw": 840, "info-leak": 200,
}
DATA_URI = r"data:([\w.+-]+/[\w.+-]+);base64,([A-Za-z0-9+/=]*)"
SNIFFED = 8192
_MARK = "\ufdd1"


def ending(path: Column) -> Column:
    """The last ending of a file name with its dot, in lower case; empty if there is none or the name begins with its only dot."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"^.+(\.[^.]*)$", 1))


def _ends_with(name: Column, endings) -> Column:
    hit = F.lit(False)
    for e in endings:
        hit = hit | F.endswith(name, F.lit(e))
    return hit


def skip_reason(path: Column) -> Column:
    """Why the pass over left files skips a path: its name, its ending or a folder; null if it does not."""
    name, folders = F.lower(F.substring_index(path, "/", -1)), F.split(F.lower(path), "/")
    above = F.slice(folders, F.lit(1), F.size(folders) - 1)
    return (
        F.when(name.isin(SKIP_NAMES), "name").when(_ends_with(name, SKIP_ENDINGS), "extension")
        .when(F.arrays_overlap(above, F.array(*[F.lit(x) for x in SKIP_FOLDERS])), "directory")
    )


def is_iac(path: Column) -> Column:
    return path.rlike(IAC)


def is_source(path: Column) -> Column:
    """Code of a known language, security configuration, or infrastructure code; type declarations are none."""
    name = F.lower(F.substring_index(path, "/", -1))
    config = ending(path).isin(list(CONFIG_ENDINGS)) & F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*[F.lit(x) for x in CONFIG_FOLDERS]))
    other = F.when(ending(path).isin(list(CONFIG_ENDINGS)), config).otherwise(is_iac(path))
    return ~F.endswith(name, F.lit(".d.ts")) & (X.language_of(path).isNotNull() | name.isin(CONFIG_NAMES) | other)


def cwe_id(c: Column, cls: Column) -> Column:
    """A weakness in upper case, else the one that stands for its class; null if neither is known."""
    given = F.nullif(F.upper(F.trim(c)), F.lit(""))
    return F.coalesce(given, F.concat(F.lit("CWE-"), X.lookup(CWE_OF_CLASS, cls).cast("string")))


def cwe_name(c: Column) -> Column:
    """The public name of a weakness written CWE-n in any case; empty for others and null."""
    n = F.regexp_extract(F.upper(F.trim(c)), r"^CWE-([1-9]\d*)$", 1).try_cast("int")
    return F.coalesce(X.lookup(CWE_NAMES, n), F.lit(""))


def cwe_label(c: Column) -> Column:
    name = cwe_name(c)
    return F.when(F.coalesce(c, F.lit("")) == "", "").when(name == "", c).otherwise(F.concat(c, F.lit(" - "), name))


def stride(kind: Column) -> Column:
    return X.lookup(STRIDE, kind, STRIDE_ELSE)


def size_band(lines: Column) -> Column:
    band = F.when(lines < SIZES[0][0], SIZES[0][1])
    for below, name in SIZES[1:]:
        band = band.when(lines < below, name)
    return band.otherwise(SIZE_ELSE)


def policy_decision(number: Column, path: Column, deny: dict[int, str], deny_paths: list[str], allow: list[int], default: str, off: bool = False) -> Column:
    """``action`` and ``reason``: the switch, an unmapped weakness, a denied one, a denied path, an allowed one, else the default, in that order."""
    out = lambda action, reason: F.struct(F.lit(action).alias("action"), reason.alias("reason"))
    if off:
        return out("guidance_only", F.lit("kill_switch"))
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    denied = X.lookup(deny, number.cast("int")) if deny else F.lit(None).cast("string")
    first = X.first_glob(slashed, [p for pattern in deny_paths for p in ([pattern, pattern.removeprefix("**/")] if pattern.startswith("**/") else [pattern])])
    said = F.lit(None).cast("string")
    for p in deny_paths:
        said = F.coalesce(said, F.when((first == p) | (first == p.removeprefix("**/")), p))
    return (
        F.when(number.isNull(), out("guidance_only", F.lit("unmapped_cwe"))).when(denied.isNotNull(), out("guidance_only", denied))
        .when(said.isNotNull(), out("guidance_only", F.concat(F.lit("sensitive_path:"), said)))
        .when(number.isin(allow), out("patch", F.lit("allow_list"))).otherwise(out(default, F.lit("default_action")))
    )


def packed_text(text: Column, path: Column) -> Column:
    """A text as it is packed: binary content replaced by a note, data URIs cut to their type and length. A text is binary if its
    first ``SNIFFED`` characters hold a NUL or are replacement characters by more than a tenth."""
    head = F.left(text, F.lit(SNIFFED))
    strange = F.length(head) - F.length(F.replace(head, F.lit("\ufffd"), F.lit("")))
    binary = F.contains(head, F.lit("\x00")) | (strange * 10 > F.length(head))
    pieces = F.split(F.regexp_replace(F.translate(text, _MARK, ""), DATA_URI, f"{_MARK}$0{_MARK}"), _MARK)

    def elided(uri: Column) -> Column:
        size = F.length(F.regexp_extract(uri, DATA_URI, 2))
        count = F.when(size > 0, F.concat(F.lit(": "), size.cast("string"), F.lit(" chars"))).otherwise("")
        return F.concat(F.lit("[data-uri "), F.regexp_extract(uri, DATA_URI, 1), F.lit(" elided"), count, F.lit("]"))

    shown = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, elided(p)).otherwise(p)), "")
    name = F.when(F.coalesce(path, F.lit("")) == "", "file").otherwise(path)
    return F.when(binary, F.concat(F.lit("[binary content elided: "), name, F.lit(" is not text]"))).when(F.contains(text, F.lit(";base64,")), shown).otherwise(text)


def setting_keys(text: Column) -> Column:
    """Names before a colon or an equals sign, one a line, in order."""
    named = F.transform(F.split(text, "\\r?\\n"), lambda line: F.regexp_extract(line, r"^\s*([A-Za-z0-9_.\-]+)\s*[:=]", 1))
    return F.filter(named, lambda k: k != "")


def indented_keys(text: Column) -> Column:
    """Dotted key paths of indented ``key:`` lines, in order: a fold over the lines that carries the open keys with their indents."""
    pattern = r"^( *)(?:- +)?([\w.\-]+)\s*:"
    start = F.struct(F.array().cast("array<struct<i:int,k:string>>").alias("open"), F.array().cast("array<string>").alias("keys"))

    def step(s: Column, line: Column) -> Column:
        indent, key = F.length(F.regexp_extract(line, pattern, 1)), F.regexp_extract(line, pattern, 2)
        kept = F.filter(s["open"], lambda o: o["i"] < indent)
        stack = F.concat(kept, F.array(F.struct(indent.alias("i"), key.alias("k"))))
        path = F.array_join(F.transform(stack, lambda o: o["k"]), ".")
        return F.when((key == "") | F.ltrim(line).startswith("#"), s).otherwise(F.struct(stack.alias("open"), F.concat(s["keys"], F.array(path)).alias("keys")))

    return F.aggregate(F.split(text, "\\r?\\n"), start, step, lambda s: s["keys"])
