"""Queries over rules, scopes, histories, manifests, duplicates and baselines, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritmill.functions import rules as U
from gritmill.functions import severity as S
from gritmill.functions import text as X
from gritmill.operators import clusters as C
from gritmill.operators import findings as O
from gritmill.operators import scope as P
from gritmill.plans import finding_queries as Q
from gritmill.plans.domain import domain, sql_with
from gritmill.plans.registry import Registry
from gritmill.sources import manifests as M
from gritmill.tables import table

R = Registry()


def q(name: str, tables: str, sql: str | None):
    def add(f):
        R.query(name, sql_with(tables, sql) if sql else None)(lambda spark, sf_dir: f(*[domain(spark, sf_dir, t) for t in tables.split()]))
        return f

    return add


def t(name: str, tables: str, sql: str | None):
    def add(f):
        R.query(name, sql)(lambda spark, sf_dir: f(*[table(spark, sf_dir, n) for n in tables.split()]))
        return f

    return add


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _any_folder(parts: str, folders) -> str:
    return f"len(list_filter({parts}, lambda x: x IN {_list(folders)})) > 0"


_NAME = "lower(regexp_extract(p, '[^/]*$'))"
_ENDING = rf"lower(regexp_extract({_NAME}, '^.+(\.[^.]*)$', 1))"
_ENDS = "|".join(e.replace(".", r"\.") for e in U.SKIP_ENDINGS)


# ---- rules over paths, weaknesses, texts --------------------------------------------
@t("skip_reasons", "scan_coverage", rf"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN {_NAME} IN {_list(U.SKIP_NAMES)} THEN 'name' WHEN regexp_matches({_NAME}, '({_ENDS})$') THEN 'extension' WHEN {_any_folder("string_split(lower(p), '/')[:-2]", U.SKIP_FOLDERS)} THEN 'directory' END AS reason FROM (SELECT replace(trim(path), '\', '/') AS p FROM scan_coverage) a) b GROUP BY 1")
def _(s):
    p = F.replace(F.trim("path"), F.lit("\\"), F.lit("/"))
    return s.groupBy(U.skip_reason(p).alias("reason")).agg(F.count("*").alias("n"))


@t("source_kinds", "scan_coverage", rf"SELECT iac, source, count(*) AS n FROM (SELECT regexp_matches(p, '{U.IAC}') AS iac, NOT ends_with({_NAME}, '.d.ts') AND ({Q._LANG.format('p')} IS NOT NULL OR {_NAME} IN {_list(U.CONFIG_NAMES)} OR CASE WHEN {_ENDING} IN {_list(U.CONFIG_ENDINGS)} THEN {_any_folder("string_split(lower(p), '/')", U.CONFIG_FOLDERS)} ELSE regexp_matches(p, '{U.IAC}') END) AS source FROM (SELECT replace(trim(path), '\', '/') AS p FROM scan_coverage) a) b GROUP BY 1, 2")
def _(s):
    p = F.replace(F.trim("path"), F.lit("\\"), F.lit("/"))
    return s.groupBy(U.is_iac(p).alias("iac"), U.is_source(p).alias("source")).agg(F.count("*").alias("n"))


_NAMES_SQL = "CASE regexp_extract(upper(trim(cwe)), '^CWE-([1-9][0-9]*)$', 1) " + " ".join(f"WHEN '{n}' THEN '{v}'" for n, v in U.CWE_NAMES.items()) + " ELSE '' END"
_STANDS = "CASE vuln_class " + " ".join(f"WHEN '{c}' THEN 'CWE-{n}'" for c, n in U.CWE_OF_CLASS.items()) + " END"


@q("cwe_labels", "findings", f"SELECT cwe, vuln_class, coalesce({_NAMES_SQL}, '') AS name, CASE WHEN coalesce(cwe, '') = '' THEN '' WHEN {_NAMES_SQL} = '' THEN cwe ELSE cwe || ' - ' || {_NAMES_SQL} END AS label, coalesce(nullif(upper(trim(cwe)), ''), {_STANDS}) AS stands, count(*) AS n FROM findings GROUP BY ALL")
def _(f):
    c = F.col("cwe")
    return f.groupBy("cwe", "vuln_class", U.cwe_name(c).alias("name"), U.cwe_label(c).alias("label"), U.cwe_id(c, F.col("vuln_class")).alias("stands")).agg(F.count("*").alias("n"))


@q("stride_hints", "findings", "SELECT split_part(vuln_class, '-', 2) AS kind, CASE split_part(vuln_class, '-', 2) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in U.STRIDE.items()) + f" ELSE '{U.STRIDE_ELSE}' END AS hint, count(*) AS n FROM findings GROUP BY 1, 2")
def _(f):
    kind = F.split_part("vuln_class", F.lit("-"), F.lit(2))
    return f.groupBy(kind.alias("kind"), U.stride(kind).alias("hint")).agg(F.count("*").alias("n"))


@t("size_bands", "scan_coverage", "SELECT CASE WHEN lines < 2000 THEN 'small' WHEN lines < 8000 THEN 'medium' ELSE 'large' END AS band, count(*) AS folders FROM (SELECT scan_id, split_part(trim(path), '/', 1) AS folder, sum(coalesce(n_lines, 0)) AS lines FROM scan_coverage GROUP BY 1, 2) a GROUP BY 1")
def _(s):
    per = s.groupBy("scan_id", F.split_part(F.trim("path"), F.lit("/"), F.lit(1)).alias("folder")).agg(F.sum(F.coalesce("n_lines", F.lit(0))).alias("lines"))
    return per.groupBy(U.size_band(F.col("lines")).alias("band")).agg(F.count("*").alias("folders"))


_DENY, _ALLOW, _DENY_PATHS = {798: "needs a rotation", 416: "memory"}, [79, 89], ["**/m1/*", "src/tests/*"]


@q("policy_decisions", "findings", f"SELECT action, reason, count(*) AS n FROM (SELECT CASE WHEN {Q._NUM} IS NOT NULL AND {Q._NUM} NOT IN (798, 416) AND NOT regexp_matches(file, '^.*/m1/.*$|^m1/.*$|^src/tests/.*$') AND {Q._NUM} IN (79, 89) THEN 'patch' ELSE 'guidance_only' END AS action, CASE WHEN {Q._NUM} IS NULL THEN 'unmapped_cwe' WHEN {Q._NUM} = 798 THEN 'needs a rotation' WHEN {Q._NUM} = 416 THEN 'memory' WHEN regexp_matches(file, '^.*/m1/.*$|^m1/.*$') THEN 'sensitive_path:**/m1/*' WHEN regexp_matches(file, '^src/tests/.*$') THEN 'sensitive_path:src/tests/*' WHEN {Q._NUM} IN (79, 89) THEN 'allow_list' ELSE 'default_action' END AS reason FROM findings) x GROUP BY 1, 2")
def _(f):
    d = f.select(U.policy_decision(X.cwe_number(F.col("cwe")), F.col("file"), _DENY, _DENY_PATHS, _ALLOW, "guidance_only").alias("d"))
    return d.groupBy("d.action", "d.reason").agg(F.count("*").alias("n"))


@t("setting_keys", "documents", r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: regexp_extract(x, '^\s*([A-Za-z0-9_.\-]+)\s*[:=]', 1)), lambda k: k <> ''), ',') AS keys FROM documents")
def _(d):
    return d.select("doc_id", F.array_join(U.setting_keys(F.col("text")), ",").alias("keys"))


@t("indented_keys", "documents", None)
def _(d):
    return d.select("doc_id", F.array_join(U.indented_keys(F.col("text")), ",").alias("keys"))


@t("packed_texts", "documents", None)
def _(d):
    return d.select("doc_id", U.packed_text(F.col("text"), F.col("source")).alias("text"))


_APP = f"CAST(c_custkey AS VARCHAR) AS app, c_acctbal > 0 AS external, c_acctbal > 5000 AS pci, c_custkey % 3 = 0 AS pan, c_nationkey % 2 = 0 AS pii, v.cvss_vector FROM customer JOIN (SELECT cvss_vector, row_number() OVER (ORDER BY cvss_vector) AS k FROM vectors) v ON v.k = c_custkey % 2592 + 1"


def _app_sql() -> str:
    p, case = Q._p, Q._case
    pr = f"CASE WHEN {p(5)} = 'C' THEN {case(p(3), S.PR_CHANGED)} ELSE {case(p(3), S.PR_UNCHANGED)} END"
    rc, ri = "CASE WHEN pci OR pan OR pii THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END", "CASE WHEN pci OR pan THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END"
    av = case(f"CASE WHEN NOT external AND {p(1)} = 'N' THEN 'A' ELSE {p(1)} END", S.AV)
    return f""", a AS (SELECT {_APP}), e1 AS (SELECT app, cvss_vector, {p(5)} = 'C' AS sc, least(1.0::DOUBLE - (1.0::DOUBLE - {rc} * {case(p(6), S.CIA)}) * (1.0::DOUBLE - {ri} * {case(p(7), S.CIA)}) * (1.0::DOUBLE - 1.0::DOUBLE * {case(p(8), S.CIA)}), 0.915::DOUBLE) AS miss,
      8.22::DOUBLE * {av} * {case(p(2), S.AC)} * {pr} * {case(p(4), S.UI)} AS ex FROM a),
    e2 AS (SELECT *, CASE WHEN sc THEN 7.52::DOUBLE * (miss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(miss * 0.9731::DOUBLE - 0.02::DOUBLE, 13.0::DOUBLE) ELSE 6.42::DOUBLE * miss END AS im FROM e1),
    e3 AS (SELECT *, least(CASE WHEN sc THEN 1.08::DOUBLE * (im + ex) ELSE im + ex END, 10.0::DOUBLE) AS rw FROM e2),
    e4 AS (SELECT *, {Q._ROUND.format('rw')} AS mb FROM e3)
    SELECT app, cvss_vector, CASE WHEN im <= 0 THEN 0.0::DOUBLE ELSE {Q._ROUND.format('mb * (0.94::DOUBLE * 0.95::DOUBLE)')} END AS vsvs FROM e4"""


def _app_scores(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    vectors = sorted(r[0] for r in domain(spark, sf_dir, "vectors").collect())  # all 2,592 of them
    all_vectors = F.array(*[F.lit(v) for v in vectors])
    a = c.select(
        F.col("c_custkey").cast("string").alias("app"), (F.col("c_acctbal") > 0).alias("external"), (F.col("c_acctbal") > 5000).alias("pci"),
        (F.col("c_custkey") % 3 == 0).alias("pan"), (F.col("c_nationkey") % 2 == 0).alias("pii"), F.get(all_vectors, (F.col("c_custkey") % 2592).cast("int")).alias("cvss_vector"),
    )
    return S.add_app_score(a).select("app", "cvss_vector", "vsvs")


R.query("app_scores", sql_with("vectors", _app_sql()))(_app_scores)


# ---- scope, chunks, threats, hops ---------------------------------------------------
@q("scope_filter", "findings", ", r AS (SELECT id, CASE run WHEN 0 THEN file WHEN 1 THEN regexp_replace(file, '^[^/]+/', '') ELSE 'nowhere/' || file END AS path FROM findings), d AS (SELECT DISTINCT file FROM findings), b AS (SELECT regexp_replace(file, '^[^/]+/', '') AS path, min(file) AS one FROM d WHERE contains(file, '/') GROUP BY 1 HAVING count(*) = 1) SELECT id, coalesce(d.file, b.one) AS resolved FROM r LEFT JOIN d ON d.file = r.path LEFT JOIN b ON b.path = r.path WHERE coalesce(d.file, b.one) IS NOT NULL")
def _(f):
    path = F.when(F.col("run") == 0, F.col("file")).when(F.col("run") == 1, F.regexp_replace("file", "^[^/]+/", "")).otherwise(F.concat(F.lit("nowhere/"), F.col("file")))
    return P.resolve_scope(f.select("id", path.alias("path")), f.select(F.col("file").alias("path"))).select("id", "resolved")


@t("chunk_scope", "cited_operations sinks", "SELECT chunk, path, row_number() OVER (PARTITION BY chunk ORDER BY pos, path) AS pos FROM (SELECT repo_id AS chunk, file AS path, min(op_id) AS pos FROM cited_operations WHERE file IN (SELECT file FROM sinks) GROUP BY 1, 2) a")
def _(c, s):
    return P.chunk_files(c.select(F.col("repo_id").alias("chunk"), F.col("op_id").alias("pos"), F.col("file").alias("path")), s.select(F.col("file").alias("path")))


_WORDS = "unnest(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


@t("threats_of_functions", "sinks cited_operations", f"WITH t AS (SELECT op_id AS ord, 'T-' || op_id AS threat, path AS surface FROM cited_operations WHERE path <> ''), f AS (SELECT DISTINCT function_name AS function FROM sinks), x AS (SELECT lower(surface) AS name, arg_min(threat, ord) AS exact FROM t GROUP BY 1), s AS (SELECT f.function, arg_min(t.threat, t.ord) AS shared FROM (SELECT function, {_WORDS.format('function')} AS w FROM f) f JOIN (SELECT threat, ord, {_WORDS.format('surface')} AS w FROM t) t USING (w) GROUP BY 1) SELECT f.function, coalesce(exact, shared) AS threat FROM f LEFT JOIN x ON x.name = lower(f.function) LEFT JOIN s ON s.function = f.function")
def _(s, c):
    threats = c.select(F.concat(F.lit("T-"), F.col("op_id").cast("string")).alias("threat"), F.col("op_id").alias("ord"), F.col("path").alias("surface"))
    return P.threats_of(s.select(F.col("function_name").alias("function")), threats)


@t("hop_files", "sinks cited_operations", "WITH c AS (SELECT DISTINCT repo_id AS grp, file AS path FROM sinks WHERE repo_id IS NOT NULL), a AS (SELECT DISTINCT repo_id AS grp, file AS path FROM cited_operations WHERE file <> ''), l AS (SELECT c.grp, c.path, max(len(list_filter(range(1, 1 + least(len(string_split(c.path, '/')), len(string_split(a.path, '/')))), lambda i: string_split(c.path, '/')[1:i] = string_split(a.path, '/')[1:i]))) AS shared FROM c JOIN a USING (grp) GROUP BY 1, 2) SELECT grp, path, CAST(coalesce(shared, 0) AS INT) AS shared FROM c LEFT JOIN l USING (grp, path) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY coalesce(shared, 0) DESC, path) <= 5")
def _(s, c):
    one = lambda d: d.select(F.col("repo_id").alias("grp"), F.col("file").alias("path"))
    return P.hop_files(one(s).where("grp IS NOT NULL"), one(c), 5)


@t("context_merge", "customer", "SELECT c_custkey AS app, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'internet' ELSE '' END ELSE 'internal' END AS exposure, c_custkey % 6 = 0 AS external, c_acctbal > 5000 OR (c_custkey % 2 = 0 AND c_nationkey % 5 IN (1, 2)) AS pci, c_custkey % 2 = 0 AND c_nationkey % 5 = 2 AS pan, c_nationkey % 7 = 0 OR (c_custkey % 2 = 0 AND c_nationkey % 5 IN (3, 4)) AS pii FROM customer")
def _(c):
    kind = F.get(F.array(*[F.lit(x) for x in ("none", "pci", "pan", "pii", "phi")]), (F.col("c_nationkey") % 5).cast("int"))
    profiles = c.select(F.col("c_custkey").alias("app"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("internal").alias("exposure"), F.lit(None).cast("boolean").alias("external"),
                        (F.col("c_acctbal") > 5000).alias("pci"), F.lit(False).alias("pan"), (F.col("c_nationkey") % 7 == 0).alias("pii"))
    facts = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("app"), F.lit("internet").alias("exposure"), F.lit(True).alias("external"), F.array(kind).alias("data"))
    return P.merge_context(profiles, facts, "app")


@q("seed_languages", "findings spans", f"SELECT DISTINCT language FROM (SELECT {Q._LANG.format('file')} AS language FROM findings UNION ALL SELECT {Q._LANG.format('file')} FROM spans) x WHERE language IS NOT NULL")
def _(f, s):
    return f.select("file").union(s.select("file")).select(X.language_of(F.col("file")).alias("language")).where("language IS NOT NULL").distinct()


@t("unfinished_scans", "scan_run", "SELECT tenant_id, count(*) FILTER (coalesce(completeness <> 'complete', true)) AS failed, count(*) AS scans FROM (SELECT DISTINCT tenant_id, scan_id, completeness FROM scan_run) x GROUP BY 1")
def _(s):
    one = s.select("tenant_id", "scan_id", "completeness").distinct()
    return one.groupBy("tenant_id").agg(F.count_if(F.coalesce(F.col("completeness") != "complete", F.lit(True))).alias("failed"), F.count("*").alias("scans"))


@t("top_assets", "customer", "SELECT c_custkey, c_name FROM customer ORDER BY CASE WHEN c_acctbal > 5000 THEN 2 WHEN c_acctbal > 0 THEN 1 ELSE 0 END DESC, c_name LIMIT 25")
def _(c):
    rank = F.when(F.col("c_acctbal") > 5000, 2).when(F.col("c_acctbal") > 0, 1).otherwise(0)
    return c.orderBy(rank.desc(), "c_name").limit(25).select("c_custkey", "c_name")


# ---- histories ----------------------------------------------------------------------
_TRIAGE = "SELECT user_id AS finding_id, event_id AS triage_id, ts AS decided_at, CASE event_type WHEN 'view' THEN 'false_positive' WHEN 'signup' THEN 'accepted_risk' WHEN 'purchase' THEN 'wont_fix' WHEN 'error' THEN 'reopen' END AS decision, CASE WHEN event_id % 4 = 0 THEN '  short ' ELSE 'reason ' || props END AS reason, CASE WHEN value > 50 THEN ts + INTERVAL 30 DAY END AS expires_at, CASE WHEN value < 5 THEN ts END AS revoked_at FROM events"


def _triage(spark, sf_dir):
    return spark.sql(_TRIAGE.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


R.query("triage_errors", f"SELECT error, count(*) AS n FROM (SELECT CASE WHEN coalesce(decision NOT IN {_list(P.DECISIONS)}, true) THEN 'decision' WHEN length(trim(coalesce(reason, ''))) < 10 THEN 'reason' WHEN decision = 'accepted_risk' AND expires_at IS NULL THEN 'expiry' END AS error FROM ({_TRIAGE}) t) x GROUP BY 1")(
    lambda spark, sf_dir: _triage(spark, sf_dir).groupBy(P.triage_error().alias("error")).agg(F.count("*").alias("n"))
)
_NOW = "TIMESTAMP '2024-02-01 00:00:00'"
R.query("active_suppressions", f"SELECT finding_id, decision FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY decided_at DESC, triage_id DESC) AS k FROM ({_TRIAGE}) t WHERE revoked_at IS NULL) x WHERE k = 1 AND coalesce(decision <> 'reopen', false) AND (expires_at IS NULL OR expires_at > {_NOW})")(
    lambda spark, sf_dir: P.active_suppressions(_triage(spark, sf_dir), F.expr(_NOW.replace("TIMESTAMP ", "TIMESTAMP_NTZ ")))
)


# ---- manifests and baselines --------------------------------------------------------
@t("manifest_entries", "customer", "WITH m AS (SELECT c_custkey AS line, CAST(c_custkey AS VARCHAR) AS app_id, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS repo_name, '/srv/' || (c_custkey * 7 % 1000) AS path, CASE WHEN c_custkey % 5 = 0 THEN 'b.json' ELSE '' END AS baseline FROM customer) SELECT line, app_id, repo_name, path, baseline, CASE WHEN repo_name = '' THEN 'blank' WHEN line > min(CASE WHEN repo_name <> '' THEN line END) OVER (PARTITION BY path) THEN 'duplicate' END AS error FROM m")
def _(c):
    path = F.concat(F.lit("/srv/"), (F.col("c_custkey") * 7 % 1000).cast("string"))
    name = F.when(F.col("c_custkey") % 11 == 0, "").otherwise(F.col("c_name"))
    value = F.concat(F.lit(" "), F.concat_ws(" , ", F.col("c_custkey").cast("string"), name, path), F.when(F.col("c_custkey") % 5 == 0, ", b.json").otherwise(""))
    return M.text_manifest(c.select(F.col("c_custkey").alias("line"), value.alias("value")))


@t("baseline_documents", "thirdparty_findings", "SELECT DISTINCT row_id, CASE WHEN row_id % 3 = 0 THEN 'sarif' ELSE 'findings' END AS kind, CASE WHEN row_id % 3 = 0 THEN 'r' || row_id WHEN row_id % 3 = 1 THEN 'c' || row_id END AS commit, CASE WHEN row_id % 3 <> 0 THEN file END AS file, CASE WHEN row_id % 3 <> 0 THEN line_start END AS line_start FROM thirdparty_findings")
def _(f):
    one = f.select("row_id", "file", "line_start", "line_end", "title").distinct()
    tag = lambda p: F.concat(F.lit(p), F.col("row_id").cast("string"))
    prov = lambda c: F.struct(F.array(F.struct(c.alias("revisionId"))).alias("versionControlProvenance"))
    runs = F.to_json(F.struct(F.array(prov(F.lit(" ")), prov(tag("r"))).alias("runs")))
    held = F.to_json(F.struct(F.when(F.col("row_id") % 3 == 1, tag("c")).otherwise(" ").alias("commit_sha"), F.array(F.struct("file", "line_start", "line_end", "title")).alias("findings")))
    docs = M.baseline_documents(one.select("row_id", F.when(F.col("row_id") % 3 == 0, runs).otherwise(held).alias("text")))
    return docs.select("row_id", "kind", "commit", F.get("findings", F.lit(0))["file"].alias("file"), F.get("findings", F.lit(0))["line_start"].alias("line_start"))


def _tier_keys(f):
    lines = F.concat_ws("#", "file", "title", F.col("line_start").cast("string"))
    return f.withColumns({"v3": F.when(F.col("run") != 2, lines), "v2": F.concat_ws("#", "file", "title"), "v1": F.concat_ws("#", "file", "vuln_class")})


def _tiers_sql() -> str:
    keys = {"v3": "CASE WHEN run <> 2 THEN file || '#' || title || '#' || line_start END", "v2": "file || '#' || title", "v1": "file || '#' || vuln_class"}
    left, right, parts, out = "current_findings", "baseline_findings", [], []
    for i, (tier, key) in enumerate(keys.items()):
        number = "SELECT *, {0} AS key, row_number() OVER (PARTITION BY {0} ORDER BY id) AS k FROM {1} WHERE {0} IS NOT NULL"
        parts.append(f"m{i} AS (SELECT c.id AS cur, b.id AS base, '{tier}' AS tier FROM ({number.format(key, left)}) c JOIN ({number.format(key, right)}) b USING (key, k))")
        parts.append(f"c{i} AS (SELECT * FROM {left} WHERE id NOT IN (SELECT cur FROM m{i})), b{i} AS (SELECT * FROM {right} WHERE id NOT IN (SELECT base FROM m{i}))")
        left, right = f"c{i}", f"b{i}"
        out.append(f"SELECT cur, base, tier FROM m{i}")
    return ", " + ", ".join(parts) + " " + " UNION ALL ".join(out)


@q("baseline_tiers", "current_findings baseline_findings", _tiers_sql())
def _(c, b):
    keyed = lambda d, name: _tier_keys(d).select(F.col("id").alias(name), "v3", "v2", "v1")
    return O.tiered_match(keyed(c, "cur"), keyed(b, "base"), ["v3", "v2", "v1"])


@q("baseline_states", "current_findings baseline_findings", None)
def _(c, b):
    """Exact tiers, then folder m1 renamed to lib, then near spans: the order of the choices is kept, so no twin."""
    keep = ["file", "vuln_class", "line_start", "line_end", "v3", "v2"]
    cur, base = _tier_keys(c).select(F.col("id").alias("cur"), *keep), _tier_keys(b).select(F.col("id").alias("base"), *keep)
    moved = b.where(F.col("file").startswith("src/m1/")).withColumn("file", F.regexp_replace("file", "^src/m1/", "src/m2/"))
    return C.baseline_states(cur, base, ["v3", "v2"], _tier_keys(moved).select(F.col("id").alias("base"), "v3", "v2"), 3, O.tiered_match)


@q("duplicate_relations", "findings", None)
def _(f):
    return C.duplicate_relations(f.withColumn("ord", F.col("id")), 5, ["logic-flaw"], True)


@q("chunks_collapsed", "findings", None)
def _(f):
    """The most confident finding of every cluster over all chunks."""
    return O.cluster_votes(f, tolerance=5).select("file", F.col("best").alias("id"), "confidence", "members")
