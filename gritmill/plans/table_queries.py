"""Queries over coverage, scans, texts, events, code sites and the call graph, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritmill.functions import masking as M
from gritmill.functions import text as X
from gritmill.operators import graph as G
from gritmill.operators import ordering as N
from gritmill.operators.packing import next_fit
from gritmill.plans.domain import domain, sql_with
from gritmill.plans.finding_queries import _LANG
from gritmill.plans.registry import Registry
from gritmill.sources import checkpoints as C
from gritmill.sources import exports as E
from gritmill.tables import table

R = Registry()
# Directories and endings a repository walk leaves out.
WALK_DIRS = (
    ".git .hg .svn node_modules __pycache__ .venv venv dist build .idea .vscode target vendor .terraform .next .nuxt coverage .pytest_cache .mypy_cache "
    "test tests __tests__ __test__ e2e testdata fixtures __fixtures__ mocks __mocks__ stubs checkpoints security-scan"
).split()
WALK_ENDINGS = (
    ".png .jpg .jpeg .gif .ico .svg .pdf .zip .gz .tar .7z .jar .war .class .exe .dll .so .dylib .bin .o .a .obj .pyc .pyo .pkl .lock .min.js .map .woff "
    ".woff2 .ttf .eot .mp4 .mp3 .wav"
).split()


def q(name: str, tables: str, sql: str | None):
    def add(f):
        R.query(name, sql)(lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in tables.split()]))
        return f

    return add


_DIRS_SQL = "[" + ", ".join(f"'{d}'" for d in WALK_DIRS) + "]"
_ENDS_SQL = "|".join(e.replace(".", r"\.") for e in WALK_ENDINGS)


@q("walk_exclusions", "scan_coverage", rf"SELECT rule, count(*) AS n FROM (SELECT CASE WHEN len(list_filter(list_slice(string_split(lower(p), '/'), 1, -2), lambda x: list_contains({_DIRS_SQL}, x))) > 0 THEN 'dir' WHEN regexp_matches(lower(p), '({_ENDS_SQL})$') THEN 'ext' WHEN regexp_matches(p, '^docs/.*$') THEN 'glob' WHEN coalesce(n_bytes > 1048576, false) THEN 'oversize' ELSE 'kept' END AS rule FROM (SELECT replace(trim(path), '\', '/') AS p, n_bytes FROM scan_coverage) a) b GROUP BY 1")
def _(s):
    p = F.replace(F.trim("path"), F.lit("\\"), F.lit("/"))
    folders = F.slice(F.split(F.lower(p), "/"), F.lit(1), F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0)))
    rule = (
        F.when(F.arrays_overlap(folders, F.array(*[F.lit(d) for d in WALK_DIRS])), "dir").when(F.lower(p).rlike("(" + _ENDS_SQL + ")$"), "ext")
        .when(X.first_glob(p, ["docs/*"]).isNotNull(), "glob").when(F.coalesce(F.col("n_bytes") > 1048576, F.lit(False)), "oversize").otherwise("kept")
    )
    return s.groupBy(rule.alias("rule")).agg(F.count("*").alias("n"))


_DISP = "lower(replace(trim(disposition), '-', '_'))"


@q("disposition_counts", "scan_coverage", f"SELECT {_DISP} AS disposition, count(*) AS n FROM (SELECT DISTINCT * FROM scan_coverage) x GROUP BY 1")
def _(s):
    return s.distinct().groupBy(F.nullif(X.norm_name(F.col("disposition")), F.lit("")).alias("disposition")).agg(F.count("*").alias("n"))


@q("not_reviewed", "scan_coverage", f"SELECT DISTINCT scan_id, path FROM scan_coverage WHERE {_DISP} <> 'reviewed'")
def _(s):
    return s.where(F.col("disposition").isNotNull() & (X.norm_name(F.col("disposition")) != "reviewed")).select("scan_id", "path").distinct()


@q("best_disposition", "scan_coverage", f"SELECT path, min(CASE {_DISP} WHEN 'reviewed' THEN 0 WHEN 'budget_skipped' THEN 1 WHEN 'chunk_guardrailed' THEN 2 ELSE 3 END) AS best FROM scan_coverage GROUP BY 1")
def _(s):
    d = X.norm_name(F.col("disposition"))
    return s.groupBy("path").agg(F.min(F.when(d == "reviewed", 0).when(d == "budget_skipped", 1).when(d == "chunk_guardrailed", 2).otherwise(3)).alias("best"))


@q("coverage_pct", "scan_coverage", f"SELECT tenant_id, count(*) AS files, CASE WHEN count(*) = 0 THEN 0 ELSE (count(*) FILTER ({_DISP} = 'reviewed') * 100) / count(*)::DOUBLE END AS pct FROM scan_coverage GROUP BY 1")
def _(s):
    n, ok = F.count("*"), F.count_if(X.norm_name(F.col("disposition")) == "reviewed")
    return s.groupBy("tenant_id").agg(n.alias("files"), F.when(n == 0, 0.0).otherwise(ok * 100 / n).alias("pct"))


@q("size_estimate", "scan_coverage", f"SELECT {_LANG.format('trim(path)')} AS language, count(*) AS files, CAST(coalesce(sum(n_bytes), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(n_bytes), 0) // 4 AS BIGINT) AS tokens FROM scan_coverage GROUP BY 1")
def _(s):
    b = F.coalesce(F.sum("n_bytes"), F.lit(0))
    return s.groupBy(X.language_of(F.trim("path")).alias("language")).agg(F.count("*").alias("files"), b.alias("bytes"), F.floor(b / 4).alias("tokens"))


@q("sparsity_guard", "scan_coverage", f"SELECT scan_id, count(*) FILTER ({_DISP} = 'unreachable') AS unreachable, count(*) > 0 AND (count(*) FILTER ({_DISP} <> 'unreachable') < 5 OR count(*) FILTER ({_DISP} <> 'unreachable') * 10 < count(*)) AS sparse FROM scan_coverage GROUP BY 1")
def _(s):
    d, n = F.nullif(X.norm_name(F.col("disposition")), F.lit("")), F.count("*")
    near = F.count_if(d != "unreachable")
    return s.groupBy("scan_id").agg(F.count_if(d == "unreachable").alias("unreachable"), ((n > 0) & ((near < 5) | (near * 10 < n))).alias("sparse"))


@q("branch_latest_scan", "scan_run", "SELECT tenant_id, repo_id, branch, scan_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, repo_id, branch ORDER BY started_at DESC, scan_id) AS k FROM (SELECT DISTINCT tenant_id, repo_id, branch, scan_id, started_at FROM scan_run) a) b WHERE k = 1")
def _(s):
    one = s.select("tenant_id", "repo_id", "branch", "scan_id", "started_at").distinct()
    k = F.row_number().over(W.partitionBy("tenant_id", "repo_id", "branch").orderBy(F.desc("started_at"), "scan_id"))
    return one.withColumn("k", k).where("k = 1").select("tenant_id", "repo_id", "branch", "scan_id")


@q("stage_counts", "scan_run", "SELECT stage, count(*) AS n FROM (SELECT unnest(stages_ran) AS stage FROM (SELECT DISTINCT scan_id, stages_ran FROM scan_run) a) b GROUP BY 1")
def _(s):
    return s.select("scan_id", "stages_ran").distinct().select(F.explode("stages_ran").alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


@q("scan_durations", "scan_run", "SELECT completeness, count(*) AS n, CAST(sum(epoch_us(finished_at) - epoch_us(started_at)) AS BIGINT) AS micros FROM (SELECT DISTINCT scan_id, completeness, started_at, finished_at FROM scan_run) a WHERE finished_at IS NOT NULL GROUP BY 1")
def _(s):
    one = s.select("scan_id", "completeness", "started_at", "finished_at").distinct().where("finished_at IS NOT NULL")
    span = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return one.groupBy("completeness").agg(F.count("*").alias("n"), F.sum(span).alias("micros"))


@q("enum_check", "scan_run", "SELECT DISTINCT scan_id, completeness FROM scan_run WHERE coalesce(completeness NOT IN ('running','complete','budget_stopped','canceled','degraded','failed','abandoned'), true)")
def _(s):
    ok = F.col("completeness").isin("running", "complete", "budget_stopped", "canceled", "degraded", "failed", "abandoned")
    return s.where(~F.coalesce(ok, F.lit(False))).select("scan_id", "completeness").distinct()


@q("tenant_isolation", "scan_run", "SELECT DISTINCT scan_id, repo_id FROM scan_run WHERE tenant_id = (SELECT min(tenant_id) FROM scan_run)")
def _(s):
    return C.tenant_rows(s, tenant=s.agg(F.min("tenant_id")).first()[0]).select("scan_id", "repo_id").distinct()


# ---- texts --------------------------------------------------------------------------
@q("nonblank_loc", "documents", r"SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s\p{Z}]'))) END AS loc FROM documents")
def _(d):
    return d.select("doc_id", X.nonblank_lines(F.col("text")).alias("loc"))


@q("line_ranges", "documents", "SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) >= 2 THEN array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) END AS lines FROM documents")
def _(d):
    return d.select("doc_id", X.line_range(F.col("text"), F.lit(2), F.lit(4)).alias("lines"))


@q("truncated_chars", "documents", "SELECT doc_id, left(text, 40) AS head FROM documents")
def _(d):
    return d.select("doc_id", F.left("text", F.lit(40)).alias("head"))


@q("text_shapes", "documents", "SELECT sha256(coalesce(text, '')) AS digest, count(*) AS copies, min(doc_id) AS keep FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(d):
    return d.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("keep")).where("copies > 1")


@q("grep_lines", "documents", "SELECT doc_id, line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) x WHERE regexp_matches(line, '(?i)sanitizer')")
def _(d):
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return lines.where(F.col("line").rlike("(?i)sanitizer")).select("doc_id", (F.col("p") + 1).cast("bigint").alias("line_no"))


@q("pattern_scan_capped", "sinks", r"SELECT file, sink_id FROM (SELECT file, sink_id, row_number() OVER (PARTITION BY file ORDER BY sink_id) AS k FROM (SELECT DISTINCT file, sink_id, snippet FROM sinks) a WHERE regexp_matches(snippet, 'exec\(|pickle\.loads|unserialize\(')) b WHERE k <= 50")
def _(s):
    hits = s.select("file", "sink_id", "snippet").distinct().where(F.col("snippet").rlike(r"exec\(|pickle\.loads|unserialize\("))
    k = F.row_number().over(W.partitionBy("file").orderBy("sink_id"))
    return hits.withColumn("k", k).where("k <= 50").select("file", "sink_id")


@q("sink_cwes", "sinks", "SELECT cwe, count(*) AS n, count(DISTINCT repo_id) AS repos FROM (SELECT DISTINCT sink_id, repo_id, unnest(cwe) AS cwe FROM sinks) x GROUP BY 1")
def _(s):
    e = s.select("sink_id", "repo_id", F.explode("cwe").alias("cwe")).distinct()
    return e.groupBy("cwe").agg(F.count("*").alias("n"), F.count_distinct("repo_id").alias("repos"))


@q("seed_merge", "sinks", "SELECT repo_id, file, function_name, min(sink_id) AS sink_id FROM sinks GROUP BY 1, 2, 3")
def _(s):
    return s.groupBy("repo_id", "file", "function_name").agg(F.min("sink_id").alias("sink_id"))


@q("orphaned_sinks", "sinks cited_operations", "SELECT DISTINCT sink_id FROM sinks s WHERE NOT EXISTS (SELECT 1 FROM cited_operations c WHERE c.repo_id = s.repo_id)")
def _(s, c):
    return s.join(c.select("repo_id").distinct(), "repo_id", "left_anti").select("sink_id").distinct()


@q("api_inventory", "cited_operations", "SELECT DISTINCT upper(trim(http_method)) AS method, '/' || array_to_string(list_filter(string_split(split_part(split_part(regexp_replace(path, ':(\\w+)', '{\\1}', 'g'), '?', 1), '#', 1), '/'), lambda x: x <> ''), '/') AS route FROM cited_operations WHERE path IS NOT NULL AND http_method IS NOT NULL")
def _(c):
    return c.where("path IS NOT NULL AND http_method IS NOT NULL").select(F.upper(F.trim("http_method")).alias("method"), X.route_path(F.col("path")).alias("route")).distinct()


@q("masked_urls", "documents", None)
def _(d):
    return d.select("doc_id", M.masked(F.col("text")).alias("text"))


@q("mask_label_counts", "documents", None)
def _(d):
    return d.where("text IS NOT NULL").select(F.explode(M.mask_counts(F.col("text"))).alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n"))


# ---- events -------------------------------------------------------------------------
@q("event_windows", "events", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(e):
    return e.groupBy(F.date_trunc("hour", "ts").cast(e.schema["ts"].dataType).alias("start"), "event_type").agg(F.count("*").alias("n"))


@q("spend_cap", "events", "SELECT user_id, min(event_id) AS tripped_at FROM (SELECT user_id, event_id, sum(1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS used FROM events) x WHERE used >= 5 GROUP BY 1")
def _(e):
    used = F.sum(F.lit(1)).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("user_id", "event_id", used.alias("used")).where("used >= 5").groupBy("user_id").agg(F.min("event_id").alias("tripped_at"))


@q("json_props", "events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(e):
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@q("usage_by_stage", "events", "SELECT event_type AS stage, count(*) AS calls, count(*) FILTER (value IS NULL OR value < 10) AS truncated, CASE WHEN count(*) FILTER (value >= 10) > 0 THEN max(value) END AS top FROM events GROUP BY 1")
def _(e):
    return e.groupBy(F.col("event_type").alias("stage")).agg(
        F.count("*").alias("calls"), F.count_if(F.col("value").isNull() | (F.col("value") < 10)).alias("truncated"),
        F.when(F.count_if(F.col("value") >= 10) > 0, F.max("value")).alias("top"),
    )


# ---- third-party rows ---------------------------------------------------------------
@q("vendor_facets", "thirdparty_findings", "SELECT lower(trim(feed)) AS feed, count(*) AS n, count(DISTINCT repo_id) AS repos, count(DISTINCT dup_group) AS groups FROM (SELECT DISTINCT * FROM thirdparty_findings) x GROUP BY 1")
def _(t):
    return t.distinct().groupBy(F.lower(F.trim("feed")).alias("feed")).agg(F.count("*").alias("n"), F.count_distinct("repo_id").alias("repos"), F.count_distinct("dup_group").alias("groups"))


@q("tier_lookup", "thirdparty_findings", "SELECT row_id, CASE WHEN n > 500 THEN 500 WHEN n > 100 THEN 100 WHEN n > 10 THEN 10 END AS tier FROM (SELECT DISTINCT row_id, line_start AS n FROM thirdparty_findings) x")
def _(t):
    tiers = F.array(F.lit(10), F.lit(100), F.lit(500))
    return t.select("row_id", "line_start").distinct().select("row_id", F.array_max(F.filter(tiers, lambda a: F.col("line_start") > a)).alias("tier"))


@q("remediation_sections", "thirdparty_findings", "SELECT DISTINCT row_id, coalesce(trim(recommendation), '') AS section FROM thirdparty_findings")
def _(t):
    md = F.concat(F.lit("# T\n## Remediation\n"), F.coalesce("recommendation", F.lit("")), F.lit("\n## References\nx"))
    return t.select("row_id", X.remediation_section(md).alias("section")).distinct()


def _export(kind: str, build, read, cols: list[str], sql: str):
    def run(spark, sf_dir):
        t = table(spark, sf_dir, "thirdparty_findings").select("row_id", "title", "file", "line_start", "line_end", "description").distinct().where("title IS NOT NULL AND file IS NOT NULL")
        return read(t.select(F.to_json(build()).alias("text"))).select(*cols)

    R.query(f"read_{kind}", sql)(run)


_BASE = "(SELECT DISTINCT row_id, title, file, line_start, line_end, description FROM thirdparty_findings WHERE title IS NOT NULL AND file IS NOT NULL) t"
_export("semgrep", lambda: F.struct(F.array(F.struct(
    F.col("title").alias("check_id"), F.col("file").alias("path"), F.struct(F.col("line_start").alias("line")).alias("start"), F.struct(F.col("line_end").alias("line")).alias("end"),
    F.struct(F.lit("high").alias("severity"), F.col("description").alias("message"), (F.col("row_id") % 5 == 0).alias("is_ignored"),
             F.struct(F.array(F.lit("CWE-79: x"), F.lit("CWE-80")).alias("cwe")).alias("metadata")).alias("extra"))).alias("results")),
    E.read_semgrep, ["external_id", "file", "line_start", "line_end", "cwe", "description"],
    f"SELECT concat_ws(':', title, file, '0') AS external_id, file, coalesce(line_start, 1) AS line_start, coalesce(line_end, 1) AS line_end, 'CWE-79' AS cwe, description FROM {_BASE} WHERE row_id % 5 <> 0")
_export("snyk", lambda: F.struct(F.col("file").alias("displayTargetFile"), F.array(F.struct(
    F.concat(F.lit("S-"), F.col("row_id").cast("string")).alias("id"), "title", F.lit("low").alias("severity"), F.lit("pkg").alias("packageName"), F.lit("1.0").alias("version"),
    F.struct(F.array(F.lit("CWE-22")).alias("CWE")).alias("identifiers"))).alias("vulnerabilities")),
    E.read_snyk, ["external_id", "title", "file", "cwe", "severity", "component"],
    f"SELECT 'S-' || row_id AS external_id, title, file, 'CWE-22' AS cwe, 'low' AS severity, 'pkg@1.0' AS component FROM {_BASE}")
_export("aikido", lambda: F.array(F.struct(
    F.col("row_id").alias("id"), F.col("title").alias("rule"), F.when(F.col("row_id") % 4 == 0, "License").otherwise("sast").alias("type"), F.col("file").alias("affected_file"),
    F.col("line_start").alias("start_line"), F.lit("medium").alias("severity"), F.array(F.lit("CWE-89")).alias("cwe_classes"))),
    E.read_aikido, ["external_id", "title", "file", "line_start", "cwe"],
    f"SELECT CAST(row_id AS VARCHAR) AS external_id, title, file, coalesce(line_start, 1) AS line_start, 'CWE-89' AS cwe FROM {_BASE} WHERE row_id % 4 <> 0")
_export("sonatype", lambda: F.struct(F.array(F.struct(
    F.struct(F.struct(F.lit("g").alias("groupId"), F.lit("a").alias("artifactId"), F.col("row_id").cast("string").alias("version")).alias("coordinates")).alias("componentIdentifier"),
    F.array("file").alias("pathnames"),
    F.struct(F.array(F.struct(F.lit("CVE-1").alias("reference"), (F.col("row_id") % 11).cast("double").alias("severity"), F.when(F.col("row_id") % 3 == 0, "Not Applicable").otherwise("Open").alias("status"))).alias("securityIssues")).alias("securityData"))).alias("components")),
    E.read_sonatype, ["external_id", "file", "severity"],
    f"SELECT 'g:a:' || row_id || ':CVE-1' AS external_id, file, CASE WHEN row_id % 11 >= 9 THEN 'critical' WHEN row_id % 11 >= 7 THEN 'high' WHEN row_id % 11 >= 4 THEN 'medium' WHEN row_id % 11 > 0 THEN 'low' ELSE 'info' END AS severity FROM {_BASE} WHERE row_id % 3 <> 0")
_export("sarif", lambda: F.struct(F.array(F.struct(
    F.struct(F.struct(F.array(F.struct(F.lit("r1").alias("id"), F.struct(F.array(F.lit("CWE-611")).alias("cwe")).alias("properties"))).alias("rules")).alias("driver")).alias("tool"),
    F.array(F.struct(F.lit("r1").alias("ruleId"), F.when(F.col("row_id") % 2 == 0, "error").otherwise("note").alias("level"), F.struct(F.col("title").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.coalesce("line_start", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"))).alias("results"))).alias("runs")),
    E.read_sarif, ["external_id", "file", "line_start", "cwe", "severity", "description"],
    f"SELECT 'r1:' || file || ':' || coalesce(line_start, 1) AS external_id, file, coalesce(line_start, 1) AS line_start, 'CWE-611' AS cwe, CASE WHEN row_id % 2 = 0 THEN 'high' ELSE 'low' END AS severity, title AS description FROM {_BASE}")


@q("diff_added_lines", "thirdparty_findings", "SELECT row_id AS id, file, unnest([coalesce(line_start, 1), coalesce(line_start, 1) + 2]) AS line FROM (SELECT DISTINCT row_id, file, line_start FROM thirdparty_findings WHERE file IS NOT NULL AND NOT contains(file, ' ')) t")
def _(t):
    one = t.select("row_id", "file", "line_start").distinct().where("file IS NOT NULL AND NOT contains(file, ' ')")
    n = F.coalesce("line_start", F.lit(1)).cast("string")
    diff = F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/"), F.col("file"), F.lit("\n@@ -1,2 +"), n, F.lit(",3 @@\n+one\n-gone\n same\n+two"))
    return E.diff_lines(one.select("row_id", diff.alias("d")), "row_id", "d")


# ---- graph --------------------------------------------------------------------------
_SEEDS = "SELECT DISTINCT src AS node FROM call_edges WHERE src LIKE 'src/m0.py%' OR src LIKE 'src/m5.py%'"


def _seeds(e):
    return e.where(F.col("src").startswith("src/m0.py") | F.col("src").startswith("src/m5.py")).select(F.col("src").alias("node")).distinct()


def g(name: str, body: str | None, recursive: bool = False):
    """A query over the call graph of all lineitem rows; no twin where SQL would have to list all pairs."""

    def add(f):
        sql = sql_with("call_edges", body) if body else None
        if sql and recursive:
            sql = sql.replace("WITH ", "WITH RECURSIVE ", 1)
        R.query(name, sql)(lambda spark, sf_dir: f(domain(spark, sf_dir, "call_edges")))
        return f

    return add


@g("reachable_nodes", f", r AS ({_SEEDS} UNION SELECT e.dst FROM call_edges e JOIN r ON e.src = r.node) SELECT node FROM r", True)
def _(e):
    return G.reachable(e, _seeds(e)).select("node")


@g("components", None)
def _(e):
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst"))
    return G.components(e, nodes)


@g("call_adjacency", "SELECT DISTINCT src, dst, n FROM call_edges JOIN (SELECT src, count(DISTINCT dst) AS n FROM call_edges GROUP BY 1) d USING (src)")
def _(e):
    return G.adjacency(e)


@g("taint_paths", None)
def _(e):
    """3 hops and 5 for high risk; the projection calls a node of odd number high risk."""
    risk = F.col("node").rlike("[13579]$").alias("high_risk")
    sinks = e.where(F.col("dst").contains("::f1")).select(F.col("dst").alias("node")).distinct()
    return G.shortest_taint_paths(e, _seeds(e).select("node", risk), sinks.select("node", risk)).select(F.array_join("path", ">").alias("path"))


@g("neighborhood", "SELECT src, array_to_string(list_slice(list_sort(list(DISTINCT dst)), 1, 3), ',') AS first_callees FROM call_edges GROUP BY 1")
def _(e):
    return N.first_values(e, "src", "dst", 3).select("src", F.array_join("values", ",").alias("first_callees"))


@g("file_graph", "SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT split_part(src, '::', 1) AS a, split_part(dst, '::', 1) AS b FROM call_edges) x WHERE a <> b")
def _(e):
    a, b = F.split_part("src", F.lit("::"), F.lit(1)), F.split_part("dst", F.lit("::"), F.lit(1))
    return e.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


@q("shard_packing", "scan_coverage", None)
def _(s):
    one = s.select("scan_id", F.trim("path").alias("path"), F.coalesce("n_lines", F.lit(0)).alias("loc")).dropDuplicates(["scan_id", "path"])
    return next_fit(one, "scan_id", "path", "loc", 10_000, 100)


R.query("callee_resolution")(
    lambda spark, sf_dir: G.resolve_callees(
        domain(spark, sf_dir, "call_edges").select(
            F.concat_ws(">", "src", "dst").alias("call_id"), F.split_part("src", F.lit("::"), F.lit(1)).alias("caller_file"), F.split_part("dst", F.lit("::"), F.lit(2)).alias("name")
        ),
        domain(spark, sf_dir, "call_edges").select(F.split_part("dst", F.lit("::"), F.lit(1)).alias("def_file"), F.split_part("dst", F.lit("::"), F.lit(2)).alias("name")).distinct(),
    )
)
