"""Queries over findings, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritmill.functions import severity as S
from gritmill.functions import text as X
from gritmill.operators import findings as O
from gritmill.operators import ordering as N
from gritmill.plans.domain import domain, sql_with
from gritmill.plans.registry import Registry

R = Registry()

# ---- SQL pieces shared by the twins -------------------------------------------------
_V = "AV:([NALP])/AC:([LH])/PR:([NLH])/UI:([NR])/S:([UC])/C:([HLN])/I:([HLN])/A:([HLN])"


def _p(i: int) -> str:
    return f"regexp_extract(cvss_vector, '{_V}', {i})"


def _case(value: str, table: dict, otherwise: str = "NULL") -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in table.items()) + f" ELSE {otherwise} END"


_ROUND = "CASE WHEN CAST(trunc(({0}) * 100000.0::DOUBLE) AS BIGINT) % 10000 = 0 THEN CAST(trunc(({0}) * 100000.0::DOUBLE) AS BIGINT) / 100000.0::DOUBLE ELSE (CAST(trunc(({0}) * 100000.0::DOUBLE) AS BIGINT) // 10000 + 1) / 10.0::DOUBLE END"


def _cvss(src: str) -> str:
    return f"""cv1 AS (SELECT *, {_p(5)} = 'C' AS sc, {_case(_p(6), S.CIA)} AS c_, {_case(_p(7), S.CIA)} AS i_, {_case(_p(8), S.CIA)} AS a_,
      8.22::DOUBLE * {_case(_p(1), S.AV)} * {_case(_p(2), S.AC)} * CASE WHEN {_p(5)} = 'C' THEN {_case(_p(3), S.PR_CHANGED)} ELSE {_case(_p(3), S.PR_UNCHANGED)} END * {_case(_p(4), S.UI)} AS ex FROM {src}),
    cv2 AS (SELECT *, 1.0::DOUBLE - (1.0::DOUBLE - c_) * (1.0::DOUBLE - i_) * (1.0::DOUBLE - a_) AS iss FROM cv1),
    cv3 AS (SELECT *, CASE WHEN sc THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15.0::DOUBLE) ELSE 6.42::DOUBLE * iss END AS im FROM cv2),
    cv4 AS (SELECT *, CASE WHEN sc THEN least(1.08::DOUBLE * (im + ex), 10.0::DOUBLE) ELSE least(im + ex, 10.0::DOUBLE) END AS bs FROM cv3),
    scored AS (SELECT * EXCLUDE (sc, c_, i_, a_, ex, iss, im, bs), CASE WHEN im <= 0 THEN 0.0::DOUBLE ELSE {_ROUND.format('bs')} END AS score FROM cv4)"""


_RATING = "CASE WHEN score IS NULL THEN 'Unknown' WHEN score = 0 THEN 'None' WHEN score < 4 THEN 'Low' WHEN score < 7 THEN 'Medium' WHEN score < 9 THEN 'High' ELSE 'Critical' END"
_BAND = "CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' WHEN score > 0 THEN 'low' WHEN score = 0 THEN 'info' END"
_TEST = r"regexp_matches(file, '(?i)(^|/)(tests?|__tests__|mocks?|examples?|fixtures?|samples?|testdata)(/|$)|_test\.|\.test\.|\.spec\.|Test\.java$|Tests\.cs$')"
_NUM = r"TRY_CAST(nullif(regexp_extract(trim(cwe), '^(?:[cC][wW][eE]-)?(\d+)$', 1), '') AS BIGINT)"
_POINT = f"(vuln_class = 'info-leak' OR coalesce({_NUM} IN (798,259,321,256,352,1004,614,307,778,311,312,532,209), false) OR regexp_matches(title, '(?i)hard[ -]?coded|password'))"
_FLOW = "(coalesce(trim(source_ref) <> '', false) AND coalesce(trim(sink_ref) <> '', false))"
_GATE = f"CASE WHEN {_TEST} AND NOT {_POINT} THEN 'excluded: test path' WHEN confidence < 0.6::DOUBLE THEN 'unconfirmed: confidence' WHEN NOT {_POINT} AND NOT {_FLOW} THEN 'unconfirmed: evidence' END"
_REF = r"nullif(regexp_replace(replace(trim({0}), '\', '/'), '^(\./)+', ''), '')"
_SEVRANK = "CASE {0} WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 WHEN 'info' THEN 5 ELSE 0 END"
_LANG = "CASE lower(regexp_extract({0}, '\\.([^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LANGUAGES.items()) + " END"
_CLASS = r"coalesce(CASE TRY_CAST(nullif(regexp_extract(upper(trim({0})), '^CWE-(\d+)$', 1), '') AS INT) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in X.CLASS_OF_CWE.items()) + " END, 'other')"


def q(name: str, tables: str, sql: str):
    """Registers a query over domain tables: the function gets them in the order named."""

    def add(f):
        R.query(name, sql_with(tables, sql))(lambda spark, sf_dir: f(*[domain(spark, sf_dir, t) for t in tables.split()]))
        return f

    return add


# ---- lifecycle, gates, verdicts -----------------------------------------------------
@q("finding_lifecycle", "findings", f", kept AS (SELECT * FROM findings WHERE {_GATE} IS NULL), {_cvss('kept')} SELECT id, file, line_start, vuln_class, score, {_RATING} AS rating, coalesce({_BAND}, severity) AS final_severity FROM scored ORDER BY {_SEVRANK.format(f'coalesce({_BAND}, severity)')}, file, line_start, id LIMIT 20")
def _(f):
    return O.lifecycle(f)


@q("evidence_gates", "findings", f"SELECT coalesce({_GATE}, 'keep') AS verdict, count(*) AS n FROM findings GROUP BY 1")
def _(f):
    return f.groupBy(F.coalesce(O.gate_reason(), F.lit("keep")).alias("verdict")).agg(F.count("*").alias("n"))


@q("gate_kept", "findings", f"SELECT id, file, confidence FROM findings WHERE {_GATE} IS NULL")
def _(f):
    return f.where(O.gate_reason().isNull()).select("id", "file", "confidence")


@q("point_of_occurrence", "findings", f"SELECT vuln_class, count(*) AS n FROM findings WHERE {_POINT} GROUP BY 1")
def _(f):
    return f.where(O.point_of_occurrence(F.col("vuln_class"), F.col("cwe"), F.col("title"))).groupBy("vuln_class").agg(F.count("*").alias("n"))


@q("test_paths", "findings", f"SELECT file, count(*) AS n FROM findings WHERE {_TEST} GROUP BY 1")
def _(f):
    return f.where(X.is_test_path(F.col("file"))).groupBy("file").agg(F.count("*").alias("n"))


@q("path_repair", "findings", "SELECT reported, count(*) AS n, min(repaired) AS repaired FROM (SELECT regexp_extract(file, '[^/]+$') AS reported, file FROM findings) r LEFT JOIN (SELECT base, CASE WHEN min(file) = max(file) THEN min(file) END AS repaired FROM (SELECT DISTINCT file, regexp_extract(file, '[^/]+$') AS base FROM findings) d GROUP BY base) v ON v.base = r.reported GROUP BY 1")
def _(f):
    reported = f.select(F.substring_index("file", "/", -1).alias("path"))
    fixed = O.repair_paths(reported, f.select(F.col("file").alias("path")))
    return fixed.groupBy(F.col("path").alias("reported")).agg(F.count("*").alias("n"), F.min("repaired").alias("repaired"))


@q("verdict_gate", "findings", "SELECT CASE WHEN run < 2 AND verdict_confidence >= 5 THEN 'confirmed' WHEN run < 2 THEN 'unconfirmed' WHEN verdict_confidence = 0 THEN 'verify_error' ELSE 'false_positive' END AS outcome, count(*) AS n FROM findings GROUP BY 1")
def _(f):
    verdict = F.when(F.col("run") < 2, "TRUE_POSITIVE").otherwise("FALSE_POSITIVE")
    return f.groupBy(O.verdict_class(verdict, F.col("verdict_confidence"), 5).alias("outcome")).agg(F.count("*").alias("n"))


@q("verdict_parse", "findings", "SELECT id, CASE WHEN run < 2 THEN 'TRUE_POSITIVE' ELSE 'FALSE_POSITIVE' END AS verdict, least(verdict_confidence * 3, 10) AS verdict_confidence, CASE WHEN run = 1 THEN '(no reason given)' ELSE title END AS reason, cvss_vector AS cvss_found FROM findings")
def _(f):
    reply = F.concat(
        F.lit("I read the code.\nVERDICT: FALSE_POSITIVE | CONFIDENCE: 1 | REASON: draft\n"), F.lit("verdict: "), F.when(F.col("run") < 2, "true_positive").otherwise("false_positive"),
        F.lit(" | confidence: "), (F.col("verdict_confidence") * 3).cast("string"), F.lit(" | reason: "), F.when(F.col("run") == 1, " ").otherwise(F.col("title")), F.lit("\n"), F.col("cvss_vector"),
    )
    return O.parse_verdicts(f.select("id", reply.alias("reply")), "reply").select("id", "verdict", "verdict_confidence", "reason", "cvss_found")


# ---- scalar functions ---------------------------------------------------------------
@q("cvss_all", "vectors", f", {_cvss('vectors')} SELECT cvss_vector, score, {_RATING} AS rating FROM scored")
def _(v):
    return S.add_cvss(v).withColumn("rating", S.rating(F.col("score")))


@q("cvss_by_rating", "findings", f", {_cvss('findings')} SELECT {_RATING} AS rating, count(*) AS n, max(score) AS top FROM scored GROUP BY 1")
def _(f):
    s = S.add_cvss(f)
    return s.groupBy(S.rating(F.col("score")).alias("rating")).agg(F.count("*").alias("n"), F.max("score").alias("top"))


def _env_sql() -> str:
    pr = f"CASE WHEN {_p(5)} = 'C' THEN {_case(_p(3), S.PR_CHANGED)} ELSE {_case(_p(3), S.PR_UNCHANGED)} END"
    return f""", e1 AS (SELECT cvss_vector, {_p(5)} = 'C' AS sc, least(1.0::DOUBLE - (1.0::DOUBLE - 1.5::DOUBLE * {_case(_p(6), S.CIA)}) * (1.0::DOUBLE - 1.0::DOUBLE * {_case(_p(7), S.CIA)}) * (1.0::DOUBLE - 0.5::DOUBLE * {_case(_p(8), S.CIA)}), 0.915::DOUBLE) AS miss,
      8.22::DOUBLE * 0.62::DOUBLE * {_case(_p(2), S.AC)} * {pr} * {_case(_p(4), S.UI)} AS ex FROM vectors),
    e2 AS (SELECT *, CASE WHEN sc THEN 7.52::DOUBLE * (miss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(miss * 0.9731::DOUBLE - 0.02::DOUBLE, 13.0::DOUBLE) ELSE 6.42::DOUBLE * miss END AS im FROM e1),
    e3 AS (SELECT *, least(CASE WHEN sc THEN 1.08::DOUBLE * (im + ex) ELSE im + ex END, 10.0::DOUBLE) AS rw FROM e2),
    e4 AS (SELECT *, {_ROUND.format('rw')} AS mb FROM e3)
    SELECT cvss_vector, CASE WHEN im <= 0 THEN 0.0::DOUBLE ELSE {_ROUND.format('mb * (0.94::DOUBLE * 0.95::DOUBLE)')} END AS env_score FROM e4"""


@q("cvss_environmental", "vectors", _env_sql())
def _(v):
    return S.add_environmental(v, "A", "H", "M", "L")


@q("cwe_normalize", "findings", f"SELECT cwe, {_NUM} AS number, {_CLASS.format('cwe')} AS class, count(*) AS n FROM findings GROUP BY 1, 2, 3")
def _(f):
    return f.groupBy("cwe", X.cwe_number(F.col("cwe")).alias("number"), X.vuln_class(F.col("cwe")).alias("class")).agg(F.count("*").alias("n"))


@q("normalize_refs", "findings", rf"SELECT id, {_REF.format('sink_ref')} AS sink, nullif(regexp_extract({_REF.format('sink_ref')}, '^(.*):[1-9]\d*$', 1), '') AS sink_file, TRY_CAST(nullif(regexp_extract({_REF.format('sink_ref')}, '^.*:([1-9]\d*)$', 1), '') AS BIGINT) AS sink_line FROM findings")
def _(f):
    sink = X.normalize_ref(F.col("sink_ref"))
    return f.select("id", sink.alias("sink"), X.ref_file(sink).alias("sink_file"), X.ref_line(sink).alias("sink_line"))


@q("enum_normalize", "findings", "SELECT vuln_class, replace(upper(vuln_class), '-', ' ') AS written, replace(vuln_class, '-', '_') AS named, count(*) AS n FROM findings GROUP BY 1, 2, 3")
def _(f):
    written = F.translate(F.upper("vuln_class"), "-", " ")
    return f.groupBy("vuln_class", written.alias("written"), X.norm_name(written).alias("named")).agg(F.count("*").alias("n"))


@q("coerce_numbers", "findings", "SELECT id, CASE WHEN run = 0 THEN line_start ELSE -1 END AS line, CASE WHEN run = 2 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, CASE WHEN k >= 2 AND k <= 10 THEN k / 10.0::DOUBLE WHEN k >= 2 AND k <= 100 THEN k / 100.0::DOUBLE ELSE k END) END AS confidence FROM (SELECT *, CAST(line_start % 120 AS DOUBLE) AS k FROM findings) x")
def _(f):
    line = F.when(F.col("run") == 0, F.concat(F.lit(" "), F.col("line_start").cast("string"))).otherwise(F.lit("n/a"))
    conf = F.when(F.col("run") == 2, F.lit("sure")).otherwise(F.concat((F.col("line_start") % 120).cast("string"), F.when(F.col("run") == 1, "%").otherwise("")))
    return f.select("id", X.coerce_int(line, -1).alias("line"), X.coerce_confidence(conf, 0.5).alias("confidence"))


@q("top_level_dirs", "findings", "SELECT CASE WHEN instr(f, '/') > 0 THEN split_part(f, '/', 1) ELSE '(repo root)' END AS dir, count(*) AS n FROM (SELECT CASE WHEN run = 0 THEN replace(file, '/', '_') ELSE file END AS f FROM findings) x GROUP BY 1")
def _(f):
    path = F.when(F.col("run") == 0, F.translate("file", "/", "_")).otherwise(F.col("file"))
    return f.groupBy(X.top_level_dir(path).alias("dir")).agg(F.count("*").alias("n"))


@q("languages", "findings", f"SELECT {_LANG.format('file')} AS language, count(DISTINCT file) AS files FROM findings GROUP BY 1")
def _(f):
    return f.groupBy(X.language_of(F.col("file")).alias("language")).agg(F.count_distinct("file").alias("files"))


@q("app_ids", "apps", "SELECT app_id, CASE WHEN ltrim(trim(app_id), '0') = '' THEN '0' ELSE ltrim(trim(app_id), '0') END AS normal FROM apps")
def _(a):
    return a.select("app_id", X.app_id(F.col("app_id")).alias("normal"))


@q("fingerprints", "findings", "SELECT id, sha1(vuln_class || chr(0) || file || chr(0) || trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS v1, sha1(file || chr(0) || trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS v2, sha1(file || chr(0) || regexp_replace(title, '\\s+', '', 'g')) AS v3 FROM findings")
def _(f):
    return f.select(
        "id", X.fingerprint(F.col("vuln_class"), F.col("file"), X.collapsed(F.col("title"))).alias("v1"),
        X.fingerprint(F.col("file"), X.collapsed(F.col("title"))).alias("v2"), X.fingerprint(F.col("file"), F.regexp_replace("title", X.WHITE, "")).alias("v3"),
    )


@q("content_hashes", "findings", "SELECT DISTINCT file, sha256(file) AS sha256, substr(sha1(file), 1, 32) AS run_id FROM findings")
def _(f):
    return f.select("file").distinct().select("file", F.sha2("file", 256).alias("sha256"), F.left(F.sha1("file"), F.lit(32)).alias("run_id"))


@q("sarif_fields", "findings", f", {_cvss('findings')} SELECT id, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, printf('%.1f', score) AS security_severity, round(score * 10, 1) AS rank FROM scored")
def _(f):
    s = S.add_cvss(f)
    return s.select("id", S.sarif_level(F.col("severity")).alias("level"), S.security_severity(F.col("severity"), F.col("score")).alias("security_severity"), F.round(F.col("score") * 10, 1).alias("rank"))


@q("csv_export_rows", "findings", "SELECT concat_ws(',', id, CASE WHEN contains(t, ',') OR contains(t, '\"') THEN '\"' || replace(t, '\"', '\"\"') || '\"' ELSE t END, printf('%.2f', confidence)) AS line FROM (SELECT *, CASE WHEN run = 0 THEN title || ', \"x\"' ELSE title END AS t FROM findings) y")
def _(f):
    t = F.when(F.col("run") == 0, F.concat("title", F.lit(', "x"'))).otherwise(F.col("title"))
    return f.select(F.concat_ws(",", "id", X.csv_field(t), F.format_string("%.2f", "confidence")).alias("line"))


@q("markdown_cells", "findings", "SELECT id, trim(regexp_replace(replace(m, '|', '\\|'), '\\s+', ' ', 'g')) AS cell FROM (SELECT id, title || ' |' || chr(10) || '  x' AS m FROM findings) y")
def _(f):
    return f.select("id", X.md_cell(F.concat("title", F.lit(" |\n  x"))).alias("cell"))


@q("xml_escapes", "findings", "SELECT id, '&lt;a b=&quot;' || replace(title, '&', '&amp;') || '&quot;&gt; &amp; &apos;' AS escaped FROM findings")
def _(f):
    return f.select("id", X.xml_escape(F.concat(F.lit('<a b="'), F.col("title"), F.lit("\"> & '"))).alias("escaped"))


@q("url_scrub", "findings", "SELECT id, 'clone https://***@host/' || file AS scrubbed FROM findings")
def _(f):
    return f.select("id", X.scrub_url(F.concat(F.lit("clone https://bot:"), F.col("run").cast("string"), F.lit("@host/"), F.col("file"))).alias("scrubbed"))


@q("origin_keys", "findings", "SELECT id, CASE WHEN run = 2 THEN NULL ELSE lower('Git.Example.com/Team/' || vendor) END AS origin FROM findings")
def _(f):
    raw = F.when(F.col("run") == 0, F.concat(F.lit("https://me@Git.Example.com:8443/Team/"), F.col("vendor"), F.lit(".git"))).when(
        F.col("run") == 1, F.concat(F.lit("git@Git.Example.com:Team/"), F.col("vendor"), F.lit(".git"))
    )
    return f.select("id", X.origin_key(F.coalesce(raw, F.lit("file:///srv/x"))).alias("origin"))


@q("route_paths", "findings", "SELECT id, '/api/' || vendor || '/{id}' AS route FROM findings")
def _(f):
    return f.select("id", X.route_path(F.concat(F.lit("/api//"), F.col("vendor"), F.lit("/:id/?page=1#top"))).alias("route"))


@q("thousands", "findings", "SELECT vendor, format('{:,}', count(*) * 1000) AS shown FROM findings GROUP BY vendor")
def _(f):
    return f.groupBy("vendor").agg(X.with_commas(F.count("*") * 1000).alias("shown"))


@q("first_glob", "findings", "SELECT CASE WHEN regexp_matches(file, '^src/m1.*\\.py$') THEN 'src/m1*.py' WHEN regexp_matches(file, 'f[0-9]\\.js$') THEN '**/f?.js' WHEN regexp_matches(file, '^src/tests/.*$') THEN 'src/tests/*' END AS glob, count(*) AS n FROM findings GROUP BY 1")
def _(f):
    return f.groupBy(X.first_glob(F.col("file"), ["src/m1*.py", "**/f[0-9].js", "src/tests/*"]).alias("g")).agg(F.count("*").alias("n")).select(
        F.when(F.col("g") == "**/f[0-9].js", "**/f?.js").otherwise(F.col("g")).alias("glob"), "n"
    )


@q("path_scores", "findings", "SELECT id, CASE WHEN hops <= 1 THEN 1.0::DOUBLE WHEN hops = 2 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END * CASE WHEN severity = 'critical' THEN 10 ELSE 5 END / hops AS path_score FROM (SELECT id, severity, run + 1 AS hops FROM findings) x")
def _(f):
    hops = F.col("run") + 1
    conf = F.when(hops <= 1, 1.0).when(hops == 2, 0.8).otherwise(0.6)
    return f.select("id", (conf * F.when(F.col("severity") == "critical", 10).otherwise(5) / hops).alias("path_score"))


@q("span_distance", "findings", "SELECT id, greatest(line_start - 200, 200 - line_end, 0) AS distance FROM findings")
def _(f):
    return f.select("id", F.greatest(F.col("line_start") - 200, 200 - F.col("line_end"), F.lit(0).cast("bigint")).alias("distance"))


@q("money_format", "findings", "SELECT id, printf('%.4f', pico / 1000000000000.0) AS usd FROM (SELECT id, line_start * 1000000000 AS pico FROM findings) x")
def _(f):
    pico = (F.col("line_start") * 1000000000).cast("decimal(38,0)")
    return f.select("id", F.round((pico / F.lit(10**12).cast("decimal(14,0)")).cast("decimal(38,12)"), 4).cast("decimal(30,4)").cast("string").alias("usd"))


@q("final_severity", "findings", f", {_cvss('findings')} SELECT coalesce({_BAND}, severity) AS final_severity, count(*) AS n FROM scored GROUP BY 1")
def _(f):
    s = S.final_severity(F.lit(None).cast("double"), F.col("score"), F.col("severity"))
    return S.add_cvss(f).groupBy(s.alias("final_severity")).agg(F.count("*").alias("n"))


# ---- joins --------------------------------------------------------------------------
_SAME = "((coalesce(a.n = b.n, false)) OR (a.vuln_class = b.vuln_class AND (a.n IS NULL OR b.n IS NULL))) AND (abs(a.line_start - b.line_start) <= 3 OR (a.line_start <= b.line_end AND b.line_start <= a.line_end))"


@q("same_bug_links", "findings", f", c AS (SELECT file, vuln_class, {_NUM} AS n, line_start, line_end, min(id) AS id, count(*) AS members FROM findings GROUP BY 1, 2, 3, 4, 5) SELECT greatest(a.id, b.id) AS later, least(a.id, b.id) AS earlier, CASE WHEN a.id > b.id THEN a.members ELSE b.members END AS later_members, CASE WHEN a.id > b.id THEN b.members ELSE a.members END AS earlier_members FROM c a JOIN c b ON a.file = b.file AND a.id < b.id AND {_SAME}")
def _(f):
    """Links between findings that differ; the copies of one place and weakness are counted in its class (same_bug_classes)."""
    return O.near_candidates(O.same_place(f), 3)


@q("same_bug_classes", "findings", f"SELECT id, min(id) OVER (PARTITION BY file, vuln_class, {_NUM}, line_start, line_end) AS class_id FROM findings")
def _(f):
    keys = ["file", "vuln_class", "n", "line_start", "line_end"]
    c = O.same_place(f).select(*keys, F.col("ord").alias("class_id"))
    mine = f.withColumn("n", X.cwe_number(F.col("cwe"))).select("id", *keys)
    return O.with_class(mine, c, keys).select("id", "class_id")


@q("span_functions", "findings spans", "SELECT f.id, count(s.function) AS functions, min(s.function) AS first_function FROM findings f LEFT JOIN spans s ON s.file = f.file AND s.span_start <= f.line_end AND f.line_start <= s.span_end GROUP BY f.id")
def _(f, s):
    width = 64
    spans = s.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("span_start") / width), F.floor(F.col("span_end") / width))))
    mine = f.select("id", "file", "line_start", "line_end").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("line_start") / width), F.floor(F.col("line_end") / width))))
    hit = mine.join(spans, ["file", "bucket"]).where((F.col("span_start") <= F.col("line_end")) & (F.col("line_start") <= F.col("span_end")))
    per = hit.groupBy("id").agg(F.count_distinct("function").alias("functions"), F.min("function").alias("first_function"))
    return f.select("id").join(per, "id", "left").select("id", F.coalesce("functions", F.lit(0).cast("bigint")).alias("functions"), "first_function")


@q("cmdb_parent_fallback", "apps", "SELECT c.app_id, coalesce(nullif(c.externally_facing, ''), p.externally_facing) AS externally_facing, coalesce(nullif(c.pci, ''), p.pci) AS pci, coalesce(nullif(c.pii, ''), p.pii) AS pii FROM (SELECT *, coalesce(nullif(ltrim(app_id, '0'), ''), '0') AS k FROM apps) c LEFT JOIN (SELECT *, coalesce(nullif(ltrim(app_id, '0'), ''), '0') AS k FROM apps) p ON p.k = c.parent_id AND p.k <> c.k")
def _(a):
    c = a.withColumn("k", X.app_id(F.col("app_id")))
    flags = ["externally_facing", "pci", "pii"]
    p = c.select(F.col("k").alias("pk"), *[F.col(x).alias("p_" + x) for x in flags])
    j = c.join(p, (F.col("pk") == F.col("parent_id")) & (F.col("pk") != F.col("k")), "left")
    return j.select("app_id", *[F.coalesce(F.nullif(F.col(x), F.lit("")), F.col("p_" + x)).alias(x) for x in flags])


@q("compliance_matches", "findings", f"SELECT r.req, count(*) AS n FROM findings f JOIN (SELECT 'R1' AS req, 79 AS num, 'injection' AS cls UNION ALL SELECT 'R2', 798, 'info-leak' UNION ALL SELECT 'R3', 416, 'use-after-free') r ON {_NUM} = r.num OR f.vuln_class = r.cls GROUP BY 1")
def _(f):
    policy = [("R1", 79, "injection"), ("R2", 798, "info-leak"), ("R3", 416, "use-after-free")]
    n = X.cwe_number(F.col("cwe"))
    hits = F.array_compact(F.array(*[F.when(F.coalesce(n == c, F.lit(False)) | (F.col("vuln_class") == k), r) for r, c, k in policy]))
    return f.select(F.explode(hits).alias("req")).groupBy("req").agg(F.count("*").alias("n"))


@q("diff_scope_split", "findings", "SELECT CASE WHEN f.file IN (SELECT file FROM findings WHERE line_start < 20) THEN 'in_scope' ELSE 'out_of_diff_scope' END AS scope, count(*) AS n FROM findings f GROUP BY 1")
def _(f):
    scope = f.where("line_start < 20").select("file").distinct().withColumn("hit", F.lit(True))
    return f.join(scope, "file", "left").groupBy(F.when(F.col("hit"), "in_scope").otherwise("out_of_diff_scope").alias("scope")).agg(F.count("*").alias("n"))


@q("baseline_exact_tiers", "current_findings baseline_findings", ", c AS (SELECT id, file || '#' || title AS v1, row_number() OVER (PARTITION BY file || '#' || title ORDER BY id) AS k FROM current_findings), b AS (SELECT id, file || '#' || title AS v1, row_number() OVER (PARTITION BY file || '#' || title ORDER BY id) AS k FROM baseline_findings) SELECT c.id AS cur, b.id AS base FROM c JOIN b USING (v1, k)")
def _(c, b):
    key = F.concat("file", F.lit("#"), "title")
    m = O.tiered_match(c.select(F.col("id").alias("cur"), key.alias("v1")), b.select(F.col("id").alias("base"), key.alias("v1")), ["v1"])
    return m.select("cur", "base")


@q("baseline_tally", "current_findings baseline_findings", "SELECT 'unchanged' AS state, count(*) AS n FROM current_findings c WHERE id IN (SELECT id FROM baseline_findings) UNION ALL SELECT 'new', count(*) FROM current_findings WHERE id NOT IN (SELECT id FROM baseline_findings) UNION ALL SELECT 'resolved', count(*) FROM baseline_findings WHERE id NOT IN (SELECT id FROM current_findings)")
def _(c, b):
    j = c.select(F.col("id"), F.lit(1).alias("c")).join(b.select("id", F.lit(1).alias("b")), "id", "full")
    state = F.when(F.col("c").isNull(), "resolved").when(F.col("b").isNull(), "new").otherwise("unchanged")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@q("baseline_absent", "current_findings baseline_findings", "SELECT id, file FROM baseline_findings WHERE id NOT IN (SELECT id FROM current_findings)")
def _(c, b):
    return b.join(c, "id", "left_anti").select("id", "file")


# ---- aggregates ---------------------------------------------------------------------
@q("provider_digest", "findings", "SELECT 'vendor' AS facet, vendor AS value, count(*) AS n FROM findings GROUP BY 2 UNION ALL SELECT 'product', product, count(*) FROM findings GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM findings GROUP BY 2 UNION ALL SELECT 'class', vuln_class, count(*) FROM findings GROUP BY 2")
def _(f):
    return O.digest(f.withColumn("sev", F.coalesce(F.lower(F.trim("severity")), F.lit("unknown"))))


@q("hotspots", "findings", "SELECT split_part(file, '/', 1) || '/' || split_part(file, '/', 2) AS path, count(*) AS n FROM findings WHERE product <> 'dependency' GROUP BY 1 ORDER BY n DESC, path LIMIT 10")
def _(f):
    return O.hotspots(f.withColumn("file", F.concat(F.regexp_replace(F.substring_index("file", "/", 2), "/", "~"), F.lit("/x")))).withColumn("path", F.regexp_replace("path", "~", "/"))


@q("dependency_alerts", "findings", f"SELECT file, title, severity FROM (SELECT *, row_number() OVER (PARTITION BY file, title ORDER BY id) AS k FROM findings WHERE product = 'dependency') x WHERE k = 1 ORDER BY {_SEVRANK.format('severity')}, file, title LIMIT 25")
def _(f):
    first = f.where("product = 'dependency'").groupBy("file", "title").agg(F.min_by("severity", "id").alias("severity"))
    return first.orderBy(S.severity_rank(F.col("severity")), "file", "title").limit(25)


@q("executive_counts", "findings", "SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (run < 2) AS tp, CASE WHEN count(*) = 0 THEN 0 ELSE round(count(*) FILTER (run < 2) * 1000 // count(*), 0) / 10.0::DOUBLE END AS precision_pct FROM findings")
def _(f):
    n, tp = F.count("*"), F.count_if(F.col("run") < 2)
    return f.agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), tp.alias("tp"),
                 F.when(n == 0, 0.0).otherwise(F.floor(tp * 1000 / n) / 10.0).alias("precision_pct"))


@q("severity_by_vendor", "findings", "SELECT vendor, severity, count(*) AS n, count(DISTINCT file) AS files FROM findings GROUP BY 1, 2")
def _(f):
    return f.groupBy("vendor", "severity").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


@q("language_majority", "findings", f"SELECT language FROM (SELECT {_LANG.format('file')} AS language, count(*) AS n, min(id) AS first FROM findings GROUP BY 1) x ORDER BY n DESC, first LIMIT 1")
def _(f):
    per = f.groupBy(X.language_of(F.col("file")).alias("language")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return per.orderBy(F.desc("n"), "first").limit(1).select("language")


@q("folder_set", "findings", "SELECT DISTINCT regexp_replace(file, '/[^/]*$', '') AS folder FROM findings UNION SELECT '.'")
def _(f):
    return f.select(F.regexp_replace("file", "/[^/]*$", "").alias("folder")).union(f.sparkSession.range(1).select(F.lit("."))).distinct()


@q("chunk_kinds", "findings", "SELECT CASE WHEN product = 'secrets' THEN 'specialist' WHEN product = 'iac' THEN 'catchall' ELSE 'risk' END AS kind, count(DISTINCT chunk_no) AS chunks FROM findings GROUP BY 1")
def _(f):
    chunk = F.when(F.col("product") == "iac", F.concat(F.lit("catchall-"), F.col("chunk_no").cast("string"))).otherwise(F.concat(F.lit("c-"), F.col("chunk_no").cast("string")))
    kind = F.when(F.col("product") == "secrets", "specialist").when(chunk.startswith("catchall-"), "catchall").otherwise("risk")
    return f.groupBy(kind.alias("kind")).agg(F.count_distinct("chunk_no").alias("chunks"))


@q("case_rollup", "findings", "SELECT severity AS state, CASE WHEN run = 0 THEN 'Validated' WHEN run = 1 THEN 'Failed' ELSE 'Open' END AS decision, count(*) AS n FROM findings GROUP BY 1, 2")
def _(f):
    decision = F.when(F.col("run") == 0, "Validated").when(F.col("run") == 1, "Failed").otherwise("Open")
    return f.groupBy(F.col("severity").alias("state"), decision.alias("decision")).agg(F.count("*").alias("n"))


@q("not_remediated", "findings", "SELECT file FROM findings GROUP BY file HAVING NOT bool_or(run = 0) AND bool_or(run = 1)")
def _(f):
    return f.groupBy("file").agg(F.bool_or(F.col("run") == 0).alias("ok"), F.bool_or(F.col("run") == 1).alias("failed")).where("NOT ok AND failed").select("file")


@q("origin_vote_ambiguity", "findings", "SELECT vendor, file, line_start, title FROM findings GROUP BY 1, 2, 3, 4 HAVING count(*) = 1")
def _(f):
    return f.groupBy("vendor", "file", "line_start", "title").agg(F.count("*").alias("n")).where("n = 1").drop("n")


@q("exact_range_clusters", "findings", f"SELECT file, line_start, line_end, min(id) AS root, count(*) AS members, count(DISTINCT {_NUM}) AS cwes FROM findings GROUP BY 1, 2, 3 HAVING count(*) > 1")
def _(f):
    g = f.groupBy("file", "line_start", "line_end").agg(F.min("id").alias("root"), F.count("*").alias("members"), F.count_distinct(X.cwe_number(F.col("cwe"))).alias("cwes"))
    return g.where("members > 1")


@q("sarif_rules", "findings", "SELECT vuln_class AS rule, min(id) AS first_seen, arg_min(title, id) AS description FROM findings GROUP BY 1")
def _(f):
    return f.groupBy(F.col("vuln_class").alias("rule")).agg(F.min("id").alias("first_seen"), F.min_by("title", "id").alias("description"))


# ---- order, windows, top-k ----------------------------------------------------------
@q("canonical_order", "findings", rf"SELECT id, row_number() OVER (ORDER BY CASE WHEN coalesce({_REF.format('source_ref')} IS NOT NULL AND regexp_replace({_REF.format('sink_ref')}, ':[^:]*$', '') = file, false) THEN 0 ELSE 1 END, file, line_start, {_SEVRANK.format('severity')}, vuln_class, CASE WHEN {_NUM} IS NULL THEN 2 WHEN {_NUM} IN (20,74,200,284,285,664,682,691,693,697,703,707,710) THEN 1 ELSE 0 END, coalesce({_NUM}, 4294967295), verdict_confidence DESC, confidence DESC, title, id) AS idx FROM findings")
def _(f):
    ordered = f.select("id", "file", "line_start", "severity", "vuln_class", "cwe", "verdict_confidence", "confidence", "title", "source_ref", "sink_ref")
    return N.number_rows(ordered, O.canonical_order()).select("id", "idx")


@q("report_order_top", "findings", f"SELECT id, severity, file, line_start FROM findings ORDER BY {_SEVRANK.format('severity')}, file, line_start, id LIMIT 100")
def _(f):
    return f.orderBy(S.severity_rank(F.col("severity")), "file", "line_start", "id").limit(100).select("id", "severity", "file", "line_start")


@q("top_by_cvss", "findings", f", {_cvss('findings')} SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 20")
def _(f):
    return S.add_cvss(f.select("id", "cvss_vector")).select("id", "score").orderBy(F.desc("score"), "id").limit(20)


@q("top_per_file", "findings", "SELECT id, file, k FROM (SELECT id, file, row_number() OVER (PARTITION BY file ORDER BY confidence DESC, id) AS k FROM findings) x WHERE k <= 3")
def _(f):
    k = F.row_number().over(W.partitionBy("file").orderBy(F.desc("confidence"), "id"))
    return f.withColumn("k", k.cast("bigint")).where("k <= 3").select("id", "file", "k")


@q("round_robin_reps", "findings", "SELECT file, rn FROM (SELECT file, row_number() OVER (PARTITION BY d ORDER BY file) AS rn, d FROM (SELECT DISTINCT file, regexp_replace(file, '/[^/]*$', '') AS d FROM findings) x) y ORDER BY rn, d, file LIMIT 12")
def _(f):
    files = f.select("file", F.regexp_replace("file", "/[^/]*$", "").alias("d")).distinct()
    rn = files.withColumn("rn", F.row_number().over(W.partitionBy("d").orderBy("file")).cast("bigint"))
    return rn.orderBy("rn", "d", "file").limit(12).select("file", "rn")


@q("total_char_cap", "findings", "SELECT id, least(len, greatest(0, 2000 - (run_total - len))) AS kept FROM (SELECT id, CAST(length(title) AS BIGINT) AS len, CAST(sum(length(title)) OVER (PARTITION BY chunk_no ORDER BY id) AS BIGINT) AS run_total FROM findings) x WHERE run_total - len < 2000")
def _(f):
    return N.running_cap(f.select("id", "chunk_no", F.length("title").cast("bigint").alias("len")), "chunk_no", "id", "len", 2000).select("id", "kept")


@q("nearest_sink_member", "findings", "SELECT file, arg_min(id, (abs(line_start - 200), id)) AS representative FROM findings GROUP BY 1")
def _(f):
    return f.groupBy("file").agg(F.min_by("id", F.struct(F.abs(F.col("line_start") - 200), F.col("id"))).alias("representative"))


@q("index_remap", "findings", "SELECT id, CASE WHEN keep THEN row_number() OVER (PARTITION BY vendor, keep ORDER BY id) END AS new_pos FROM (SELECT id, vendor, confidence >= 0.6::DOUBLE AS keep FROM findings) x")
def _(f):
    k = f.select("id", "vendor", (F.col("confidence") >= 0.6).alias("keep"))
    return N.place_in_group(k, ["vendor", "keep"], F.col("id"), "pos").select("id", F.when(F.col("keep"), F.col("pos")).alias("new_pos"))


# ---- sets ---------------------------------------------------------------------------
@q("distinct_origins", "findings", "SELECT DISTINCT vendor, product, severity FROM findings")
def _(f):
    return f.select("vendor", "product", "severity").dropDuplicates()


@q("refs_introduced", "current_findings baseline_findings", "SELECT file, title FROM current_findings EXCEPT ALL SELECT file, title FROM baseline_findings")
def _(c, b):
    return c.select("file", "title").exceptAll(b.select("file", "title"))


@q("reachable_union", "findings", "SELECT file FROM findings WHERE line_start < 50 UNION SELECT file FROM findings WHERE line_end > 350")
def _(f):
    return f.where("line_start < 50").select("file").union(f.where("line_end > 350").select("file")).distinct()


# ---- fix scoring --------------------------------------------------------------------
_G = ["root_cause", "instance_coverage", "no_new_vulnerabilities", "security_best_practices"]
_W = {g: S.GATE_WEIGHTS[g] for g in _G}
_EARN = " + ".join(f"CASE {g} WHEN 'pass' THEN {_W[g]}::DOUBLE WHEN 'partial' THEN {_W[g]}::DOUBLE * 0.5::DOUBLE ELSE 0.0::DOUBLE END" for g in _G)
_ACT = " + ".join(f"CASE WHEN {g} = 'skip' THEN 0.0::DOUBLE ELSE {_W[g]}::DOUBLE END" for g in _G)
_CRIT = "(root_cause IN ('partial', 'fail') OR no_new_vulnerabilities IN ('partial', 'fail'))"


@q("fix_scores", "gates", f"SELECT case_id, s AS raw_score, {_CRIT} AS has_critical_failure, CASE WHEN s IS NULL THEN 'Unverifiable' WHEN s >= 0.8::DOUBLE AND NOT {_CRIT} THEN 'Fixed' WHEN s >= 0.5::DOUBLE THEN 'Partially Fixed' ELSE 'Not Fixed' END AS verdict FROM (SELECT *, CASE WHEN {_ACT} > 0 THEN CAST(printf('%.4f', least(({_EARN}) / ({_ACT}), 1.0::DOUBLE)) AS DOUBLE) END AS s FROM gates) x")
def _(g):
    gates = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("status")) for n in _G])
    s = g.withColumn("raw_score", S.round4_exact(S.fix_score(gates)))
    crit = F.col("root_cause").isin("partial", "fail") | F.col("no_new_vulnerabilities").isin("partial", "fail")
    verdict = F.when(F.col("raw_score").isNull(), "Unverifiable").when((F.col("raw_score") >= S.FIXED_AT) & ~crit, "Fixed").when(F.col("raw_score") >= S.PARTIAL_AT, "Partially Fixed").otherwise("Not Fixed")
    return s.select("case_id", "raw_score", crit.alias("has_critical_failure"), verdict.alias("verdict"))


@q("gate_shape_errors", "gates", "SELECT case_id, concat_ws(',', CASE WHEN instance_coverage = 'invalid' THEN 'instance_coverage' END, CASE WHEN no_new_vulnerabilities = 'invalid' THEN 'no_new_vulnerabilities' END, CASE WHEN root_cause = 'invalid' THEN 'root_cause' END, CASE WHEN security_best_practices = 'invalid' THEN 'security_best_practices' END) AS missing FROM gates")
def _(g):
    provided = F.array_compact(F.array(*[F.when(F.col(n) != "invalid", F.lit(n)) for n in _G]))
    return g.select("case_id", F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(n) for n in _G]), provided)), ",").alias("missing"))


@q("persona_synthesis", "findings", ", p AS (SELECT file, vendor AS persona, max(CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS worst FROM findings GROUP BY 1, 2), c AS (SELECT file, worst, count(*) AS n FROM p WHERE worst > 0 GROUP BY 1, 2), m AS (SELECT file, worst, n, rank() OVER (PARTITION BY file ORDER BY n DESC) AS k FROM c) SELECT file, max(worst) AS status, CASE WHEN count(*) > 1 THEN 'SPLIT' ELSE 'HIGH' END AS confidence FROM m WHERE k = 1 GROUP BY 1")
def _(f):
    worth = F.when(F.col("severity").isin("critical", "high"), 3).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 1).otherwise(0)
    per = f.groupBy("file", F.col("vendor").alias("persona")).agg(F.max(worth).alias("worst")).where("worst > 0")
    counts = per.groupBy("file", "worst").agg(F.count("*").alias("n"))
    top = counts.withColumn("k", F.rank().over(W.partitionBy("file").orderBy(F.desc("n")))).where("k = 1")
    return top.groupBy("file").agg(F.max("worst").alias("status"), F.when(F.count("*") > 1, "SPLIT").otherwise("HIGH").alias("confidence"))


R.query("vote_clusters")(lambda spark, sf_dir: O.cluster_votes(domain(spark, sf_dir, "findings")))
