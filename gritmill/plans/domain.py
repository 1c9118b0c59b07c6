"""Projection of the star-schema tables into the domain's tables.

The texts below are the same in Spark SQL and in DuckDB: only integer arithmetic,
CASE, substr and concat. ``{lineitem}`` etc. stand for the source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gritmill.tables import table

_FILE = "concat(CASE WHEN l_partkey % 9 = 0 THEN 'src/tests/f' ELSE concat('src/m', CAST(l_partkey % 20 AS STRING), '/f') END, CAST(l_partkey AS STRING), CASE WHEN l_partkey % 4 = 0 THEN '.js' ELSE '.py' END)"
_START = "(1 + (l_orderkey * 7 + l_linenumber * 13) % 400)"

FINDINGS = f"""
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
         CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS id,
  {_FILE} AS file, {_START} AS line_start, {_START} + l_linenumber % 4 AS line_end,
  CASE (l_suppkey + l_linenumber) % 12 WHEN 0 THEN 'use-after-free' WHEN 1 THEN 'heap-overflow' WHEN 2 THEN 'stack-overflow'
    WHEN 3 THEN 'format-string' WHEN 4 THEN 'integer-overflow' WHEN 5 THEN 'type-confusion' WHEN 6 THEN 'race-condition'
    WHEN 7 THEN 'injection' WHEN 8 THEN 'unsafe-deserialization' WHEN 9 THEN 'logic-flaw' WHEN 10 THEN 'info-leak' ELSE 'other' END AS vuln_class,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CASE (l_partkey + l_linenumber) % 6 WHEN 0 THEN 'CWE-79' WHEN 1 THEN 'cwe-89' WHEN 2 THEN 'CWE-798'
    WHEN 3 THEN '22' WHEN 4 THEN 'CWE-416' ELSE 'CWE-200' END END AS cwe,
  CAST(CAST(l_quantity AS INT) % 11 AS DOUBLE) / 10e0 AS confidence,
  CAST(l_suppkey % 3 AS BIGINT) AS run, CAST(l_orderkey % 7 AS BIGINT) AS verdict_confidence,
  CASE l_orderkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity,
  CASE l_suppkey % 5 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'snyk' WHEN 2 THEN 'aikido' WHEN 3 THEN 'sonatype' ELSE 'checkmarx' END AS vendor,
  CASE l_suppkey % 4 WHEN 0 THEN 'sast' WHEN 1 THEN 'dependency' WHEN 2 THEN 'iac' ELSE 'secrets' END AS product,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE concat({_FILE}, ':', CAST({_START} AS STRING)) END AS source_ref,
  CASE WHEN l_linenumber % 5 = 0 THEN '  ' ELSE concat('./', {_FILE}, ':', CAST({_START} + 2 AS STRING)) END AS sink_ref,
  concat(CASE WHEN l_partkey % 13 = 0 THEN 'Hard-coded password in ' ELSE 'Tainted value in ' END, CAST(l_partkey AS STRING)) AS title,
  concat('CVSS:3.1/AV:', substr('NALP', CAST(1 + l_orderkey % 4 AS INT), 1), '/AC:', substr('LH', CAST(1 + l_partkey % 2 AS INT), 1),
    '/PR:', substr('NLH', CAST(1 + l_suppkey % 3 AS INT), 1), '/UI:', substr('NR', CAST(1 + l_linenumber % 2 AS INT), 1),
    '/S:', substr('UC', CAST(1 + (l_orderkey + l_linenumber) % 2 AS INT), 1), '/C:', substr('NLH', CAST(1 + l_partkey % 3 AS INT), 1),
    '/I:', substr('NLH', CAST(1 + l_orderkey % 3 AS INT), 1), '/A:', substr('NLH', CAST(1 + l_linenumber % 3 AS INT), 1)) AS cvss_vector,
  CAST(l_orderkey % 50 AS BIGINT) AS app_no, CAST(l_suppkey AS BIGINT) AS chunk_no
FROM {{lineitem}}"""

APPS = """
SELECT concat(CASE WHEN c_custkey % 3 = 0 THEN '000' ELSE '' END, CAST(c_custkey AS STRING)) AS app_id, c_name AS name,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END AS externally_facing,
  CASE WHEN c_custkey % 6 = 0 THEN '' WHEN c_acctbal > 5000 THEN 'yes' ELSE 'no' END AS pci,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_nationkey % 2 = 0 THEN 'yes' ELSE 'no' END AS pii,
  CAST(c_nationkey AS STRING) AS parent_id, c_custkey AS ord
FROM {customer}"""

EDGES = """
SELECT DISTINCT concat('src/m', CAST(l_partkey % 20 AS STRING), '.py::f', CAST(l_partkey % 97 AS STRING)) AS src,
  concat('src/m', CAST((l_partkey + l_suppkey) % 20 AS STRING), '.py::f', CAST((l_partkey * 3 + l_suppkey) % 97 AS STRING)) AS dst
FROM {lineitem}"""

SPANS = """
SELECT concat('src/m', CAST(p_partkey % 20 AS STRING), '/f', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 4 = 0 THEN '.js' ELSE '.py' END) AS file,
  concat('fn', CAST(k AS STRING)) AS function, CAST(1 + k * 40 AS BIGINT) AS span_start, CAST(1 + k * 40 + 10 + p_size % 25 AS BIGINT) AS span_end
FROM {part} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) ks"""

GATES = """
SELECT CAST(a.i * 125 + b.i * 25 + c.i * 5 + d.i AS BIGINT) AS case_id, a.s AS root_cause, b.s AS instance_coverage, c.s AS no_new_vulnerabilities, d.s AS security_best_practices
FROM (SELECT 0 AS i, 'pass' AS s UNION ALL SELECT 1, 'partial' UNION ALL SELECT 2, 'fail' UNION ALL SELECT 3, 'skip' UNION ALL SELECT 4, 'invalid') a
CROSS JOIN (SELECT 0 AS i, 'pass' AS s UNION ALL SELECT 1, 'partial' UNION ALL SELECT 2, 'fail' UNION ALL SELECT 3, 'skip' UNION ALL SELECT 4, 'invalid') b
CROSS JOIN (SELECT 0 AS i, 'pass' AS s UNION ALL SELECT 1, 'partial' UNION ALL SELECT 2, 'fail' UNION ALL SELECT 3, 'skip' UNION ALL SELECT 4, 'invalid') c
CROSS JOIN (SELECT 0 AS i, 'pass' AS s UNION ALL SELECT 1, 'partial' UNION ALL SELECT 2, 'fail' UNION ALL SELECT 3, 'skip' UNION ALL SELECT 4, 'invalid') d"""



def _letters(name: str, letters: str) -> str:
    return "(" + " UNION ALL ".join(f"SELECT '{x}' AS {name}" for x in letters) + f") t_{name}"


VECTORS = (
    "SELECT concat('CVSS:3.1/AV:', av, '/AC:', ac, '/PR:', pr, '/UI:', ui, '/S:', s, '/C:', c, '/I:', i, '/A:', a) AS cvss_vector FROM "
    + " CROSS JOIN ".join(_letters(n, x) for n, x in (("av", "NALP"), ("ac", "LH"), ("pr", "NLH"), ("ui", "NR"), ("s", "UC"), ("c", "HLN"), ("i", "HLN"), ("a", "HLN")))
)

# Two scans of the same findings: the later one misses some and has some shifted.
CURRENT = f"SELECT * FROM ({FINDINGS}) x WHERE CAST(app_no AS INT) % 3 <> 0"
BASELINE = f"SELECT * FROM ({FINDINGS}) x WHERE CAST(app_no AS INT) % 3 <> 1"

TEXTS = {
    "findings": FINDINGS, "apps": APPS, "call_edges": EDGES, "spans": SPANS, "gates": GATES, "vectors": VECTORS, "current_findings": CURRENT, "baseline_findings": BASELINE,
}
_SOURCES = ("lineitem", "customer", "part", "orders", "supplier", "nation", "events")


def domain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = TEXTS[name]
    used = {s: table(spark, sf_dir, s) for s in _SOURCES if "{" + s + "}" in text}
    return spark.sql(text, **used)


def sql_with(names: str, body: str) -> str:
    """A DuckDB statement over domain tables, given as common table expressions."""
    parts = []
    for n in names.split():
        text = TEXTS[n]
        for s in _SOURCES:
            text = text.replace("{" + s + "}", s)
        parts.append(f"{n} AS ({text})")
    return f"WITH {', '.join(parts)} {body}"
