"""The graph projected from relational tables: ids are a type's code times ten to the tenth plus the row's key.

The statements are plain SQL that Spark and other engines read alike; {table} stands for an input table. Spark plans
them as views over Parquet scans, so that filters and column pruning reach the files.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "conversations")

_PLACE = "lower(r.r_name) || '/' || lower(n.n_name)"

SQL = {
    "nodes": f"""
SELECT CAST(10000000000 + r_regionkey AS BIGINT) AS id, lower(r_name) AS corpus, lower(r_name) AS path, 'go' AS language,
       'pkg:' || lower(r_name) AS signature, 'package' AS kind, lower(r_name) AS package, CAST(NULL AS INT) AS line, CAST(NULL AS INT) AS end_line, 0 AS test_role
FROM {{region}}
UNION ALL
SELECT CAST(20000000000 + n.n_nationkey AS BIGINT), lower(r.r_name), {_PLACE}, 'go', 'file:' || lower(n.n_name), 'file', lower(r.r_name), CAST(NULL AS INT), CAST(NULL AS INT), 0
FROM {{nation}} n JOIN {{region}} r ON n.n_regionkey = r.r_regionkey
UNION ALL
SELECT CAST(30000000000 + c_custkey AS BIGINT), lower(r.r_name), {_PLACE} || '/' || lower(c_mktsegment) || '.ts', 'typescript', 'class:' || replace(c_name, '#', '_'), 'class', lower(r.r_name),
       CAST(c_custkey % 1000 + 1 AS INT), CAST(c_custkey % 1000 + 1 + c_custkey % 50 AS INT), CAST(CASE WHEN c_custkey % 11 = 0 THEN 1 WHEN c_custkey % 13 = 0 THEN 2 ELSE 0 END AS INT)
FROM {{customer}} JOIN {{nation}} n ON c_nationkey = n.n_nationkey JOIN {{region}} r ON n.n_regionkey = r.r_regionkey
UNION ALL
SELECT CAST(40000000000 + s_suppkey AS BIGINT), lower(r.r_name), {_PLACE} || '/suppliers_test.go', 'go', 'class:' || replace(s_name, '#', '_'), 'class', lower(r.r_name),
       CAST(s_suppkey % 300 + 1 AS INT), CAST(s_suppkey % 300 + 20 AS INT), 0
FROM {{supplier}} JOIN {{nation}} n ON s_nationkey = n.n_nationkey JOIN {{region}} r ON n.n_regionkey = r.r_regionkey
UNION ALL
SELECT CAST(50000000000 + p_partkey AS BIGINT), 'parts', 'parts/' || lower(replace(p_brand, '#', '_')) || '/' || lower(p_type) || '.rs', 'rust',
       'method:' || replace(p_brand, '#', '_') || '.' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR(20)), 'method', lower(p_type), CAST(p_partkey % 500 + 1 AS INT), CAST(p_partkey % 500 + 1 + p_size AS INT), 0
FROM {{part}}
UNION ALL
SELECT CAST(60000000000 + o_orderkey AS BIGINT), lower(r.r_name), {_PLACE} || '/' || lower(c_mktsegment) || '.ts', 'typescript', 'fn:order_' || CAST(o_orderkey AS VARCHAR(20)), 'function', lower(r.r_name),
       CAST(o_orderkey % 2000 + 1 AS INT), CAST(o_orderkey % 2000 + 1 + o_orderkey % 40 AS INT), 0
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} n ON c_nationkey = n.n_nationkey JOIN {{region}} r ON n.n_regionkey = r.r_regionkey
UNION ALL
SELECT CAST(70000000000 + doc_id AS BIGINT), 'docs', source || '/' || lang || '.md', 'markdown', 'doc:' || CAST(doc_id AS VARCHAR(20)), 'doc-chunk', source, CAST(NULL AS INT), CAST(NULL AS INT), 0
FROM {{documents}}
UNION ALL
SELECT DISTINCT CAST(80000000000 + user_id AS BIGINT), 'events', 'users/app.py', 'python', 'fn:user_' || CAST(user_id AS VARCHAR(20)), 'function', 'users', CAST(user_id % 900 + 1 AS INT), CAST(user_id % 900 + 9 AS INT), 0
FROM {{events}}
UNION ALL
SELECT DISTINCT CAST(90000000000 + length(event_type) * 100 + ascii(event_type) AS BIGINT), 'events', 'types/kinds.py', 'python', 'type:' || event_type, 'type', 'types', CAST(NULL AS INT), CAST(NULL AS INT), 0
FROM {{events}}""",
    "edges": """
SELECT src, dst, kind, CASE (src + dst) % 3 WHEN 0 THEN 'tree-sitter' WHEN 1 THEN 'scip' ELSE 'live' END AS provenance,
       CASE WHEN kind = 'ref/call' THEN 'typescript' WHEN kind = 'ffi/call' THEN 'go' ELSE 'rust' END AS language, confidence
FROM (
SELECT CAST(10000000000 + n_regionkey AS BIGINT) AS src, CAST(20000000000 + n_nationkey AS BIGINT) AS dst, 'defines/binding' AS kind, CAST(NULL AS INT) AS confidence FROM {nation}
UNION ALL SELECT CAST(20000000000 + c_nationkey AS BIGINT), CAST(30000000000 + c_custkey AS BIGINT), 'defines/binding', CAST(NULL AS INT) FROM {customer}
UNION ALL SELECT CAST(20000000000 + s_nationkey AS BIGINT), CAST(40000000000 + s_suppkey AS BIGINT), 'defines/binding', CAST(NULL AS INT) FROM {supplier}
UNION ALL SELECT CAST(30000000000 + o_custkey AS BIGINT), CAST(60000000000 + o_orderkey AS BIGINT), 'exports', CAST(NULL AS INT) FROM {orders}
UNION ALL SELECT DISTINCT CAST(60000000000 + l_orderkey AS BIGINT), CAST(50000000000 + l_partkey AS BIGINT), 'ref/call', CAST(NULL AS INT) FROM {lineitem}
UNION ALL SELECT DISTINCT CAST(60000000000 + l_orderkey AS BIGINT), CAST(40000000000 + l_suppkey AS BIGINT), 'depends', CAST(NULL AS INT) FROM {lineitem} WHERE l_linenumber <= 2
UNION ALL SELECT DISTINCT CAST(40000000000 + l_suppkey AS BIGINT), CAST(50000000000 + l_partkey AS BIGINT), 'ffi/call', CAST(30 + 30 * ((l_suppkey + l_partkey) % 3) AS INT) FROM {lineitem} WHERE l_partkey % 5 = 0
UNION ALL SELECT DISTINCT CAST(80000000000 + user_id AS BIGINT), CAST(90000000000 + length(event_type) * 100 + ascii(event_type) AS BIGINT), 'ref/call', CAST(NULL AS INT) FROM {events}
UNION ALL SELECT CAST(50000000000 + p_partkey AS BIGINT), CAST(30000000000 + c_custkey AS BIGINT), 'ref/field', CAST(NULL AS INT) FROM {part} JOIN {customer} ON p_partkey = c_custkey WHERE p_partkey % 7 = 0
) AS e""",
    "edge_sites": """
SELECT CAST(60000000000 + l_orderkey AS BIGINT) AS src, CAST(50000000000 + l_partkey AS BIGINT) AS dst, 'ref/call' AS kind, l_linenumber AS line, CAST(l_suppkey % 80 AS INT) AS col FROM {lineitem}""",
}


#: Shuffled bytes that a task should read. Rows take ten times as much or more in its memory once they are sorted or grouped.
TASK_BYTES = 4 << 20
#: Bytes of files that a task should read: where it groups rows before they are shuffled, they take as much more.
SCAN_BYTES = 8 << 20
_BOUNDS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES, "spark.sql.files.maxPartitionBytes": SCAN_BYTES}


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds what a task reads where the session's own bounds are wider: by default, tasks are as few as cores until each reads 64 MB of a shuffle or 128 MB of a file, so that their memory grows with the input."""
    unit = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    for key, most in _BOUNDS.items():
        number, of = re.fullmatch(r"(\d+)([bkmgt]?)b?", spark.conf.get(key).strip().lower()).groups()
        if int(number) * unit[of] > most:
            spark.conf.set(key, f"{most}b")
    return spark


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def _of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    own = {t: df for t, df in tables(prepare(spark), sf_dir).items() if f"{{{t}}}" in SQL[name]}
    return spark.sql(SQL[name], **own)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "nodes")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "edges")


def edge_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "edge_sites")


def ctes(*names: str) -> str:
    """The projection as common table expressions over tables of their own names."""
    return ", ".join(f"{n} AS MATERIALIZED ({SQL[n].format(**{t: t for t in TABLES})})" for n in names)
