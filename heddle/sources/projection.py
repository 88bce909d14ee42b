"""An archive made of the driver's star-schema tables, so that every operator has rows to work on.

Each table is one SELECT that Spark and DuckDB both read; `{name}` stands for a source table. Every row of a source table is
projected: each order is a revision, each line an object and a staged object, each event an activity, a write and a log stream,
too. What not every row has by nature are second parents (merges), mesh references and second references of events. A few rows
are made wrong on purpose (unknown parents, cycles, repeated keys, mismatches), by arithmetic on their keys, so that every check
finds some.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..model import TABLES, Archive, Config, columns

CONFIG = Config(shared="ns0")
_NS = "l_partkey % 25"
_OBJECT = """
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity AS bigint) AS qty,
         l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ordinal
  FROM {lineitem}"""

SQL = {
    "objects": f"""
SELECT 'obj-' || l_partkey AS object_id, 'rev-' || l_orderkey AS revision_id,
  CASE WHEN ordinal % 11 = 0 THEN NULL ELSE md5('c/' || l_partkey || '/' || qty) END AS content_id,
  CASE WHEN l_orderkey % 3 = 0 THEN 'run-' || l_suppkey END AS run_id,
  'ns' || ({_NS}) AS ns_id,
  CASE WHEN ordinal % 701 = 0 THEN 'uuid-other' WHEN l_linenumber = 1 THEN '' ELSE 'uuid-' || ({_NS}) END AS ns_uuid,
  CASE WHEN l_linenumber = 2 THEN '' ELSE 'Namespace ' || ({_NS}) END AS ns_display,
  CASE WHEN ordinal % 503 = 0 THEN 'other/k1' WHEN ordinal % 809 = 0 THEN 'ns0/core' ELSE 'ns' || ({_NS}) || '/k' || (l_partkey % 7) END AS kind,
  CASE WHEN ordinal % 607 = 0 THEN 'other' ELSE 'ns' || ({_NS}) END AS schema_ns,
  'k' || (l_partkey % 7) AS schema_id, 'v' || (l_suppkey % 3) AS schema_version,
  CASE WHEN l_linenumber < 4 THEN 'env-' || (l_suppkey % 6) END AS software_environment,
  CASE WHEN l_linenumber > 2 THEN 'ctx-' || (l_suppkey % 6) END AS execution_context,
  ordinal
FROM ({_OBJECT}) x""",
    "refs": f"""
SELECT ordinal AS owner, 'obj-' || l_partkey AS object_id, 'rev-' || l_orderkey AS revision_id, 'previous' AS name,
  'obj-' || l_partkey AS target_object, 'rev-' || previous AS target_revision, cast(0 AS bigint) AS pos
FROM (SELECT *, lag(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY ordinal) AS previous FROM ({_OBJECT}) x) y WHERE previous IS NOT NULL
UNION ALL
SELECT ordinal, 'obj-' || l_partkey, 'rev-' || l_orderkey, CASE WHEN ordinal % 409 = 0 THEN 'previous' ELSE 'mesh' END,
  CASE WHEN ordinal % 307 = 0 THEN 'obj-none' ELSE 'obj-' || ((l_partkey * 7) % 2000 + 1) END, cast(NULL AS string), cast(1 AS bigint)
FROM ({_OBJECT}) x WHERE qty % 2 = 0""",
    "revisions": """
SELECT 'rev-' || o_orderkey AS revision_id, CASE WHEN o_orderkey % 3 = 0 THEN 'run-' || o_custkey WHEN o_orderkey % 401 = 0 THEN 'run-none' END AS run_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'plan-' || (o_orderkey % 7) END AS plan_id, o_orderkey * 10 AS ordinal FROM {orders}
UNION ALL
SELECT 'rev-' || o_orderkey, NULL, 'plan-again', o_orderkey * 10 + 1 FROM {orders} WHERE o_orderkey % 1499 = 7
UNION ALL
SELECT 'rev-loop-' || n_nationkey, NULL, NULL, -100 + n_nationkey FROM {nation} WHERE n_nationkey < 4""",
    "edges": """
SELECT 'rev-' || o_orderkey AS child, 'rev-' || previous AS parent, cast(0 AS bigint) AS pos
FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM {orders}) x WHERE previous IS NOT NULL
UNION ALL
SELECT 'rev-' || o_orderkey, 'rev-' || other, cast(1 AS bigint)
FROM (SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey - o_custkey % 2 ORDER BY o_orderdate, o_orderkey) AS other,
             lag(o_custkey) OVER (PARTITION BY o_custkey - o_custkey % 2 ORDER BY o_orderdate, o_orderkey) AS owner FROM {orders}) x
WHERE o_orderkey % 5 = 0 AND owner <> o_custkey
UNION ALL
SELECT 'rev-' || o_orderkey, 'rev-none-' || o_orderkey, cast(2 AS bigint) FROM {orders} WHERE o_orderkey % 997 = 3
UNION ALL
SELECT 'rev-loop-' || n_nationkey, 'rev-loop-' || ((n_nationkey + 1) % 3), cast(0 AS bigint) FROM {nation} WHERE n_nationkey < 4""",
    "heads": """
SELECT 'head-' || (o_custkey - CASE WHEN o_custkey % 307 = 0 THEN 1 ELSE 0 END) AS head_id,
  'branch-' || (o_custkey - CASE WHEN o_custkey % 211 = 0 THEN 1 ELSE 0 END) AS name,
  CASE WHEN o_custkey % 193 = 0 THEN 'rev-none' ELSE 'rev-' || o_orderkey END AS revision_id, o_custkey AS ordinal
FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM {orders}) x WHERE n = 1""",
    "runs": """
SELECT 'run-' || c_custkey AS run_id, CASE WHEN c_custkey % 2 = 0 THEN 'plan-' || (c_custkey % 7) END AS plan_id,
  CASE WHEN c_custkey % 97 = 0 THEN 'run-' || c_custkey WHEN c_custkey % 89 = 0 THEN 'run-none' WHEN c_custkey % 4 = 0 THEN 'run-' || cast(c_custkey / 4 AS bigint) END AS parent_run_id,
  CASE WHEN c_custkey % 83 = 0 THEN 'rev-none' WHEN c_custkey % 2 = 0 THEN 'rev-' || o_orderkey END AS revision_id,
  CASE WHEN c_custkey % 13 = 0 THEN 'uncertain' WHEN c_custkey % 11 = 0 THEN 'failed' WHEN c_custkey % 7 = 0 THEN 'interrupted' WHEN c_custkey % 5 = 0 THEN 'running' ELSE 'completed' END AS status,
  CASE WHEN c_custkey % 3 > 0 THEN 'env-' || (c_custkey % 6) END AS software_environment, CASE WHEN c_custkey % 4 > 0 THEN 'ctx-' || (c_custkey % 6) END AS execution_context,
  'agent-' || (c_custkey % 9) AS agent_id, c_custkey % 3 < 2 AS restart_declared,
  CASE WHEN c_custkey % 3 = 0 THEN 'ctx-' || (c_custkey % 5) END AS restart_context, CASE WHEN c_custkey % 6 = 1 THEN 'act-' || (c_custkey * 10) END AS restart_activity, c_custkey AS ordinal
FROM {customer} LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM {orders} GROUP BY o_custkey) o ON o_custkey = c_custkey
UNION ALL
SELECT 'run-' || c_custkey, NULL, NULL, NULL, 'completed', NULL, NULL, NULL, false, NULL, NULL, c_custkey + 1000000000 FROM {customer} WHERE c_custkey % 401 = 0""",
    "checkpoints": """
SELECT 'run-' || o_custkey AS run_id, CASE WHEN o_orderkey % 17 = 0 THEN 'obj-none' ELSE 'obj-' || l_partkey END AS object_id,
  CASE WHEN o_orderkey % 3 = 0 THEN md5('c/' || l_partkey || '/' || qty) WHEN o_orderkey % 3 = 1 THEN 'content-other' END AS content_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'rev-' || o_orderkey END AS revision_id, 'state' AS kind, o_orderkey * 10 + n AS pos
FROM (SELECT o_custkey, o_orderkey, l_partkey, cast(l_quantity AS bigint) AS qty,
             row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n
      FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey) x""",
    "activities": """
SELECT 'run-' || user_id AS run_id, CASE WHEN event_id % 1000 = 0 THEN 'act-again' ELSE 'act-' || event_id END AS activity_id,
  CASE WHEN event_id % 170 = 0 THEN 'run-none' ELSE 'run-' || user_id END AS declared_run_id, event_type AS operation,
  CASE WHEN event_id % 20 = 0 THEN 'key-' || event_id END AS idempotency_key,
  CASE WHEN event_id % 30 = 0 THEN 'reused' WHEN event_id % 70 = 0 THEN 'forced' ELSE 'computed' END AS reuse, event_id AS ordinal
FROM {events}""",
    "activity_refs": """
SELECT 'run-' || user_id AS run_id, 'act-' || event_id AS activity_id, CASE WHEN event_id % 20 = 0 THEN 'used' ELSE 'generated' END AS direction, 'input' AS name,
  CASE WHEN event_id % 130 = 0 THEN 'obj-none' ELSE 'obj-' || ((event_id * 13) % 2000 + 1) END AS object_id, cast(NULL AS string) AS revision_id, cast(0 AS bigint) AS pos
FROM {events} WHERE event_id % 1000 <> 0""",
    "staged": f"""
SELECT 'run-' || o_custkey AS run_id, 'obj-' || l_partkey AS object_id,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_orderkey % 7 = 0 THEN 'content-other' ELSE md5('c/' || l_partkey || '/' || qty) END AS content_id,
  'ns' || ({_NS}) AS ns_id, 'uuid-' || ({_NS}) AS ns_uuid, '' AS ns_display, CASE WHEN x.ordinal % 67 = 0 THEN 'other/k1' ELSE 'ns' || ({_NS}) || '/k' || (l_partkey % 7) END AS kind,
  CASE WHEN x.ordinal % 71 = 0 THEN 'other' ELSE 'ns' || ({_NS}) END AS schema_ns, 'k' || (l_partkey % 7) AS schema_id, 'v1' AS schema_version,
  cast(NULL AS string) AS software_environment, cast(NULL AS string) AS execution_context, CASE WHEN l_orderkey % 2 = 0 THEN 'reused' ELSE 'generated' END AS origin,
  CASE WHEN l_orderkey % 2 = 0 AND l_orderkey % 8 > 0 THEN 'rev-' || (l_orderkey - CASE WHEN l_orderkey % 6 = 0 THEN 1 ELSE 0 END) END AS source_revision_id,
  CASE WHEN l_orderkey % 9 = 0 THEN 'act-' || (l_orderkey * 10) END AS activity_id, x.ordinal
FROM ({_OBJECT}) x JOIN {{orders}} ON o_orderkey = l_orderkey""",
    "events": """
SELECT event_type AS kind, CASE WHEN event_id % 601 = 0 THEN 'run-none' ELSE 'run-' || user_id END AS run_id,
  CASE WHEN event_id % 10 = 0 THEN CASE WHEN event_id % 90 = 0 THEN 'act-none' ELSE 'act-' || event_id END END AS activity_id,
  CASE WHEN event_id % 8 > 0 THEN cast((event_id - event_id % 2) / 2 AS bigint) % 40 END AS sequence,
  CASE WHEN event_id % 4 > 0 THEN 'rank-' || (event_id % 4) END AS source,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 5 = 0 THEN 'warn' WHEN event_id % 5 = 1 THEN 'debug' ELSE 'info' END AS severity,
  CASE WHEN event_id % 499 = 0 THEN 'Authorization: Bearer abcdefghij0123456789ABCDEF' WHEN event_id % 503 = 0 THEN 'key sk-abcdefghij0123456789' ELSE event_type || ' of ' || user_id END AS message,
  cast(NULL AS string) AS timestamp, CASE WHEN event_id % 3 = 0 THEN 'run' END AS scope, CASE WHEN event_id % 6 = 0 THEN CASE WHEN event_id % 84 = 0 THEN 'rev-none' ELSE 'rev-' || event_id END END AS revision_id,
  'producer-' || (event_id % 3) AS producer_id, 'ctx-' || (event_id % 6) AS execution_context,
  CASE WHEN event_id % 4 = 0 THEN 'ephemeral' WHEN event_id % 4 = 1 THEN 'debug' WHEN event_id % 4 = 2 THEN 'forensic' ELSE 'pinned' END AS retention, event_id AS ordinal
FROM {events}""",
    "event_refs": """
SELECT event_id AS event, CASE WHEN event_id % 91 = 0 THEN 'obj-none' ELSE 'obj-' || ((event_id * 3) % 2000 + 1) END AS object_id, cast(NULL AS string) AS revision_id, cast(0 AS bigint) AS pos FROM {events}
UNION ALL
SELECT event_id, 'obj-' || ((event_id * 3) % 2000 + 1), 'rev-' || event_id, cast(1 AS bigint) FROM {events} WHERE event_id % 21 = 0""",
    "event_payload": """
SELECT event_id AS event, CASE WHEN event_id % 97 = 0 THEN 'API_Key' WHEN event_id % 101 = 0 THEN 'myToken' ELSE 'detail' END AS key, CASE WHEN event_id % 103 = 0 THEN '-----BEGIN RSA PRIVATE KEY-----' ELSE event_type END AS value, true AS is_text FROM {events}
UNION ALL
SELECT event_id, 'size', cast(event_id AS string), false FROM {events} WHERE event_id % 2 = 0""",
    "writes": """
SELECT CASE WHEN event_id % 200 = 0 THEN 'archive' ELSE 'run' END AS scope,
  CASE event_id % 6 WHEN 0 THEN 'begin' WHEN 1 THEN 'appending' WHEN 2 THEN 'committing' WHEN 3 THEN 'committed' WHEN 4 THEN 'aborted' ELSE 'uncertain' END AS phase,
  event_id AS sequence, CASE WHEN event_id % 400 = 0 THEN NULL WHEN event_id % 275 = 0 THEN 'run-none' ELSE 'run-' || user_id END AS run_id, CASE WHEN event_id % 15 > 0 THEN 'token-' || event_id END AS writer_token, event_id AS ordinal
FROM {events}""",
    "log_streams": """
SELECT CASE WHEN event_id % 350 = 0 THEN 'run-none' ELSE 'run-' || user_id END AS run_id, CASE event_id % 3 WHEN 0 THEN 'stdout' WHEN 1 THEN 'stderr' ELSE 'trace' END AS kind,
  CASE WHEN event_id % 20 = 0 THEN CASE WHEN event_id % 60 = 0 THEN 'act-none' ELSE 'act-' || event_id END END AS activity_id, CASE WHEN event_id % 4 > 0 THEN 'rank-' || (event_id % 4) END AS source,
  CASE event_id % 5 WHEN 0 THEN 'ephemeral' WHEN 1 THEN 'debug' WHEN 2 THEN 'forensic' WHEN 3 THEN 'pinned' ELSE 'debug' END AS retention, 'log-' || event_id AS content_id,
  CASE WHEN event_id % 210 = 0 THEN 'bearer 0123456789abcdefghijklmn' ELSE event_type END AS summary, event_id AS ordinal
FROM {events}""",
    "externals": """
SELECT 'obj-' || (item_id * 3 + 1) AS object_id, CASE WHEN item_id % 2 = 0 THEN 'content-' || item_id END AS content_id, 'file' AS artifact_kind, '/data/' || item_id AS path, cast(NULL AS string) AS uri, cast(NULL AS string) AS description, item_id AS ordinal FROM {benchmark}
UNION ALL
SELECT 'obj-' || (item_id * 3 + 1), 'content-again', 'file', '/again/' || item_id, NULL, NULL, item_id + 1000000 FROM {benchmark} WHERE item_id % 5 = 0""",
    "catalog": """
SELECT 'ns' || n_nationkey AS schema_ns, 'k' || k AS schema_id, 'v' || v AS schema_version,
  CASE WHEN (n_nationkey + k + v) % 10 = 0 THEN 'unsupported' WHEN (n_nationkey + k + v) % 10 = 1 THEN 'migration_required' WHEN (n_nationkey + k + v) % 10 = 2 THEN 'backwards_compatible' ELSE 'exact_read' END AS compatibility
FROM {nation} CROSS JOIN (SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey < 7) a CROSS JOIN (SELECT n_nationkey AS v FROM {nation} WHERE n_nationkey < 3) b WHERE (n_nationkey * 7 + k + v) % 11 > 0""",
    "environments": """
SELECT 'software' AS kind, 'env-' || n_nationkey AS id FROM {nation} WHERE n_nationkey < 5
UNION ALL
SELECT 'execution', 'ctx-' || n_nationkey FROM {nation} WHERE n_nationkey < 5""",
    "claims": """
SELECT CASE WHEN n_nationkey = 23 THEN 'runs' ELSE 'ns' || n_nationkey END AS ns_id,
  CASE WHEN n_nationkey % 9 = 4 THEN '' WHEN n_nationkey = 21 THEN 'uuid-20' WHEN n_nationkey = 0 THEN 'uuid-0' ELSE 'uuid-' || n_nationkey END AS ns_uuid,
  CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'The ' || n_name END AS ns_display,
  CASE WHEN n_nationkey IN (0, 5) THEN 'shared' WHEN n_nationkey % 4 = 1 THEN 'extension' ELSE 'domain' END AS role,
  CASE WHEN n_nationkey % 6 = 2 THEN 'alias' WHEN n_nationkey % 6 = 3 THEN 'deprecated' ELSE 'active' END AS status,
  CASE WHEN n_nationkey = 23 THEN 'runs' WHEN n_nationkey = 14 THEN 'ns-none' WHEN n_nationkey = 20 THEN 'ns2' WHEN n_nationkey % 6 = 2 THEN 'ns' || (n_nationkey - 1) ELSE 'ns' || n_nationkey END AS canonical_id, n_nationkey AS ordinal
FROM {nation} WHERE n_nationkey % 8 <> 7 OR n_nationkey = 23
UNION ALL
SELECT 'ns6', 'uuid-6b', '', 'domain', 'active', 'ns6', 100 FROM {nation} WHERE n_nationkey = 6""",
    "claim_aliases": """
SELECT 'ns' || n_nationkey AS ns_id, n_nationkey AS claim, CASE WHEN n_nationkey = 9 THEN 'events' WHEN n_nationkey = 10 THEN 'ns0' WHEN n_nationkey = 12 THEN 'short-3' WHEN n_nationkey = 13 THEN 'ns16' WHEN n_nationkey = 6 THEN 'ns7' WHEN n_nationkey = 1 THEN 'ns15' ELSE 'short-' || n_nationkey END AS alias, cast(0 AS bigint) AS pos
FROM {nation} WHERE n_nationkey IN (1, 3, 6, 9, 10, 12, 13, 16)""",
    "plan_operations": """
SELECT 'plan-' || (p_partkey % 200) AS plan_id, CASE WHEN p_partkey % 301 = 0 THEN '' ELSE p_type END AS kind, CASE WHEN p_size % 3 = 0 THEN 'forbid' WHEN p_size % 3 = 1 THEN 'allow_if_domain_says' ELSE 'force_recompute' END AS reuse, p_partkey AS pos FROM {part}""",
}
_SOURCE = re.compile(r"\{(\w+)\}")


def tables_of(name: str) -> list[str]:
    """The driver's tables that an archive table is made of."""
    return sorted(set(_SOURCE.findall(SQL[name])))


def duckdb_sql(name: str) -> str:
    """The table as a query over the driver's views."""
    return _SOURCE.sub(r"main.\1", SQL[name])


def with_tables(query: str, *names: str) -> str:
    """A DuckDB query that may name the given archive tables (a_<name>)."""
    text = ",\n".join(f"a_{n} AS ({duckdb_sql(n)})" for n in names)
    body = query.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {text},\n{body[14:]}"
    if body.upper().startswith("WITH"):
        return f"WITH {text},\n{body[4:]}"
    return f"WITH {text}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sources = {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in tables_of(name)}
    return spark.sql(SQL[name], **sources).select(*columns(name))


class _Lazy(dict):
    """Tables that are only planned when they are asked for."""

    def __init__(self, spark, sf_dir):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name):
        self[name] = table(self.spark, self.sf_dir, name)
        return self[name]

    def __or__(self, other):
        out = _Lazy(self.spark, self.sf_dir)
        out.update(self)
        out.update(other)
        return out


def archive(spark: SparkSession, sf_dir: str) -> Archive:
    return Archive(_Lazy(spark, sf_dir), CONFIG)


ALL = list(TABLES)
