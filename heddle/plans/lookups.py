"""Queries of lookups, orders, joins and listings."""

from pyspark.sql import functions as F

from ..functions.columns import is_secret_name, is_secret_value, schema_kind
from ..model import columns
from ..operators import catalog, lookup, namespaces, records
from ..sources import files
from .base import query

EVENT_ORDER = "coalesce(source, ''), coalesce(sequence, 9223372036854775807), ordinal"


@query("p1_find_revision", "revisions", "SELECT revision_id, run_id, plan_id FROM (SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY ordinal) AS n FROM a_revisions) WHERE n = 1")
def _(a):
    return lookup.find(a, "revisions", ["revision_id"]).select("revision_id", "run_id", "plan_id")


@query("p1_find_run", "runs", "SELECT run_id, status, revision_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ordinal) AS n FROM a_runs) WHERE n = 1")
def _(a):
    return lookup.find(a, "runs", ["run_id"]).select("run_id", "status", "revision_id")


@query("p2_find_object", "objects", "SELECT object_id, revision_id, content_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY object_id, revision_id ORDER BY ordinal) AS n FROM a_objects) WHERE n = 1")
def _(a):
    return lookup.find(a, "objects", ["object_id", "revision_id"]).select("object_id", "revision_id", "content_id", "ordinal")


@query("p3_objects_of_head_revisions", "objects heads", "SELECT head_id, object_id, o.revision_id, row_number() OVER (PARTITION BY h.ordinal ORDER BY ns_id, object_id, o.revision_id, o.ordinal) AS place FROM a_heads h JOIN a_objects o ON o.revision_id = h.revision_id")
def _(a):
    from pyspark.sql import Window

    rows = a.heads.select("head_id", "revision_id", F.col("ordinal").alias("h")).join(a.objects, "revision_id")
    return rows.select("head_id", "object_id", "revision_id", F.row_number().over(Window.partitionBy("h").orderBy(*lookup.ORDERS["objects"])).cast("long").alias("place"))


@query("p4_versions_of_objects", "objects", "SELECT object_id, revision_id, row_number() OVER (PARTITION BY object_id ORDER BY ns_id, object_id, revision_id, ordinal) AS place FROM a_objects")
def _(a):
    from pyspark.sql import Window

    return a.objects.select("object_id", "revision_id", F.row_number().over(Window.partitionBy("object_id").orderBy(*lookup.ORDERS["objects"])).cast("long").alias("place"))


@query("p5_find_write", "writes", "SELECT scope, run_id, phase, sequence FROM (SELECT *, row_number() OVER (PARTITION BY scope, run_id ORDER BY ordinal) AS n FROM a_writes) WHERE n = 1")
def _(a):
    return lookup.find(a, "writes", ["scope", "run_id"]).select("scope", "run_id", "phase", "sequence")


@query("p6_head_names", "heads", "SELECT name, min_by(head_id, ordinal) AS head_id, count(*) > 1 AS ambiguous FROM a_heads GROUP BY name")
def _(a):
    return a.heads.groupBy("name").agg(F.min_by("head_id", "ordinal").alias("head_id"), (F.count(F.lit(1)) > 1).alias("ambiguous"))


@query("p7_event_timeline", "events event_refs", f"""
SELECT e.run_id, e.source, e.sequence, e.kind, e.severity, e.message, e.activity_id, e.revision_id, e.scope, e.producer_id, e.retention, coalesce(r.ids, '') AS object_ids, e.ordinal
FROM a_events e LEFT JOIN (SELECT event, string_agg(object_id, ',' ORDER BY pos) AS ids FROM a_event_refs GROUP BY event) r ON r.event = e.ordinal ORDER BY run_id, {EVENT_ORDER}""")
def _(a):
    return lookup.timeline(a)


@query("p9_schema_kinds", "objects", "SELECT schema_ns || '/' || schema_id AS schema_kind, count(*) AS n FROM a_objects GROUP BY 1")
def _(a):
    return a.objects.groupBy(schema_kind().alias("schema_kind")).agg(F.count(F.lit(1)).alias("n"))


@query("p10_owned_kinds", "objects", "SELECT ns_id, count(*) AS n FROM a_objects WHERE starts_with(kind, ns_id || '/') GROUP BY ns_id")
def _(a):
    return namespaces.owned(a).groupBy("ns_id").agg(F.count(F.lit(1)).alias("n"))


_NAMES = "password secret token api_key apikey authorization private_key privatekey cookie credential passwd".split()
SECRET_NAME = "(" + " OR ".join(f"contains(lower({{0}}), '{n}')" for n in _NAMES) + ")"
SECRET_VALUE = (
    "(regexp_matches({0}, '-----BEGIN [A-Z ]*PRIVATE KEY-----') OR regexp_matches({0}, '(?i)\\bbearer\\s+[A-Za-z0-9._\\-+/=]{{20,}}') "
    "OR regexp_matches({0}, '(?i)\\b(sk|ghp|gho|xox[baprs])-[A-Za-z0-9]{{16,}}'))"
)


@query("p11_document_secrets", "", f"SELECT doc_id, {SECRET_NAME.format('text')} AS names_secret, {SECRET_VALUE.format('text')} AS holds_secret FROM documents")
def _(a):
    raise NotImplementedError


def _document_secrets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return docs.select("doc_id", is_secret_name(F.col("text")).alias("names_secret"), is_secret_value(F.col("text")).alias("holds_secret"))


from .base import QUERIES  # noqa: E402

QUERIES["p11_document_secrets"] = _document_secrets


@query("p12_run_states", "runs writes", """
SELECT run_id, status <> 'completed' AS incomplete, status IN ('failed', 'interrupted', 'cancelled', 'uncertain') AS restartable,
  EXISTS (SELECT 1 FROM a_writes w WHERE w.run_id = r.run_id AND phase IN ('begin', 'appending', 'committing')) AS in_flight FROM a_runs r""")
def _(a):
    from ..model import IN_FLIGHT, INCOMPLETE, RESTARTABLE

    busy = a.writes.where(F.col("phase").isin(*IN_FLIGHT)).select("run_id").distinct().withColumn("_busy", F.lit(True))
    return a.runs.join(busy, "run_id", "left").select("run_id", F.col("status").isin(*INCOMPLETE).alias("incomplete"), F.col("status").isin(*RESTARTABLE).alias("restartable"), F.coalesce("_busy", F.lit(False)).alias("in_flight"))


@query("p14_branch_from", "heads", "SELECT head_id, name, revision_id FROM a_heads UNION ALL SELECT 'head-new', 'experiment', 'rev-1'")
def _(a):
    return lookup.branch_from(a, "rev-1", "head-new", "experiment").heads.select("head_id", "name", "revision_id")


@query("p15_promote_staged", "staged runs", "SELECT object_id, r.revision_id, content_id, s.run_id, ns_id, kind FROM a_staged s JOIN a_runs r ON r.run_id = s.run_id WHERE r.revision_id IS NOT NULL")
def _(a):
    rows = lookup.promote_staged(a, a.runs.where("revision_id IS NOT NULL").select("run_id", "revision_id"))
    return rows.select("object_id", "revision_id", "content_id", "run_id", "ns_id", "kind")


_ORDERED = {
    "o1_ordered_objects": ("objects", "ns_id, object_id, revision_id, ordinal", "ns_id object_id revision_id ordinal"),
    "o3_ordered_heads": ("heads", "head_id, name, ordinal", "head_id name revision_id"),
    "o4_ordered_revisions": ("revisions", "revision_id, ordinal", "revision_id run_id"),
    "o4_ordered_runs": ("runs", "run_id, ordinal", "run_id status"),
    "o4_ordered_writes": ("writes", "scope, coalesce(run_id, ''), sequence, ordinal", "scope run_id sequence"),
    "o4_ordered_log_streams": ("log_streams", "run_id, kind, coalesce(source, ''), ordinal", "run_id kind source ordinal"),
    "o6_ordered_claims": ("claims", "ns_id, ns_uuid, status, ordinal", "ns_id ns_uuid status"),
    "o2_ordered_references": ("refs", "owner, name, target_object, coalesce(target_revision, ''), pos", "owner name target_object target_revision"),
}


def _ordered(table, cols):
    def run(a):
        rows = lookup.ordered(a, table) if table != "refs" else a.refs.orderBy("owner", *lookup.ORDERS["refs"])
        return rows.select(*cols.split())

    return run


for _name, (_table, _order, _cols) in _ORDERED.items():
    query(_name, _table, f"SELECT {_cols.replace(' ', ', ')} FROM a_{_table} ORDER BY {_order}")(_ordered(_table, _cols))


@query("o5_ranked_run_events", "events", f"SELECT ordinal, run_id, row_number() OVER (PARTITION BY run_id ORDER BY {EVENT_ORDER}) AS place FROM a_events")
def _(a):
    return lookup.ranked_timeline(a).select("ordinal", "run_id", F.col("place").cast("long").alias("place"))


@query("a1_graph_report", "objects heads revisions runs events writes log_streams", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM a_{t}" for t in "objects heads revisions runs events writes log_streams".split()))
def _(a):
    return lookup.counts(a)


@query("a1_namespaces", "objects", "SELECT DISTINCT ns_id FROM a_objects ORDER BY ns_id")
def _(a):
    return lookup.namespaces(a)


@query("a3_run_report", "runs activities staged checkpoints", """
SELECT r.run_id, r.status, coalesce(ac.n, 0) AS activities, coalesce(st.n, 0) AS staged, coalesce(cp.n, 0) AS checkpoints, r.revision_id IS NOT NULL AS committed FROM a_runs r
LEFT JOIN (SELECT run_id, count(*) AS n FROM a_activities GROUP BY run_id) ac ON ac.run_id = r.run_id LEFT JOIN (SELECT run_id, count(*) AS n FROM a_staged GROUP BY run_id) st ON st.run_id = r.run_id
LEFT JOIN (SELECT run_id, count(*) AS n FROM a_checkpoints GROUP BY run_id) cp ON cp.run_id = r.run_id""")
def _(a):
    return records.report(a, "run").drop("revision_id")


@query("a10_known_schemas", "catalog", "SELECT schema_ns, schema_id, schema_version, compatibility FROM a_catalog")
def _(a):
    return catalog.known(a.catalog)


@query("j12_schema_status", "objects catalog", """
SELECT object_id, revision_id, o.ordinal, coalesce(c.compatibility, 'missing_schema') AS status FROM a_objects o
LEFT JOIN a_catalog c ON c.schema_ns = o.schema_ns AND c.schema_id = o.schema_id AND c.schema_version = o.schema_version""")
def _(a):
    return catalog.statuses(a.objects, a.catalog).select("object_id", "revision_id", "ordinal", "status")


FIRST_CLAIMS = "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ns_id ORDER BY ns_uuid, status, ordinal) AS n FROM a_claims) WHERE n = 1)"
RESOLVED = f"""{FIRST_CLAIMS},
resolved AS (
  SELECT ns_id AS id, ns_id AS claim_id, ns_uuid AS claim_uuid, canonical_id, role, status, ns_display AS display FROM firsts WHERE status <> 'alias'
  UNION ALL
  SELECT f.ns_id, c.ns_id, c.ns_uuid, c.canonical_id, c.role, c.status, c.ns_display FROM firsts f JOIN firsts c ON c.ns_id = f.canonical_id WHERE f.status = 'alias'
  UNION ALL
  SELECT alias, ns_id, ns_uuid, canonical_id, role, status, ns_display FROM (
    SELECT l.alias, c.*, row_number() OVER (PARTITION BY l.alias ORDER BY c.ns_id, c.ns_uuid, c.status, c.ordinal) AS n FROM a_claim_aliases l JOIN a_claims c ON c.ordinal = l.claim WHERE c.status <> 'alias')
  WHERE n = 1 AND alias NOT IN (SELECT ns_id FROM firsts))"""


@query("j13_resolve_namespace", "claims claim_aliases", f"WITH {RESOLVED} SELECT id, claim_id, canonical_id, role, status FROM resolved")
def _(a):
    return namespaces.resolved(a).select("id", "claim_id", "canonical_id", "role", "status")


SEEN = """
first_uuid AS (SELECT ns_id, min_by(ns_uuid, ordinal) AS uuid, min(ordinal) AS since FROM a_objects WHERE ns_uuid <> '' GROUP BY ns_id),
seen AS (
  SELECT o.ns_id, coalesce(any_value(f.uuid), '') AS uuid, max(CASE WHEN f.since IS NULL OR o.ordinal >= f.since THEN o.ns_display END) AS name,
    string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, string_agg(DISTINCT schema_id, ',' ORDER BY schema_id) AS schema_ids
  FROM a_objects o LEFT JOIN first_uuid f ON f.ns_id = o.ns_id GROUP BY o.ns_id)"""


@query("a4_list_object_namespaces", "objects", f"""
WITH {SEEN} SELECT ns_id, uuid AS ns_uuid, name AS display, CASE WHEN ns_id = 'ns0' THEN 'shared' ELSE 'domain' END AS role, 'active' AS status, ns_id AS canonical_id, '' AS aliases, kinds, schema_ids FROM seen""")
def _(a):
    return namespaces.listing(a, with_claims=False)


@query("a4_list_namespaces", "objects claims claim_aliases", f"""
WITH {RESOLVED}, {SEEN},
last AS (SELECT ns_id, max_by(role, k) AS role, max_by(status, k) AS status, max_by(canonical_id, k) AS canonical_id, max_by(ns_uuid, k) FILTER (WHERE ns_uuid <> '') AS uuid, max_by(ns_display, k) FILTER (WHERE ns_display <> '') AS name
  FROM (SELECT *, row_number() OVER (PARTITION BY ns_id ORDER BY ns_uuid, status, ordinal) AS k FROM a_claims) GROUP BY ns_id),
ids AS (SELECT ns_id FROM seen UNION SELECT ns_id FROM last),
names AS (
  SELECT ns_id, alias FROM a_claim_aliases
  UNION SELECT r.id, l.alias FROM resolved r JOIN a_claim_aliases l ON l.ns_id = r.claim_id
  UNION SELECT id, id FROM resolved WHERE id <> claim_id)
SELECT i.ns_id, coalesce(l.uuid, s.uuid, '') AS ns_uuid, coalesce(l.name, s.name, '') AS display, coalesce(l.role, r.role, CASE WHEN i.ns_id = 'ns0' THEN 'shared' ELSE 'domain' END) AS role,
  coalesce(l.status, CASE WHEN r.id <> r.claim_id THEN 'alias' ELSE r.status END, 'active') AS status, coalesce(l.canonical_id, r.canonical_id, i.ns_id) AS canonical_id,
  coalesce((SELECT string_agg(DISTINCT alias, ',' ORDER BY alias) FROM names n WHERE n.ns_id = i.ns_id), '') AS aliases, coalesce(s.kinds, '') AS kinds, coalesce(s.schema_ids, '') AS schema_ids
FROM ids i LEFT JOIN seen s ON s.ns_id = i.ns_id LEFT JOIN last l ON l.ns_id = i.ns_id LEFT JOIN resolved r ON r.id = i.ns_id""")
def _(a):
    return namespaces.listing(a)


@query("s9_serialised_runs", "runs", """
SELECT run_id, '{"run_id":"' || run_id || '","status":"' || status || '","restart_declared":' || restart_declared || ',"ordinal":' || ordinal || '}' AS record FROM a_runs""")
def _(a):
    return a.runs.select("run_id", F.to_json(F.struct("run_id", "status", "restart_declared", "ordinal")).alias("record"))


@query("s10_deserialised_runs", "runs", "SELECT run_id, status, restart_declared, ordinal FROM a_runs")
def _(a):
    rows = a.runs.select(F.to_json(F.struct("run_id", "status", "restart_declared", "ordinal")).alias("record"))
    return rows.select(F.from_json("record", "run_id string, status string, restart_declared boolean, ordinal bigint").alias("r")).select("r.*")


def _round_trip(table):
    def run(a):
        return files.from_records(files.to_records(a, table), table)

    run.__doc__ = f"Table {table} written as records and read again."
    return run


for _name in ("objects", "refs", "heads", "revisions", "runs", "activities", "staged", "events", "writes", "log_streams", "externals", "claims", "plan_operations"):
    query(f"s10_{_name}_records", _name, f"SELECT {', '.join(columns(_name))} FROM a_{_name}")(_round_trip(_name))

REPORTS = {
    "object": ("objects", "SELECT object_id, revision_id, content_id, ns_id AS namespace, schema_ns || '/' || schema_id AS schema, schema_version, 'object ' || object_id || ' of kind ' || kind || ' in revision ' || revision_id AS summary FROM a_objects"),
    "event": ("events", "SELECT ordinal, run_id, kind, sequence, severity, 'event ' || kind || ' of run ' || run_id AS summary FROM a_events"),
    "log_stream": ("log_streams", "SELECT ordinal, run_id, kind, retention, kind || ' of run ' || run_id AS summary FROM a_log_streams"),
    "staged": ("staged", "SELECT run_id, object_id, origin, ordinal, origin || ' object ' || object_id || ' of run ' || run_id AS summary FROM a_staged"),
    "write": ("writes", "SELECT scope, phase, sequence, ordinal, scope || ' write is ' || phase AS summary FROM a_writes"),
    "plan": ("plan_operations", "SELECT plan_id, count(*) AS operations, count(*) FILTER (WHERE kind = '') AS unnamed FROM a_plan_operations GROUP BY plan_id"),
    "claim": ("claims claim_aliases", """
SELECT c.ordinal, ns_id AS namespace, ns_uuid, role, status, canonical_id, coalesce(l.aliases, '') AS aliases, 'namespace ' || ns_id || ' is claimed as ' || role || ', ' || status AS summary FROM a_claims c
LEFT JOIN (SELECT claim, string_agg(alias, ',' ORDER BY alias) AS aliases FROM a_claim_aliases GROUP BY claim) l ON l.claim = c.ordinal"""),
}
for _name, (_tables, _sql) in REPORTS.items():
    query(f"a3_{_name}_report", _tables, _sql)(lambda a, kind=_name: records.report(a, kind))


@query("j15_schemas_in_use", "objects catalog", """
SELECT schema_ns, schema_id, schema_version, compatibility FROM a_catalog c WHERE EXISTS (SELECT 1 FROM a_objects o WHERE o.schema_ns = c.schema_ns AND o.schema_id = c.schema_id AND o.schema_version = c.schema_version)""")
def _(a):
    return catalog.needed(a, a.catalog).select("schema_ns", "schema_id", "schema_version", "compatibility")


@query("c1_revisions_without_objects", "objects revisions", "SELECT DISTINCT revision_id FROM a_revisions WHERE revision_id NOT IN (SELECT revision_id FROM a_objects)")
def _(a):
    return a.revisions.select("revision_id").distinct().join(a.objects.select("revision_id").distinct(), "revision_id", "left_anti")


@query("a6_content_multiplicity", "objects", "SELECT content_id, count(*) AS n FROM a_objects WHERE content_id IS NOT NULL GROUP BY content_id HAVING count(*) > 1")
def _(a):
    return a.objects.where("content_id IS NOT NULL").groupBy("content_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
