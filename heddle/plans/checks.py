"""Queries of integrity checks; each is compared as (code, subject, related)."""

from pyspark.sql import functions as F

from ..model import TABLES
from ..operators import catalog, namespaces, readiness, records, rules
from .base import found, query
from .graphs import KNOWN
from .lookups import RESOLVED, SECRET_NAME, SECRET_VALUE

AREAS = "('profile', 'provenance', 'schemas', 'revisions', 'runs', 'events', 'heads', 'objects', 'content', 'payloads')"
UUID = "'00000000-0000-4000-8000-000000000001'"


def check(name, tables, sql):
    def add(f):
        return query(name, tables, sql)(lambda a: found(f(a)))

    return add


def again(code, table, keys, order, subject, related="''", where="true"):
    """Every row of a key but the first."""
    return f"SELECT '{code}' AS code, {subject} AS subject, {related} AS related FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS n FROM a_{table} WHERE {where}) WHERE n > 1"


def _envelope(table, reserved):
    parts = [
        f"SELECT 'kind_namespace_mismatch' AS code, object_id AS subject, kind AS related FROM a_{table} WHERE NOT starts_with(kind, ns_id || '/')",
        f"SELECT 'schema_namespace_mismatch', object_id, schema_ns FROM a_{table} WHERE schema_ns <> ns_id",
        f"SELECT 'schema_kind_mismatch', object_id, schema_ns || '/' || schema_id FROM a_{table} WHERE schema_ns || '/' || schema_id <> kind",
    ]
    if reserved:
        parts += [
            f"SELECT 'reserved_archive_area_claimed', object_id, ns_id FROM a_{table} WHERE ns_id IN {AREAS}",
            f"SELECT 'reserved_namespace_claimed', object_id, ns_uuid FROM a_{table} WHERE ns_id = 'ns0' AND ns_uuid NOT IN ('', {UUID})",
            f"SELECT 'reserved_kind_claimed', object_id, kind FROM a_{table} WHERE ns_id <> 'ns0' AND starts_with(kind, 'ns0/')",
        ]
    return " UNION ALL ".join(parts)


O1 = "ns_id, object_id, revision_id, ordinal"
SQLS = {
    "k1_object_rows": ("objects", _envelope("objects", True), rules.object_rows),
    "w6_duplicate_reference_names": ("refs", again("duplicate_reference_name", "refs", "owner, name", "pos", "object_id", "name"), rules.duplicate_reference_names),
    "w1_duplicate_object_revisions": ("objects", again("duplicate_object_revision", "objects", "object_id, revision_id", O1, "object_id", "revision_id"), rules.duplicate_object_revisions),
    "w2_object_id_conflicts": ("objects", f"""
SELECT CASE WHEN ns_id <> ns0 THEN 'object_id_namespace_conflict' ELSE 'object_id_kind_conflict' END AS code, object_id AS subject, CASE WHEN ns_id <> ns0 THEN ns_id ELSE kind END AS related
FROM (SELECT *, first_value(ns_id) OVER w AS ns0, first_value(kind) OVER w AS kind0 FROM a_objects WINDOW w AS (PARTITION BY object_id ORDER BY {O1})) WHERE ns_id <> ns0 OR kind <> kind0""", rules.object_id_conflicts),
    "j1_j2_dangling_references": ("refs objects", """
SELECT 'dangling_reference' AS code, object_id AS subject, target_object AS related FROM a_refs r
WHERE NOT EXISTS (SELECT 1 FROM a_objects o WHERE o.object_id = r.target_object AND (r.target_revision IS NULL OR o.revision_id = r.target_revision))""", rules.dangling_references),
    "k4_heads": ("heads revisions", again("duplicate_workflow_head", "heads", "head_id", "head_id, name, ordinal", "head_id") + " UNION ALL " + again("duplicate_workflow_head_name", "heads", "name", "head_id, name, ordinal", "head_id", "name") + """
UNION ALL SELECT 'dangling_workflow_head', head_id, revision_id FROM a_heads WHERE revision_id NOT IN (SELECT revision_id FROM a_revisions)""", rules.heads),
    "k8_records": ("revisions runs activities objects", again("duplicate_revision", "revisions", "revision_id", "ordinal", "revision_id") + " UNION ALL " + again("duplicate_run", "runs", "run_id", "ordinal", "run_id") + " UNION ALL " + again("duplicate_activity", "activities", "activity_id", "ordinal", "activity_id") + """
UNION ALL SELECT 'activity_run_mismatch', activity_id, declared_run_id FROM a_activities WHERE declared_run_id <> run_id
UNION ALL SELECT 'missing_revision_record', object_id, revision_id FROM a_objects WHERE revision_id NOT IN (SELECT revision_id FROM a_revisions)""", rules.records),
    "k8_run_parents": ("runs", """
SELECT CASE WHEN parent_run_id = run_id THEN 'self_parent_run' ELSE 'missing_parent_run' END AS code, run_id AS subject, parent_run_id AS related FROM a_runs
WHERE parent_run_id = run_id OR parent_run_id NOT IN (SELECT run_id FROM a_runs)""", rules.run_parents),
    "j6_run_revisions": ("runs revisions", """
SELECT code, subject, related FROM (
  SELECT CASE WHEN v.revision_id IS NULL THEN 'missing_run_revision' WHEN v.run_id <> r.run_id THEN 'run_revision_mismatch' WHEN v.plan_id <> r.plan_id THEN 'run_revision_plan_mismatch' END AS code, r.run_id AS subject, r.revision_id AS related
  FROM a_runs r LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY ordinal) AS n FROM a_revisions) WHERE n = 1) v ON v.revision_id = r.revision_id WHERE r.revision_id IS NOT NULL
  UNION ALL
  SELECT CASE WHEN r.run_id IS NULL THEN 'missing_revision_run' WHEN r.revision_id <> v.revision_id THEN 'run_revision_mismatch' WHEN r.plan_id <> v.plan_id THEN 'run_revision_plan_mismatch' END, v.revision_id, v.run_id
  FROM a_revisions v LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ordinal) AS n FROM a_runs) WHERE n = 1) r ON r.run_id = v.run_id WHERE v.run_id IS NOT NULL
) WHERE code IS NOT NULL""", rules.run_revisions),
    "j7_event_references": ("events runs activities revisions event_refs objects", """
SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM a_runs r WHERE r.run_id = e.run_id) THEN 'missing_event_run' ELSE 'missing_event_activity' END AS code, run_id AS subject,
  CASE WHEN NOT EXISTS (SELECT 1 FROM a_runs r WHERE r.run_id = e.run_id) THEN '' ELSE activity_id END AS related FROM a_events e
WHERE NOT EXISTS (SELECT 1 FROM a_runs r WHERE r.run_id = e.run_id) OR (activity_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a_activities t WHERE t.run_id = e.run_id AND t.activity_id = e.activity_id))
UNION ALL SELECT 'missing_event_revision', run_id, revision_id FROM a_events WHERE revision_id IS NOT NULL AND revision_id NOT IN (SELECT revision_id FROM a_revisions)
UNION ALL SELECT 'dangling_event_object', e.run_id, f.object_id FROM a_event_refs f JOIN a_events e ON e.ordinal = f.event
WHERE NOT EXISTS (SELECT 1 FROM a_objects o WHERE o.object_id = f.object_id AND (f.revision_id IS NULL OR o.revision_id = f.revision_id))""", rules.event_references),
    "k9_secrets": ("events event_payload log_streams", f"""
SELECT 'credential_like_content' AS code, run_id AS subject, 'message' AS related FROM a_events WHERE {SECRET_VALUE.format('message')}
UNION ALL SELECT 'credential_like_content', e.run_id, p.key FROM a_event_payload p JOIN a_events e ON e.ordinal = p.event WHERE {SECRET_NAME.format('p.key')}
UNION ALL SELECT 'credential_like_content', e.run_id, p.key FROM a_event_payload p JOIN a_events e ON e.ordinal = p.event WHERE p.is_text AND {SECRET_VALUE.format('p.value')}
UNION ALL SELECT 'credential_like_content', run_id, 'summary' FROM a_log_streams WHERE summary IS NOT NULL AND {SECRET_VALUE.format('summary')}""", rules.secrets),
    "w5_duplicate_sequences": ("events", again("duplicate_event_sequence", "events", "run_id, coalesce(source, ''), sequence", "ordinal", "run_id", "coalesce(source, '') || '/' || sequence", "sequence IS NOT NULL"), rules.duplicate_sequences),
    "j8_log_streams": ("log_streams runs activities", """
SELECT CASE WHEN run_id NOT IN (SELECT run_id FROM a_runs) THEN 'missing_log_stream_run' ELSE 'missing_log_stream_activity' END AS code, run_id AS subject,
  CASE WHEN run_id NOT IN (SELECT run_id FROM a_runs) THEN '' ELSE activity_id END AS related FROM a_log_streams s
WHERE run_id NOT IN (SELECT run_id FROM a_runs) OR (activity_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a_activities t WHERE t.run_id = s.run_id AND t.activity_id = s.activity_id))""", rules.log_streams),
    "k11_run_records": ("runs staged activities revisions", f"""
SELECT CASE WHEN status = 'uncertain' THEN 'uncertain_run_has_revision' ELSE 'incomplete_run_has_revision' END AS code, run_id AS subject, revision_id AS related FROM a_runs WHERE revision_id IS NOT NULL AND status <> 'completed'
UNION ALL {_envelope("staged", False)}
UNION ALL SELECT 'reused_without_source', object_id, run_id FROM a_staged WHERE origin = 'reused' AND source_revision_id IS NULL
UNION ALL {again("duplicate_staged_object", "staged", "run_id, object_id", "ordinal", "run_id", "object_id")}
UNION ALL SELECT 'missing_staged_activity', run_id, activity_id FROM a_staged s WHERE activity_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a_activities t WHERE t.run_id = s.run_id AND t.activity_id = s.activity_id)
UNION ALL SELECT 'missing_restart_activity', run_id, restart_activity FROM a_runs r WHERE restart_declared AND restart_activity IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a_activities t WHERE t.run_id = r.run_id AND t.activity_id = r.restart_activity)
UNION ALL SELECT 'uncommitted_run_has_revision', r.run_id, v.revision_id FROM a_runs r JOIN a_revisions v ON v.run_id = r.run_id WHERE r.revision_id IS NULL""", rules.run_records),
    "j9_staging": ("staged objects runs", """
SELECT code, subject, related FROM (
  SELECT CASE WHEN o.object_id IS NULL THEN 'reused_source_missing' WHEN o.content_id IS NOT NULL AND s.content_id IS NULL THEN 'reused_content_missing' WHEN o.content_id <> s.content_id THEN 'reused_content_mismatch' END AS code, s.run_id AS subject, s.object_id AS related
  FROM a_staged s LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id, revision_id ORDER BY ordinal) AS n FROM a_objects) WHERE n = 1) o ON o.object_id = s.object_id AND o.revision_id = s.source_revision_id
  WHERE s.origin = 'reused' AND s.source_revision_id IS NOT NULL
  UNION ALL
  SELECT CASE WHEN o.object_id IS NULL THEN 'staged_not_promoted' WHEN o.content_id <> s.content_id THEN 'committed_content_mismatch' END, s.run_id, s.object_id
  FROM a_staged s JOIN a_runs r ON r.run_id = s.run_id LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id, revision_id ORDER BY ordinal) AS n FROM a_objects) WHERE n = 1) o ON o.object_id = s.object_id AND o.revision_id = r.revision_id
  WHERE r.revision_id IS NOT NULL
) WHERE code IS NOT NULL""", rules.staging),
    "k12_writes": ("writes runs", f"""
SELECT 'missing_writer_token' AS code, sequence::VARCHAR AS subject, phase AS related FROM a_writes WHERE phase IN ('begin', 'appending', 'committing') AND writer_token IS NULL
UNION ALL {again("duplicate_write", "writes", "scope, coalesce(run_id, '')", "ordinal", "scope", "coalesce(run_id, '')")}
UNION ALL SELECT 'missing_write_run', scope, run_id FROM a_writes WHERE run_id IS NOT NULL AND run_id NOT IN (SELECT run_id FROM a_runs)
UNION ALL SELECT 'multiple_archive_writers', count(*)::VARCHAR, '' FROM a_writes WHERE scope = 'archive' AND phase IN ('begin', 'appending', 'committing') HAVING count(*) > 1
UNION ALL SELECT c.code, c.subject, c.related FROM (
  SELECT unnest([
    CASE WHEN w.phase IN ('begin', 'appending', 'committing') AND r.revision_id IS NOT NULL THEN {{'code': 'in_flight_write_has_revision', 'subject': w.run_id, 'related': r.revision_id}} END,
    CASE WHEN w.phase = 'committed' AND r.revision_id IS NULL THEN {{'code': 'committed_write_missing_revision', 'subject': w.run_id, 'related': w.sequence::VARCHAR}} END,
    CASE WHEN w.phase = 'uncertain' AND r.revision_id IS NOT NULL THEN {{'code': 'uncertain_write_has_revision', 'subject': w.run_id, 'related': r.revision_id}} END,
    CASE WHEN w.phase = 'uncertain' AND r.status <> 'uncertain' THEN {{'code': 'uncertain_write_status_mismatch', 'subject': w.run_id, 'related': r.status}} END]) AS c
  FROM a_writes w JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ordinal) AS n FROM a_runs) WHERE n = 1) r ON r.run_id = w.run_id) WHERE c IS NOT NULL""", rules.writes),
    "v5_plans": ("plan_operations", "SELECT 'empty_operation_kind' AS code, plan_id AS subject, pos::VARCHAR AS related FROM a_plan_operations WHERE kind = ''", rules.plans),
    "k3_object_statuses": ("objects catalog", """
SELECT CASE coalesce(c.compatibility, 'missing_schema') WHEN 'unsupported' THEN 'unsupported_schema' ELSE coalesce(c.compatibility, 'missing_schema') END AS code, object_id AS subject, o.schema_ns || '/' || o.schema_id || '/' || o.schema_version AS related
FROM a_objects o LEFT JOIN a_catalog c ON c.schema_ns = o.schema_ns AND c.schema_id = o.schema_id AND c.schema_version = o.schema_version WHERE coalesce(c.compatibility, 'missing_schema') IN ('missing_schema', 'unsupported', 'migration_required')""", catalog.object_statuses),
    "k3_provenance": ("objects environments", """
SELECT 'missing_software_environment' AS code, object_id AS subject, software_environment AS related FROM a_objects WHERE software_environment NOT IN (SELECT id FROM a_environments WHERE kind = 'software')
UNION ALL SELECT 'missing_execution_context', object_id, execution_context FROM a_objects WHERE execution_context NOT IN (SELECT id FROM a_environments WHERE kind = 'execution')""", catalog.provenance),
    "k5_object_identities": ("objects claims claim_aliases", f"""
WITH {RESOLVED}, p AS (SELECT DISTINCT ns_id, ns_uuid FROM a_objects WHERE ns_uuid <> '')
SELECT 'namespace_identity_conflict' AS code, ns_id AS subject, string_agg(ns_uuid, ',' ORDER BY ns_uuid) AS related FROM p GROUP BY ns_id HAVING count(*) > 1
UNION ALL SELECT 'namespace_id_split', p.ns_uuid, string_agg(p.ns_id, ',' ORDER BY p.ns_id) FROM p LEFT JOIN resolved r ON r.id = p.ns_id GROUP BY p.ns_uuid
  HAVING count(*) > 1 AND NOT (bool_and(r.id IS NOT NULL AND r.claim_uuid IN ('', p.ns_uuid)) AND count(DISTINCT r.canonical_id) = 1)
UNION ALL SELECT CASE WHEN o.ns_uuid = '' THEN 'namespace_identity_missing' ELSE 'namespace_identity_conflict' END, o.object_id, o.ns_id FROM a_objects o JOIN resolved r ON r.id = o.ns_id WHERE r.claim_uuid <> '' AND r.claim_uuid <> o.ns_uuid""", lambda a: namespaces.object_identities(a, True)),
    "k6_claims": ("claims claim_aliases", f"""
WITH {RESOLVED},
c AS (SELECT *, (ns_id = 'ns0' OR canonical_id = 'ns0' OR ns_uuid = {UUID}) AS own, row_number() OVER (ORDER BY ns_id, ns_uuid, status, ordinal) AS place FROM a_claims),
ca AS (SELECT c.*, f.ns_id AS f_id, f.ns_uuid AS f_uuid, f.role AS f_role, f.status AS f_status FROM c LEFT JOIN firsts f ON f.ns_id = c.canonical_id WHERE c.status = 'alias'),
ow AS (SELECT place, 0 AS pos, ns_id AS alias, canonical_id AS owner FROM c WHERE status = 'alias' UNION ALL SELECT c.place, l.pos, l.alias, c.ns_id FROM c JOIN a_claim_aliases l ON l.claim = c.ordinal WHERE c.status <> 'alias'),
ow1 AS (SELECT *, first_value(owner) OVER (PARTITION BY alias ORDER BY place, pos) AS first_owner FROM ow)
SELECT 'reserved_archive_area_claimed' AS code, ns_id AS subject, '' AS related FROM c WHERE ns_id IN {AREAS}
UNION ALL SELECT 'reserved_namespace_claimed', ns_id, 'alias' FROM c WHERE status = 'alias' AND ns_id = 'ns0'
UNION ALL SELECT 'reserved_namespace_claimed', ns_id, 'role' FROM c WHERE own AND role <> 'shared'
UNION ALL SELECT 'reserved_namespace_claimed', ns_id, 'uuid' FROM c WHERE own AND ns_uuid NOT IN ('', {UUID})
UNION ALL SELECT 'shared_namespace_role_mismatch', ns_id, role FROM c WHERE NOT own AND role = 'shared'
UNION ALL SELECT 'reserved_archive_area_claimed', ns_id, alias FROM a_claim_aliases WHERE alias IN {AREAS}
UNION ALL SELECT 'reserved_namespace_claimed', ns_id, alias FROM a_claim_aliases WHERE alias = 'ns0'
UNION ALL SELECT 'namespace_alias_unresolved', ns_id, canonical_id FROM ca WHERE f_id IS NULL
UNION ALL SELECT 'namespace_alias_not_canonical', ns_id, canonical_id FROM ca WHERE f_status = 'alias'
UNION ALL SELECT 'namespace_alias_uuid_mismatch', ns_id, canonical_id FROM ca WHERE f_status <> 'alias' AND f_uuid <> '' AND ns_uuid <> '' AND f_uuid <> ns_uuid
UNION ALL SELECT 'namespace_alias_role_mismatch', ns_id, canonical_id FROM ca WHERE f_status <> 'alias' AND role <> f_role
UNION ALL SELECT 'namespace_identity_conflict', alias, owner FROM ow1 WHERE owner <> first_owner
UNION ALL SELECT DISTINCT 'namespace_identity_conflict', first_owner, alias FROM ow1 JOIN firsts f ON f.ns_id = alias WHERE CASE WHEN f.status = 'alias' THEN f.canonical_id <> first_owner ELSE f.ns_id <> first_owner END
UNION ALL SELECT 'duplicate_namespace_claim', ns_id, '' FROM (SELECT *, row_number() OVER (PARTITION BY ns_id ORDER BY place) AS n FROM c) WHERE n > 1
UNION ALL SELECT 'namespace_id_split', ns_uuid, string_agg(DISTINCT id, ',' ORDER BY id) FROM (SELECT ns_uuid, CASE WHEN status = 'alias' THEN canonical_id ELSE ns_id END AS id FROM c WHERE ns_uuid <> '') GROUP BY ns_uuid HAVING count(DISTINCT id) > 1""", namespaces.registry),
}
for _name, (_tables, _sql, _rule) in SQLS.items():
    check(_name, _tables, _sql)(_rule)


#: What single records answer to by themselves.
RECORDS = {
    "object": ("objects refs", _envelope("objects", True) + " UNION ALL " + again("duplicate_reference_name", "refs", "owner, name", "pos", "object_id", "name")),
    "event": ("events event_payload", f"""
SELECT 'credential_like_content' AS code, run_id AS subject, 'message' AS related FROM a_events WHERE {SECRET_VALUE.format('message')}
UNION ALL SELECT 'credential_like_content', e.run_id, p.key FROM a_event_payload p JOIN a_events e ON e.ordinal = p.event WHERE {SECRET_NAME.format('p.key')} OR (p.is_text AND {SECRET_VALUE.format('p.value')})"""),
    "log_stream": ("log_streams", f"SELECT 'credential_like_content' AS code, run_id AS subject, 'summary' AS related FROM a_log_streams WHERE summary IS NOT NULL AND {SECRET_VALUE.format('summary')}"),
    "staged": ("staged", _envelope("staged", False) + " UNION ALL SELECT 'reused_without_source', object_id, run_id FROM a_staged WHERE origin = 'reused' AND source_revision_id IS NULL"),
    "run": ("runs staged activities revisions", f"SELECT code, subject, related FROM ({SQLS['k11_run_records'][1]}) WHERE code <> 'uncommitted_run_has_revision'"),
    "write": ("writes", "SELECT 'missing_writer_token' AS code, sequence::VARCHAR AS subject, phase AS related FROM a_writes WHERE phase IN ('begin', 'appending', 'committing') AND writer_token IS NULL"),
    "claim": ("claims claim_aliases", f"""
WITH c AS (SELECT *, (ns_id = 'ns0' OR canonical_id = 'ns0' OR ns_uuid = {UUID}) AS own FROM a_claims)
SELECT 'reserved_archive_area_claimed' AS code, ns_id AS subject, '' AS related FROM c WHERE ns_id IN {AREAS}
UNION ALL SELECT 'reserved_namespace_claimed', ns_id, 'alias' FROM c WHERE status = 'alias' AND ns_id = 'ns0'
UNION ALL SELECT 'reserved_namespace_claimed', ns_id, 'role' FROM c WHERE own AND role <> 'shared'
UNION ALL SELECT 'reserved_namespace_claimed', ns_id, 'uuid' FROM c WHERE own AND ns_uuid NOT IN ('', {UUID})
UNION ALL SELECT 'shared_namespace_role_mismatch', ns_id, role FROM c WHERE NOT own AND role = 'shared'
UNION ALL SELECT 'reserved_archive_area_claimed', ns_id, alias FROM a_claim_aliases WHERE alias IN {AREAS}
UNION ALL SELECT 'reserved_namespace_claimed', ns_id, alias FROM a_claim_aliases WHERE alias = 'ns0'"""),
}
for _name, (_tables, _sql) in RECORDS.items():
    check(f"v_{_name}_records", _tables, _sql)(lambda a, kind=_name: records.validate(a, kind))


@query("f14_rendered", "objects", "SELECT 'error ' || code || ' [' || subject || CASE WHEN related <> '' THEN ', ' || related ELSE '' END || ']' AS line FROM (" + _envelope("objects", True) + ")")
def _(a):
    return records.render(rules.object_rows(a))


def total(parts: list[str]) -> str:
    """What the given checks find, row by row."""
    return " UNION ALL ".join(f"SELECT code, subject, related FROM ({p})" for p in parts)


_SUITE = [v[1] for k, v in SQLS.items() if k != "v5_plans"]
_GRAPH = [
    "WITH RECURSIVE " + KNOWN + " SELECT 'cycle' AS code, id AS subject, '' AS related FROM (SELECT min(source) AS id FROM pairs WHERE target IN (SELECT source FROM pairs WHERE source = target)) WHERE id IS NOT NULL",
    "SELECT DISTINCT 'dangling_parent' AS code, child AS subject, parent AS related FROM a_edges WHERE child IN (SELECT revision_id FROM a_revisions) AND parent NOT IN (SELECT revision_id FROM a_revisions)",
]


@query("v2_validate_archive", " ".join(TABLES), total(_SUITE + _GRAPH))
def _(a):
    """What the whole suite finds, claims and catalog included."""
    return found(rules.validate(a, namespaces=True, catalog=True))


@query("q3_archive_commit", "runs staged activities revisions objects writes", total([
    "SELECT 'run_not_completed' AS code, run_id AS subject, status AS related FROM a_runs WHERE status <> 'completed'",
    "SELECT 'run_already_committed' AS code, run_id AS subject, revision_id AS related FROM a_runs WHERE revision_id IS NOT NULL",
    "SELECT 'uncertain_side_effect' AS code, run_id AS subject, '' AS related FROM a_runs WHERE status = 'uncertain'",
    f"SELECT code, subject, related FROM ({SQLS['k11_run_records'][1]}) WHERE code <> 'uncommitted_run_has_revision'",
    SQLS["j9_staging"][1],
    "SELECT CASE WHEN phase = 'uncertain' THEN 'uncertain_side_effect' ELSE 'in_flight_write' END AS code, run_id AS subject, scope AS related FROM a_writes w WHERE scope = 'run' AND phase IN ('begin', 'appending', 'committing', 'uncertain') AND run_id IN (SELECT run_id FROM a_runs)",
    "SELECT CASE WHEN phase = 'uncertain' THEN 'uncertain_side_effect' ELSE 'in_flight_write' END AS code, run_id AS subject, 'archive' AS related FROM (SELECT DISTINCT phase FROM a_writes WHERE scope = 'archive' AND phase IN ('begin', 'appending', 'committing', 'uncertain')) CROSS JOIN (SELECT DISTINCT run_id FROM a_runs)",
]))
def _(a):
    """What keeps runs from being committed."""
    return found(readiness.archive_commit(a))


@query("k13_event_batches", "events event_payload writes", f"""
WITH e AS (SELECT *, 'batch-' || (ordinal - ordinal % 50) AS batch FROM a_events), f AS (SELECT batch, min_by(run_id, ordinal) AS first_run FROM e GROUP BY batch)
SELECT 'event_batch_run_mismatch' AS code, e.batch AS subject, run_id AS related FROM e JOIN f ON f.batch = e.batch WHERE run_id <> first_run
UNION ALL SELECT 'duplicate_event_sequence', batch, run_id || '/' || coalesce(source, '') || '/' || sequence FROM (SELECT *, row_number() OVER (PARTITION BY batch, run_id, coalesce(source, ''), sequence ORDER BY ordinal) AS n FROM e WHERE sequence IS NOT NULL) WHERE n > 1
UNION ALL SELECT 'credential_like_content', batch, 'message' FROM e WHERE {SECRET_VALUE.format('message')}
UNION ALL SELECT 'credential_like_content', batch, key FROM a_event_payload p JOIN e ON e.ordinal = p.event WHERE {SECRET_NAME.format('p.key')} OR (p.is_text AND {SECRET_VALUE.format('p.value')})
UNION ALL SELECT 'missing_writer_token', f.batch, w.phase FROM a_writes w JOIN f ON f.batch = 'batch-' || w.ordinal WHERE phase IN ('begin', 'appending', 'committing') AND writer_token IS NULL
UNION ALL SELECT 'event_batch_write_scope', f.batch, w.scope FROM a_writes w JOIN f ON f.batch = 'batch-' || w.ordinal WHERE scope <> 'run'
UNION ALL SELECT 'event_batch_write_run_mismatch', f.batch, w.run_id FROM a_writes w JOIN f ON f.batch = 'batch-' || w.ordinal WHERE scope = 'run' AND run_id <> first_run""")
def _(a):
    """Fifty events make a batch, with the write that has the first one's number."""
    batch = F.concat(F.lit("batch-"), F.col("ordinal") - F.col("ordinal") % 50)
    writes = a.writes.withColumn("batch", F.concat(F.lit("batch-"), "ordinal"))
    return found(rules.event_batches(a.events.withColumn("batch", batch), a.event_payload, writes))


@query("e1_appended_events", "events event_payload", f"""
WITH bad AS (
  SELECT run_id, 'credential_like_content' AS code FROM a_events WHERE {SECRET_VALUE.format('message')}
  UNION SELECT e.run_id, 'credential_like_content' FROM a_event_payload p JOIN a_events e ON e.ordinal = p.event WHERE {SECRET_NAME.format('p.key')} OR (p.is_text AND {SECRET_VALUE.format('p.value')})
  UNION SELECT run_id, 'duplicate_event_sequence' FROM (SELECT *, row_number() OVER (PARTITION BY run_id, coalesce(source, ''), sequence ORDER BY ordinal) AS n FROM a_events WHERE sequence IS NOT NULL) WHERE n > 1)
SELECT ordinal, e.run_id, coalesce(codes, '') AS codes FROM a_events e LEFT JOIN (SELECT run_id, string_agg(code, ',' ORDER BY code) AS codes FROM bad GROUP BY run_id) b ON b.run_id = e.run_id""")
def _(a):
    """All events through the append stream, in one micro-batch: what was appended, and what was set aside with its codes."""
    from ..sources.files import event_stream
    from ..staging import stage
    from ..streaming.events import append

    spark = a.events.sparkSession
    arrived = stage(a.events, "append-events")
    out = arrived.staged_path.replace("append-events", "appended")
    append(event_stream(spark, arrived.staged_path), f"{out}/table", f"{out}/aside", f"{out}/state", payload=a.event_payload).awaitTermination()
    kept = spark.read.parquet(f"{out}/table").select("ordinal", "run_id", F.lit("").alias("codes"))
    return kept.unionByName(spark.read.parquet(f"{out}/aside").select("ordinal", "run_id", "codes"))


@query("e2_stream_repeats", "events", """
SELECT run_id, coalesce(source, '') AS source, sequence FROM (SELECT *, row_number() OVER (PARTITION BY run_id, coalesce(source, ''), sequence ORDER BY ordinal) AS n FROM a_events WHERE sequence IS NOT NULL) WHERE n > 1""")
def _(a):
    """Repeats that the stateful stream finds, over all events as files arrive."""
    from ..staging import shared_dir, stage
    from ..sources.files import event_stream
    from ..streaming.events import repeats, state_store

    spark = a.events.sparkSession
    arrived = stage(a.events, "stream-events")
    out = f"{shared_dir(spark)}/stream-repeats-{arrived.staged_path.rsplit('-', 1)[-1]}"
    rows = repeats(event_stream(spark, arrived.staged_path))
    with state_store(spark):
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema("run_id string, source string, sequence long, kind string").parquet(out).select("run_id", "source", "sequence")
