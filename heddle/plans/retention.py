"""Queries of reference resolution, manifests, readiness and retention."""

from pyspark.sql import functions as F

from ..operators import catalog, dag, manifest, namespaces, purge, readiness, records, resolve
from .base import found, query
from .graphs import KNOWN, WALK

VERSIONS = "versions AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id, revision_id ORDER BY ordinal) AS n FROM a_objects) WHERE n = 1)"
SIGHT = KNOWN.split(",\npairs")[0] + """,
roots AS (SELECT DISTINCT revision_id FROM {roots} WHERE revision_id IN (SELECT revision_id FROM a_revisions)),
""" + WALK + """,
sight AS (SELECT root, node AS revision_id, row_number() OVER (PARTITION BY root ORDER BY steps, path) - 1 AS rank
  FROM (SELECT root, node, steps, min(path) AS path FROM walk GROUP BY root, node, steps QUALIFY steps = min(steps) OVER (PARTITION BY root, node))),
""" + VERSIONS + """,
links AS (
  SELECT s.root, o.ordinal AS owner, r.target_object, r.target_revision FROM sight s JOIN versions o ON o.revision_id = s.revision_id JOIN (SELECT DISTINCT owner, target_object, target_revision FROM a_refs) r ON r.owner = o.ordinal),
near AS (
  SELECT l.root, l.owner, l.target_object, l.target_revision, min_by(v.ordinal, s.rank) AS target FROM links l
  JOIN versions v ON v.object_id = l.target_object AND (l.target_revision IS NULL OR v.revision_id = l.target_revision) JOIN sight s ON s.root = l.root AND s.revision_id = v.revision_id
  GROUP BY ALL)"""
MANIFEST = SIGHT.format(roots="a_heads") + """,
reached(root, ordinal) AS (
  SELECT root, v.ordinal FROM (SELECT root FROM sight WHERE rank = 0) JOIN versions v ON v.revision_id = root
  UNION
  SELECT r.root, n.target FROM reached r JOIN near n ON n.root = r.root AND n.owner = r.ordinal),
open_slots AS (
  SELECT DISTINCT r.root, l.target_object AS object_id, l.target_revision AS revision_id FROM reached r JOIN links l ON l.root = r.root AND l.owner = r.ordinal
  WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.root = l.root AND n.owner = l.owner AND n.target_object = l.target_object AND n.target_revision IS NOT DISTINCT FROM l.target_revision)),
first_externals AS (SELECT object_id, min_by(content_id, ordinal) AS x, arg_min_null(content_id, ordinal) AS content_id FROM a_externals GROUP BY object_id),
entries AS (
  SELECT r.root, v.object_id, v.revision_id, v.content_id, 'envelope_only' AS availability FROM reached r JOIN versions v ON v.ordinal = r.ordinal
  UNION ALL
  SELECT s.root, s.object_id, s.revision_id, e.content_id, CASE WHEN e.object_id IS NULL THEN 'missing' ELSE 'external_required' END FROM open_slots s LEFT JOIN first_externals e ON e.object_id = s.object_id)"""
MANIFEST = MANIFEST.replace("min_by(content_id, ordinal) AS x, arg_min_null(content_id, ordinal) AS content_id", "arg_min_null(content_id, ordinal) AS content_id")
TABLES = "edges revisions heads objects refs externals"


@query("j3_resolve_in_scope", TABLES, "WITH RECURSIVE " + SIGHT.format(roots="a_heads") + """
SELECT l.root, l.owner, l.target_object, l.target_revision, v.revision_id AS found_revision FROM links l
LEFT JOIN near n ON n.root = l.root AND n.owner = l.owner AND n.target_object = l.target_object AND n.target_revision IS NOT DISTINCT FROM l.target_revision LEFT JOIN versions v ON v.ordinal = n.target""")
def _(a):
    """Every reference of every object that a head sees, as that head resolves it."""
    sight = dag.visible(a, a.heads)
    objects = resolve.versions(a)
    refs = a.refs.select("owner", "target_object", "target_revision").distinct()
    links = sight.select("root", "revision_id").join(objects.select("revision_id", F.col("ordinal").alias("owner")), "revision_id").join(refs, "owner").select("root", "owner", "target_object", "target_revision")
    return resolve.in_scope(links, resolve.sights(sight, objects)).select("root", "owner", "target_object", "target_revision", "found_revision")


@query("j4_all_versions", "activity_refs objects", """
SELECT r.activity_id, r.object_id, v.revision_id AS version FROM a_activity_refs r LEFT JOIN (SELECT DISTINCT object_id, revision_id FROM a_objects) v ON v.object_id = r.object_id AND (r.revision_id IS NULL OR v.revision_id = r.revision_id)""")
def _(a):
    return resolve.all_versions(a.activity_refs, a.objects).select("activity_id", "object_id", "version")


@query("j5_match_external", "checkpoints externals", """
SELECT c.run_id, c.pos, c.object_id, min(e.ordinal) IS NOT NULL AS external, arg_min_null(e.content_id, e.ordinal) AS external_content FROM a_checkpoints c
LEFT JOIN a_externals e ON e.object_id = c.object_id AND (e.content_id IS NULL OR c.content_id IS NULL OR e.content_id = c.content_id) GROUP BY c.run_id, c.pos, c.object_id""")
def _(a):
    return resolve.match_external(a.checkpoints, a.externals, "object_id", "content_id").select("run_id", "pos", "object_id", "external", "external_content")


@query("m3_manifest_entries", TABLES, "WITH RECURSIVE " + MANIFEST + " SELECT root, object_id, revision_id, content_id, availability FROM entries")
def _(a):
    return manifest.manifests(a, a.heads).entries.select("root", "object_id", "revision_id", "content_id", "availability")


@query("m1_manifest_headers", TABLES + " runs", "WITH RECURSIVE " + MANIFEST + """,
recs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY ordinal) AS n FROM a_revisions) WHERE n = 1)
SELECT s.root, CASE WHEN c.run_id IN (SELECT run_id FROM a_runs) THEN c.run_id END AS run_id, c.plan_id, (SELECT count(*) FROM a_heads h WHERE h.revision_id = s.root) AS heads,
  count(*) FILTER (WHERE e.availability = 'envelope_only') AS objects, count(*) FILTER (WHERE e.availability = 'external_required') AS externals, count(*) FILTER (WHERE e.availability = 'missing') AS missing
FROM (SELECT root FROM sight WHERE rank = 0) s JOIN recs c ON c.revision_id = s.root LEFT JOIN entries e ON e.root = s.root GROUP BY ALL""")
def _(a):
    return manifest.header(a, manifest.manifests(a, a.heads))


@query("p8_manifest_slots", TABLES, "WITH RECURSIVE " + MANIFEST + " SELECT root, object_id, count(*) AS entries, CASE WHEN count(*) = 1 THEN min(revision_id) END AS revision_id FROM entries GROUP BY root, object_id")
def _(a):
    return manifest.slots(manifest.manifests(a, a.heads, "checkout"))


@query("m6_manifest_namespaces", TABLES, "WITH RECURSIVE " + MANIFEST + """,
held AS (SELECT o.* FROM a_objects o WHERE (object_id, revision_id) IN (SELECT (object_id, revision_id) FROM entries WHERE availability = 'envelope_only')),
first_uuid AS (SELECT ns_id, min_by(ns_uuid, ordinal) AS uuid, min(ordinal) AS since FROM held WHERE ns_uuid <> '' GROUP BY ns_id)
SELECT o.ns_id, coalesce(any_value(f.uuid), '') AS ns_uuid, max(CASE WHEN f.since IS NULL OR o.ordinal >= f.since THEN o.ns_display END) AS display,
  string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, string_agg(DISTINCT schema_id, ',' ORDER BY schema_id) AS schema_ids FROM held o LEFT JOIN first_uuid f ON f.ns_id = o.ns_id GROUP BY o.ns_id""")
def _(a):
    held = manifest.objects_of(a, manifest.manifests(a, a.heads))
    return namespaces.listing(held, with_claims=False).select("ns_id", "ns_uuid", "display", "kinds", "schema_ids")


@query("m6_manifest_schemas", TABLES + " catalog", "WITH RECURSIVE " + MANIFEST + """,
held AS (SELECT DISTINCT schema_ns, schema_id, schema_version FROM a_objects WHERE (object_id, revision_id) IN (SELECT (object_id, revision_id) FROM entries WHERE availability = 'envelope_only'))
SELECT c.schema_ns, c.schema_id, c.schema_version, c.compatibility FROM a_catalog c JOIN held h ON h.schema_ns = c.schema_ns AND h.schema_id = c.schema_id AND h.schema_version = c.schema_version""")
def _(a):
    """The schemas of what manifests hold."""
    held = manifest.objects_of(a, manifest.manifests(a, a.heads))
    return catalog.needed(held, a.catalog).select("schema_ns", "schema_id", "schema_version", "compatibility")


@query("m7_missing_objects", TABLES, "WITH RECURSIVE " + MANIFEST + " SELECT 'missing_manifest_object' AS code, root AS subject, object_id AS related FROM entries WHERE availability = 'missing'")
def _(a):
    return found(manifest.validate(manifest.manifests(a, a.heads))).where("code = 'missing_manifest_object'")


@query("m5_manifest_record_diagnostics", "edges revisions heads objects refs runs externals", "WITH RECURSIVE " + SIGHT.format(roots="a_heads") + """,
pairs(source, target) AS (SELECT child, parent FROM known UNION SELECT p.source, k.parent FROM pairs p JOIN known k ON k.child = p.target),
recs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY ordinal) AS n FROM a_revisions) WHERE n = 1),
runs1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ordinal) AS n FROM a_runs) WHERE n = 1),
d AS (
  SELECT CASE WHEN r.run_id IS NULL THEN 'missing_revision_run' WHEN r.revision_id <> v.revision_id THEN 'run_revision_mismatch' WHEN r.plan_id <> v.plan_id THEN 'run_revision_plan_mismatch' END AS code, v.revision_id AS subject, v.run_id AS related
  FROM recs v LEFT JOIN runs1 r ON r.run_id = v.run_id WHERE v.run_id IS NOT NULL
  UNION ALL SELECT 'cycle', source, '' FROM pairs WHERE source = target
  UNION ALL SELECT DISTINCT 'dangling_parent', child, parent FROM a_edges WHERE child IN (SELECT revision_id FROM a_revisions) AND parent NOT IN (SELECT revision_id FROM a_revisions))
SELECT s.root, d.code, d.subject, d.related FROM d JOIN sight s ON s.revision_id = d.subject WHERE d.code IS NOT NULL""")
def _(a):
    return manifest.record_diagnostics(a, dag.visible(a, a.heads)).select("root", "code", "subject", "related")


REPLAY = """,
recs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY ordinal) AS n FROM a_revisions) WHERE n = 1),
runs1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ordinal) AS n FROM a_runs) WHERE n = 1),
made AS (SELECT s.root, r.run_id, r.software_environment, r.restart_declared FROM (SELECT root FROM sight WHERE rank = 0) s JOIN recs v ON v.revision_id = s.root LEFT JOIN runs1 r ON r.run_id = v.run_id)
"""


@query("q5_manifest_readiness", TABLES + " runs activities checkpoints", "WITH RECURSIVE " + MANIFEST + REPLAY + """
SELECT 'replay' AS target, code, subject, related FROM (
  SELECT 'external_content_required' AS code, root AS subject, object_id AS related FROM entries WHERE availability = 'external_required'
  UNION ALL SELECT 'replay_run_missing', root, '' FROM made WHERE run_id IS NULL
  UNION ALL SELECT 'replay_environment_unknown', root, run_id FROM made WHERE run_id IS NOT NULL AND software_environment IS NULL)
UNION ALL SELECT 'rerun', code, subject, related FROM (
  SELECT 'external_content_required' AS code, root AS subject, object_id AS related FROM entries WHERE availability = 'external_required'
  UNION ALL SELECT 'rerun_run_missing', root, '' FROM made WHERE run_id IS NULL
  UNION ALL SELECT 'rerun_activity_missing', root, run_id FROM made WHERE run_id IS NOT NULL AND run_id NOT IN (SELECT run_id FROM a_activities))
UNION ALL SELECT 'restart', code, subject, related FROM (
  SELECT 'restart_not_declared' AS code, root AS subject, coalesce(run_id, '') AS related FROM made WHERE run_id IS NULL OR NOT restart_declared OR run_id NOT IN (SELECT run_id FROM a_checkpoints)
  UNION ALL SELECT 'missing_restart_checkpoint', m.root, c.object_id FROM made m JOIN a_checkpoints c ON c.run_id = m.run_id WHERE m.restart_declared
    AND NOT EXISTS (SELECT 1 FROM entries e WHERE e.root = m.root AND e.availability = 'envelope_only' AND e.object_id = c.object_id AND (c.revision_id IS NULL OR e.revision_id = c.revision_id) AND (c.content_id IS NULL OR e.content_id = c.content_id)))""")
def _(a):
    """What each target adds to a manifest's own diagnostics."""
    m = manifest.manifests(a, a.heads)
    own = ("missing_manifest_object", "cycle", "dangling_parent", "missing_revision_run", "run_revision_mismatch", "run_revision_plan_mismatch")
    out = None
    for target in ("replay", "rerun", "restart"):
        rows = found(manifest.readiness(a, m, target)).where(~F.col("code").isin(*own)).select(F.lit(target).alias("target"), "code", "subject", "related")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("q1_run_commit", "runs", """
SELECT 'run_not_completed' AS code, run_id AS subject, status AS related FROM a_runs WHERE status <> 'completed'
UNION ALL SELECT 'run_already_committed', run_id, revision_id FROM a_runs WHERE revision_id IS NOT NULL
UNION ALL SELECT 'uncertain_side_effect', run_id, '' FROM a_runs WHERE status = 'uncertain'""")
def _(a):
    return found(readiness.run_commit(a))


RESTART = """
SELECT 'run_already_committed' AS code, run_id AS subject, revision_id AS related FROM a_runs WHERE revision_id IS NOT NULL
UNION ALL SELECT 'run_not_restartable', run_id, status FROM a_runs WHERE status NOT IN ('failed', 'interrupted', 'cancelled', 'uncertain')
UNION ALL SELECT 'restart_not_declared', run_id, '' FROM a_runs WHERE NOT restart_declared OR run_id NOT IN (SELECT run_id FROM a_checkpoints)"""


@query("q2_run_restart", "runs checkpoints", RESTART)
def _(a):
    return found(readiness.run_restart(a))


@query("q4_archive_restart", "runs checkpoints objects staged", RESTART + """
UNION ALL SELECT code, subject, related FROM (
  SELECT CASE WHEN execution_context IS NULL THEN 'missing_restart_execution_context' WHEN execution_context <> restart_context THEN 'incompatible_restart_execution_context' END AS code, run_id AS subject, restart_context AS related
  FROM a_runs WHERE restart_declared AND restart_context IS NOT NULL
  UNION ALL
  SELECT CASE WHEN NOT found THEN 'missing_restart_checkpoint' WHEN content_id IS NULL OR same THEN NULL WHEN unknown THEN 'unverified_restart_content' ELSE 'incompatible_restart_content' END, run_id, object_id FROM (
    SELECT c.run_id, c.object_id, c.content_id, count(k.hit) > 0 AS found, coalesce(bool_or(k.content = c.content_id), false) AS same, coalesce(bool_or(k.hit AND k.content IS NULL), false) AS unknown
    FROM a_checkpoints c JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ordinal) AS n FROM a_runs) WHERE n = 1 AND restart_declared) r ON r.run_id = c.run_id
    LEFT JOIN (
      SELECT c.run_id, c.pos, true AS hit, o.content_id AS content FROM a_checkpoints c JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id, revision_id ORDER BY ordinal) AS n FROM a_objects) WHERE n = 1) o ON o.object_id = c.object_id AND o.revision_id = c.revision_id
      UNION ALL SELECT c.run_id, c.pos, true, o.content_id FROM a_checkpoints c JOIN a_objects o ON o.object_id = c.object_id WHERE c.revision_id IS NULL
      UNION ALL SELECT c.run_id, c.pos, true, s.content_id FROM a_checkpoints c JOIN a_staged s ON s.object_id = c.object_id AND s.run_id = c.run_id WHERE c.revision_id IS NULL
      UNION ALL SELECT c.run_id, c.pos, true, s.content_id FROM a_checkpoints c JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ordinal) AS n FROM a_runs) WHERE n = 1) r ON r.run_id = c.run_id
        JOIN a_staged s ON s.object_id = c.object_id AND s.run_id = r.parent_run_id AND r.parent_run_id IN (SELECT run_id FROM a_runs) WHERE c.revision_id IS NULL) k ON k.run_id = c.run_id AND k.pos = c.pos
    GROUP BY c.run_id, c.pos, c.object_id, c.content_id)
) WHERE code IS NOT NULL""")
def _(a):
    return found(readiness.archive_restart(a))


ROOTS = [purge.Root("head", id="head-1"), purge.Root("head", id="head-2")]
PURGE_TABLES = "edges revisions heads objects refs externals runs activity_refs events event_refs log_streams"


def _reach(a):
    return purge.reachable(a, ROOTS, purge.Policy(keep_debug_logs=False))


REACH = SIGHT.format(roots="a_revisions") + """,
runs1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ordinal) AS n FROM a_runs) WHERE n = 1),
recs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY ordinal) AS n FROM a_revisions) WHERE n = 1),
stays AS (SELECT * FROM a_events WHERE retention IN ('pinned', 'forensic')),
asked AS (
  SELECT 'run|' || run_id AS src, object_id, revision_id FROM a_activity_refs
  UNION ALL SELECT CASE WHEN e.retention = 'pinned' THEN 'start' ELSE 'run|' || e.run_id END, f.object_id, f.revision_id FROM a_event_refs f JOIN stays e ON e.ordinal = f.event),
rules AS (
  SELECT 'start' AS src, 'snap|' || revision_id AS dst FROM a_heads WHERE head_id IN ('head-1', 'head-2') AND revision_id IN (SELECT revision_id FROM a_revisions)
  UNION SELECT 'start', 'run|' || run_id FROM a_events WHERE retention = 'pinned'
  UNION SELECT 'start', 'run|' || run_id FROM a_log_streams WHERE retention = 'pinned'
  UNION SELECT 'start', 'rec|' || r.revision_id FROM runs1 r WHERE r.revision_id IS NOT NULL AND (r.run_id IN (SELECT run_id FROM a_events WHERE retention = 'pinned') OR r.run_id IN (SELECT run_id FROM a_log_streams WHERE retention = 'pinned'))
  UNION SELECT 'start', 'rec|' || revision_id FROM stays WHERE retention = 'pinned' AND revision_id IS NOT NULL
  UNION SELECT 'run|' || run_id, 'rec|' || revision_id FROM stays WHERE retention <> 'pinned' AND revision_id IS NOT NULL
  UNION SELECT 'run|' || run_id, 'run|' || parent_run_id FROM a_runs WHERE parent_run_id IN (SELECT run_id FROM a_runs)
  UNION SELECT 'run|' || r.run_id, 'rec|' || p.revision_id FROM runs1 r JOIN runs1 p ON p.run_id = r.parent_run_id WHERE p.revision_id IS NOT NULL AND p.run_id <> r.run_id
  UNION SELECT src, 'obj|' || v.revision_id || '|' || v.ordinal FROM asked q JOIN versions v ON v.object_id = q.object_id AND (q.revision_id IS NULL OR v.revision_id = q.revision_id)
  UNION SELECT 'snap|' || v.revision_id, 'obj|' || v.revision_id || '|' || v.ordinal FROM versions v
  UNION SELECT 'snap|' || revision_id, 'rec|' || revision_id FROM recs
  UNION SELECT 'obj|' || v.revision_id || '|' || v.ordinal, 'rec|' || v.revision_id FROM versions v
  UNION SELECT 'rec|' || root, 'rev|' || revision_id FROM sight
  UNION SELECT 'rec|' || s.root, 'run|' || c.run_id FROM sight s JOIN recs c ON c.revision_id = s.revision_id WHERE c.run_id IS NOT NULL
  UNION SELECT 'rec|' || revision_id, 'rev|' || revision_id FROM (SELECT revision_id FROM runs1 WHERE revision_id IS NOT NULL UNION SELECT revision_id FROM stays WHERE revision_id IS NOT NULL)
  UNION SELECT 'rev|' || revision_id, 'run|' || run_id FROM a_runs WHERE revision_id IS NOT NULL
  UNION SELECT 'obj|' || n.root || '|' || n.owner, 'obj|' || n.root || '|' || n.target FROM near n),
got(node) AS (SELECT 'start' UNION SELECT r.dst FROM got g JOIN rules r ON r.src = g.node)"""
REACH_ROWS = """
SELECT 'run' AS kind, substr(node, 5) AS id FROM got WHERE starts_with(node, 'run|')
UNION SELECT 'revision', substr(node, 5) FROM got WHERE starts_with(node, 'rev|')
UNION SELECT 'object', v.object_id || '@' || v.revision_id FROM got JOIN versions v ON v.ordinal = split_part(node, '|', 3)::BIGINT WHERE starts_with(node, 'obj|')
UNION SELECT 'head', head_id FROM a_heads WHERE 'rev|' || revision_id IN (SELECT node FROM got) OR head_id IN ('head-1', 'head-2')"""


@query("c12_reachable", PURGE_TABLES, "WITH RECURSIVE " + REACH + REACH_ROWS)
def _(a):
    """What two heads, and all pinned events and logs, keep."""
    return _kept(_reach(a))


def _kept(r):
    parts = [
        r.runs.select(F.lit("run").alias("kind"), F.col("run_id").alias("id")),
        r.revisions.select(F.lit("revision").alias("kind"), F.col("revision_id").alias("id")),
        r.objects.select(F.lit("object").alias("kind"), F.concat("object_id", F.lit("@"), "revision_id").alias("id")),
        r.heads.select(F.lit("head").alias("kind"), F.col("head_id").alias("id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


KEPT = """,
kept_runs AS (SELECT substr(node, 5) AS run_id FROM got WHERE starts_with(node, 'run|')),
kept_revisions AS (SELECT substr(node, 5) AS revision_id FROM got WHERE starts_with(node, 'rev|')),
kept_objects AS (SELECT DISTINCT v.object_id, v.revision_id FROM got JOIN versions v ON v.ordinal = split_part(node, '|', 3)::BIGINT WHERE starts_with(node, 'obj|')),
kept_heads AS (SELECT DISTINCT head_id FROM a_heads WHERE revision_id IN (SELECT revision_id FROM kept_revisions) OR head_id IN ('head-1', 'head-2')),
stored AS (SELECT o.*, (object_id, revision_id) IN (SELECT (object_id, revision_id) FROM kept_objects) AS kept FROM a_objects o),
streams AS (SELECT run_id, retention, 'l' AS t FROM a_log_streams UNION ALL SELECT run_id, retention, 'e' FROM a_events),
content AS (SELECT content_id, count(*) FILTER (WHERE kept) AS n, min(ordinal) % 1000 AS bytes FROM stored WHERE content_id IS NOT NULL GROUP BY content_id),
lost AS (
  SELECT DISTINCT l.target_object AS object_id FROM got g JOIN links l ON g.node = 'obj|' || l.root || '|' || l.owner
  WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.root = l.root AND n.owner = l.owner AND n.target_object = l.target_object AND n.target_revision IS NOT DISTINCT FROM l.target_revision)
  UNION SELECT object_id FROM asked q WHERE src IN (SELECT node FROM got) AND NOT EXISTS (SELECT 1 FROM versions v WHERE v.object_id = q.object_id AND (q.revision_id IS NULL OR v.revision_id = q.revision_id)))"""


@query("c12_purge_plan", PURGE_TABLES, "WITH RECURSIVE " + REACH + KEPT + """
SELECT 'reachable' AS what, count(*) FILTER (WHERE kept) AS n FROM stored
UNION ALL SELECT 'unreachable', count(*) FILTER (WHERE NOT kept) FROM stored
UNION ALL SELECT 'external', count(DISTINCT object_id) FROM a_externals WHERE object_id IN (SELECT object_id FROM lost)
UNION ALL SELECT 'purgeable_debug', count(*) FROM streams WHERE run_id IN (SELECT run_id FROM kept_runs) AND retention IN ('debug', 'ephemeral')
UNION ALL SELECT 'retained_content', count(*) FROM content WHERE n > 0
UNION ALL SELECT 'omitted_content', count(*) FROM content WHERE n = 0
UNION ALL SELECT 'duplicated_content', count(*) FROM content WHERE n > 1
UNION ALL SELECT 'retained_bytes', sum(bytes)::BIGINT FROM content WHERE n > 0
UNION ALL SELECT 'omitted_bytes', sum(bytes)::BIGINT FROM content WHERE n = 0
UNION ALL SELECT 'omitted_revisions', count(DISTINCT revision_id) FROM a_revisions WHERE revision_id NOT IN (SELECT revision_id FROM kept_revisions)
UNION ALL SELECT 'omitted_runs', count(DISTINCT run_id) FROM a_runs WHERE run_id NOT IN (SELECT run_id FROM kept_runs)
UNION ALL SELECT 'retained_revisions', count(*) FROM kept_revisions
UNION ALL SELECT 'retained_runs', count(*) FROM kept_runs""")
def _(a):
    """The plan's counts."""
    sizes = a.objects.where("content_id IS NOT NULL").groupBy("content_id").agg((F.min("ordinal") % 1000).alias("bytes"))
    return purge.plan(a, ROOTS, purge.Policy(), sizes=sizes).summary


@query("o7_purge_classes", PURGE_TABLES, "WITH RECURSIVE " + REACH + KEPT + """
SELECT CASE WHEN kept THEN 'reachable' ELSE 'unreachable' END AS class, object_id, revision_id, content_id FROM stored
UNION ALL SELECT DISTINCT 'external', object_id, NULL, arg_min_null(content_id, ordinal) FROM a_externals WHERE object_id IN (SELECT object_id FROM lost) GROUP BY object_id
UNION ALL SELECT 'purgeable_debug', 'log-stream-' || ordinal || '-' || run_id, NULL, NULL FROM a_log_streams WHERE run_id IN (SELECT run_id FROM kept_runs) AND retention IN ('debug', 'ephemeral')
UNION ALL SELECT 'purgeable_debug', 'event-' || ordinal || '-' || run_id, NULL, NULL FROM a_events WHERE run_id IN (SELECT run_id FROM kept_runs) AND retention IN ('debug', 'ephemeral')""")
def _(a):
    return purge.plan(a, ROOTS, purge.Policy()).classes.select("class", "object_id", "revision_id", "content_id")


OTHER_ROOTS = [purge.Root("run", id="run-4"), purge.Root("log_stream", id="run-8", log_kind="stdout"), purge.Root("revision", revision_id="rev-5")]
OTHER_POLICY = purge.Policy(keep_uncommitted_runs=True, keep_ancestor_objects=True)
# The same rules from other roots: runs and log streams keep their record and what their revision holds, an object its closure.
OTHER_REACH = REACH.replace("""  SELECT 'start' AS src, 'snap|' || revision_id AS dst FROM a_heads WHERE head_id IN ('head-1', 'head-2') AND revision_id IN (SELECT revision_id FROM a_revisions)
""", """  SELECT 'start' AS src, 'snap|rev-5' AS dst
  UNION SELECT 'start', 'run|' || run_id FROM a_runs WHERE run_id IN ('run-4', 'run-8') OR revision_id IS NULL
  UNION SELECT 'start', 'snap|' || revision_id FROM runs1 WHERE run_id IN ('run-4', 'run-8') AND revision_id IN (SELECT revision_id FROM a_revisions)
  UNION SELECT 'start', 'rec|' || revision_id FROM runs1 WHERE run_id IN ('run-4', 'run-8') AND revision_id IS NOT NULL
  UNION SELECT 'start', 'obj|' || revision_id || '|' || ordinal FROM (SELECT * FROM versions ORDER BY object_id, revision_id LIMIT 1)
  UNION SELECT 'snap|' || s.root, 'held|' || v.ordinal FROM sight s JOIN versions v ON v.revision_id = s.revision_id
  UNION SELECT 'obj|' || o.revision_id || '|' || o.ordinal, 'held|' || v.ordinal FROM versions o JOIN sight s ON s.root = o.revision_id JOIN versions v ON v.revision_id = s.revision_id
""")


@query("c4_reachable_from_other_roots", PURGE_TABLES, "WITH RECURSIVE " + OTHER_REACH + """
SELECT 'run' AS kind, substr(node, 5) AS id FROM got WHERE starts_with(node, 'run|')
UNION SELECT 'revision', substr(node, 5) FROM got WHERE starts_with(node, 'rev|')
UNION SELECT 'object', v.object_id || '@' || v.revision_id FROM got JOIN versions v ON v.ordinal = split_part(node, '|', CASE WHEN starts_with(node, 'obj|') THEN 3 ELSE 2 END)::BIGINT WHERE starts_with(node, 'obj|') OR starts_with(node, 'held|')
UNION SELECT 'head', head_id FROM a_heads WHERE 'rev|' || revision_id IN (SELECT node FROM got)""")
def _(a):
    """What a revision, an object, a run, a log stream, all uncommitted runs and all pinned events and logs keep, ancestors' objects
    included."""
    first = a.objects.orderBy("object_id", "revision_id").select("object_id", "revision_id").first()
    roots = [*OTHER_ROOTS, purge.Root("object", id=first["object_id"], revision_id=first["revision_id"])]
    return _kept(purge.reachable(a, roots, OTHER_POLICY))


@query("a3_purge_report", PURGE_TABLES, "WITH RECURSIVE " + REACH + KEPT + """
SELECT (SELECT count(*) FILTER (WHERE kept) FROM stored) AS reachable, (SELECT count(*) FILTER (WHERE NOT kept) FROM stored) AS unreachable, (SELECT count(*) FROM kept_runs) AS retained_runs, (SELECT count(*) FROM kept_revisions) AS retained_revisions""")
def _(a):
    """The plan's counts as one row."""
    return records.plan_summary(purge.plan(a, ROOTS, purge.Policy())).select("reachable", "unreachable", "retained_runs", "retained_revisions")


@query("c13_compacted_rows", PURGE_TABLES + " writes", "WITH RECURSIVE " + REACH + KEPT + """
SELECT 'objects' AS "table", ordinal FROM stored WHERE kept
UNION ALL SELECT 'heads', ordinal FROM a_heads WHERE head_id IN (SELECT head_id FROM kept_heads)
UNION ALL SELECT 'revisions', ordinal FROM a_revisions WHERE revision_id IN (SELECT revision_id FROM kept_revisions)
UNION ALL SELECT 'runs', ordinal FROM a_runs WHERE run_id IN (SELECT run_id FROM kept_runs)
UNION ALL SELECT 'events', ordinal FROM a_events WHERE retention = 'pinned' OR (retention = 'forensic' AND run_id IN (SELECT run_id FROM kept_runs))
UNION ALL SELECT 'writes', ordinal FROM a_writes WHERE run_id IN (SELECT run_id FROM kept_runs)
UNION ALL SELECT 'log_streams', ordinal FROM a_log_streams WHERE retention = 'pinned' OR (retention = 'forensic' AND run_id IN (SELECT run_id FROM kept_runs))""")
def _(a):
    """Rows of the compacted archive's base tables."""
    policy = purge.Policy()
    small = purge.compact(a, purge.reachable(a, ROOTS, policy), policy)
    out = None
    for name in ("objects", "heads", "revisions", "runs", "events", "writes", "log_streams"):
        rows = getattr(small, name).select(F.lit(name).alias("table"), F.col("ordinal").cast("bigint").alias("ordinal"))
        out = rows if out is None else out.unionByName(rows)
    return out
