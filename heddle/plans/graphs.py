"""Queries of revision ancestry."""

from pyspark.sql import functions as F

from ..operators import dag
from .base import found, query

KNOWN = """
known AS (SELECT child, parent, min(pos) AS pos FROM a_edges WHERE parent IN (SELECT revision_id FROM a_revisions) AND child IN (SELECT revision_id FROM a_revisions) GROUP BY child, parent),
pairs(source, target) AS (SELECT child, parent FROM known UNION SELECT p.source, k.parent FROM pairs p JOIN known k ON k.child = p.target)"""

# All simple paths up from the roots, of any length.
WALK = """walk(root, node, steps, path, seen) AS (
  SELECT revision_id, revision_id, 0, '', [revision_id] FROM roots
  UNION ALL
  SELECT w.root, k.parent, w.steps + 1, w.path || lpad(k.pos::VARCHAR, 20, '0'), list_append(w.seen, k.parent) FROM walk w JOIN known k ON k.child = w.node WHERE NOT list_contains(w.seen, k.parent))"""


@query("g1_revision_parents", "edges revisions", "WITH RECURSIVE " + KNOWN + " SELECT child, parent, pos FROM known")
def _(a):
    return dag.parents(a)


@query("g2_revision_children", "edges revisions", "SELECT DISTINCT parent AS revision_id, child FROM a_edges WHERE child IN (SELECT revision_id FROM a_revisions)")
def _(a):
    return dag.children(a)


@query("g3_revision_ancestors", "edges revisions heads", "WITH RECURSIVE " + KNOWN + " SELECT source AS revision_id, target AS ancestor FROM pairs WHERE source <> target AND source IN (SELECT revision_id FROM a_heads)")
def _(a):
    return dag.ancestors(a, a.heads)


@query("g4_revision_descendants", "edges revisions", "WITH RECURSIVE " + KNOWN + " SELECT target AS revision_id, source AS descendant FROM pairs WHERE source <> target")
def _(a):
    return dag.descendants(a)


@query("g5_visible_order", "edges revisions heads", "WITH RECURSIVE " + KNOWN.split(",\npairs")[0] + """,
roots AS (SELECT DISTINCT revision_id FROM a_heads WHERE revision_id IN (SELECT revision_id FROM a_revisions)),
""" + WALK + """
SELECT root, node AS revision_id, row_number() OVER (PARTITION BY root ORDER BY steps, path) - 1 AS rank
FROM (SELECT root, node, steps, min(path) AS path FROM walk GROUP BY root, node, steps QUALIFY steps = min(steps) OVER (PARTITION BY root, node))""")
def _(a):
    return dag.visible(a, a.heads).select("root", "revision_id", F.col("rank").cast("long").alias("rank"))


@query("g6_cycle_check", "edges revisions", "WITH RECURSIVE " + KNOWN + """
SELECT 'cycle' AS code, least_id AS subject, '' AS related FROM (
  SELECT min(id) AS least_id FROM (SELECT source AS id FROM pairs WHERE target IN (SELECT source FROM pairs WHERE source = target))) WHERE least_id IS NOT NULL""")
def _(a):
    return found(dag.cycle_check(a))


@query("g6_dangling_parents", "edges revisions", "SELECT DISTINCT 'dangling_parent' AS code, child AS subject, parent AS related FROM a_edges WHERE child IN (SELECT revision_id FROM a_revisions) AND parent NOT IN (SELECT revision_id FROM a_revisions)")
def _(a):
    return found(dag.dangling_parents(a))


@query("g7_revisions_on_cycles", "edges revisions", "WITH RECURSIVE " + KNOWN + " SELECT source AS revision_id FROM pairs WHERE source = target")
def _(a):
    return dag.on_cycle(a)
