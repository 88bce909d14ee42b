"""Revision ancestry by doubling and striding over shortest distances.

A round joins the pairs at a distance of exactly d, the largest known so far, with all pairs up to d: every pair up to 2 d is a
shortest path of d steps and a rest, so each comes out about once, and the round after the last has nothing to join. From
given roots only as many distances are doubled as `DENSE` pairs for each edge allow; then the roots' own frontier advances by
that stride, so the work is bounded by the edges and what the roots see, not by all pairs of a long chain.

Breadth-first search with a queue visits ancestors in the order of their distance and, at equal distance, of the least
sequence of parent positions. Sequences are not kept: what is reached in d + e steps is ordered by the place, among those
at distance d, of the node on its way and then by its own place among those at distance e from that node, two numbers. Their
rank within (source, distance) is the place that further rounds go on with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import diagnostic, first_by, union
from ..model import Archive
from ..staging import stage, unstage

DENSE = 8
PEELS = 3  # levels that a round of peeling takes off
LEVELS = 6  # levels that a round of a search for a set takes up
DEALT_LEVELS = 8  # the same, of edges that need not be moved for a round


def known_edges(archive: Archive) -> DataFrame:
    """(child, parent, pos) between revisions that have records, a parent once, at its first position."""
    ids = archive.revisions.select(F.col("revision_id").alias("parent")).distinct()
    children = archive.revisions.select(F.col("revision_id").alias("child")).distinct()
    edges = archive.edges.join(ids, "parent", "left_semi").join(children, "child", "left_semi")
    return edges.groupBy("child", "parent").agg(F.min("pos").alias("pos"))


def read_parts(parts: list[DataFrame]) -> DataFrame:
    """Staged tables of one schema as one scan."""
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*[p.staged_path for p in parts])


def _further(ends: DataFrame, pairs: DataFrame, seen: DataFrame, base: int, ordered: bool) -> DataFrame:
    """Pairs beyond `base` steps: `ends`, all at that distance, prolonged by `pairs`, but for those that are `seen`."""
    left = ends.select("source", F.col("target").alias("mid"), *([F.col("place").alias("a")] if ordered else []))
    right = pairs.select(F.col("source").alias("mid"), "target", (F.col("steps") + base).alias("steps"), *([F.col("place").alias("b")] if ordered else []))
    found = left.join(right, "mid").drop("mid")
    if not ordered:
        best = seen.select("source", "target", "steps").unionByName(found).groupBy("source", "target").agg(F.min("steps").alias("steps"))
        return stage(best.where(F.col("steps") > base), "closure")
    known = seen.select("source", "target", "steps", F.lit(0).alias("a"), F.lit(0).alias("b"))
    best = known.unionByName(found).groupBy("source", "target").agg(F.min(F.struct("steps", "a", "b")).alias("m")).where(F.col("m.steps") > base)
    place = F.row_number().over(Window.partitionBy("source", "m.steps").orderBy("m.a", "m.b"))
    return stage(best.select("source", "target", "m.steps", place.alias("place")), "closure")


def closure(edges: DataFrame, roots: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """(source, target, steps[, place]) of all connected pairs, or of those from `roots` (source); `edges` has (source, target,
    pos). A node on a cycle is paired with itself."""
    first = edges.select("source", "target", F.lit(1).alias("steps"), *([F.row_number().over(Window.partitionBy("source").orderBy("pos")).alias("place")] if ordered else []))
    parts = [stage(first, "closure")]
    size = most = parts[0].count()
    most *= DENSE
    span, ends = 1, parts[0]
    while (roots is None or size <= most) and not ends.isEmpty():
        pairs = read_parts(parts)
        new = _further(ends, pairs, pairs, span, ordered)
        parts.append(new)
        size += new.count()
        span *= 2
        ends = new.where(F.col("steps") == span)
    if roots is None:
        return read_parts(parts)
    pairs = read_parts(parts)
    seen = [stage(pairs.join(roots.select("source").distinct(), "source", "left_semi").select(*pairs.columns), "closure")]
    base, ends = span, seen[0].where(F.col("steps") == span)
    while not ends.isEmpty():
        seen.append(_further(ends, pairs, read_parts(seen), base, ordered))
        base += span
        ends = seen[-1].where(F.col("steps") == base)
    unstage(*parts)
    return read_parts(seen)


def upward(archive: Archive) -> DataFrame:
    return known_edges(archive).select(F.col("child").alias("source"), F.col("parent").alias("target"), "pos")


def parents(archive: Archive) -> DataFrame:
    return known_edges(archive)


def children(archive: Archive) -> DataFrame:
    """(revision_id, child) of every revision that is named as a parent, recorded or not."""
    ids = archive.revisions.select(F.col("revision_id").alias("child")).distinct()
    return archive.edges.join(ids, "child", "left_semi").select(F.col("parent").alias("revision_id"), "child").distinct()


def _roots(roots: DataFrame | None) -> DataFrame | None:
    return None if roots is None else roots.select(F.col("revision_id").alias("source")).distinct()


def ancestors(archive: Archive, roots: DataFrame | None = None) -> DataFrame:
    """(revision_id, ancestor); never itself, not even on a cycle. `roots` has revision_id."""
    pairs = closure(upward(archive), _roots(roots)).where("source <> target")
    return pairs.select(F.col("source").alias("revision_id"), F.col("target").alias("ancestor"))


def descendants(archive: Archive, roots: DataFrame | None = None) -> DataFrame:
    """(revision_id, descendant) of recorded revisions."""
    down = known_edges(archive).select(F.col("parent").alias("source"), F.col("child").alias("target"), "pos")
    pairs = closure(down, _roots(roots)).where("source <> target")
    return pairs.select(F.col("source").alias("revision_id"), F.col("target").alias("descendant"))


def visible(archive: Archive, roots: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(root, revision_id, rank): what each root sees, itself first, in breadth-first order over its parents in their order.

    `pairs` is the archive's ordered closure, where the caller has it already.
    """
    roots = roots.select("revision_id").distinct().join(archive.revisions.select("revision_id").distinct(), "revision_id", "left_semi")
    own = roots.select(F.col("revision_id").alias("root"), "revision_id", F.lit(0).alias("steps"), F.lit(0).alias("place"))
    if pairs is None:
        pairs = closure(upward(archive), _roots(roots), ordered=True)
    else:
        pairs = pairs.join(_roots(roots), "source", "left_semi")
    seen = pairs.where("source <> target").select(F.col("source").alias("root"), F.col("target").alias("revision_id"), "steps", "place")
    rank = F.row_number().over(Window.partitionBy("root").orderBy("steps", "place")) - 1
    return own.unionByName(seen).select("root", "revision_id", rank.alias("rank"))


def _left(edges: DataFrame, both: bool) -> DataFrame:
    """The edges that are left when nodes without parents (`both`: or without children) are peeled off until none is: nothing, if
    there are no cycles. A round takes away a level, and edges never meet in pairs of a whole chain."""
    edges = stage(edges.select("source", "target").distinct(), "peel")
    n = edges.count()
    while n:
        left = edges
        for _ in range(PEELS):
            has_parents = left.select(F.col("source").alias("_n")).distinct()
            inner = left.join(has_parents, F.col("target") == F.col("_n"), "left_semi")
            if both:
                has_children = left.select(F.col("target").alias("_n")).distinct()
                inner = inner.join(has_children, F.col("source") == F.col("_n"), "left_semi")
            left = inner
        left = stage(left, "peel")
        unstage(edges)
        edges, before = left, n
        n = edges.count()
        if n == before:
            break
    return edges


def above(edges: DataFrame, start: DataFrame, known: DataFrame | None = None, dealt: int | None = None) -> DataFrame:
    """(revision_id): `start` and all its ancestors by `edges` (source, target), but for what is `known`, which must hold its own
    ancestors. A set, not pairs: a round takes the frontier some levels up. `dealt` is the number of partitions by source that
    `edges` have, where they are cached so; a level then moves its frontier only."""
    if dealt:
        return _above_dealt(edges, start, known, dealt)

    def fresh(rows, *seen):
        rows = rows.distinct()
        for x in seen:
            rows = rows.join(x, "revision_id", "left_anti")
        return stage(rows, "above")

    closed = [] if known is None else [known]
    frontier = fresh(start.select("revision_id"), *closed)
    parts = [frontier]
    while not frontier.isEmpty():
        near, levels = frontier, []
        for _ in range(LEVELS):
            near = edges.join(near, F.col("source") == F.col("revision_id"), "left_semi").select(F.col("target").alias("revision_id")).distinct()
            levels.append(near)
        frontier = fresh(union(levels), read_parts(parts), *closed)
        parts.append(frontier)
    return read_parts(parts)


def _above_dealt(edges: DataFrame, start: DataFrame, known: DataFrame | None, dealt: int) -> DataFrame:
    """Each level reads the one before once, as what is `open` goes up beside what has gone up, so a round's plan is a chain."""
    def up(rows):
        rows = rows.join(edges, F.col("open") & (F.col("source") == F.col("revision_id")), "left")
        rows = rows.select(F.explode(F.array(F.struct("revision_id", F.lit(False).alias("open")), F.struct(F.col("target").alias("revision_id"), F.lit(True).alias("open")))).alias("_x"))
        return deal(rows.select("_x.*").where("revision_id IS NOT NULL"))

    def deal(rows):
        return rows.repartition(dealt, "revision_id").groupBy("revision_id").agg(F.min("open").alias("open"))

    closed = [] if known is None else [known.select("revision_id")]
    parts, rows = [], deal(start.select("revision_id", F.lit(True).alias("open")))
    while True:
        for x in [*([read_parts(parts).select("revision_id")] if parts else []), *closed]:
            rows = rows.join(x.repartition(dealt, "revision_id"), "revision_id", "left_anti")
        parts.append(stage(rows, "above"))
        rows = parts[-1].where("open")
        if rows.isEmpty():
            return read_parts(parts).select("revision_id")
        rows = rows.repartition(dealt, "revision_id")
        for _ in range(DEALT_LEVELS):
            rows = up(rows)


def closure_above(edges: DataFrame, roots: DataFrame, dealt: int | None = None) -> DataFrame:
    """The ordered closure from `roots` (revision_id), of what lies above them only."""
    within = above(edges, roots, dealt=dealt)
    return closure(edges.join(within, F.col("source") == F.col("revision_id"), "left_semi"), _roots(roots), ordered=True)


def on_cycle(archive: Archive, within: DataFrame | None = None) -> DataFrame:
    """Revisions that are their own ancestors, of those in `within` (revision_id), which must hold its own ancestors."""
    edges = upward(archive)
    if within is not None:
        edges = edges.join(within.select("revision_id").distinct(), F.col("source") == F.col("revision_id"), "left_semi")
    left = _left(edges, both=True)
    if left.isEmpty():
        return left.select(F.col("source").alias("revision_id"))
    return closure(left).where("source = target").select(F.col("source").alias("revision_id"))


def dangling_parents(archive: Archive) -> DataFrame:
    named = archive.edges.select("child", "parent").distinct()
    ids = archive.revisions.select("revision_id").distinct()
    rows = named.join(ids, F.col("child") == F.col("revision_id"), "left_semi").join(ids, F.col("parent") == F.col("revision_id"), "left_anti")
    return diagnostic(rows, "dangling_parent", "child", "parent", "revision {child} names unknown parent {parent}", revision_id=F.col("child"), parent_id=F.col("parent"))


def cycle_check(archive: Archive) -> DataFrame:
    """One row when peeling off revisions without unpeeled parents leaves some: those on cycles or below them. The least of
    their ids is named, a deterministic choice."""
    left = _left(upward(archive), both=False).agg(F.min("source").alias("revision_id")).where("revision_id IS NOT NULL")
    return diagnostic(left, "cycle", "revision_id", None, "revision parent graph contains a cycle including {revision_id}", revision_id=F.col("revision_id"))


def first_revisions(archive: Archive) -> DataFrame:
    return first_by(archive.revisions, ["revision_id"])
