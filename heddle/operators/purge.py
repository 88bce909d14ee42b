"""Retention: what roots reach, the plan of what else may go, and the compacted archive.

Everything that is kept follows by rules from one member each, so runs, revisions and what is asked for are the nodes of one
graph that is searched as a set. Objects lead to no more of these than their own revision does, so the closures of all that is
asked for are taken once, after the search, over the objects and references of the revisions that they see.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import diagnostic, distinct_diagnostics, first_by, union
from ..model import Archive
from ..staging import near, release, stage
from . import dag, manifest, rules
from .resolve import match_external

C, L = F.col, F.lit
ROOT_KINDS = ("head", "revision", "object", "run", "log_stream")
ARCS = 1_000_000  # of the searched graph, in a partition
LONGEST = (1 << 31) - 1


@dataclass(frozen=True)
class Policy:
    keep_debug_logs: bool = False
    keep_forensic_logs: bool = True
    keep_uncommitted_runs: bool = False
    keep_ancestor_objects: bool = False


@dataclass(frozen=True)
class Root:
    """One retention root: a head by id or name, a revision, an object version, a run, or a run's log stream."""

    kind: str
    id: str = ""
    name: str = ""
    revision_id: str = ""
    log_kind: str = ""

    def __post_init__(self):
        if self.kind not in ROOT_KINDS:
            raise ValueError(f"unknown root kind {self.kind}")


@dataclass(frozen=True)
class Reach:
    objects: DataFrame
    revisions: DataFrame
    runs: DataFrame
    heads: DataFrame
    externals: DataFrame
    find_diagnostics: Callable[[], DataFrame]
    forced: list[tuple[str, str]] = field(default_factory=list)

    @cached_property
    def diagnostics(self) -> DataFrame:
        """Found when they are first asked for."""
        return self.find_diagnostics()


@dataclass(frozen=True)
class Plan:
    policy: Policy
    reach: Reach
    classes: DataFrame
    summary: DataFrame


def _one(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise LookupError(message)
    return df


def keep_by_retention(policy: Policy, in_runs, retention="retention"):
    """Whether a log stream or an event stays: pinned ones always, others with their run and the policy."""
    r = C(retention)
    return (r == "pinned") | (in_runs & F.when(r == "forensic", L(policy.keep_forensic_logs)).otherwise(L(policy.keep_debug_logs)))


def reachable(a: Archive, roots: list[Root], policy: Policy = Policy(), externals: DataFrame | None = None) -> Reach:
    externals = a.externals if externals is None else externals
    spark = a.objects.sparkSession
    first_runs = stage(first_by(a.runs, ["run_id"]).select("run_id", "revision_id", "parent_run_id"), "purge-runs")
    recs = stage(dag.first_revisions(a).select("revision_id", "run_id"), "purge-revisions")

    def frame(schema):
        return spark.createDataFrame([], schema)

    heads, snapshots, seeds, runs, forced = [], [], [], [], []
    for r in roots:
        if r.kind == "head":
            h = _one(a.heads.where((C("head_id") == r.id) if r.id else (C("name") == r.name)), "a head root does not resolve")
            h = first_by(h, ["head_id"]) if r.id else h
            heads.append(h.select("head_id"))
            snapshots.append(h.select("revision_id"))
        elif r.kind == "revision":
            snapshots.append(_one(recs.where(C("revision_id") == r.revision_id), "a revision root is not in the archive").select("revision_id"))
        elif r.kind == "object":
            seeds.append(_one(a.objects.where((C("object_id") == r.id) & (C("revision_id") == r.revision_id)), "an object root is missing").select("object_id", "revision_id"))
        else:
            found = _one(first_runs.where(C("run_id") == r.id), "a run root is not in the archive")
            if r.kind == "log_stream":
                _one(a.log_streams.where((C("run_id") == r.id) & (C("kind") == r.log_kind)), "a log stream root is not in the archive")
                forced.append((r.id, r.log_kind))
            runs.append(found.select("run_id"))
            snapshots.append(found.where("revision_id IS NOT NULL").select("revision_id"))
    snapshot_roots = stage(union([frame("revision_id string"), *snapshots]).distinct(), "purge-roots")
    seeds = union([frame("object_id string, revision_id string"), *seeds]).distinct()

    # what activities, and events that stay with their run or always, refer to
    pinned = C("retention") == "pinned"
    events = a.events.where(keep_by_retention(policy, L(True))).select("ordinal", "run_id", "revision_id", pinned.alias("pinned"))
    named = a.event_refs.join(events.select(C("ordinal").alias("event"), "run_id", "pinned"), "event").select("run_id", "pinned", C("run_id").alias("subject"), "object_id", "revision_id", L("dangling_event_object").alias("code"))
    named = named.unionByName(a.activity_refs.select("run_id", L(False).alias("pinned"), C("activity_id").alias("subject"), "object_id", "revision_id", L("missing_activity_object").alias("code")))
    named = stage(named, "purge-named")
    asked = stage(named.select("object_id", "revision_id").distinct(), "purge-asked")
    ids = near(stage(asked.select("object_id").distinct(), "purge-ids"))
    held = stage(a.objects.join(ids, "object_id", "left_semi").select("object_id", C("revision_id").alias("version")), "purge-held")
    meant = union([
        asked.where("revision_id IS NULL").join(held, "object_id").select("object_id", "revision_id", "version"),
        asked.where("revision_id IS NOT NULL").join(held.withColumn("revision_id", C("version")), ["object_id", "revision_id"]).select("object_id", "revision_id", "version"),
    ])
    meant = stage(meant.distinct(), "purge-versions")

    # runs that are kept from the start, and what is asked for with them: no arc needs to lead to these
    seeded = stage(union([frame("run_id string"), *[x.where("retention = 'pinned'").select("run_id") for x in (a.log_streams, a.events)], *runs]).distinct(), "purge-seeded")
    records = seeded.join(first_runs, "run_id").where("revision_id IS NOT NULL").select("revision_id")
    if policy.keep_uncommitted_runs:
        seeded = stage(seeded.unionByName(a.runs.where("revision_id IS NULL").select("run_id")).distinct(), "purge-seeded")
    sure = near(seeded)
    early = stage(named.where("pinned").unionByName(named.where("NOT pinned").join(sure, "run_id", "left_semi").select(*named.columns)).select("object_id", "revision_id").distinct(), "purge-early")
    late = named.where("NOT pinned").join(sure, "run_id", "left_anti").select("run_id", "object_id", "revision_id").distinct()
    late = late.join(early.select(C("object_id").alias("_o"), C("revision_id").alias("_r")), (C("object_id") == C("_o")) & C("revision_id").eqNullSafe(C("_r")), "left_anti")
    written = events.where("NOT pinned AND revision_id IS NOT NULL").select("run_id", "revision_id")

    # the graph that is searched: runs, revisions, and what is asked for; only parents have a position
    run, rev, ask = _node("run", "run_id"), _node("rev", "revision_id"), _node("ask", F.to_json(F.struct("object_id", "revision_id")))
    parents = first_runs.where("parent_run_id IS NOT NULL").select("run_id", "parent_run_id")
    known = first_runs.select(C("run_id").alias("parent_run_id"), "revision_id")
    up = parents.join(known, "parent_run_id")
    arcs = union([
        dag.upward(a.replaced(revisions=recs)).select(_node("rev", "source").alias("source"), _node("rev", "target").alias("target"), "pos"),
        *[
            x.select(s.alias("source"), t.alias("target"), L(None).cast("bigint").alias("pos"))
            for x, s, t in (
                (recs.where("run_id IS NOT NULL").join(sure, "run_id", "left_anti"), rev, run),
                (a.runs.where("revision_id IS NOT NULL").select("run_id", "revision_id").join(sure, "run_id", "left_anti").distinct(), rev, run),
                (up.join(sure.select(C("run_id").alias("parent_run_id")), "parent_run_id", "left_anti"), run, _node("run", "parent_run_id")),
                (up.where("parent_run_id <> run_id AND revision_id IS NOT NULL"), run, rev),
                (written.join(sure, "run_id", "left_anti"), run, rev),
                (late, run, ask),
                (meant.select(ask.alias("_a"), C("version").alias("revision_id")).distinct(), C("_a"), rev),
            )
        ],
    ])
    # cached as dealt and sorted by source, so that each level of a search moves its frontier only
    dealt = max(spark.sparkContext.defaultParallelism, 2 * recs.count() // ARCS)
    graph = arcs.repartition(dealt, "source").sortWithinPartitions("source").persist(StorageLevel.MEMORY_AND_DISK)

    start = [
        seeded.select(run.alias("n")), early.select(ask.alias("n")),
        *[x.select(rev.alias("n")) for x in (snapshot_roots, records, seeds, events.where("pinned AND revision_id IS NOT NULL"), written.join(sure, "run_id", "left_semi"))],
    ]
    kept = dag.above(graph, union(start).select(C("n").alias("revision_id")), dealt=dealt)

    def of_kind(kind, name):
        return kept.where(F.startswith("revision_id", L(f"{kind}|"))).select(F.substring("revision_id", len(kind) + 2, LONGEST).alias(name))

    kept_runs = stage(of_kind("run", "run_id"), "purge-runs-kept")
    kept_revisions = stage(of_kind("rev", "revision_id"), "purge-kept")
    wanted = kept.where(F.startswith("revision_id", L("ask|"))).withColumnRenamed("revision_id", "_n")
    fresh = stage(meant.join(wanted, ask == C("_n"), "left_semi").select("object_id", C("version").alias("revision_id")).unionByName(seeds).distinct(), "purge-seeds")

    # closures of the seeds, each as its own revision sees it
    own = stage(fresh.select("revision_id").unionByName(snapshot_roots).distinct(), "purge-own")
    pairs = dag.closure_above(graph.where("pos IS NOT NULL"), own.join(recs, "revision_id", "left_semi").select(rev.alias("revision_id")), dealt)
    pairs = pairs.withColumns({c: F.substring(c, 5, LONGEST) for c in ("source", "target")})
    sight = stage(dag.visible(a.replaced(revisions=recs), own, pairs), "purge-sight")
    graph.unpersist()
    within = near(stage(sight.select("revision_id").unionByName(own).distinct(), "purge-within"))
    objects = stage(first_by(a.objects.select("object_id", "revision_id", "ordinal").join(within, "revision_id", "left_semi"), ["object_id", "revision_id"]), "manifest-objects")
    release(spark)
    refs = a.refs.select("owner", "revision_id", "target_object", "target_revision").join(within, "revision_id", "left_semi")
    refs = refs.join(objects.select(C("ordinal").alias("owner")), "owner", "left_semi")
    refs = stage(refs.select("owner", "target_object", "target_revision"), "manifest-refs")
    release(spark)
    first = fresh.unionByName(objects.join(snapshot_roots.join(recs, "revision_id", "left_semi"), "revision_id", "left_semi").select("object_id", "revision_id")).distinct()
    reached, slots = manifest.entries(a, sight, first.join(objects, ["object_id", "revision_id"]).withColumn("root", C("revision_id")), (objects, refs))
    kept_objects = reached.select("object_id", "revision_id")
    if policy.keep_ancestor_objects:
        kept_objects = kept_objects.unionByName(_in_scope(objects, sight))
    kept_objects = stage(kept_objects.distinct(), "purge-objects-kept")
    release(spark)

    all_heads = union([frame("head_id string"), *heads, a.heads.join(kept_revisions, "revision_id", "left_semi").select("head_id")]).distinct()
    # a reference met its versions once, however many subjects name it; subjects only come back for those that are lost
    nothing = asked.join(meant.select(C("object_id").alias("_o"), C("revision_id").alias("_r")).distinct(), (C("object_id") == C("_o")) & C("revision_id").eqNullSafe(C("_r")), "left_anti")
    nothing = nothing.select(C("object_id").alias("_o"), C("revision_id").alias("_r"))
    lost = named.join(nothing, (C("object_id") == C("_o")) & C("revision_id").eqNullSafe(C("_r")), "left_semi")
    lost = lost.where("pinned").unionByName(lost.where("NOT pinned").join(kept_runs, "run_id", "left_semi").select(*lost.columns))
    lost = match_external(lost.select("code", "subject", "object_id").distinct(), externals, "object_id")
    open_ = match_external(slots.select("root", "object_id").unionByName(lost.where("external").select(L(None).cast("string").alias("root"), "object_id")).distinct(), externals, "object_id")
    used = open_.where("external").select("object_id", C("external_content").alias("content_id")).distinct()

    def diagnostics():
        lone = diagnostic(parents.join(kept_runs, "run_id", "left_semi").join(known, "parent_run_id", "left_anti"), "missing_parent_run", "run_id", "parent_run_id", "parent run {parent_run_id} of run {run_id} is not known")
        absent = diagnostic(lost.where("NOT external"), C("code"), "subject", "object_id", "{subject} names missing object {object_id}")
        unresolved = diagnostic(open_.where("NOT external"), "missing_manifest_object", "root", "object_id", "revision {root} names missing object {object_id}", revision_id=C("root"), object_id=C("object_id"))
        whole = manifest.record_diagnostics(a, sight.join(snapshot_roots.select(C("revision_id").alias("root")), "root", "left_semi"))
        return distinct_diagnostics(union([whole.drop("root"), lone, absent, unresolved]))

    return Reach(kept_objects, kept_revisions, kept_runs, all_heads, used, diagnostics, forced)


def _node(kind: str, value) -> Column:
    return F.concat(L(f"{kind}|"), C(value) if isinstance(value, str) else value)


def _in_scope(held: DataFrame, visible: DataFrame) -> DataFrame:
    return held.join(visible.select("revision_id").distinct(), "revision_id", "left_semi").select("object_id", "revision_id")


def _streams(a: Archive, reach: Reach, policy: Policy, table: str) -> DataFrame:
    """Rows of log_streams or events with (in_runs, keep)."""
    rows = getattr(a, table).join(near(reach.runs).withColumn("_in", L(True)), "run_id", "left").withColumn("in_runs", C("_in").isNotNull()).drop("_in")
    keep = keep_by_retention(policy, C("in_runs"))
    for run, kind in reach.forced if table == "log_streams" else []:
        keep = keep | ((C("run_id") == run) & (C("kind") == kind))
    return rows.withColumn("keep", keep)


def plan(a: Archive, roots: list[Root], policy: Policy = Policy(), externals: DataFrame | None = None, sizes: DataFrame | None = None) -> Plan:
    """A dry run: the class of every object and purgeable record, and one row of counts; `sizes` has (content_id, bytes)."""
    reach = reachable(a, roots, policy, externals)
    in_ = a.objects.join(near(reach.objects).withColumn("_in", L(True)), ["object_id", "revision_id"], "left")
    objects = stage(in_.select("object_id", "revision_id", "content_id", F.when(C("_in"), "reachable").otherwise("unreachable").alias("class")), "purge-classes")
    debug = [
        _streams(a, reach, policy, t).where("in_runs AND NOT keep").select(F.concat(L(f"{name}-"), C("ordinal"), L("-"), C("run_id")).alias("object_id"), L(None).cast("string").alias("revision_id"), L(None).cast("string").alias("content_id"), L("purgeable_debug").alias("class"))
        for t, name in (("log_streams", "log-stream"), ("events", "event"))
    ]
    outside = reach.externals.select("object_id", L(None).cast("string").alias("revision_id"), "content_id", L("external").alias("class"))
    classes = union([objects, outside, *debug])
    content = objects.where("content_id IS NOT NULL").groupBy("content_id").agg(F.count_if(C("class") == "reachable").alias("kept"))
    if sizes is not None:
        content = content.join(sizes, "content_id", "left").withColumn("bytes", F.coalesce("bytes", L(0)))
    else:
        content = content.withColumn("bytes", L(None).cast("long"))
    by_content = content.agg(
        F.count_if(C("kept") > 0).alias("retained_content"), F.count_if(C("kept") == 0).alias("omitted_content"), F.count_if(C("kept") > 1).alias("duplicated_content"),
        F.sum(F.when(C("kept") > 0, C("bytes"))).alias("retained_bytes"), F.sum(F.when(C("kept") == 0, C("bytes"))).alias("omitted_bytes"),
    )
    by_class = classes.agg(*[F.count_if(C("class") == c).alias(c) for c in ("reachable", "unreachable", "external", "purgeable_debug")])
    left_out = union([
        a.revisions.select("revision_id").distinct().join(reach.revisions, "revision_id", "left_anti").agg(F.count(L(1)).alias("n")).select(L("omitted_revisions").alias("what"), "n"),
        a.runs.select("run_id").distinct().join(reach.runs, "run_id", "left_anti").agg(F.count(L(1)).alias("n")).select(L("omitted_runs").alias("what"), "n"),
        reach.revisions.agg(F.count(L(1)).alias("n")).select(L("retained_revisions").alias("what"), "n"),
        reach.runs.agg(F.count(L(1)).alias("n")).select(L("retained_runs").alias("what"), "n"),
    ])
    counts = union([_unpivot(by_class), _unpivot(by_content), left_out])
    return Plan(policy, reach, classes.orderBy("class", "object_id", F.coalesce("revision_id", L(""))), counts)


def _unpivot(row: DataFrame) -> DataFrame:
    """A row of numbers as (what, n)."""
    return row.select(F.explode(F.array(*[F.struct(L(c).alias("what"), C(c).cast("long").alias("n")) for c in row.columns])).alias("x")).select("x.what", "x.n")


def compact(a: Archive, reach: Reach, policy: Policy) -> Archive:
    """The tables with only what is kept; the source is untouched."""
    # by revision first, a filter that Spark can move below windows over the rows of one revision
    objects = a.objects.join(reach.objects.select("revision_id").distinct(), "revision_id", "left_semi").join(reach.objects, ["object_id", "revision_id"], "left_semi")
    owners = objects.select(C("ordinal").alias("owner"))
    runs = a.runs.join(reach.runs, "run_id", "left_semi")
    events = _streams(a, reach, policy, "events").where("keep").drop("in_runs", "keep")
    kept_events = events.select(C("ordinal").alias("event"))

    def of_runs(table):
        return getattr(a, table).join(reach.runs, "run_id", "left_semi")

    revisions = a.revisions.join(reach.revisions, "revision_id", "left_semi")
    return a.replaced(
        objects=objects,
        refs=a.refs.join(owners, "owner", "left_semi"),
        heads=a.heads.join(reach.heads, "head_id", "left_semi"),
        revisions=revisions,
        edges=a.edges.join(revisions.select(C("revision_id").alias("child")).distinct(), "child", "left_semi"),
        runs=runs,
        checkpoints=of_runs("checkpoints"),
        activities=of_runs("activities"),
        activity_refs=of_runs("activity_refs"),
        staged=of_runs("staged"),
        events=events,
        event_refs=a.event_refs.join(kept_events, "event", "left_semi"),
        event_payload=a.event_payload.join(kept_events, "event", "left_semi"),
        writes=a.writes.where("run_id IS NOT NULL").join(reach.runs, "run_id", "left_semi"),
        log_streams=_streams(a, reach, policy, "log_streams").where("keep").drop("in_runs", "keep"),
    )


def verify(compacted: Archive, reach: Reach, externals: DataFrame | None = None) -> DataFrame:
    """What is wrong with a compacted archive: its own checks, but for references that externals explain, and revisions that
    can't be inspected."""
    externals = compacted.externals if externals is None else externals
    own = rules.validate(compacted)
    known = externals.select(C("object_id").alias("related")).distinct()
    own = own.where("code <> 'dangling_reference'").unionByName(own.where("code = 'dangling_reference'").join(known, "related", "left_anti").select(*own.columns))
    m = manifest.manifests(compacted, reach.revisions, externals=externals)
    return union([reach.diagnostics, own, manifest.validate(m).drop("root")])


def publish(a: Archive, roots: list[Root], path: str, policy: Policy = Policy(), externals: DataFrame | None = None) -> tuple[Plan, DataFrame, bool]:
    """Writes the compacted archive to a new folder, verifies it as read from there, and marks it with a `_VERIFIED` file only
    if nothing is wrong, which is what `files.load` with `verified` asks for."""
    from ..sources import files

    p = plan(a, roots, policy, externals)
    spark = a.objects.sparkSession
    files.save(compact(a, p.reach, policy), path)
    wrong = verify(files.load(spark, path, config=a.config), p.reach, externals)
    good = rules.is_valid(wrong)
    if good:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{files.VERIFIED}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target).close()
    return p, wrong, good
