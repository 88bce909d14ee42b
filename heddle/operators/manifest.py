"""What a revision holds: inspection and checkout of many revisions at once.

The entries of a root are the objects of its revision and what they refer to, transitively, each reference resolved as the
root sees it. The frontier of all roots advances together; a round resolves only the references of objects that were new
in the round before, and ends when none is new anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import diagnostic, first_by, union
from ..model import Archive
from ..staging import release, stage, unstage
from . import dag
from .lookup import Ambiguous, find_head
from .resolve import in_scope, match_external, sights, versions

C, L = F.col, F.lit


@dataclass(frozen=True)
class Manifest:
    """entries: (root, object_id, revision_id, content_id, availability, rank); diagnostics also have the root."""

    mode: str
    roots: DataFrame
    entries: DataFrame
    visible: DataFrame
    archive: Archive

    @cached_property
    def diagnostics(self) -> DataFrame:
        """Found when they are first asked for: missing objects, and what is wrong with the revisions that a root sees."""
        missing = self.entries.where("availability = 'missing'").withColumn("_s", C("root"))
        problems = diagnostic(missing, "missing_manifest_object", "root", "object_id", "revision {root} names missing object {object_id}", revision_id=C("root"), object_id=C("object_id"))
        return problems.withColumn("root", C("subject")).unionByName(record_diagnostics(self.archive, self.visible))


def root_of(archive: Archive, *, revision_id: str | None = None, head_id: str | None = None, name: str | None = None, run_id: str | None = None) -> DataFrame:
    """The revision that one argument stands for; what doesn't resolve raises."""
    if revision_id is not None:
        found = archive.revisions.where(C("revision_id") == revision_id)
    elif head_id is not None or name is not None:
        found = find_head(archive, head_id=head_id, name=name)
    else:
        found = first_by(archive.runs.where(C("run_id") == run_id), ["run_id"]).where("revision_id IS NOT NULL")
    found = found.select("revision_id").join(archive.revisions.select("revision_id").distinct(), "revision_id", "left_semi").distinct()
    if found.isEmpty():
        raise LookupError("the argument leads to no recorded revision")
    return found


def tables(archive: Archive) -> tuple[DataFrame, DataFrame]:
    """Staged object versions (object_id, revision_id, ordinal) and references (owner, target_object, target_revision)."""
    objects = stage(versions(archive).select("object_id", "revision_id", "ordinal"), "manifest-objects")
    release(objects.sparkSession)
    refs = stage(archive.refs.select("owner", "target_object", "target_revision"), "manifest-refs")
    release(refs.sparkSession)
    return objects, refs


def entries(archive: Archive, visible: DataFrame, seeds: DataFrame | None = None, known: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Reached versions (root, object_id, revision_id, ordinal, level) and unresolved slots (root, object_id, revision_id),
    from `seeds` (root, object_id, revision_id, ordinal), or from all objects of each root's own revision. `known` are the
    archive's `tables`, where the caller has them."""
    objects, refs = known or tables(archive)
    seen = stage(sights(visible, objects), "manifest-sights")
    roots = visible.where("rank = 0").select("root")
    # all rows of the root's own revision are seeds; of a repeated version the first in canonical order speaks
    if seeds is None:
        seeds = archive.objects.select("object_id", "revision_id", "ordinal").join(roots, C("revision_id") == C("root"))
    frontier = stage(first_by(seeds, ["root", "object_id", "revision_id"]).withColumn("level", L(0)).select("root", "object_id", "revision_id", "ordinal", "level"), "manifest-frontier")
    reached, lost = [frontier], []
    level = 0
    while not frontier.isEmpty():
        level += 1
        asked = frontier.select("root", C("ordinal").alias("owner")).join(refs, "owner").select("root", "target_object", "target_revision").distinct()
        found = stage(in_scope(asked, seen), "manifest-resolved")
        lost.append(found.where("found_revision IS NULL").select("root", C("target_object").alias("object_id"), C("target_revision").alias("revision_id")))
        new = found.where("found_revision IS NOT NULL").select("root", C("target_object").alias("object_id"), C("found_revision").alias("revision_id"), C("found_ordinal").alias("ordinal"), L(level).alias("level"))
        # the earlier levels and the new rows meet in one aggregate: the least level of each version
        every = dag.read_parts(reached).unionByName(new).groupBy("root", "object_id", "revision_id").agg(F.min(F.struct("level", "ordinal")).alias("m"))
        frontier = stage(every.where(C("m.level") == level).select("root", "object_id", "revision_id", "m.ordinal", "m.level"), "manifest-frontier")
        reached.append(frontier)
    if known is None:
        unstage(objects, refs)
    unstage(seen)
    slots = union(lost).distinct() if lost else archive.refs.where("false").select(C("object_id").alias("root"), "object_id", "revision_id")
    return dag.read_parts(reached), slots


def manifests(
    archive: Archive, roots: DataFrame, mode: str = "inspect", externals: DataFrame | None = None, pairs: DataFrame | None = None, known: tuple[DataFrame, DataFrame] | None = None
) -> Manifest:
    """Manifests of all recorded revisions in `roots` (revision_id). `pairs` is an ordered closure from them and `known` are the
    archive's `tables`, where the caller has them."""
    if mode not in ("inspect", "checkout"):
        raise ValueError(f"unknown mode {mode}")
    externals = archive.externals if externals is None else externals
    visible = stage(dag.visible(archive, roots, pairs), "manifest-visible")
    reached, slots = entries(archive, visible, known=known)
    content = versions(archive).select("object_id", "revision_id", "content_id")
    present = reached.join(content, ["object_id", "revision_id"]).select("root", "object_id", "revision_id", "content_id", L("envelope_only").alias("availability"), "level")
    open_ = match_external(slots, externals, "object_id")
    absent = open_.select("root", "object_id", "revision_id", C("external_content").alias("content_id"), F.when(C("external"), "external_required").otherwise("missing").alias("availability"), L(None).cast("int").alias("level"))
    rows = present.unionByName(absent)
    return Manifest(mode, roots, rows, visible, archive)


def record_diagnostics(archive: Archive, visible: DataFrame) -> DataFrame:
    """Cycles, unknown parents, and disagreements with runs, of the revisions that each root sees."""
    recs = dag.first_revisions(archive)
    runs = first_by(archive.runs, ["run_id"]).select(C("run_id").alias("_run"), C("revision_id").alias("_rev"), C("plan_id").alias("_plan"))
    rows = recs.where("run_id IS NOT NULL").join(runs, C("run_id") == C("_run"), "left")
    code = F.when(C("_run").isNull(), "missing_revision_run").when(C("_rev").isNotNull() & (C("_rev") != C("revision_id")), "run_revision_mismatch").when(C("plan_id").isNotNull() & C("_plan").isNotNull() & (C("plan_id") != C("_plan")), "run_revision_plan_mismatch")
    against = diagnostic(rows.withColumn("code", code).where("code IS NOT NULL"), C("code"), "revision_id", "run_id", "revision {revision_id} and run {run_id} disagree")
    loops = diagnostic(dag.on_cycle(archive, visible), "cycle", "revision_id", None, "revision parent graph contains a cycle including {revision_id}")
    parents = dag.dangling_parents(archive).where("subject <> related")
    per_revision = union([against, loops, parents])
    return per_revision.join(visible.select("root", C("revision_id").alias("subject")), "subject").select(*per_revision.columns, "root")


def header(archive: Archive, manifest: Manifest) -> DataFrame:
    """(root, run_id, plan_id, heads, objects, externals, missing) of every manifest."""
    counts = manifest.entries.groupBy("root").agg(
        F.count_if(C("availability") == "envelope_only").alias("objects"), F.count_if(C("availability") == "external_required").alias("externals"), F.count_if(C("availability") == "missing").alias("missing")
    )
    recs = dag.first_revisions(archive).select(C("revision_id").alias("root"), "run_id", "plan_id")
    known = archive.runs.select("run_id").distinct().withColumn("_known", L(True))
    heads = archive.heads.groupBy(C("revision_id").alias("root")).agg(F.count(L(1)).alias("heads"))
    rows = manifest.visible.where("rank = 0").select("root").join(recs, "root").join(known, "run_id", "left").join(counts, "root", "left").join(heads, "root", "left")
    zero = L(0).cast("long")
    return rows.select("root", F.when(C("_known"), C("run_id")).alias("run_id"), "plan_id", *[F.coalesce(c, zero).alias(c) for c in ("heads", "objects", "externals", "missing")])


def select(manifest: Manifest, object_id: str, revision_id: str | None = None) -> DataFrame:
    """One slot of a manifest; an object with several versions in it must be pinned."""
    rows = manifest.entries.where(C("object_id") == object_id)
    if revision_id is not None:
        return rows.where(C("revision_id") == revision_id)
    if len(rows.limit(2).collect()) > 1:
        raise Ambiguous(f"object {object_id} has several versions in this manifest")
    return rows


def slots(manifest: Manifest) -> DataFrame:
    """(root, object_id, entries, revision_id): how often each object is in each manifest, and its version where that is one."""
    rows = manifest.entries.groupBy("root", "object_id").agg(F.count(L(1)).alias("entries"), F.min("revision_id").alias("_r"))
    return rows.select("root", "object_id", "entries", F.when(C("entries") == 1, C("_r")).alias("revision_id"))


def objects_of(archive: Archive, manifest: Manifest) -> Archive:
    """The archive with only the objects that manifests hold, for listings of their namespaces and schemas."""
    held = manifest.entries.where("availability = 'envelope_only'").select("object_id", "revision_id").distinct()
    return archive.replaced(objects=archive.objects.join(held, ["object_id", "revision_id"], "left_semi"))


def inspect(archive: Archive, externals: DataFrame | None = None, **which: str) -> Manifest:
    return manifests(archive, root_of(archive, **which), "inspect", externals)


def checkout(archive: Archive, externals: DataFrame | None = None, **which: str) -> Manifest:
    return manifests(archive, root_of(archive, **which), "checkout", externals)


def validate(manifest: Manifest) -> DataFrame:
    """The manifest's diagnostics, and a row for every missing slot that has none."""
    said = manifest.diagnostics.where("code = 'missing_manifest_object'").select("root", C("related").alias("object_id")).distinct()
    more = manifest.entries.where("availability = 'missing'").join(said, ["root", "object_id"], "left_anti")
    extra = diagnostic(more, "missing_manifest_object", "root", "object_id", "manifest names missing object {object_id}").withColumn("root", C("subject"))
    return manifest.diagnostics.unionByName(extra)


def readiness(archive: Archive, manifest: Manifest, target: str) -> DataFrame:
    """Diagnostics, with their root, that keep manifests from being inspected, replayed, restarted or rerun."""
    if target not in ("inspect", "replay", "restart", "rerun"):
        rows = manifest.visible.where("rank = 0").select("root")
        return diagnostic(rows, "unsupported_target", "root", L(target), f"unknown target {target}").withColumn("root", C("subject"))
    frames = [validate(manifest)]

    def add(rows, code, related, message):
        frames.append(diagnostic(rows, code, "root", related, message).withColumn("root", C("subject")))

    recs = dag.first_revisions(archive).select(C("revision_id").alias("root"), "run_id")
    rows = manifest.visible.where("rank = 0").select("root").join(recs, "root")
    runs = first_by(archive.runs, ["run_id"]).select(C("run_id").alias("_run"), "software_environment", "restart_declared")
    rows = rows.join(runs, C("run_id") == C("_run"), "left")
    if target in ("replay", "rerun"):
        add(manifest.entries.where("availability = 'external_required'"), "external_content_required", "object_id", "revision {root} requires external object {object_id}")
    if target == "replay":
        add(rows.where("_run IS NULL"), "replay_run_missing", L(""), "revision {root} has no producing run to replay")
        add(rows.where("_run IS NOT NULL AND software_environment IS NULL"), "replay_environment_unknown", "_run", "run {_run} did not record a software environment")
    if target == "rerun":
        own = archive.activities.select(C("run_id").alias("_r")).distinct()
        add(rows.where("_run IS NULL"), "rerun_run_missing", L(""), "revision {root} has no producing run to rerun")
        add(rows.where("_run IS NOT NULL").join(own, C("_run") == C("_r"), "left_anti"), "rerun_activity_missing", "_run", "run {_run} has no activity to rerun from")
    if target == "restart":
        points = archive.checkpoints.select(C("run_id").alias("_r"), "object_id", "content_id", "revision_id", "pos")
        declared = rows.where("restart_declared").join(points, C("_run") == C("_r"))
        add(rows.join(declared.select("root").distinct(), "root", "left_anti"), "restart_not_declared", C("_run"), "revision {root} does not declare restart checkpoints")
        held = manifest.entries.where("availability = 'envelope_only'").select("root", C("object_id").alias("_o"), C("revision_id").alias("_v"), C("content_id").alias("_c"))
        good = (
            (declared["root"] == held["root"]) & (C("object_id") == C("_o"))
            & (declared["revision_id"].isNull() | (declared["revision_id"] == C("_v")))
            & (declared["content_id"].isNull() | (declared["content_id"] == C("_c")))
        )
        add(declared.join(held, good, "left_anti"), "missing_restart_checkpoint", "object_id", "restart checkpoint {object_id} is not in this revision manifest")
    return union(frames)


