"""Gates of runs: whether they may be committed or restarted, by themselves and within their archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import diagnostic, first_by, row_rules, union
from ..model import IN_FLIGHT, RESTARTABLE, Archive
from ..staging import release, stage, unstage
from . import rules

C, L = F.col, F.lit


def run_commit(a: Archive) -> DataFrame:
    """A run commits when it is completed, not uncertain, and has no revision yet."""
    return row_rules(a.runs, [
        (C("status") != "completed", "run_not_completed", C("run_id"), C("status"), L("a run that is not completed is not ready to commit")),
        (C("revision_id").isNotNull(), "run_already_committed", C("run_id"), C("revision_id"), L("a run already names a revision")),
        (C("status") == "uncertain", "uncertain_side_effect", C("run_id"), L(""), L("a run has uncertain durable side effects")),
    ])


def run_restart(a: Archive) -> DataFrame:
    """A run restarts when it is not committed, stopped early, and names checkpoints."""
    counts = a.checkpoints.groupBy("run_id").agg(F.count(L(1)).alias("_n"))
    rows = a.runs.join(counts, "run_id", "left")
    return row_rules(rows, [
        (C("revision_id").isNotNull(), "run_already_committed", C("run_id"), C("revision_id"), L("a run already names a revision")),
        (~C("status").isin(*RESTARTABLE), "run_not_restartable", C("run_id"), C("status"), L("a run's status is no restartable one")),
        (~C("restart_declared") | C("_n").isNull(), "restart_not_declared", C("run_id"), L(""), L("a run names no restart checkpoints")),
    ])


def archive_commit(a: Archive) -> DataFrame:
    """Everything that keeps each run from being committed into its archive: its own state and records, what it stages, and
    writes in flight or uncertain, its own or the archive's."""
    first = first_by(a.runs, ["run_id"]).select("run_id")
    blocking = a.writes.where(C("phase").isin(*IN_FLIGHT, "uncertain")).select("scope", "phase", C("run_id").alias("writer"))
    code = F.when(C("phase") == "uncertain", "uncertain_side_effect").otherwise("in_flight_write")
    own = blocking.where("scope = 'run'").join(first, C("writer") == C("run_id"))
    # the archive's own writes block every run alike: one row for each phase that they are in
    phases = [r["phase"] for r in blocking.where("scope = 'archive'").select("phase").distinct().collect()]  # WRITE_PHASES bounds them
    everyone = first.withColumn("scope", L("archive")).withColumn("phase", F.explode(F.array(*map(L, sorted(phases))).cast("array<string>")))
    writes = union([diagnostic(x, code, "run_id", "scope", "a {scope} write is {phase}") for x in (own, everyone)])
    records = rules.run_records(a).where("code <> 'uncommitted_run_has_revision'")
    return union([run_commit(a), records, rules.staging(a), writes])


def _flags(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, open): a row for each key that has any, and whether one of its contents is unknown."""
    return rows.groupBy(*keys).agg(F.bool_or(C("content").isNull()).alias("open"))


def _answered(points: DataFrame, held: DataFrame, on: list[str]) -> DataFrame:
    """`points` with `found` and `unknown`, which also hold if what `held` has by `on` says so."""
    rows = points.join(held.withColumn("_hit", L(True)), on, "left")
    return rows.withColumns({"found": C("found") | C("_hit").isNotNull(), "unknown": C("unknown") | F.coalesce("open", L(False))}).drop("_hit", "open")


def checkpoints(a: Archive) -> DataFrame:
    """Checkpoints that nothing answers, whose content can't be verified, or is another one. A pinned one means that version;
    others all versions and what the run and its parent stage.

    A checkpoint meets neither the versions of its object nor what is staged row by row: whether there are any, whether one has
    no content, and whether one has the wanted content are equi-joins with a row for each key. The table of points is staged
    between them, with only those that are still open, so their shuffle files needn't lie on the disk together.
    """
    spark = a.runs.sparkSession
    runs = first_by(a.runs, ["run_id"]).where("restart_declared").select("run_id", "parent_run_id")
    runs = runs.join(a.runs.select(C("run_id").alias("parent_run_id"), C("run_id").alias("parent")).distinct(), "parent_run_id", "left").select("run_id", "parent")
    no = L(False)

    def put(df, name):
        out = stage(df, f"restart-{name}", compression="zstd")
        release(spark)
        return out

    points = put(a.checkpoints.join(runs, "run_id").select("run_id", "parent", "object_id", C("revision_id").alias("pin"), C("content_id").alias("wanted"), no.alias("found"), no.alias("unknown")), "points")
    held = put(a.objects.select("object_id", "revision_id", "ordinal", C("content_id").alias("content")), "objects")
    # pinned versions
    first = first_by(held, ["object_id", "revision_id"]).select("object_id", C("revision_id").alias("pin"), "content", L(True).alias("_hit"))
    pinned = points.where("pin IS NOT NULL").join(first, ["object_id", "pin"], "left").withColumns({"found": C("_hit").isNotNull(), "unknown": C("_hit").isNotNull() & C("content").isNull(), "same": F.coalesce(C("content") == C("wanted"), no)})
    done = put(pinned.where("NOT found OR (wanted IS NOT NULL AND NOT same)").select("run_id", "object_id", "wanted", "found", "unknown"), "pinned")
    # all versions, of those whose wanted content is none of theirs or that have none
    free = _answered(points.where("pin IS NULL"), _flags(held, "object_id"), ["object_id"]).where("NOT found OR wanted IS NOT NULL").drop("pin")
    stored = held.where("content IS NOT NULL").select("object_id", C("content").alias("wanted")).distinct()
    free = put(free.join(stored, ["object_id", "wanted"], "left_anti").withColumn("id", F.monotonically_increasing_id()), "free")
    unstage(points, held)
    # what is staged by the run and its parent
    own = a.staged.select(C("run_id").alias("stager"), "object_id", C("content_id").alias("content"))
    asked = free.withColumn("stager", F.explode(F.array_compact(F.array("run_id", "parent")))).drop("parent")
    asked = put(_answered(asked, _flags(own, "stager", "object_id"), ["stager", "object_id"]), "asked")
    unstage(free)
    same = own.where("content IS NOT NULL").select("stager", "object_id", C("content").alias("wanted")).distinct().withColumn("_same", L(True))
    left = asked.join(same, ["stager", "object_id", "wanted"], "left").groupBy("id", "run_id", "object_id", "wanted").agg(F.bool_or("found").alias("found"), F.bool_or("unknown").alias("unknown"), F.bool_or(C("_same").isNotNull()).alias("same"))
    left = put(left.where("NOT found OR (wanted IS NOT NULL AND NOT same)").select("run_id", "object_id", "wanted", "found", "unknown"), "left")
    unstage(asked)
    code = F.when(~C("found"), "missing_restart_checkpoint").when(C("unknown"), "unverified_restart_content").otherwise("incompatible_restart_content")
    return diagnostic(done.unionByName(left), code, "run_id", "object_id", "restart checkpoint {object_id} cannot be used")


def archive_restart(a: Archive) -> DataFrame:
    """Everything that keeps each run from being restarted within its archive."""
    wanted = a.runs.where("restart_declared AND restart_context IS NOT NULL")
    code = F.when(C("execution_context").isNull(), "missing_restart_execution_context").when(C("execution_context") != C("restart_context"), "incompatible_restart_execution_context")
    context = diagnostic(wanted.withColumn("code", code).where("code IS NOT NULL"), C("code"), "run_id", "restart_context", "run {run_id} restart needs execution context {restart_context}")
    return union([run_restart(a), checkpoints(a), context])


def gate(a: Archive, target: str, run_ids: DataFrame | None = None, of: str = "archive") -> DataFrame:
    """Diagnostics of a target; runs in `run_ids` that the archive doesn't know get a row of their own, and so does a target
    that there is no gate for."""
    gates = {("run", "commit"): run_commit, ("run", "restart"): run_restart, ("archive", "commit"): archive_commit, ("archive", "restart"): archive_restart}
    if (of, target) not in gates:
        return diagnostic(a.runs.sparkSession.range(1), "unsupported_target", L(target), L(of), f"unknown target {target}")
    rows = gates[of, target](a)
    if run_ids is None:
        return rows
    lost = run_ids.join(a.runs.select("run_id").distinct(), "run_id", "left_anti")
    unknown = diagnostic(lost, f"missing_{target}_run", "run_id", None, "the run is not known")
    return rows.join(run_ids.withColumnRenamed("run_id", "subject"), "subject", "left_semi").unionByName(unknown)


def ready(a: Archive, diagnostics: DataFrame) -> DataFrame:
    """(run_id, ready) of every run."""
    bad = diagnostics.where("severity = 'error'").select(C("subject").alias("run_id")).distinct().withColumn("_bad", L(True))
    return a.runs.select("run_id").distinct().join(bad, "run_id", "left").select("run_id", C("_bad").isNull().alias("ready"))


def sound(diagnostics: DataFrame, target: str = "inspect", what: str = "archive") -> DataFrame:
    """The gate of registries and purge results: they can be inspected when nothing is wrong with them."""
    if target != "inspect":
        return diagnostic(diagnostics.sparkSession.range(1), "unsupported_target", L(target), L(what), f"unknown target {target}")
    return diagnostics.where("severity = 'error'")


def purge_result(diagnostics: DataFrame, verified: bool, target: str = "inspect") -> DataFrame:
    """A purge result can be inspected when its archive was published."""
    rows = sound(diagnostics, target, "purge_result")
    if verified or target != "inspect":
        return rows
    return rows.unionByName(diagnostic(diagnostics.sparkSession.range(1), "purge_unverified", L("purge_result"), None, "the compacted archive is not verified"))
