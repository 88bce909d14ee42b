"""Integrity checks of an archive. Every check returns diagnostics rows and raises nothing.

Checks on single rows of one table share one scan; uniqueness checks are windows, references are anti-joins, and chains of
alternatives are one CASE, so that a row gets at most one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import after_first, diagnostic, first_by, is_secret_name, is_secret_value, owns_kind, row_rules, schema_kind, union
from ..model import IN_FLIGHT, INCOMPLETE, Archive
from . import dag
from .lookup import ORDERS

C, L = F.col, F.lit


def _envelope(config, id_column: str, reserved: bool):
    kind, ns = C("kind"), C("ns_id")
    rules = [
        (~owns_kind(ns, kind), "kind_namespace_mismatch", C(id_column), kind, F.concat(L("kind "), kind, L(" is not owned by namespace "), ns)),
        (C("schema_ns") != ns, "schema_namespace_mismatch", C(id_column), C("schema_ns"), F.concat(L("schema namespace "), C("schema_ns"), L(" does not match object namespace "), ns)),
        (schema_kind() != kind, "schema_kind_mismatch", C(id_column), schema_kind(), F.concat(L("schema "), schema_kind(), L(" does not match kind "), kind)),
    ]
    if reserved:
        shared = ns == config.shared
        rules += [
            (ns.isin(*config.areas), "reserved_archive_area_claimed", C(id_column), ns, F.concat(L("namespace "), ns, L(" is a reserved archive area"))),
            (shared & (C("ns_uuid") != "") & (C("ns_uuid") != config.shared_uuid), "reserved_namespace_claimed", C(id_column), C("ns_uuid"), F.concat(L("namespace "), ns, L(" is reserved"))),
            (~shared & owns_kind(L(config.shared), kind), "reserved_kind_claimed", C(id_column), kind, F.concat(L("kind "), kind, L(" is reserved"))),
        ]
    return rules


def object_rows(a: Archive) -> DataFrame:
    """Kind, schema and reserved-name rules of single objects."""
    return row_rules(a.objects, _envelope(a.config, "object_id", True))


def duplicate_reference_names(a: Archive) -> DataFrame:
    return diagnostic(after_first(a.refs, ["owner", "name"], ["pos"]), "duplicate_reference_name", "object_id", "name", "reference name {name} is used twice in one object")


def duplicate_object_revisions(a: Archive) -> DataFrame:
    return diagnostic(after_first(a.objects, ["object_id", "revision_id"], ORDERS["objects"]), "duplicate_object_revision", "object_id", "revision_id", "object {object_id} has several rows for revision {revision_id}")


def object_id_conflicts(a: Archive) -> DataFrame:
    """Objects whose namespace, or else kind, differs from their id's first one in canonical order."""
    from pyspark.sql import Window

    w = Window.partitionBy("object_id").orderBy(*ORDERS["objects"])
    rows = a.objects.select("object_id", "ns_id", "kind", F.first("ns_id").over(w).alias("ns0"), F.first("kind").over(w).alias("kind0"))
    code = F.when(C("ns_id") != C("ns0"), "object_id_namespace_conflict").when(C("kind") != C("kind0"), "object_id_kind_conflict")
    rows = rows.withColumn("code", code).where("code IS NOT NULL")
    return diagnostic(rows, C("code"), "object_id", F.when(C("code") == "object_id_namespace_conflict", C("ns_id")).otherwise(C("kind")), "object id {object_id} is used in two ways")


def resolves(refs: DataFrame, objects: DataFrame, how: str, object_col: str = "target_object", revision_col: str = "target_revision") -> DataFrame:
    """References that exist somewhere in the archive (how: left_semi), or that don't (left_anti): pinned ones by object and
    revision, others by object."""
    versions = objects.select(C("object_id").alias("_o"), C("revision_id").alias("_r")).distinct()
    pinned = refs.where(C(revision_col).isNotNull()).join(versions, (C(object_col) == C("_o")) & (C(revision_col) == C("_r")), how)
    free = refs.where(C(revision_col).isNull()).join(versions.select("_o").distinct(), C(object_col) == C("_o"), how)
    return pinned.unionByName(free)


def dangling_references(a: Archive) -> DataFrame:
    rows = resolves(a.refs, a.objects, "left_anti")
    return diagnostic(rows, "dangling_reference", "object_id", "target_object", "nothing answers reference {name}", name=C("name"), target_object_id=C("target_object"), target_revision_id=C("target_revision"))


def heads(a: Archive) -> DataFrame:
    """Repeated ids and names, and heads on unknown revisions (of the objects, where no revision has a record)."""
    right = a.revisions if a.has_revisions else a.objects
    dangling = a.heads.join(right.select("revision_id").distinct(), "revision_id", "left_anti")
    return union([
        diagnostic(after_first(a.heads, ["head_id"], ORDERS["heads"]), "duplicate_workflow_head", "head_id", None, "head id {head_id} is taken twice"),
        diagnostic(after_first(a.heads, ["name"], ORDERS["heads"]), "duplicate_workflow_head_name", "head_id", "name", "head name {name} is taken twice"),
        diagnostic(dangling, "dangling_workflow_head", "head_id", "revision_id", "head {name} stands on {revision_id}, which is not recorded"),
    ])


def records(a: Archive) -> DataFrame:
    """Repeated revisions, runs, activities; objects of unrecorded revisions; activities of another run."""
    checks = [
        diagnostic(after_first(a.revisions, ["revision_id"], ["ordinal"]), "duplicate_revision", "revision_id", None, "revision {revision_id} is recorded twice"),
        diagnostic(after_first(a.runs, ["run_id"], ["ordinal"]), "duplicate_run", "run_id", None, "run {run_id} is recorded twice"),
        diagnostic(after_first(a.activities, ["activity_id"], ["ordinal"]), "duplicate_activity", "activity_id", None, "activity {activity_id} is recorded twice"),
        diagnostic(a.activities.where("declared_run_id <> run_id"), "activity_run_mismatch", "activity_id", "declared_run_id", "activity {activity_id} belongs to run {declared_run_id}, not {run_id}"),
    ]
    if a.has_revisions:
        lost = a.objects.join(a.revisions.select("revision_id").distinct(), "revision_id", "left_anti")
        checks.append(diagnostic(lost, "missing_revision_record", "object_id", "revision_id", "object {object_id} names unknown revision {revision_id}"))
    return union(checks)


def run_parents(a: Archive) -> DataFrame:
    known = a.runs.select(C("run_id").alias("_k")).distinct()
    rows = a.runs.where("parent_run_id IS NOT NULL").join(known, C("parent_run_id") == C("_k"), "left")
    code = F.when(C("parent_run_id") == C("run_id"), "self_parent_run").when(C("_k").isNull(), "missing_parent_run")
    return diagnostic(rows.withColumn("code", code).where("code IS NOT NULL"), C("code"), "run_id", "parent_run_id", "run {run_id} has a wrong parent run {parent_run_id}")


def _plans_differ(x, y):
    return x.isNotNull() & y.isNotNull() & (x != y)


def run_revisions(a: Archive) -> DataFrame:
    """What a run's revision says of the run, and what a revision's run says of the revision."""
    recs = dag.first_revisions(a).select(C("revision_id").alias("_rev"), C("run_id").alias("_run"), C("plan_id").alias("_plan"))
    rows = a.runs.where("revision_id IS NOT NULL").join(recs, C("revision_id") == C("_rev"), "left")
    gate = L(a.has_revisions)
    forward = F.when(C("_rev").isNull(), F.when(gate, L("missing_run_revision"))).when(C("_run").isNotNull() & (C("_run") != C("run_id")), "run_revision_mismatch").when(_plans_differ(C("plan_id"), C("_plan")), "run_revision_plan_mismatch")
    one = diagnostic(rows.withColumn("code", forward).where("code IS NOT NULL"), C("code"), "run_id", "revision_id", "run {run_id} and revision {revision_id} disagree")
    runs = first_by(a.runs, ["run_id"]).select(C("run_id").alias("_run"), C("revision_id").alias("_rev"), C("plan_id").alias("_plan"))
    rows = a.revisions.where("run_id IS NOT NULL").join(runs, C("run_id") == C("_run"), "left")
    back = F.when(C("_run").isNull(), "missing_revision_run").when(C("_rev").isNotNull() & (C("_rev") != C("revision_id")), "run_revision_mismatch").when(_plans_differ(C("plan_id"), C("_plan")), "run_revision_plan_mismatch")
    two = diagnostic(rows.withColumn("code", back).where("code IS NOT NULL"), C("code"), "revision_id", "run_id", "revision {revision_id} and run {run_id} disagree")
    return one.unionByName(two)


def secrets(a: Archive) -> DataFrame:
    """Events and log summaries that carry what looks like credentials."""
    rows = a.event_payload.join(a.events.select(C("ordinal").alias("event"), "run_id", C("kind").alias("event_kind")), "event")
    named = rows.where(is_secret_name(C("key")))
    valued = rows.where(C("is_text") & is_secret_value(C("value")))
    said = "credential-like content is not allowed"
    return union([
        diagnostic(a.events.where(is_secret_value(C("message"))), "credential_like_content", "run_id", L("message"), said),
        diagnostic(named, "credential_like_content", "run_id", "key", "payload key {key} looks like a secret name"),
        diagnostic(valued, "credential_like_content", "run_id", "key", said),
        diagnostic(a.log_streams.where(C("summary").isNotNull() & is_secret_value(C("summary"))), "credential_like_content", "run_id", L("summary"), said),
    ])


def _activities(a: Archive) -> DataFrame:
    """Activities by the run that holds them; only a run id's first record counts."""
    return a.activities.select(C("run_id").alias("_r"), C("activity_id").alias("_a")).distinct()


def event_references(a: Archive) -> DataFrame:
    runs = a.runs.select(C("run_id").alias("_run")).distinct()
    own = _activities(a)
    rows = a.events.join(runs, C("run_id") == C("_run"), "left").join(own, (C("run_id") == C("_r")) & (C("activity_id") == C("_a")), "left")
    code = F.when(C("_run").isNull(), "missing_event_run").when(C("activity_id").isNotNull() & C("_a").isNull(), "missing_event_activity")
    checks = [diagnostic(rows.withColumn("code", code).where("code IS NOT NULL"), C("code"), "run_id", F.when(C("code") == "missing_event_activity", C("activity_id")), "event {kind} names an unknown run or activity")]
    if a.has_revisions:
        lost = a.events.where("revision_id IS NOT NULL").join(a.revisions.select("revision_id").distinct(), "revision_id", "left_anti")
        checks.append(diagnostic(lost, "missing_event_revision", "run_id", "revision_id", "event {kind} names unknown revision {revision_id}"))
    refs = resolves(a.event_refs, a.objects, "left_anti", "object_id", "revision_id").join(a.events.select(C("ordinal").alias("event"), "run_id", "kind"), "event")
    checks.append(diagnostic(refs, "dangling_event_object", "run_id", "object_id", "event {kind} names unknown object {object_id}"))
    return union(checks)


def duplicate_sequences(a: Archive) -> DataFrame:
    """Events that repeat a sequence number of their run and source."""
    rows = after_first(a.events.where("sequence IS NOT NULL"), ["run_id", F.coalesce(C("source"), L("")), "sequence"], ["ordinal"])
    return diagnostic(rows, "duplicate_event_sequence", "run_id", F.concat_ws("/", F.coalesce(C("source"), L("")), C("sequence")), "sequence {sequence} is taken twice in run {run_id}")


def log_streams(a: Archive) -> DataFrame:
    runs = a.runs.select(C("run_id").alias("_run")).distinct()
    rows = a.log_streams.join(runs, C("run_id") == C("_run"), "left").join(_activities(a), (C("run_id") == C("_r")) & (C("activity_id") == C("_a")), "left")
    code = F.when(C("_run").isNull(), "missing_log_stream_run").when(C("activity_id").isNotNull() & C("_a").isNull(), "missing_log_stream_activity")
    return diagnostic(rows.withColumn("code", code).where("code IS NOT NULL"), C("code"), "run_id", F.when(C("code") == "missing_log_stream_activity", C("activity_id")), "log stream {kind} names an unknown run or activity")


def staged_rows(a: Archive) -> DataFrame:
    """Kind and schema rules of single staged objects, and reused ones without a source."""
    reused = (C("origin") == "reused") & C("source_revision_id").isNull()
    return row_rules(a.staged, [*_envelope(a.config, "object_id", False), (reused, "reused_without_source", C("object_id"), C("run_id"), L("reused staged object has no source revision"))])


def run_records(a: Archive) -> DataFrame:
    """Lifecycle rules of runs by themselves and of what they stage."""
    code = F.when(C("status") == "uncertain", "uncertain_run_has_revision").otherwise("incomplete_run_has_revision")
    early = a.runs.where(C("revision_id").isNotNull() & C("status").isin(*INCOMPLETE))
    own = _activities(a)
    lost = a.staged.where("activity_id IS NOT NULL").join(own, (C("run_id") == C("_r")) & (C("activity_id") == C("_a")), "left_anti")
    restart = a.runs.where("restart_declared AND restart_activity IS NOT NULL").join(own, (C("run_id") == C("_r")) & (C("restart_activity") == C("_a")), "left_anti")
    back = a.revisions.select("revision_id", C("run_id").alias("_run")).join(a.runs.where("revision_id IS NULL").select("run_id"), C("_run") == C("run_id"))
    return union([
        diagnostic(early, code, "run_id", "revision_id", "run {run_id} is {status} and still names a revision"),
        staged_rows(a),
        diagnostic(after_first(a.staged, ["run_id", "object_id"], ["ordinal"]), "duplicate_staged_object", "run_id", "object_id", "object {object_id} is staged twice by run {run_id}"),
        diagnostic(lost, "missing_staged_activity", "run_id", "activity_id", "activity {activity_id} of staged object {object_id} is not the run's"),
        diagnostic(restart, "missing_restart_activity", "run_id", "restart_activity", "the restart of run {run_id} starts from {restart_activity}, which is not its activity"),
        diagnostic(back, "uncommitted_run_has_revision", "run_id", "revision_id", "revision {revision_id} names uncommitted run {run_id}"),
    ])


def staging(a: Archive) -> DataFrame:
    """Reused objects against their source, and committed runs' staged objects against what was promoted."""
    versions = first_by(a.objects, ["object_id", "revision_id"]).select(C("object_id").alias("_o"), C("revision_id").alias("_v"), C("content_id").alias("_c"), L(True).alias("_found"))
    reused = a.staged.where("origin = 'reused' AND source_revision_id IS NOT NULL").join(versions, (C("object_id") == C("_o")) & (C("source_revision_id") == C("_v")), "left")
    code = F.when(C("_found").isNull(), "reused_source_missing").when(C("_c").isNotNull() & C("content_id").isNull(), "reused_content_missing").when(C("content_id").isNotNull() & C("_c").isNotNull() & (C("content_id") != C("_c")), "reused_content_mismatch")
    one = diagnostic(reused.withColumn("code", code).where("code IS NOT NULL"), C("code"), "run_id", "object_id", "reused object {object_id} does not match its source")
    runs = a.runs.where("revision_id IS NOT NULL").select("run_id", C("revision_id").alias("_commit"))
    done = a.staged.join(runs, "run_id").join(versions, (C("object_id") == C("_o")) & (C("_commit") == C("_v")), "left")
    code = F.when(C("_found").isNull(), "staged_not_promoted").when(C("content_id").isNotNull() & C("_c").isNotNull() & (C("content_id") != C("_c")), "committed_content_mismatch")
    two = diagnostic(done.withColumn("code", code).where("code IS NOT NULL"), C("code"), "run_id", "object_id", "staged object {object_id} does not match revision {_commit}")
    return one.unionByName(two)


def write_rows(a: Archive) -> DataFrame:
    """Writes in flight that nobody holds."""
    open_ = C("phase").isin(*IN_FLIGHT) & C("writer_token").isNull()
    return row_rules(a.writes, [(open_, "missing_writer_token", C("sequence"), C("phase"), F.concat(C("scope"), L(" write is in flight without a writer token")))])


def writes(a: Archive) -> DataFrame:
    flight = C("phase").isin(*IN_FLIGHT)
    repeated = after_first(a.writes, ["scope", F.coalesce(C("run_id"), L(""))], ["ordinal"])
    lost = a.writes.where("run_id IS NOT NULL").join(a.runs.select("run_id").distinct(), "run_id", "left_anti")
    many = a.writes.where(flight & (C("scope") == "archive")).agg(F.count(L(1)).alias("n")).where("n > 1")
    runs = first_by(a.runs, ["run_id"]).select("run_id", C("revision_id").alias("_rev"), C("status").alias("_status"))
    against = row_rules(a.writes.join(runs, "run_id"), [
        (flight & C("_rev").isNotNull(), "in_flight_write_has_revision", C("run_id"), C("_rev"), L("a run with an in-flight write must not name a revision")),
        ((C("phase") == "committed") & C("_rev").isNull(), "committed_write_missing_revision", C("run_id"), C("sequence"), L("a committed write's run names no revision")),
        ((C("phase") == "uncertain") & C("_rev").isNotNull(), "uncertain_write_has_revision", C("run_id"), C("_rev"), L("an uncertain write's run must not name a revision")),
        ((C("phase") == "uncertain") & (C("_status") != "uncertain"), "uncertain_write_status_mismatch", C("run_id"), C("_status"), L("an uncertain write's run has another status")),
    ])
    return union([
        write_rows(a),
        diagnostic(repeated, "duplicate_write", "scope", "run_id", "{scope} write for {run_id} is recorded more than once"),
        diagnostic(lost, "missing_write_run", "scope", "run_id", "{scope} write sequence {sequence} names unknown run {run_id}"),
        diagnostic(many, "multiple_archive_writers", C("n").cast("string"), None, "one in-flight archive writer is allowed; found {n}"),
        against,
    ])


def plans(a: Archive) -> DataFrame:
    return diagnostic(a.plan_operations.where("kind = ''"), "empty_operation_kind", "plan_id", "pos", "operation {pos} of the plan names no kind")


def event_batch(events: DataFrame, payload: DataFrame | None = None, write: dict | None = None) -> DataFrame:
    """One atomic append: its events name one run, repeat no sequence and carry no credentials; its write is that run's."""
    first = events.orderBy("ordinal").limit(1).select(C("run_id").alias("_first"))
    mixed = events.crossJoin(F.broadcast(first)).where("run_id <> _first")  # one row
    repeated = after_first(events.where("sequence IS NOT NULL"), ["run_id", F.coalesce(C("source"), L("")), "sequence"], ["ordinal"])
    checks = [
        diagnostic(mixed, "event_batch_run_mismatch", "_first", "run_id", "a batch of run {_first} holds an event of {run_id}"),
        diagnostic(repeated, "duplicate_event_sequence", "run_id", F.concat_ws("/", F.coalesce(C("source"), L("")), C("sequence")), "sequence {sequence} is taken twice in run {run_id}"),
        diagnostic(events.where(is_secret_value(C("message"))), "credential_like_content", "run_id", L("message"), "credential-like content is not allowed"),
    ]
    if payload is not None:
        checks.append(diagnostic(payload.where(is_secret_name(C("key")) | (C("is_text") & is_secret_value(C("value")))), "credential_like_content", "event", "key", "credential-like content is not allowed"))
    if write is not None:
        if write["phase"] in IN_FLIGHT and not write.get("writer_token"):
            checks.append(diagnostic(first, "missing_writer_token", L(str(write.get("sequence", ""))), L(write["phase"]), "write is in flight without a writer token"))
        if write["scope"] != "run":
            checks.append(diagnostic(first, "event_batch_write_scope", "_first", L(write["scope"]), "the write of a batch has another scope than its run"))
        elif write.get("run_id") is not None:
            checks.append(diagnostic(first.where(C("_first") != write["run_id"]), "event_batch_write_run_mismatch", "_first", L(write["run_id"]), "the write of a batch is for another run"))
    return union(checks)


def event_batches(events: DataFrame, payload: DataFrame | None = None, writes: DataFrame | None = None) -> DataFrame:
    """The rules of atomic appends for many batches at once: `events` also has a `batch`. Each is its first event's run's.

    `payload` (event, key, value, is_text) belongs to the events by their ordinal; `writes` (batch, scope, phase, sequence, run_id,
    writer_token) are the batches' write transactions.
    """
    first = events.groupBy("batch").agg(F.min_by("run_id", "ordinal").alias("_first"))
    mixed = events.join(first, "batch").where("run_id <> _first")
    repeated = after_first(events.where("sequence IS NOT NULL"), ["batch", "run_id", F.coalesce(C("source"), L("")), "sequence"], ["ordinal"])
    checks = [
        diagnostic(mixed, "event_batch_run_mismatch", "batch", "run_id", "a batch of run {_first} holds an event of {run_id}"),
        diagnostic(repeated, "duplicate_event_sequence", "batch", F.concat_ws("/", "run_id", F.coalesce(C("source"), L("")), "sequence"), "sequence {sequence} is taken twice in run {run_id}"),
        diagnostic(events.where(is_secret_value(C("message"))), "credential_like_content", "batch", L("message"), "credential-like content is not allowed"),
    ]
    if payload is not None:
        said = payload.where(is_secret_name(C("key")) | (C("is_text") & is_secret_value(C("value"))))
        said = said.join(events.select("batch", C("ordinal").alias("event")), "event")
        checks.append(diagnostic(said, "credential_like_content", "batch", "key", "credential-like content is not allowed"))
    if writes is not None:
        rows = writes.join(first, "batch")
        code = F.when(C("scope") != "run", "event_batch_write_scope").when(C("run_id") != C("_first"), "event_batch_write_run_mismatch")
        checks += [
            row_rules(rows, [(C("phase").isin(*IN_FLIGHT) & C("writer_token").isNull(), "missing_writer_token", C("batch"), C("phase"), L("the write of a batch is in flight without a writer token"))]),
            diagnostic(rows.withColumn("code", code).where("code IS NOT NULL"), C("code"), "batch", F.when(C("scope") != "run", C("scope")).otherwise(C("run_id")), "the write of a batch is not its run's"),
        ]
    return union(checks)


HISTORY = (records, run_parents, run_revisions, event_references, secrets, duplicate_sequences, log_streams, run_records, staging, writes)
OBJECTS = (object_rows, duplicate_reference_names, duplicate_object_revisions, object_id_conflicts, dangling_references, heads)


def validate(a: Archive, *, namespaces: bool = False, catalog: bool = False, definitions: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """All checks of an archive, as one frame; with its namespace claims, with its catalog, and with embedded schema definitions
    (definitions, fields) if given: their own rules, and what they say of the objects' schemas."""
    from . import catalog as schemas
    from . import namespaces as claims

    frames = [check(a) for check in OBJECTS + HISTORY] + [dag.dangling_parents(a), dag.cycle_check(a), claims.object_identities(a, namespaces)]
    if namespaces:
        frames += [claims.registry(a)]
    if catalog:
        frames += [schemas.object_statuses(a), schemas.provenance(a)]
    if definitions is not None:
        frames += [schemas.registry(a, *definitions, with_claims=namespaces), schemas.status_diagnostics(a.objects, definitions[0])]
    return union(frames)


def is_valid(diagnostics: DataFrame) -> bool:
    return diagnostics.where("severity = 'error'").isEmpty()
