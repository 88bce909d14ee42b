"""Single records: their checks, reports and text, by one entry point for every kind.

`validate(archive, kind)` holds the rules that a record answers to by itself, for all records of the kind at once;
`validate(archive, kind, run_id=...)` for those with that key. What a record is to others is the archive's business (`rules`).
`report` gives one row a record with its sizes and flags, and `render` any diagnostics as lines of text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import diagnostic, is_secret_name, is_secret_value, schema_kind, union
from ..model import Archive
from . import catalog, namespaces, purge, readiness, rules

C, L = F.col, F.lit


class Checks(Protocol):
    """What a kind of record brings along: the rows that `validate` returns of an archive."""

    def __call__(self, a: Archive) -> DataFrame: ...


@dataclass(frozen=True)
class Kind:
    """`table` holds the records, `keys` name one, and `parts` are the tables that belong to them, with the columns that say to
    which (the record's own, the part's)."""

    table: str
    keys: tuple[str, ...]
    check: Checks
    report: Callable[[Archive], DataFrame]
    parts: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = ()


def _events(a: Archive) -> DataFrame:
    said = a.event_payload.join(a.events.select(C("ordinal").alias("event"), "run_id"), "event")
    bad = is_secret_name(C("key")) | (C("is_text") & is_secret_value(C("value")))
    return diagnostic(a.events.where(is_secret_value(C("message"))), "credential_like_content", "run_id", L("message"), "credential-like content is not allowed").unionByName(
        diagnostic(said.where(bad), "credential_like_content", "run_id", "key", "credential-like content is not allowed")
    )


def _log_streams(a: Archive) -> DataFrame:
    return diagnostic(a.log_streams.where(C("summary").isNotNull() & is_secret_value(C("summary"))), "credential_like_content", "run_id", L("summary"), "credential-like content is not allowed")


def _runs(a: Archive) -> DataFrame:
    return rules.run_records(a).where("code <> 'uncommitted_run_has_revision'")


def _sized(a: Archive, rows: DataFrame, key: str, tables: tuple[str, ...]) -> DataFrame:
    for name in tables:
        rows = rows.join(getattr(a, name).groupBy(key).agg(F.count(L(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, L(0)))
    return rows


def object_report(a: Archive) -> DataFrame:
    return a.objects.select("object_id", "revision_id", "content_id", C("ns_id").alias("namespace"), schema_kind().alias("schema"), "schema_version", F.format_string("object %s of kind %s in revision %s", "object_id", "kind", "revision_id").alias("summary"))


def run_report(a: Archive) -> DataFrame:
    rows = _sized(a, a.runs, "run_id", ("activities", "staged", "checkpoints"))
    return rows.select("run_id", "status", "revision_id", "activities", "staged", "checkpoints", C("revision_id").isNotNull().alias("committed"))


def event_report(a: Archive) -> DataFrame:
    return a.events.select("ordinal", "run_id", "kind", "sequence", "severity", F.format_string("event %s of run %s", "kind", "run_id").alias("summary"))


def log_stream_report(a: Archive) -> DataFrame:
    return a.log_streams.select("ordinal", "run_id", "kind", "retention", F.format_string("%s of run %s", "kind", "run_id").alias("summary"))


def staged_report(a: Archive) -> DataFrame:
    return a.staged.select("run_id", "object_id", "origin", "ordinal", F.format_string("%s object %s of run %s", "origin", "object_id", "run_id").alias("summary"))


def write_report(a: Archive) -> DataFrame:
    return a.writes.select("scope", "phase", "sequence", "ordinal", F.format_string("%s write is %s", "scope", "phase").alias("summary"))


def plan_report(a: Archive) -> DataFrame:
    return a.plan_operations.groupBy("plan_id").agg(F.count(L(1)).alias("operations"), F.count_if(C("kind") == "").alias("unnamed"))


def claim_report(a: Archive) -> DataFrame:
    aliases = a.claim_aliases.groupBy(C("claim").alias("ordinal")).agg(F.array_join(F.array_sort(F.collect_list("alias")), ",").alias("aliases"))
    rows = a.claims.join(aliases, "ordinal", "left")
    return rows.select("ordinal", C("ns_id").alias("namespace"), "ns_uuid", "role", "status", "canonical_id", F.coalesce("aliases", L("")).alias("aliases"), F.format_string("namespace %s is claimed as %s, %s", "ns_id", "role", "status").alias("summary"))


KINDS: dict[str, Kind] = {
    "object": Kind("objects", ("object_id", "revision_id"), lambda a: rules.object_rows(a).unionByName(rules.duplicate_reference_names(a)), object_report, (("refs", ("ordinal",), ("owner",)),)),
    "event": Kind("events", ("ordinal",), _events, event_report, (("event_payload", ("ordinal",), ("event",)),)),
    "log_stream": Kind("log_streams", ("run_id", "kind"), _log_streams, log_stream_report),
    "plan": Kind("plan_operations", ("plan_id",), rules.plans, plan_report),
    "staged": Kind("staged", ("run_id", "object_id"), rules.staged_rows, staged_report),
    "run": Kind("runs", ("run_id",), _runs, run_report, (("staged", ("run_id",), ("run_id",)), ("activities", ("run_id",), ("run_id",)), ("checkpoints", ("run_id",), ("run_id",)), ("revisions", ("run_id",), ("run_id",)))),
    "write": Kind("writes", ("scope", "run_id"), rules.write_rows, write_report),
    "claim": Kind("claims", ("ns_id",), namespaces.claim_rules, claim_report, (("claim_aliases", ("ordinal",), ("claim",)),)),
}


def register(name: str, kind: Kind) -> None:
    """Adds a kind of record to the entry points."""
    KINDS[name] = kind


def only(a: Archive, kind: str, **key) -> Archive:
    """The archive with only the records of that key and what belongs to them; no such record raises."""
    k = KINDS[kind]
    unknown = set(key) - set(k.keys)
    if unknown:
        raise ValueError(f"a {kind} is named by {k.keys}, not by {sorted(unknown)}")
    rows = getattr(a, k.table)
    for name, value in key.items():
        rows = rows.where(C(name).eqNullSafe(L(value)))
    if rows.isEmpty():
        raise LookupError(f"there is no such {kind}")
    frames = {k.table: rows}
    for table, own, theirs in k.parts:
        part = getattr(a, table)
        frames[table] = part.join(rows.select(*[C(o).alias(f"_{o}") for o in own]).distinct(), [part[t].eqNullSafe(C(f"_{o}")) for o, t in zip(own, theirs)], "left_semi")
    return a.replaced(**frames)


def validate(a: Archive, kind: str, catalog_too: bool = False, **key) -> DataFrame:
    """Diagnostics of the kind's records, all or those of the key; of objects also against the archive's catalog if asked for."""
    one = only(a, kind, **key) if key else a
    found = KINDS[kind].check(one)
    if catalog_too:
        if kind != "object":
            raise ValueError("only objects have a schema in the catalog")
        found = union([found, catalog.object_statuses(one), catalog.provenance(one)])
    return found


def report(a: Archive, kind: str, **key) -> DataFrame:
    """One row a record."""
    return KINDS[kind].report(only(a, kind, **key) if key else a)


def validate_definitions(a: Archive, definitions: DataFrame, fields: DataFrame) -> DataFrame:
    """The rules that a schema definition answers to by itself."""
    return catalog.definition_rules(a, definitions, fields)


def definition_report(definitions: DataFrame, fields: DataFrame) -> DataFrame:
    listed = catalog.listing(definitions, fields)
    key = F.concat_ws("/", *catalog.KEY)
    return listed.select(key.alias("schema"), "compatibility", "fields", "n_fields", F.format_string("schema %s is %s", key, "compatibility").alias("summary"))


def registry_report(rows: DataFrame, name: str) -> DataFrame:
    """(entries, names) of a registry of claims or definitions: their number, and how many different names they have."""
    return rows.agg(F.count(L(1)).alias("entries"), F.count_distinct(name).alias("names"))


def document_report(fragments: DataFrame) -> DataFrame:
    """(document_id, schema, fragments) of portable documents, from a row (document_id, schema, ...) a fragment."""
    return fragments.groupBy("document_id").agg(F.first("schema").alias("schema"), F.count(L(1)).alias("fragments"))


def validate_plan(plan: purge.Plan) -> DataFrame:
    """What is wrong with what a purge plan reaches."""
    return plan.reach.diagnostics


def validate_result(diagnostics: DataFrame, verified: bool) -> DataFrame:
    """What is wrong with a published archive: what its verification found, or that there was none."""
    return readiness.purge_result(diagnostics, verified)


def plan_summary(plan: purge.Plan) -> DataFrame:
    """One row with all counts of a purge plan."""
    names = [r["what"] for r in plan.summary.select("what").distinct().orderBy("what").collect()]  # a dozen counts
    return plan.summary.groupBy().pivot("what", names).agg(F.sum("n"))


def render(diagnostics: DataFrame) -> DataFrame:
    """(line): diagnostics as text, the subject and what it is related to in brackets."""
    related = F.when(C("related") != "", F.concat(L(", "), C("related"))).otherwise(L(""))
    return diagnostics.select(F.concat(C("severity"), L(" "), C("code"), L(" ["), F.coalesce("subject", L("")), related, L("]")).alias("line"))
