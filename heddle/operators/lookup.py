"""Lookups, ordered scans and small rewrites of an archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import LAST, first_by
from ..model import Archive, columns

_ORDERS = {
    "objects": "ns_id object_id revision_id ordinal",
    "heads": "head_id name ordinal",
    "revisions": "revision_id ordinal",
    "runs": "run_id ordinal",
    "writes": "scope coalesce(run_id,'') sequence ordinal",
    "log_streams": "run_id kind coalesce(source,'') ordinal",
    "claims": "ns_id ns_uuid status ordinal",
    "refs": "name target_object coalesce(target_revision,'') pos",
    "events": f"run_id coalesce(source,'') coalesce(sequence,{LAST}) ordinal",
}


class _Orders:
    """Sort keys of each table, as Columns made when they are asked for."""

    def __getitem__(self, table: str) -> list[Column]:
        return [F.expr(k) for k in _ORDERS[table].split(" ")]


ORDERS = _Orders()


class Ambiguous(ValueError):
    """A name that more than one row answers to."""


def ordered(archive: Archive, table: str) -> DataFrame:
    """A table in its canonical order. Events keep insertion order here; see `timeline`."""
    return getattr(archive, table).orderBy(*(["ordinal"] if table == "events" else ORDERS[table]))


def find(archive: Archive, table: str, keys: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """First row, in insertion order, of every key (of those in `wanted`); nulls match nulls."""
    rows = getattr(archive, table)
    if wanted is not None:
        cond = [rows[k].eqNullSafe(wanted[k]) for k in keys]
        rows = rows.join(wanted, cond, "left_semi")
    return first_by(rows, keys)


def find_objects(archive: Archive, revision: str) -> DataFrame:
    """All objects of a revision, in order."""
    return archive.objects.where(F.col("revision_id") == revision).orderBy(*ORDERS["objects"])


def find_revisions(archive: Archive, object_id: str) -> DataFrame:
    """All versions of an object, in order."""
    return archive.objects.where(F.col("object_id") == object_id).orderBy(*ORDERS["objects"])


def find_head(archive: Archive, *, head_id: str | None = None, name: str | None = None) -> DataFrame:
    """A head by id (the first one) or by name (an ambiguous name raises)."""
    if head_id is not None:
        return first_by(archive.heads.where(F.col("head_id") == head_id), ["head_id"])
    found = archive.heads.where(F.col("name") == name)
    if len(found.limit(2).collect()) > 1:
        raise Ambiguous(f"more than one head is named {name}")
    return found


def timeline(archive: Archive, run_id: str | None = None) -> DataFrame:
    """Events in causal order (run, source, sequence with unsequenced ones last, insertion), with the ids they refer to."""
    events = archive.events if run_id is None else archive.events.where(F.col("run_id") == run_id)
    refs = archive.event_refs.groupBy(F.col("event").alias("ordinal")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "object_id"))), lambda r: r["object_id"]), ",").alias("object_ids"))
    rows = events.join(refs, "ordinal", "left").withColumn("object_ids", F.coalesce("object_ids", F.lit("")))
    return rows.select("run_id", "source", "sequence", "kind", "severity", "message", "activity_id", "revision_id", "scope", "producer_id", "retention", "object_ids", "ordinal").orderBy(*ORDERS["events"])


def ranked_timeline(archive: Archive) -> DataFrame:
    """Every event's place in its run's timeline. Ranks are taken per run, so a run's events meet in one task but no more."""
    from pyspark.sql import Window

    w = Window.partitionBy("run_id").orderBy(*ORDERS["events"][1:])
    return archive.events.withColumn("place", F.row_number().over(w))


def branch_from(archive: Archive, revision: str, head_id: str, name: str) -> Archive:
    """A new head on a revision; history is untouched."""
    spark = archive.heads.sparkSession
    last = archive.heads.agg(F.coalesce(F.max("ordinal"), F.lit(0)) + 1).alias("ordinal")
    row = spark.range(1).select(F.lit(head_id).alias("head_id"), F.lit(name).alias("name"), F.lit(revision).alias("revision_id")).crossJoin(last.toDF("ordinal"))  # one row
    return archive.replaced(heads=archive.heads.unionByName(row))


def promote_staged(archive: Archive, targets: DataFrame) -> DataFrame:
    """Object rows that the staged objects of runs become; `targets` has (run_id, revision_id)."""
    rows = archive.staged.join(targets.select("run_id", "revision_id"), "run_id")
    return rows.select(*columns("objects"))


def counts(archive: Archive) -> DataFrame:
    """(table, rows) of the seven base tables."""
    out = None
    for name in ("objects", "heads", "revisions", "runs", "events", "writes", "log_streams"):
        one = getattr(archive, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def namespaces(archive: Archive) -> DataFrame:
    """The distinct namespaces of the objects, sorted."""
    return archive.objects.select("ns_id").distinct().orderBy("ns_id")


def is_in(words: tuple[str, ...], column: str) -> Column:
    return F.col(column).isin(*words)
