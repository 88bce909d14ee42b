"""Reference resolution: by existence (see rules.resolves), as seen from a revision, and over all versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import first_by
from ..model import Archive

C, L = F.col, F.lit


def versions(a: Archive) -> DataFrame:
    """The first row of every object version."""
    return first_by(a.objects, ["object_id", "revision_id"])


def sights(visible: DataFrame, objects: DataFrame) -> DataFrame:
    """(root, target_object, target_revision, found_revision, found_ordinal): what a reference to an object means as seen from a
    root, with a null target_revision for the unpinned one: the version in the nearest revision, in the root's visiting order,
    that holds the object. `visible` has (root, revision_id, rank).

    Every (root, object) is resolved here once, so references are left with an equi-join.
    """
    held = objects.select(C("object_id").alias("target_object"), C("revision_id").alias("found_revision"), C("ordinal").alias("found_ordinal"))
    seen = visible.select("root", C("revision_id").alias("found_revision"), "rank").join(held, "found_revision")
    near = seen.groupBy("root", "target_object").agg(F.min(F.struct("rank", "found_revision", "found_ordinal")).alias("b"))
    near = near.select("root", "target_object", L(None).cast("string").alias("target_revision"), "b.found_revision", "b.found_ordinal")
    return near.unionByName(seen.select("root", "target_object", C("found_revision").alias("target_revision"), "found_revision", "found_ordinal"))


def in_scope(refs: DataFrame, sights: DataFrame) -> DataFrame:
    """`refs` (root, target_object, target_revision, …) with (found_revision, found_ordinal), null where nothing is found; a
    pinned target must lie in what its root sees."""
    s = sights.select(*[C(c).alias(f"_{c}") for c in ("root", "target_object", "target_revision")], "found_revision", "found_ordinal")
    same = (C("root") == C("_root")) & (C("target_object") == C("_target_object")) & C("target_revision").eqNullSafe(C("_target_revision"))
    return refs.join(s, same, "left").drop("_root", "_target_object", "_target_revision")


def match_external(rows: DataFrame, externals: DataFrame, object_col: str = "target_object", content_col: str | None = None) -> DataFrame:
    """`rows` with (external, external_content): the first external requirement of the object whose content, if both sides
    name one, is the same."""
    ext = externals.select(C("object_id").alias("_eo"), C("content_id").alias("_ec"), C("ordinal").alias("_en"))
    if content_col is None:  # any content matches, so the first one wins
        first = first_by(ext, ["_eo"], ["_en"])
        return rows.join(first, C(object_col) == C("_eo"), "left").withColumn("external", C("_eo").isNotNull()).withColumnRenamed("_ec", "external_content").drop("_eo", "_en")
    # one answer for each different pair of object and content
    asked = rows.select(C(object_col).alias("_ao"), C(content_col).alias("_ac")).distinct()
    same = (C("_ao") == C("_eo")) & (C("_ec").isNull() | C("_ac").isNull() | (C("_ec") == C("_ac")))
    best = first_by(asked.join(ext, same), ["_ao", "_ac"], ["_en"]).select("_ao", "_ac", L(True).alias("external"), C("_ec").alias("external_content"))
    out = rows.join(best, (C(object_col) == C("_ao")) & C(content_col).eqNullSafe(C("_ac")), "left")
    return out.withColumn("external", F.coalesce("external", L(False))).drop("_ao", "_ac")


def all_versions(refs: DataFrame, objects: DataFrame, object_col: str = "object_id", revision_col: str = "revision_id") -> DataFrame:
    """`refs` joined to every version they may mean: the pinned one, or all of the object; unresolved ones have a null version."""
    held = objects.select(C("object_id").alias("_o"), C("revision_id").alias("version")).distinct()
    return refs.join(held, (C(object_col) == C("_o")) & (C(revision_col).isNull() | (C(revision_col) == C("version"))), "left").drop("_o")


def nearest(rows: DataFrame, keys: list[str], rank: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(rank))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")
