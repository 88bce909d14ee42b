"""Namespace claims: resolution, rules, identities and the listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import after_first, diagnostic, first_by, owns_kind, row_rules, union
from ..model import Archive
from .lookup import ORDERS

C, L = F.col, F.lit


def first_claims(a: Archive) -> DataFrame:
    """The claim that an id finds: the first in canonical order."""
    return first_by(a.claims, ["ns_id"], ORDERS["claims"])


def resolved(a: Archive) -> DataFrame:
    """(id, claim_id, claim_uuid, canonical_id, role, status, display, direct): the claim that each known id resolves to.

    A direct claim wins; an alias claim leads to its canonical claim, one hop and no further; other ids belong to the first
    active or deprecated claim that lists them. Ids whose hop leads nowhere are left out.
    """
    claims = first_claims(a).select("ns_id", "ns_uuid", "ns_display", "role", "status", "canonical_id")
    own = claims.where("status <> 'alias'").select(C("ns_id").alias("id"), *[C(c) for c in claims.columns], L(True).alias("direct"))
    hop = claims.where("status = 'alias'").select(C("ns_id").alias("id"), C("canonical_id").alias("_to")).join(claims, C("_to") == C("ns_id")).select("id", *claims.columns, L(True).alias("direct"))
    listed = a.claim_aliases.select(C("claim").alias("ordinal"), "alias").join(a.claims.where("status <> 'alias'"), "ordinal")
    listed = first_by(listed, ["alias"], ORDERS["claims"]).join(claims.select(C("ns_id").alias("_n")), C("alias") == C("_n"), "left_anti")
    listed = listed.select(C("alias").alias("id"), *claims.columns, L(False).alias("direct"))
    return union([own, hop, listed]).select("id", C("ns_id").alias("claim_id"), C("ns_uuid").alias("claim_uuid"), "canonical_id", "role", "status", C("ns_display").alias("display"), "direct")


def _claim_rules(a: Archive) -> DataFrame:
    cfg = a.config
    ns, uuid = C("ns_id"), C("ns_uuid")
    identity = (ns == cfg.shared) | (C("canonical_id") == cfg.shared) | ((uuid != "") & (uuid == cfg.shared_uuid))
    return row_rules(a.claims, [
        (ns.isin(*cfg.areas), "reserved_archive_area_claimed", ns, L(""), L("a reserved archive area is no package namespace")),
        ((C("status") == "alias") & (ns == cfg.shared), "reserved_namespace_claimed", ns, L("alias"), L("the reserved namespace cannot be an alias")),
        (identity & (C("role") != "shared"), "reserved_namespace_claimed", ns, L("role"), L("the reserved namespace must use the shared role")),
        (identity & (uuid != "") & (uuid != cfg.shared_uuid), "reserved_namespace_claimed", ns, L("uuid"), L("the reserved namespace has another UUID")),
        (~identity & (C("role") == "shared"), "shared_namespace_role_mismatch", ns, C("role"), L("the shared role is reserved")),
    ])


def claim_rules(a: Archive) -> DataFrame:
    """What a claim answers to by itself, its aliases included."""
    return _claim_rules(a).unionByName(_alias_rules(a))


def _alias_rules(a: Archive) -> DataFrame:
    cfg = a.config
    return row_rules(a.claim_aliases, [
        (C("alias").isin(*cfg.areas), "reserved_archive_area_claimed", C("ns_id"), C("alias"), L("an alias is a reserved archive area")),
        (C("alias") == cfg.shared, "reserved_namespace_claimed", C("ns_id"), C("alias"), L("the reserved namespace cannot be an alias")),
    ])


def _canonical_rules(a: Archive) -> DataFrame:
    to = first_claims(a).select(C("ns_id").alias("_id"), C("ns_uuid").alias("_uuid"), C("role").alias("_role"), C("status").alias("_status"))
    rows = a.claims.where("status = 'alias'").join(to, C("canonical_id") == C("_id"), "left")
    whole = C("_id").isNotNull() & (C("_status") != "alias")
    return row_rules(rows, [
        (C("_id").isNull(), "namespace_alias_unresolved", C("ns_id"), C("canonical_id"), L("an alias names an unknown canonical namespace")),
        (C("_status") == "alias", "namespace_alias_not_canonical", C("ns_id"), C("canonical_id"), L("an alias names another alias")),
        (whole & (C("_uuid") != "") & (C("ns_uuid") != "") & (C("_uuid") != C("ns_uuid")), "namespace_alias_uuid_mismatch", C("ns_id"), C("canonical_id"), L("an alias has another UUID")),
        (whole & (C("role") != C("_role")), "namespace_alias_role_mismatch", C("ns_id"), C("canonical_id"), L("an alias has another role")),
    ])


def _alias_owners(a: Archive) -> DataFrame:
    """Aliases with two owners, and aliases that another claim holds as its own id."""
    claims = a.claims.withColumn("_place", F.struct(*ORDERS["claims"]))
    own = claims.where("status = 'alias'").select("_place", L(0).cast("bigint").alias("pos"), C("ns_id").alias("alias"), C("canonical_id").alias("owner"))
    listed = claims.where("status <> 'alias'").join(a.claim_aliases.select(C("claim").alias("ordinal"), "alias", "pos"), "ordinal").select("_place", "pos", "alias", C("ns_id").alias("owner"))
    owners = own.unionByName(listed).withColumn("_first", F.first("owner").over(Window.partitionBy("alias").orderBy("_place", "pos")))
    two = owners.where("owner <> _first")
    direct = first_claims(a).select(C("ns_id").alias("_id"), "status", "canonical_id")
    held = owners.select("alias", C("_first").alias("owner")).distinct().join(direct, C("alias") == C("_id"))
    held = held.where(F.when(C("status") == "alias", C("canonical_id") != C("owner")).otherwise(C("_id") != C("owner")))
    return diagnostic(two, "namespace_identity_conflict", "alias", "owner", "alias {alias} is claimed by both {_first} and {owner}").unionByName(
        diagnostic(held, "namespace_identity_conflict", "owner", "alias", "alias {alias} of {owner} collides with another claim")
    )


def registry(a: Archive) -> DataFrame:
    """All rules of the claims by themselves."""
    ids = a.claims.where("ns_uuid <> ''").select("ns_uuid", F.when(C("status") == "alias", C("canonical_id")).otherwise(C("ns_id")).alias("id"))
    split = ids.groupBy("ns_uuid").agg(F.array_sort(F.collect_set("id")).alias("ids")).where("size(ids) > 1")
    return union([
        claim_rules(a),
        _canonical_rules(a),
        _alias_owners(a),
        diagnostic(after_first(a.claims, ["ns_id"], ORDERS["claims"]), "duplicate_namespace_claim", "ns_id", None, "namespace {ns_id} is claimed more than once"),
        diagnostic(split, "namespace_id_split", "ns_uuid", F.array_join("ids", ","), "package UUID {ns_uuid} is registered under several ids"),
    ])


def identities(rows: DataFrame, a: Archive, with_claims: bool) -> DataFrame:
    """Ids with several UUIDs, and UUIDs with several ids that no shared canonical claim explains; `rows` has ns_id, ns_uuid."""
    pairs = rows.where("ns_uuid <> ''").select("ns_id", "ns_uuid").distinct()
    conflict = pairs.groupBy("ns_id").agg(F.array_sort(F.collect_set("ns_uuid")).alias("uuids")).where("size(uuids) > 1")
    split = pairs.groupBy("ns_uuid").agg(F.array_sort(F.collect_set("ns_id")).alias("ids")).where("size(ids) > 1")
    if with_claims:
        found = pairs.join(resolved(a).select(C("id").alias("ns_id"), "claim_id", "claim_uuid", "canonical_id"), "ns_id", "left")
        good = C("claim_id").isNotNull() & ((C("claim_uuid") == "") | (C("claim_uuid") == C("ns_uuid")))
        explained = found.groupBy("ns_uuid").agg(F.bool_and(good).alias("ok"), F.count_distinct("canonical_id").alias("n")).where("ok AND n = 1")
        split = split.join(explained, "ns_uuid", "left_anti")
    return diagnostic(conflict, "namespace_identity_conflict", "ns_id", F.array_join("uuids", ","), "namespace {ns_id} is claimed by several package UUIDs").unionByName(
        diagnostic(split, "namespace_id_split", "ns_uuid", F.array_join("ids", ","), "package UUID {ns_uuid} is used under several ids without an alias")
    )


def against_claims(rows: DataFrame, a: Archive, subject: str) -> DataFrame:
    """Rows whose namespace leaves out, or contradicts, the UUID that its claim registers."""
    found = rows.join(resolved(a), C("ns_id") == C("id"))
    code = F.when(C("claim_uuid") == "", None).when(C("ns_uuid") == "", "namespace_identity_missing").when(C("claim_uuid") != C("ns_uuid"), "namespace_identity_conflict")
    return diagnostic(found.withColumn("code", code).where("code IS NOT NULL"), C("code"), subject, "ns_id", "namespace {ns_id} does not carry the registered UUID {claim_uuid}")


def object_identities(a: Archive, with_claims: bool = False) -> DataFrame:
    out = identities(a.objects, a, with_claims)
    return out.unionByName(against_claims(a.objects, a, "object_id")) if with_claims else out


def listing(a: Archive, with_claims: bool = True) -> DataFrame:
    """(ns_id, ns_uuid, display, role, status, canonical_id, aliases, kinds, schema_ids) of every namespace that objects or
    claims name; lists are joined by commas.

    An object namespace's identity is folded in insertion order: the first UUID replaces all of it, and from there on (from
    the start, where there is none) a greater display name replaces the name. So it is the first UUID, and the greatest
    name at or after its object.
    """
    first = a.objects.where("ns_uuid <> ''").groupBy("ns_id").agg(F.min_by("ns_uuid", "ordinal").alias("uuid"), F.min("ordinal").alias("_since"))
    names = a.objects.select("ns_id", "ns_display", "ordinal").join(first, "ns_id", "left")
    seen = names.groupBy("ns_id").agg(F.first("uuid").alias("_u"), F.max(F.when(C("_since").isNull() | (C("ordinal") >= C("_since")), C("ns_display"))).alias("name"))
    kinds = a.objects.groupBy("ns_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_set("schema_id")).alias("schema_ids"))
    seen = seen.select("ns_id", F.coalesce("_u", L("")).alias("uuid"), "name").join(kinds, "ns_id")
    none = F.array().cast("array<string>")
    if not with_claims:
        role = F.when(C("ns_id") == a.config.shared, "shared").otherwise("domain")
        return seen.select("ns_id", C("uuid").alias("ns_uuid"), C("name").alias("display"), role.alias("role"), L("active").alias("status"), C("ns_id").alias("canonical_id"), L("").alias("aliases"), F.array_join("kinds", ",").alias("kinds"), F.array_join("schema_ids", ",").alias("schema_ids"))
    # claims of an id are overlaid in canonical order: the last one's role, status and canonical id, the last names that are not empty
    lists = a.claims.groupBy("ns_id").agg(F.array_sort(F.collect_list(F.struct("ns_uuid", "status", "ordinal", "role", "canonical_id", "ns_display"))).alias("l"))

    def last_of(name):
        return F.element_at(F.filter(F.transform("l", lambda x: x[name]), lambda v: v != ""), -1)

    lists = lists.select("ns_id", F.try_element_at("l", L(-1)).alias("z"), F.when(F.exists("l", lambda x: x["ns_uuid"] != ""), last_of("ns_uuid")).alias("cu"), F.when(F.exists("l", lambda x: x["ns_display"] != ""), last_of("ns_display")).alias("cd"))
    aliases = a.claim_aliases.groupBy(C("ns_id")).agg(F.collect_set("alias").alias("own_aliases"))
    rows = seen.join(lists, "ns_id", "full").join(aliases, "ns_id", "left")
    res = resolved(a).select(C("id").alias("_id"), "claim_id", C("role").alias("r_role"), C("status").alias("r_status"), C("canonical_id").alias("r_canonical"))
    extra = a.claim_aliases.groupBy(C("ns_id").alias("claim_id")).agg(F.collect_set("alias").alias("claim_aliases"))
    rows = rows.join(res.join(extra, "claim_id", "left"), C("ns_id") == C("_id"), "left")
    other = C("claim_id").isNotNull() & (C("ns_id") != C("claim_id"))
    names = F.array_sort(F.array_union(F.array_union(F.coalesce("own_aliases", none), F.coalesce("claim_aliases", none)), F.when(other, F.array("ns_id")).otherwise(none)))
    return rows.select(
        "ns_id",
        F.coalesce("cu", "uuid", L("")).alias("ns_uuid"),
        F.coalesce("cd", "name", L("")).alias("display"),
        F.coalesce("z.role", "r_role", F.when(C("ns_id") == a.config.shared, "shared").otherwise("domain")).alias("role"),
        F.coalesce("z.status", F.when(other, "alias").otherwise(C("r_status")), L("active")).alias("status"),
        F.coalesce("z.canonical_id", "r_canonical", "ns_id").alias("canonical_id"),
        F.array_join(names, ",").alias("aliases"),
        F.array_join(F.coalesce("kinds", none), ",").alias("kinds"),
        F.array_join(F.coalesce("schema_ids", none), ",").alias("schema_ids"),
    )


def owned(a: Archive) -> DataFrame:
    """Objects whose kind their namespace owns."""
    return a.objects.where(owns_kind(C("ns_id"), C("kind")))
