"""Schemas: the archive's catalog, embedded definitions, their rules and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import after_first, diagnostic, row_rules, union
from ..model import Archive
from . import namespaces

C, L = F.col, F.lit
KEY = ["schema_ns", "schema_id", "schema_version"]
STATUS_CODES = {"missing_schema": "missing_schema", "unsupported": "unsupported_schema", "migration_required": "migration_required"}


def statuses(rows: DataFrame, known: DataFrame) -> DataFrame:
    """`rows` with the compatibility that `known` schemas give their schema, or missing_schema."""
    known = known.select(*KEY, "compatibility").dropDuplicates(KEY)
    return rows.join(known, KEY, "left").withColumn("status", F.coalesce("compatibility", L("missing_schema"))).drop("compatibility")


def status_diagnostics(rows: DataFrame, known: DataFrame) -> DataFrame:
    code = F.create_map(*[L(x) for kv in STATUS_CODES.items() for x in kv])[C("status")]
    found = statuses(rows, known).withColumn("code", code).where("code IS NOT NULL")
    return diagnostic(found, C("code"), "object_id", F.concat_ws("/", *KEY), "schema {schema_ns}/{schema_id} version {schema_version} is {status}")


def object_statuses(a: Archive) -> DataFrame:
    return status_diagnostics(a.objects, a.catalog)


def provenance(a: Archive) -> DataFrame:
    """Environments and contexts that the catalog doesn't know."""
    known = a.environments
    env = a.objects.where("software_environment IS NOT NULL").join(known.where("kind = 'software'").select(C("id").alias("software_environment")).distinct(), "software_environment", "left_anti")
    ctx = a.objects.where("execution_context IS NOT NULL").join(known.where("kind = 'execution'").select(C("id").alias("execution_context")).distinct(), "execution_context", "left_anti")
    return diagnostic(env, "missing_software_environment", "object_id", "software_environment", "software environment {software_environment} is not in the catalog").unionByName(
        diagnostic(ctx, "missing_execution_context", "object_id", "execution_context", "execution context {execution_context} is not in the catalog")
    )


def needed(a: Archive, definitions: DataFrame) -> DataFrame:
    """Definitions of schemas that the archive's objects have."""
    return definitions.join(a.objects.select(*KEY).distinct(), KEY, "left_semi")


def listing(definitions: DataFrame, fields: DataFrame) -> DataFrame:
    """(schema, compatibility, field names sorted and joined) of every definition."""
    names = fields.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list("name")), lambda x: x), ",").alias("fields"), F.count(L(1)).alias("n_fields"))
    return definitions.join(names, KEY, "left").select(*KEY, "ns_id", "compatibility", "documentation", F.coalesce("fields", L("")).alias("fields"), F.coalesce("n_fields", L(0)).alias("n_fields")).orderBy(*KEY)


def known(definitions: DataFrame) -> DataFrame:
    return definitions.select(*KEY, "compatibility")


def definition_rules(a: Archive, definitions: DataFrame, fields: DataFrame) -> DataFrame:
    """Rules of single definitions: owner, reserved names, fields, node schema, replacement and migration.

    `definitions` has the schema key, ns_id, ns_uuid, compatibility, node_kind, and the keys replaces, replaced_by,
    migration_source and migration_target as `ns/id/version` strings or null.
    """
    cfg = a.config
    kind, key = F.concat_ws("/", "schema_ns", "schema_id"), F.concat_ws("/", *KEY)
    shared = C("ns_id") == cfg.shared
    counts = fields.groupBy(*KEY).agg(F.count(L(1)).alias("_n"))
    rows = definitions.join(counts, KEY, "left")
    needs = C("compatibility") == "migration_required"
    rules = row_rules(rows, [
        (C("ns_id") != C("schema_ns"), "schema_namespace_mismatch", key, C("ns_id"), L("a schema's namespace is not its owner's")),
        (C("ns_id").isin(*cfg.areas), "reserved_archive_area_claimed", key, C("ns_id"), L("a reserved archive area is no package namespace")),
        (shared & (C("ns_uuid") != "") & (C("ns_uuid") != cfg.shared_uuid), "reserved_namespace_claimed", key, C("ns_uuid"), L("the reserved namespace has another UUID")),
        (~shared & F.startswith(kind, L(cfg.shared + "/")), "reserved_kind_claimed", key, kind, L("the kind is reserved")),
        (C("_n").isNull() & C("node_kind").isNull(), "corrupt_schema", key, L("no_fields"), L("a schema has neither fields nor a node schema")),
        (C("node_kind").isNotNull() & (C("node_kind") != kind), "corrupt_schema", key, L("node_kind"), L("a node schema has another kind")),
        ((C("replaces") == key) | (C("replaced_by") == key), "corrupt_schema", key, L("replaces_itself"), L("a schema replaces itself")),
        (C("migration_target").isNotNull() & C("replaced_by").isNotNull() & (C("migration_target") != C("replaced_by")), "corrupt_schema", key, L("migration_target"), L("a migration's target is not the replacement")),
        (needs & C("migration_target").isNull(), "missing_migration_ref", key, L(""), L("a schema that requires migration names none")),
        (needs & C("migration_target").isNotNull() & (C("migration_source") != key), "corrupt_schema", key, L("migration_source"), L("a migration's source is another schema")),
    ])
    shape = fields.where("size(shape) > 0 AND size(shape) <> rank")
    twice = after_first(fields, [*KEY, "name"], ["pos"])
    field_key = F.concat_ws("/", *KEY)
    return union([
        rules,
        diagnostic(shape, "corrupt_schema", field_key, F.concat(L("shape:"), C("name")), "field {name} has a shape of another rank"),
        diagnostic(twice, "corrupt_schema", field_key, F.concat(L("duplicate:"), C("name")), "field {name} is declared twice"),
    ])


def replacement_links(definitions: DataFrame) -> DataFrame:
    """Replacements that the other side contradicts; of repeated definitions the last one speaks."""
    from pyspark.sql import Window

    key = F.concat_ws("/", *KEY)
    last = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("ordinal")))
    other = definitions.withColumn("_n", last).where("_n = 1").select(key.alias("_key"), C("replaces").alias("_replaces"), C("replaced_by").alias("_replaced_by"))
    rows = definitions.withColumn("_own", key)
    after = rows.join(other, C("replaced_by") == C("_key")).where("_replaces IS NOT NULL AND _replaces <> _own")
    before = rows.join(other, C("replaces") == C("_key")).where("_replaced_by IS NOT NULL AND _replaced_by <> _own")
    return diagnostic(after, "corrupt_schema", "_own", F.concat(L("successor:"), C("replaced_by")), "the successor replaces another schema").unionByName(
        diagnostic(before, "corrupt_schema", "_own", F.concat(L("predecessor:"), C("replaces")), "the predecessor is replaced by another schema")
    )


def registry(a: Archive, definitions: DataFrame, fields: DataFrame, with_claims: bool = False) -> DataFrame:
    """All rules of the embedded definitions."""
    key = F.concat_ws("/", *KEY)
    frames = [
        definition_rules(a, definitions, fields),
        diagnostic(after_first(definitions, KEY, ["ordinal"]), "duplicate_schema", key, None, "a schema is embedded more than once"),
        namespaces.identities(definitions, a, with_claims),
        replacement_links(definitions),
    ]
    if with_claims:
        frames.append(namespaces.against_claims(definitions.withColumn("_key", key), a, "_key"))
    return union(frames)
