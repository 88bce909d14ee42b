"""Tables of an archive, their columns, vocabularies and ingest checks.

Every collection is a table in normal form: lists that a record owns (references, parents, checkpoints, aliases) are tables
of their own with a position. `ordinal` is the insertion order that "first match" and ties refer to.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegralType, NullType, StringType

# The vocabularies and reserved names that archives are written with.
OPERATION_REUSE = ("forbid", "allow_if_domain_says", "force_recompute")
ACTIVITY_REUSE = ("computed", "reused", "forced")
RUN_STATUSES = ("queued", "running", "completed", "failed", "interrupted", "cancelled", "uncertain")
INCOMPLETE = tuple(s for s in RUN_STATUSES if s != "completed")
RESTARTABLE = ("failed", "interrupted", "cancelled", "uncertain")
STAGED_ORIGINS = ("generated", "reused")
WRITE_SCOPES = ("archive", "run")
WRITE_PHASES = ("begin", "appending", "committing", "committed", "aborted", "uncertain")
IN_FLIGHT = WRITE_PHASES[:3]
SEVERITIES = ("debug", "info", "warn", "error")
RETENTIONS = ("ephemeral", "debug", "forensic", "pinned")
LOG_KINDS = ("stdout", "stderr", "trace")
COMPATIBILITIES = ("exact_read", "backwards_compatible", "migration_required", "unsupported")
CLAIM_ROLES = ("shared", "domain", "extension")
CLAIM_STATUSES = ("active", "deprecated", "alias")
SCALAR_KINDS = ("bool", "integer", "real", "complex", "string", "symbol", "enum")
RESERVED_AREAS = ("profile", "provenance", "schemas", "revisions", "runs", "events", "heads", "objects", "content", "payloads")

#: Columns of every table; `!` marks those that may not be null.
TABLES = {
    "objects": "object_id! revision_id! content_id run_id ns_id! ns_uuid! ns_display! kind! schema_ns! schema_id! schema_version! software_environment execution_context ordinal!",
    "refs": "owner! object_id! revision_id! name! target_object! target_revision pos!",
    "heads": "head_id! name! revision_id! ordinal!",
    "revisions": "revision_id! run_id plan_id ordinal!",
    "edges": "child! parent! pos!",
    "runs": "run_id! plan_id parent_run_id revision_id status! software_environment execution_context agent_id restart_declared! restart_context restart_activity ordinal!",
    "checkpoints": "run_id! object_id! content_id revision_id kind pos!",
    "activities": "run_id! activity_id! declared_run_id! operation! idempotency_key reuse! ordinal!",
    "activity_refs": "run_id! activity_id! direction! name! object_id! revision_id pos!",
    "staged": "run_id! object_id! content_id ns_id! ns_uuid! ns_display! kind! schema_ns! schema_id! schema_version! software_environment execution_context origin! source_revision_id activity_id ordinal!",
    "events": "kind! run_id! activity_id sequence source severity! message! timestamp scope revision_id producer_id execution_context retention! ordinal!",
    "event_refs": "event! object_id! revision_id pos!",
    "event_payload": "event! key! value is_text!",
    "writes": "scope! phase! sequence! run_id writer_token ordinal!",
    "log_streams": "run_id! kind! activity_id source retention! content_id summary ordinal!",
    "externals": "object_id! content_id artifact_kind! path uri description ordinal!",
    "catalog": "schema_ns! schema_id! schema_version! compatibility!",
    "environments": "kind! id!",
    "claims": "ns_id! ns_uuid! ns_display! role! status! canonical_id! ordinal!",
    "claim_aliases": "ns_id! claim! alias! pos!",
    "plan_operations": "plan_id! kind! reuse! pos!",
}
VOCABULARIES = {
    ("runs", "status"): RUN_STATUSES,
    ("activities", "reuse"): ACTIVITY_REUSE,
    ("staged", "origin"): STAGED_ORIGINS,
    ("writes", "scope"): WRITE_SCOPES,
    ("writes", "phase"): WRITE_PHASES,
    ("events", "severity"): SEVERITIES,
    ("events", "retention"): RETENTIONS,
    ("log_streams", "retention"): RETENTIONS,
    ("log_streams", "kind"): LOG_KINDS,
    ("catalog", "compatibility"): COMPATIBILITIES,
    ("claims", "role"): CLAIM_ROLES,
    ("claims", "status"): CLAIM_STATUSES,
    ("plan_operations", "reuse"): OPERATION_REUSE,
}


@dataclass(frozen=True)
class Config:
    """Which namespace is the shared one, by name and package UUID, and which names are areas of the archive itself."""

    shared: str = "core"
    shared_uuid: str = "00000000-0000-4000-8000-000000000001"
    areas: tuple[str, ...] = RESERVED_AREAS


@dataclass(frozen=True)
class Archive:
    """The tables, each a DataFrame or None where an archive has no such rows."""

    frames: dict[str, DataFrame] = field(default_factory=dict)
    config: Config = Config()

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__") or name not in TABLES:
            raise AttributeError(name)
        return self.frames[name]

    @cached_property
    def has_revisions(self) -> bool:
        """Whether any revision has a record; several checks apply only then."""
        return not self.revisions.isEmpty()

    def replaced(self, **frames: DataFrame) -> Archive:
        return replace(self, frames=self.frames | frames)

    @staticmethod
    def of(frames: dict[str, DataFrame], config: Config = Config()) -> Archive:
        """Checks that every table has its columns, with their types; missing tables are empty."""
        unknown = set(frames) - set(TABLES)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        spark = next(iter(frames.values())).sparkSession
        out = {}
        for name, text in TABLES.items():
            if name in frames:
                missing = set(columns(name)) - set(frames[name].columns)
                if missing:
                    raise ValueError(f"table {name} lacks {sorted(missing)}")
                kinds = {f.name: f.dataType for f in frames[name].schema}
                wrong = [c for c in columns(name) if not isinstance(kinds[c], (IntegralType if c in _LONG else BooleanType if c in _BOOLEAN else StringType, NullType))]
                if wrong:
                    raise TypeError(f"table {name} has other types than {schema(name)} in {wrong}")
                out[name] = frames[name].select(*columns(name))
            else:
                out[name] = spark.createDataFrame([], schema(name))
        return Archive(out, config)


_LONG = {"ordinal", "pos", "owner", "sequence", "event", "claim"}
_BOOLEAN = {"restart_declared", "is_text"}


def columns(table: str) -> list[str]:
    return [c.rstrip("!") for c in TABLES[table].split()]


def schema(table: str) -> str:
    return ", ".join(f"{c} {'bigint' if c in _LONG else 'boolean' if c in _BOOLEAN else 'string'}" for c in columns(table))


def ingest(table: str, rows: DataFrame) -> DataFrame:
    """Rows as they may enter a table: ids trimmed, optional strings that are empty made null; a required value that is
    missing or blank, a word outside its vocabulary or a negative sequence raises when the rows are read."""
    out = []
    for text in TABLES[table].split():
        name, required = text.rstrip("!"), text.endswith("!")
        c = F.col(name)
        if name in _LONG or name in _BOOLEAN:
            good = c.isNotNull() if required else F.lit(True)
            if name == "sequence":
                good = good & (c.isNull() | (c >= 0))
            value = c.cast("bigint" if name in _LONG else "boolean")
        else:
            value = F.trim(c)
            if not required:
                value = F.nullif(value, F.lit(""))
            allows_empty = name in ("ns_uuid", "ns_display", "message")
            good = (c.isNotNull() if allows_empty else c.isNotNull() & (value != "")) if required else F.lit(True)
            words = VOCABULARIES.get((table, name))
            if words:
                good = good & value.isin(*words)
        out.append(F.when(good, value).otherwise(F.raise_error(F.concat(F.lit(f"{table}.{name}: bad value "), F.coalesce(c.cast("string"), F.lit("null"))))).alias(name))
    checked = rows.select(*out)
    if table == "staged":
        checked = _require(checked, ~((F.col("origin") == "reused") & F.col("source_revision_id").isNull()), "staged: reused needs a source revision")
    if table == "writes":
        checked = _require(checked, ~((F.col("scope") == "run") & F.col("run_id").isNull()), "writes: run scope needs a run")
    if table == "claims":
        alias = F.col("status") == "alias"
        checked = _require(checked, F.when(alias, F.col("canonical_id") != F.col("ns_id")).otherwise(F.col("canonical_id") == F.col("ns_id")), "claims: canonical id")
    return checked


def _require(df: DataFrame, good, message: str) -> DataFrame:
    first = df.columns[0]
    return df.withColumn(first, F.when(good, F.col(first)).otherwise(F.raise_error(F.lit(message))))




def ingest_schemas(definitions: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Embedded schema definitions and their fields as they may enter an archive: ids trimmed and not blank, a known
    compatibility, a migration between two schemas, a shape that is empty or has the field's rank, and extents that are not
    negative; anything else raises when the rows are read."""
    keys = ["schema_ns", "schema_id", "schema_version"]

    def trimmed(df, names):
        for name in names:
            value = F.trim(name)
            df = df.withColumn(name, F.when(value != "", value).otherwise(F.raise_error(F.lit(f"schema {name}: blank"))))
        return df

    d = trimmed(definitions, [*keys, "ns_id"])
    d = _require(d, F.col("compatibility").isin(*COMPATIBILITIES), "schema compatibility: bad value")
    both = F.col("migration_source").isNotNull() & F.col("migration_target").isNotNull()
    d = _require(d, ~both | (F.col("migration_source") != F.col("migration_target")), "a migration leads to its own source")
    d = _require(d, F.col("migration_target").isNull() == F.col("migration_source").isNull(), "a migration needs a source and a target")
    f = trimmed(fields, [*keys, "name"])
    f = _require(f, F.col("rank") >= 0, "a field's rank is negative")
    f = _require(f, F.col("shape").isNull() | (F.size("shape") == 0) | (F.size("shape") == F.col("rank")), "a field's shape has another rank")
    f = _require(f, F.coalesce(F.forall("shape", lambda x: x.isNull() | (x >= 0)), F.lit(True)), "a field's extent is negative")
    return d, f
