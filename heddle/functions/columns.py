"""Columns that several operators share: sort keys, first-match windows, name and secret predicates, diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST = (1 << 63) - 1  # where an event without a sequence sorts

# What counts as a secret by name, and by value.
SECRET_NAMES = ("password", "secret", "token", "api_key", "apikey", "authorization", "private_key", "privatekey", "cookie", "credential", "passwd")
SECRET_VALUES = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"(?i)\bbearer\s+[A-Za-z0-9._\-+/=]{20,}",
    r"(?i)\b(sk|ghp|gho|xox[baprs])-[A-Za-z0-9]{16,}",
)


def first_by(df: DataFrame, keys: list[str], order: list[str] = ["ordinal"]) -> DataFrame:
    """The first row of every key: what a lookup in insertion order finds."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def after_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """Every row of a key but the first."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n > 1").drop("_n")


def is_secret_name(name: Column) -> Column:
    low = F.lower(name)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in SECRET_NAMES])


def is_secret_value(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in SECRET_VALUES])


def schema_kind() -> Column:
    return F.concat_ws("/", "schema_ns", "schema_id")


def owns_kind(namespace: Column, kind: Column) -> Column:
    return F.startswith(kind, F.concat(namespace, F.lit("/")))


SEVERITIES = ("info", "warning", "error")
DIAGNOSTIC = ["severity", "code", "subject", "related", "message", "context"]


def diagnostic(df: DataFrame, code: str | Column, subject: str | Column, related: str | Column | None = None, message: str = "", severity: str = "error", **context: Column) -> DataFrame:
    """Rows as diagnostics. `message` may name columns in braces."""
    if severity not in SEVERITIES:
        raise ValueError(f"unknown severity {severity}")
    subject = F.col(subject) if isinstance(subject, str) else subject
    related = F.lit("") if related is None else F.coalesce((F.col(related) if isinstance(related, str) else related).cast("string"), F.lit(""))
    parts, rest = [], message
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), F.coalesce(F.col(name).cast("string"), F.lit(""))]
    pairs = [x for k, v in context.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        F.lit(severity).alias("severity"),
        (F.lit(code) if isinstance(code, str) else code).alias("code"),
        subject.cast("string").alias("subject"),
        related.alias("related"),
        F.concat(*parts, F.lit(rest)).alias("message"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("context"),
    )


def row_rules(df: DataFrame, rules: list[tuple[Column, str, Column, Column, Column]]) -> DataFrame:
    """Many rules over one table in one scan; a rule is (condition, code, subject, related, message)."""
    hits = [
        F.when(cond, F.struct(F.lit("error").alias("severity"), F.lit(code).alias("code"), subject.cast("string").alias("subject"), F.coalesce(related.cast("string"), F.lit("")).alias("related"), message.alias("message")))
        for cond, code, subject, related, message in rules
    ]
    found = df.select(F.explode(F.array_compact(F.array(*hits))).alias("d")).select("d.*")
    return found.withColumn("context", F.create_map(F.lit("subject"), "subject", F.lit("related"), "related"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def distinct_diagnostics(df: DataFrame) -> DataFrame:
    """One row for every (code, message, context); maps are compared as sorted entries."""
    return df.withColumn("_c", F.to_json(F.array_sort(F.map_entries("context")))).dropDuplicates(["code", "message", "_c"]).drop("_c")
