"""Registration of queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..model import Archive
from ..sources.projection import archive, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, tables: str = "", sql: str | None = None):
    """Registers a function of an archive as a query; `sql` names archive tables a_<table>, those listed in `tables`."""

    def add(f: Callable[[Archive], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(archive(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_tables(sql, *tables.split()) if tables else sql
        return f

    return add


def found(diagnostics: DataFrame) -> DataFrame:
    """What is compared of diagnostics."""
    return diagnostics.select("code", "subject", "related")
