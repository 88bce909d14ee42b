"""Archives as folders of Parquet or JSON tables, and the event stream as a file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TABLES, Archive, Config, columns, schema

CLUSTERED = {"object_id": ("objects", "refs", "externals"), "run_id": ("runs", "checkpoints", "activities", "activity_refs", "staged", "events", "log_streams"), "event": ("event_refs", "event_payload")}
VERIFIED = "_VERIFIED"


def save(archive: Archive, path: str, form: str = "parquet") -> None:
    """One folder a table. Tables are ranged by object, run or event, and sorted by it inside their files, so that the readers'
    filters on these skip files and row groups."""
    by = {name: key for key, names in CLUSTERED.items() for name in names}
    for name, df in archive.frames.items():
        if name in by:
            df = df.repartitionByRange(by[name]).sortWithinPartitions(by[name])
        df.write.mode("errorifexists").format(form).save(f"{path}/{name}")


def is_verified(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{VERIFIED}")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def to_records(archive: Archive, table: str) -> DataFrame:
    """(record): every row of a table as a JSON object with the table's columns in their order, in insertion order if it has one."""
    rows = getattr(archive, table)
    if "ordinal" in rows.columns:
        rows = rows.orderBy("ordinal")
    return rows.select(F.to_json(F.struct(*columns(table)), {"ignoreNullFields": "false"}).alias("record"))


def from_records(records: DataFrame, table: str) -> DataFrame:
    """The table that `to_records` has written; a record that is no such JSON raises."""
    return records.select(F.from_json("record", schema(table), {"mode": "FAILFAST"}).alias("r")).select("r.*")


def load(spark: SparkSession, path: str, form: str = "parquet", config: Config = Config(), verified: bool = False) -> Archive:
    """The archive in a folder; with `verified` only one that `purge.publish` has marked, any other raises."""
    if verified and not is_verified(spark, path):
        raise ValueError(f"{path} is not a verified archive")
    return Archive.of({n: spark.read.format(form).schema(schema(n)).load(f"{path}/{n}") for n in TABLES}, config)


def event_stream(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """The append-only events table as a stream of the files that arrive in `path`."""
    return spark.readStream.format(form).schema(schema("events")).load(path).select(*columns("events"))
