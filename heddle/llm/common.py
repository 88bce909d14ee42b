"""Reading, staging and key helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import stage as _stage
from ..staging import unstage

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
__all__ = ["fold_ascii", "grouped", "lean", "null_safe", "owners", "read_table", "runs", "salt_of", "scope", "small_batches", "stage", "unstage"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below `sf_dir`, by any path that Spark can open."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what a Python worker holds at once: at most `rows` documents go over in one Arrow batch."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(conf, "10000")) <= rows:
        spark.conf.set(conf, str(rows))


_scopes: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Tables staged inside are deleted at the end; those staged with keep at the end of the scope around it, or with the session."""
    _scopes.append([])
    try:
        yield
    finally:
        unstage(*_scopes.pop())


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes `df` as Parquet into the shared folder and reads it again.

    The lineage ends there, and a lost executor costs only the tasks that ran on it.
    """
    small_batches(df.sparkSession)
    out = _stage(df, name)
    if len(_scopes) > keep:
        _scopes[-2 if keep else -1].append(out)
    return out


def fold_ascii(text: Column) -> Column:
    """A-Z to lower case and nothing else; pure ASCII takes the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())
    )


def owners(rows: DataFrame, key: str, order: list[str], spread: int = 64) -> DataFrame:
    """(key, salt, size, first): of every key with two or more rows, its row count and its least `order` struct.

    Rows are counted by (key, salt) and then by key, so that no task receives the rows of a hot key; the result has
    one row for every salt that the key uses. A row's salt is `salt_of` of the same columns.
    """
    part = rows.groupBy(key, salt_of(order, spread).alias("salt")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first")
    )
    whole = part.groupBy(key).agg(
        F.sum("n").alias("size"), F.min("first").alias("first"), F.collect_set("salt").alias("salts")
    )
    return whole.where("size > 1").select(key, F.explode("salts").alias("salt"), "size", "first")


def salt_of(cols: list[str], spread: int = 64) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(spread)).cast("int")


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The groups of rows with equal neighbouring `key`, whole even where they cross Arrow batches.

    For partitions that are clustered by `key` and sorted on it.
    """
    import numpy as np
    import pyarrow.compute as pc

    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = table.column(key).combine_chunks()
        if len(keys) > 1:
            cuts = np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1
        else:
            cuts = np.empty(0, dtype=np.int64)
        starts = [0, *cuts.tolist(), table.num_rows]
        for a, b in zip(starts, starts[1:]):
            k = keys[a].as_py()
            if held and k != held_key:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            held_key = k
    if held:
        yield pa.concat_tables(held)


def grouped(df: DataFrame, key: str, fn: Callable[[pa.Table], list[pa.RecordBatch] | pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies `fn` to the rows of each `key`. Groups are bounded by the caller; one task streams over many."""

    def over(batches):
        for table in runs(batches, key):
            out = fn(table)
            if out is not None:
                yield out

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(lean(over), schema)


def lean(over: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function, that gives back to the system what its worker has freed when a partition is done: workers live on,
    side by side with the JVM, through all later stages."""

    def run(batches):
        import ctypes

        yield from over(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def null_safe(pairs: list[tuple[Column, Column]]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out = out & a.eqNullSafe(b)
    return out
