"""Cutting lineage in iterative operators by tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_left: dict[str, SparkSession] = {}  # staged tables that still exist
SMALL = 500_000  # rows of ids that a table is filtered by without being moved


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset: a temporary one if everything runs in one JVM, else one in the
    warehouse, which executors share too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    if spark not in _own:
        folder = tempfile.TemporaryDirectory(prefix="heddle-")
        atexit.register(folder.cleanup)
        _own[spark] = folder
    return "file://" + _own[spark].name


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes `df` as Parquet, with the writer's `options`, into the shared folder and reads it again; a lost executor costs only
    its own tasks. The table is deleted by `unstage`, or when the session's process ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    _left[path] = df.sparkSession
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _left.pop(path, None)


def unstage(*frames: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "staged_path", None)
        if path:
            _delete(df.sparkSession, path)


def near(staged: DataFrame) -> DataFrame:
    """A staged table of ids as one side of a join with a large table: broadcast while it has no more than `SMALL` rows, which are
    counted first, else left to a shuffle."""
    return F.broadcast(staged) if staged.count() <= SMALL else staged


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs, which else stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


@atexit.register
def clear() -> None:
    """Deletes all staged tables that are left."""
    for path, spark in list(_left.items()):
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            _delete(spark, path)
