"""The event stream: atomic appends, repeated sequence numbers, credential screening.

Wall-clock time orders nothing here: an event's place is its source's own sequence. State is dropped when a run says that it
has ended, not by a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.columns import is_secret_name, is_secret_value
from ..model import columns
from ..operators import rules

ENDED = "run_ended"


def screened(events: DataFrame, payload: DataFrame | None = None) -> DataFrame:
    """Events with a flag for what looks like credentials, in their message or, if given, in their `payload` (event, key, value,
    is_text), a static table that is joined by the event's ordinal."""
    suspect = F.coalesce(is_secret_value(F.col("message")), F.lit(False))
    if payload is None:
        return events.withColumn("suspect", suspect)
    said = payload.where(is_secret_name(F.col("key")) | (F.col("is_text") & is_secret_value(F.col("value")))).select(F.col("event").alias("_event")).distinct()
    return events.join(said, F.col("ordinal") == F.col("_event"), "left").withColumn("suspect", suspect | F.col("_event").isNotNull()).drop("_event")


def append(
    stream: DataFrame, table: str, quarantine: str, checkpoint: str, trigger: dict | None = None, *,
    unit: str = "run_id", payload: DataFrame | None = None, writes: DataFrame | None = None,
) -> StreamingQuery:
    """Appends the stream's events to a table, unit by unit: what breaks a rule of atomic appends in a micro-batch is set aside
    whole, with the rules' codes.

    A unit is a run, or whatever other column of the stream tells batches apart. `payload` and `writes` are as in
    `rules.event_batches`, whose rules these are (`writes` names the unit as `batch`). Every micro-batch has a folder of its own
    that a retry overwrites, so an append happens once.
    """

    def write(events: DataFrame, batch_id: int) -> None:
        events = events.withColumn("batch", F.col(unit)).persist()
        try:
            found = rules.event_batches(events, payload, writes)
            wrong = found.groupBy(F.col("subject").alias("batch")).agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
            both = events.join(wrong, "batch", "left").select(*columns("events"), "codes").persist()
            both.where("codes IS NULL").drop("codes").write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
            both.where("codes IS NOT NULL").write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
            both.unpersist()
        finally:
            events.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class _Repeats(StatefulProcessor):
    """A map of the sequence numbers of one run and source; a row costs a lookup, whatever the map has grown to."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "sequence long", "kind string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run_id, source = key
        ended = False
        for pdf in rows:
            out = []
            for sequence, kind in zip(pdf["sequence"], pdf["kind"]):
                ended |= kind == ENDED
                if pd.isna(sequence):
                    continue
                if self.seen.containsKey((int(sequence),)):
                    out.append((run_id, source, int(sequence), kind))
                else:
                    self.seen.updateValue((int(sequence),), (kind,))
            yield pd.DataFrame(out, columns=["run_id", "source", "sequence", "kind"])
        if ended:
            self.seen.clear()

    def close(self) -> None:
        pass


def repeats(stream: DataFrame) -> DataFrame:
    """(run_id, source, sequence, kind): events that repeat a sequence number of their run and source, in any batch so far.

    The session's state store must be the RocksDB one when the query starts (see `state_store`).
    """
    keyed = stream.select("run_id", F.coalesce("source", F.lit("")).alias("source"), "sequence", "kind")
    return keyed.groupBy("run_id", "source").transformWithStateInPandas(_Repeats(), "run_id string, source string, sequence long, kind string", "append", "none")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB; the session's setting is put back."""
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(conf, before)
