"""Incremental runs: changed items arrive as a stream, each micro-batch is compared and stored."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import units
from ..sources.state import StateTable


def newest_readings(stored: DataFrame, batch: str | None = None) -> DataFrame:
    """(entity_id, weight, seen_at): the newest stored reading of each item, those of ``batch`` left out."""
    rows = stored if batch is None else stored.filter(F.col("batch") != batch)
    return rows.groupBy("entity_id").agg(F.max(F.struct("seen_at", "weight")).alias("r")).select("entity_id", "r.weight", "r.seen_at")


def weight_events(batch: DataFrame, then: DataFrame | None, threshold: float) -> DataFrame:
    """Newest reading of each item in the batch against the stored one: baseline, changed, same or late.

    Of readings of one time the greatest weight counts; one without a time is late where one is stored.
    """
    last = newest_readings(batch).withColumnRenamed("weight", "now")
    if then is None:
        return last.select("entity_id", F.lit(None).cast("double").alias("then"), "now", "seen_at", F.lit("baseline").alias("action"))
    rows = last.join(then.select("entity_id", F.col("weight").alias("then"), F.col("seen_at").alias("_then_at"), F.lit(True).alias("_stored")), "entity_id", "left")
    newer = F.col("_then_at").isNull() | F.coalesce(F.col("seen_at") > F.col("_then_at"), F.lit(False))
    action = F.when(F.col("_stored").isNull(), "baseline").when(~newer, "late").when(units.weight_changed(F.col("then"), F.col("now"), threshold), "changed").otherwise("same")
    return rows.select("entity_id", "then", "now", "seen_at", action.alias("action"))


def run(stream: DataFrame, state: StateTable, threshold: float, checkpoint: str, sink: Callable[[DataFrame, int], None], fold_every: int = 100) -> StreamingQuery:
    """Starts the run over all there is.  ``sink`` gets each batch's events and its number.

    A batch appends its readings to the state, marked with its number, and is compared with the
    readings of other batches only.  So one that is replayed after a failure hands the same events
    under the same number to ``sink`` again, which can tell by it, and the state is none the worse.
    Every ``fold_every`` batches the state is folded to one reading an item, and older versions go.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        mark = f"{checkpoint}#{epoch}"
        if epoch and epoch % fold_every == 0 and (stored := state.read()) is not None:
            state.write(newest_readings(stored, mark).withColumn("batch", F.lit("")))
            state.prune()
        then = state.read()
        if then is not None:  # the few items of a batch, before their readings are grouped
            then = newest_readings(then.join(batch.select("entity_id").distinct(), "entity_id", "left_semi"), mark)
        events = weight_events(batch, then, threshold).persist()
        try:
            sink(events, epoch)
            state.append(events.filter("action in ('baseline', 'changed')").select("entity_id", F.col("now").alias("weight"), "seen_at", F.lit(mark).alias("batch")))
        finally:
            events.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EVENTS = "entity_id string, then double, now double, seen_at timestamp, action string"
KEYED = EVENTS.replace("seen_at timestamp", "seen_us long")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a session sets for a keyed run: the state store, and that a batch commits what it changed, not its stores' files.
KEYED_CONF = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


class LastReading(StatefulProcessor):
    """Keeps each item's last stored reading and tells what a batch's newest reading is to it, as ``weight_events`` does.

    Times are microseconds.  Rows pass one by one, and an item's state is read once and written at most once a batch.
    An item that is not seen for ``silent_after`` (by the clock of the cluster) gives one event ``silent`` and is kept.
    """

    def __init__(self, threshold: float, silent_after: datetime.timedelta | None = None) -> None:
        self.threshold, self.silent_ms = threshold, None if silent_after is None else int(silent_after.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reading = handle.getValueState("reading", "weight double, seen_us long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        newest = max(rows, key=_place)
        seen_us, weight = newest.seen_us, newest.weight
        stored = self.reading.get()
        then, then_us = (None, None) if stored is None else stored
        newer = then_us is None or (seen_us is not None and seen_us > then_us)
        moved = then is not None and weight is not None and not abs(then - weight) < self.threshold  # NaN is far from all
        action = "baseline" if stored is None else "late" if not newer else "changed" if moved else "same"
        if action in ("baseline", "changed"):
            self.reading.update((weight, seen_us))
        if self.silent_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
        yield Row(entity_id=key[0], then=then, now=weight, seen_us=seen_us, action=action)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        then, then_us = self.reading.get()
        yield Row(entity_id=key[0], then=then, now=None, seen_us=then_us, action="silent")

    def close(self) -> None:
        pass


def _place(r: Row) -> tuple:
    """The order of readings: by time, then by weight; null is least and NaN the greatest weight."""
    w = r.weight
    return r.seen_us is not None, r.seen_us or 0, w is not None, w is not None and w != w, w if w is not None and w == w else 0.0


def keyed_events(stream: DataFrame, threshold: float, silent_after: datetime.timedelta | None = None) -> DataFrame:
    """Events of a stream of readings (entity_id, weight, seen_at), with the state by item in the state store.

    A batch reads and writes the state of its own items only, and a batch that is replayed starts from the state before
    it, so its events are the same.  The session must use the RocksDB state store (``ROCKSDB``).
    """
    by_item = stream.select(F.col("entity_id").cast("string").alias("entity_id"), "weight", F.unix_micros("seen_at").alias("seen_us")).groupBy("entity_id")
    mode = "None" if silent_after is None else "ProcessingTime"
    events = by_item.transformWithState(LastReading(threshold, silent_after), outputStructType=KEYED, outputMode="Append", timeMode=mode)
    return events.select("entity_id", "then", "now", F.timestamp_micros("seen_us").alias("seen_at"), "action")


def run_keyed(stream: DataFrame, threshold: float, checkpoint: str, path: str, silent_after: datetime.timedelta | None = None) -> StreamingQuery:
    """Starts the keyed run over all there is; events go to a Parquet table under ``path``, each once."""
    return keyed_events(stream, threshold, silent_after).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_actions(stream: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Log actions by hour, late rows up to the watermark; works on a batch as well."""
    rows = stream.withWatermark("logged_at", lateness) if stream.isStreaming else stream
    return rows.groupBy(F.window("logged_at", "1 hour").alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "action", "n")


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
