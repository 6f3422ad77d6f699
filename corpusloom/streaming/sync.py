"""Structured Streaming forms of incremental ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusloom.operators import ingest


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Files that drop into a folder, so many per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def calls_per_window(events: DataFrame, seconds: int, late: str = "10 minutes", key: str = "user_id", at: str = "ts") -> DataFrame:
    """key, window_start, calls per tumbling window, with events later than the watermark left out."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    counted = timed.groupBy(F.window("_at", f"{seconds} seconds").alias("w"), key).agg(F.count("*").alias("calls"))
    return counted.select(key, F.col("w.start").alias("window_start"), "calls")


LATE_ROWS = "key string, event_id long, at timestamp, is_late boolean"


def late_stream(events: DataFrame, seconds: int) -> DataFrame:
    """Streamed events (key, event_id, at) with is_late, as ingest.late_events(): split by it, the late ones are a side table.

    The state of a key is its latest time so far.
    """

    def mark(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest = state.get[0] if state.exists else None
        out = []
        for batch in batches:
            for row in batch.sort_values("event_id").itertuples(index=False):
                out.append((key[0], row.event_id, row.at, latest is not None and row.at < latest - pd.Timedelta(seconds=seconds)))
                latest = row.at if latest is None else max(latest, row.at)
        state.update((latest,))
        yield pd.DataFrame(out, columns=["key", "event_id", "at", "is_late"])

    return events.groupBy("key").applyInPandasWithState(mark, LATE_ROWS, "latest timestamp", "append", GroupStateTimeout.NoTimeout)


def once(jobs: DataFrame, late: str = "1 hour", key: str = "key", at: str = "created_at") -> DataFrame:
    """Jobs without repeats of a key within the watermark."""
    return jobs.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def keep_state(spark: SparkSession) -> None:
    """Let streams of this session hold their state on disk, as the processors below need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def milliseconds(span: str | None) -> int | None:
    """'90 seconds' in milliseconds, as many as pandas reads there."""
    return None if span is None else int(pd.Timedelta(span).total_seconds() * 1000)


VERSION_ROWS = "document_id {key}, number int, hashes array<string>, times array<{arrived}>"


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's arrivals as one row for each of its documents."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).group_by("document_id", use_threads=False).aggregate([("content_hash", "list"), ("arrived", "list")])
        yield from rows.select(["document_id", "content_hash_list", "arrived_list"]).rename_columns(["document_id", "hashes", "times"]).combine_chunks().to_batches()


class Versions(StatefulProcessor):
    """Rows of new versions. State of a document: the number and hash of its last version, forgotten after `ttl` without a change."""

    def __init__(self, ttl: int | None = None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "number int, hash string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # A frame or a row for each arrival would cost more than all else here.
        number, before = self.last.get() or (0, None)
        hashes, times = [], []
        for at, found in sorted((a for row in rows for a in zip(row.times, row.hashes, strict=True)), key=lambda a: (a[0] is None, a[0])):
            if not number and not hashes or found != before:
                hashes.append(found)
                times.append(at)
                before = found
        if hashes:
            self.last.update((number + len(hashes), before))
            yield Row(document_id=key[0], number=number + 1, hashes=hashes, times=times)


def version_stream(arrivals: DataFrame, forget_after: str | None = None) -> DataFrame:
    """A row for each new version of a document (document_id, content_hash, arrived), the same over batches as ingest.versions() over all rows.

    Arrivals go to the state, and versions come back, in one row for a document and batch.

    forget_after: a document without a new version for so long loses its state, and its next arrival is version 1 again.
    """
    kinds = dict(arrivals.dtypes)
    rows = arrivals.select("document_id", "content_hash", "arrived").mapInArrow(packed, "document_id {document_id}, hashes array<{content_hash}>, times array<{arrived}>".format(**kinds))
    out = VERSION_ROWS.format(key=kinds["document_id"], arrived=kinds["arrived"])
    mode = "none" if forget_after is None else "processingTime"
    found = rows.groupBy("document_id").transformWithState(Versions(milliseconds(forget_after)), out, "append", mode)
    found = found.select("document_id", "number", F.posexplode(F.arrays_zip("hashes", "times")).alias("at", "v"))
    return found.select("document_id", (F.col("number") + F.col("at")).alias("version_number"), F.col("v.hashes").alias("content_hash"), F.col("v.times").alias("arrived"))


STEPS = "document_id string, state string, accepted boolean"


class Steps(StatefulProcessor):
    """Each step of a document's state log against its last accepted one.

    With `stalled`, a document that stands in an unfinished state for so many
    milliseconds fails: a row of its own tells so, and its state goes on from there.
    """

    RESTING = ("INDEXED", "FAILED", "DELETED")

    def __init__(self, stalled: int | None = None):
        self.stalled = stalled

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        steps = pd.concat(list(rows)).sort_values("at", kind="stable")["state"].tolist()
        last, accepted = self.last.get()[0] if self.last.exists() else None, []
        for state in steps:
            good = last is None or state in ingest.successors(last)
            accepted.append(good)
            last = state if good else last
        self.last.update((last,))
        if self.stalled is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if last not in self.RESTING:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stalled)
        yield pd.DataFrame({"document_id": [key[0]] * len(steps), "state": steps, "accepted": accepted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.update(("FAILED",))
        yield pd.DataFrame({"document_id": [key[0]], "state": ["FAILED"], "accepted": [True]})


def valid_states(log: DataFrame, stalled_after: str | None = None) -> DataFrame:
    """document_id, state, accepted of each step of a streamed log (document_id, state, at).

    stalled_after: documents that stay in an unfinished state for so long fail.
    """
    mode = "none" if stalled_after is None else "processingTime"
    return log.groupBy("document_id").transformWithStateInPandas(Steps(milliseconds(stalled_after)), STEPS, "append", mode)


def run_available(stream: DataFrame, path: str, checkpoint: str, *, timed: bool = False) -> None:
    """Append what a stream has for now to a Parquet folder, going on where the checkpoint ended.

    timed: the stream has timers or a time to live. It then has work without new
    data for ever, so only batches with data are run; timers that have passed fire in
    the next of those.
    """
    spark = stream.sparkSession
    keep_state(spark)
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle)
    spark.conf.set(idle, "false" if timed else before)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(idle, before)


def sync(changes: DataFrame, checkpoint: str, upsert: Callable[[DataFrame], None], delete: Callable[[DataFrame], None]) -> StreamingQuery:
    """Apply batches of changes (document_id, op, ...): deletes first, then upserts, last change per document.

    A batch that fails is replayed from the checkpoint, so both handlers must give
    the same result when they see a batch again.
    """

    def handle(batch: DataFrame, number: int) -> None:
        last = ingest.latest(batch, ["document_id"], F.desc("seq"))
        delete(last.where("op = 'delete'"))
        upsert(last.where("op = 'upsert'"))

    return changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
