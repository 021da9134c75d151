"""Job streams: live states, stale jobs, and continuous intake into a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cartolith.operators.catalog import TIMED_OUT

STATES = "job_id long, repo_id long, status string, error string"
LATEST = "repo_id long, status string, at timestamp"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = "repo_id long, at long, status string"


def _milliseconds(at: pd.Series) -> pd.Series:
    return pd.to_datetime(at, utc=True).dt.tz_localize(None).astype("datetime64[ms]").astype("int64")


def _newest(frame: pd.DataFrame) -> tuple[int, int, str]:
    """(repository, time in ms, status) of the newest row; of equal times the one that isn't RUNNING counts."""
    ms = _milliseconds(frame["created_at"])
    last = frame.assign(__ms=ms, __run=frame["status"] == "RUNNING").sort_values(["__ms", "__run"], ascending=[True, False]).iloc[-1]
    return int(last["repo_id"]), int(last["__ms"]), str(last["status"])


class _Newest(StatefulProcessor):
    """Keeps the newest event of each key, and drops it when event time has passed it by `keep_ms`."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.event = handle.getValueState("event", _EVENT)

    def take(self, frame: pd.DataFrame) -> tuple[int, int, str] | None:
        """The event of the frame that becomes the key's newest, or None; the state holds it from then on."""
        new = _newest(frame)
        if self.event.exists():
            old = self.event.get()
            if (old[1], old[2] != "RUNNING") > (new[1], new[2] != "RUNNING"):
                return None
        self.event.update(new)
        return new

    def wake_at(self, ms: int, timer_values) -> None:
        """One timer a key: the state lives until it fires."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(ms, timer_values.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


class _StaleJobs(_Newest):
    def __init__(self, timeout_ms: int, keep_ms: int):
        super().__init__(keep_ms)
        self.timeout_ms = timeout_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            if new := self.take(frame):
                self.wake_at(new[1] + (self.timeout_ms if new[2] == "RUNNING" else self.keep_ms), timerValues)
            yield pd.DataFrame({"job_id": frame["job_id"], "repo_id": frame["repo_id"], "status": frame["status"], "error": None})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.event.exists():
            repo, _, status = self.event.get()
            self.event.clear()
            if status == "RUNNING":
                yield pd.DataFrame({"job_id": [key[0]], "repo_id": [repo], "status": ["FAILED"], "error": [TIMED_OUT]})


class _LatestStatus(_Newest):
    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = None
        for frame in rows:
            if new := self.take(frame):
                self.wake_at(new[1] + self.keep_ms, timerValues)
                out = new
        if out:
            yield pd.DataFrame({"repo_id": [out[0]], "status": [out[2]], "at": pd.to_datetime([out[1]], unit="ms", utc=True)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.event.clear()
        yield from ()


def _timed(events: DataFrame, delay: str) -> DataFrame:
    """Events by event time. Timers and states of this kind need the RocksDB store, which the session is set to."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)


def latest_status(events: DataFrame, delay: str = "10 minutes", keep_seconds: int = 30 * 86_400) -> DataFrame:
    """A stream of (repo_id, status, created_at) as each repository's latest status, a row for each change; write it in
    update mode. The state of a repository without events for keep_seconds of event time is dropped."""
    rows = _timed(events.select("repo_id", "status", "created_at"), delay)
    return rows.groupBy("repo_id").transformWithStateInPandas(_LatestStatus(keep_seconds * 1000), LATEST, "update", "eventTime")


def stale_jobs(events: DataFrame, seconds: int, delay: str = "10 minutes", keep_seconds: int = 86_400) -> DataFrame:
    """Job events with a FAILED row for each job still RUNNING `seconds` after it began, by event time.

    events: job_id, repo_id, status, created_at. A job's state is its newest event, so events that come out of order are
    taken in theirs; a timer fails the job, or drops the state of one that has ended keep_seconds before.
    """
    rows = _timed(events.select("job_id", "repo_id", "status", "created_at"), delay)
    return rows.groupBy("job_id").transformWithStateInPandas(_StaleJobs(seconds * 1000, keep_seconds * 1000), STATES, "append", "eventTime")


def intake(spark: SparkSession, folder: str, schema: str, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Rows of new files in a folder, each key once within the watermark."""
    rows = spark.readStream.schema(schema).json(folder)
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def for_each_batch(rows: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs work on every batch until what is there now is done; a restart continues after the last whole batch."""
    return rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_events(spark: SparkSession, path: str) -> DataFrame:
    """Stored job events as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


@dataclass
class KeyedTable:
    """A table with one row a key, into which batches put the keys that it doesn't have; rows that are there stay.

    Give `put` to foreachBatch: a batch lies in a folder of its own, which a second run of it writes anew, and counts once
    the ledger has it. Rows lie in ranges of the keys' hashes, and a batch reads only the ranges of its own keys.
    """

    spark: SparkSession
    root: str
    key: str
    schema: str
    ranges: int = 64

    def _ledger(self) -> DataFrame:
        kind = "batch long, base boolean"
        try:
            return self.spark.read.schema(kind).parquet(f"{self.root}/ledger")
        except AnalysisException:
            return self.spark.createDataFrame([], kind)

    def done(self) -> tuple[int, int]:
        """The batch up to which rows are put together, and the last one; -1 if there is none."""
        row = self._ledger().agg(F.max(F.when(F.col("base"), F.col("batch"))), F.max("batch")).first()
        return (-1 if row[0] is None else row[0]), (-1 if row[1] is None else row[1])

    def _range(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.ranges)).cast("int").alias("range")

    def _stored(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{self.schema}, range int, batch long").parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], f"{self.schema}, range int, batch long")

    def _rows(self) -> DataFrame:
        base, last = self.done()
        return self._stored("base").where(F.col("batch") == base).unionByName(self._stored("rows").where(F.col("batch").between(base + 1, last)))

    def rows(self) -> DataFrame:
        return self._rows().drop("range", "batch")

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.select("*", self._range()).repartition("range").write.mode("overwrite").partitionBy("range").parquet(f"{self.root}/{name}/batch={batch}")

    def _enter(self, batch: int, base: bool) -> None:
        self.spark.createDataFrame([(batch, base)], "batch long, base boolean").coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")

    def put(self, rows: DataFrame, batch: int) -> None:
        """Of several rows with one key the least one counts."""
        if batch <= self.done()[1]:
            return
        columns = [c for c in rows.columns if c != self.key]
        new = rows.groupBy(self.key).agg(F.min(F.struct(*columns)).alias("r")).select(self.key, "r.*").select(*rows.columns)
        touched = [r[0] for r in new.select(self._range()).distinct().collect()]  # numbers below self.ranges
        there = self._rows().where(F.col("range").isin(touched)).select(self.key)
        self._write(new.join(there.hint("merge"), self.key, "left_anti"), "rows", batch)
        self._enter(batch, False)

    def compact(self) -> None:
        """All rows in one folder; batches up to now aren't read from then on."""
        _, last = self.done()
        if last >= 0:
            self._write(self.rows(), "base", last)
            self._enter(last, True)
