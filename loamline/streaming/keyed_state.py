"""Streams that go on where they stopped: a ledger of accepted names as a log, and sessions, held in RocksDB until they are over."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession):
    """States of queries that start within are kept in RocksDB, on disk, not in the executors' heaps."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_to_end(rows: DataFrame, folder: str) -> None:
    """Append the stream's rows to ``folder`` as Parquet until nothing new is there; the same folder goes on where it stopped."""
    with rocks_state(rows.sparkSession):
        query = rows.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    if error := query.exception():
        raise error


def accept_once(named: DataFrame, folder: str) -> DataFrame:
    """(filename, doc_id, last_id) of a stream ``named(filename, doc_id)``: a name's first row is accepted, the last one's image replaces it.

    Of the rows of one batch the smallest id comes first and the largest last. A batch is
    summed up by name and appended to ``folder`` as a log with the batch's number as its version, a
    row for each of its names; a batch that is run again replaces its own rows. So a batch
    costs no more than its rows, whatever was accepted before, and a run over the same folder
    goes on where the last one stopped. The ledger is what the log says of each name.
    """

    def log(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy("filename").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last_id"))
        rows.withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    query = named.writeStream.foreachBatch(log).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    if error := query.exception():
        raise error
    versions = named.sparkSession.read.schema("filename string, doc_id long, last_id long, version long").parquet(folder)
    return versions.groupBy("filename").agg(F.min_by("doc_id", "version").alias("doc_id"), F.max_by("last_id", "version").alias("last_id"))


class _Sessions(StatefulProcessor):
    """Sessions of a key that may still grow, as (start, end, rows); those before the watermark are dropped."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "t0 bigint, t1 bigint, n bigint")
        self.batches = handle.getValueState("batches", "n bigint")
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        times = sorted(t for part in rows for t in part["t"].tolist())
        held = sorted(tuple(x) for x in self.open.get()) if self.open.exists() else []
        merged: list[list[int]] = []
        # Events and open sessions in order of their start: what begins within the gap after the last end goes on with it.
        for t0, t1, n in sorted([*held, *((t, t, 1) for t in times)]):
            if merged and t0 - merged[-1][1] < self.gap:
                merged[-1] = [merged[-1][0], max(merged[-1][1], t1), merged[-1][2] + n]
            else:
                merged.append([t0, t1, n])
        version = (self.batches.get()[0] if self.batches.exists() else 0) + 1
        self.batches.update((version,))
        before, now = set(held), {tuple(m) for m in merged}
        changed = sorted(now - before)
        gone = sorted({t0 for t0, _, _ in before} - {t0 for t0, _, _ in now})
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        kept = [tuple(m) for m in merged if m[1] + self.gap > watermark]
        if kept:
            self.open.put(kept)
            self.handle.registerTimer(max(k[1] for k in kept) // 1000 + self.gap // 1000 + 1)
        else:
            self.open.clear()
        rows_out = [(key[0], t0, t1, n, version) for t0, t1, n in changed] + [(key[0], t0, t0, 0, version) for t0 in gone]
        yield pd.DataFrame(rows_out, columns=["user_id", "t0", "t1", "n", "version"]).astype({"t0": "int64", "t1": "int64", "n": "int64", "version": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        kept = [tuple(x) for x in self.open.get() if x[1] + self.gap > watermark] if self.open.exists() else []
        if kept:
            self.open.put(kept)
        else:
            self.open.clear()
            self.batches.clear()
        yield pd.DataFrame({"user_id": pd.Series(dtype="int64"), "t0": pd.Series(dtype="int64"), "t1": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "version": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def sessions(events: DataFrame, gap: int, folder: str, delay: str = "1 hour") -> DataFrame:
    """(user_id, n, t0, t1) of runs of a user's events with less than ``gap`` microseconds between neighbours.

    ``events(user_id, t, at)`` is a stream. A session is held until the watermark, ``delay``
    behind the latest event, has left it by more than the gap; later rows that would have
    belonged to it are then a session of their own. Each batch appends the sessions that it changed
    with a version, and one without rows for a start that a merge took away; the last version counts.
    """
    out = "user_id long, t0 long, t1 long, n long, version long"
    keyed = events.withWatermark("at", delay).groupBy("user_id")
    run_to_end(keyed.transformWithStateInPandas(_Sessions(gap), out, "Append", "EventTime"), folder)
    versions = events.sparkSession.read.schema(out).parquet(folder)
    last = versions.groupBy("user_id", "t0").agg(F.max_by(F.struct("t1", "n"), "version").alias("s"))
    return last.filter("s.n > 0").select("user_id", "s.n", "t0", "s.t1")
