"""Structured Streaming counterparts over the event stream: sessions and alerts with a cooldown."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.operators.series import ordered_fold
from loamline.sources.tables import micros
from loamline.streaming.keyed_state import sessions


def shared(spark: SparkSession, purpose: str) -> str:
    """A new folder in ``spark.checkpoint.dir``, or, on one machine, below the warehouse where that is unset."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_streams"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Files of a table that make a batch of a stream.
BATCH_FILES = 200


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of files, with ``t`` in microseconds and ``at`` as a time stamp."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern matches the table whether it is one file or a folder of files.
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", BATCH_FILES).parquet(f"{sf_dir}/events.parque[t]")
    timed = rows.withColumn("t", micros(F.col("ts")))
    return timed.withColumn("at", F.timestamp_micros("t"))


def carried(stream: DataFrame, purpose: str, state: list[str], walk) -> DataFrame:
    """Rows that ``walk`` makes of each batch of ``stream(user_id, t, event_id, ...)`` and of the users' last states.

    ``walk(rows)`` gets the batch with ``fresh`` = 1 and, with ``fresh`` = 0, a row for
    each user of an earlier batch that holds the columns ``state``; it returns the fresh
    rows with those columns. Each user's last row is written to the shared folder for the
    next batch, so a batch that is run again finds what it found before. What is there is
    read to its end. Rows that come in a later batch than others of later time are walked
    through after them.
    """
    spark = stream.sparkSession
    out = shared(spark, purpose)
    fields = ", ".join(f"{c} double" for c in state)

    def one(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        last = own.read.schema(f"user_id long, t long, {fields}").parquet(f"{out}-last/{number - 1}") if number else None
        rows = batch.withColumn("fresh", F.lit(1)).withColumns({f"old_{c}": F.lit(None).cast("double") for c in state})
        if last is not None:
            rows = rows.unionByName(last.select("user_id", "t", F.lit(0).alias("fresh"), *(F.col(c).alias(f"old_{c}") for c in state)), allowMissingColumns=True)
        walk(rows).filter("fresh = 1").drop("fresh", *(f"old_{c}" for c in state)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        done = own.read.schema(f"event_id long, user_id long, t long, {fields}").parquet(f"{out}/batch={number}")
        newest = done.groupBy("user_id").agg(F.max_by(F.struct("t", *state), F.struct("t", "event_id")).alias("s"), F.lit(1).alias("newer")).select("user_id", "newer", "s.*")
        both = newest if last is None else newest.unionByName(last.withColumn("newer", F.lit(0)))
        kept = both.groupBy("user_id").agg(F.max_by(F.struct("t", *state), "newer").alias("s")).select("user_id", "s.*")
        kept.write.mode("overwrite").parquet(f"{out}-last/{number}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch", *state)


def stream_motion(spark: SparkSession, sf_dir: str, alpha: float = 0.6, floor: float = 5.0, wait: int = 6 * 3_600_000_000, still_alpha: float = 0.05, still_bound: float = 35.0) -> DataFrame:
    """Each event of the stream with whether a peak has just been passed, and whether the user is still.

    The peak detector is the batch query's; the stillness filter is a slow mean of absolute
    values that starts high, so that nobody counts as still at first.
    """
    from loamline.operators.series import apex_step
    from loamline.plans.gait import CENTRE, STILL_SEED

    peak, state = apex_step(alpha, floor, wait), ["smoothed", "change", "last_fire", "motion"]

    def step(held, fresh, t, x, *old):
        if not fresh:
            return old, (*old, 0.0, 0.0)
        (smoothed, change, last), fired = peak(held[:3], t, x)
        motion = still_alpha * abs(x) + (1 - still_alpha) * held[3]
        # A time in microseconds is below 2^53, so a double holds it.
        return (smoothed, change, last, motion), (smoothed, change, last, motion, fired, float(motion < still_bound))

    def walk(rows: DataFrame) -> DataFrame:
        values = ["fresh", "t", "down", *(f"old_{c}" for c in state)]
        return ordered_fold(rows, "user_id", ["fresh", "t", "event_id"], values, [*state, "fired", "still"], lambda: (None, 0.0, None, STILL_SEED), step)

    s = event_stream(spark, sf_dir).select("event_id", "user_id", "t", (F.col("value") - CENTRE).alias("down"))
    m = carried(s, "motion", state, walk)
    return m.select("event_id", "user_id", (F.col("fired") == 1).alias("fired"), (F.col("still") == 1).alias("still"))


def stream_sessions(spark: SparkSession, sf_dir: str, gap: int = 24 * 3_600_000_000) -> DataFrame:
    """Runs of a user's events with less than a day between neighbours; what is there is read to its end."""
    return sessions(event_stream(spark, sf_dir).select("user_id", "t", "at"), gap, shared(spark, "sessions"))


def stream_rates(spark: SparkSession, sf_dir: str, width: int = 3_600_000_000) -> DataFrame:
    """Events in each window of ``width`` microseconds, windows not overlapping, and the latest event of each.

    Each batch writes what its rows add to their windows; these parts are summed when they
    are read, so no window is kept as state and late rows count too.
    """
    out = shared(spark, "rates")
    latest = lambda: F.max(F.struct("t", "event_id")).alias("latest")

    def part(batch: DataFrame, number: int) -> None:
        g = batch.groupBy(F.floor(F.col("t") / width).alias("slot")).agg(F.count("*").alias("n"), latest())
        g.select("slot", "n", "latest.*").write.mode("overwrite").parquet(f"{out}/batch={number}")

    s = event_stream(spark, sf_dir).select("t", "event_id")
    s.writeStream.foreachBatch(part).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.schema("slot long, n long, t long, event_id long").parquet(out)
    return parts.groupBy("slot").agg(F.sum("n").alias("n"), latest()).select("slot", "n", F.col("latest.event_id").alias("latest_id"))


def stream_alerts(spark: SparkSession, sf_dir: str, wait: int = 6 * 3_600_000_000) -> DataFrame:
    """Events that fire: at least ``wait`` microseconds after the user's last one that fired.

    A batch is sorted and walked through by an ordered fold, which holds one user's state;
    each user's last time goes from batch to batch through the shared folder.
    """
    out = shared(spark, "alerts")

    def step(last, fresh, t):
        fire = bool(fresh) and (last is None or t - last >= wait)
        return (t if fire or not fresh else last), float(fire)

    def fire(batch: DataFrame, number: int) -> None:
        read = batch.sparkSession.read
        rows = batch.select(F.col("event_id").cast("long"), F.col("user_id").cast("long"), "t", F.lit(1).alias("fresh"))
        last = read.schema("user_id long, t long").parquet(f"{out}-last/{number - 1}") if number else None
        if last is not None:
            rows = rows.union(last.select(F.lit(None).cast("long"), "user_id", "t", F.lit(0)))
        picked = ordered_fold(rows, "user_id", ["fresh", "t", "event_id"], ["fresh", "t"], "picked", lambda: None, step).filter("picked = 1")
        picked.select("event_id", "user_id", "t").write.mode("overwrite").parquet(f"{out}/batch={number}")
        times = read.schema("user_id long, t long").parquet(f"{out}/batch={number}")
        times = times if last is None else times.union(last)
        times.groupBy("user_id").agg(F.max("t").alias("t")).write.mode("overwrite").parquet(f"{out}-last/{number}")

    picks = event_stream(spark, sf_dir).select("event_id", "user_id", "t")
    picks.writeStream.foreachBatch(fire).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, user_id long, t long").parquet(out).select("event_id", "user_id", "t")
