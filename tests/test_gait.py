import math

import numpy as np
import pytest
from loamline.functions.details import token
from loamline.operators import series
from loamline.plans import gait
from loamline.sources.tables import events
from loamline.streaming import event_streams
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

SF = "/root/testdata/sf0.001"


def _fires(spark, t, x, alpha, floor, wait):
    df = spark.createDataFrame([("u", float(a), float(b)) for a, b in zip(t, x, strict=True)], "u string, t double, x double")
    return sorted(r.t for r in series.apexes(df, "u", ["t"], "t", "x", alpha, floor, wait).collect())


def test_one_apex_for_each_stride(spark):
    t = np.arange(0, 4, 0.01)
    fires = _fires(spark, t, 0.3 * np.sin(2 * np.pi * 2 * t), 1.0, 0.05, 0.25)
    assert len(fires) == 8 and all(abs(f * 2 % 1 - 0.25) < 0.04 for f in fires)
    assert _fires(spark, t, np.random.default_rng(0).normal(0, 0.01, len(t)), 0.35, 0.05, 0.25) == []
    assert len(_fires(spark, np.arange(9) * 0.02, [0, 0.1, 0.2, 0.1, 0, 0.1, 0.2, 0.1, 0], 1.0, 0.05, 0.25)) == 1


def test_cadence_of_a_walk(spark):
    rng, t = np.random.default_rng(0), np.arange(0, 40, 0.01)
    x = 0.25 * np.sin(2 * np.pi * 1.8 * t) + rng.normal(0, 0.01, len(t))
    for k in range(1, 72):
        x -= 0.6 * np.exp(-(((t - k / 1.8 + 0.139) / 0.02) ** 2))
    fires = _fires(spark, t, x, 0.35, 0.05, 0.25)
    assert abs(60 / np.median(np.diff(fires)) - 108) < 6


def test_last_token_wins(spark):
    rows = [("a=1 a=2 junk b=x=y",), ("junk",), (None,), ("b=",)]
    got = spark.createDataFrame(rows, "d string").select(token(F.col("d"), "a").alias("a"), token(F.col("d"), "b").alias("b")).collect()
    assert [tuple(r) for r in got] == [("2", "x=y"), (None, None), (None, None), (None, "")]


def test_signs(spark, tmp_path):
    draws = np.random.default_rng(1).exponential(80, 200)
    source = spark.read.parquet(f"{SF}/events.parquet")
    rows = [(i, u, "view", float(gait.CENTRE + s * v)) for u, s in ((1, 1.0), (2, -1.0), (3, 0.0)) for i, v in enumerate(draws)] + [(0, 4, "view", 1.0)]
    # A long rest with one sharp impact against the sign, which isn't active and doesn't count.
    rows += [(1_000 + i, u, "view", float(gait.CENTRE - s * (100 if i == 200 else 0))) for u, s in ((1, 1.0), (2, -1.0)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    df = df.withColumns({c: F.lit(None).cast(source.schema[c].dataType) for c in source.columns if c not in df.columns}).withColumn("ts", F.expr("TIMESTAMP_NTZ'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(6 * event_id AS int))"))
    df.select(*source.columns).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r for r in gait.sign_report(spark, str(tmp_path)).collect()}
    assert [got[u].verdict for u in (1, 2, 3, 4)] == ["inverted", "consistent", "inconclusive", "inconclusive"]
    assert math.isnan(got[3].skew) and math.isnan(got[4].skew) and got[1].skew == pytest.approx(-got[2].skew)


def test_motion_over_batches_equals_the_batch(spark, tmp_path, monkeypatch):
    source = spark.read.parquet(f"{SF}/events.parquet")
    ts = sorted(r[0] for r in source.select("ts").collect())
    cuts = [ts[len(ts) // 3], ts[2 * len(ts) // 3]]
    for part in (source.filter(source.ts < cuts[0]), source.filter((source.ts >= cuts[0]) & (source.ts < cuts[1])), source.filter(source.ts >= cuts[1])):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    whole = DataStreamReader.parquet
    monkeypatch.setattr(DataStreamReader, "parquet", lambda self, *a, **b: whole(self.option("maxFilesPerTrigger", 1), *a, **b))
    got = event_streams.stream_motion(spark, str(tmp_path)).collect()
    assert len(got) == events(spark, SF).count()
    assert {(r.event_id, r.user_id) for r in got if r.fired} == {(r.event_id, r.user_id) for r in gait.apex_times(spark, SF).collect()}
    assert 0 < sum(r.still for r in got) < len(got)


def test_missing_columns_are_named(spark):
    from loamline.sources.tables import require_columns

    with pytest.raises(ValueError, match="missing columns: gravity_z, roll"):
        require_columns(spark.range(1).withColumnRenamed("id", "timestamp_s"), ["timestamp_s", "gravity_z", "roll"])
