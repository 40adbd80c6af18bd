"""Scans in segments against plain walks, with one user holding a third of all rows, and in several tasks."""

import random

import numpy as np
import pytest
from loamline.operators import segments, series
from pyspark.sql import functions as F

SCHEMA = "event_id long, user_id long, t long, value double, kind string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = [(i, 1 if i % 3 == 0 else rng.randrange(2, 40), rng.randrange(0, 5_000), round(rng.gauss(0, 10), 2), rng.choice("abc")) for i in range(3_000)]
    out += [(4_000 + i, None, rng.randrange(0, 5_000), 1.0, "a") for i in range(50)] + [(5_000, 99, 7, 3.0, "b")]
    return out


@pytest.fixture
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


def by_user(rows):
    users = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        users.setdefault(r[1], []).append(r)
    return users


@pytest.mark.parametrize(("n", "batch"), [(1, 10_000), (9, 50), (64, 3)])
def test_ema_and_refractory(spark, df, rows, n, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        means = {r.event_id: r.ema for r in series.ema(df, "user_id", ["t", "event_id"], "value", 0.35, segments=n).collect()}
        seeded = {r.event_id: r.ema for r in series.ema(df, "user_id", ["t", "event_id"], "value", 0.033, seed=1.0, segments=n).collect()}
        picked = {r.event_id for r in series.refractory(df, "user_id", ["t", "event_id"], "t", 37, segments=n).filter("picked = 1").collect()}
        fired = {r.event_id for r in series.apexes(df, "user_id", ["t", "event_id"], "t", "value", 0.6, 2.0, 25, segments=n).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    picks, peaks, step = set(), set(), series.apex_step(0.6, 2.0, 25)
    for own in by_user(rows).values():
        s, z, last, state = None, 1.0, None, (None, 0.0, None)
        for e, _, t, x, _ in own:
            s, z = (x if s is None else 0.35 * x + 0.65 * s), 0.033 * x + 0.967 * z
            assert means[e] == pytest.approx(s, abs=1e-9) and seeded[e] == pytest.approx(z, abs=1e-9)
            if last is None or t - last >= 37:
                picks.add(e)
                last = t
            state, fire = step(state, t, x)
            if fire:
                peaks.add(e)
    assert picked == picks and fired == peaks


def test_a_hot_user_lies_in_several_tasks(spark, df):
    found = segments.scan(df, "user_id", ["t", "event_id"], "value", segments.Ema(0.5), ["a", "b", "c"], 32)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = found.filter("user_id = 1").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1
    assert found.count() == df.count() and found.columns == [*df.columns, "a", "b", "c"]


def test_flat_series_and_bad_waits(spark):
    flat = spark.createDataFrame([(i, 1, i, 0.1, "a") for i in range(500)], SCHEMA)
    assert {r.ema for r in series.ema(flat, "user_id", ["t"], "value", 0.3).collect()} == {0.1}
    with pytest.raises(ValueError, match="positive"):
        series.refractory(flat, "user_id", ["t"], "t", 0)
    assert series.ema(flat.limit(0), "user_id", ["t"], "value", 0.3).count() == 0


@pytest.mark.parametrize("n", [1, 7, 64])
def test_lagged_and_last_before(df, rows, n):
    lag = {r.event_id: (r.a, r.b, r.c) for r in segments.lagged(df, "user_id", ["t", "event_id"], "value", ["a", "b", "c"], n).collect()}
    seen = {r.event_id: (r.prev_event_id, r.prev_value) for r in series.as_of(df, "user_id", "t", F.col("kind") == "a", F.col("kind") == "b", ["event_id", "value"], segments=n).collect()}
    near = {r.event_id: (r.near_id, r.near_gap) for r in series.nearest(df, "user_id", "t", F.col("kind") == "a", F.col("kind") == "c", segments=n).collect()}
    for user, own in by_user(rows).items():
        for i, (e, _, t, _, kind) in enumerate(own):
            past = [r[3] for r in reversed(own[max(0, i - 3) : i])]
            assert lag[e] == tuple(past + [None] * (3 - len(past)))
            if kind == "a" and user is not None:
                b = max(((r[2], r[0], r[3]) for r in own if r[4] == "b" and r[2] <= t), default=(None,) * 3)
                assert seen[e] == b[1:]
                before = max(((r[2], r[0]) for r in own[:i] if r[4] == "c"), default=None)
                after = min(((r[2], r[0]) for r in own[i + 1 :] if r[4] == "c"), default=None)
                best = before if before and (not after or t - before[0] <= after[0] - t) else after
                assert near[e] == ((best[1], abs(best[0] - t)) if best else (None, None))


@pytest.mark.parametrize("width", [1, 7, 8, 99, 100])
def test_framed_rms(df, rows, width):
    wide = F.when(F.col("user_id") == 1, width).otherwise(3)
    got = {r.event_id: r.rms for r in series.framed_rms(df, "user_id", "t", ["event_id"], "value", wide).collect()}
    for user, own in by_user(rows).items():
        w, x = (width if user == 1 else 3), np.array([r[3] for r in own])
        # Zeros around a series make the frame of a row the same however short the series is.
        whole = np.convolve(np.pad(x * x, 200), np.ones(w) / w, mode="same")[200 : 200 + len(x)]
        assert [got[r[0]] for r in own] == pytest.approx(np.sqrt(np.maximum(whole, 0)).tolist(), abs=1e-3)


@pytest.mark.parametrize("cuts", [False, True])
def test_small_keys_are_one_segment(spark, df, rows, monkeypatch, cuts):
    """Only user 1 has more than a share of the rows; others make one run each, however many segments there are."""
    parts, several = segments.cut(df, "user_id", "t", 8)
    assert several and {r.user_id for r in parts.filter("_part >= 0").select("user_id").distinct().collect()} == {1}
    assert parts.count() == len(rows)
    small = df.filter("user_id > 1 OR user_id IS NULL")
    if cuts:
        monkeypatch.setattr(segments.ranks, "MOST_ROWS", 30)
    parts, several = segments.cut(small, "user_id", "t", 8)
    assert several == cuts and (parts.select("user_id", "_part").distinct().count() == parts.select("user_id").distinct().count()) != cuts
    got = {r.event_id: r.ema for r in series.ema(small, "user_id", ["t", "event_id"], "value", 0.35, segments=8).collect()}
    lag = {r.event_id: (r.a, r.b) for r in segments.lagged(small, "user_id", ["t", "event_id"], "value", ["a", "b"], 8).collect()}
    for user, own in by_user(rows).items():
        s, past = None, [None, None]
        for e, _, _, x, _ in own if user != 1 else []:
            s = x if s is None else 0.35 * x + 0.65 * s
            assert got[e] == pytest.approx(s, abs=1e-9) and lag[e] == tuple(past)
            past = [x, past[0]]
