"""Exact percentiles against numpy, with rounds forced by a small bound."""

import random

import numpy as np
import pytest
from loamline.operators.selection import percentiles

SHARES = {"p0": 0.0, "p5": 0.05, "median": 0.5, "p95": 0.95, "p995": 0.995, "p100": 1.0}


def plain(groups):
    return sorted(((k, *(round(float(np.percentile(v, 100 * q)), 6) for q in SHARES.values())) for k, v in groups.items() if v), key=str)


@pytest.mark.parametrize(("small", "pivots"), [(4, 3), (30, 5), (100_000, 48)])
def test_equals_numpy(spark, small, pivots):
    rng = random.Random(1)
    groups = {
        "normal": [rng.gauss(0, 1e6) for _ in range(400)],
        "ties": [5.0] * 200 + [5.1] * 150 + [-1.0],
        "one": [3.0],
        "same": [2.0] * 90,
        None: [float(i % 7) for i in range(100)],
        "few": [1.0, 2.0, 4.0],
        "tail": [1e300, -1e300] + [float(2**i) for i in range(60)],
    }
    rows = [(k, x) for k, v in groups.items() for x in v] + [("normal", None), ("nulls", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = percentiles(df, ["k"], "x", SHARES, small, pivots)
    assert sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in got.select("k", *SHARES).collect()), key=str) == plain(groups)


@pytest.mark.parametrize("small", [3, 1000])
def test_whole_table(spark, small):
    df = spark.range(101).selectExpr("CAST(id AS INT) AS x")
    assert [tuple(r) for r in percentiles(df, [], "x", {"a": 0.5, "b": 0.905}, small, 4).collect()] == [(50.0, 90.5)]
    assert [tuple(r) for r in percentiles(df.filter("x < 0"), [], "x", {"a": 0.5}, small).collect()] == [(None,)]
    assert percentiles(df.filter("x < 0").withColumn("k", df.x), ["k"], "x", {"a": 0.5}, small).count() == 0
