"""Small rules of the app, and errors of arguments and classes."""

import pytest
from loamline.functions import app
from loamline.functions import decisions as d
from loamline.plans.app import assert_classes
from pyspark.sql import functions as F


def _one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_frames_boxes_and_settings(spark):
    rows = [("forced", 9.0), ("apogee", 1.0), ("apogee", 1.1), (None, 2.0), ("apogee", None)]
    assert _one(spark, rows, "t string, r double", app.frame_passes(F.col("t"), F.col("r"), 1.0)) == [True, True, False, False, True]
    assert _one(spark, [(3.0, 4.0, 12.0)], "x double, y double, z double", app.magnitude(*map(F.col, "xyz"))) == [13.0]
    assert _one(spark, [(0.1,), (0.5,), (0.95,)], "s double", app.healed(F.col("s"))) == [0.3, 0.5, 0.8]
    boxes = [(0.1, 0.5, 0.2, 0.25), (-0.1, 0.9, 0.2, 0.3), (1.5, 0.0, 0.2, 0.2), (0.0, 0.0, 1.0, 1.0)]
    got = _one(spark, boxes, "x double, y double, w double, h double", app.view_box(*map(F.col, "xywh"), 100.0, 200.0))
    assert [tuple(round(v, 6) for v in b) for b in got] == [(6.0, 46.0, 28.0, 58.0), (0.0, 0.0, 14.0, 24.0), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 100.0, 200.0)]


def test_guard(spark):
    rows = [(3, 0.9), (0, 1.01), (0, 1.0), (1, 0.45), (1, 0.1)]
    found = app.guarded_severity(F.col("c"), 3, F.col("p"), d.alert_threshold(F.col("c"), 0.6))
    assert _one(spark, rows, "c int, p double", found) == ["ignore", "ignore", "alert", "uncertain", "ignore"]


def test_errors(spark):
    for bad in ({"window": 0.0}, {"w_boundary": -0.1}, {"w_boundary": 0.0, "w_threshold": 0.0}):
        with pytest.raises(ValueError, match="window"):
            d.safety_score(F.col("p"), **bad)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "cls string, n int")
    assert assert_classes(rows, "cls", ("a", "b")).count() == 2
    with pytest.raises(Exception, match="the classes are a,b"):
        assert_classes(rows, "cls", ("a", "b", "c")).collect()
