import pytest
from loamline.functions import decisions as d
from loamline.functions import feedback as fb
from pyspark.sql import functions as F


def _one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_severity_and_thresholds(spark):
    rows = [([0.45, 0.3, 0.05, 0.2],), ([0.30, 0.25, 0.2, 0.25],), ([0.55, 0.2, 0.05, 0.2],), ([0.1, 0.2, 0.45, 0.25],), ([0.24, 0.22, 0.30, 0.24],), ([0.05, 0.03, 0.02, 0.9],)]
    assert _one(spark, rows, "probs array<double>", d.decide(F.col("probs"))) == ["alert", "uncertain", "alert", "uncertain", "ignore", "safe"]
    assert _one(spark, [(0,), (2,), (7,)], "c int", d.alert_threshold(F.col("c"), 0.6)) == pytest.approx([0.5, 0.62, 0.6])
    assert _one(spark, [(0,)], "c int", d.alert_threshold(F.col("c"), 0.0)) == [0.15]
    assert _one(spark, [(0.74,), (0.75,), (0.90,)], "c double", d.alert_level(F.col("c"))) == ["low", "medium", "high"]


def test_ties_and_measures(spark):
    assert _one(spark, [([0.4, 0.1, 0.1, 0.4],)], "p array<double>", d.argmax(F.col("p"))) == [0]
    rows = [([0.5, 0.5, 0.0, 0.0],), ([0.45, 0.05, 0.0, 0.5],)]
    assert _one(spark, rows, "p array<double>", 1 - d.margin(F.col("p"))) == pytest.approx([1.0, 0.95])
    assert _one(spark, rows, "p array<double>", d.safety_score(F.col("p"))) == pytest.approx([0.15, 0.925])


def test_confidence(spark):
    raw = [None, "x", "nan", "inf", "-0.2", "0.7", "1.0", "70", "150"]
    assert _one(spark, [(r,) for r in raw], "r string", fb.normalize_confidence(F.col("r"))) == [None, None, None, None, 0.0, 0.7, 1.0, 0.7, 1.0]


def test_priorities(spark):
    rows = [("corrected", 0.9, "safe_plants", "poison_ivy"), ("corrected", 0.9, "poison_ivy", "safe_plants"), ("confirmed", 0.9, "poison_oak", "poison_oak"), ("confirmed", None, "poison_oak", "poison_oak"), ("corrected", 0.5, "fern", "poison_oak")]
    c = [F.col(x) for x in ("s", "c", "o", "l")]
    p = fb.priority(c[0], c[1], fb.contradiction(c[2], c[3]), c[3])
    assert _one(spark, rows, "s string, c double, o string, l string", p) == pytest.approx([3.15, 2.4, 0.4, 0.8, 1.75])


def test_gate(spark):
    rows = [("poison_ivy", "safe_plants", 0.69), ("poison_ivy", "safe_plants", 0.70), ("poison_ivy", "safe_plants", None), ("fern", "safe_plants", 0.1), ("fern", "poison_ivy", 0.1), ("safe_plants", "poison_oak", 0.99)]
    g = fb.gate(fb.contradiction(F.col("o"), F.col("l")), F.col("l"), F.col("c"))
    assert _one(spark, rows, "o string, l string, c double", g) == [False, True, True, True, False, False]


def test_names(spark):
    assert _one(spark, [("a b/c.jpg",), ("",), ("ok-1_2.x",)], "n string", fb.sanitize_stem(F.col("n"))) == ["a_b_c.jpg", "unnamed", "ok-1_2.x"]
