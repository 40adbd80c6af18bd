import math

import numpy as np
import pytest
from loamline.functions import decisions as d
from loamline.operators import metrics as m
from loamline.plans import evaluation
from pyspark.sql import functions as F

PROBS = "y int, probs array<double>"
SIX = [(0, [0.45, 0.2, 0.15, 0.2]), (0, [0.2, 0.1, 0.1, 0.6]), (1, [0.25, 0.30, 0.2, 0.25]), (2, [0.25, 0.2, 0.30, 0.25]), (3, [0.45, 0.2, 0.15, 0.2]), (3, [0.1, 0.05, 0.05, 0.8])]


def _rows(spark, rows):
    return spark.createDataFrame(rows, PROBS).withColumns({"pred": d.argmax(F.col("probs")), "conf": F.array_max("probs")})


def test_operating_point_of_six_rows(spark):
    r = m.operating_point(_rows(spark, SIX), [0.5]).first()
    assert (r.n_toxic, r.n_miss, r.n_alert, r.n_surfaced, r.n_false_alarm, r.n_false_surfaced, r.n_right, r.n) == (4, 1, 1, 2, 1, 1, 4, 6)
    s = m.summary(_rows(spark, SIX), 4).first()
    assert s.accuracy == round(4 / 6, 6) and s.toxic_recall == 0.75


def test_safety_metrics_and_empty_sides(spark):
    r = {x.threshold: x for x in m.safety_metrics(_rows(spark, SIX), [0.3, 0.4]).collect()}
    assert (r[0.4].toxic_recall, r[0.4].toxic_to_safe_hard, r[0.4].toxic_below_thr, r[0.4].safe_false_alarm) == (0.25, 0.25, 0.5, 0.5)
    assert (r[0.3].toxic_recall, r[0.3].toxic_miss_total) == (0.75, 0.25)
    only_safe = m.safety_metrics(_rows(spark, SIX[4:]), [0.3]).first()
    assert math.isnan(only_safe.toxic_recall) and only_safe.safe_false_alarm == 0.5
    assert math.isnan(m.summary(_rows(spark, SIX[4:]), 4).first().toxic_recall)


def test_nothing_to_divide_by_is_zero(spark):
    r = {x.cls: x for x in m.precision_recall(_rows(spark, SIX[:2]), 4).collect()}
    assert (r[1].prec, r[1].rec, r[1].f1) == (0.0, 0.0, 0.0) and r[0].rec == 0.5


def test_bins_with_edges_and_empty_ones(spark):
    rows = [(0, [x, 1 - x, 0.0, 0.0]) for x in (0.0, 0.3, 1.0)]
    df = spark.createDataFrame(rows, PROBS).withColumns({"pred": F.lit(0), "conf": F.col("probs")[0]})
    bins = m.calibration_bins(df).orderBy("bin").collect()
    assert [b.n for b in bins] == [1, 0, 1, 0, 0, 0, 0, 0, 0, 1] and bins[1].mean_conf is None and bins[1].gap is None
    own = {r.cls: r for r in m.per_class_calibration(df, 4).collect()}
    assert own[1].n_predicted == 0 and own[1].ece is None and own[0].ece == pytest.approx(1.7 / 3, abs=1e-6)


def test_class_weights_have_mean_one_and_need_rows(spark):
    counts = spark.createDataFrame([("a", 10), ("b", 30)], "cls string, n long")
    assert {r.cls: r.weight for r in m.class_weights(counts, ["a", "b"]).collect()} == {"a": 1.5, "b": 0.5}
    with pytest.raises(ValueError, match="no rows for"):
        m.class_weights(counts, ["a", "b", "c"])


def test_auroc_by_ranges(spark):
    rng = np.random.default_rng(1)
    s, p = rng.integers(0, 400, 3000).astype(float), rng.random(3000) < 0.3
    s[p] += rng.integers(0, 90, p.sum())
    want = np.mean([(s[p][:, None] > s[~p]).mean() + (s[p][:, None] == s[~p]).mean() / 2])
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, p, strict=True)], "s double, p boolean")
    for ranges in (1, 7, 200):
        assert m.auroc(df, F.col("s"), F.col("p"), ranges).first().auroc == pytest.approx(want, abs=1e-6)
    tied = m.auroc(df.select(F.lit(1.0).alias("s"), "p"), F.col("s"), F.col("p")).first()
    assert tied.auroc == 0.5 and math.isnan(m.auroc(df.filter("p"), F.col("s"), F.col("p")).first().auroc)


def test_app_rule_on_ties(spark):
    df = spark.createDataFrame([([0.4, 0.1, 0.1, 0.4],), ([0.3, 0.1, 0.1, 0.5],), ([0.45, 0.1, 0.1, 0.35],)], "p array<double>")
    got = df.select(d.app_severity(F.col("p")).alias("s"), d.emitted(F.col("p")).alias("e")).collect()
    assert [(r.s, r.e) for r in got] == [("alert", False), ("ignore", False), ("alert", True)]


def test_temperature_is_a_minimum(spark):
    r = evaluation.temperature_fit(spark, "/root/testdata/sf0.001").first()
    rows = evaluation.predictions(spark, "/root/testdata/sf0.001").select("label", "z").collect()
    z, y = np.array([x.z for x in rows]), np.array([x.label for x in rows])

    def nll(t):
        e = z / t - (z / t).max(1, keepdims=True)
        return (np.log(np.exp(e).sum(1)) - e[np.arange(len(y)), y]).mean()

    assert r.nll_before == pytest.approx(nll(1), abs=1e-5) and r.nll_after == pytest.approx(nll(r.temperature), abs=1e-5)
    assert r.nll_after <= r.nll_before and all(nll(r.temperature * f) >= nll(r.temperature) - 1e-9 for f in (0.98, 1.02))
