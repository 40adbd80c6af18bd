"""Probes on folds: stratified folds, fits at their optimum, and predictions equal to a plain fit's."""

import numpy as np
from loamline.operators import probe
from pyspark.sql import functions as F

D, K, FOLDS = 3, 3, 4


def _plain(x, y, steps=6_000):
    """Descent with momentum on the whole training rows."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, v, own = np.zeros((D + 1, K)), np.zeros((D + 1, K)), np.eye(K)[y]
    penal = np.append(np.ones(D), 0.0)[:, None]
    for _ in range(steps):
        z = np.exp(x @ w - (x @ w).max(axis=1, keepdims=True))
        slope = x.T @ (z / z.sum(axis=1, keepdims=True) - own) + penal * w
        v = 0.9 * v - 0.5 / len(x) * slope
        w = w + v
    return w


def test_equals_a_plain_fit(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, K, 400)
    x = rng.normal(0, 1, (400, D)) + np.eye(D)[y] * 1.2
    df = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, y int").repartition(5)
    rows = probe.stratified_folds(df, "y", F.xxhash64("id"), FOLDS).cache()
    sizes = {(r.y, r.fold): r["count"] for r in rows.groupBy("y", "fold").count().collect()}
    for c in range(K):
        assert max(sizes[c, f] for f in range(FOLDS)) - min(sizes[c, f] for f in range(FOLDS)) <= 1
    weights = probe.fit_folds(rows, D, K, FOLDS)
    fold = {r.id: r.fold for r in rows.collect()}
    at = np.array([fold[i] for i in range(400)])
    scored = {r.id: r.predicted for r in probe.predict_folds(rows, weights).collect()}
    accuracy, recall = [], []
    for f in range(FOLDS):
        w = _plain(x[at != f], y[at != f])
        assert np.allclose(w[:D], weights[f][:D], atol=1e-4)
        held = np.concatenate([x[at == f], np.ones(((at == f).sum(), 1))], axis=1)
        p = (held @ w).argmax(axis=1)
        assert [scored[i] for i in np.flatnonzero(at == f)] == p.tolist()
        accuracy.append((p == y[at == f]).mean())
        recall.append((p[y[at == f] < 2] < 2).mean())
    got = {r.measure: r for r in probe.spread(probe.predict_folds(rows, weights), 2).collect()}
    for name, want in (("accuracy", accuracy), ("toxic_recall", recall)):
        assert np.allclose([got[name].mean, got[name].deviation, *got[name].folds], [np.mean(want), np.std(want), *want], atol=2e-6)


def test_empty_and_single_class(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0, 1.0], 1, i % 2) for i in range(6)], "id long, features array<double>, y int, fold int")
    weights = probe.fit_folds(df, D, K, 2)
    assert {r.predicted for r in probe.predict_folds(df, weights).collect()} == {1}
    none = probe.fit_folds(df.limit(0), D, K, 2)
    assert probe.spread(probe.predict_folds(df.limit(0), none), 1).count() == 0
