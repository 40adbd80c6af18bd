"""Logistic regressions on folds: stratified folds by order of a hash, and Newton steps whose sums tasks make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.operators import ranks

#: Steps at most, and the largest slope, for each row, at which a fit has ended.
STEPS, SLOPE = 30, 1e-9
#: Sums of tasks are added up in so many groups first.
GROUPS = 16


def stratified_folds(df: DataFrame, label: str, order: Column, folds: int, out: str = "fold") -> DataFrame:
    """``df`` with a fold number: rows of a class are dealt out in turn in ``order``, a long, so folds have its share each."""
    placed = ranks.numbered(df.withColumn("_order", order), label, "_order")
    return placed.withColumn(out, (F.col("before") % folds).cast("int")).drop("_order", "before", "total")


def _softmax(z):
    import numpy as np

    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _rows(b):
    """(features with a one, class, fold) of a batch of (features, y, fold)."""
    import numpy as np

    x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(b.num_rows, -1)
    return np.concatenate([x, np.ones((len(x), 1))], axis=1), b.column(1).to_numpy(), b.column(2).to_numpy()


def _sums(x, y, w):
    """Loss, slope and curvature of the rows at the weights ``w`` (features, classes)."""
    import numpy as np

    p = _softmax(x @ w)
    d, k = w.shape
    own = np.zeros_like(p)
    own[np.arange(len(y)), y] = 1.0
    bend = np.empty((k, d, k, d))
    for a in range(k):
        for b in range(a, k):
            bend[a, :, b, :] = (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
            bend[b, :, a, :] = bend[a, :, b, :]
    return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum(), (x.T @ (p - own)).T.ravel(), bend.reshape(k * d, k * d)


def _total(rows: DataFrame, weights: dict, classes: int) -> dict:
    """{fold: (loss, slope, curvature)} over the rows outside of each fold.

    A task adds up its rows; its sums go to one of ``GROUPS`` for the fold, whose sums are
    added up in turn, so what meets in one place doesn't grow with the tasks' number.
    """
    import numpy as np

    held = rows.sparkSession.sparkContext.broadcast(weights)

    def add(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        sums: dict = {}
        for b in batches:
            x, y, fold = _rows(b)
            for f, w in held.value.items():
                found = _sums(x[fold != f], y[fold != f], w)
                sums[f] = tuple(s + t for s, t in zip(sums[f], found, strict=True)) if f in sums else found
        group = TaskContext.get().partitionId() % GROUPS
        packed = [np.concatenate([[s], g, h.ravel()]).tobytes() for s, g, h in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([group] * len(sums), pa.int32()), pa.array(packed, pa.binary())], names=["fold", "part", "sums"])

    def merged(table):
        import pyarrow as pa

        whole = sum(np.frombuffer(x, "f8") for x in table["sums"].to_pylist())
        return pa.table({"fold": table["fold"][:1], "part": pa.array([0], pa.int32()), "sums": pa.array([whole.tobytes()], pa.binary())})

    kind = "fold int, part int, sums binary"
    parts = rows.select("features", "y", "fold").mapInArrow(add, kind)
    whole = parts.groupBy("fold", "part").applyInArrow(merged, kind).groupBy("fold").applyInArrow(merged, kind).collect()
    out = {}
    for r in whole:
        flat, n = np.frombuffer(r.sums, "f8"), weights[r.fold].size
        out[r.fold] = (flat[0], flat[1 : n + 1], flat[n + 1 :].reshape(n, n))
    return out


def fit_folds(rows: DataFrame, dims: int, classes: int, folds: int, strength: float = 1.0) -> dict:
    """{fold: weights (dims + 1, classes)} of regressions on the rows ``(features, y, fold)`` outside of each fold.

    The squared weights, not the last row's offsets, count half against ``strength`` times
    the summed loss. All folds are fitted together, with one pass over the rows for a step;
    a step that makes the loss larger is halved.
    """
    import numpy as np

    penal = np.tile(np.append(np.ones(dims), 0.0), classes)
    now = {f: np.zeros((dims + 1, classes)) for f in range(folds)}
    done, last = {}, {}
    for _ in range(STEPS):
        open_ = {f: w for f, w in now.items() if f not in done}
        found = _total(rows, open_, classes)
        for f, w in open_.items():
            flat = w.T.ravel()
            if f not in found:
                done[f] = w
                continue
            loss, slope, bend = found[f]
            loss, slope, bend = strength * loss + 0.5 * (penal * flat**2).sum(), strength * slope + penal * flat, strength * bend + np.diag(penal + 1e-8)
            if f in last and loss > last[f][0] + 1e-9 * abs(last[f][0]):
                now[f] = (w + last[f][1]) / 2
                continue
            last[f] = (loss, w)
            if np.abs(slope).max() <= SLOPE * max(1.0, loss):
                done[f] = w
            now[f] = (flat - np.linalg.solve(bend, slope)).reshape(classes, dims + 1).T
        if len(done) == folds:
            break
    return {f: done.get(f, last[f][1] if f in last else now[f]) for f in now}


def predict_folds(rows: DataFrame, weights: dict) -> DataFrame:
    """``rows`` with ``predicted``: the class that the regression gives which hasn't seen the row's fold."""
    held, kept = rows.sparkSession.sparkContext.broadcast(weights), rows.columns
    at = [kept.index(c) for c in ("features", "y", "fold")]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x, _, fold = _rows(pa.RecordBatch.from_arrays([b.column(i) for i in at], names=["features", "y", "fold"]))
            found = np.zeros(len(x), "i4")
            for f, w in held.value.items():
                found[fold == f] = (x[fold == f] @ w).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], names=[*kept, "predicted"])

    return rows.mapInArrow(run, rows.withColumn("predicted", F.lit(0)).schema)


def spread(scored: DataFrame, harmful: int) -> DataFrame:
    """(measure, n_folds, mean, deviation, folds) of accuracy and of harmful recall over folds; NaN for a fold without harmful rows."""
    hit = (F.col("y") == F.col("predicted")).cast("double")
    toxic = F.col("y") < harmful
    g = scored.groupBy("fold").agg(F.avg(hit).alias("accuracy"), F.coalesce(F.avg(F.when(toxic, (F.col("predicted") < harmful).cast("double"))), F.lit(float("nan"))).alias("toxic_recall"))
    each = g.select("fold", F.explode(F.create_map(F.lit("accuracy"), "accuracy", F.lit("toxic_recall"), "toxic_recall")).alias("measure", "x"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("fold", "x"))), lambda s: F.round(s["x"], 6))
    return each.groupBy("measure").agg(F.count("*").alias("n_folds"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("deviation"), listed.alias("folds"))
