"""Centroid clusters against a plain walk through the rounds."""

import hashlib
import math
import random

import pytest
from loamline.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def plain(rows, k, rounds, seed, dims, scale):
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e, *_ in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    now = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(now))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        now = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(now)]
    return sorted(((i, *reversed(near(v))) for i, v in kept), key=str), now


def as_floats(x):
    import numpy as np

    return [float(np.float32(y)) for y in x]


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_equals_plain_walk(spark, rounds):
    rng = random.Random(5)
    rows = [(i, as_floats([rng.gauss(i % 3 - 1, 0.4) for _ in range(6)]), i, "x") for i in range(120)]
    rows += [rows[7], rows[7], (None, as_floats([0.5] * 6), None, None), (None, as_floats([-0.5] * 6), None, None)]
    rows += [(900, None, 1, "x"), (901, [], 1, "x"), (902, [1.0] * 5, 1, "x"), (903, [1.0] * 5 + [None], 1, "x"), (904, [1.0] * 5 + [float("nan")], 1, "x"), (905, [1.0] * 5 + [float("inf")], 1, "x")]
    found, now = centroids.cluster(spark.createDataFrame(rows, SCHEMA), k=5, rounds=rounds, dims=6, scale=100)
    want, centres = plain(rows, 5, rounds, "3", 6, 100)
    assert now == centres
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=str) == want


def test_ties_empty_clusters_and_few_rows(spark):
    same = [(i, [1.0, -1.0], 0, "x") for i in range(4)]
    found, now = centroids.cluster(spark.createDataFrame(same, SCHEMA), k=3, rounds=3, dims=2)
    assert now == [[1024, -1024]] * 3
    assert {(r.cluster, r.distance) for r in found.collect()} == {(0, 0)}
    found, now = centroids.cluster(spark.createDataFrame(same[:1], SCHEMA), k=3, rounds=3, dims=2)
    assert len(now) == 1 and found.count() == 1
    found, now = centroids.cluster(spark.createDataFrame([], SCHEMA), k=3, rounds=3, dims=2)
    assert now == [] and found.count() == 0 and found.columns == ["vec_id", "v", "cluster", "distance"]


def test_large_components(spark):
    rows = [(i, [131_071.0 * (-1) ** i] * 64, 0, "x") for i in range(3)]
    found, _ = centroids.cluster(spark.createDataFrame(rows, SCHEMA), k=2, rounds=2)
    assert max(r.distance for r in found.collect()) < 2**63
    with pytest.raises(Exception, match="131072"):
        centroids.cluster(spark.createDataFrame([(1, [2e5] * 64, 0, "x")], SCHEMA))


def test_query_without_vectors(spark, tmp_path):
    spark.createDataFrame([(1, None, 0, "x")], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert centroids.op11_centroid_clusters(spark, str(tmp_path)).count() == 0
