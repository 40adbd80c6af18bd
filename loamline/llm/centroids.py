"""Centroid clustering of integer vectors over an incremental matrix of dot products.

Each vector is kept with its exact integer dot products with all centroids. When centroids
move, only their components that changed are multiplied and added to the products; the
nearest centroid follows from them, as |v - c|^2 = |v|^2 - 2 v.c + |c|^2. Sums of clusters
are carried on likewise: only vectors that changed their cluster are added and taken off.

Each round writes the state (vector, products, cluster) as a table in the shared folder and
deletes the one before, so a lost executor repeats tasks of one round only. What comes to
the driver is a sum for each cluster and component.

Defined results: vectors of another length, with a null or non-finite component, and null
vectors are left out. Rows with the same or a null id are vectors of their own; a null id
stands for an empty text where ids are hashed, and ties there go to the smaller vector. With
fewer vectors than centroids there are as many centroids as vectors; an empty table gives an
empty result. Only the id and the vector are read; other columns don't pass through. A
component of 131072 or more has no exact 64-bit distance and is an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import discard, materialize

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Components must stay below this, so that sums of 64 squared differences fit a long.
MOST = 131_072.0


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors that are whole: ``dims`` integers floor(scale * x)."""
    e = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = df.filter((F.size(e) == dims) & F.forall(e, finite)).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(e, lambda x: x.cast("double")).alias("x"))
    fits = F.forall("x", lambda x: F.abs(x) < MOST)
    return whole.select("vec_id", F.when(fits, F.transform("x", lambda x: F.floor(x * scale).cast("int"))).otherwise(F.raise_error(F.lit(f"a component is {MOST:.0f} or more")).cast("array<int>")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors of smallest sha256 of ``seed:<vec_id>``, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.v) for r in vectors.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def _matrix(column, width: int):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype("i8").reshape(-1, width) if width else np.empty((len(column), 0), "i8")


_STATE = "vec_id long, v array<int>, norm long, dots array<long>, cluster int, before int, distance long"


def moved(state: DataFrame, old: list[list[int]], new: list[list[int]]) -> DataFrame:
    """``state`` after the centroids went from ``old`` to ``new``: products brought up to date, clusters chosen anew.

    For each centroid only the components that differ are read and multiplied.
    """
    changes = [[(j, b - a) for j, (a, b) in enumerate(zip(x, y, strict=True)) if a != b] for x, y in zip(old, new, strict=True)]
    squares = [sum(x * x for x in c) for c in new]

    def step(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if b.num_rows == 0:
                continue
            v, dots = _matrix(b.column(1), len(new[0])), _matrix(b.column(3), len(new)).copy()
            for c, own in enumerate(changes):
                if own:
                    at, by = (np.array(x, "i8") for x in zip(*own, strict=True))
                    dots[:, c] += v[:, at] @ by
            less = np.array(squares, "i8") - 2 * dots
            cluster = less.argmin(axis=1)
            distance = b.column(2).to_numpy() + less[np.arange(len(v)), cluster]
            offsets = pa.array(np.arange(0, dots.size + 1, len(new)), pa.int32())
            columns = [b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(offsets, pa.array(dots.ravel())), pa.array(cluster.astype("i4")), b.column(4), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _STATE.split(", ")])

    return state.mapInArrow(step, _STATE)


def sum_changes(state: DataFrame, k: int, dims: int) -> dict[tuple[int, int], int]:
    """What the vectors that changed their cluster add to (cluster, component); component -1 counts them.

    A task adds up its rows and gives one row for each cluster and component.
    """

    def add(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((k, dims + 1), "i8")
        for b in batches:
            rows = np.concatenate([np.ones((b.num_rows, 1), "i8"), _matrix(b.column(0), dims)], axis=1)
            for column, sign in ((1, 1), (2, -1)):
                at = b.column(column).to_numpy()
                np.add.at(total, at[at >= 0], sign * rows[at >= 0])
        cluster, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype("i4")), pa.array((at - 1).astype("i4")), pa.array(total[cluster, at])], names=["cluster", "at", "total"])

    parts = state.filter("cluster <> before").select("v", "cluster", "before").mapInArrow(add, "cluster int, at int, total long")
    sums = parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return {(r.cluster, r.at): int(r.total) for r in sums.collect()}


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, v, cluster, distance) of the kept vectors after ``rounds`` rounds, and the final centroids.

    A round that moves no centroid ends the work early, as later ones would change nothing.
    """
    vectors = materialize(integer_vectors(df, id_col, vector_col, dims, scale), "vectors")
    now = first_centroids(vectors, k, seed)
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
    zeros = F.array_repeat(F.lit(0).cast("long"), len(now))
    state = vectors.select("vec_id", "v", norm.alias("norm"), zeros.alias("dots"), F.lit(-1).alias("cluster"), F.lit(-1).alias("before"), F.lit(0).cast("long").alias("distance"))
    if not now:
        return state.select("vec_id", "v", "cluster", "distance"), now
    sums, last, written = {}, [[0] * dims for _ in now], [vectors]
    for done in range(rounds + 1):
        state = materialize(moved(state, last, now), "products")
        discard(*written)
        written = [state]
        if done == rounds:
            break
        for key, more in sum_changes(state, len(now), dims).items():
            sums[key] = sums.get(key, 0) + more
        sizes = [sums.get((c, -1), 0) for c in range(len(now))]
        last, now = now, [[sums.get((c, j), 0) // n for j in range(dims)] if n else own for c, (n, own) in enumerate(zip(sizes, now, strict=True))]
        if last == now:
            break
    return state.select("vec_id", "v", "cluster", "distance"), now


def op11_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    """Query: eight clusters of all embeddings after ten rounds."""
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    digests = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    # As many rows as clusters.
    sums = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    about = spark.createDataFrame([(c, d, sums.get(c, 0), sum(sums.values())) for c, d in digests], "cluster int, centroid_sha256 string, cluster_inertia long, inertia long")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


ORACLE = f"""
WITH RECURSIVE raw AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE len(embedding) = {DIMS}),
v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(e, lambda x: floor({SCALE} * x)::BIGINT) AS v FROM raw WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
f AS (SELECT v, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c FROM v),
it(r, cs) AS (SELECT 0, list(v ORDER BY c) FROM f WHERE c < {CLUSTERS}
  UNION ALL SELECT r + 1, (
    SELECT list(coalesce(m, old) ORDER BY c) FROM (SELECT unnest(range(1, len(cs) + 1)) AS c, unnest(cs) AS old) o LEFT JOIN (
      SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM (
        SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({DIMS})) AS j FROM (
          SELECT v, list_position(d, list_min(d)) AS c FROM (SELECT v, list_transform(cs, lambda k: list_sum(list_transform(list_zip(v, k), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM v)))
        GROUP BY c, j) GROUP BY c) USING (c))
  FROM it WHERE r < {ROUNDS}),
z AS (SELECT vec_id, cs, list_transform(cs, lambda k: list_sum(list_transform(list_zip(v, k), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM v, it WHERE r = {ROUNDS}),
a AS (SELECT vec_id, list_position(d, list_min(d)) - 1 AS cluster, list_min(d)::BIGINT AS distance, cs FROM z)
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(cs[cluster + 1], ',')) AS centroid_sha256 FROM a
"""
