"""Predictions from ``embeddings``: softmax over class centroids, folded into three harmful classes and a safe one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions.decisions import argmax, softmax
from loamline.sources.tables import table

#: Classes of the table, and how sharply scores tell them apart.
CLASSES, SCALE = 10, 80.0

#: Common table expressions with the same rows: pr(vec_id, label, y, z, probs, pred, conf).
SQL = f"""
cent AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, i) GROUP BY label),
lg AS (SELECT e.vec_id, e.label, list({SCALE} * list_inner_product(e.embedding::DOUBLE[], c.c) ORDER BY c.label) AS z FROM embeddings e CROSS JOIN cent c GROUP BY e.vec_id, e.label),
ex AS (SELECT vec_id, label, z, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM lg),
p10 AS (SELECT vec_id, label, z, list_transform(e, lambda x: x / list_sum(e)) AS p FROM ex),
p4 AS (SELECT vec_id, label, z, [p[1], p[2], p[3], list_sum(p[4:])] AS probs FROM p10),
pr AS (SELECT vec_id, label, least(label, 3)::INTEGER AS y, z, probs, (list_position(probs, list_max(probs)) - 1)::INTEGER AS pred, list_max(probs) AS conf FROM p4)
"""


def predictions(spark: SparkSession, sf_dir: str, scale: float = SCALE) -> DataFrame:
    """(vec_id, label, y, z, probs, pred, conf); the centroids are ``CLASSES`` rows of fixed width."""
    emb = table(spark, sf_dir, "embeddings")
    means = emb.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centroids = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c")).select("label", F.transform("c", lambda x: x["m"]).alias("c"))
    rows = sorted(centroids.collect(), key=lambda r: r.label)
    own = F.transform("embedding", lambda x: x.cast("double"))

    def dot(c):
        return F.aggregate(F.zip_with("e", F.lit(c), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) * scale

    scored = emb.select("vec_id", "label", own.alias("e")).select("vec_id", "label", F.array(*[dot(r.c) for r in rows]).alias("z"))
    p = scored.withColumn("p", softmax(F.col("z")))
    rest = F.aggregate(F.slice("p", 4, CLASSES), F.lit(0.0), lambda a, x: a + x)
    folded = p.select("vec_id", "label", F.least("label", F.lit(3)).cast("int").alias("y"), "z", F.array(F.col("p")[0], F.col("p")[1], F.col("p")[2], rest).alias("probs"))
    return folded.withColumns({"pred": argmax(F.col("probs")), "conf": F.array_max("probs")})
