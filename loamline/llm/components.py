"""Connected components of an edge table by smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; the component is its smallest node.

    Each round takes the smallest label among a node and its neighbours, pre-aggregated
    before the shuffle, then follows that label once. Labels are written to the shared
    folder each round, so a lost executor costs one round's work at most; those of the
    round before are deleted. It ends when no label falls any more, after about the
    logarithm of the longest path in rounds.

    Defined results: an empty edge table gives an empty result; a repeated edge counts once;
    an edge with a null end is left out.
    """
    both = materialize(edges.select("u", "v").union(edges.select("v", "u")).dropna().distinct(), "edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        jump = lower.select(F.col("node").alias("c"), F.col("c").alias("c2"))
        after = materialize(lower.join(jump, "c").select("node", F.least("c", "c2").alias("c"), "old"), "labels")
        discard(labels)
        labels = after.select("node", "c")
        if after.filter("c <> old").limit(1).count() == 0:
            discard(both)
            return labels.withColumnRenamed("c", "component")
