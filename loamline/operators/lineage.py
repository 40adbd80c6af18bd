"""Cutting lineage through the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """``df`` after a checkpoint in ``spark.checkpoint.dir``; where that is unset, on one machine, below the warehouse."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        home = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.sparkContext.setCheckpointDir(home)
    return df.checkpoint()
