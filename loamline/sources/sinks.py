"""Keyed and append-only outputs as JSON lines and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_rows(df: DataFrame, path: str, needed: str) -> None:
    """Append rows as JSON lines; rows without a value in ``needed`` aren't written."""
    df.filter(F.col(needed).isNotNull()).write.mode("append").json(path)


def merged(old: DataFrame, fresh: DataFrame, key: str, ordinal: str) -> DataFrame:
    """``old`` rows whose key isn't among the fresh ones, and the fresh row of the largest ``ordinal`` for each key, sorted by key.

    Merging the same rows again changes nothing.
    """
    newest = fresh.groupBy(key).agg(F.max_by(F.struct(*[c for c in fresh.columns if c != key]), ordinal).alias("s")).select(key, "s.*")
    kept = old.join(newest.select(key), key, "left_anti")
    return kept.unionByName(newest, allowMissingColumns=True).orderBy(key)


def commit(df: DataFrame, path: str, key: str) -> int:
    """Append the rows to a Parquet table whose key isn't there yet; never overwrites. Gives how many were left out."""
    there = df.sparkSession.read.parquet(path).select(key).distinct()
    left_out = df.join(there, key, "left_semi").count()
    df.join(there, key, "left_anti").write.mode("append").parquet(path)
    return left_out
