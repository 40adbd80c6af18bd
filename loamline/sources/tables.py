"""Parquet tables, and time stamps as whole microseconds whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time stamp without zone."""
    day = F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000
    second = (F.expr("0") + F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return day + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + second


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``t``, the time in microseconds, instead of ``ts``."""
    return table(spark, sf_dir, "events").withColumn("t", micros(F.col("ts"))).drop("ts")


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    """``df``, if it has all columns of ``needed``; else an error that names the missing ones."""
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
