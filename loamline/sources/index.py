"""A keyed index in versions: a refresh writes a new one and swaps a pointer at its end, so one that dies leaves the old index."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_POINTER = "current"


def _files(spark: SparkSession, path: str):
    context = spark.sparkContext
    fs = context._jvm.org.apache.hadoop.fs
    at = fs.Path(path)
    return fs, at, at.getFileSystem(context._jsc.hadoopConfiguration())


def version(spark: SparkSession, home: str) -> str | None:
    """Folder of the current version; null where there is none, or the pointer can't be read."""
    _, at, system = _files(spark, f"{home}/{_POINTER}")
    if not system.exists(at):
        return None
    name = spark.read.text(f"{home}/{_POINTER}").first()
    return f"{home}/{name.value}" if name and name.value.startswith("v-") and system.exists(at.getParent().suffix(f"/{name.value}/_SUCCESS")) else None


def read(spark: SparkSession, home: str, schema: StructType) -> DataFrame:
    """Rows of the current version; none without one, or if its columns are others, as then all has to be made anew."""
    path = version(spark, home)
    if path is None or spark.read.parquet(path).schema.simpleString() != schema.simpleString():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def commit(df: DataFrame, home: str) -> str:
    """Write ``df`` as a new version and make it the current one by renaming a pointer; older versions stay for their readers."""
    spark, name = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{home}/{name}")
    fs, at, system = _files(spark, f"{home}/{_POINTER}")
    part = fs.Path(f"{home}/{_POINTER}-{uuid.uuid4().hex}")
    out = system.create(part)
    out.write(bytearray(f"{name}\n".encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri()).rename(part, at, options)
    return f"{home}/{name}"


def refresh(listing: DataFrame, home: str, key: str, stamps: list[str], made: str, make: Callable[[], Column]) -> tuple[DataFrame, dict[str, int]]:
    """The index of a new listing, committed, with ``reused``, and its hits and misses, which are counted while it is written.

    A row's ``made`` is taken over where the current version has its key with equal
    ``stamps``, else it is ``make()`` of the listing's columns; rows that aren't listed any more go.
    """
    spark = listing.sparkSession
    kept = listing.select(key, *stamps, make().alias(made), F.lit(True).alias("reused")).schema
    old = read(spark, home, kept).drop("reused").withColumnRenamed(made, "_old").withColumn("_held", F.lit(True))
    j = listing.join(old, [key, *stamps], "left")
    rows = j.select(key, *stamps, F.when(F.col("_held"), F.col("_old")).otherwise(make()).alias(made), F.col("_held").isNotNull().alias("reused"))
    seen = Observation()
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    watched = rows.observe(seen, count(F.col("reused")).alias("hits"), count(~F.col("reused")).alias("misses"))
    done = spark.read.schema(rows.schema).parquet(commit(watched, home))
    return done, dict(seen.get)
