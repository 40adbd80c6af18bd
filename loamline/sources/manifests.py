"""Provenance manifests: tolerant readers and the reconciliation of their spellings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StructType

#: Output column: the columns that may hold it, the first usable one wins.
ALIASES = {
    "path": ("path", "file", "filename"),
    "cls": ("cls", "class", "label"),
    "license": ("license",),
    "attribution": ("attribution", "photographer_name", "photographer_login"),
    "source": ("source",),
    "url": ("url", "image_url", "source_url"),
    "observation_id": ("observation_id", "occurrence_id", "obs_id"),
}


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with columns of ``schema``; blank and broken lines are skipped."""
    rows = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    named = [c for c in rows.columns if c != "_broken"]
    whole = F.coalesce(*[F.col(c).cast("string") for c in named]).isNotNull()
    return rows.filter(F.col("_broken").isNull() & whole).drop("_broken")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one JSON document with ``entries`` or a bare list, or CSV, by the extension.

    Broken lines are dropped; a document that can't be parsed is an error.
    """
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    if path.endswith(".jsonl"):
        return spark.read.option("mode", "DROPMALFORMED").json(path)
    whole = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    if "entries" not in whole.columns:
        return whole
    kind = whole.schema["entries"].dataType
    listed = whole.select(F.explode("entries").alias("e"))
    return listed.select("e.*") if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) else listed


def usable(*columns: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c.cast("string")) for c in columns], F.lit(None).cast("string"))


def _filled(manifest: DataFrame, column: str) -> Column:
    """A column as text; of a number, 0 counts as missing."""
    c = F.col(column)
    return F.when(c != 0, c).cast("string") if isinstance(manifest.schema[column].dataType, NumericType) else c


def reconcile(manifest: DataFrame, ordinal: str) -> DataFrame:
    """One row for each base name of the path, with the columns of ``ALIASES``; the row of the largest ``ordinal`` wins.

    Ordinals must tell the rows of a name apart. The row that wins is found by one
    aggregate. A row without a path is left out.
    """
    has = {c.lower(): c for c in manifest.columns}
    found = [usable(*[_filled(manifest, has[a]) for a in names if a in has]).alias(out) for out, names in ALIASES.items()]
    rows = manifest.select(*found, F.col(ordinal).alias("ordinal")).withColumn("name", F.element_at(F.split("path", "/"), -1)).filter("name <> ''")
    return rows.groupBy("name").agg(F.max_by(F.struct(*ALIASES), "ordinal").alias("m"), F.count("*").alias("n_rows")).select("name", "m.*", "n_rows")


def union_manifests(*manifests: DataFrame) -> DataFrame:
    """Manifests of different columns below each other."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), manifests)


def by_priority(*manifests: DataFrame, ordinal: str) -> DataFrame:
    """Reconciled rows of several manifests; a name's row is that of the first manifest that has one."""
    ranked = [reconcile(m, ordinal).withColumn("rank", F.lit(k)) for k, m in enumerate(manifests)]
    both = reduce(DataFrame.unionByName, ranked)
    kept = [c for c in both.columns if c not in ("name", "rank")]
    return both.groupBy("name").agg(F.min_by(F.struct(*kept), "rank").alias("m")).select("name", "m.*")
