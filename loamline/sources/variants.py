"""Manifests of any shape, read without a schema: lines, ``entries``, a flat map or a bare list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Output column: the fields that may hold it, the first filled one wins.
FIELDS = {
    "cls": ("class", "cls"),
    "source": ("source",),
    "license": ("license",),
    "attribution": ("attribution",),
    "url": ("url", "image_url", "source_url"),
    "observation_id": ("observation_id", "occurrence_id", "obs_id"),
}
NAMES = ("path", "file", "filename")


def field(entry: Column, *names: str) -> Column:
    """The first of an entry's fields that is filled, as text: blank texts, 0, false and nulls aren't."""
    texts = [F.try_variant_get(entry, f"$.{n}", "string") for n in names]
    return F.coalesce(*[F.when(~t.isin("", "0", "false"), t) for t in texts])


def base_name(path: Column) -> Column:
    """What follows the last slash; trailing slashes don't count."""
    return F.nullif(F.element_at(F.split(F.regexp_replace(path, r"/+$", ""), "/"), -1), F.lit(""))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def documents(spark: SparkSession, path: str, fatal: bool = False) -> DataFrame:
    """(file, doc): each file below ``path`` as one JSON value; one that can't be parsed is an error, or null if not ``fatal``."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    parse = F.parse_json if fatal else F.try_parse_json
    return whole.select(F.input_file_name().alias("file"), parse("value").alias("doc"))


def entries(docs: DataFrame, fatal: bool = False) -> DataFrame:
    """(file, place, key, entry) of the objects in documents: of ``entries``, of a bare list, else the values of a flat map.

    Only a map's entries have a ``key``, their name. If ``fatal``, a document of none of
    these shapes is an error; else it has no entries.
    """
    doc = F.col("doc")
    listed = F.coalesce(F.try_variant_get(doc, "$.entries", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>"))
    mapped = F.when(is_object(doc), F.try_variant_get(doc, "$", "map<string,variant>"))
    item = lambda key, v: F.struct(key.alias("key"), v.alias("entry"))
    of_list = F.transform(listed, lambda v: item(F.lit(None).cast("string"), v))
    of_map = F.transform(F.map_entries(mapped), lambda e: item(e["key"], e["value"]))
    nothing = F.raise_error(F.lit("a manifest holds neither entries nor a map")).cast("array<struct<key:string,entry:variant>>") if fatal else F.lit(None)
    items = F.coalesce(F.when(listed.isNotNull(), of_list).otherwise(of_map), nothing)
    found = docs.select("file", F.posexplode(items).alias("place", "i")).select("file", "place", "i.key", "i.entry")
    return found.filter(is_object(F.col("entry")))


def normalized(found: DataFrame) -> DataFrame:
    """(file, place, name, fields of ``FIELDS``) of entries with a name: a field's base name, else the entry's key."""
    name = base_name(F.coalesce(field(F.col("entry"), *NAMES), F.col("key")))
    return found.select("file", "place", name.alias("name"), *(field(F.col("entry"), *names).alias(out) for out, names in FIELDS.items())).filter("name IS NOT NULL")


def lines(spark: SparkSession, path: str, ordinal: str) -> DataFrame:
    """(file, place, key, entry) of JSON lines; blank and broken ones are skipped. ``place`` is the entry's field ``ordinal``, as lines of a split file aren't numbered.

    Part files of one folder are one manifest, as Spark writes them in no order of its lines; ``file`` is that folder.
    """
    file = F.regexp_replace(F.input_file_name(), r"/part-[^/]*$", "")
    parsed = spark.read.option("recursiveFileLookup", True).text(path).select(file.alias("file"), F.try_parse_json("value").alias("entry"))
    place = F.coalesce(F.try_variant_get("entry", f"$.{ordinal}", "long"), F.lit(0).cast("long"))
    return parsed.filter(is_object(F.col("entry"))).select("file", place.alias("place"), F.lit(None).cast("string").alias("key"), "entry")


def one_row_each(rows: DataFrame, last: bool) -> DataFrame:
    """A row for each name: the last or the first one by file and place."""
    kept = F.struct(*FIELDS)
    best = F.max_by(kept, F.struct("file", "place")) if last else F.min_by(kept, F.struct("file", "place"))
    return rows.groupBy("name").agg(best.alias("m")).select("name", "m.*")


def provenance(line_rows: DataFrame, *blobs: DataFrame) -> DataFrame:
    """What manifests know of each name: the last line of it, else the first entry of the first blob manifest that has it."""
    ranked = [one_row_each(line_rows, True).withColumn("rank", F.lit(0)), *(one_row_each(b, False).withColumn("rank", F.lit(k + 1)) for k, b in enumerate(blobs))]
    both = reduce(DataFrame.unionByName, ranked)
    return both.groupBy("name").agg(F.min_by(F.struct(*FIELDS, "rank"), "rank").alias("m")).select("name", "m.*")
