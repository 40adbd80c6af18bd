"""Document fingerprints: threshold-scaled sketches of word shingles, in built-in functions.

A sketch retains every shingle hash below a fixed fraction of the hash range. Sketches of
parts merge by union, and the share of one sketch's hashes that another holds estimates
containment however unequal the documents are. A document that retains nothing has its
smallest hash instead, marked, which only serves to tell whether two such are alike.

Shingles are ``WIDTH`` consecutive lower-cased words; a shorter text is one shingle.

Defined results: a null or empty text has the empty fingerprint, and two of those have
likeness 1; against anything else likeness is 0. Rows with equal ids are ordered by text;
a null id comes after all others. An empty table gives an empty result. ``fingerprint``
works on one column and keeps the others, but replaces one of the name ``out``; the neighbour query looks at no other columns.
Rows of one id lie in one range, so ids should tell rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.common import documents, range_bounds, range_of, space_words

#: Words in a shingle, the retained share of hashes (one in so many), bits of a hash.
WIDTH, ONE_IN, HASH_BITS = 5, 4, 40
#: Bytes of text that lie in one range of ids.
RANGE_BYTES = 4 << 20
_FIRST = -(2**63)


def _bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, width: int = WIDTH, one_in: int = ONE_IN) -> Column:
    """Sorted retained hashes; else the complement of the smallest one; else nothing."""
    mask, limit = (1 << HASH_BITS) - 1, (1 << HASH_BITS) // one_in

    def hashes(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]).bitwiseAND(F.lit(mask)))
        one = F.array(F.xxhash64(F.array_join(w, " ")).bitwiseAND(F.lit(mask)))
        return F.when(n >= width, many).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))

    def retained(h: Column) -> Column:
        low = F.sort_array(F.array_distinct(F.filter(h, lambda x: x < limit)))
        return F.when(F.size(low) > 0, low).when(F.size(h) > 0, F.array(F.bitwise_not(F.array_min(h)))).otherwise(F.array().cast("array<bigint>"))

    return _bind(space_words(F.lower(text)), lambda w: _bind(hashes(w), retained))


def as_text(sk: Column) -> Column:
    """Ten hexadecimal digits a hash; ``~`` marks a smallest hash."""
    digits = HASH_BITS // 4
    return F.array_join(F.transform(sk, lambda h: F.when(h < 0, F.concat(F.lit("~"), F.lpad(F.lower(F.hex(F.bitwise_not(h))), digits, "0"))).otherwise(F.lpad(F.lower(F.hex(h)), digits, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance: shared hashes over all hashes."""
    both = F.size(F.array_intersect(a, b))
    return _bind(both, lambda n: F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def merge(sketches: Column) -> Column:
    """Sketch of the union of several documents, from an array of their sketches."""
    every = F.array_distinct(F.flatten(sketches))
    return _bind(every, lambda e: _bind(F.filter(e, lambda h: h >= 0), lambda low: F.when(F.size(low) > 0, F.sort_array(low)).when(F.size(e) > 0, F.array(F.array_max(e))).otherwise(e)))


def fingerprint(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the sketch of a text column as an array of hashes."""
    return df.withColumn(out, sketch(F.coalesce(F.col(text_col), F.lit(""))))


def with_next(df: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): the next row by descending id, the first after the last.

    Rows are dealt by ranges of ids, and each range ends with a copy of the row that opens
    the next one. Only the ranges' highest ids come to the driver and
    are broadcast; there are 200,000 ranges at most, which grow beyond 0.8 TB (0.5 GB at 100 TB).
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("key"), F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = [key for (key,) in range_bounds(rows, ["key"], "text", range_bytes)]
    ranged = rows.withColumn("part", range_of(F.col("key"), bounds))
    tops = sorted((r.part, r.top) for r in ranged.groupBy("part").agg(F.max("key").alias("top")).collect())
    following = [(tops[k - 1][1], part) for k, (part, _) in enumerate(tops)]
    heads = rows.join(F.broadcast(spark.createDataFrame(following, "key long, part int")), "key").groupBy("part", "key").agg(F.min("text").alias("text"))
    copies = heads.select("key", F.lit(None).cast(df.schema["doc_id"].dataType).alias("doc_id"), "text", "part", F.lit(True).alias("copy"))
    dealt = ranged.withColumn("copy", F.lit(False)).unionByName(copies).repartition(max(1, len(tops)), "part")
    order = Window.partitionBy("part").orderBy("copy", F.col("key").desc(), "text")
    after = dealt.withColumn("sketch", sketch(F.col("text"))).withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)})
    return after.filter(~F.col("copy")).select("doc_id", "text", "sketch", "next_text", "next_sketch")


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Query: each document against its edited text and against the next document."""
    rows = with_next(documents(spark, sf_dir))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    shown = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    shown = shown.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", sketch(F.col("edited")).alias("edited_sketch"), "next_sketch")
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return shown.select(
        "doc_id", "n_chars", "edited_sha256", as_text(a).alias("fingerprint"), as_text(b).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"), containment(a, b).alias("contained_in_edited"),
    )
