"""Helpers shared by the text operators: words, folds, hashing seeds and the shared folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression for one run of the six ASCII white-space characters.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents``, whole."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``labels``, whole."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def space_words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; empty for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ASCII_SPACE), lambda w: w != "")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as decimal text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent, as in tests on one machine, it lies below the warehouse; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """The mounted path of a shared folder; the formats that are mapped into memory need one."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"a folder mounted on all machines is needed, not {uri}")
    return os.path.abspath(parsed.path)


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the folders of materialized tables that nothing will read any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def replace_file(path: str, parts: Iterator[bytes] | list[bytes]) -> None:
    """Write a file under another name first, so that a retried task never leaves half of it."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(part, "wb") as out:
        for x in parts:
            out.write(x)
    os.replace(part, path)


def range_bounds(df: DataFrame, keys: list[str], text: str, range_bytes: int, most: int = 200_000, drawn: int = 16) -> list[tuple]:
    """Bounds, as tuples, that cut the rows into ranges of ``keys`` with about ``range_bytes`` of ``text`` each.

    They are quantiles of a sample of ``drawn`` rows for each range, which is all that comes
    to the driver. There are ``most`` ranges at most, so that at 100 TB a range holds 0.5 GB.
    """
    total = df.agg(F.sum(F.octet_length(text)).alias("n_bytes"), F.count("*").alias("n")).first()
    n = int(min(most, max(1, -(-(total.n_bytes or 0) // range_bytes))))
    if n == 1:
        return []
    share = drawn * n / total.n
    sample = df.select(*keys) if share >= 1 else df.select(*keys).sample(share, 20240607)
    found = sorted(map(tuple, sample.collect()))
    return sorted({found[len(found) * k // n] for k in range(1, n)}) if found else []


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds that ``key`` has reached: looked up among every so many, then between two of those."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    whole, coarse = F.lit(bounds), F.lit(bounds[::step])
    at = F.greatest(F.size(F.filter(coarse, lambda b: b <= key)) - 1, F.lit(0)) * step
    return F.transform(F.array(at), lambda a: a + F.size(F.filter(F.slice(whole, a + 1, step), lambda b: b <= key)))[0]


def batch_words(texts):
    """Words of an Arrow array of texts, A-Z lower-cased: (distinct words as bytes, code of each word, bounds of each text).

    Splitting and finding the distinct words run in Arrow's own code.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if len(texts) == 0:
        return [], np.empty(0, "i8"), np.zeros(1, "i8")
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    starts = cut.offsets.to_numpy().astype("i8")
    flat = cut.flatten()
    kept = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(kept)])
    coded = flat.filter(pa.array(kept)).dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype("i8"), before[starts - starts[0]]


def hash_words(words: list[bytes]):
    """64-bit hash of each word."""
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), "u8", len(words))


def fit_in_task(sample: DataFrame, fit):
    """``fit(rows)`` run in one task over a sample of bounded size, so that a lost executor only repeats it.

    ``rows`` is a list of dicts in an order fixed by their values.
    """
    import pickle

    def run(batches):
        import pyarrow as pa

        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: [(x is not None, x) for x in r.values()])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    # Not coalesced, which would make whatever gives the rows one task too.
    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit([])


def text_slices(texts, most_bytes: int):
    """Slices of an Arrow array of texts with about ``most_bytes`` each, one text at least."""
    import numpy as np
    import pyarrow.compute as pc

    if len(texts) == 0:
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype="i8") // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield lo, texts.slice(lo, hi - lo)


def labelled_sample(docs: DataFrame, known: DataFrame, label: str, most: int, most_bytes: int = 1 << 20) -> DataFrame:
    """At most ``most`` rows (doc_id, text, label) of documents with a label, by order of a hash of the id.

    Texts of more than ``most_bytes`` aren't learned from, so the task that fits holds a
    bounded number of bytes too; they are scored like all others.

    The ids are chosen among the labels first; as there are at most ``most`` of them, they
    are broadcast to the scan of the texts. A repeated id counts once more for each row.
    """
    order = lambda: [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.filter(F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).distinct().orderBy(*order(), "label").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    return rows.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes).orderBy(*order(), "text", "label").limit(most)
