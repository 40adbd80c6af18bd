"""Token-id files: one zstandard frame for each document under a shared dictionary.

A shard is ``magic, dictionary hash, id width, number of documents, place of the index``,
then the frames, then the index: columns of doc_id, null flag, frame offset, frame
length and number of ids. The dictionary is trained on the serialized ids of a bounded
sample (``DICT_SAMPLE`` documents by hash order, of each a window of ``DICT_DOC_BYTES`` at a
place drawn by the same hash); it lies beside the shards under the
name of its hash, which every shard repeats, so that a reader refuses another one. One
document is read with its index row and one frame alone.

Shards hold consecutive ranges of ``doc_id``, rows of one id by a hash of their place in the
input; their bounds are quantiles of a sample, each
task streams its sorted frames to one shard after another, and a file gets its name only
when it is complete, so a retried task changes nothing.

Defined results: a null or empty text is the end id alone; null ids come first; rows with
equal ids are all written, next to each other, in any order; an empty table gives no
shards and no rows; other columns are not looked at. Ids take two bytes, or four where the
tokenizer or the end id needs them; a width that is too small raises an error.
"""

from __future__ import annotations

import struct
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import documents, local_path, range_bounds, replace_file, shared_dir, text_slices
from loamline.llm.encoding import chunk_encoder, load_tokenizer, tokenizer_path

#: Documents and bytes of each that the dictionary is trained on, and its size.
DICT_SAMPLE, DICT_DOC_BYTES, DICT_BYTES = 1000, 1 << 14, 1 << 16
#: Compression level; bytes of text for one shard.
LEVEL = 1
SHARD_TEXT_BYTES = 32 << 20
#: Bytes of text that a task encodes at a time, and chunks of text whose ids a worker remembers.
SLICE_BYTES, KEPT_CHUNKS = 8 << 20, 400_000
_HEAD = struct.Struct("<8s32sBQQ")
_MAGIC = b"LLTOKEN1"
#: Null ids come first.
_NULL_ID = -(2**63)


def _train(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples: their content is the dictionary
        return b"".join(samples)[:DICT_BYTES]


@lru_cache(maxsize=2)
def _dictionary(folder: str, digest: str):
    import hashlib

    import zstandard

    with open(f"{folder}/{digest}.dict", "rb") as f:
        raw = f.read()
    if hashlib.sha256(raw).hexdigest() != digest:
        raise ValueError(f"the dictionary in {folder} isn't {digest}")
    return zstandard.ZstdCompressionDict(raw) if raw else None


class ShardWriter:
    """Streams frames to a file and adds the index at the end."""

    def __init__(self, path: str, digest: str, width: int):
        import os
        import uuid

        os.makedirs(os.path.dirname(path), exist_ok=True)
        self.path, self.part, self.digest, self.width = path, f"{path}.{uuid.uuid4().hex}.tmp", digest, width
        self.out = open(self.part, "wb")  # noqa: SIM115
        self.out.write(b"\0" * _HEAD.size)
        self.at, self.rows = _HEAD.size, []

    def add(self, doc_id, n_tokens: int, frame: bytes) -> None:
        self.out.write(frame)
        self.rows.append((doc_id or 0, doc_id is None, self.at, len(frame), n_tokens))
        self.at += len(frame)

    def close(self) -> tuple[int, int, int]:
        """Documents, ids and bytes written."""
        import os

        import numpy as np

        for c in zip(*self.rows, strict=True):
            self.out.write(np.asarray(c, "<i8").tobytes())
        self.out.seek(0)
        self.out.write(_HEAD.pack(_MAGIC, bytes.fromhex(self.digest), self.width, len(self.rows), self.at))
        self.out.close()
        os.replace(self.part, self.path)
        return len(self.rows), sum(r[4] for r in self.rows), self.at + 40 * len(self.rows)


class ShardReader:
    """Index of a shard, and any of its documents by place."""

    def __init__(self, path: str):
        import os

        import numpy as np
        import zstandard

        self.file = open(path, "rb")  # noqa: SIM115
        magic, digest, self.width, n, at = _HEAD.unpack(self.file.read(_HEAD.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is no token file")
        self.file.seek(at)
        table = np.frombuffer(self.file.read(), "<i8").reshape(5, n)
        self.doc_ids = [None if null else int(d) for d, null in zip(table[0], table[1], strict=True)]
        self.offsets, self.lengths, self.n_tokens = table[2], table[3], table[4]
        shared = _dictionary(os.path.dirname(path), digest.hex())
        self.zstd = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()

    def document(self, k: int):
        """Ids of the k-th document, as unsigned 32-bit integers."""
        import numpy as np

        self.file.seek(int(self.offsets[k]))
        raw = self.zstd.decompress(self.file.read(int(self.lengths[k])))
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def write_token_files(df: DataFrame, tokenizer: str, end_id: int, uri: str, width: int | None = None, shard_text_bytes: int = SHARD_TEXT_BYTES) -> list[tuple]:
    """Encode ``df`` into shards below ``uri``; (shard, documents, ids, bytes) of each, in order."""
    import hashlib

    most = max(end_id, *load_tokenizer(tokenizer).get_vocab(with_added_tokens=True).values())
    width = width or (2 if most < 1 << 16 else 4)
    if most >= 1 << (8 * width):
        raise ValueError(f"ids up to {most} don't fit in {width} bytes")

    folder = local_path(uri)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def serialized(texts) -> list[bytes]:
        import numpy as np

        flat, bounds = chunk_encoder(tokenizer, kept=KEPT_CHUNKS).encode_batch(texts)
        flat = np.insert(flat, bounds[1:], end_id).astype(f"<u{width}")
        bounds = (bounds + np.arange(len(bounds))).tolist()
        return [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def window(ids: bytes, drawn: int) -> bytes:
        at = drawn % (max(0, len(ids) - DICT_DOC_BYTES) // width + 1) * width
        return ids[at : at + DICT_DOC_BYTES]

    def sampled(batches):
        import pyarrow as pa

        for b in batches:
            for at, part in text_slices(b.column(1), SLICE_BYTES):
                drawn = b.column(2).slice(at, len(part))
                cut = [window(ids, k) for ids, k in zip(serialized(part), drawn.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([drawn, pa.array(cut, pa.binary())], names=["drawn", "ids"])

    chosen = docs.select("doc_id").distinct().withColumn("drawn", F.xxhash64("doc_id")).orderBy("drawn", "doc_id").limit(DICT_SAMPLE)
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "drawn").mapInArrow(sampled, "drawn long, ids binary")
    samples = [bytes(r.ids) for r in sample.orderBy("drawn", "ids").limit(DICT_SAMPLE).collect()]
    raw = _train(samples)
    digest = hashlib.sha256(raw).hexdigest()
    replace_file(f"{folder}/{digest}.dict", [raw])

    # A row's place tells rows of one id apart, so that a frequent or null id spreads over shards too.
    keyed = docs.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("key"), F.xxhash64(F.monotonically_increasing_id()).alias("place"), "doc_id", "text")
    bounds = range_bounds(keyed, ["key", "place"], "text", shard_text_bytes)
    n_shards = len(bounds) + 1

    cuts = df.sparkSession.sparkContext.broadcast(bounds)

    def frames(batches):
        from bisect import bisect_right

        import numpy as np
        import pyarrow as pa
        import zstandard

        shared = _dictionary(folder, digest)
        zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared) if shared else zstandard.ZstdCompressor(level=LEVEL)
        for rows, ids in ((b.slice(at, len(part)), serialized(part)) for b in batches for at, part in text_slices(b.column(3), SLICE_BYTES)):
            doc_ids = rows.column(2)
            shard = np.array([bisect_right(cuts.value, key) for key in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype("i4")), doc_ids, pa.array([len(x) // width for x in ids], pa.int64()), pa.array([zstd.compress(x) for x in ids], pa.binary())], names=["shard", "doc_id", "n_tokens", "frame"])

    def write(batches):
        import pyarrow as pa

        writer, now = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (now, *writer.close())], names=["shard", "n_docs", "n_tokens", "n_bytes"])

        for b in batches:
            for shard, doc, n, frame in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if shard != now:
                    if writer:
                        yield done()
                    writer, now = ShardWriter(f"{folder}/shard-{shard:08d}.tok", digest, width), shard
                writer.add(doc, n, frame)
        if writer:
            yield done()

    dealt = keyed.mapInArrow(frames, "shard int, doc_id long, n_tokens long, frame binary").repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "n_tokens", "frame")
    return sorted(tuple(r) for r in dealt.mapInArrow(write, "shard long, n_docs long, n_tokens long, n_bytes long").collect())


def read_token_files(spark, uri: str, shards: list[tuple], per_document, schema: str) -> DataFrame:
    """``per_document(doc_id, start, ids)`` of every document of the shards, a row each."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    folder, before, rows = local_path(uri), 0, []
    for shard, _, n_tokens, _ in shards:
        rows.append((shard, before))
        before += n_tokens
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for shard, start in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                reader, out = ShardReader(f"{folder}/shard-{shard:08d}.tok"), []
                for k, doc in enumerate(reader.doc_ids):
                    out.append(per_document(doc, int(start), reader.document(k)))
                    start += int(reader.n_tokens[k])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    files = spark.createDataFrame(rows, "shard long, before long")
    return files.repartitionById(max(1, len(rows)), F.col("shard").cast("int")).mapInArrow(read, schema)


def _digest(doc_id, start, ids):
    import zlib

    return doc_id, start, len(ids), zlib.crc32(ids.tobytes())


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    """Query: writes all documents as token files and reports what the files hold."""
    uri = shared_dir(spark, "token-files")
    shards = write_token_files(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), 0, uri)
    return read_token_files(spark, uri, shards, _digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
