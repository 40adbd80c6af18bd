"""Packing: first-fit decreasing with a tournament tree, in randomised groups of documents.

Each document becomes ids and an end id, cut into pieces of at most ``seq_len`` ids.
Groups are drawn by a hash of the row and its place in the input, which a retry doesn't
change, so repeated rows spread over groups; they have about ``group_docs`` documents each, so that a
group's piece lengths fit one task whatever the size of the corpus; the ids themselves
need not travel. In a group, pieces go longest first into the first open sequence with
room, found by walking down a tree that keeps the larger room of every pair of bins.

Defined results: a null or empty text is the end id alone; rows with equal ids or null
ids are packed one by one; an empty table gives no pieces; other columns of the input
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import documents, text_slices
from loamline.llm.encoding import chunk_encoder, tokenizer_path

SEQ_LEN, GROUP_DOCS = 2048, 4096
#: Bytes of text that a task encodes at a time.
SLICE_BYTES = 8 << 20
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, pack_group long"


def encode_pieces(df: DataFrame, tokenizer: str, end_id: int, seq_len: int = SEQ_LEN, group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document; ``with_ids`` adds the ids as binary ``ids``."""
    groups = max(1, -(-df.count() // group_docs))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.pmod(F.xxhash64("doc_id", text, F.monotonically_increasing_id()), F.lit(groups)).alias("pack_group"))

    def cut(batches):
        import zlib

        import pyarrow as pa

        encoder, end = chunk_encoder(tokenizer, True), end_id.to_bytes(4, "little")
        step = 4 * seq_len
        names = [x.split()[0] for x in _PIECE.split(", ")] + ["ids"] * with_ids
        kinds = [pa.int64()] * 6 + [pa.binary()] * with_ids
        for batch in batches:
            for lo, texts in text_slices(batch.column(1), SLICE_BYTES):
                own, out = batch.slice(lo, len(texts)), []
                flat, bounds = encoder.encode_batch(texts)
                for doc, group, a, b in zip(own.column(0).to_pylist(), own.column(2).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = flat[a:b].tobytes() + end
                    for at in range(0, len(ids), step):
                        piece = ids[at : at + step]
                        out.append((doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, group) + ((piece,) if with_ids else ()))
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return rows.mapInArrow(cut, _PIECE + ", ids binary" * with_ids)


def first_fit(lengths: list[int], room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in the given order: the first bin with enough room."""
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    tree = [room] * (2 * leaves)
    bins, offsets = [], []
    for x in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < x:
                node += 1
        bins.append(node - leaves)
        offsets.append(room - tree[node])
        tree[node] -= x
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins, offsets


def pack(pieces: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, packed group by group."""
    kept = [c for c in pieces.columns if c != "pack_group"]

    def fill(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        table = table.take(pc.sort_indices(table, sort_keys=order))
        bins, offsets = first_fit(table["length"].to_pylist(), seq_len)
        group = table["pack_group"][0].as_py()
        out = table.select(kept)
        return out.append_column("sequence_id", pa.array([(group << 32) + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    schema = ", ".join(f"{c} {t}" for c, t in pieces.select(*kept).dtypes) + ", sequence_id long, offset long"
    return pieces.groupBy("pack_group").applyInArrow(fill, schema)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Query: all documents by the word tokenizer, packed into sequences of 2048."""
    return pack(encode_pieces(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=1))
