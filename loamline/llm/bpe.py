"""BPE encoding of whole texts, long ones in parallel halves, and decoding.

Texts up to ``SEGMENT_CHARS`` are encoded in place. A longer one is cut in two, and its
halves again, until they are short; the parts are dealt out by document and part, encoded
as rows of their own, and concatenated as a tree. A cut is put where no token can span;
only in unsplit text (a long run of letters, digits or marks of one pretoken) it falls
inside the run. There the tokens around the join are encoded again together, in windows
that grow until the first two and the last two tokens of a window are those that the
halves have: a BPE sequence is the encoding of its text if each neighbouring pair is, so
the whole is then exact. A window that would leave the run is replaced by one call of the
library on both halves' text.

Decoding joins the bytes of the ids and replaces what isn't UTF-8, as the library does.

Defined results: a null or empty text has no ids and decodes to the empty text; special
tokens written out in a text become their ids, as in the library; rows with null or equal
ids, and wholly equal rows, are all encoded; an empty table gives an empty result. Other
columns are not looked at. A run without any place to cut (such as white space alone)
stays whole in one row.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import documents, text_slices
from loamline.llm.encoding import byte_letters, chunk_encoder, load_tokenizer, tokenizer_path

SEGMENT_CHARS = 1 << 15
#: Bytes of text that a task encodes at a time.
SLICE_BYTES = 2 << 20
#: Chunks that a worker remembers; several workers of an executor hold as many each.
KEPT_CHUNKS = 50_000
#: A cut inside a run has so many characters of its class before it, more than any special token or contraction has.
_RUN = 24


def _kind(c: str) -> str:
    """Letter, number, white space or other; empty for characters that Unicode 3.2 had otherwise."""
    if c.isspace():
        return "Z"
    kind = unicodedata.category(c)
    if kind != unicodedata.ucd_3_2_0.category(c):
        return ""
    return kind[0] if kind[0] in "LN" else "O" if kind[0] in "PS" else ""


def cut_place(text: str, lo: int, hi: int) -> tuple[int, bool] | None:
    """A place to cut near the middle of ``text[lo:hi]``, and whether a token may span it."""
    middle, spread = (lo + hi) // 2, (hi - lo) // 4
    p = middle + spread
    while (p := text.rfind(" ", middle - spread, p)) > lo:
        if not text[p - 1].isspace() and p + 1 < hi and not text[p + 1].isspace():
            return p, False
    run = 0
    for p in range(max(lo, middle - spread), middle + spread):
        same = run and _kind(text[p]) == _kind(text[p - 1])
        if same and run >= _RUN:
            return p, True
        run = run + 1 if same else int(bool(_kind(text[p])) and not text[p].isspace())
    return None


def cut_tree(text: str, most: int) -> list[tuple[str, bool]]:
    """Parts of a text in order, each with whether a token may span its start."""
    out, todo = [], [(0, len(text), False)]
    while todo:
        lo, hi, glued = todo.pop()
        place = cut_place(text, lo, hi) if hi - lo > most else None
        if place:
            todo += [(place[0], hi, place[1]), (lo, place[0], glued)]
        else:
            out.append((text[lo:hi], glued))
    return out


@lru_cache(maxsize=4)
def byte_table(path: str) -> list[bytes]:
    """The bytes of each id."""
    t = load_tokenizer(path)
    letters = {c: b for b, c in byte_letters().items()}
    added = {i: a.content.encode() for i, a in t.get_added_tokens_decoder().items()}
    table = [b""] * (max(t.get_vocab(True).values()) + 1)
    for token, i in t.get_vocab(True).items():
        table[i] = added.get(i) or bytes(letters[c] for c in token)
    return table


class Part:
    """Ids of a stretch of text; how many at its start and end lie in the run that it shares with its neighbours."""

    def __init__(self, text: str, ids: list[int], head: int, tail: int, whole: bool):
        self.text, self.ids, self.head, self.tail, self.whole = text, ids, head, tail, whole


def _inside(ids: list[int], run_bytes: int, table: list[bytes]) -> int:
    n = 0
    for i in ids:
        run_bytes -= len(table[i])
        if run_bytes < 0:
            break
        n += 1
    return n


def encoded_part(text: str, ids: list[int], table: list[bytes]) -> Part:
    """Finds the runs at both ends of a part."""
    first, last = _kind(text[0]), _kind(text[-1])
    a = next((i for i, c in enumerate(text) if _kind(c) != first), len(text))
    b = next((i for i, c in enumerate(reversed(text)) if _kind(c) != last), len(text))
    head = _inside(ids, len(text[:a].encode()), table)
    tail = _inside(ids[::-1], len(text[len(text) - b :].encode()), table)
    return Part(text, ids, head, tail, a == len(text))


def join_parts(x: Part, y: Part, glued: bool, encoder, table: list[bytes]) -> Part:
    """The encoding of both texts together."""
    if not glued:
        return Part(x.text + y.text, x.ids + y.ids, x.head, y.tail, False)
    size, ids = 4, None
    while ids is None:
        i, j = min(size, x.tail), min(size, y.head)
        raw = b"".join(table[k] for k in x.ids[len(x.ids) - i :] + y.ids[:j])
        window = [t.id for t in encoder.model.tokenize(raw.decode("latin-1").translate(encoder.letters))]
        left = i >= 2 and window[:2] == x.ids[len(x.ids) - i :][:2]
        right = j >= 2 and window[-2:] == y.ids[:j][-2:]
        left, right = left or i == len(x.ids) == x.tail and x.whole, right or j == len(y.ids) == y.head and y.whole
        if left and right:
            ids = x.ids[: len(x.ids) - i] + window + y.ids[j:]
        elif i == x.tail and j == y.head:
            ids = encoder.tokenizer.encode(x.text + y.text, add_special_tokens=False).ids
        size *= 2
    run = len(ids) - (len(x.ids) - x.tail) - (len(y.ids) - y.head)
    return Part(x.text + y.text, ids, run if x.whole else x.head, run if y.whole else y.tail, x.whole and y.whole)


def join_tree(parts: list[Part], glued: list[bool], encoder, table: list[bytes]) -> list[int]:
    """Joins neighbours, then the results, until one is left."""
    while len(parts) > 1:
        pairs = [join_parts(parts[k], parts[k + 1], glued[k + 1], encoder, table) for k in range(0, len(parts) - 1, 2)]
        parts, glued = pairs + parts[2 * len(pairs) :], glued[::2]
    return parts[0].ids if parts else []


def decode_ids(ids, path: str) -> str:
    """Text of the ids, special tokens included."""
    return b"".join(map(byte_table(path).__getitem__, ids)).decode("utf-8", "replace")


def encode_decode(df: DataFrame, tokenizer: str, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """(doc_id, ids, decoded) for every row of ``df(doc_id, text)``; byte-level tokenizers."""
    spark = df.sparkSession
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = "doc_id long, ids array<int>, decoded string"

    def encoded(batches):
        import pyarrow as pa

        for at, part, b in ((at, part, b) for b in batches for at, part in text_slices(b.column(1), SLICE_BYTES)):
            flat, bounds = chunk_encoder(tokenizer, kept=KEPT_CHUNKS).encode_batch(part)
            ids = pa.ListArray.from_arrays(pa.array(bounds.astype("i4")), pa.array(flat.astype("i4")))
            pieces = flat.tolist()
            texts = [decode_ids(pieces[x:y], tokenizer) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            for doc, a, c, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                parts = cut_tree(text, segment_chars)
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array([a] * n, pa.int64()), pa.array([c] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([g for _, g in parts], pa.bool_()), pa.array([t for t, _ in parts], pa.string())], names=["doc_id", "hash_a", "hash_b", "part", "glued", "text"])

    def encode_parts(batches):
        import pyarrow as pa

        for b in (b.slice(at, len(part)) for b in batches for at, part in text_slices(b.column(5), SLICE_BYTES)):
            flat, bounds = chunk_encoder(tokenizer, kept=KEPT_CHUNKS).encode_batch(b.column(5))
            ids = pa.ListArray.from_arrays(pa.array(bounds.astype("i4")), pa.array(flat.astype("i4")))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, "ids"])

    def join_document(pdf):
        import pandas as pd

        encoder, table = chunk_encoder(tokenizer, kept=KEPT_CHUNKS), byte_table(tokenizer)
        copies = int((pdf["part"] == 0).sum())
        pdf = pdf.sort_values("part").drop_duplicates("part")
        glued = pdf["glued"].tolist()
        near = [g or h for g, h in zip(glued, [*glued[1:], False], strict=True)]
        parts = [encoded_part(t, list(i), table) if n else Part(t, list(i), 0, 0, False) for t, i, n in zip(pdf["text"], pdf["ids"], near, strict=True)]
        ids = join_tree(parts, glued, encoder, table)
        text = decode_ids(ids, tokenizer)
        return pd.DataFrame({"doc_id": pd.array([pdf["doc_id"].iloc[0]] * copies, "Int64"), "ids": [ids] * copies, "decoded": [text] * copies})

    short = rows.filter(F.length("text") <= segment_chars).mapInArrow(encoded, out)
    long = rows.filter(F.length("text") > segment_chars).select("doc_id", F.xxhash64("text").alias("hash_a"), F.xxhash64(F.lit(1), "text").alias("hash_b"), "text")
    parts = long.mapInArrow(cut, "doc_id long, hash_a long, hash_b long, part int, glued boolean, text string")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(n, "doc_id", "hash_a", "part").mapInArrow(encode_parts, "doc_id long, hash_a long, hash_b long, part int, glued boolean, text string, ids array<int>")
    return short.unionByName(dealt.groupBy("doc_id", "hash_a", "hash_b").applyInPandas(join_document, out))


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Query: digests of all documents' ids and of what they decode to."""
    done = encode_decode(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
