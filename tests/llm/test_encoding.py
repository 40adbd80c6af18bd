import random
import zlib

import numpy as np
import pytest
from loamline.llm import packing, token_files
from loamline.llm.encoding import ChunkEncoder, load_tokenizer, tokenizer_path

from tests.llm.cases import DOC, TRICKY, frame, rows


@pytest.mark.parametrize(("name", "drops"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_chunks_give_the_ids_of_the_library(name, drops):
    encoder, plain = ChunkEncoder(tokenizer_path(name), drops), load_tokenizer(tokenizer_path(name))
    rng = random.Random(1)
    alphabet = ["a", "B", "é", " ", " ", "\n", "\t", "'s", "1", ".", " ", "🙂", "́", "İ", "\x1c", "<|endoftext|>"]
    texts = [t or "" for t in TRICKY] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    import pyarrow as pa

    flat, bounds = encoder.encode_batch(pa.array([*texts, None]))
    for i, t in enumerate(texts):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def _ids(name, text, end):
    return np.asarray(load_tokenizer(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_token_files_round_trip(spark, tmp_path):
    docs = rows(TRICKY + ["long " * 4000]) + [(3, "again", None, None, None), (None, "no id", None, None, None)]
    df = spark.createDataFrame(docs, DOC).selectExpr("*", "'clash' as ids").repartition(5)
    uri = f"file://{tmp_path}/out"
    shards = token_files.write_token_files(df, tokenizer_path("byte_bpe_50k.json"), 0, uri, shard_text_bytes=4000)
    assert len(shards) > 2
    got = [tuple(r) for r in token_files.read_token_files(spark, uri, shards, token_files._digest, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()]
    want = sorted(((d[0], len(_ids("byte_bpe_50k.json", d[1], 0)), zlib.crc32(_ids("byte_bpe_50k.json", d[1], 0).tobytes())) for d in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got.sort(key=lambda r: r[1])
    assert [(d, n, c) for d, _, n, c in got] == want
    assert [s for _, s, _, _ in got] == np.cumsum([0] + [n for _, n, _ in want])[:-1].tolist()
    reader = token_files.ShardReader(f"{tmp_path}/out/shard-{shards[-1][0]:08d}.tok")
    k = len(reader.doc_ids) - 1
    assert reader.document(k).tolist() == _ids("byte_bpe_50k.json", dict((d[0], d[1]) for d in docs)[reader.doc_ids[k]], 0).tolist()


def test_token_files_of_an_empty_table(spark, tmp_path):
    shards = token_files.write_token_files(frame(spark, []), tokenizer_path("byte_bpe_50k.json"), 0, f"file://{tmp_path}/none")
    assert shards == []
    assert token_files.read_token_files(spark, f"file://{tmp_path}/none", shards, token_files._digest, "doc_id long, start long, n_tokens long, ids_crc32 long").count() == 0


def test_first_fit_equals_the_plain_scan():
    rng = random.Random(2)
    for _ in range(50):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 40))), reverse=True)
        room, want = [], []
        for x in lengths:
            k = next((i for i, r in enumerate(room) if r >= x), None)
            if k is None:
                room.append(20)
                k = len(room) - 1
            want.append((k, 20 - room[k]))
            room[k] -= x
        assert list(zip(*packing.first_fit(lengths, 20), strict=True)) == want


def test_packing_keeps_every_id_once(spark):
    docs = rows(TRICKY + ["many words here " * 900]) + [(3, "again", None, None, None), (None, "no id", None, None, None)]
    df = spark.createDataFrame(docs, DOC).selectExpr("*", "1 as start", "2 as length", "3 as pack_group")
    out = packing.pack(packing.encode_pieces(df, tokenizer_path("word_bpe_49k.json"), 1, seq_len=64, group_docs=5, with_ids=True), 64).collect()
    sequences, pieces = {}, {}
    for r in out:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 256
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    whole = {k: b"".join(b for _, b in sorted(v)) for k, v in pieces.items()}
    for d, text, *_ in docs:
        ids = _ids("word_bpe_49k.json", text, 1)
        assert whole[(d, len(ids))] == ids.tobytes()


def test_packing_of_an_empty_table(spark):
    assert packing.pack(packing.encode_pieces(frame(spark, []), tokenizer_path("word_bpe_49k.json"), 1)).count() == 0


BIG = 2**60 + 1


def test_large_ids_beside_null_ids(spark, tmp_path):
    docs = [(BIG, "one two", "en", "s", 7), (None, "three", "en", "s", 5), (BIG + 1, None, None, None, None)]
    df = spark.createDataFrame(docs, DOC).coalesce(1)
    uri = f"file://{tmp_path}/big"
    shards = token_files.write_token_files(df, tokenizer_path("byte_bpe_50k.json"), 0, uri)
    read = token_files.read_token_files(spark, uri, shards, token_files._digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
    assert [r.doc_id for r in read.orderBy("start").collect()] == [None, BIG, BIG + 1]
    packed = packing.pack(packing.encode_pieces(df, tokenizer_path("word_bpe_49k.json"), 1)).collect()
    assert sorted(r.doc_id or 0 for r in packed) == [0, BIG, BIG + 1] and len({r.sequence_id for r in packed}) == 1


def test_id_width_fits_the_tokenizer(spark, tmp_path):
    df, name = frame(spark, ["a b", "c"]), tokenizer_path("byte_bpe_50k.json")
    with pytest.raises(ValueError, match="don't fit"):
        token_files.write_token_files(df, name, 70_000, f"file://{tmp_path}/narrow", width=2)
    uri = f"file://{tmp_path}/wide"
    shards = token_files.write_token_files(df, name, 70_000, uri)
    reader = token_files.ShardReader(f"{tmp_path}/wide/shard-{shards[0][0]:08d}.tok")
    assert reader.width == 4 and [reader.document(k).tolist()[-1] for k in range(2)] == [70_000, 70_000]


def test_very_long_text(spark, tmp_path):
    long = " ".join(f"w{k % 5000}" for k in range(300_000))
    df = frame(spark, [long, "short"])
    uri = f"file://{tmp_path}/long"
    shards = token_files.write_token_files(df, tokenizer_path("byte_bpe_50k.json"), 0, uri)
    rows_ = token_files.read_token_files(spark, uri, shards, token_files._digest, "doc_id long, start long, n_tokens long, ids_crc32 long").orderBy("doc_id").collect()
    ids = _ids("byte_bpe_50k.json", long, 0)
    assert (rows_[0].n_tokens, rows_[0].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    packed = packing.pack(packing.encode_pieces(df, tokenizer_path("word_bpe_49k.json"), 1)).filter("doc_id = 0")
    n = len(_ids("word_bpe_49k.json", long, 1))
    assert sum(r.length for r in packed.collect()) == n
