import random

from loamline.llm import bpe
from loamline.llm.encoding import chunk_encoder, load_tokenizer, tokenizer_path

from tests.llm.cases import DOC, TRICKY, frame, rows

PATH = tokenizer_path("byte_bpe_50k.json")


def _long(rng):
    pools = ["abcdeTHEing", "日本語学校漢字", "0123456789", "!?#$%*", "éüßñ", "aab", "the"]
    out = []
    for _ in range(rng.randint(1, 6)):
        pool = rng.choice(pools)
        out.append("".join(rng.choice(pool) for _ in range(rng.randint(1, 900))))
        out.append(rng.choice(["", " ", "\n", "  ", "'s", " \n ", "<|endoftext|>", "\t"]))
    return "".join(out)


def test_trees_give_the_ids_of_the_library():
    rng, encoder, plain, table = random.Random(5), chunk_encoder(PATH), load_tokenizer(PATH), bpe.byte_table(PATH)
    texts = [_long(rng) for _ in range(150)] + ["a" * 3000, "ab" * 2000, " " * 3000, "漢" * 2000, "the" * 999, "x'" * 900]
    joined = 0
    for t in texts:
        for most in (60, 200):
            parts = bpe.cut_tree(t, most)
            assert "".join(x for x, _ in parts) == t
            joined += sum(g for _, g in parts)
            made = [bpe.encoded_part(x, plain.encode(x, add_special_tokens=False).ids, table) for x, _ in parts]
            ids = bpe.join_tree(made, [g for _, g in parts], encoder, table)
            assert ids == plain.encode(t, add_special_tokens=False).ids, repr(t[:80])
    assert joined > 1000


def test_rows_equal_the_library(spark):
    rng, plain = random.Random(6), load_tokenizer(PATH)
    docs = rows(TRICKY + [_long(rng) for _ in range(40)]) + [(20, "x" * 700, None, None, None)] * 2 + [(None, "y" * 700, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(docs, DOC).selectExpr("*", "1 as ids", "2 as part", "'z' as decoded")
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in bpe.encode_decode(df, PATH, segment_chars=200).collect()), key=str)
    want = sorted(((d[0], (ids := plain.encode(d[1] or "", add_special_tokens=False).ids), plain.decode(ids, skip_special_tokens=False)) for d in docs), key=str)
    assert got == want


def test_decoding_of_broken_sequences():
    plain, rng = load_tokenizer(PATH), random.Random(7)
    for _ in range(300):
        ids = [rng.randrange(256) for _ in range(rng.randint(0, 12))]
        assert bpe.decode_ids(ids, PATH) == plain.decode(ids, skip_special_tokens=False)


def test_empty(spark):
    assert bpe.encode_decode(frame(spark, []), PATH).count() == 0
