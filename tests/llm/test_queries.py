"""The registered queries over whole small tables: against their SQL, or against the libraries."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from loamline.llm import queries
from loamline.llm.encoding import load_tokenizer, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == cols
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, want.select(", ".join(cols)).fetchall()))


def test_token_files(spark, docs):
    plain, want, at = load_tokenizer(tokenizer_path("byte_bpe_50k.json")), [], 0
    for d, t in docs:
        ids = np.asarray([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.QUERIES["op1_token_files"](spark, SF).collect())) == want


def test_bpe(spark, docs):
    plain = load_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(d, len(ids), sha(",".join(map(str, ids))), sha(plain.decode(ids, skip_special_tokens=False))) for d, t in docs for ids in [plain.encode(t, add_special_tokens=False).ids]]
    assert sorted(map(tuple, queries.QUERIES["op4_bpe"](spark, SF).collect())) == want


def test_packing(spark, docs):
    plain, got = load_tokenizer(tokenizer_path("word_bpe_49k.json")), {}
    rows = queries.QUERIES["op9_packing"](spark, SF).collect()
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for d, t in docs:
        ids, at = np.asarray([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4"), 0
        for start, length, crc, n in sorted(got[d]):
            assert start == at and n == len(ids) and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)
    used = sum(r.length for r in rows)
    assert used > 0.97 * 2048 * len({r.sequence_id for r in rows})


def test_every_query_gives_a_row_for_each_document(spark, docs):
    for name in ("op6_quality_classifier", "op7_lm_scoring", "op8_toxicity", "op10_fingerprints"):
        assert sorted(r.doc_id for r in queries.QUERIES[name](spark, SF).select("doc_id").collect()) == [d for d, _ in docs]
