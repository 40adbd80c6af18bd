"""SimHash against a plain version; short unrelated texts are never near."""

import re
import hashlib

import pytest
from loamline.operators import simhash
from loamline.plans import curation, provenance

LONG = " ".join(f"w{i}" for i in range(60))
#: Short texts without a common word, three to a third of the table each, and a copy with white space changed.
TEXTS = ["alpha beta", "gamma delta epsilon", "zeta", "eta theta", "iota kappa lambda", "mu nu", "xi omicron pi", "rho sigma", "tau upsilon phi"]


def plain(text, at):
    words = text.split()
    runs = {" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))}
    sums = [0] * 64
    for r in runs:
        h = int(hashlib.md5(r.encode()).hexdigest()[at : at + 16], 16)
        for i in range(64):
            sums[i] += 1 if h >> i & 1 else -1
    x = sum(1 << i for i in range(64) if sums[i] > 0)
    return x - (1 << 64) if x >> 63 else x


def test_bits(spark):
    texts = [*TEXTS, LONG, LONG + " x y", "a a a a a a b", "é  ü\n\tß"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, " \n")]
    got = {r.doc_id: (r.level, r.step) for r in simhash.simhashes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (plain(t, 0), plain(t, 16)) for i, t in enumerate(texts)}


@pytest.fixture
def sf(spark, tmp_path):
    """Nine unrelated short texts, then a long one with near copies in other thirds and sources."""
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(TEXTS)]
    rows += [(12, LONG, "en", "s0", 9), (13, LONG.replace(" ", "  "), "en", "s1", 9), (15, LONG + " zz", "en", "s1", 9), (16, "zz " + LONG, "en", "s1", 9), (17, None, "en", "s1", 0), (18, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_short_texts_are_not_near(spark, sf):
    assert all(r.doc_id >= 12 and r.origin.endswith(("13", "16")) for r in provenance.leak_report(spark, sf).collect())
    assert [r.doc_id for r in provenance.crossclass_near(spark, sf).collect() if r.doc_id < 12] == []
    kept = {r.doc_id for r in provenance.fetch_dedup(spark, sf).collect()}
    assert kept >= {i for i in range(9) if i % 3 != 1} and not kept & {12, 15}
    assert all(min(r.a, r.b) >= 12 for r in curation.near_pairs_hash(spark, sf).collect())
    assert provenance.audit_leakage(spark, sf).count() == 0
    assert {r.doc_id for r in provenance.leak_report(spark, sf).collect()} == {12, 15}


def test_confirmed_needs_shared_shingles(spark):
    docs = spark.createDataFrame([(1, LONG), (2, LONG + " x"), (3, "other words " * 30)], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 3)], "a long, b long")
    assert sorted(map(tuple, simhash.confirmed(pairs, docs).collect())) == [(1, 2), (3, 3)]


def test_bits_are_counted_without_a_shuffle(spark):
    """Bits by a plain count, for texts of other white space, few words and repeated shingles; a document is hashed where it is read."""
    import hashlib

    texts = {1: "a b é\x0bc\td\r\n e  f", 2: "one", 3: " \t", 4: None, 5: "x y z x y z x y z x y z w", 6: "\U0001f600 b c d e " * 50}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = simhash.simhashes(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, text in texts.items():
        if words := [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]:
            grams = {" ".join(words[k : k + 4]) for k in range(max(len(words) - 3, 1))}
            digests = [int(hashlib.md5(g.encode()).hexdigest(), 16) for g in grams]
            bits = sum(1 << k for k in range(128) if 2 * sum(d >> k & 1 for d in digests) > len(digests))
            want[i] = tuple(x - (1 << 64) if x >> 63 else x for x in (bits >> 64, bits & (1 << 64) - 1))
    assert {r.doc_id: (r.level, r.step) for r in found.collect()} == want


def test_keys_of_two_blocks_find_the_same_pairs(spark, monkeypatch):
    import random

    from loamline.operators import dedup

    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(40)]
    near = [(i, h ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(8)))) for i, h in enumerate(base * 4)]
    df = spark.createDataFrame(near, "rep long, h long")
    want = {(a, b) for a, x in near for b, y in near if a < b and (x ^ y).bit_count() <= 5}
    assert {(r.a, r.b) for r in dedup.hamming_pairs(df, 5, 2).collect()} == want
    monkeypatch.setattr(dedup, "SOME_HASHES", 100)
    assert dedup._spare(df) == 2
