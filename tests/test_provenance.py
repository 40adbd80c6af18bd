import pytest
from loamline.functions import sources as so
from loamline.operators import dedup
from loamline.plans import provenance as pv
from pyspark.sql import functions as F


def _one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_media_licences(spark):
    by, zero, nc = "http://creativecommons.org/licenses/by/4.0/", "https://creativecommons.org/publicdomain/zero/1.0/", "http://creativecommons.org/licenses/by-nc/4.0/"
    rows = [(nc, zero), (None, zero), ("", "CC_BY_4_0"), (by, nc), ("cc0_1_0", None), (None, nc), (None, None)]
    assert _one(spark, rows, "m string, o string", so.media_license(F.col("m"), F.col("o"))) == [None, "CC0_1_0", "CC_BY_4_0", "CC_BY_4_0", "CC0_1_0", None, None]
    credit = so.attribution(F.col("c"), F.col("i"), F.col("a"), F.col("b"))
    assert _one(spark, [("CC0_1_0", 5, "", "me"), ("CC_BY_4_0", 6, None, None)], "c string, i long, a string, b string", credit) == ["© me, licensed CC0-1.0 (via GBIF, occurrence 5)", "© unknown, licensed CC-BY-4.0 (via GBIF, occurrence 6)"]


def test_dates_places_and_names(spark):
    assert _one(spark, [("2021-06-14T11:23:15",), ("2021-06-14/2021-06-15",), ("",), (None,)], "d string", so.event_date(F.col("d"))) == ["2021-06-14", "2021-06-14", None, None]
    places = [(0.0, 0.0), (0.0, 1e-3), (float("nan"), 1.0), (float("inf"), 1.0), (91.0, 1.0), (90.0, -180.0), (None, 1.0)]
    assert _one(spark, places, "a double, b double", so.usable_place(F.col("a"), F.col("b"))) == [False, True, False, False, False, True, False]
    names = so.committed_name(F.col("t"), F.lit("ivy"), F.col("i"), F.col("e"))
    assert _one(spark, [("a b-ü.c", 7, "JPEG"), ("x", 12345, "png")], "t string, i int, e string", names) == ["qa_a_b-ü_c_ivy_0007.jpg", "qa_x_ivy_12345.png"]


def test_exact_leak_beats_near_and_held_out_beats_pool(spark):
    one = 0b1011 << 40
    ref = [(0, "held_out:a", "d1", one, one, 100), (1, "held_out:b", "d2", one ^ 1, one, 101), (2, "pool:c", "d3", -1, -1, 102), (3, "pool:d", "d3", 7, 7, 103), (4, "pool:e", "d5", 1 << 55, 1 << 55, 104)]
    staged = [(1, "d3", one, one), (2, "x", one ^ 3, one), (3, "x", one ^ 31, one ^ 31), (4, "x", one ^ 63, one), (5, "x", one, one ^ 63), (6, None, None, None), (7, "d2", 1 << 62, 0), (8, "x", 1 << 55, (1 << 55) + 1)]
    # Hashes of 8 and 104 are near, but their texts have nothing in common.
    docs = [(i, "a b c d e f") for i in (1, 2, 3, 4, 5, 100, 101)] + [(7, "g"), (8, "one two"), (102, "h"), (103, "i"), (104, "three four")]
    fields = "digest string, level long, step long, rep long"
    got = pv.leak_matches(spark.createDataFrame([(*s, s[0]) for s in staged], f"doc_id long, {fields}"), spark.createDataFrame(ref, f"ord long, origin string, {fields}"), spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.kind, r.origin) for r in got} == {1: ("exact", "pool:c"), 2: ("near", "held_out:a"), 3: ("near", "held_out:a"), 4: ("near", "held_out:b"), 7: ("exact", "held_out:b")}


def test_matches_equal_all_pairs(spark):
    import random

    rng = random.Random(4)
    flip = lambda h, n: h ^ sum(1 << b for b in rng.sample(range(63), n))
    base = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(15)]
    rows = [(i, flip(a, rng.randrange(8)), flip(b, rng.randrange(7))) for i, (a, b) in enumerate(base * 5)]
    df = spark.createDataFrame(rows, "id long, p long, q long")
    bits = lambda x, y: bin(x ^ y).count("1")
    want = {(i, j) for i, a, b in rows for j, c, d in rows if bits(a, c) <= 5 and bits(b, d) <= 5}
    for spare in (1, 3, None):
        got = [(r.l.id, r.r.id) for r in dedup.hamming_matches(df, df, ("p", "q"), 5, spare).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > len(rows)


@pytest.mark.parametrize("name", ["leak_report", "crossclass_near", "shape_gate", "attribution_summary"])
def test_nulls_and_empty_tables(spark, tmp_path, name):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for k, rows in enumerate(([], [(0, None, None, None, None), (1, "", "en", "a", 0), (2, "x", None, "b", 1), (3, "x", "en", None, 1)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        out = pv.QUERIES[name](spark, f"{tmp_path}/{k}").collect()
        assert len(out) == {"shape_gate": len(rows), "attribution_summary": 1}.get(name, len(out))
