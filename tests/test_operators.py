import pytest
import math
import random

from loamline.operators import dedup, metrics, series
from loamline.sources import manifests
from pyspark.sql import functions as F


def test_hamming_pairs_equal_all_pairs(spark):
    rng = random.Random(1)
    hashes = [rng.getrandbits(64) - 2**63 for _ in range(40)]
    for h in list(hashes):
        for _ in range(4):
            x = h
            for _ in range(rng.randint(0, 7)):
                x ^= 1 << rng.randrange(63)
            hashes.append(x)
    rows = list(enumerate(hashes))
    classes = dedup.hash_classes(spark.createDataFrame(rows, "id long, h long"), "id", "h")
    first = {}
    for i, h in rows:
        first.setdefault(h, i)
    want = {(a, b, d) for h, a in first.items() for g, b in first.items() if a < b and (d := bin((h ^ g) & (2**64 - 1)).count("1")) <= 5}
    got = [tuple(r) for r in dedup.hamming_pairs(classes, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_keep_first_equals_the_walk(spark):
    rng = random.Random(2)
    for _ in range(3):
        links = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
        near, kept, want = {}, set(), {}
        for a, b in links:
            near.setdefault(b, set()).add(a)
        for i in range(40):
            hits = near.get(i, set()) & kept
            want[i] = min(hits) if hits else None
            if not hits:
                kept.add(i)
        got = dedup.keep_first(spark.range(40), spark.createDataFrame(links, "a long, b long"))
        assert {r.id: r.dup_of for r in got.collect()} == want


def test_chain_keeps_the_third(spark):
    got = dedup.keep_first(spark.range(3), spark.createDataFrame([(0, 1), (1, 2)], "a long, b long"))
    assert {r.id: r.dup_of for r in got.collect()} == {0: None, 1: 0, 2: None}


def test_refractory_and_ema(spark):
    rows = [(1, i, i, float(v)) for i, v in enumerate([0, 1, 2, 1, 0, 1, 2, 1, 0])]
    df = spark.createDataFrame(rows, "user_id int, event_id long, t long, value double")
    picked = series.refractory(df, "user_id", ["t"], "t", 4).filter("picked = 1")
    assert [r.t for r in picked.orderBy("t").collect()] == [0, 4, 8]
    ema = [r.ema for r in series.ema(df, "user_id", ["t"], "value", 0.5).orderBy("t").collect()]
    want, s = [], None
    for r in rows:
        s = r[3] if s is None else 0.5 * r[3] + 0.5 * s
        want.append(s)
    assert ema == want


def test_fold_keeps_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(200).select((F.col("id") % 2).alias("user_id"), F.col("id").alias("event_id"), F.col("id").alias("t"), F.lit(1.0).alias("value"))
        n = series.ordered_fold(df, "user_id", ["t"], ["value"], "n", lambda: 0.0, lambda s, x: (s + x, s + x))
        assert n.groupBy("user_id").agg(F.max("n").alias("m")).filter("m = 100").count() == 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_auroc(spark):
    area = lambda rows: metrics.auroc(spark.createDataFrame(rows, "s double, p boolean"), F.col("s"), F.col("p")).first().auroc
    assert area([(1.0, True), (1.0, False)]) == 0.5
    assert area([(2.0, True), (1.0, False)]) == 1.0
    assert math.isnan(area([(2.0, True)]))  # the reference rule: undefined without both kinds


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.0, 0, 0), (0.3, 0, 0), (1.0, 0, 0)], "conf double, y int, pred int")
    assert sorted(r.bin for r in metrics.calibration_bins(df).collect() if r.n) == [0, 2, 9]


def test_manifests(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"path": "x/1.jpg", "class": " ", "label": "oak"}\nbroken\n{"path": "y/1.jpg", "license": "cc0", "ord": 2}\n')
    (tmp_path / "b.csv").write_text("file,class,ord\nz/2.jpg,ivy,3\n")
    both = manifests.union_manifests(manifests.read_manifest(spark, str(tmp_path / "a.jsonl")), manifests.read_manifest(spark, str(tmp_path / "b.csv")).withColumn("ord", F.col("ord").cast("long")))
    got = {r.name: r for r in manifests.reconcile(both.withColumn("ord", F.coalesce("ord", F.lit(1))), "ord").collect()}
    assert got["1.jpg"].path == "y/1.jpg" and got["1.jpg"].license == "cc0" and got["1.jpg"].n_rows == 2
    assert got["2.jpg"].cls == "ivy"


def test_keep_first_decides_long_chains(spark):
    n = 13
    got = dedup.keep_first(spark.range(n), spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long"))
    assert {r.id: r.dup_of for r in got.collect()} == {i: i - 1 if i % 2 else None for i in range(n)}


def test_set_pairs_equal_all_pairs(spark):
    rng = random.Random(6)
    sets = [[]]
    for _ in range(12):
        base = rng.sample(range(400), rng.choice([1, 4, 30, 60]))
        for _ in range(8):
            s = set(base)
            for _ in range(rng.randrange(1 + len(base) // 4)):
                s.discard(rng.choice(base))
                s.add(rng.randrange(500))
            sets.append(sorted(s))
    df = spark.createDataFrame(list(enumerate(sets)), "id long, s array<long>")
    for percent in (80, 50):
        want = {(a, b, len(set(x) & set(y))) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and x and y and 100 * len(set(x) & set(y)) >= percent * len(set(x) | set(y))}
        assert {tuple(r) for r in dedup.set_pairs(df, percent).collect()} == want and len(want) > 20


def test_as_of_takes_rows_of_equal_time(spark):
    rows = [(1, "a", 10, "q", 1.0), (2, "a", 10, "v", None), (3, "a", 9, "v", 3.0), (4, "b", 5, "q", 0.0), (5, "a", 11, None, 1.0), (6, "b", 6, "v", 1.0)]
    df = spark.createDataFrame(rows, "event_id long, k string, t long, kind string, x double")
    got = series.as_of(df, "k", "t", F.col("kind") == "q", F.col("kind") == "v", ["event_id", "x"]).collect()
    assert {r.event_id: (r.prev_event_id, r.prev_x) for r in got} == {1: (2, None), 4: (None, None)}


def test_running_sums_by_ranges(spark):
    from loamline.operators import ranks

    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.randrange(50), i, rng.randrange(5)) for i in range(400)] + [(None, 3, 900, 2), (None, 1, 901, 4)]
    df = spark.createDataFrame(rows, "k string, o long, i long, n long")
    for ranges in (1, 7, 64):
        got = {r.i: (r.before, r.total) for r in ranks.running(df, "k", F.col("o"), ["i"], F.col("n"), ranges).collect()}
        want = {i: (sum(m for g, p, j, m in rows if g == k and (p, j) < (o, i)), sum(m for g, _, _, m in rows if g == k)) for k, o, i, _ in rows}
        assert got == want


def test_a_broken_split_is_an_error(spark):
    from loamline.plans import curation

    good = spark.createDataFrame([("s", "g", "a", True), ("s", "g", "b", True), ("s", "h", "c", False)], "source string, grp string, name string, val boolean")
    assert tuple(curation.overlap(good).first()) == (2, 0, 1, 2)
    assert curation.assert_disjoint(good).count() == 3
    broken = good.union(spark.createDataFrame([("s", "g", "d", False)], good.schema))
    assert tuple(curation.overlap(broken).first()) == (2, 1, 2, 2)
    with pytest.raises(Exception, match="both sides: s/g"):
        curation.assert_disjoint(broken).collect()
