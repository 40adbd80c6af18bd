import random

import numpy as np
from loamline.llm import minhash_dedup as md
from loamline.llm.components import connected_components
from pyspark.sql import functions as F

from tests.llm.cases import DOC, TRICKY, frame, rows


def _lower(t):
    return (t or "").encode().lower().split()


def _sets(docs, width):
    out = []
    for d in docs:
        w = _lower(d[1])
        out.append((d[0], {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()))
    return out


def _components(docs, width, percent):
    sets, parent = _sets(docs, width), {d[0]: d[0] for d in docs if d[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, s) for i, s in sets if i is not None]
    for i, (u, a) in enumerate(sets):
        for v, b in sets[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(u), root(v)))
                parent[y] = x
    return {x: root(x) for x in parent}


def _edited(words, rng, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    texts = list(TRICKY)
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 30, 200, 900]))]
        texts += [_edited(base, rng, rng.randrange(1 + len(base) // 25)) for _ in range(rng.randint(2, 14))]
        texts += [" ".join(base)] * rng.choice([0, 5])
    base = [f"c{i}" for i in range(300)]
    texts += [" ".join(base[k * 6 : k * 6 + 200]) for k in range(12)]  # a chain: neighbours are alike, ends aren't
    rng.shuffle(texts)
    docs = rows(texts) + [(3, texts[-1], None, None, None), (None, texts[0], None, None, None), (7, texts[7], None, None, None)]
    want = _components(docs, 4, 80)
    df = spark.createDataFrame(docs, DOC).withColumn("component_id", F.lit("x")).withColumn("bands", F.lit(1)).repartition(6)
    got = md.near_duplicates(df, 4, 80).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    kept = md.drop_near_duplicates(df, 4, 80)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for c in want.values()})


def test_pairs_are_tried_when_a_leader_repeats(spark, monkeypatch):
    monkeypatch.setattr(md.F, "xxhash64", lambda node, turn: F.col(node))  # the smallest id leads in each turn
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (4000, 3998, 3199)]  # similarities 0.9995, 0.79975, 0.80015
    got = md.near_duplicates(frame(spark, texts), 1, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 0}


def test_empty(spark):
    assert md.near_duplicates(frame(spark, []), 5, 80).count() == 0
    assert md.near_duplicates(frame(spark, [None, "", " "]), 5, 80).filter("doc_id = component_id").count() == 3


def test_estimate_is_close(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(words), _edited(words, rng, 40), _edited(words, rng, 120), " ".join(f"v{i}" for i in range(2000))]
    low = {r.doc_id: r.low for r in md.signatures(frame(spark, texts), 4).collect()}
    sets = [s for _, s in _sets(rows(texts), 4)]
    for k in (1, 2, 3):
        true = len(sets[0] & sets[k]) / len(sets[0] | sets[k])
        got = spark.createDataFrame([(low[0], low[k])], "a array<long>, b array<long>").select(md.estimate(F.col("a"), F.col("b"))).first()[0]
        assert abs(got - true) < 0.11


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(1000, 1001)], "u long, v long")
    out = {r.node: r.component for r in connected_components(edges).collect()}
    assert set(out.values()) == {0, 1000} and len(out) == 503


def test_members_apart_from_their_leader(spark):
    """A group around one text, another around a text alike, and texts that share a bucket with them unlinked."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    other = _edited(base, rng, 4).split()
    texts = [_edited(base, rng, rng.randrange(14)) for _ in range(90)] + [_edited(other, rng, rng.randrange(14)) for _ in range(60)]
    texts += [" ".join(base[: 150 - k]) for k in range(0, 60, 3)]
    edits = [(rng.randrange(150), f"e{k}") for k in range(12)]  # members that share differences from the others
    for _ in range(40):
        w = list(base)
        for at, word in rng.sample(edits, 9):
            w[at] = word
        texts.append(_edited(w, rng, rng.randrange(3)))
    texts.append("long " + " ".join(f"l{i % 9000}" for i in range(300_000)))
    rng.shuffle(texts)
    docs = rows(texts)
    got = {r.doc_id: r.component_id for r in md.near_duplicates(frame(spark, texts), 4, 80).collect()}
    want = _components(docs, 4, 80)
    assert got == want and len(set(want.values())) > 20


def test_pairs_at_the_bound_are_candidates():
    rng, signer = np.random.default_rng(5), md.Signer(md.BANDS, md.ROWS, md.BITS)
    missed = under = 0
    for _ in range(2000):
        h = rng.integers(0, 1 << 63, 100, dtype="u8")
        (a, x), (b, y) = signer.sign(np.sort(h[:90])), signer.sign(np.sort(h[10:]))
        missed += not (a == b).any()
        z = (x ^ y).view("u8")
        z = (z | (z >> np.uint64(1))) & np.uint64(0x5555555555555555)
        equal = 1 - int(np.bitwise_count(z).sum()) / (md.BANDS * md.ROWS)
        under += (equal - 0.25) / 0.75 < 0.8 - md.MARGIN
    assert missed == 0 and under == 0
