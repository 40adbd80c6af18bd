"""Near copies are confirmed on shingles, and each document has a row."""

import random

from loamline.operators import dedup
from loamline.plans import curation


def _saved(spark, tmp_path, texts):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_short_documents_are_no_copies(spark, tmp_path):
    long = [f"w{i}" for i in range(60)]
    texts = ["alpha", "bee cat dog eel", "fox gnu", "hen ibis", None, "", " \t", " ".join(long), " ".join([*long[:-1], "other"]), "  ".join(long), "alpha ", "jay"]
    got = {r.doc_id: r.dup_of for r in curation.near_dup_keep_first(spark, _saved(spark, tmp_path, texts)).collect()}
    assert got == {i: {8: 7, 9: 7, 10: 0}.get(i) for i in range(len(texts))}


def test_copies_of_a_dropped_document(spark, tmp_path):
    w = [f"w{i}" for i in range(100)]
    got = {r.doc_id: r.dup_of for r in curation.near_dup_keep_first(spark, _saved(spark, tmp_path, [" ".join(w), " ".join(w[1:]), " ".join(w[1:]) + "\n"])).collect()}
    assert got == {0: None, 1: 0, 2: 0}


def test_longest_copy_stays(spark, tmp_path):
    w = [f"w{i}" for i in range(100)]
    texts = [" ".join(w[2:]), " ".join(w), " ".join(w[1:]), "quite another text", None]
    assert [r.doc_id for r in curation.diversity_topk(spark, _saved(spark, tmp_path, texts)).collect()] == [1, 3, 4]


def test_only_sets_that_may_be_near_are_listed_whole(spark, tmp_path, monkeypatch):
    rng, seen, walk = random.Random(5), [], dedup.keep_first_sets
    common = [f"c{i}" for i in range(12)]
    texts = [" ".join([*common, *(f"v{rng.randrange(10**9)}" for _ in range(80))]) for _ in range(60)]
    texts.append(texts[7] + " tail")
    monkeypatch.setattr(dedup, "keep_first_sets", lambda sets, *a: seen.append({r.id for r in sets.select("id").collect()}) or walk(sets, *a))
    got = {r.doc_id: r.dup_of for r in curation.near_dup_keep_first(spark, _saved(spark, tmp_path, texts)).collect()}
    assert got == {i: {60: 7}.get(i) for i in range(61)} and seen == [{7, 60}]


def test_no_near_pair_is_lost_before_sets_are_listed(spark):
    rng, sets = random.Random(8), []
    for n in [1, 2, 3, 4, 5, 6, 9, 10, 11, 20, 25, 40, 60, 100] * 6:
        base = rng.sample(range(10**9), n)
        sets += [base, rng.sample(base, max(1, -(-n * 80 // 100))), [*base, *rng.sample(range(10**9), n // 4)], [*base[: n - n // 9], *rng.sample(range(10**9), n // 9)]]
    near = {i for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and 100 * len({*x} & {*y}) >= 80 * len({*x} | {*y}) for i in (a, b)}
    rows = [(i, len(s), sorted(s)[: dedup.early(len(s), 80)]) for i, s in enumerate(sets)]
    got = {r.id for r in dedup.may_pair(spark.createDataFrame(rows, "id long, n long, s array<long>"), 80).collect()}
    assert near <= got and len(near) > 100


def test_a_near_group_is_walked_without_all_pairs(spark, monkeypatch):
    rng, sets = random.Random(3), []
    for _ in range(25):
        base = rng.sample(range(3000), rng.choice([5, 30, 60]))
        for _ in range(rng.choice([2, 6])):
            s = {*base}
            for _ in range(rng.randrange(1 + len(base) // 5)):
                s.discard(rng.choice(base))
                s.add(rng.randrange(3000))
            sets.append(sorted(s))
    large = rng.sample(range(5000, 9000), 200)
    sets += [sorted({*large} - {x} | {10_000 + i}) for i, x in enumerate(large[:100])]
    rng.shuffle(sets)
    kept, want, made, near = [], {}, [], dedup._near
    for i, s in enumerate(sets):
        want[i] = next((k for k in kept if 100 * len({*s} & {*sets[k]}) >= 80 * len({*s} | {*sets[k]})), None)
        kept += [i] * (want[i] is None)
    monkeypatch.setattr(dedup, "_near", lambda *a: made.append((found := dedup.written(near(*a))).count()) or found)
    got = {r.id: r.dup_of for r in dedup.keep_first_sets(spark.createDataFrame(list(enumerate(sets)), "id long, s array<long>"), 80).collect()}
    assert {i: d for i, d in got.items() if d is not None} == {i: d for i, d in want.items() if d is not None} and len(got) == len({*got})
    assert sum(made) < 600 and len(made) > 2
