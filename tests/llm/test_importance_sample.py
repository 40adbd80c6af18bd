"""Importance sample against a plain version, with long runs, ties, nulls and repeated rows."""

import hashlib
import math
import random
import re
import zlib

import pytest
from loamline.llm import importance_sample as imp

SCHEMA = "doc_id long, text string, score string, rank int"


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_runs(text, low, high):
    words = plain_words(text)
    return [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, low, high, buckets, percent, least):
    place = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for hist, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for x in plain_runs(text, low, high):
                hist[place(x)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text, *_ in rows:
        own = [gain[place(x)] for x in plain_runs(text, low, high)]
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(own) // len(own) if own else 0
        out.append([i, len(plain_words(text)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    for k, x in enumerate(able[: len(able) * percent // 100]):
        x[5] = k + 1
    return sorted(map(str, map(tuple, out)))


@pytest.mark.parametrize(("low", "high", "buckets"), [(1, 1, 97), (1, 3, 70_000), (2, 2, 50)])
def test_equals_plain_version(spark, low, high, buckets):
    rng = random.Random(3)
    word = lambda: rng.choice(["Ab", "é", "x1", "ÄB", "zz", "日本", "q"]) + rng.choice(["", "s", "9"])
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.randrange(0, 60))), "x", 1) for i in range(80)]
    rows += [rows[4], rows[4], (None, rows[5][1], None, None), (200, None, "x", 1), (201, "", "x", 1), (202, " ._-\x00", "x", 1), (203, "one", "x", 1), (204, "Word, " * 60_000, "x", 1), (205, "y" * 100_000, "x", 1)]
    target = [" ".join(word() for _ in range(50)) for _ in range(5)] + [None, ""]
    found = imp.sample(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(t,) for t in target], "text string"), low, high, buckets, percent=30, least_words=5)
    got = [(r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()]
    assert sorted(map(str, got)) == plain(rows, target, low, high, buckets, 30, 5)


def test_pieces_end_between_words():
    split = imp.splitter()
    text = "one two,three  four five " * 3_000
    assert "".join(imp.pieces(text, 100)) == text
    for high in (1, 4):
        assert sorted(x for _, f in imp.runs(split, text, 1, high) for x in f) == sorted(plain_runs(text, 1, high))


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert imp.sample(docs, target).count() == 0
    some = spark.createDataFrame([(1, "a b c " * 20, "x", 1)], SCHEMA)
    assert [(r.n_features, r["rank"]) for r in imp.sample(some, target).collect()] == [(60, None)]
