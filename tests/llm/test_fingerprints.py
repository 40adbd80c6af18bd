import hashlib
import re

import xxhash
from loamline.llm import fingerprints as fp
from pyspark.sql import functions as F

from tests.llm.cases import DOC, TRICKY, frame, rows


def test_next_row_and_edited_text_equal_plain_python(spark, monkeypatch):
    texts = TRICKY + [f"words of document number {i} " * (i % 7) for i in range(60)]
    docs = rows(texts) + [(3, "again", None, None, None), (3, "again", None, None, None), (None, "no id", None, None, None)]
    df = spark.createDataFrame(docs, DOC).withColumn("part", F.lit("x")).withColumn("sketch", F.lit(1))
    order = sorted(docs, key=lambda d: (-(d[0] if d[0] is not None else -(2**63)), d[1] or ""))
    got = sorted(map(tuple, fp.with_next(df, range_bytes=900).select("doc_id", "text", "next_text").collect()), key=str)
    want = sorted(((d[0], d[1] or "", order[(i + 1) % len(order)][1] or "") for i, d in enumerate(order)), key=str)
    assert got == want


def test_query(spark, tmp_path):
    texts = TRICKY + ["one two three four five six seven eight nine ten " * 3, "one two three four five six seven eight nine ten " * 3]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in fp.op10_fingerprints(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1] or ""
        k = len(t) // 3
        assert out[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
        assert out[i].n_chars == len(t) and 0 <= out[i].near_edited <= 1 and 0 <= out[i].near_next <= 1
    last = len(texts) - 1
    assert out[last].fingerprint == out[last - 1].fingerprint and out[last].near_next == 1


def test_empty_and_single(spark):
    assert fp.with_next(frame(spark, [])).count() == 0
    assert [tuple(r) for r in fp.with_next(frame(spark, ["a b"])).select("text", "next_text").collect()] == [("a b", "a b")]


def test_estimates_follow_exact_values(spark):
    a = [f"w{i}" for i in range(4000)]
    df = spark.createDataFrame([(1, " ".join(a), " ".join(a[:1000]), " ".join(a[2000:] + [f"v{i}" for i in range(2000)]))], "id int, a string, part string, other string")
    s = {c: fp.sketch(F.col(c)) for c in ("a", "part", "other")}
    r = df.select(fp.containment(s["part"], s["a"]).alias("inside"), fp.containment(s["a"], s["part"]).alias("outside"), fp.likeness(s["a"], s["other"]).alias("like"), (fp.merge(F.array(s["a"], s["part"])) == s["a"]).alias("merged")).first()
    assert r.inside == 1 and abs(r.outside - 0.25) < 0.05 and abs(r.like - 1 / 3) < 0.06 and r.merged


def _sketch(text):
    """The sketch from its definition."""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    if not w:
        return []
    hashes = set()
    for i in range(max(1, len(w) - fp.WIDTH + 1)):
        h = 42
        for x in w[i : i + fp.WIDTH] if len(w) >= fp.WIDTH else [" ".join(w)]:
            h = xxhash.xxh64_intdigest(x.encode(), seed=h)
        hashes.add(h & ((1 << fp.HASH_BITS) - 1))
    low = sorted(h for h in hashes if h < (1 << fp.HASH_BITS) // fp.ONE_IN)
    return low or [~min(hashes)]


def _like(a, b):
    return 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))


def test_fingerprints_equal_brute_force(spark, tmp_path):
    rng = __import__("random").Random(7)
    ascii_ = [t for t in TRICKY if t is None or t.isascii()]
    texts = ascii_ + [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(60))) for _ in range(60)] + [" ".join(f"long{k % 7001}" for k in range(200_000))]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in fp.op10_fingerprints(spark, str(tmp_path)).collect()}
    shown = lambda s: "".join(("~%010x" % ~h) if h < 0 else "%010x" % h for h in s)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1] or ""
        k = len(t) // 3
        own, edited, after = _sketch(t), _sketch(t[: len(t) - k] + nxt[:k]), _sketch(nxt)
        assert (out[i].fingerprint, out[i].edited_fingerprint) == (shown(own), shown(edited)), repr(t[:80])
        assert abs(out[i].near_edited - _like(own, edited)) < 1e-12 and abs(out[i].near_next - _like(own, after)) < 1e-12
