import math
import random
import zlib
from collections import Counter

from loamline.llm import kneser_ney as kn
from pyspark.sql import functions as F

from tests.llm.cases import DOC, TRICKY, frame, rows


def _tokens(t):
    return [*(t or "").encode().lower().split(), b"\n"]


def _plain(train, texts):
    """The model from its formulas."""
    pair, word = Counter(), Counter()
    for t in train:
        w = _tokens(t)
        word.update(w)
        pair.update(zip([None, *w], w, strict=False))
    after = Counter(w for _, w in pair)
    total, kinds = Counter(), Counter()
    for (h, _), c in pair.items():
        total[h] += c
        kinds[h, min(c, 3)] += 1
    of = lambda xs: kn.discounts(*(sum(c == k for c in xs) for k in (1, 2, 3, 4)))
    dp, dw, n, v = of(pair.values()), of(after.values()), sum(word.values()), len(word)
    rest = sum(dw[min(c, 3)] for c in after.values()) / len(pair) if pair else 1.0
    out = []
    for t in texts:
        w, base, own = _tokens(t), 0.0, 0.0
        for h, x in zip([None, *w], w, strict=False):
            base += math.log10((word[x] + 0.1) / (n + 0.1 * (v + 1)))
            p = (max(after[x] - dw[min(after[x], 3)], 0) / len(pair) if pair else 0) + rest / (v + 1)
            if total[h]:
                p = max(pair[h, x] - dp[min(pair[h, x], 3)], 0) / total[h] + p * sum(dp[k] * kinds[h, k] for k in (1, 2, 3)) / total[h]
            own += math.log10(p)
        out.append((len(w), sum(word[x] > 0 for x in w), base, own))
    return n, out


def test_scores_equal_the_formulas(spark, tmp_path):
    rng = random.Random(8)
    texts = TRICKY + [" ".join(rng.choice(["the", "of", "x", f"w{rng.randrange(60)}", f"W{rng.randrange(9)}"]) for _ in range(rng.randint(0, 120))) for _ in range(120)]
    docs = rows(texts) + [(3, "again the of", None, None, None), (None, "no id the", None, None, None)]
    held = [zlib.crc32(("" if d[0] is None else str(d[0])).encode()) % 10 == 0 for d in docs]
    df = spark.createDataFrame(docs, DOC).selectExpr("*", "1 as score", "'x' as slot").withColumn("held_out", kn.crc_fold(F.col("doc_id"), 10) == 0).repartition(4)
    for shard_tokens in (300, 10**6):
        model = kn.train(df.filter("not held_out"), f"file://{tmp_path}/{shard_tokens}", slot_bytes=2000, shard_tokens=shard_tokens)
        assert len(model.word_sizes) > 4 and (len(model.shards.hot) > 1) == (shard_tokens == 300)
        n, want = _plain([d[1] for d, h in zip(docs, held, strict=True) if not h], [d[1] for d in docs])
        got = kn.score(df, model).collect()
        assert model.tokens == n and len(got) == len(docs)
        key = lambda r: (str(r[0]), r[1], r[2], r[3], round(r[4], 6))
        a = sorted(map(tuple, got), key=key)
        b = sorted(((d[0], h, *x) for d, h, x in zip(docs, held, want, strict=True)), key=key)
        for x, y in zip(a, b, strict=True):
            assert x[:4] == y[:4] and abs(x[4] - y[4]) < 1e-6 and abs(x[5] - y[5]) < 1e-6


def test_frequent_word_with_one_follower(spark, tmp_path):
    train = ["hot next"] * 40 + ["a b c d", "b a d next", "c c a"]
    texts = [f"hot {w}" for w in ("hot", "next", "a", "b", "c", "d", "unseen")] + ["hot", "next hot"]
    for shard_tokens in (7, 10**6):
        model = kn.train(frame(spark, train), f"file://{tmp_path}/{shard_tokens}", shard_tokens=shard_tokens)
        sizes = [model.shard_sizes.get(s, 0) for s in range(model.shards.n_ranges, model.shards.total)]
        assert (0 in sizes) == (shard_tokens == 7)
        want = _plain(train, texts)[1]
        got = kn.score(frame(spark, texts).withColumn("held_out", F.lit(True)), model).orderBy("doc_id").collect()
        for x, y in zip(got, want, strict=True):
            assert abs(x.score - y[3]) < 1e-6, (shard_tokens, x.doc_id)


def test_probabilities_sum_to_one(spark, tmp_path):
    model = kn.train(frame(spark, ["a b a c b a", "b b c d e a", "e d c"]), f"file://{tmp_path}/m")
    vocabulary = ["a", "b", "c", "d", "e", "unseen"]
    for h in ("a", "e", "unseen"):
        import pyarrow as pa

        with_h = model.score_batch(pa.array([f"{h} {w}" for w in vocabulary] + [h]))[3]
        # log p(h) + log p(w | h) + log p(end | w): the last text gives p(end | h)
        start = model.score_batch(pa.array([h]))[3][0] - math.log10(_end(model, h))
        total = sum(10 ** (s - start) / _end(model, w) for s, w in zip(with_h[:-1], vocabulary, strict=True)) + _end(model, h)
        assert abs(total - 1) < 1e-9


def _end(model, w):
    """p(end | w), from texts that differ only by it."""
    import numpy as np

    words = kn.Words(model.folder, model.word_sizes)
    number = words.numbers(kn.hash_words([w.encode(), b"\n"]))[0]
    return float(model._bigram(np.array([number[0]]), np.array([number[1]]), model._unigram(words, number[1:]))[0])


def test_empty(spark, tmp_path):
    model = kn.train(frame(spark, []), f"file://{tmp_path}/m")
    empty = frame(spark, []).withColumn("held_out", F.lit(True))
    assert kn.score(empty, model).count() == 0
    got = kn.score(frame(spark, ["a b", None]).withColumn("held_out", F.lit(True)), model).collect()
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in sorted(got, key=lambda r: r.doc_id)] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]


def test_unseen_followers_of_repeated_pairs_have_a_score(spark, tmp_path):
    """Counts of counts from which a discount of 0 would follow."""
    texts = [t for n, times in ((100, 1), (10, 2), (100, 3), (10, 4)) for k in range(n) for t in [f"a{n}x{times}x{k}"] * times]
    df = frame(spark, texts).withColumn("held_out", F.lit(False))
    model = kn.train(df, f"file://{tmp_path}/repeated")
    asked = [f"{t} a10x2x0" for t in ("a100x1x3", "a10x2x0", "a100x3x0", "a10x4x0", "unknown")]
    got = kn.score(frame(spark, asked).withColumn("held_out", F.lit(True)), model).orderBy("doc_id").collect()
    _, want = _plain(texts, asked)
    assert all(math.isfinite(r.score) and abs(r.score - w[3]) < 1e-6 for r, w in zip(got, want, strict=True))
    assert kn.discounts(100, 10, 100, 10) == [0.0, 0.5, 1.0, 1.5] and all(0 < d < k for k, d in enumerate(kn.discounts(100, 40, 20, 12)) if k)


def test_base_columns_equal_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    got = kn.op7_lm_scoring(spark, sf).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").orderBy("doc_id").collect()
    fold = {r.doc_id: r.held_out for r in got}
    assert all(h == (zlib.crc32(str(d).encode()) % 10 == 0) for d, h in fold.items())
    con = duckdb.connect()
    con.execute("CREATE TABLE f (doc_id BIGINT, held_out BOOLEAN)")
    con.executemany("INSERT INTO f VALUES (?, ?)", list(fold.items()))
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    want = con.sql(f"""
      WITH w AS (SELECT doc_id, held_out, unnest(list_append(regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+'), chr(10))) AS t FROM '{sf}/documents.parquet' JOIN f USING (doc_id)),
      c AS (SELECT t, count(*) AS c FROM w WHERE NOT held_out GROUP BY t), n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
      SELECT doc_id, any_value(held_out), count(*), count(c.c), any_value(n), sum(log10((coalesce(c.c, 0) + 0.1) / (n + 0.1 * (v + 1))))
      FROM w LEFT JOIN c USING (t), n GROUP BY doc_id ORDER BY doc_id""").fetchall()
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert tuple(a)[:5] == b[:5] and abs(a.base_score - b[5]) < 1e-6
