import numpy as np
import pyarrow as pa
import pytest
from loamline.llm import toxicity as tx
from loamline.llm.common import labels
from pyspark.sql import functions as F

from tests.llm.cases import DOC, TRICKY, frame, rows


def _toy():
    words = [b"one", b"two", b"", b"fourth"]
    vocabulary = tx.Vocabulary([b"one", b"fourth"])
    p = tx.initial(2, np.array([0.5, -0.2]))
    rng = np.random.default_rng(3)
    index, mask = rng.integers(0, 4, (3, tx.WINDOW)), np.ones((3, tx.WINDOW), bool)
    mask[1, 5:] = mask[2, 1:] = False
    index[~mask] = 4
    return words, vocabulary, p, index, mask


def test_gradients_equal_differences():
    words, vocabulary, p, index, mask = _toy()
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    run = lambda q: tx.gradients(q, tx._inputs(q, vocabulary.of(words), tx._grams(words)), vocabulary.of(words), tx._grams(words), index, mask, y, w)
    _, grad = run(p)
    rng = np.random.default_rng(4)
    for k in p:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p[k].shape)
            if k == "ew":
                at = (1 + at[0] % 2, at[1])
            if k == "es":
                at = (int(tx._grams(words)[3][rng.integers(0, 4)]), at[1])
            if k == "ec":
                at = (int(tx._grams(words)[0][rng.integers(0, 6)]), at[1])
            hi, lo = ({n: v.copy() for n, v in p.items()} for _ in range(2))
            hi[k][at] += 1e-5
            lo[k][at] -= 1e-5
            assert grad[k][at] == pytest.approx((run(hi)[0] - run(lo)[0]) / 2e-5, rel=1e-3, abs=1e-8), k


def test_grams_of_some_words_equal_those_of_all():
    words = [b"one", b"", b"a", b"fourteen", b"one"]
    every = tx._grams(words)
    assert every[2].tolist() == [4, 1, 1, 14, 4]
    for rows_ in ([0, 3], [1], [4, 2, 0]):
        bins, first, counts, stems = tx._grams_of(every, np.array(rows_))
        want = tx._grams([words[k] for k in rows_])
        assert bins.tolist() == want[0].tolist() and first.tolist() == want[1].tolist() and counts.tolist() == want[2].tolist() and stems.tolist() == want[3].tolist()


def test_every_word_is_in_a_window_and_windows_overlap():
    for n in (0, 1, 16, 17, 32, 33, 48, 49, 500):
        index, mask, doc = tx._window_index(np.arange(n), np.array([0, n]), -1)
        assert len(doc) == tx.windows(n) and set(index[mask].tolist()) == set(range(n))
        assert n <= tx.WINDOW or all(len(set(a[m]) & set(b[k])) == tx.STRIDE for a, b, m, k in zip(index, index[1:], mask, mask[1:], strict=False))


def test_scores_do_not_depend_on_neighbours(monkeypatch):
    _, vocabulary, p, *_ = _toy()
    model = (tx._single(p), vocabulary)
    texts = [*TRICKY, "one two fourth " * 500]
    alone = [tx.score_texts(model, pa.array([t], pa.string()))[0] for t in texts]
    monkeypatch.setattr(tx, "_BLOCK", 7)
    monkeypatch.setattr(tx, "_TEXT_BYTES", 100)
    assert tx.score_texts(model, pa.array(texts, pa.string())) == pytest.approx(alone, abs=1e-6)


def test_held_out_accuracy(spark):
    out = tx.op8_toxicity(spark, "/root/testdata/sf0.1").join(labels(spark, "/root/testdata/sf0.1"), "doc_id")
    r = {x.toxic: x.p for x in out.filter("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert r[1] > 0.85 and r[0] < 0.03, r


def test_cases(spark):
    docs = rows(TRICKY) + [(3, "again", None, None, None), (None, "no id", None, None, None)]
    df = spark.createDataFrame(docs, DOC).withColumn("score", F.lit("x"))
    assert tx.fit_sample(df, df.select("doc_id", F.lit(None).cast("int").alias("toxic"))) is None
    out = tx.score(df, None)
    assert out.count() == len(docs) and out.filter("score = 0 AND predicted = 0").count() == len(docs)
    _, vocabulary, p, *_ = _toy()
    got = tx.score(df, (tx._single(p), vocabulary))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "predicted"]
    assert got.filter("score BETWEEN 0 AND 1").count() == len(docs)
    assert tx.score(frame(spark, []), None).count() == 0


def test_bound_separates_held_documents():
    assert tx._bound(np.array([0.1, 3.0, 0.2, 2.0]), np.array([0, 1, 0, 1])) == (1.0, 1.1)
    value, bound = tx._bound(np.array([0.1, 3.0, 0.2, 0.15]), np.array([0, 1, 0, 1]))
    assert value == 0.5 and bound == 1.6
    assert tx._bound(np.array([1.0, 2.0]), np.array([1, 1]))[0] == 1.0
