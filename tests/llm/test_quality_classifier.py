import numpy as np
import pytest
from loamline.llm import quality_classifier as qc
from loamline.llm.common import labels
from pyspark.sql import functions as F

from tests.llm.cases import DOC, TRICKY, frame, rows

SF = "/root/testdata/sf0.01"


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    p = qc.initial()
    x, bags, y, w = rng.random((9, qc.FEATURES)), np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    _, grad = qc.gradients(p, x, bags, y, w)
    for k in ("w1", "b1", "v", "u", "a", "w2", "b2"):
        at = tuple(rng.integers(0, n) for n in p[k].shape)
        hi, lo = ({n: v.copy() for n, v in p.items()} for _ in range(2))
        hi[k][at] += 1e-5
        lo[k][at] -= 1e-5
        assert grad[k][at] == pytest.approx((qc.gradients(hi, x, bags, y, w)[0] - qc.gradients(lo, x, bags, y, w)[0]) / 2e-5, rel=1e-4, abs=1e-8)


def test_blocks_give_the_scores_of_whole_bags(monkeypatch):
    p = {k: v.astype("f4") for k, v in qc.initial().items()}
    texts = [*TRICKY, "long text with much in it " * 900]
    whole = []
    for t in texts:
        raw = (t or "").encode()
        h, _, _, e = qc._hidden(p, np.concatenate([qc.encode_passages(raw[s : s + qc.PASSAGE_BYTES], np.array([0])) for s in qc.passage_starts(len(raw))]))
        q = np.exp(e - e.max())
        whole.append(qc._sigmoid((q / q.sum()) @ h @ p["w2"] + p["b2"][0]))
    monkeypatch.setattr(qc, "_BLOCK", 5)
    assert qc.score_texts(p, texts) == pytest.approx(np.array(whole), abs=1e-5)


def test_held_out_accuracy(spark):
    out = qc.op6_quality_classifier(spark, "/root/testdata/sf0.1").join(labels(spark, "/root/testdata/sf0.1"), "doc_id")
    r = out.filter("held_out").groupBy("quality").agg(F.avg("predicted").alias("p"), F.count("*").alias("n")).collect()
    share = {x.quality: x.p for x in r}
    assert share[1] > 0.98 and share[0] < 0.02, share


def test_cases(spark):
    docs = rows(TRICKY) + [(3, "again", None, None, None), (None, "no id", None, None, None)]
    df = spark.createDataFrame(docs, DOC).withColumn("score", F.lit("x"))
    assert qc.fit_sample(df, df.select("doc_id", F.lit(None).cast("int").alias("quality"))) is None
    out = qc.score(df, None)
    assert out.count() == len(docs) and out.filter("score = 0.5 AND predicted = 1").count() == len(docs)
    model = {k: v.astype("f4") for k, v in qc.initial().items()}
    got = qc.score(df, model)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "predicted"]
    assert got.filter("score BETWEEN 0 AND 1").count() == len(docs)
    assert qc.score(frame(spark, []), model).count() == 0
