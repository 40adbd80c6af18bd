"""A text of two megabytes beside short ones, in operators whose other tests stop earlier."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from loamline.llm import kneser_ney as kn
from loamline.llm import quality_classifier as qc
from loamline.llm import quality_rules
from loamline.llm import toxicity as tx
from pyspark.sql import functions as F

from tests.llm.cases import frame
from tests.llm.test_toxicity import _toy

LONG = "\n".join(" ".join(f"word{(k * j) % 977}" for j in range(100)) for k in range(2700))
TEXTS = [LONG, "short one", None]


def test_quality_rules(spark):
    m = quality_rules.apply_rules(frame(spark, TEXTS)).filter("doc_id = 0").first().metrics
    words, lines = LONG.split(), LONG.split("\n")
    n = Counter(zip(words, words[1:], words[2:], strict=False))
    assert (m.n_words, m.word_chars) == (len(words), sum(map(len, words)))
    assert m.n_dup_lines == len(lines) - len(set(lines))
    assert m.n_repeat_words == len({i + k for i in range(len(words) - 2) if n[tuple(words[i : i + 3])] > 1 for k in range(3)})


def test_language_model(spark, tmp_path):
    df = frame(spark, TEXTS).withColumn("held_out", F.lit(False))
    got = {r.doc_id: r for r in kn.score(df, kn.train(df, f"file://{tmp_path}/lm")).collect()}
    count = Counter(LONG.split()) + Counter(["short", "one"])
    count["\n"] = 3
    total = sum(count.values())
    base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in [*LONG.split(), "\n"])
    assert got[0].n_tokens == got[0].n_known == len(LONG.split()) + 1 and abs(got[0].base_score - base) < 1e-4 and math.isfinite(got[0].score)


def test_classifiers():
    p = {k: v.astype("f4") for k, v in qc.initial().items()}
    assert np.allclose(qc.score_texts(p, TEXTS)[1:], qc.score_texts(p, TEXTS[1:]), atol=1e-6)
    _, vocabulary, q, *_ = _toy()
    s = tx.score_texts((tx._single(q), vocabulary), pa.array([f"{LONG} one two fourth {LONG}", LONG, "one two fourth"]))
    assert 0 <= s.min() and s.max() <= 1 and s[0] >= s[1]
