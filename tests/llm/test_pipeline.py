import corpus_pipeline as cp
import pytest
from loamline.llm import quality_rules
from loamline.llm.common import documents, labels
from pyspark.sql import functions as F

from tests.llm.cases import TRICKY, frame
from tests.llm.test_minhash_dedup import _components

SF = "/root/testdata/sf0.01"


def test_stages_equal_brute_force(spark):
    docs = documents(spark, SF)
    ruled = cp.keep_by_rules(spark, docs, SF).cache()
    assert ruled.columns == docs.columns
    judged = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs).select("doc_id", "kept").collect()}
    assert sorted(r.doc_id for r in ruled.select("doc_id").collect()) == sorted(k for k, v in judged.items() if v)
    rated = cp.keep_by_classifier(spark, ruled, SF).cache()
    clean = ruled.join(labels(spark, SF).filter("quality = 1"), "doc_id").count()
    kept = rated.join(labels(spark, SF).filter("quality = 1"), "doc_id").count()
    assert rated.columns == docs.columns and kept > 0.98 * clean
    unique = cp.drop_near_duplicates(spark, rated, SF).cache()
    want = _components([(r.doc_id, r.text) for r in rated.collect()], 5, 80)
    assert sorted(r.doc_id for r in unique.select("doc_id").collect()) == sorted(set(want.values()))
    packed = cp.pack_sequences(spark, unique, SF)
    assert packed.select("doc_id").distinct().count() == unique.count()
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"))
    assert per.filter("n > 2048 OR n <> e").count() == 0


@pytest.mark.parametrize("texts", [[], TRICKY])
def test_stages_take_any_rows(spark, tmp_path, texts):
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark, str(tmp_path))
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_stages_keep_clashing_columns_and_null_ids(spark, tmp_path):
    good = " ".join(f"the word{k % 40} of text and line{k % 9}" for k in range(60))
    rows = [(1, good, "x"), (2, good + " more", "y"), (None, good.replace("word", "other"), "z"), (4, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, metrics string").selectExpr("*", "'s' as score", "'b' as bands", "1 as component", "2 as node", "3 as u").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark, str(tmp_path))
    columns = docs.columns
    unique = cp.drop_near_duplicates(spark, docs, str(tmp_path))
    assert unique.columns == columns and sorted((r.doc_id or 0, r.metrics) for r in unique.collect()) == [(0, "z"), (1, "x"), (4, None)]
    for name, stage in cp.STAGES[:2]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns, name
        assert {r.metrics for r in out.collect()} <= {"x", "y", "z", None}
    packed = cp.pack_sequences(spark, unique, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == 3
