"""Texts far beyond the others': nine million words for the licence scan, two megabytes for the other operators."""

import os
import subprocess
import sys

import corpus_pipeline as cp
import pytest
from loamline.llm import centroids, fingerprints, html_text, importance_sample, minhash_dedup, packing, token_files
from loamline.llm.common import documents
from loamline.llm.encoding import load_tokenizer, tokenizer_path
from pyspark.sql import functions as F

from tests.llm.cases import frame

SCAN = """
import sys
from pyspark.sql import SparkSession
from loamline.llm import license_scan
folder = sys.argv[1]
with open(f"{folder}/long.txt", "w") as f:
    f.write("a " * 9_000_000 + "all rights reserved " + "b " * 10 + "cc by")
spark = SparkSession.builder.master("local[1]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", f"{folder}/w").getOrCreate()
found = license_scan.scan(spark.read.text(f"{folder}/long.txt", wholetext=True).withColumnRenamed("value", "text")).select("licence.*").first()
print(found.n_words, sorted((s.label, s.start) for s in found.spans if s.base))
"""

LONG = " ".join(f"w{(k * k) % 99_991}" for k in range(330_000))


def test_nine_million_words(tmp_path):
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    run = subprocess.run([sys.executable, "-c", SCAN, str(tmp_path)], env=os.environ | {"PYTHONPATH": home}, cwd=home, capture_output=True, text=True, timeout=600)
    assert run.stdout.strip().endswith("9000015 [('cc-by', 9000013), ('reserved', 9000000)]"), run.stderr[-2000:]


def test_near_duplicates(spark):
    found = minhash_dedup.near_duplicates(frame(spark, [LONG, LONG + " more", "short", None]))
    assert len(LONG) > 2_000_000 and {r.doc_id: r.component_id for r in found.collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_fingerprints(spark):
    rows = {r.doc_id: r for r in fingerprints.with_next(frame(spark, [LONG, LONG + " more", None])).select("doc_id", F.size("sketch").alias("n"), fingerprints.likeness(F.col("sketch"), F.col("next_sketch")).alias("like")).collect()}
    assert rows[0].n > 20_000 and rows[1].like > 0.99 and rows[0].like == 0.0


def test_pipeline(spark, tmp_path):
    good = " ".join(f"the word{k % 40} of text and line{k % 9}" for k in range(60))
    frame(spark, [LONG, good, good + " x"]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark, str(tmp_path))
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    unique = cp.drop_near_duplicates(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in unique.select("doc_id").collect()) == [0, 1]
    n = len(load_tokenizer(tokenizer_path("word_bpe_49k.json")).encode(LONG, add_special_tokens=False).ids) + 1
    packed = cp.pack_sequences(spark, unique, str(tmp_path)).filter("doc_id = 0")
    assert packed.agg(F.sum("length")).first()[0] == n == packed.first().doc_tokens


def test_importance_and_pages(spark):
    found = importance_sample.sample(frame(spark, [LONG, "short"]), frame(spark, ["w1 w4 w9"]))
    assert {r.doc_id: r.n_features for r in found.collect()} == {0: 330_000, 1: 1}
    pages = spark.createDataFrame([(1, "http://a/", f"<article><p>{LONG}</p></article>")], "page_id long, url string, html string")
    assert html_text.extract(pages).first().text == LONG


@pytest.mark.parametrize("ids", ["null", "same"])
def test_rows_of_one_id_spread(spark, tmp_path, ids):
    """Equal rows with one id, or none, lie in several token files and several packing groups, and none is lost."""
    value = F.lit(None).cast("long") if ids == "null" else F.lit(5).cast("long")
    rows = spark.range(600).select(value.alias("doc_id"), F.lit("some words of one text ").alias("text")).repartition(3)
    uri = f"file://{tmp_path}/t"
    shards = token_files.write_token_files(rows, tokenizer_path("byte_bpe_50k.json"), 0, uri, shard_text_bytes=2_000)
    assert len(shards) > 3 and max(s[1] for s in shards) < 300 and sum(s[1] for s in shards) == 600
    back = token_files.read_token_files(spark, uri, shards, token_files._digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
    assert back.select("start").distinct().count() == 600 and back.select("ids_crc32").distinct().count() == 1
    pieces = packing.encode_pieces(rows, tokenizer_path("word_bpe_49k.json"), 1, group_docs=50)
    sizes = [r["count"] for r in pieces.groupBy("pack_group").count().collect()]
    assert sum(sizes) == 600 and max(sizes) < 120
    packed = packing.pack(pieces)
    assert packed.count() == 600 and packed.select("sequence_id", "offset").distinct().count() == 600


def test_clusters_of_equal_vectors(spark):
    rows = spark.range(500).select(F.lit(None).cast("long").alias("vec_id"), F.array_repeat(F.lit(0.5), 64).alias("embedding"))
    found, now = centroids.cluster(rows)
    assert found.count() == 500 and now == [[512] * 64] * 8 and found.agg(F.sum("distance")).first()[0] == 0
