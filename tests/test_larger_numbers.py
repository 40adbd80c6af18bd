"""Names and manifests of more rows than the smallest tables have, against the SQL."""

import duckdb
import pytest
from loamline.plans import registry
from pyspark.sql import functions as F


def _agree(spark, name, folder, **tables):
    con = duckdb.connect()
    for t, path in tables.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    df = registry.QUERIES[name](spark, str(folder))
    want = con.sql(registry.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.select(", ".join(cols)).fetchall()))
    return df


def test_committed_numbers_of_five_digits(spark, tmp_path):
    rows = spark.range(13_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = _agree(spark, "committed_names", tmp_path, documents=f"{tmp_path}/documents.parquet/*.parquet")
    assert df.select("name").distinct().count() == df.count()


@pytest.mark.parametrize("name", ["frame_listing", "resume_counters"])
def test_frames_of_seven_digits(spark, tmp_path, name):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("event_id", F.col("event_id") + 999_900)
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    df = _agree(spark, name, tmp_path, events=f"{tmp_path}/events.parquet/*.parquet")
    if name == "frame_listing":
        assert df.agg(F.max("idx")).first()[0] == e.agg(F.max("event_id")).first()[0] and df.filter("filename NOT LIKE idx || '_%'").filter("idx >= 1000000").count() == 0


def test_lines_of_a_manifest_in_parts(spark, tmp_path):
    """Larger files are read first, so the first part of the manifest holds its last lines."""
    schema = "doc_id long, lang string, source string, text string"
    for k, rows in enumerate(([(12, "de", "a", "x")], [(24, "en", "b", "x"), *((4 * i, "fr", "c", f"y{i}") for i in range(10, 400))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
        assert k < 2
    df = _agree(spark, "manifest_shapes", tmp_path, documents=f"{tmp_path}/documents.parquet/*.parquet")
    assert df.filter("observation_id = '2'").select("cls").first()[0] == "en"


def test_each_trust_policy_counts_every_row(spark):
    d = registry.QUERIES["feedback_outcomes"](spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert {r.policy: r.n for r in d.groupBy("policy").agg(F.sum("n").alias("n")).collect()} == {p: n for p in ("all", "corrections-only", "high-confidence")}
    assert d.filter("policy <> 'all' AND outcome = 'policy'").count() > 0


def test_every_accepted_row_is_staged(spark):
    accepted = registry.QUERIES["feedback_cascade"](spark, "/root/testdata/sf0.001").filter("outcome = 'accepted'").count()
    assert registry.QUERIES["feedback_staging"](spark, "/root/testdata/sf0.001").count() == accepted > 0
