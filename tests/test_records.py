import math

import pytest
from loamline.plans import records
from loamline.sources import manifests, sinks
from pyspark.sql import functions as F


def test_lines_skip_blank_and_broken_ones(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"path": "a/x.jpg", "n": 0}\n\n{"path": "b\nnot json\n{"file": "b/x.jpg", "n": 7}\n{}\n')
    got = manifests.read_lines(spark, str(tmp_path / "m.jsonl"), "path string, file string, n long").collect()
    assert sorted((r.path or "", r.file or "", r.n) for r in got) == [("", "b/x.jpg", 7), ("a/x.jpg", "", 0)]


def test_entries_bare_lists_and_broken_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"version": 1, "entries": [{"filename": "x.jpg"}, {"filename": "y.jpg"}]}')
    (tmp_path / "b.json").write_text('[{"filename": "z.jpg"}]')
    (tmp_path / "c.json").write_text('{"entries": [')
    assert sorted(r.filename for r in manifests.read_manifest(spark, str(tmp_path / "a.json")).collect()) == ["x.jpg", "y.jpg"]
    assert [r.filename for r in manifests.read_manifest(spark, str(tmp_path / "b.json")).collect()] == ["z.jpg"]
    with pytest.raises(Exception, match="(?i)malformed|parse|corrupt"):
        manifests.read_manifest(spark, str(tmp_path / "c.json")).collect()


def test_numbers_of_zero_count_as_missing_and_lines_win(spark):
    lines = spark.createDataFrame([("p/a.jpg", 0, 5, 1), ("q/a.jpg", 0, 6, 2), (None, 1, 1, 3)], "path string, observation_id long, occurrence_id long, line long")
    old = spark.createDataFrame([("a.jpg", "cc0", 1), ("b.jpg", " ", 2)], "filename string, license string, line long")
    got = {r.name: r for r in manifests.by_priority(lines, old, ordinal="line").collect()}
    assert sorted(got) == ["a.jpg", "b.jpg"]
    assert (got["a.jpg"].path, got["a.jpg"].observation_id, got["a.jpg"].license, got["a.jpg"].n_rows) == ("q/a.jpg", "6", None, 2)
    assert got["b.jpg"].license is None


def test_merging_twice_changes_nothing(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, o long, v string")
    fresh = spark.createDataFrame([("b", 3, "z"), ("b", 4, "w"), ("c", 1, None)], "k string, o long, v string")
    once = sinks.merged(old, fresh, "k", "o")
    rows = [tuple(r) for r in once.collect()]
    assert rows == [("a", 1, "x"), ("b", 4, "w"), ("c", 1, None)] == [tuple(r) for r in sinks.merged(once, fresh, "k", "o").collect()]


def test_commit_tells_what_it_left_out(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "k string, v long").write.parquet(str(tmp_path / "pool"))
    assert sinks.commit(spark.createDataFrame([("a", 2), ("b", 3)], "k string, v long"), str(tmp_path / "pool"), "k") == 1
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "pool")).collect())) == [("a", 1), ("b", 3)]


def test_ledger_over_batches(spark, tmp_path, monkeypatch):
    from pyspark.sql.streaming import DataStreamReader

    schema = "doc_id long, text string, n_chars long"
    for k, rows in enumerate(([(1, "x", 1), (2, "x", 1), (3, "y", 1)], [(4, "x", 1), (5, "z", 1), (6, "z", 1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
        assert k < 2
    whole = DataStreamReader.parquet
    monkeypatch.setattr(DataStreamReader, "parquet", lambda self, *a, **b: whole(self.option("maxFilesPerTrigger", 1), *a, **b))
    got = records.upload_ledger(spark, str(tmp_path)).collect()
    assert len(got) == len({r.filename for r in got}) == 3


def test_frames_of_odd_names(spark):
    assert math.isclose(records.BLUR_BANDS[0], 100)
    f = records.frame_listing(spark, "/root/testdata/sf0.001")
    assert f.filter(F.col("cls").contains("_b12_leaf")).count() > 0 and f.filter("blur < 0").count() == 0
