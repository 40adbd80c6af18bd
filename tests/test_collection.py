"""Manifests of any shape, folder listings and saved pages on small files."""

import json

import pytest
from loamline.sources import folders, paged, variants
from pyspark.sql import functions as F


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def rows(found):
    return sorted((r.name, r.cls, r.url, r.observation_id) for r in variants.normalized(found).collect())


def test_all_shapes(spark, tmp_path):
    _write(tmp_path / "m/a.json", json.dumps({"version": 1, "entries": [{"filename": "p/x.jpg", "cls": "c", "obs_id": 7}, 5, {"cls": "nameless"}, {"path": "", "file": "y.jpg", "class": " "}]}, indent=2))
    _write(tmp_path / "m/b.json", json.dumps([{"file": "z.jpg", "url": "", "image_url": "u", "observation_id": 0, "occurrence_id": "12"}]))
    _write(tmp_path / "m/c.json", json.dumps({"q/w.jpg": {"class": "d"}, "version": 2, "v/": {"class": "e"}}))
    _write(tmp_path / "m/d.json", '{"entries": [')
    _write(tmp_path / "m/e.json", "7")
    _write(tmp_path / "m/f.json", '{"entries": []}')
    docs = variants.documents(spark, str(tmp_path / "m"))
    assert rows(variants.entries(docs)) == [("v", "e", None, None), ("w.jpg", "d", None, None), ("x.jpg", "c", None, "7"), ("y.jpg", " ", None, None), ("z.jpg", None, "u", "12")]


def test_fatal_mode(spark, tmp_path):
    _write(tmp_path / "ok/a.json", '{"entries": [{"filename": "x"}]}')
    _write(tmp_path / "broken/a.json", '{"entries": [')
    _write(tmp_path / "odd/a.json", '"text"')
    read = lambda name: variants.entries(variants.documents(spark, str(tmp_path / name), fatal=True), fatal=True).count()
    assert read("ok") == 1
    for name in ("broken", "odd"):
        with pytest.raises(Exception, match="(?i)malformed|neither"):
            read(name)


def test_priority(spark, tmp_path):
    _write(tmp_path / "l/a.jsonl", '{"path": "x", "class": "old", "line": 1}\n\n{"path": "x", "class": "new", "line": 2}\nnot json\n[1]\n')
    _write(tmp_path / "one/a.json", '[{"path": "x", "class": "a"}, {"path": "y", "class": "b"}, {"path": "y", "class": "c"}]')
    _write(tmp_path / "two/a.json", '{"y": {"class": "d"}, "z": {"class": "e"}}')
    blobs = [variants.normalized(variants.entries(variants.documents(spark, str(tmp_path / n)))) for n in ("one", "two")]
    found = variants.provenance(variants.normalized(variants.lines(spark, str(tmp_path / "l"), "line")), *blobs)
    assert sorted((r.name, r.cls, r["rank"]) for r in found.collect()) == [("x", "new", 0), ("y", "b", 1), ("z", "e", 2)]


def test_listing(spark, tmp_path):
    for path, text in {"a/1.jpg": "x", "a/2.JPEG": b"\xff\xfe", "a/3.png": "", "a/.4.jpg": "x", "a/5.txt": "x", "a/sub/6.jpg": "x", "a/sub/deep/7.jpg": "x", "b/8.webp": "yy", ".c/9.jpg": "x", "Testing/10.jpg": "x", "11.jpg": "x"}.items():
        _write(tmp_path / "t" / path, text)
    (tmp_path / "t/empty").mkdir()
    files = folders.listing(spark, str(tmp_path / "t"), ("Testing",))
    assert sorted((r.name, r.depth) for r in files.filter("folder = 'a'").collect()) == [(".4.jpg", 1), ("1.jpg", 1), ("2.JPEG", 1), ("3.png", 1), ("5.txt", 1), ("6.jpg", 2), ("7.jpg", 3)]
    got = [tuple(r) for r in folders.split_scan(files, ["a"]).orderBy("folder").collect()]
    assert got == [("a", True, 3, 4, 2, 3), ("b", False, 1, 0, 0, 2)]
    assert sorted(map(tuple, folders.first_files(files, 2).collect())) == [("a", "1.jpg", 1), ("a", "2.JPEG", 2), ("b", "8.webp", 2)]
    assert folders.listing(spark, str(tmp_path / "t"), contents=False).filter("content IS NOT NULL").count() == 0
    assert folders.listing(spark, str(tmp_path / "t"), ("Testing",)).rdd.getNumPartitions() == 16 * 3


def test_pages(spark, tmp_path):
    page = lambda at, rows: json.dumps({"offset": at, "results": rows})
    for path, text in {"q/0.json": page(0, [{"id": 1, "url": "a"}, {"id": 2}]), "q/2.json": page(2, [{"id": 3, "url": "c", "more": 1}]), "r/0.json": page(0, [{"id": 4}]), "r/2.json": "{", "r/100002.json": page(100_002, [{"id": 5}]), "s/0.json": "[]"}.items():
        _write(tmp_path / "p" / path, text)
    found = paged.read_pages(spark, str(tmp_path / "p"), "query string, place long, id long, url string")
    assert sorted(map(tuple, found.collect())) == [("q", 0, 1, "a"), ("q", 1, 2, None), ("q", 2, 3, "c"), ("r", 0, 4, None)]
    assert found.rdd.getNumPartitions() == 5
    one = found.filter(F.col("query") == "q").filter("id > 1")
    assert sorted(r.id for r in one.collect()) == [2, 3] and one.rdd.getNumPartitions() == 2
    assert found.filter(F.col("query").isin("r", "s") & (F.col("query") != "r")).count() == 0
    assert paged.read_pages(spark, str(tmp_path / "p"), "query string, place long, id long", most_offset=10**6).filter("id = 5").count() == 1
    with pytest.raises(ValueError, match="mounted"):
        paged.read_pages(spark, "s3a://b/p", "query string, place long")
