"""An index in versions: reuse by stamps, pruning, and what a broken refresh leaves."""

import os

import pytest
from loamline.sources import index
from pyspark.sql import functions as F

SCHEMA = "path string, mtime long, size long, text string"


def _refresh(spark, home, rows, make=None):
    listing = spark.createDataFrame(rows, SCHEMA)
    done, counts = index.refresh(listing, home, "path", ["mtime", "size"], "digest", make or (lambda: F.md5("text")))
    return {r.path: (r.digest, r.reused) for r in done.collect()}, counts


def test_refresh(spark, tmp_path):
    home = f"file://{tmp_path}/index"
    old, counts = _refresh(spark, home, [("a", 1, 1, "x"), ("b", 1, 1, "y"), ("c", 1, 1, "z")], lambda: F.upper("text"))
    assert old == {"a": ("X", False), "b": ("Y", False), "c": ("Z", False)} and counts == {"hits": 0, "misses": 3}
    now, counts = _refresh(spark, home, [("a", 1, 1, "x"), ("b", 2, 1, "y"), ("d", 1, 1, "w")], lambda: F.concat("text", F.lit("!")))
    assert now == {"a": ("X", True), "b": ("y!", False), "d": ("w!", False)} and counts == {"hits": 1, "misses": 2}
    # A refresh that dies halfway changes nothing.
    with pytest.raises(Exception, match="broken"):
        _refresh(spark, home, [("e", 1, 1, "x")], lambda: F.when(F.col("path") == "e", F.raise_error(F.lit("broken"))).cast("string"))
    again, counts = _refresh(spark, home, [("a", 1, 1, "x"), ("d", 1, 1, "w")])
    assert again == {"a": ("X", True), "d": ("w!", True)} and counts == {"hits": 2, "misses": 0}
    # A pointer that can't be read is as none.
    with open(f"{tmp_path}/index/current", "w") as f:
        f.write("nowhere\n")
    os.path.exists(f"{tmp_path}/index/.current.crc") and os.remove(f"{tmp_path}/index/.current.crc")
    assert _refresh(spark, home, [("a", 1, 1, "x")])[1] == {"hits": 0, "misses": 1}
