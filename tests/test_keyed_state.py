"""Ledger and sessions over several batches, and after a restart."""

import random

from loamline.streaming import keyed_state
from pyspark.sql import functions as F

NAMES = "filename string, doc_id long"


def _files(spark, folder, parts, schema):
    """A file for each part, in order of time."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_nothing_is_accepted_twice(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    _files(spark, source, [[("x", 5), ("x", 2), ("y", 3)], [("x", 9), ("z", 4), (None, 8)]], NAMES)
    first = {r.filename: (r.doc_id, r.last_id) for r in keyed_state.accept_once(_stream(spark, source, NAMES), out).collect()}
    assert first == {"x": (2, 9), "y": (3, 3), "z": (4, 4), None: (8, 8)}
    _files(spark, source, [[("x", 1), ("w", 7)]], NAMES)
    again = {r.filename: (r.doc_id, r.last_id) for r in keyed_state.accept_once(_stream(spark, source, NAMES), out).collect()}
    assert again == {"x": (2, 1), "y": (3, 3), "z": (4, 4), "w": (7, 7), None: (8, 8)}
    rows = spark.read.schema("filename string, doc_id long, last_id long, version long").parquet(out)
    assert rows.filter("version = 0").groupBy("filename").count().filter("count > 1").count() == 0
    assert rows.count() == 7


def _plain(rows, gap):
    out, open_ = set(), {}
    for u, t in sorted(rows):
        if u in open_ and t - open_[u][1] < gap:
            open_[u] = (open_[u][0], t, open_[u][2] + 1)
        else:
            if u in open_:
                out.add((u, *open_[u]))
            open_[u] = (t, t, 1)
    return out | {(u, *s) for u, s in open_.items()}


def test_sessions_over_batches(spark, tmp_path):
    """Batches overlap in time, so sessions of one batch are joined by rows of a later one; a user holds half of all rows."""
    rng, gap = random.Random(2), 600_000_000
    rows = [(1 if i % 2 else rng.randrange(2, 9), t * 1_000_000) for i, t in enumerate(sorted(rng.randrange(0, 200_000) for _ in range(900)))]
    parts = [rows[:300], rows[300:600:2], rows[301:600:2], rows[600:]]
    schema = "user_id long, t long"
    _files(spark, f"{tmp_path}/in", parts, schema)
    events = _stream(spark, f"{tmp_path}/in", schema).withColumn("at", F.timestamp_micros("t"))
    got = {(r.user_id, r.t0, r.t1, r.n) for r in keyed_state.sessions(events, gap, f"{tmp_path}/out", "1 day").collect()}
    assert got == _plain(rows, gap)


def test_sessions_leave_the_state(spark, tmp_path):
    gap, schema = 10_000_000, "user_id long, t long"
    _files(spark, f"{tmp_path}/in", [[(1, 1_000_000), (1, 6_000_000)], [(2, 10**12)], [(2, 10**12 + 1)]], schema)
    events = _stream(spark, f"{tmp_path}/in", schema).withColumn("at", F.timestamp_micros("t"))
    got = {(r.user_id, r.t0, r.t1, r.n) for r in keyed_state.sessions(events, gap, f"{tmp_path}/out", "1 second").collect()}
    assert got == {(1, 1_000_000, 6_000_000, 2), (2, 10**12, 10**12 + 1, 2)}
    held = spark.read.format("statestore").option("stateVarName", "open").load(f"{tmp_path}/out-state")
    assert {r.key.user_id for r in held.collect()} == {2}


def test_ledger_without_a_call_for_each_name(spark, tmp_path, monkeypatch):
    """Names are summed up by built-in functions, a batch at a time."""

    def refuse(*args, **kwargs):
        raise AssertionError("a Python call for each name")

    monkeypatch.setattr("pyspark.sql.pandas.group_ops.PandasGroupedOpsMixin.transformWithStateInPandas", refuse)
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    _files(spark, source, [[(f"n{i % 900}", i) for i in range(2_000)], [("n5", 1), ("new", 9_000)]], NAMES)
    rows = {r.filename: (r.doc_id, r.last_id) for r in keyed_state.accept_once(_stream(spark, source, NAMES), out).collect()}
    assert len(rows) == 901 and rows["n5"] == (5, 1) and rows["n899"] == (899, 1_799) and rows["new"] == (9_000, 9_000)
