import hashlib

import pytest
from loamline.functions import feedback as fb
from loamline.plans import triage
from pyspark.sql import functions as F


def _one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_made_up_rows_are_skipped_not_errors(spark):
    rows = [("confirmed", "poison_ivy", None, True), ("synthetic_confirmed", "poison_ivy", None, None), ("liked", "poison_ivy", None, False), ("corrected", "poison_ivy", "", None), ("confirmed", "not_a_plant", None, None), ("confirmed", "fern", None, None), ("Discarded ", None, None, None), (None, None, None, None), ("confirmed", None, None, None)]
    got = _one(spark, rows, "s string, o string, c string, m boolean", fb.resolve(F.col("s"), F.col("o"), F.col("c"), F.col("m")))
    assert [(r.label, r.status, r.error is not None) for r in got] == [
        (None, "synthetic", False), (None, "synthetic", False), (None, "liked", True), ("poison_ivy", "corrected", False), ("safe_plants", "confirmed", False),
        (None, "confirmed", True), (None, "discarded", False), (None, "", False), (None, "confirmed", True),
    ]


def test_timestamps(spark):
    raw = ["2026-01-02T03:04:05Z", "2026-01-02T03:04:05", "2026-01-02T03:04:05+02:00", " 2026-01-02 ", "yesterday", "2026", "", None, "2026-13-01T00:00:00Z"]
    day = 1767312000 * 10**6
    at = 3 * 3600 + 4 * 60 + 5
    assert _one(spark, [(r,) for r in raw], "r string", fb.parse_timestamp(F.col("r"))) == [day + at * 10**6, day + at * 10**6, day + (at - 7200) * 10**6, day, None, None, None, None, None]


def test_paths_stay_inside(spark):
    # Own cases of the rule: absolute, above the folder, down and up again, back by the folder's name.
    names = ["a.jpg", "x/y/a.jpg", "x/../a.jpg", "x/./y//../a.jpg", ".", "/a.jpg", "..", "x/../../box/a.jpg", "x/y/../../../a.jpg", "../box/a.jpg", "x..y/..a.jpg", "b\\..\\a"]
    assert _one(spark, [(n,) for n in names], "n string", fb.inside(F.col("n"))) == [True, True, True, True, True, False, False, False, False, False, True, True]


def test_observation_groups(spark):
    minute = 60 * 10**6
    rows = [(1.25, -3.0, 20 * minute, "a"), (1.25001, -3.0, 29 * minute, "b"), (1.25, -3.0, 30 * minute, "c"), (0.0, 0.0, 0, "d"), (float("nan"), 1.0, 0, "e"), (91.0, 1.0, 0, "f"), (1.0, 1.0, None, "g"), (None, 1.0, 0, "h")]
    got = _one(spark, rows, "lat double, lng double, t long, f string", fb.observation_group(F.col("lat"), F.col("lng"), F.col("t"), F.col("f")))
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()[:12]
    assert got == [f"fb_obs_{sha('1.25,-3.0,2')}"] * 2 + [f"fb_obs_{sha('1.25,-3.0,3')}"] + [f"fb_single_{sha(x)}" for x in "defgh"]


def test_trust_policies(spark):
    rows = [("confirmed", 0.69), ("corrected", 0.4), ("corrected", 0.7), ("confirmed", None)]
    take = lambda p: _one(spark, rows, "s string, c double", fb.trusted(p, F.col("s"), F.col("c")))
    assert take("all") == [True] * 4 and take("corrections-only") == [False, True, True, False] and take("high-confidence") == [False, False, True, False]
    with pytest.raises(ValueError, match="no trust policy"):
        fb.trusted("some", F.lit("x"), F.lit(0.1))


ENTRY = "doc_id long, filename string, original string, corrected string, status string, synthetic boolean, raw string, stamp string, latitude double, longitude double"


def test_every_outcome_in_order(spark):
    row = lambda i, name, o="poison_ivy", c=None, s="confirmed", m=None, raw="0.9": (i, name, o, c, s, m, raw, None, None, None)
    rows = [row(0, " "), row(1, "a.jpg", s="discarded"), row(2, "a.jpg"), row(3, "b.jpg", o="fern"), row(4, "c.jpg", m=True), row(5, "../d.jpg"), row(6, "e.jpg"), row(7, "f.jpg"), row(8, "g.jpg", c="safe_plants", s="corrected"), row(9, "h.jpg", raw="0.1"), row(10, "i.jpg")]
    files = spark.createDataFrame([(f"{x}.jpg", x != "f") for x in "abcdfghi"] + [("../d.jpg", True)], "filename string, readable boolean")
    got = {r.doc_id: r for r in triage.feedback_decisions(spark.createDataFrame(rows, ENTRY), files, "high-confidence").collect()}
    by_all = {r.doc_id: r.outcome for r in triage.feedback_decisions(spark.createDataFrame(rows, ENTRY), files).collect()}
    assert by_all[9] == by_all[10] == "accepted" and by_all[8] == "review"
    assert [got[i].outcome for i in range(11)] == ["no_filename", "skipped", "duplicate", "label_error", "skipped", "path_escape", "missing_file", "unreadable", "review", "policy", "accepted"]
    assert got[10].accepted_by == "all,high-confidence" and got[9].accepted_by == "all" and got[8].accepted_by is None


def test_staging_conflicts(spark):
    accepted = spark.createDataFrame([(1, "a-b.jpg", "poison_ivy", 1.0), (2, "a~b.jpg", "poison_ivy", 1.0), (3, "a b.jpg", "poison_ivy", 2.0), (4, "c.jpg", "poison_oak", 1.0), (5, "x/d.jpg", "poison_oak", 1.0), (6, "e.jpeg", "poison_oak", 1.0)], "doc_id long, filename string, label string, priority double")
    staged = spark.createDataFrame([("fb_c.jpg", "safe_plants"), ("fb_d.jpg", "poison_oak")], "staged_name string, prior_class string")
    got = {r.doc_id: (r.staged_name, r.fate) for r in triage.staging_conflicts(accepted, staged).collect()}
    assert got == {1: ("fb_a-b.jpg", "staged"), 2: ("fb_a_b.jpg", "name_clash"), 3: ("fb_a_b.jpg", "staged"), 4: ("fb_c.jpg", "other_class"), 5: ("fb_d.jpg", "already_staged"), 6: ("fb_e.jpg", "staged")}
