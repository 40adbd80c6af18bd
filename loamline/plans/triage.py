"""Feedback triage over rows made from documents and labels, and the streaming queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.functions import feedback as fb
from loamline.plans.event_series import ORACLES as EVENT_SQL
from loamline.plans.event_series import _E, _O, GAP
from loamline.plans.gait import MOTION_SQL
from loamline.sources.tables import table
from loamline.streaming.event_streams import stream_alerts, stream_motion, stream_rates, stream_sessions

# Class names and feedback states.
_NAMES = ("poison_ivy", "poison_oak", "poison_sumac", "safe_plants", "unknown_plant")
_ENTRY_STATES = ("confirmed", "corrected", "discarded", "Confirmed", "none", "corrected ", "confirmed", "liked", "synthetic_confirmed", "corrected", "confirmed")
_STATES = ("confirmed", "corrected", "discarded", "confirmed", "none", "corrected", "confirmed")


def feedback_rows(spark, sf):
    """A feedback row for each document: equal texts share a name; states and confidences are set by its numbers."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    names = F.array(*[F.lit(x) for x in _NAMES])
    return d.select(
        "doc_id",
        F.concat(F.lit("shot_"), F.substring("digest", 1, 12), F.lit(".jpg")).alias("filename"),
        F.get(names, (F.col("n_chars") % 5).cast("int")).alias("original"),
        F.get(names, (F.col("doc_id") % 4).cast("int")).alias("corrected"),
        F.get(F.array(*[F.lit(x) for x in _STATES]), (F.col("doc_id") % 7).cast("int")).alias("status"),
        F.when(F.col("n_chars") % 11 == 0, "nan").when(F.col("n_chars") % 13 == 0, "x").otherwise((F.col("n_chars") % 131).cast("string")).alias("raw"),
    )


def feedback_triage(spark, sf):
    """Outcome of each row: duplicate, skipped, error, review or accepted, and its priority."""
    rows = feedback_rows(spark, sf)
    # The first row of a name by a partial aggregate, as many rows may share one.
    first = rows.groupBy("filename").agg(F.min("doc_id").alias("first_id"))
    r = rows.join(first, "filename").withColumn("confidence", fb.normalize_confidence(F.col("raw")))
    r = r.withColumn("label", fb.resolve_label(F.col("status"), F.col("original"), F.col("corrected")))
    r = r.withColumn("direction", fb.contradiction(F.col("original"), F.col("label")))
    outcome = (
        F.when(F.col("doc_id") > F.col("first_id"), "duplicate")
        .when(F.col("status").isin(*fb.SKIPPED), "skipped")
        .when(F.col("label").isNull(), "error")
        .when(fb.gate(F.col("direction"), F.col("label"), F.col("confidence")), "review")
        .otherwise("accepted")
    )
    p = F.round(fb.priority(F.col("status"), F.col("confidence"), F.col("direction"), F.col("label")) + 1e-9, 6)
    return r.select("doc_id", "filename", "label", F.when(F.col("label").isNotNull(), F.col("direction")).alias("direction"), F.round(F.col("confidence") + 1e-9, 6).alias("confidence"), outcome.alias("outcome"), F.when(F.col("label").isNotNull(), p).alias("priority"))


def triage_report(spark, sf):
    return feedback_triage(spark, sf).groupBy("outcome", "direction").agg(F.count("*").alias("n"))


def feedback_entries(spark, sf):
    """An untrusted manifest of all documents: some rows without names, with escaping names, made-up or unreadable."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 12).alias("h"))
    i, n = F.col("doc_id"), F.col("n_chars")
    pick = lambda xs, k: F.get(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int"))
    name = F.when(i % 41 == 0, " ").when(i % 37 == 0, F.concat(F.lit("../shot "), "h")).when(i % 31 == 0, F.concat(F.lit("/etc/"), "h")).when(i % 29 == 0, F.concat(F.lit("sub/../../"), "h"))
    name = name.when(i % 23 == 0, F.concat(F.lit("sub/../shot+"), F.substring("h", 1, 3))).when(i % 19 == 0, F.concat(F.lit("shot~"), F.substring("h", 1, 3))).otherwise(F.concat(F.lit("shot "), "h"))
    return d.select(
        "doc_id",
        F.concat(name, F.when(i % 41 == 0, "").otherwise(".jpg")).alias("filename"),
        pick([*_NAMES, "not_a_plant"], n).alias("original"),
        pick([*_NAMES, "not_a_plant", ""], i).alias("corrected"),
        pick(_ENTRY_STATES, i).alias("status"),
        (i % 43 == 0).alias("synthetic"),
        F.when(n % 11 == 0, "nan").when(n % 13 == 0, "x").otherwise((n % 131).cast("string")).alias("raw"),
        F.when(i % 7 == 0, "yesterday").otherwise(F.concat(F.lit("2026-03-"), F.lpad((1 + i % 28).cast("string"), 2, "0"), F.lit("T10:"), F.lpad((n % 60).cast("string"), 2, "0"), F.when(i % 2 == 0, ":00Z").otherwise(":30"))).alias("stamp"),
        F.when(i % 5 == 0, F.lit(0.0)).otherwise((n % 1700) / F.lit(10.0) - 70).alias("latitude"),
        F.when(i % 5 == 0, F.lit(0.0)).otherwise((n % 360) / F.lit(4.0) - 40).alias("longitude"),
    )


POLICIES = ("all", "corrections-only", "high-confidence")


def feedback_decisions(entries, files, policy="all"):
    """Outcome of each row of a manifest, the first that applies: no_filename, duplicate, label_error, skipped, path_escape,
    missing_file, unreadable, review, policy, accepted.

    ``files(filename, readable)`` are the images that exist; ``policy`` is the trust policy
    that decides on rows which get so far. ``accepted_by`` says which policies would take
    such a row, ``observation_id`` its group.
    """
    r = entries.withColumns({"filename": F.trim(F.coalesce("filename", F.lit(""))), "confidence": fb.normalize_confidence(F.col("raw")), "at": fb.parse_timestamp(F.col("stamp"))})
    r = r.withColumn("r", fb.resolve(F.col("status"), F.col("original"), F.col("corrected"), F.col("synthetic"))).select("*", "r.label", "r.error", F.col("r.status").alias("state"))
    first = r.filter("filename <> ''").groupBy("filename").agg(F.min("doc_id").alias("first_id"))
    r = r.join(first, "filename", "left").join(files, "filename", "left")
    r = r.withColumn("direction", fb.contradiction(F.col("original"), F.col("label")))
    outcome = (
        F.when(F.col("filename") == "", "no_filename")
        .when(F.col("doc_id") > F.col("first_id"), "duplicate")
        .when(F.col("error").isNotNull(), "label_error")
        .when(F.col("label").isNull(), "skipped")
        .when(~fb.inside(F.col("filename")), "path_escape")
        .when(F.col("readable").isNull(), "missing_file")
        .when(~F.col("readable"), "unreadable")
        .when(fb.gate(F.col("direction"), F.col("label"), F.col("confidence")), "review")
    )
    takes = lambda p: fb.trusted(p, F.col("state"), F.col("confidence"))
    taken = F.array_compact(F.array(*(F.when(takes(p), p) for p in POLICIES)))
    judged = F.col("label").isNotNull()
    r = r.withColumn("outcome", F.coalesce(outcome, F.when(takes(policy), "accepted").otherwise("policy")))
    return r.select(
        "doc_id", "filename", "label", "state", "outcome", F.when(judged, F.col("direction")).alias("direction"),
        F.when(F.col("outcome").isin("accepted", "policy"), F.array_join(taken, ",")).alias("accepted_by"),
        F.when(judged, F.round(fb.priority(F.col("state"), F.col("confidence"), F.col("direction"), F.col("label")) + 1e-9, 4)).alias("priority"),
        fb.observation_group(F.col("latitude"), F.col("longitude"), F.col("at"), F.col("filename")).alias("observation_id"),
    )


def _decisions(spark, sf, policy="all"):
    d = table(spark, sf, "documents")
    entries = feedback_entries(spark, sf)
    named = entries.join(d.select("doc_id", "text"), "doc_id").filter(F.col("doc_id") % 17 != 3).groupBy(F.trim("filename").alias("filename"))
    files = named.agg((F.coalesce(F.max(F.length("text")), F.lit(0)) >= 64).alias("readable"))
    return feedback_decisions(entries, files, policy)


def feedback_cascade(spark, sf):
    """Each feedback row with its outcome under each trust policy, contradiction, priority and observation group."""
    d = _decisions(spark, sf)
    under = lambda p: F.when(F.col("outcome") != "accepted", F.col("outcome")).when(F.array_contains(F.split("accepted_by", ","), p), "accepted").otherwise("policy")
    return d.withColumns({"outcome_corrections": under(POLICIES[1]), "outcome_confident": under(POLICIES[2])})


def feedback_outcomes(spark, sf):
    """Rows by outcome and direction under each trust policy, the most frequent first."""
    d = feedback_cascade(spark, sf)
    under = F.array(*(F.struct(F.lit(p).alias("policy"), F.col(c).alias("outcome")) for p, c in zip(POLICIES, ("outcome", "outcome_corrections", "outcome_confident"), strict=True)))
    each = d.select("direction", F.explode(under).alias("u")).groupBy("u.policy", "u.outcome", "direction")
    return each.agg(F.count("*").alias("n")).orderBy("policy", F.desc("n"), "outcome", "direction")


def review_queue(spark, sf):
    """The hundred rows that a person should judge first: highest priority, then manifest order."""
    return _decisions(spark, sf).filter("outcome = 'review'").select("doc_id", "filename", "label", "priority").orderBy(F.desc(F.coalesce("priority", F.lit(0.0))), "doc_id").limit(100)


def staging_conflicts(accepted, staged):
    """What becomes of accepted rows when they are staged: a name clash, another class under the name, or staged.

    Rows claim their cleaned names by priority, then in manifest order; the first of a name
    has it. ``staged(staged_name, prior_class)`` are names that earlier runs staged.
    """
    stem = F.regexp_replace(F.element_at(F.split("filename", "/"), -1), r"(.)\.[^.]*$", "$1")
    named = accepted.withColumn("staged_name", F.concat(F.lit("fb_"), fb.sanitize_stem(stem), F.lit(".jpg")))
    first = named.groupBy("staged_name").agg(F.min_by("doc_id", F.struct(-F.col("priority"), "doc_id")).alias("claimed_by"))
    r = named.join(first, "staged_name").join(staged, "staged_name", "left")
    fate = F.when(F.col("doc_id") != F.col("claimed_by"), "name_clash").when(F.col("prior_class") != F.col("label"), "other_class").when(F.col("prior_class").isNotNull(), "already_staged").otherwise("staged")
    return r.select("doc_id", "staged_name", "label", fate.alias("fate"), "claimed_by")


def feedback_staging(spark, sf):
    """All accepted rows with their staged names and conflicts; an earlier run staged every ninth of them, a third under another class."""
    accepted = _decisions(spark, sf).filter("outcome = 'accepted'")
    stem = F.regexp_replace(F.element_at(F.split("filename", "/"), -1), r"(.)\.[^.]*$", "$1")
    before = accepted.filter("doc_id % 9 = 0").groupBy(F.concat(F.lit("fb_"), fb.sanitize_stem(stem), F.lit(".jpg")).alias("staged_name"))
    staged = before.agg(F.min_by(F.when(F.col("doc_id") % 27 == 0, fb.SAFE).otherwise(F.col("label")), "doc_id").alias("prior_class"))
    return staging_conflicts(accepted, staged)


QUERIES = {f.__name__: f for f in (feedback_triage, triage_report, feedback_cascade, feedback_outcomes, review_queue, feedback_staging, stream_sessions, stream_alerts, stream_motion, stream_rates)}

_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_HARM = ", ".join(f"'{x}'" for x in fb.HARMFUL)
_FB = f"""
f0 AS (SELECT doc_id, 'shot_' || substr(md5(coalesce(text, '')), 1, 12) || '.jpg' AS filename, {_LIST(_NAMES)}[n_chars % 5 + 1] AS original, {_LIST(_NAMES)}[doc_id % 4 + 1] AS corrected, {_LIST(_STATES)}[doc_id % 7 + 1] AS status,
  CASE WHEN n_chars % 11 = 0 OR n_chars % 13 = 0 THEN NULL WHEN n_chars % 131 > 100 THEN 1.0::DOUBLE WHEN n_chars % 131 > 1 THEN (n_chars % 131) / 100::DOUBLE ELSE (n_chars % 131)::DOUBLE END AS confidence FROM documents),
f1 AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY doc_id) AS i, CASE status WHEN 'confirmed' THEN original WHEN 'corrected' THEN corrected END AS l0 FROM f0),
f2 AS (SELECT *, CASE WHEN l0 IN ({_HARM}, 'safe_plants') THEN l0 END AS label FROM f1),
f3 AS (SELECT *, CASE WHEN original = label THEN 'none' WHEN original NOT IN ({_HARM}, 'safe_plants') THEN 'unknown_origin' WHEN original <> 'safe_plants' AND label = 'safe_plants' THEN 'toxic_to_safe' WHEN original = 'safe_plants' AND label <> 'safe_plants' THEN 'safe_to_toxic' ELSE 'toxic_to_toxic' END AS dir FROM f2),
f4 AS (SELECT doc_id, filename, label, CASE WHEN label IS NOT NULL THEN dir END AS direction, round(confidence + 1e-9::DOUBLE, 6) AS confidence,
  CASE WHEN i > 1 THEN 'duplicate' WHEN status IN ('discarded', 'none') THEN 'skipped' WHEN label IS NULL THEN 'error' WHEN (dir = 'toxic_to_safe' AND (confidence IS NULL OR confidence >= 0.7)) OR (dir = 'unknown_origin' AND label = 'safe_plants') THEN 'review' ELSE 'accepted' END AS outcome,
  CASE WHEN label IS NOT NULL THEN round(CASE status WHEN 'corrected' THEN 1 + coalesce(confidence, 0.5::DOUBLE) ELSE 0.3::DOUBLE + (1 - coalesce(confidence, 0.5::DOUBLE)) END
    + CASE dir WHEN 'safe_to_toxic' THEN 1.0::DOUBLE + CASE WHEN label IN ('poison_ivy', 'poison_oak') THEN 0.25::DOUBLE ELSE 0 END WHEN 'toxic_to_safe' THEN 0.5::DOUBLE WHEN 'unknown_origin' THEN 0.25::DOUBLE ELSE 0 END + 1e-9::DOUBLE, 6) END AS priority FROM f3)"""

_ENTRIES = f"""
g0 AS (SELECT doc_id, n_chars, substr(md5(coalesce(text, '')), 1, 12) AS h, text FROM documents),
g1 AS (SELECT doc_id, text, trim(CASE WHEN doc_id % 41 = 0 THEN '' ELSE CASE WHEN doc_id % 37 = 0 THEN '../shot ' || h WHEN doc_id % 31 = 0 THEN '/etc/' || h WHEN doc_id % 29 = 0 THEN 'sub/../../' || h
    WHEN doc_id % 23 = 0 THEN 'sub/../shot+' || substr(h, 1, 3) WHEN doc_id % 19 = 0 THEN 'shot~' || substr(h, 1, 3) ELSE 'shot ' || h END || '.jpg' END) AS filename,
  {_LIST([*_NAMES, 'not_a_plant'])}[n_chars % 6 + 1] AS original, {_LIST([*_NAMES, 'not_a_plant', ''])}[doc_id % 7 + 1] AS corrected, lower(trim({_LIST(_ENTRY_STATES)}[doc_id % 11 + 1])) AS st, doc_id % 43 = 0 AS synthetic,
  CASE WHEN n_chars % 11 = 0 OR n_chars % 13 = 0 THEN NULL WHEN n_chars % 131 > 100 THEN 1.0::DOUBLE WHEN n_chars % 131 > 1 THEN (n_chars % 131) / 100::DOUBLE ELSE (n_chars % 131)::DOUBLE END AS confidence,
  CASE WHEN doc_id % 7 <> 0 THEN epoch(make_timestamp(2026, 3, 1 + doc_id % 28, 10, n_chars % 60, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 30 END))::BIGINT // 600 END AS bucket,
  CASE WHEN doc_id % 5 = 0 THEN 0 ELSE (n_chars % 1700) / 10::DOUBLE - 70 END AS lat, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE (n_chars % 360) / 4::DOUBLE - 40 END AS lng FROM g0),
g2 AS (SELECT *, CASE WHEN synthetic OR st LIKE 'synthetic%' THEN 'synthetic' ELSE st END AS state, CASE WHEN NOT synthetic AND st = 'confirmed' THEN original WHEN NOT synthetic AND st = 'corrected' THEN CASE corrected WHEN '' THEN original ELSE corrected END END AS l0,
  min(doc_id) OVER (PARTITION BY filename) AS first_id FROM g1),
g3 AS (SELECT *, CASE WHEN l0 = 'not_a_plant' THEN 'safe_plants' WHEN l0 IN ({_HARM}, 'safe_plants') THEN l0 END AS label FROM g2),
fl AS (SELECT filename, coalesce(max(length(text)), 0) >= 64 AS readable FROM g1 WHERE doc_id % 17 <> 3 GROUP BY 1),
g4 AS (SELECT *, CASE WHEN label IS NULL THEN NULL WHEN original = label THEN 'none' WHEN original NOT IN ({_HARM}, 'safe_plants') THEN 'unknown_origin' WHEN label = 'safe_plants' THEN 'toxic_to_safe' WHEN original = 'safe_plants' THEN 'safe_to_toxic' ELSE 'toxic_to_toxic' END AS direction FROM g3 LEFT JOIN fl USING (filename)),
g5 AS (SELECT *, CASE WHEN filename = '' THEN 'no_filename' WHEN doc_id > first_id THEN 'duplicate' WHEN state NOT IN ('synthetic', 'discarded', 'none', '') AND label IS NULL THEN 'label_error' WHEN label IS NULL THEN 'skipped'
    WHEN filename LIKE '/%' OR filename LIKE '../%' OR filename LIKE 'sub/../../%' THEN 'path_escape' WHEN readable IS NULL THEN 'missing_file' WHEN NOT readable THEN 'unreadable'
    WHEN (direction = 'toxic_to_safe' AND (confidence IS NULL OR confidence >= 0.7)) OR (direction = 'unknown_origin' AND label = 'safe_plants') THEN 'review'
    ELSE 'accepted' END AS outcome, coalesce(confidence >= {fb.LEAST_TRUSTED}::DOUBLE, FALSE) AS sure FROM g4),
fc AS (SELECT doc_id, filename, label, state, outcome, CASE WHEN outcome <> 'accepted' THEN outcome WHEN state = 'corrected' THEN 'accepted' ELSE 'policy' END AS outcome_corrections,
  CASE WHEN outcome <> 'accepted' THEN outcome WHEN sure THEN 'accepted' ELSE 'policy' END AS outcome_confident, direction,
  CASE WHEN outcome = 'accepted' THEN 'all' || CASE WHEN state = 'corrected' THEN ',corrections-only' ELSE '' END || CASE WHEN sure THEN ',high-confidence' ELSE '' END END AS accepted_by,
  CASE WHEN label IS NOT NULL THEN round(CASE state WHEN 'corrected' THEN 1 + coalesce(confidence, 0.5::DOUBLE) ELSE 0.3::DOUBLE + (1 - coalesce(confidence, 0.5::DOUBLE)) END
    + CASE direction WHEN 'safe_to_toxic' THEN 1.0::DOUBLE + CASE WHEN label IN ('poison_ivy', 'poison_oak') THEN 0.25::DOUBLE ELSE 0 END WHEN 'toxic_to_safe' THEN 0.5::DOUBLE WHEN 'unknown_origin' THEN 0.25::DOUBLE ELSE 0 END + 1e-9::DOUBLE, 4) END AS priority,
  CASE WHEN bucket IS NOT NULL AND (lat <> 0 OR lng <> 0) AND abs(lat) <= 90 THEN 'fb_obs_' || substr(sha1(round(lat, 4)::VARCHAR || ',' || round(lng, 4)::VARCHAR || ',' || bucket), 1, 12) ELSE 'fb_single_' || substr(sha1(filename), 1, 12) END AS observation_id FROM g5)"""
_STAGED = f"""{_ENTRIES}, ac AS (SELECT *, 'fb_' || regexp_replace(regexp_replace(string_split(filename, '/')[-1], '[.]jpg$', ''), '[^A-Za-z0-9_.-]+', '_', 'g') || '.jpg' AS staged_name FROM fc WHERE outcome = 'accepted'),
be AS (SELECT staged_name, arg_min(CASE WHEN doc_id % 27 = 0 THEN 'safe_plants' ELSE label END, doc_id) AS prior_class FROM ac WHERE doc_id % 9 = 0 GROUP BY 1),
cb AS (SELECT *, first_value(doc_id) OVER (PARTITION BY staged_name ORDER BY priority DESC, doc_id) AS claimed_by FROM ac)"""

ORACLES = {
    "feedback_cascade": f"WITH {_ENTRIES} SELECT * FROM fc",
    "feedback_outcomes": f"WITH {_ENTRIES}, u AS (SELECT 'all' AS policy, outcome, direction FROM fc UNION ALL SELECT 'corrections-only', outcome_corrections, direction FROM fc UNION ALL SELECT 'high-confidence', outcome_confident, direction FROM fc) SELECT policy, outcome, direction, count(*) AS n FROM u GROUP BY 1, 2, 3",
    "review_queue": f"WITH {_ENTRIES} SELECT doc_id, filename, label, priority FROM fc WHERE outcome = 'review' ORDER BY priority DESC, doc_id LIMIT 100",
    "feedback_staging": f"WITH {_STAGED} SELECT doc_id, staged_name, label, CASE WHEN doc_id <> claimed_by THEN 'name_clash' WHEN prior_class <> label THEN 'other_class' WHEN prior_class IS NOT NULL THEN 'already_staged' ELSE 'staged' END AS fate, claimed_by FROM cb LEFT JOIN be USING (staged_name)",
    "feedback_triage": f"WITH {_FB} SELECT * FROM f4",
    "triage_report": f"WITH {_FB} SELECT outcome, direction, count(*) AS n FROM f4 GROUP BY 1, 2",
    "stream_sessions": f"WITH {_E}, d AS (SELECT *, CASE WHEN coalesce(t - lag(t) {_O} >= {GAP}, TRUE) THEN 1 ELSE 0 END AS new FROM e), s AS (SELECT *, sum(new) {_O} AS session FROM d) SELECT user_id, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM s GROUP BY user_id, session",
    "stream_alerts": EVENT_SQL["refractory_picks"],
    "stream_motion": MOTION_SQL,
    "stream_rates": f"WITH {_E} SELECT t // 3600000000 AS slot, count(*) AS n, arg_max(event_id, (t, event_id)) AS latest_id FROM e GROUP BY 1",
}
