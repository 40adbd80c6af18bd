"""Gait reports over the event series of users: apexes, cadence, sign, phase and alignment, and their SQL.

An event's value less ``CENTRE`` stands for the downward acceleration of a sample, and a
text of key=value tokens is made of its columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.functions.details import token
from loamline.operators import series
from loamline.operators.lineage import written
from loamline.operators.selection import percentiles
from loamline.plans.event_series import _E, _O, _RN, gaps
from loamline.sources.tables import events, require_columns

#: Smoothing, least height of a peak, least microseconds between two, what a value is measured against.
ALPHA, FLOOR, WAIT, CENTRE = 0.6, 5.0, 6 * 3_600_000_000, 60.0
#: Microseconds around a sample in which its activity counts, the root mean square that it must exceed, the step where the median is 0.
ACTIVE_WINDOW, ACTIVE_RMS, LEAST_STEP = 5 * 86_400_000_000, 45.0, 10_000
#: Smoothing of the stillness filter, which starts high, and the bound below which a user is still.
STILL_ALPHA, STILL_SEED, STILL_BOUND = 0.05, 100.0, 35.0


def samples(spark, sf):
    """(event_id, user_id, event_type, t, down, details) of each event; captures have details."""
    e = events(spark, sf)
    k = F.get_json_object("props", "$.k").try_cast("int")
    trigger = F.when(k % 5 == 0, "junk").otherwise(F.concat(F.lit("trigger="), F.get(F.array(*map(F.lit, ("manual", "apogee", "forced", "apogee"))), k % 4)))
    details = F.when(F.col("event_type") == "view", F.concat(F.lit("a=1 trigger=old "), trigger, F.lit(" pts="), F.when(k % 7 == 0, "x").otherwise(F.col("t").cast("string")), F.lit(" b=x=y")))
    plain = F.when(k % 11 == 0, F.lit("junk")).otherwise(details)
    return e.select("event_id", "user_id", "event_type", "t", (F.col("value") - CENTRE).alias("down"), "value", F.when(F.col("event_type") == "view", plain).alias("details"))


def _apexes(s, value="down"):
    return written(series.apexes(s.select("event_id", "user_id", "t", value), "user_id", ["t", "event_id"], "t", value, ALPHA, FLOOR, WAIT).select("event_id", "user_id", "t"))


def apex_times(spark, sf):
    """Samples on which a user's smoothed series has just passed a peak."""
    return _apexes(samples(spark, sf)).select("event_id", "user_id", "t")


def _periods(apexes):
    """(user_id, apexes, period): a user's apexes and the median seconds between them, null for one."""
    g = written(gaps(apexes).select("user_id", "gap"))
    medians = percentiles(g, ["user_id"], "gap", {"gap": 0.5})
    return g.groupBy("user_id").agg(F.count("*").alias("apexes")).join(medians, "user_id", "left").select("user_id", "apexes", (F.col("gap") / 1e6).alias("period"))


def cadence_report(spark, sf):
    """Each user's apexes, the median seconds between them and how many a day; nulls for fewer than two."""
    s = samples(spark, sf)
    p = s.select("user_id").distinct().join(_periods(_apexes(s)), "user_id", "left")
    return p.select("user_id", F.coalesce("apexes", F.lit(0)).alias("apexes"), F.round("period", 3).alias("median_period_s"), F.round(86400 / F.col("period"), 6).alias("per_day"))


def active_samples(s):
    """``s`` with ``active``: the root mean square of ``down`` within ``ACTIVE_WINDOW`` around a sample exceeds ``ACTIVE_RMS``.

    The window is so many samples as fit it at a user's median step, one at least; a user
    with one sample is never active.
    """
    steps = percentiles(gaps(s), ["user_id"], "gap", {"step": 0.5}).withColumnRenamed("user_id", "stepping")
    step = F.when(F.col("step") == 0, LEAST_STEP).otherwise(F.col("step"))
    sized = s.join(steps, F.col("user_id").eqNullSafe(F.col("stepping")), "left").withColumn("width", F.greatest(F.lit(1), F.bround(ACTIVE_WINDOW / step)).cast("long"))
    framed = series.framed_rms(sized, "user_id", "t", ["event_id"], "down", F.col("width"))
    return framed.select(*s.columns, (F.col("step").isNotNull() & (F.col("rms") > ACTIVE_RMS)).alias("active"))


def sign_report(spark, sf):
    """Whether a user's sharp impacts while active are negative, as they should be: skewness and both extremes.

    Skewness is NaN below three active samples or without spread, extremes without any.
    """
    a = written(active_samples(samples(spark, sf).select("event_id", "user_id", "t", "down")))
    walking = a.filter("active").select("user_id", "down", (-F.col("down")).alias("up"))
    high = percentiles(walking, ["user_id"], "down", {"pos": 0.995})
    low = percentiles(walking, ["user_id"], "up", {"neg": 0.995})
    moments = walking.groupBy("user_id").agg(F.count("*").alias("n_active"), F.skewness("down").alias("s"), F.var_pop("down").alias("v"))
    g = a.groupBy("user_id").agg(F.count("*").alias("n")).join(moments, "user_id", "left").join(high, "user_id", "left").join(low, "user_id", "left")
    nan = F.lit(float("nan"))
    skew = F.when((F.col("n_active") >= 3) & (F.col("v") > 0), F.round("s", 6)).otherwise(nan)
    verdict = F.when(F.isnan("skew"), "inconclusive").when((F.col("skew") < -0.3) & (F.col("neg") > F.col("pos")), "consistent").when((F.col("skew") > 0.3) & (F.col("pos") > F.col("neg")), "inverted").otherwise("weak")
    ends = (F.coalesce(F.round(c, 6), nan).alias(f"{c}_extreme") for c in ("neg", "pos"))
    return g.withColumn("skew", skew).select("user_id", "n", F.coalesce("n_active", F.lit(0)).alias("n_active"), "skew", *ends, verdict.alias("verdict"))


def session_clock(spark, sf):
    """Each user's clock: the motion clock only if all of its values are finite, else the elapsed one; and the time it spans."""
    e = require_columns(events(spark, sf), ["event_id", "user_id", "t"])
    motion = F.when(F.col("event_id") % 401 == 0, None).when(F.col("event_id") % 407 == 0, float("nan")).otherwise(F.col("t") / 1e6 + 0.25)
    finite = motion.isNotNull() & ~F.isnan(motion) & (F.abs(motion) != float("inf"))
    g = e.groupBy("user_id").agg(F.min(finite).alias("motion"), F.count("*").alias("n"), ((F.max("t") - F.min("t")) / 1e6).alias("elapsed"), (F.max(motion) - F.min(motion)).alias("moved"))
    return g.select("user_id", "n", F.when(F.col("motion"), "motion_ts").otherwise("timestamp_s").alias("clock"), F.round(F.when(F.col("motion"), F.col("moved")).otherwise(F.col("elapsed")), 3).alias("duration_s"))


def trigger_histogram(spark, sf):
    """Captures by trigger, the last one that their details name; ``?`` for none."""
    c = samples(spark, sf).filter("event_type = 'view'")
    return c.groupBy(F.coalesce(token(F.col("details"), "trigger"), F.lit("?")).alias("trigger")).agg(F.count("*").alias("n"))


def phase_summary(spark, sf):
    """Milliseconds from the last apex to each capture at the apogee without a stamp of its own, by user, and their share of a stride."""
    s = samples(spark, sf)
    apexes = _apexes(s)
    captures = s.filter("event_type = 'view'").filter((token(F.col("details"), "trigger") == "apogee") & token(F.col("details"), "pts").try_cast("double").isNull())
    marks = apexes.select("user_id", "t", "event_id", F.lit(True).alias("apex")).union(captures.select("user_id", "t", "event_id", F.lit(False)))
    found = series.as_of(marks, "user_id", "t", ~F.col("apex"), F.col("apex"), ["t"])
    gap = (F.col("t") - F.col("prev_t")) / 1000
    late = written(found.filter("prev_t IS NOT NULL").select("user_id", gap.alias("g")))
    g = late.groupBy("user_id").agg(F.count("*").alias("n")).join(percentiles(late, ["user_id"], "g", {"median": 0.5, "p25": 0.25, "p75": 0.75}), "user_id")
    j = g.join(_periods(apexes), "user_id", "left")
    return j.select("user_id", "n", F.round(F.col("median") + 1e-6, 3).alias("median_ms"), F.round(F.col("p25") + 1e-6, 3).alias("p25_ms"), F.round(F.col("p75") + 1e-6, 3).alias("p75_ms"), F.round(F.col("median") / 1000 / F.col("period"), 6).alias("stride_share"))


def apex_alignment(spark, sf):
    """Whether stamps (purchases) lie nearer to a user's peaks or to the peaks of the inverted series; twice as many decide."""
    s = samples(spark, sf)
    stamps = s.filter("event_type = 'purchase'").select("user_id", "t", "event_id", F.lit(0).alias("kind"))
    found = stamps
    for kind, marks in ((1, _apexes(s)), (2, _apexes(s.withColumn("up", -F.col("down")), "up"))):
        both = stamps.select("user_id", "t", "event_id", F.lit(0).alias("kind")).union(marks.select("user_id", "t", "event_id", F.lit(kind)))
        near = series.nearest(both, "user_id", "t", F.col("kind") == 0, F.col("kind") == kind)
        found = found.join(near.select("event_id", F.col("near_gap").alias(f"gap_{kind}")), "event_id")
    found = written(found.filter("gap_1 IS NOT NULL AND gap_2 IS NOT NULL"))
    g = found.groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("gap_1") < F.col("gap_2")).cast("long")).alias("near_maxima"), F.sum((F.col("gap_2") < F.col("gap_1")).cast("long")).alias("near_minima"))
    g = g.join(percentiles(found, ["user_id"], "gap_1", {"offset": 0.5}), "user_id").select("user_id", "n", "near_maxima", "near_minima", F.round(F.col("offset") / 1000 + 1e-6, 3).alias("median_offset_ms"))
    one = lambda c: F.greatest(F.lit(1), F.col(c))
    verdict = F.when(F.col("near_maxima") >= 2 * one("near_minima"), "agrees").when(F.col("near_minima") >= 2 * one("near_maxima"), "inverted").otherwise("inconclusive")
    return g.select("*", verdict.alias("verdict"))


QUERIES = {f.__name__: f for f in (apex_times, cadence_report, session_clock, sign_report, trigger_histogram, phase_summary, apex_alignment)}


def _detector(name: str, sign: str, out: str) -> str:
    """Recursive walk: smoothed value, its last step, time of the last peak that fired, and whether this sample fires."""
    x = f"{sign}(n.value - {CENTRE}::DOUBLE)"
    sm = f"({ALPHA}::DOUBLE * {x} + (1 - {ALPHA}::DOUBLE) * s.sm)"
    peak = f"(s.st > 0 AND {sm} - s.sm <= 0 AND s.sm >= {FLOOR} AND (s.last IS NULL OR n.t - s.last >= {WAIT}))"
    first = f"{sign}(value - {CENTRE}::DOUBLE)"
    return f"""{name}(event_id, user_id, rn, t, sm, st, last, hit) AS (SELECT event_id, user_id, rn, t, {first}, {first}, NULL::BIGINT, FALSE FROM n WHERE rn = 1
  UNION ALL SELECT n.event_id, n.user_id, n.rn, n.t, {sm}, {sm} - s.sm, CASE WHEN {peak} THEN n.t ELSE s.last END, {peak} FROM {name} s JOIN n ON n.user_id = s.user_id AND n.rn = s.rn + 1),
{out} AS (SELECT event_id, user_id, t FROM {name} WHERE hit)"""


_AP = f"RECURSIVE {_E}, {_RN}, {_detector('wa', '', 'ap')}"
_PD = f"gp AS (SELECT user_id, t - lag(t) {_O} AS gap FROM ap), pd AS (SELECT user_id, count(*) AS apexes, quantile_cont(gap, 0.5) / 1e6::DOUBLE AS period FROM gp GROUP BY 1)"
_TRIG = "['manual', 'apogee', 'forced', 'apogee'][k % 4 + 1]"
# The last trigger wins: the old one stays only where the new token is junk.
_CAP = f"cap AS (SELECT event_id, user_id, t, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 5 = 0 THEN 'old' ELSE {_TRIG} END AS trig, k % 11 <> 0 AND k % 7 <> 0 AS stamped FROM e WHERE event_type = 'view')"
ORACLES = {
    "apex_times": f"WITH {_AP} SELECT * FROM ap",
    "cadence_report": f"WITH {_AP}, {_PD} SELECT user_id, coalesce(apexes, 0) AS apexes, round(period, 3) AS median_period_s, round(86400 / period, 6) AS per_day FROM (SELECT DISTINCT user_id FROM e) LEFT JOIN pd USING (user_id)",
    "sign_report": f"""WITH {_E}, gp AS (SELECT user_id, t - lag(t) {_O} AS gap FROM e), wd AS (SELECT user_id, greatest(1, round_even({ACTIVE_WINDOW} / CASE quantile_cont(gap, 0.5) WHEN 0 THEN {LEAST_STEP} ELSE quantile_cont(gap, 0.5) END, 0))::BIGINT AS w FROM gp WHERE gap IS NOT NULL GROUP BY 1),
fr AS (SELECT user_id, value - {CENTRE}::DOUBLE AS d, w, sqrt(sum(floor((value - {CENTRE}::DOUBLE) * (value - {CENTRE}::DOUBLE) * 1000000)::DECIMAL(38,0)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN (w - 1 - (w - 1) // 2) PRECEDING AND ((w - 1) // 2) FOLLOWING)::DOUBLE / 1000000 / w) AS rms FROM e JOIN wd USING (user_id)),
x AS (SELECT user_id, d FROM fr WHERE rms > {ACTIVE_RMS}), m AS (SELECT user_id, avg(d) AS mu FROM x GROUP BY 1), c AS (SELECT user_id, count(*) AS n_active, avg((d - mu) ** 3) AS m3, avg((d - mu) ** 2) AS m2, quantile_cont(-d, 0.995) AS neg, quantile_cont(d, 0.995) AS pos FROM x JOIN m USING (user_id) GROUP BY 1),
u AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1), r AS (SELECT u.*, coalesce(n_active, 0) AS n_active, neg, pos, CASE WHEN n_active >= 3 AND m2 > 0 THEN round(m3 / m2 ** 1.5, 6) ELSE 'nan'::DOUBLE END AS skew FROM u LEFT JOIN c USING (user_id))
SELECT user_id, n, n_active, skew, coalesce(round(neg, 6), 'nan'::DOUBLE) AS neg_extreme, coalesce(round(pos, 6), 'nan'::DOUBLE) AS pos_extreme, CASE WHEN isnan(skew) THEN 'inconclusive' WHEN skew < -0.3 AND neg > pos THEN 'consistent' WHEN skew > 0.3 AND pos > neg THEN 'inverted' ELSE 'weak' END AS verdict FROM r""",
    "session_clock": f"WITH {_E}, m AS (SELECT user_id, t, event_id % 401 <> 0 AND event_id % 407 <> 0 AS ok FROM e) SELECT user_id, count(*) AS n, CASE WHEN bool_and(ok) THEN 'motion_ts' ELSE 'timestamp_s' END AS clock, round((max(t) - min(t)) / 1e6::DOUBLE, 3) AS duration_s FROM m GROUP BY 1",
    "trigger_histogram": f"WITH {_E}, {_CAP} SELECT coalesce(trig, '?') AS trigger, count(*) AS n FROM cap GROUP BY 1",
    "phase_summary": f"WITH {_AP}, {_PD}, {_CAP}, f AS (SELECT c.user_id, (c.t - a.t) / 1000 AS g FROM (SELECT * FROM cap WHERE trig = 'apogee' AND NOT stamped) c ASOF JOIN ap a ON c.user_id = a.user_id AND c.t >= a.t) SELECT f.user_id, count(*) AS n, round(quantile_cont(g, 0.5) + 1e-6::DOUBLE, 3) AS median_ms, round(quantile_cont(g, 0.25) + 1e-6::DOUBLE, 3) AS p25_ms, round(quantile_cont(g, 0.75) + 1e-6::DOUBLE, 3) AS p75_ms, round(quantile_cont(g, 0.5) / 1000 / any_value(period), 6) AS stride_share FROM f LEFT JOIN pd USING (user_id) GROUP BY 1",
    "apex_alignment": f"WITH {_AP}, {_detector('wi', '-', 'mi')}, d AS (SELECT p.user_id, p.event_id, (SELECT min(abs(p.t - a.t)) FROM ap a WHERE a.user_id = p.user_id) AS g1, (SELECT min(abs(p.t - b.t)) FROM mi b WHERE b.user_id = p.user_id) AS g2 FROM e p WHERE event_type = 'purchase'), g AS (SELECT user_id, count(*) AS n, count(*) FILTER (g1 < g2) AS near_maxima, count(*) FILTER (g2 < g1) AS near_minima, round(quantile_cont(g1, 0.5) / 1000 + 1e-6::DOUBLE, 3) AS median_offset_ms FROM d WHERE g1 IS NOT NULL AND g2 IS NOT NULL GROUP BY 1) SELECT *, CASE WHEN near_maxima >= 2 * greatest(1, near_minima) THEN 'agrees' WHEN near_minima >= 2 * greatest(1, near_maxima) THEN 'inverted' ELSE 'inconclusive' END AS verdict FROM g",
}

#: The stream's detector and stillness filter over all events.
MOTION_SQL = f"WITH {_AP}, st(event_id, user_id, rn, m) AS (SELECT event_id, user_id, rn, {STILL_ALPHA}::DOUBLE * abs(value - {CENTRE}::DOUBLE) + (1 - {STILL_ALPHA}::DOUBLE) * {STILL_SEED}::DOUBLE FROM n WHERE rn = 1 UNION ALL SELECT n.event_id, n.user_id, n.rn, {STILL_ALPHA}::DOUBLE * abs(n.value - {CENTRE}::DOUBLE) + (1 - {STILL_ALPHA}::DOUBLE) * st.m FROM st JOIN n ON n.user_id = st.user_id AND n.rn = st.rn + 1) SELECT event_id, user_id, hit AS fired, m < {STILL_BOUND} AS still FROM wa JOIN st USING (event_id, user_id)"
