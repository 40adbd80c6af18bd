"""Queries over the event streams of users, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamline.operators import ranks, series
from loamline.operators.lineage import written
from loamline.operators.segments import lagged
from loamline.operators.selection import percentiles
from loamline.sources.tables import events

ALPHA, WAIT, FLOOR, WIDTH = 0.35, 6 * 3_600_000_000, 20.0, 7
#: Now, for windows that look back: one hour after the last event.
GAP = 24 * 3_600_000_000


def _base(spark, sf):
    return events(spark, sf).select("event_id", "user_id", "event_type", "value", "t")


def asof_prev_event(spark, sf):
    """For each purchase the user's latest view before it."""
    a = series.as_of(_base(spark, sf), "user_id", "t", F.col("event_type") == "purchase", F.col("event_type") == "view", ["event_id", "value"])
    return a.select("event_id", "user_id", "prev_event_id", "prev_value")


def nearest_event(spark, sf):
    """For each purchase the nearest click of the user, and how far in time."""
    n = series.nearest(_base(spark, sf), "user_id", "t", F.col("event_type") == "purchase", F.col("event_type") == "click")
    return n.select("event_id", "user_id", "near_id", "near_gap")


def local_maxima(spark, sf):
    return series.local_maxima(_base(spark, sf), "user_id", ["t", "event_id"], "value", FLOOR).select("event_id", "user_id", "peak")


def ema_series(spark, sf):
    e = series.ema(_base(spark, sf), "user_id", ["t", "event_id"], "value", ALPHA)
    return e.select("event_id", "user_id", F.round(F.col("ema") + 1e-9, 6).alias("ema"))


def ema_seeded(spark, sf):
    """Starts high at 1 and moves slowly; below 30 counts as still."""
    e = series.ema(_base(spark, sf), "user_id", ["t", "event_id"], "value", 0.033, seed=1.0)
    return e.select("event_id", "user_id", F.round(F.col("ema") + 1e-9, 6).alias("ema"), (F.round(F.col("ema") + 1e-9, 6) < 30).alias("still"))


def refractory_picks(spark, sf):
    p = series.refractory(_base(spark, sf), "user_id", ["t", "event_id"], "t", WAIT)
    return p.filter("picked = 1").select("event_id", "user_id", "t")


def rolling_rms(spark, sf):
    """Root of the mean square of seven events around each; beyond a user's events zeros count."""
    return series.framed_rms(_base(spark, sf), "user_id", "t", ["event_id"], "value", F.lit(WIDTH)).select("event_id", "user_id", F.round("rms", 6).alias("rms"))


def gaps(rows):
    """``rows`` with ``gap``, the time since the user's row before; null for the first."""
    return lagged(rows, "user_id", ["t", "event_id"], "t", ["_before"]).withColumn("gap", F.col("t") - F.col("_before")).drop("_before")


def period_summary(spark, sf):
    """Gaps between a user's events: mean, median and events a day."""
    g = written(gaps(_base(spark, sf)).filter("gap IS NOT NULL"))
    means = g.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("gap") / 1e6, 3).alias("mean_s"))
    return means.join(percentiles(g, ["user_id"], "gap", {"median": 0.5}), "user_id").select("user_id", "n", "mean_s", F.round(F.col("median") / 1e6, 3).alias("median_s"))


def skew_by_user(spark, sf):
    """Population skewness from the moments, and its verdict."""
    m = _base(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.skewness("value").alias("s"))
    s = F.round("s", 6)
    return m.select("user_id", "n", s.alias("skew"), F.when(s > 0.3, "positive").when(s < -0.3, "negative").otherwise("unclear").alias("verdict"))


def props_kv(spark, sf):
    """The number in each event's properties, summed by type."""
    e = events(spark, sf).select("event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.min("k").alias("least"), F.max("k").alias("most"))


def recent_or_top10(spark, sf):
    """Each user's events of the last day before the last event of all; if there are none, the ten newest."""
    e = _base(spark, sf)
    last = e.agg(F.max("t").alias("now"))
    w = Window.partitionBy("user_id").orderBy(F.desc("t"), F.desc("event_id"))
    r = e.crossJoin(F.broadcast(last)).withColumns({"recent": F.col("t") >= F.col("now") - GAP, "place": F.row_number().over(w)})
    any_recent = F.max("recent").over(Window.partitionBy("user_id"))
    return r.withColumn("any", any_recent).filter("recent OR (NOT any AND place <= 10)").select("event_id", "user_id", "recent")


def log_filters(spark, sf):
    """The three newest errors of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("t"), F.desc("event_id"))
    return _base(spark, sf).filter("event_type = 'error'").select("event_id", "user_id", "value", F.row_number().over(w).cast("long").alias("place")).filter("place <= 3")


def bounding_region(spark, sf):
    """Box of each type's points (value, k): its centre, and one and a half times its range, but 0.005 at least."""
    e = events(spark, sf).select("event_type", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
    g = e.groupBy("event_type").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return g.select("event_type", F.round((F.col("x0") + F.col("x1")) / 2, 6).alias("cx"), F.round((F.col("y0") + F.col("y1")) / 2, 6).alias("cy"), F.round(F.greatest((F.col("x1") - F.col("x0")) * 1.5, F.lit(0.005)), 6).alias("dx"), F.round(F.greatest((F.col("y1") - F.col("y0")) * 1.5, F.lit(0.005)), 6).alias("dy"))


def captures_per_minute(spark, sf):
    """Events in each hour, from whole windows that don't overlap."""
    return _base(spark, sf).groupBy(F.floor(F.col("t") / 3_600_000_000).alias("hour")).agg(F.count("*").alias("n"))


def telemetry_latest(spark, sf):
    """The latest event of each user in each window of six hours."""
    g = _base(spark, sf).groupBy("user_id", F.floor(F.col("t") / WAIT).alias("slot"))
    return g.agg(F.max_by("event_id", F.struct("t", "event_id")).alias("event_id"), F.count("*").alias("n"))


def sessions(spark, sf):
    """Runs of a user's events with less than a day between neighbours."""
    new = gaps(_base(spark, sf)).withColumn("new", F.coalesce(F.col("gap") >= GAP, F.lit(True)).cast("long"))
    e = ranks.running(new, "user_id", F.col("t"), ["event_id"], F.col("new")).withColumn("session", F.col("before") + F.col("new"))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))


def keyed_upsert(spark, sf):
    """Later events of a user and type replace earlier ones."""
    g = _base(spark, sf).groupBy("user_id", "event_type")
    return g.agg(F.max_by(F.struct("event_id", "value"), F.struct("t", "event_id")).alias("x"), F.count("*").alias("n_seen")).select("user_id", "event_type", "x.event_id", "x.value", "n_seen")


def sync_counts(spark, sf):
    """How many distinct types a user has shown up to each event."""
    e = _base(spark, sf)
    first = e.groupBy("user_id", "event_type").agg(F.min(F.struct("t", "event_id")).alias("first"))
    f = e.join(first, ["user_id", "event_type"]).withColumn("new", (F.struct("t", "event_id") == F.col("first")).cast("long"))
    r = ranks.running(f, "user_id", F.col("t"), ["event_id"], F.col("new"))
    return r.select("event_id", "user_id", (F.col("before") + F.col("new")).alias("n_types"))


QUERIES = {f.__name__: f for f in (asof_prev_event, nearest_event, local_maxima, ema_series, ema_seeded, refractory_picks, rolling_rms, period_summary, skew_by_user, props_kv, recent_or_top10, log_filters, bounding_region, captures_per_minute, telemetry_latest, sessions, keyed_upsert, sync_counts)}

_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t, (props->>'$.k')::INTEGER AS k FROM events)"
_O = "OVER (PARTITION BY user_id ORDER BY t, event_id)"
_RN = f"n AS (SELECT *, row_number() {_O} AS rn FROM e)"
_EMA = "WITH RECURSIVE {e}, {rn}, s(event_id, user_id, rn, v) AS (SELECT event_id, user_id, rn, {first} FROM n WHERE rn = 1 UNION ALL SELECT n.event_id, n.user_id, n.rn, {a}::DOUBLE * n.value + (1 - {a}::DOUBLE) * s.v FROM s JOIN n ON n.user_id = s.user_id AND n.rn = s.rn + 1)"
ORACLES = {
    "asof_prev_event": f"WITH {_E} SELECT p.event_id, p.user_id, v.event_id AS prev_event_id, v.value AS prev_value FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.t >= v.t",
    "nearest_event": f"WITH {_E}, j AS (SELECT p.event_id, p.user_id, c.event_id AS near_id, abs(p.t - c.t) AS near_gap, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - c.t), c.t, c.event_id) AS i FROM e p LEFT JOIN e c ON c.user_id = p.user_id AND c.event_type = 'click' WHERE p.event_type = 'purchase') SELECT event_id, user_id, near_id, near_gap FROM j WHERE i = 1",
    "local_maxima": f"WITH {_E}, d AS (SELECT event_id, user_id, value, lag(value, 1, 0) {_O} AS one, lag(value, 2, 0) {_O} AS two FROM e) SELECT event_id, user_id, one AS peak FROM d WHERE one - two > 0 AND value - one <= 0 AND one >= {FLOOR}",
    "ema_series": _EMA.format(e=_E, rn=_RN, first="value", a=ALPHA) + " SELECT event_id, user_id, round(v + 1e-9::DOUBLE, 6) AS ema FROM s",
    "ema_seeded": _EMA.format(e=_E, rn=_RN, first="0.033::DOUBLE * value + (1 - 0.033::DOUBLE) * 1.0::DOUBLE", a=0.033) + " SELECT event_id, user_id, round(v + 1e-9::DOUBLE, 6) AS ema, round(v + 1e-9::DOUBLE, 6) < 30 AS still FROM s",
    "refractory_picks": f"WITH RECURSIVE {_E}, {_RN}, s(event_id, user_id, rn, last, t, hit) AS (SELECT event_id, user_id, rn, t, t, TRUE FROM n WHERE rn = 1 UNION ALL SELECT n.event_id, n.user_id, n.rn, CASE WHEN n.t - s.last >= {WAIT} THEN n.t ELSE s.last END, n.t, n.t - s.last >= {WAIT} FROM s JOIN n ON n.user_id = s.user_id AND n.rn = s.rn + 1) SELECT event_id, user_id, t FROM s WHERE hit",
    "rolling_rms": f"WITH {_E} SELECT event_id, user_id, round(sqrt(sum(floor(value * value * 1000000)::DECIMAL(38,0)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)::DOUBLE / 1000000 / 7), 6) AS rms FROM e",
    "period_summary": f"WITH {_E}, g AS (SELECT user_id, t - lag(t) {_O} AS gap FROM e) SELECT user_id, count(gap) AS n, round(avg(gap) / 1e6::DOUBLE, 3) AS mean_s, round(quantile_cont(gap, 0.5) / 1e6::DOUBLE, 3) AS median_s FROM g WHERE gap IS NOT NULL GROUP BY 1",
    "skew_by_user": f"WITH {_E}, m AS (SELECT user_id, avg(value) AS mu FROM e GROUP BY 1), c AS (SELECT user_id, count(*) AS n, round(avg((value - mu) ** 3) / avg((value - mu) ** 2) ** 1.5, 6) AS skew FROM e JOIN m USING (user_id) GROUP BY 1) SELECT user_id, n, skew, CASE WHEN skew > 0.3 THEN 'positive' WHEN skew < -0.3 THEN 'negative' ELSE 'unclear' END AS verdict FROM c",
    "props_kv": f"WITH {_E} SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, min(k) AS least, max(k) AS most FROM e GROUP BY 1",
    "recent_or_top10": f"WITH {_E}, r AS (SELECT *, t >= (SELECT max(t) FROM e) - {GAP} AS recent, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS place FROM e), q AS (SELECT *, bool_or(recent) OVER (PARTITION BY user_id) AS has FROM r) SELECT event_id, user_id, recent FROM q WHERE recent OR (NOT has AND place <= 10)",
    "log_filters": f"WITH {_E} SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS place FROM e WHERE event_type = 'error' QUALIFY place <= 3",
    "bounding_region": f"WITH {_E} SELECT event_type, round((min(value) + max(value)) / 2, 6) AS cx, round((min(k) + max(k)) / 2::DOUBLE, 6) AS cy, round(greatest((max(value) - min(value)) * 1.5::DOUBLE, 0.005), 6) AS dx, round(greatest((max(k) - min(k)) * 1.5::DOUBLE, 0.005), 6) AS dy FROM e GROUP BY 1",
    "captures_per_minute": f"WITH {_E} SELECT t // 3600000000 AS hour, count(*) AS n FROM e GROUP BY 1",
    "telemetry_latest": f"WITH {_E} SELECT user_id, t // {WAIT} AS slot, arg_max(event_id, (t, event_id)) AS event_id, count(*) AS n FROM e GROUP BY 1, 2",
    "sessions": f"WITH {_E}, d AS (SELECT *, CASE WHEN coalesce(t - lag(t) {_O} >= {GAP}, TRUE) THEN 1 ELSE 0 END AS new FROM e), s AS (SELECT *, sum(new) {_O} AS session FROM d) SELECT user_id, session::BIGINT AS session, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM s GROUP BY 1, 2",
    "keyed_upsert": f"WITH {_E} SELECT user_id, event_type, arg_max(event_id, (t, event_id)) AS event_id, arg_max(value, (t, event_id)) AS value, count(*) AS n_seen FROM e GROUP BY 1, 2",
    "sync_counts": f"WITH {_E}, f AS (SELECT *, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) = 1)::INTEGER AS first FROM e) SELECT event_id, user_id, sum(first) {_O}::BIGINT AS n_types FROM f",
}
