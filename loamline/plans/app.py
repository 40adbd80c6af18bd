"""What the app asks of frames, boxes and alerts, and its files: ranked worklists and composed reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamline.functions import app
from loamline.functions import decisions as d
from loamline.functions import sources as so
from loamline.functions.details import token
from loamline.operators import metrics as m
from loamline.plans import evaluation as ev
from loamline.plans import gait, records
from loamline.plans.event_series import _E
from loamline.plans.predictions import SQL, predictions
from loamline.plans.triage import feedback_entries
from loamline.sources.tables import events, table
from loamline.streaming.event_streams import shared

#: Turning rate above which a frame is smeared; the view that boxes are drawn in; stored sensitivities; rows of a worklist.
MOST_RATE, VIEW, STORED, TOP = 1.2, (390.0, 844.0), (0.1, 0.5, 0.95), 50
#: Pool images that a run scores at most, and the folder that none may come from.
LIMIT, FROZEN = 300, "held_out"


def _k():
    return F.get_json_object("props", "$.k").try_cast("int")


def frame_gate(spark, sf):
    """Captures with their turning rate, and whether the frame is looked at."""
    k = events(spark, sf).select("event_id", _k().alias("k"))
    c = gait.samples(spark, sf).filter("event_type = 'view'").join(k, "event_id")
    rate = app.magnitude(F.col("value") / 100, F.col("k") / 50, (F.col("event_id") % 11) / 10)
    return c.select("event_id", F.round(rate, 6).alias("rate"), app.frame_passes(token(F.col("details"), "trigger"), rate, MOST_RATE).alias("passes"))


def box_mapping(spark, sf):
    """Boxes made of events' numbers as the view draws them; zeros for those beyond it."""
    e = events(spark, sf).select("event_id", (F.col("value") / 100 - 0.4).alias("x"), (_k() / 60 - 0.3).alias("y"))
    box = app.view_box(F.col("x"), F.col("y"), F.lit(0.3), F.lit(0.2), *VIEW)
    return e.select("event_id", box.alias("b")).select("event_id", *(F.round(f"b.{c}", 6).alias(c) for c in "xywh"))


def alert_guard(spark, sf):
    """Detections by stored sensitivity, what it is healed to, and severity; safe classes and impossible confidences are ignored."""
    p = predictions(spark, sf).select("pred", F.when(F.col("vec_id") % 3 == 0, F.col("conf") * 1.3).otherwise(F.col("conf")).alias("conf"), F.explode(F.array(*map(F.lit, STORED))).alias("stored"))
    own = p.withColumn("healed", app.healed(F.col("stored")))
    threshold = d.alert_threshold(F.col("pred"), F.col("healed"))
    return own.groupBy("stored", "healed", app.guarded_severity(F.col("pred"), ev.CLS - 1, F.col("conf"), threshold).alias("severity")).agg(F.count("*").alias("n"))


def worklist_records(spark, sf, strategy="safety"):
    """(rank, record) of the rows that a person should look at first, each a nested record; ranks are without gaps."""
    p = predictions(spark, sf)
    score, value = d.ranking_scores(F.col("probs"))[strategy]
    scored = p.select("vec_id", "pred", "conf", "probs", F.round(score, 6).alias("score"), F.round(value, 6).alias("value"))
    top = scored.orderBy(F.desc("score"), "vec_id").limit(TOP)
    names, x = F.array(*map(F.lit, records.CLASSES)), F.col("probs")
    r6 = lambda c: F.round(c, 6)
    toxic = F.aggregate(F.slice(x, 1, ev.CLS - 1), F.lit(0.0), lambda a, b: a + b)
    uncertainty = F.struct(r6(d.least_confidence(x)).alias("least_confidence"), r6(d.margin(x)).alias("margin"), r6(d.entropy(x)).alias("entropy"))
    name = F.get(names, "pred")
    # Rows here are as many as ``TOP``.
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "vec_id"))
    record = F.struct(
        F.lit("candidate").alias("record_type"), F.col("rank"), F.concat(F.lit("pool/img_"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("path"), name.alias("prediction"), r6(F.col("conf")).alias("confidence"), name.alias("suggested_label"),
        F.map_from_arrays(names, F.transform(x, lambda v: F.round(v, 6))).alias("probs"), r6(toxic).alias("p_toxic"), r6(F.element_at(x, -1)).alias("p_safe"), d.app_severity(x).alias("app_severity"), F.lit(strategy).alias("strategy"), F.col("value").alias("strategy_value"), "score", uncertainty.alias("uncertainty"),
    )
    return top.withColumn("rank", rank).select("rank", record.alias("record"))


def worklist_file(spark, sf):
    """A ranked worklist as JSON lines, a line about the list before its candidates, and a table as text beside it; read back."""
    path = shared(spark, "worklist")
    rows = worklist_records(spark, sf)
    meta = rows.agg(F.to_json(F.struct(F.lit("meta").alias("record_type"), F.lit("safety").alias("strategy"), F.count("*").alias("selected"))).alias("value"), F.lit(0).alias("rank"))
    lines = meta.select("rank", "value").unionByName(rows.select("rank", F.to_json("record").alias("value")))
    # One file, as it has ``TOP`` lines and one.
    lines.coalesce(1).sortWithinPartitions("rank").select("value").write.text(path)
    of = lambda c: F.col(f"record.{c}")
    shown = F.concat_ws("  ", F.lpad(F.col("rank").cast("string"), 4, " "), F.format_number(of("score"), 3), F.rpad(of("suggested_label"), 13, " "), F.rpad(of("app_severity"), 9, " "), of("path"))
    rows.coalesce(1).sortWithinPartitions("rank").select(shown).write.text(f"{path}-table")
    schema = "record_type string, rank int, path string, prediction string, confidence double, probs map<string,double>, p_toxic double, p_safe double, app_severity string, score double, uncertainty struct<least_confidence: double, margin: double, entropy: double>"
    read = spark.read.schema(schema).json(path).filter("record_type = 'candidate'")
    return read.select("rank", "path", "prediction", "confidence", F.col("probs")["poison_oak"].alias("p_oak"), "p_toxic", "p_safe", "app_severity", "score", "uncertainty.margin", "uncertainty.entropy")


def composed_report(spark, sf):
    """One row, written as JSON and read back: the calibration report with its bins, confusion cells, sweep and classes as lists."""
    path, p = shared(spark, "report"), predictions(spark, sf)
    joined = lambda df, text, *order: df.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text.alias("x")))), lambda s: s["x"]), ",").alias("x"))
    texts = lambda *c: F.concat_ws(":", *(F.col(x).cast("string") for x in c))
    right = p.select("pred", "y", (F.col("pred") == F.col("y")).cast("long").alias("right"), m._place(F.col("conf"), 10).alias("bin"))
    bins = right.groupBy("bin").agg(F.count("*").alias("n"), F.sum("right").alias("right"))
    classes = right.groupBy("pred").agg(F.count("*").alias("n"), F.sum("right").alias("right"))
    sweep = ev.calibration_sweep(spark, sf).filter("mode = 'toxic_score'")
    # Each of these has a row for each bin, cell, threshold or class.
    parts = {
        "bins": joined(bins, texts("bin", "n", "right"), "bin"),
        "confusion": joined(m.confusion(p, ev.CLS), texts("y", "pred", "n"), "y", "pred"),
        "sweep": joined(sweep, texts("caught", "alarms"), "threshold"),
        "classes": joined(classes, texts("pred", "n", "right"), "pred"),
    }
    report = records.calibration_report(spark, sf)
    for name, part in parts.items():
        report = report.crossJoin(F.broadcast(part.withColumnRenamed("x", name)))
    report.write.json(path)
    return spark.read.schema(report.schema).json(path)


def pool_gate(spark, sf):
    """The first ``LIMIT`` pool images by path that no earlier run has seen, and why one is dropped before its hash is looked at.

    Every ninth document was seen; a path inside the frozen folder is a leak, however it is written.
    """
    i = F.col("doc_id")
    folder = F.when(i % 7 == 1, f"{FROZEN}/").when(i % 11 == 2, f"pool/../{FROZEN}/").otherwise("pool/")
    rows = table(spark, sf, "documents").select("doc_id", F.concat(folder, "lang", F.lit("/"), F.lpad(i.cast("string"), 9, "0"), F.lit(".jpg")).alias("path"))
    seen = rows.filter("doc_id % 9 = 0").select("doc_id")
    plain = F.regexp_replace("path", r"(^|/)[^/.]+/\.\./", "$1")
    fresh = rows.join(seen, "doc_id", "left_anti").orderBy("path").limit(LIMIT)
    return fresh.select("doc_id", "path", F.when(plain.startswith(f"{FROZEN}/"), "leak_heldout").alias("drop"))


def assert_classes(rows, column, contract):
    """``rows``, if the sorted values of a column are the contract's; else an error when a row is read."""
    found = rows.agg(F.array_join(F.sort_array(F.collect_set(column)), ",").alias("_found"))
    told = F.raise_error(F.concat(F.lit("the classes are "), F.col("_found"))).cast("string")
    return rows.crossJoin(F.broadcast(found)).withColumn(column, F.when(F.col("_found") == ",".join(contract), F.col(column)).otherwise(told)).drop("_found")


def class_contract(spark, sf):
    """Rows of each class of predictions, which must be the four of the contract."""
    named = predictions(spark, sf).select(F.get(F.array(*map(F.lit, records.CLASSES)), "y").alias("cls"))
    return assert_classes(named.groupBy("cls").agg(F.count("*").alias("n")), "cls", records.CLASSES)


def debug_confidences(spark, sf):
    """Every row's classes, the most confident first; of equal ones the first class."""
    own = F.transform("probs", lambda p, i: F.struct((-p).alias("less"), i.alias("cls"), p.alias("p")))
    ranked = predictions(spark, sf).select("vec_id", F.posexplode(F.sort_array(own)).alias("place", "s"))
    return ranked.select("vec_id", "place", F.get(F.array(*map(F.lit, records.CLASSES)), F.col("s.cls")).alias("cls"), F.round("s.p", 6).alias("confidence"))


def detection_log(spark, sf):
    """Feedback rows as the app's log holds them: without a usable place they lie at 0, 0 and say so."""
    e = feedback_entries(spark, sf)
    there = F.coalesce(so.usable_place(F.col("latitude"), F.col("longitude")), F.lit(False))
    return e.select("doc_id", there.alias("has_location"), *(F.round(F.when(there, F.col(c)).otherwise(0.0), 6).alias(c) for c in ("latitude", "longitude")))


QUERIES = {f.__name__: f for f in (frame_gate, box_mapping, alert_guard, worklist_file, composed_report, pool_gate, class_contract, debug_confidences, detection_log)}

_HEAL = f"least(greatest(s, {app.SENSITIVITY[0]}::DOUBLE), {app.SENSITIVITY[1]}::DOUBLE)"
_THR = f"least(greatest(CASE pred WHEN 2 THEN 0.52::DOUBLE ELSE 0.40::DOUBLE END + ({_HEAL} - 0.5::DOUBLE), 0.15::DOUBLE), 0.95::DOUBLE)"
_NAMES = "[" + ", ".join(f"'{c}'" for c in records.CLASSES) + "]"
_W, _H = VIEW
_STORED = ", ".join(f"({s}::DOUBLE)" for s in STORED)
ORACLES = {
    "pool_gate": f"WITH p AS (SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN '{FROZEN}/' WHEN doc_id % 11 = 2 THEN 'pool/../{FROZEN}/' ELSE 'pool/' END || lang || '/' || lpad(doc_id::VARCHAR, 9, '0') || '.jpg' AS path FROM documents WHERE doc_id % 9 <> 0 ORDER BY path LIMIT {LIMIT}) SELECT doc_id, path, CASE WHEN path LIKE '{FROZEN}/%' OR path LIKE 'pool/../{FROZEN}/%' THEN 'leak_heldout' END AS drop FROM p",
    "class_contract": f"WITH {SQL} SELECT {_NAMES}[y + 1] AS cls, count(*) AS n FROM pr GROUP BY 1",
    "debug_confidences": f"WITH {SQL}, x AS (SELECT vec_id, i, probs[i] AS p FROM pr CROSS JOIN (SELECT unnest(range(1, 5)) AS i)) SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) - 1)::INTEGER AS place, {_NAMES}[i] AS cls, round(p, 6) AS confidence FROM x",
    "detection_log": f"WITH {records._ENTRIES}, l AS (SELECT doc_id, (lat <> 0 OR lng <> 0) AND abs(lat) <= 90 AS there, lat, lng FROM g1) SELECT doc_id, there AS has_location, CASE WHEN there THEN round(lat, 6) ELSE 0 END AS latitude, CASE WHEN there THEN round(lng, 6) ELSE 0 END AS longitude FROM l",
    "frame_gate": f"WITH {_E}, {gait._CAP}, r AS (SELECT event_id, trig, sqrt((value / 100) * (value / 100) + (e.k / 50) * (e.k / 50) + ((event_id % 11) / 10) * ((event_id % 11) / 10)) AS rate FROM e JOIN cap USING (event_id)) SELECT event_id, round(rate, 6) AS rate, coalesce(trig = 'forced', FALSE) OR coalesce(rate <= {MOST_RATE}::DOUBLE, TRUE) AS passes FROM r",
    "box_mapping": f"WITH {_E}, b AS (SELECT event_id, (value / 100 - 0.4::DOUBLE) * {_W}::DOUBLE - 4 AS l, (1 - (k / 60 - 0.3::DOUBLE) - 0.2::DOUBLE) * {_H}::DOUBLE - 4 AS t FROM e), c AS (SELECT event_id, greatest(l, 0) AS x0, greatest(t, 0) AS y0, least(l + 0.3::DOUBLE * {_W}::DOUBLE + 8, {_W}::DOUBLE) AS x1, least(t + 0.2::DOUBLE * {_H}::DOUBLE + 8, {_H}::DOUBLE) AS y1 FROM b) SELECT event_id, CASE WHEN x1 >= x0 AND y1 >= y0 THEN round(x0, 6) ELSE 0 END AS x, CASE WHEN x1 >= x0 AND y1 >= y0 THEN round(y0, 6) ELSE 0 END AS y, CASE WHEN x1 >= x0 AND y1 >= y0 THEN round(x1 - x0, 6) ELSE 0 END AS w, CASE WHEN x1 >= x0 AND y1 >= y0 THEN round(y1 - y0, 6) ELSE 0 END AS h FROM c",
    "alert_guard": f"WITH {SQL}, c AS (SELECT pred, CASE WHEN vec_id % 3 = 0 THEN conf * 1.3::DOUBLE ELSE conf END AS conf, s FROM pr CROSS JOIN (VALUES {_STORED}) v(s)) SELECT s AS stored, {_HEAL} AS healed, CASE WHEN pred = 3 OR conf > 1 THEN 'ignore' WHEN conf >= {_THR} THEN 'alert' WHEN conf >= {_THR} - 0.2::DOUBLE THEN 'uncertain' ELSE 'ignore' END AS severity, count(*) AS n FROM c GROUP BY 1, 2, 3",
    "worklist_file": f"WITH {SQL}, {ev._SAFETY}, {ev._APP}, t AS (SELECT row_number() OVER (ORDER BY round(sf, 6) DESC, vec_id)::INTEGER AS rank, vec_id, round(sf, 6) AS score, mg, en FROM ms QUALIFY rank <= {TOP}) SELECT rank, 'pool/img_' || vec_id || '.jpg' AS path, {_NAMES}[pred + 1] AS prediction, round(conf, 6) AS confidence, round(probs[2], 6) AS p_oak, round(probs[1] + probs[2] + probs[3], 6) AS p_toxic, round(probs[4], 6) AS p_safe, sev AS app_severity, score, round(mg, 6) AS margin, round(en, 6) AS entropy FROM t JOIN ap USING (vec_id)",
    "composed_report": records.ORACLES["calibration_report"].replace("SELECT count(*) AS n, round(avg((y = pred)", f""", q AS (SELECT pred, y, (pred = y)::INTEGER AS r, {ev._BIN} AS bin FROM pr),
      lb AS (SELECT string_agg(bin || ':' || n || ':' || r, ',' ORDER BY bin) AS bins FROM (SELECT bin, count(*) AS n, sum(r) AS r FROM q GROUP BY 1)),
      lk AS (SELECT string_agg(pred || ':' || n || ':' || r, ',' ORDER BY pred) AS classes FROM (SELECT pred, count(*) AS n, sum(r) AS r FROM q GROUP BY 1)), {ev._CELLS},
      lc AS (SELECT string_agg(y || ':' || pred || ':' || n, ',' ORDER BY y, pred) AS confusion FROM cells),
      ls AS (SELECT string_agg(c || ':' || a, ',' ORDER BY t) AS sweep FROM (SELECT t, count(*) FILTER (y < 3 AND list_max(probs[1:3]) >= t) AS c, count(*) FILTER (y = 3 AND list_max(probs[1:3]) >= t) AS a FROM pr CROSS JOIN (VALUES {ev._T}) v(t) GROUP BY 1))
      SELECT any_value(bins) AS bins, any_value(classes) AS classes, any_value(confusion) AS confusion, any_value(sweep) AS sweep, count(*) AS n, round(avg((y = pred)""", 1).replace("FROM pr, e", "FROM pr, e, lb, lk, lc, ls"),
}
