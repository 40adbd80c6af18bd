"""Evaluation queries over predictions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.functions import decisions as d
from loamline.operators import metrics as m
from loamline.operators import probe
from loamline.operators.lineage import written
from loamline.operators.selection import percentiles
from loamline.plans.predictions import SQL, predictions
from loamline.sources.tables import table

CLS = 4
SWEEP = [round(0.05 * i, 2) for i in range(1, 20)]
SENSITIVITIES = [0.3, 0.5, 0.6, 0.8]


def confusion_matrix(spark, sf):
    return m.confusion(predictions(spark, sf), CLS)


def per_class_prf(spark, sf):
    return m.precision_recall(predictions(spark, sf), CLS)


def operating_point(spark, sf):
    return m.operating_point(predictions(spark, sf), SENSITIVITIES)


def safety_sweep(spark, sf):
    p = predictions(spark, sf).withColumn("toxic", F.array_max(F.slice("probs", 1, 3)))
    return m.threshold_sweep(p, "toxic", F.col("y") < 3, SWEEP)


def calibration_sweep(spark, sf):
    """Recall and false alarms at each threshold, by the strongest harmful class and by the leading class alone."""
    safe = F.size("probs") - 1
    strongest = F.array_max(F.slice("probs", 1, safe))
    leading = F.when(F.col("pred") < safe, F.col("conf")).otherwise(0.0)
    p = predictions(spark, sf).select("y", F.explode(F.array(F.struct(F.lit("toxic_score").alias("mode"), strongest.alias("s")), F.struct(F.lit("argmax").alias("mode"), leading.alias("s")))).alias("m")).select("y", "m.*")
    t = p.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in SWEEP])))
    toxic, alert = F.col("y") < CLS - 1, F.col("s") >= F.col("threshold")
    g = t.groupBy("mode", "threshold").agg(m.count_if(toxic & alert).alias("caught"), m.count_if(toxic).alias("n_toxic"), m.count_if(~toxic & alert).alias("alarms"), m.count_if(~toxic).alias("n_safe"))
    return g.select("mode", "threshold", "caught", (F.col("n_toxic") - F.col("caught")).alias("missed"), "alarms", m.share(F.col("caught"), F.col("n_toxic")).alias("recall"), m.share(F.col("alarms"), F.col("n_safe")).alias("false_alarm"))


def ece_bins(spark, sf):
    return m.calibration_bins(predictions(spark, sf))


def expected_calibration_error(spark, sf):
    b = m.calibration_bins(predictions(spark, sf)).filter("n > 0")
    gap = F.abs(F.col("accuracy") - F.col("mean_conf"))
    return b.agg(F.round(F.sum(gap * F.col("n")) / F.sum("n"), 4).alias("ece"), F.round(F.max(gap), 4).alias("mce"))


def per_class_ece(spark, sf):
    return m.per_class_calibration(predictions(spark, sf), CLS)


def accuracy_macro_f1(spark, sf):
    return m.summary(predictions(spark, sf), CLS)


def safety_metrics(spark, sf):
    return m.safety_metrics(predictions(spark, sf), SWEEP)


def operating_point_by_class(spark, sf):
    """Recall of each class that has rows, and for harmful ones the share that is taken for safe."""
    g = predictions(spark, sf).groupBy(F.col("y").alias("cls")).agg(F.count("*").alias("n"), m.count_if(F.col("pred") == F.col("y")).alias("hit"), m.count_if(F.col("pred") == CLS - 1).alias("safe"))
    return g.select("cls", "n", m.share(F.col("hit"), F.col("n")).alias("recall"), F.when(F.col("cls") < CLS - 1, m.share(F.col("safe"), F.col("n"))).alias("to_safe"))


# Logits are changed like images by blur, contrast or a bias: name, factor, addition to the safe classes' logits.
PERTURBATIONS = (("clean", 1.0, 0.0), ("flat", 0.1, 0.0), ("sharp", 3.0, 0.0), ("safe_bias", 1.0, 4.0), ("flat_bias", 0.3, 1.0))


def _perturbed(spark, sf):
    """(vec_id, y, name, probs, pred, conf) of each row under each perturbation."""
    kinds = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f).alias("factor"), F.lit(b).alias("bias")) for n, f, b in PERTURBATIONS])
    p = predictions(spark, sf).select("vec_id", "y", "z", F.explode(kinds).alias("k")).select("vec_id", "y", "z", "k.*")
    z = F.transform("z", lambda x, i: x * F.col("factor") + F.when(i >= CLS - 1, F.col("bias")).otherwise(0.0))
    q = p.select("vec_id", "y", "name", d.softmax(z).alias("q"))
    folded = F.concat(F.slice("q", 1, CLS - 1), F.array(F.aggregate(F.slice("q", CLS, 100), F.lit(0.0), lambda a, x: a + x)))
    r = q.select("vec_id", "y", "name", folded.alias("probs"))
    return r.withColumns({"pred": d.argmax(F.col("probs")), "conf": F.array_max("probs")})


def robustness_report(spark, sf):
    """Metrics under each perturbation, what they lose against the clean rows, and the place by lost recall; clean is 0."""
    from pyspark.sql import Window

    r = m.robustness(_perturbed(spark, sf), "name")
    clean = r.filter("name = 'clean'").select(*(F.col(c).alias(f"clean_{c}") for c in ("accuracy", "recall_argmax", "recall_summed", "to_safe")))
    lost = r.crossJoin(F.broadcast(clean))
    lost = lost.select(*r.columns, *(F.round(F.col(c) - F.col(f"clean_{c}"), 6).alias(f"d_{c}") for c in ("accuracy", "recall_argmax", "recall_summed", "to_safe")))
    # Rows here are as many as perturbations.
    place = F.row_number().over(Window.partitionBy(F.col("name") == "clean").orderBy("d_recall_summed", "name")).cast("long")
    return lost.withColumn("place", F.when(F.col("name") == "clean", F.lit(0).cast("long")).otherwise(place))


def blur_flip(spark, sf):
    """Of the harmful rows that clean logits take for harmful, the share that a perturbation turns to safe."""
    p = _perturbed(spark, sf).filter(F.col("y") < CLS - 1).select("vec_id", "name", (F.col("pred") == CLS - 1).alias("safe"))
    right = p.filter("name = 'clean' AND NOT safe").select("vec_id")
    g = p.filter("name <> 'clean'").join(right, "vec_id").groupBy("name").agg(F.count("*").alias("n_right"), m.count_if(F.col("safe")).alias("n_flipped"))
    return g.select("name", "n_right", "n_flipped", F.round(F.col("n_flipped") / F.greatest("n_right", F.lit(1)), 6).alias("flip"))


def model_deltas(spark, sf):
    """Agreement of clean and flattened probabilities, row by row: same leading class, mean and largest difference."""
    p = _perturbed(spark, sf)
    a, b = (p.filter(F.col("name") == n).select("vec_id", F.col("probs").alias(f"p_{n}"), F.col("pred").alias(f"c_{n}")) for n in ("clean", "flat"))
    gaps = F.zip_with("p_clean", "p_flat", lambda x, y: F.abs(x - y))
    j = a.join(b, "vec_id").select((F.col("c_clean") == F.col("c_flat")).alias("same"), F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x).alias("total"), F.array_max(gaps).alias("most"))
    return j.agg(F.count("*").alias("n"), m.share_or_nan(m.count_if(F.col("same")), F.count("*")).alias("agreement"), F.round(F.sum("total") / (CLS * F.count("*")), 6).alias("mean_delta"), F.round(F.max("most"), 6).alias("max_delta"))


def ood_harm(spark, sf, retention: float = 0.95):
    """What the app does with rows of unknown classes, by leading class, and how many of those the energy bound stops."""
    p = predictions(spark, sf).select("label", "pred", F.round(d.energy(F.col("z")), 9).alias("energy"), d.app_severity(F.col("probs")).alias("sev"))
    bound = percentiles(p.filter("label < 7"), [], "energy", {"bound": retention})
    g = p.filter("label >= 7").crossJoin(F.broadcast(bound)).groupBy("pred")
    surfaced = F.col("sev").isin("alert", "uncertain")
    return g.agg(F.count("*").alias("n"), m.count_if(F.col("sev") == "alert").alias("n_alert"), m.count_if(surfaced).alias("n_surfaced"), m.count_if(surfaced & (F.col("energy") > F.col("bound"))).alias("n_blocked"))


def auroc(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"))
    known = table(spark, sf, "labels")
    return m.auroc(known.join(docs, "doc_id"), F.col("n"), F.col("quality") == 1)


def ood_gate(spark, sf, retention: float = 0.95):
    """Energy bound that keeps a share of the known classes, and what it rejects of the others."""
    p = predictions(spark, sf).select("label", F.round(d.energy(F.col("z")), 9).alias("energy"))
    inside = F.col("label") < 7
    bound = percentiles(p.filter(inside), [], "energy", {"bound": retention})
    g = p.crossJoin(F.broadcast(bound))
    return g.agg(F.round(F.max("bound"), 6).alias("bound"), m.count_if(~inside & (F.col("energy") > F.col("bound"))).alias("n_rejected"), m.count_if(~inside).alias("n_outside"), m.count_if(inside & (F.col("energy") > F.col("bound"))).alias("n_lost"), m.count_if(inside).alias("n_inside"))


def energy_summary(spark, sf):
    p = predictions(spark, sf).select((F.col("label") < 7).alias("inside"), F.round(d.energy(F.col("z")), 9).alias("e"))
    ends = percentiles(p, ["inside"], "e", {"p5": 0.05, "p95": 0.95})
    return p.groupBy("inside").agg(F.round(F.avg("e"), 6).alias("mean")).join(ends, "inside").select("inside", "mean", F.round("p5", 6).alias("p5"), F.round("p95", 6).alias("p95"))


def model_agreement(spark, sf):
    """Rows by the decisions of two temperatures."""
    p = predictions(spark, sf).select("vec_id", "y", "pred", F.col("z"))
    q = d.softmax(F.transform("z", lambda x: x * 0.2))
    both = p.select("y", "pred", q.alias("q")).select("y", "pred", F.array(F.col("q")[0], F.col("q")[1], F.col("q")[2], F.aggregate(F.slice("q", 4, 10), F.lit(0.0), lambda a, x: a + x)).alias("q"))
    other = both.select("y", "pred", d.argmax(F.col("q")).alias("other"))
    return other.groupBy("pred", "other").agg(F.count("*").alias("n"), m.count_if(F.col("pred") == F.col("y")).alias("n_right"), m.count_if(F.col("other") == F.col("y")).alias("n_other_right"))


TEMPERATURES = [0.5, 0.8, 1.0, 1.25, 2.0, 4.0]


def temperature_grid(spark, sf):
    """Mean negative log likelihood of the true label at each temperature."""
    p = predictions(spark, sf).select("label", "z", F.explode(F.array(*[F.lit(t) for t in TEMPERATURES])).alias("temperature"))
    lse = lambda z, t: F.ln(F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp((x - F.array_max(z)) / t)))
    nll = lse(F.col("z"), F.col("temperature")) - (F.get("z", F.col("label")) - F.array_max("z")) / F.col("temperature")
    return p.groupBy("temperature").agg(F.round(F.avg(nll), 6).alias("nll"))


def _measures(p):
    x = F.col("probs")
    r6 = lambda c: F.round(c, 6)
    return p.select("vec_id", "label", r6(d.least_confidence(x)).alias("least_confidence"), r6(d.margin(x)).alias("margin"), r6(d.entropy(x)).alias("entropy"), r6(d.safety_score(x)).alias("safety"))


def ranking_measures(spark, sf):
    return _measures(predictions(spark, sf))


def worklist_topk(spark, sf):
    """The fifty rows that a person should look at first."""
    r = _measures(predictions(spark, sf)).select("vec_id", "safety")
    top = r.orderBy(F.desc("safety"), "vec_id").limit(50)
    from pyspark.sql import Window

    return top.select(F.row_number().over(Window.orderBy(F.desc("safety"), "vec_id")).cast("long").alias("place"), "vec_id", "safety")


def strategy_top(spark, sf, k: int = 20):
    """The k first rows of each ranking strategy, with score and value; ties by id."""
    p = predictions(spark, sf)
    tops = []
    for name, (score, value) in d.ranking_scores(F.col("probs")).items():
        scored = p.select(F.lit(name).alias("strategy"), "vec_id", F.round(score, 6).alias("score"), F.round(value, 6).alias("value"))
        tops.append(scored.orderBy(F.desc("score"), "vec_id").limit(k))
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return out


def worklist_composition(spark, sf, k: int = 50):
    """Leading classes and app decisions among the k first rows by safety; a class with 0.7 of them or more is a collapse."""
    p = predictions(spark, sf).select("vec_id", "pred", d.app_severity(F.col("probs")).alias("sev"), F.round(d.safety_score(F.col("probs")), 6).alias("score"))
    top = p.orderBy(F.desc("score"), "vec_id").limit(k)
    whole = top.agg(F.count("*").alias("total"), F.min("score").alias("least"), F.max("score").alias("most"), F.round(F.avg("score"), 6).alias("mean"))
    g = top.groupBy("pred").agg(F.count("*").alias("n"), m.count_if(F.col("sev") == "alert").alias("n_alert"), m.count_if(F.col("sev") == "uncertain").alias("n_uncertain"))
    of = F.col("n") / F.col("total")
    return g.crossJoin(F.broadcast(whole)).select("pred", "n", "n_alert", "n_uncertain", F.round(of, 6).alias("share"), ((F.col("total") >= 5) & (of >= 0.7)).alias("collapse"), "least", "most", "mean")


def temperature_fit(spark, sf, rounds: int = 4, points: int = 11):
    """The temperature with the least mean negative log likelihood, by grids in its logarithm, each around the best of the last.

    Each grid is one aggregate and its ``points`` rows come to the driver. Gives
    temperature, nll_before (at 1) and nll_after.
    """
    p = predictions(spark, sf).select("label", "z")
    lse = lambda z, t: F.ln(F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp((x - F.array_max(z)) / t)))

    def losses(temperatures):
        t = p.withColumn("t", F.explode(F.array(*[F.lit(float(x)) for x in temperatures])))
        nll = lse(F.col("z"), F.col("t")) - (F.get("z", F.col("label")) - F.array_max("z")) / F.col("t")
        return {r.t: r.nll for r in t.groupBy("t").agg(F.avg(nll).alias("nll")).collect()}

    import math

    low, high, found = -4.0, 4.0, losses([1.0])
    before = found.get(1.0)
    for _ in range(rounds):
        grid = [low + (high - low) * k / (points - 1) for k in range(points)]
        found |= losses([math.exp(g) for g in grid])
        best = math.log(min(found, key=lambda t: (found[t], t))) if found else 0.0
        half = (high - low) / (points - 1)
        low, high = best - half, best + half
    t = math.exp(best)
    return spark.createDataFrame([(round(t, 4), before and round(before, 6), found.get(min(found, key=found.get)) if found else None)], "temperature double, nll_before double, nll_after double").withColumn("nll_after", F.round("nll_after", 6))


def kfold_probe(spark, sf, folds: int = 5):
    """How well a linear model tells the classes apart on folds that it hasn't seen: mean and deviation of accuracy and harmful recall."""
    e = table(spark, sf, "embeddings").filter("label IS NOT NULL").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"), F.least("label", F.lit(CLS - 1)).cast("int").alias("y"))
    rows = written(probe.stratified_folds(e, "y", F.xxhash64("vec_id"), folds))
    return probe.spread(probe.predict_folds(rows, probe.fit_folds(rows, 64, CLS, folds)), CLS - 1)


def severity_counts(spark, sf):
    p = predictions(spark, sf)
    return p.groupBy("y", d.decide(F.col("probs")).alias("decision"), d.alert_level(F.col("conf")).alias("level")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (confusion_matrix, per_class_prf, operating_point, safety_sweep, calibration_sweep, ece_bins, expected_calibration_error, auroc, ood_gate, energy_summary, model_agreement, temperature_grid, ranking_measures, worklist_topk, severity_counts, per_class_ece, accuracy_macro_f1, safety_metrics, operating_point_by_class, robustness_report, blur_flip, model_deltas, ood_harm, strategy_top, worklist_composition, temperature_fit, kfold_probe)}

_T = ", ".join(f"({t}::DOUBLE)" for t in SWEEP)
_THR = "least(greatest(CASE pred WHEN 0 THEN 0.40::DOUBLE WHEN 1 THEN 0.40::DOUBLE WHEN 2 THEN 0.52::DOUBLE ELSE 0.50::DOUBLE END + (s - 0.5::DOUBLE), 0.15::DOUBLE), 0.95::DOUBLE)"
_DECIDE = f"CASE WHEN pred = 3 THEN 'safe' WHEN conf >= {_THR} THEN 'alert' WHEN conf >= {_THR} - 0.2::DOUBLE THEN 'uncertain' ELSE 'ignore' END"
_CELLS = "cells AS (SELECT a.y, b.pred, count(pr.vec_id) AS n FROM (SELECT unnest(range(4))::INTEGER AS y) a CROSS JOIN (SELECT unnest(range(4))::INTEGER AS pred) b LEFT JOIN pr ON pr.y = a.y AND pr.pred = b.pred GROUP BY 1, 2)"
_BIN = " + ".join(f"(conf >= {x!r}::DOUBLE)::INTEGER" for x in m.edges(10)[1:-1])
_BINS = f"bins AS (SELECT {_BIN} AS bin, count(*) AS n, avg(conf) AS c, avg((y = pred)::INTEGER::DOUBLE) AS a FROM pr GROUP BY 1)"
_EDGES = ", ".join(f"({i}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for i, (lo, hi) in enumerate(zip(m.edges(10), m.edges(10)[1:], strict=False)))
_ENERGY = "en AS (SELECT label, round(-(list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z)))))), 9) AS e FROM pr)"
_SAFETY = f"""ms AS (SELECT vec_id, label, probs, 1 - conf AS lc, list_sort(probs, 'DESC')[1] - list_sort(probs, 'DESC')[2] AS mg,
  list_sum(list_transform(probs, lambda x: -greatest(x, 1e-12) * ln(greatest(x, 1e-12)))) AS en,
  0.7 / (0.7::DOUBLE + 0.3::DOUBLE) * 2 * least(probs[1] + probs[2] + probs[3], probs[4])
  + 0.3 / (0.7::DOUBLE + 0.3::DOUBLE) * greatest(0, 1 - abs(list_max(probs[1:3]) - CASE WHEN list_position(probs[1:3], list_max(probs[1:3])) = 3 THEN 0.52 ELSE 0.4 END) / 0.2::DOUBLE) AS sf FROM pr)"""
_PERT = f"""pz AS (SELECT vec_id, y, name, list_transform(range(1, 11), lambda i: z[i] * f + CASE WHEN i > 3 THEN b ELSE 0 END) AS z FROM pr CROSS JOIN (VALUES {", ".join(f"('{n}', {f}::DOUBLE, {b}::DOUBLE)" for n, f, b in PERTURBATIONS)}) v(name, f, b)),
pe AS (SELECT vec_id, y, name, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM pz), p5 AS (SELECT vec_id, y, name, [e[1] / list_sum(e), e[2] / list_sum(e), e[3] / list_sum(e), list_sum(e[4:]) / list_sum(e)] AS probs FROM pe),
pt AS (SELECT *, (list_position(probs, list_max(probs)) - 1)::INTEGER AS pred, probs[1] + probs[2] + probs[3] AS su FROM p5)"""
_APP = "ax AS (SELECT *, list_max(probs[1:3]) AS hm, CASE WHEN list_position(probs[1:3], list_max(probs[1:3])) = 3 THEN 0.52::DOUBLE ELSE 0.40::DOUBLE END AS thr FROM pr), ap AS (SELECT *, CASE WHEN hm < probs[4] THEN 'ignore' WHEN hm >= thr THEN 'alert' WHEN hm >= thr - 0.2::DOUBLE THEN 'uncertain' ELSE 'ignore' END AS sev FROM ax)"

ORACLES = {
    "confusion_matrix": f"WITH {SQL}, {_CELLS} SELECT y, pred, n FROM cells",
    "per_class_prf": f"WITH {SQL}, {_CELLS}, r AS (SELECT y AS cls, sum(n)::BIGINT AS actual, sum(n) FILTER (y = pred)::BIGINT AS hit FROM cells GROUP BY 1), c AS (SELECT pred AS cls, sum(n)::BIGINT AS predicted FROM cells GROUP BY 1) SELECT cls, actual, predicted, hit, CASE WHEN predicted = 0 THEN 0 ELSE round(hit / predicted, 6) END AS prec, CASE WHEN actual = 0 THEN 0 ELSE round(hit / actual, 6) END AS rec, CASE WHEN hit = 0 THEN 0 ELSE round(2 * (hit / predicted) * (hit / actual) / (hit / predicted + hit / actual), 6) END AS f1 FROM r JOIN c USING (cls)",
    "operating_point": f"WITH {SQL}, dd AS (SELECT s AS sensitivity, y, pred, {_DECIDE} AS decision FROM pr CROSS JOIN (SELECT unnest({SENSITIVITIES})::DOUBLE AS s)) SELECT sensitivity, count(*) FILTER (y < 3) AS n_toxic, count(*) FILTER (y < 3 AND decision = 'safe') AS n_miss, count(*) FILTER (y < 3 AND decision = 'alert') AS n_alert, count(*) FILTER (y < 3 AND decision IN ('alert', 'uncertain')) AS n_surfaced, count(*) FILTER (y = 3 AND decision = 'alert') AS n_false_alarm, count(*) FILTER (y = 3 AND decision IN ('alert', 'uncertain')) AS n_false_surfaced, count(*) FILTER (y = pred) AS n_right, count(*) AS n FROM dd GROUP BY 1",
    "safety_sweep": f"WITH {SQL} SELECT t AS threshold, count(*) FILTER (y < 3 AND list_max(probs[1:3]) >= t) AS tp, count(*) FILTER (y = 3 AND list_max(probs[1:3]) >= t) AS fp, count(*) FILTER (y < 3) AS positives, count(*) AS n FROM pr CROSS JOIN (VALUES {_T}) v(t) GROUP BY 1",
    "calibration_sweep": f"WITH {SQL}, sc AS (SELECT y, 'toxic_score' AS mode, list_max(probs[1:3]) AS s FROM pr UNION ALL SELECT y, 'argmax', CASE WHEN pred < 3 THEN conf ELSE 0 END FROM pr) SELECT mode, t AS threshold, count(*) FILTER (y < 3 AND s >= t) AS caught, count(*) FILTER (y < 3 AND s < t) AS missed, count(*) FILTER (y = 3 AND s >= t) AS alarms, round(count(*) FILTER (y < 3 AND s >= t) / nullif(count(*) FILTER (y < 3), 0), 6) AS recall, round(count(*) FILTER (y = 3 AND s >= t) / nullif(count(*) FILTER (y = 3), 0), 6) AS false_alarm FROM sc CROSS JOIN (VALUES {_T}) v(t) GROUP BY 1, 2",
    "ece_bins": f"WITH {SQL}, {_BINS} SELECT e.bin, lo, hi, coalesce(n, 0) AS n, round(c, 6) AS mean_conf, round(a, 6) AS accuracy, round(abs(c - a), 6) AS gap FROM (VALUES {_EDGES}) e(bin, lo, hi) LEFT JOIN bins ON bins.bin = e.bin",
    "expected_calibration_error": f"WITH {SQL}, {_BINS} SELECT round(sum(abs(round(a, 6) - round(c, 6)) * n) / sum(n), 4) AS ece, round(max(abs(round(a, 6) - round(c, 6))), 4) AS mce FROM bins",
    "per_class_ece": f"WITH {SQL}, b AS (SELECT pred, {_BIN} AS bin, count(*) AS n, avg(conf) AS c, avg((y = pred)::INTEGER::DOUBLE) AS a FROM pr GROUP BY 1, 2), k AS (SELECT pred, sum(n) AS n, sum(abs(c - a) * n) / sum(n) AS ece FROM b GROUP BY 1), o AS (SELECT pred, avg(conf) AS c, avg((y = pred)::INTEGER::DOUBLE) AS a FROM pr GROUP BY 1) SELECT cls::INTEGER AS cls, coalesce(n, 0)::BIGINT AS n_predicted, round(ece, 6) AS ece, round(c, 6) AS mean_conf, round(a, 6) AS prec FROM (SELECT unnest(range(4)) AS cls) LEFT JOIN k ON k.pred = cls LEFT JOIN o ON o.pred = cls",
    "accuracy_macro_f1": f"WITH {SQL}, f AS (SELECT cls, round(coalesce(2 * count(*) FILTER (y = cls AND pred = cls) / nullif(count(*) FILTER (y = cls) + count(*) FILTER (pred = cls), 0), 0), 6) AS f1 FROM pr, (SELECT unnest(range(4)) AS cls) GROUP BY 1) SELECT count(*) AS n, round(count(*) FILTER (y = pred) / count(*), 6) AS accuracy, (SELECT round(avg(f1), 6) FROM f) AS macro_f1, round(count(*) FILTER (y < 3 AND pred < 3) / count(*) FILTER (y < 3), 6) AS toxic_recall FROM pr",
    "safety_metrics": f"WITH {SQL}, c AS (SELECT t AS threshold, count(*) FILTER (y < 3) AS actual_toxic, count(*) FILTER (y = 3) AS actual_safe, count(*) FILTER (y < 3 AND pred < 3 AND conf >= t) AS hit, count(*) FILTER (y < 3 AND pred = 3) AS hard, count(*) FILTER (y < 3 AND pred < 3 AND conf < t) AS below, count(*) FILTER (y = 3 AND pred < 3 AND conf >= t) AS alarm FROM pr CROSS JOIN (VALUES {_T}) v(t) GROUP BY 1) SELECT threshold, actual_toxic, actual_safe, round(hit / actual_toxic, 6) AS toxic_recall, round((actual_toxic - hit) / actual_toxic, 6) AS toxic_miss_total, round(hard / actual_toxic, 6) AS toxic_to_safe_hard, round(below / actual_toxic, 6) AS toxic_below_thr, round(alarm / actual_safe, 6) AS safe_false_alarm FROM c",
    "operating_point_by_class": f"WITH {SQL} SELECT y AS cls, count(*) AS n, round(avg((pred = y)::INTEGER), 6) AS recall, CASE WHEN y < 3 THEN round(avg((pred = 3)::INTEGER), 6) END AS to_safe FROM pr GROUP BY y",
    "robustness_report": f"WITH {SQL}, {_PERT}, g AS (SELECT name, count(*) AS n, count(*) FILTER (y < 3) AS n_toxic, round(avg((pred = y)::INTEGER), 6) AS accuracy, round(avg((pred < 3)::INTEGER) FILTER (y < 3), 6) AS recall_argmax, round(avg((su >= 0.5)::INTEGER) FILTER (y < 3), 6) AS recall_summed, round(avg((pred = 3)::INTEGER) FILTER (y < 3), 6) AS to_safe, round(avg((su < 0.5)::INTEGER) FILTER (y < 3), 6) AS below FROM pt GROUP BY 1), x AS (SELECT g.*, round(g.accuracy - c.accuracy, 6) AS d_accuracy, round(g.recall_argmax - c.recall_argmax, 6) AS d_recall_argmax, round(g.recall_summed - c.recall_summed, 6) AS d_recall_summed, round(g.to_safe - c.to_safe, 6) AS d_to_safe FROM g, g c WHERE c.name = 'clean') SELECT *, CASE WHEN name = 'clean' THEN 0 ELSE row_number() OVER (PARTITION BY name = 'clean' ORDER BY d_recall_summed, name) END AS place FROM x",
    "blur_flip": f"WITH {SQL}, {_PERT} SELECT b.name, count(*) AS n_right, count(*) FILTER (b.pred = 3) AS n_flipped, round(count(*) FILTER (b.pred = 3) / count(*), 6) AS flip FROM pt a JOIN pt b USING (vec_id) WHERE a.name = 'clean' AND b.name <> 'clean' AND a.y < 3 AND a.pred < 3 GROUP BY 1",
    "model_deltas": f"WITH {SQL}, {_PERT}, j AS (SELECT a.pred = b.pred AS same, list_transform(range(1, 5), lambda i: abs(a.probs[i] - b.probs[i])) AS g FROM pt a JOIN pt b USING (vec_id) WHERE a.name = 'clean' AND b.name = 'flat') SELECT count(*) AS n, round(avg(same::INTEGER), 6) AS agreement, round(sum(list_sum(g)) / (4 * count(*)), 6) AS mean_delta, round(max(list_max(g)), 6) AS max_delta FROM j",
    "ood_harm": f"WITH {SQL}, {_APP}, e AS (SELECT label, pred, sev, round(-(list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z)))))), 9) AS e FROM ap), b AS (SELECT quantile_cont(e, 0.95) AS bound FROM e WHERE label < 7) SELECT pred, count(*) AS n, count(*) FILTER (sev = 'alert') AS n_alert, count(*) FILTER (sev <> 'ignore') AS n_surfaced, count(*) FILTER (sev <> 'ignore' AND e > bound) AS n_blocked FROM e, b WHERE label >= 7 GROUP BY 1",
    "strategy_top": f"WITH {SQL}, {_SAFETY}, s AS (SELECT 'margin' AS strategy, vec_id, round(1 - mg, 6) AS score, round(mg, 6) AS value FROM ms UNION ALL SELECT 'least_confidence', vec_id, round(lc, 6), round(lc, 6) FROM ms UNION ALL SELECT 'entropy', vec_id, round(en / ln(4::DOUBLE), 6), round(en, 6) FROM ms UNION ALL SELECT 'safety', vec_id, round(sf, 6), round(sf, 6) FROM ms) SELECT strategy, vec_id, score, value FROM s QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY score DESC, vec_id) <= 20",
    "worklist_composition": f"WITH {SQL}, {_SAFETY}, {_APP}, w AS (SELECT pred, sev, round(sf, 6) AS score FROM ms JOIN ap USING (vec_id) ORDER BY score DESC, vec_id LIMIT 50), t AS (SELECT count(*) AS total, min(score) AS least, max(score) AS most, round(avg(score), 6) AS mean FROM w) SELECT pred, count(*) AS n, count(*) FILTER (sev = 'alert') AS n_alert, count(*) FILTER (sev = 'uncertain') AS n_uncertain, round(count(*) / any_value(total), 6) AS share, any_value(total) >= 5 AND count(*) / any_value(total) >= 0.7 AS collapse, any_value(least) AS least, any_value(most) AS most, any_value(mean) AS mean FROM w, t GROUP BY pred",
    "auroc": "WITH x AS (SELECT length(text) AS s, quality = 1 AS p FROM labels JOIN documents USING (doc_id)), r AS (SELECT p, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM x) SELECT count(*) FILTER (p) AS n_pos, count(*) FILTER (NOT p) AS n_neg, round((sum(rk) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2) / (count(*) FILTER (p) * count(*) FILTER (NOT p)), 6)::DOUBLE AS auroc FROM r",
    "ood_gate": f"WITH {SQL}, {_ENERGY}, b AS (SELECT quantile_cont(e, 0.95) AS bound FROM en WHERE label < 7) SELECT round(max(bound), 6) AS bound, count(*) FILTER (label >= 7 AND e > bound) AS n_rejected, count(*) FILTER (label >= 7) AS n_outside, count(*) FILTER (label < 7 AND e > bound) AS n_lost, count(*) FILTER (label < 7) AS n_inside FROM en CROSS JOIN b",
    "energy_summary": f"WITH {SQL}, {_ENERGY} SELECT label < 7 AS inside, round(avg(e), 6) AS mean, round(quantile_cont(e, 0.05), 6) AS p5, round(quantile_cont(e, 0.95), 6) AS p95 FROM en GROUP BY 1",
    "model_agreement": f"WITH {SQL}, q1 AS (SELECT y, pred, list_transform(z, lambda x: exp((x - list_max(z)) * 0.2)) AS e FROM pr), q2 AS (SELECT y, pred, [e[1], e[2], e[3], list_sum(e[4:])] AS q FROM q1), q3 AS (SELECT y, pred, (list_position(q, list_max(q)) - 1)::INTEGER AS other FROM q2) SELECT pred, other, count(*) AS n, count(*) FILTER (pred = y) AS n_right, count(*) FILTER (other = y) AS n_other_right FROM q3 GROUP BY 1, 2",
    "temperature_grid": f"WITH {SQL} SELECT t AS temperature, round(avg(ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / t)))) - (z[label + 1] - list_max(z)) / t), 6) AS nll FROM pr CROSS JOIN (SELECT unnest({TEMPERATURES})::DOUBLE AS t) GROUP BY 1",
    "ranking_measures": f"WITH {SQL}, {_SAFETY} SELECT vec_id, label, round(lc, 6) AS least_confidence, round(mg, 6) AS margin, round(en, 6) AS entropy, round(sf, 6) AS safety FROM ms",
    "worklist_topk": f"WITH {SQL}, {_SAFETY} SELECT row_number() OVER (ORDER BY round(sf, 6) DESC, vec_id) AS place, vec_id, round(sf, 6) AS safety FROM ms ORDER BY 1 LIMIT 50",
    "severity_counts": f"WITH {SQL}, dd AS (SELECT y, conf, {_DECIDE.replace('(s -', '(0.5::DOUBLE -')} AS decision FROM pr) SELECT y, decision, CASE WHEN conf < 0.75 THEN 'low' WHEN conf < 0.9 THEN 'medium' ELSE 'high' END AS level, count(*) AS n FROM dd GROUP BY 1, 2, 3",
}
