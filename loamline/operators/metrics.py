"""Classifier metrics as grouped aggregates; every table comes from one pass over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.decisions import decide


def share(n: Column, of: Column) -> Column:
    """n / of rounded to six places; null where ``of`` is zero."""
    return F.round(F.try_divide(n, of), 6)


def share_or_zero(n: Column, of: Column) -> Column:
    """n / of rounded to six places; 0 where ``of`` is zero."""
    return F.coalesce(share(n, of), F.lit(0.0))


def share_or_nan(n: Column, of: Column) -> Column:
    """n / of rounded to six places; NaN where ``of`` is zero."""
    return F.coalesce(share(n, of), F.lit(float("nan")))


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def confusion(df: DataFrame, classes: int) -> DataFrame:
    """(y, pred, n) with zero cells."""
    spark = df.sparkSession
    cells = spark.range(classes).select(F.col("id").cast("int").alias("y")).crossJoin(spark.range(classes).select(F.col("id").cast("int").alias("pred")))
    return cells.join(df.groupBy("y", "pred").agg(F.count("*").alias("n")), ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def precision_recall(df: DataFrame, classes: int) -> DataFrame:
    """Precision, recall and F1 of each class, from the confusion cells; 0 where there is nothing to divide by."""
    cells = confusion(df, classes)
    same = F.col("y") == F.col("pred")
    rows = cells.groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("actual"), F.sum(F.when(same, F.col("n")).otherwise(0)).alias("hit"))
    cols = cells.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    j = rows.join(cols, "cls")
    return j.select("cls", "actual", "predicted", "hit", share_or_zero(F.col("hit"), F.col("predicted")).alias("prec"), share_or_zero(F.col("hit"), F.col("actual")).alias("rec"), share_or_zero(2 * F.col("hit"), F.col("actual") + F.col("predicted")).alias("f1"))


def summary(df: DataFrame, classes: int) -> DataFrame:
    """Accuracy, F1 as the mean over all classes, and the share of harmful rows that any harmful class leads; one row.

    All come from the confusion cells; NaN without rows to divide by.
    """
    cells = confusion(df, classes)
    f1 = precision_recall(df, classes).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    harmful = F.col("y") < classes - 1
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    own = cells.agg(F.sum("n").alias("n"), share_or_nan(total(F.col("y") == F.col("pred")), F.sum("n")).alias("accuracy"), share_or_nan(total(harmful & (F.col("pred") < classes - 1)), total(harmful)).alias("toxic_recall"))
    return own.crossJoin(F.broadcast(f1)).select("n", "accuracy", "macro_f1", "toxic_recall")


def safety_metrics(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """Recall, misses and false alarms at each threshold; a row is flagged if a harmful class leads and reaches it.

    Shares of nothing are NaN.
    """
    d = df.select("y", "pred", "conf", (F.size("probs") - 1).alias("safe"), F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    toxic, leads = F.col("y") < F.col("safe"), F.col("pred") < F.col("safe")
    flagged = leads & (F.col("conf") >= F.col("threshold"))
    g = d.groupBy("threshold").agg(
        count_if(toxic).alias("actual_toxic"),
        count_if(~toxic).alias("actual_safe"),
        count_if(toxic & flagged).alias("hit"),
        count_if(toxic & ~leads).alias("hard"),
        count_if(toxic & leads & ~flagged).alias("below"),
        count_if(~toxic & flagged).alias("alarm"),
    )
    of = lambda n, total, name: share_or_nan(F.col(n) if isinstance(n, str) else n, F.col(total)).alias(name)
    return g.select(
        "threshold", "actual_toxic", "actual_safe", of("hit", "actual_toxic", "toxic_recall"), of(F.col("actual_toxic") - F.col("hit"), "actual_toxic", "toxic_miss_total"),
        of("hard", "actual_toxic", "toxic_to_safe_hard"), of("below", "actual_toxic", "toxic_below_thr"), of("alarm", "actual_safe", "safe_false_alarm"),
    )


def robustness(df: DataFrame, by: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy and recalls of each value of ``by``: by the leading class, and by the summed probability of harmful ones."""
    safe = F.size("probs") - 1
    toxic, leads = F.col("y") < safe, F.col("pred") < safe
    summed = F.aggregate(F.slice("probs", 1, safe), F.lit(0.0), lambda a, x: a + x)
    alerts = summed >= threshold
    n_toxic = count_if(toxic)
    return df.groupBy(by).agg(
        F.count("*").alias("n"),
        n_toxic.alias("n_toxic"),
        share_or_nan(count_if(F.col("y") == F.col("pred")), F.count("*")).alias("accuracy"),
        share_or_nan(count_if(toxic & leads), n_toxic).alias("recall_argmax"),
        share_or_nan(count_if(toxic & alerts), n_toxic).alias("recall_summed"),
        share_or_nan(count_if(toxic & ~leads), n_toxic).alias("to_safe"),
        share_or_nan(count_if(toxic & ~alerts), n_toxic).alias("below"),
    )


def operating_point(df: DataFrame, sensitivities: list[float]) -> DataFrame:
    """Misses, alerts and false alarms of the decision rule at several sensitivities, in one pass."""
    rules = F.array(*[F.struct(F.lit(s).alias("sensitivity"), decide(F.col("probs"), s).alias("decision")) for s in sensitivities])
    d = df.select("y", "pred", F.size("probs").alias("k"), F.explode(rules).alias("r")).select("y", "pred", "k", "r.*")
    toxic = F.col("y") < F.col("k") - 1
    is_ = lambda x: F.col("decision") == x
    return d.groupBy("sensitivity").agg(
        count_if(toxic).alias("n_toxic"),
        count_if(toxic & is_("safe")).alias("n_miss"),
        count_if(toxic & is_("alert")).alias("n_alert"),
        count_if(toxic & is_("alert") | toxic & is_("uncertain")).alias("n_surfaced"),
        count_if(~toxic & is_("alert")).alias("n_false_alarm"),
        count_if(~toxic & (is_("alert") | is_("uncertain"))).alias("n_false_surfaced"),
        count_if(F.col("y") == F.col("pred")).alias("n_right"),
        F.count("*").alias("n"),
    )


def threshold_sweep(df: DataFrame, score: str, positive: Column, thresholds: list[float]) -> DataFrame:
    """True and false positives at each threshold."""
    d = df.select(F.col(score).alias("s"), positive.alias("p"), F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    return d.groupBy("threshold").agg(count_if(F.col("p") & (F.col("s") >= F.col("threshold"))).alias("tp"), count_if(~F.col("p") & (F.col("s") >= F.col("threshold"))).alias("fp"), count_if(F.col("p")).alias("positives"), F.count("*").alias("n"))


def edges(bins: int) -> list[float]:
    """Bin edges by repeated addition of 1 / bins, as multiples of the step."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def _place(conf: Column, bins: int) -> Column:
    return sum((F.when(conf >= x, 1).otherwise(0) for x in edges(bins)[1:-1]), F.lit(0))


def calibration_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """Rows, mean confidence, accuracy and their gap of each right-open bin; the last one is closed, empty ones have nulls."""
    e = edges(bins)
    g = df.groupBy(_place(F.col("conf"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("c"), F.avg(F.when(F.col("y") == F.col("pred"), 1.0).otherwise(0.0)).alias("a"))
    every = df.sparkSession.createDataFrame([(i, e[i], e[i + 1]) for i in range(bins)], "bin int, lo double, hi double")
    r = every.join(g, "bin", "left")
    return r.select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), F.round("c", 6).alias("mean_conf"), F.round("a", 6).alias("accuracy"), F.round(F.abs(F.col("c") - F.col("a")), 6).alias("gap"))


def per_class_calibration(df: DataFrame, classes: int, bins: int = 10) -> DataFrame:
    """Calibration error of the rows predicted as each class; a class that is never predicted has nulls."""
    hit = F.when(F.col("y") == F.col("pred"), 1.0).otherwise(0.0)
    g = df.groupBy("pred", _place(F.col("conf"), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum("conf").alias("c"), F.sum(hit).alias("a"))
    own = g.groupBy("pred").agg(F.sum("n").alias("n_predicted"), (F.sum(F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"), (F.sum("c") / F.sum("n")).alias("c"), (F.sum("a") / F.sum("n")).alias("a"))
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("pred"))
    return every.join(own, "pred", "left").select(F.col("pred").alias("cls"), F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"), F.round("ece", 6).alias("ece"), F.round("c", 6).alias("mean_conf"), F.round("a", 6).alias("prec"))


def class_weights(counts: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """``counts(cls, n)`` with inverse frequency weights, divided by their mean over classes.

    ``classes`` must all have rows: a class without any would get all the weight, so that is an error.
    """
    if classes is not None:
        found = {r.cls for r in counts.filter("n > 0").filter(F.col("cls").isin(classes)).select("cls").collect()}
        if missing := [c for c in classes if c not in found]:
            raise ValueError(f"no rows for {missing}")
    t = counts.agg(F.avg(1 / F.col("n")).alias("mean"))
    return counts.crossJoin(F.broadcast(t)).select("cls", "n", F.round(1 / F.col("n") / F.col("mean"), 6).alias("weight"))


def auroc(df: DataFrame, score: Column, positive: Column, ranges: int = 200) -> DataFrame:
    """Area under the curve by average ranks; NaN without rows of both kinds.

    Scores are counted first. Distinct scores are then sorted into ranges by Spark, each
    range adds up on its own, and what lies below a range comes from the ranges' totals,
    of which there are ``ranges`` at most.
    """
    g = df.select(score.alias("s"), positive.alias("p")).groupBy("s").agg(count_if(F.col("p")).alias("pos"), count_if(~F.col("p")).alias("neg"))
    cuts = sorted(set(g.agg(F.percentile_approx("s", [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0] or []))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>"), lambda c: c <= F.col("s")))
    ranged = g.withColumn("part", part)
    own = Window.partitionBy("part").orderBy("s")
    inner = ranged.withColumn("lower", F.sum("neg").over(own) - F.col("neg"))
    sums = inner.groupBy("part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2)).alias("u"))
    below = sums.withColumn("below", F.sum("neg").over(Window.orderBy("part")) - F.col("neg"))
    t = below.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"), F.sum(F.col("u") + F.col("pos") * F.col("below")).alias("u"))
    return t.select("n_pos", "n_neg", share_or_nan(F.col("u"), F.col("n_pos") * F.col("n_neg")).alias("auroc"))
