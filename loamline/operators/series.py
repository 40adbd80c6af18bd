"""Ordered operators on time series: folds, as-of and nearest matches, local maxima, rolling sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.operators import ranks
from loamline.operators.lineage import written
from loamline.operators.segments import SEGMENTS, Ema, Refractory, lagged, last_before, scan


def ordered_fold(df: DataFrame, key: str, order: list[str], value_cols: list[str], out: str | list[str], start: Callable[[], object], step: Callable) -> DataFrame:
    """``df`` with ``out``: ``state, result = step(state, *values)`` along each key's rows in order; several results for several names.

    Rows are dealt by key and sorted; a task walks through its sorted rows batch by batch
    and holds the state of one key, so a key of any length takes bounded memory.
    """
    names, several = df.columns, not isinstance(out, str)
    outs = list(out) if several else [out]
    dealt = df.repartition(key).sortWithinPartitions(key, *order)

    def walk(batches):
        import pyarrow as pa

        now, state, first = None, None, True
        for b in batches:
            results: list = []
            keys = b.column(names.index(key)).to_pylist()
            for k, *values in zip(keys, *(b.column(names.index(v)).to_pylist() for v in value_cols), strict=True):
                if first or k != now:
                    now, state, first = k, start(), False
                state, result = step(state, *values)
                results.append(result)
            found = zip(*results, strict=True) if several else [results]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(r, pa.float64()) for r in (found if results else [[]] * len(outs)))], names=[*names, *outs])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return dealt.mapInArrow(walk, StructType([*df.schema.fields, *(StructField(o, DoubleType()) for o in outs)]))


def ema(df: DataFrame, key: str, order: list[str], value: str, alpha: float, out: str = "ema", seed: float | None = None, segments: int = SEGMENTS) -> DataFrame:
    """Exponential mean; begins with the first value, or with ``seed``. Values mustn't be null."""
    found = scan(df.withColumn("_x", F.col(value).cast("double")), key, order, "_x", Ema(alpha, seed), [out, "_before", "_change"], segments)
    return found.drop("_x", "_before", "_change")


def refractory(df: DataFrame, key: str, order: list[str], time: str, wait: int, out: str = "picked", segments: int = SEGMENTS) -> DataFrame:
    """Marks (1 or 0) rows that come at least ``wait`` after the last marked one; ``time``, a long, is what rows are ordered by."""
    return scan(df, key, order, time, Refractory(wait), [out], segments)


def apex_step(alpha: float, floor: float, wait: int) -> Callable:
    """Step of the peak detector: state (smoothed value, its last change, time of the last peak that fired).

    A sample fires when the smoothed series has just turned down from at least ``floor``,
    ``wait`` or more after the last one.
    """

    def step(state, t, x):
        smoothed, change, last = state
        after = x if smoothed is None else alpha * x + (1 - alpha) * smoothed
        before = 0.0 if smoothed is None else smoothed
        peak = change > 0 and after - before <= 0 and before >= floor
        fire = peak and (last is None or t - last >= wait)
        return (after, after - before, t if fire else last), float(fire)

    return step


def apexes(df: DataFrame, key: str, order: list[str], time: str, value: str, alpha: float, floor: float, wait: int, segments: int = SEGMENTS) -> DataFrame:
    """Rows just after a peak of the smoothed series that fire; ``apex_step`` says when. Values mustn't be null.

    The smoothed series is made by segments of time, and the wait is kept among the peaks alone.
    """
    smooth = scan(df.withColumn("_x", F.col(value).cast("double")), key, order, "_x", Ema(alpha), ["_after", "_before", "_change"], segments)
    # Written once, as the second scan goes over the peaks several times.
    peaks = written(smooth.filter((F.col("_change") > 0) & (F.col("_after") - F.col("_before") <= 0) & (F.col("_before") >= floor)).select(*df.columns))
    return refractory(peaks, key, order, time, wait, "_fired", segments).filter("_fired = 1").drop("_fired")


def as_of(df: DataFrame, key: str, time: str, left: Column, right: Column, values: list[str], tie: str = "event_id", segments: int = SEGMENTS) -> DataFrame:
    """Rows where ``left`` holds, with ``prev_*`` of the latest row not after it where ``right`` holds.

    A right row of equal time counts, whatever its ``tie``; of several of them the largest
    ``tie`` wins. One window over both kinds of rows, segment by segment of a key; no join of pairs.
    """
    # A value may be null, so the row is looked up, not each of its values.
    asked = written(df.withColumn("_left", F.coalesce(left, F.lit(False))))
    seen = last_before(asked, key, [F.col(time), F.col("_left").cast("int"), F.col(tie)], time, F.when(right, F.struct(*values)), "_found", segments)
    return seen.filter("_left").select(*df.columns, *(F.col(f"_found.{v}").alias(f"prev_{v}") for v in values))


def nearest(df: DataFrame, key: str, time: str, left: Column, right: Column, tie: str = "event_id", segments: int = SEGMENTS) -> DataFrame:
    """Rows where ``left`` holds, with the nearest row in time where ``right`` holds; the earlier of two.

    A right row of the same time and ``tie`` counts as earlier.
    """
    order, hit = [F.col(time), F.col(tie), F.col("_left").cast("int")], F.when(right, F.struct(F.col(time).alias("t"), F.col(tie).alias("id")))
    asked = written(df.withColumn("_left", F.coalesce(left, F.lit(False))))
    both = last_before(last_before(asked, key, order, time, hit, "_a", segments), key, order, time, hit, "_b", segments, forward=False).filter("_left")
    a, b = F.col(time) - F.col("_a.t"), F.col("_b.t") - F.col(time)
    first = F.col("_b").isNull() | (a <= b)
    return both.withColumns({"near_id": F.when(first & F.col("_a").isNotNull(), F.col("_a.id")).otherwise(F.col("_b.id")), "near_gap": F.when(first & F.col("_a").isNotNull(), a).otherwise(b)}).drop("_left", "_a", "_b")


def local_maxima(df: DataFrame, key: str, order: list[str], value: str, floor: float, segments: int = SEGMENTS) -> DataFrame:
    """Rows whose predecessor was a peak of at least ``floor``: it rose to it and fell after it."""
    found = lagged(df, key, order, value, ["_one", "_two"], segments)
    one, two = F.coalesce("_one", F.lit(0.0)), F.coalesce("_two", F.lit(0.0))
    return found.withColumns({"_d": F.col(value) - one, "_p": one - two, "peak": one}).filter(f"_p > 0 AND _d <= 0 AND peak >= {floor}").drop("_d", "_p", "_one", "_two")


#: Squares are summed as whole numbers of this part of one, so that differences of sums are exact.
_GRAIN = 1_000_000


def framed_rms(df: DataFrame, key: str, time: str, tie: list[str], value: str, width: Column, out: str = "rms") -> DataFrame:
    """Root of the mean square in a centred frame of ``width`` rows, which may differ by key; rows outside count as zero.

    Each row looks up two running sums of squares, at the places where its frame ends. Sums
    and places are made range by range, and places tell rows of a key apart, so neither
    needs a key's rows together. Squares count to six decimal places.
    """
    squares = F.floor(F.col(value) * F.col(value) * _GRAIN).cast("decimal(38,0)")
    r = ranks.running(df.withColumn("_width", width), key, F.col(time), tie, F.struct(F.lit(1).cast("long").alias("n"), squares.alias("sq")))
    r = written(r.withColumns({"_n": F.col("total.n"), "_i": F.col("before.n"), "_to": F.col("before.sq"), "_all": F.col("total.sq")}).drop("before", "total"))
    after = F.floor((F.col("_width") - 1) / 2).cast("long")
    # The frame holds the rows from _from on and before _until.
    ends = r.withColumns({"_from": F.col("_i") + after - F.col("_width") + 1, "_until": F.col("_i") + after + 1})
    sums = lambda at: r.select(F.col(key).alias(f"_k{at}"), F.col("_i").alias(f"_i{at}"), F.col("_to").alias(f"_to{at}"))
    at = lambda place, name: F.col(key).eqNullSafe(F.col(f"_k{name}")) & (F.col(place) == F.col(f"_i{name}"))
    j = ends.join(sums("a"), at("_from", "a"), "left").join(sums("b"), at("_until", "b"), "left")
    lower = F.when(F.col("_from") <= 0, F.lit(0)).otherwise(F.col("_toa"))
    upper = F.when(F.col("_until") >= F.col("_n"), F.col("_all")).otherwise(F.col("_tob"))
    mean = (upper - lower).cast("double") / _GRAIN / F.col("_width")
    return j.select(*df.columns, F.sqrt(mean).alias(out))
