"""Places within a key, without sending all rows of the key to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: A key of so many rows is cut in any case.
MOST_ROWS = 1_000_000


def cut(df: DataFrame, key: str, order: Column, ranges: int, out: str = "_part") -> tuple[DataFrame, bool]:
    """``df`` with the part of its key that a row lies in, and whether any key is cut: a range of ``order``, or -1 in keys that stay whole.

    A key is cut if it has more than its share, a ``ranges``-th of all rows, or more than
    ``MOST_ROWS``; so few keys are, and parts are never more than rows' keys by much.
    """
    sizes = df.groupBy(F.col(key).alias("_large")).agg(F.count("*").alias("_n"))
    total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    share = min((total or 0) / ranges, MOST_ROWS)
    if ranges < 2 or (most or 0) <= share:
        return df.withColumn(out, F.lit(-1)), False
    large = F.broadcast(sizes.filter(F.col("_n") > share).select("_large", F.lit(True).alias("_cut")))
    marked = df.join(large, F.col(key).eqNullSafe(F.col("_large")), "left").drop("_large")
    cuts = sorted(set(marked.filter("_cut").agg(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0] or []))
    part = F.size(F.filter(F.lit(cuts), lambda c: c < order)) if cuts else F.lit(0)
    return marked.withColumn(out, F.when(F.col("_cut"), part).otherwise(-1)).drop("_cut"), True


def running(df: DataFrame, key: str, order: Column, tie: list[str], amount: Column, ranges: int = 64) -> DataFrame:
    """``df`` with ``before`` and ``total``: the sum of ``amount`` in earlier rows of the key, and in all of its rows.

    A struct of amounts gives structs of sums. Rows come by ``order``, a number that isn't null, then ``tie``. Each range of a large key
    adds up on its own; what lies before it comes from the sums of key and range, a
    pre-aggregated table of at most ``ranges`` rows a key. Other keys are summed whole.
    """
    ranged, several = cut(df.withColumn("_amount", amount), key, order, ranges)
    kind = ranged.schema["_amount"].dataType
    names = kind.names if isinstance(kind, StructType) else []
    each = lambda body: F.struct(*(body(lambda c, n=n: F.col(f"{c}.{n}")).alias(n) for n in names)) if names else body(F.col)
    own = Window.partitionBy(key, "_part").orderBy(order, *tie)
    if not several:
        of_key, until = Window.partitionBy(key), Window.partitionBy(key).orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
        summed = ranged.withColumns({"before": each(lambda of: F.sum(of("_amount")).over(until) - of("_amount")), "total": each(lambda of: F.sum(of("_amount")).over(of_key))})
        return summed.select(*df.columns, "total", "before")
    sums = ranged.groupBy(key, "_part").agg(each(lambda of: F.sum(of("_amount"))).alias("_sum"))
    of_key = Window.partitionBy(key)
    sums = sums.withColumns({"_earlier": each(lambda of: F.sum(of("_sum")).over(of_key.orderBy("_part")) - of("_sum")), "total": each(lambda of: F.sum(of("_sum")).over(of_key))})
    inner = ranged.withColumn("_inner", each(lambda of: F.sum(of("_amount")).over(own.rowsBetween(Window.unboundedPreceding, 0)) - of("_amount")))
    joined = inner.join(sums.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), "_earlier", "total"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("before", each(lambda of: of("_earlier") + of("_inner"))).drop("_amount", "_part", "_inner", "_earlier", "_key", "_p")


def numbered(df: DataFrame, key: str, order: str, ranges: int = 64) -> DataFrame:
    """``df`` with ``before``, the number of earlier rows of the key, and ``total``, that of all its rows; ties get places in any order."""
    return running(df, key, F.col(order), [], F.lit(1).cast("long"), ranges)
