"""Exact percentiles without holding a group's values: rounds of counts by range, then only rows between two bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.operators.lineage import written

#: Groups of so many values at most are sorted whole; bounds of a round; rows of bounds that are broadcast at most.
SMALL, PIVOTS, BROADCAST_ROWS = 100_000, 48, 10_000


def _near(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _named(df: DataFrame, prefix: str) -> DataFrame:
    """``df`` with a prefix before all names, so that it can be joined with what it comes from."""
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def _same(columns: list[str], left: str = "", right: str = "r_") -> list:
    return [F.col(left + k).eqNullSafe(F.col(right + k)) for k in columns]


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], small: int = SMALL, pivots: int = PIVOTS) -> DataFrame:
    """``keys`` and a column for each of ``shares`` (name: place between 0 and 1), between neighbours in proportion; nulls don't count.

    A group of more than ``small`` values is narrowed down: its rows between two bounds are
    counted by ranges between ``pivots`` of their own approximate quantiles, and only the
    range that holds a wanted place goes on, with both of its ends excluded. So each round
    leaves about one row in ``pivots``, and values that repeat without end are found as
    bounds. Without keys the whole table is one group, and an empty one gives a row of nulls.
    """
    own = keys or ["_all"]
    rows = df.select(*(keys or [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL")
    rows = written(rows)
    sizes = written(rows.groupBy(*own).agg(F.count("*").alias("_n")))
    large = sizes.filter(F.col("_n") > small)
    exact = lambda q: F.expr(f"percentile(_x, {q})")
    n_large = large.count()
    if n_large == 0:
        out = rows.groupBy(*own).agg(*(exact(q).alias(name) for name, q in shares.items()))
        return out if keys else out.drop("_all").unionByName(_nothing(df, shares)).limit(1)
    rest = rows.join(_near(_named(large, "r_"), n_large), _same(own), "left_anti").groupBy(*own).agg(*(exact(q).alias(name) for name, q in shares.items()))
    found = _selected(rows, large, own, shares, small, pivots)
    both = rest.unionByName(found.select(*own, *shares))
    return both if keys else both.drop("_all").limit(1)


def _nothing(df: DataFrame, shares: dict[str, float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(None,) * len(shares)], ", ".join(f"`{name}` double" for name in shares))


def _selected(rows: DataFrame, large: DataFrame, own: list[str], shares: dict[str, float], small: int, pivots: int) -> DataFrame:
    place = lambda q: F.lit(float(q)) * (F.col("_n") - 1)
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), place(q).alias("place")) for name, q in shares.items()))
    targets = written(large.select(*own, "_n", F.explode(wanted).alias("_w")).select(*own, "_n", "_w.*"))
    ranks = targets.select(*own, "_n", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct()
    bound = F.lit(None).cast("double")
    # An open interval that holds the value of rank ``rank``, how many values lie before it and in it.
    open_ = written(ranks.select(*own, "rank", bound.alias("lo"), bound.alias("hi"), F.lit(0).cast("long").alias("past"), F.col("_n").alias("m")))
    interval = [*own, "lo", "hi", "past", "m"]
    inside = (F.col("lo").isNull() | (F.col("_x") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("_x") < F.col("hi")))
    done = []

    def held(bounds: DataFrame) -> DataFrame:
        """Rows within intervals, which are few against the rows and come along with what belongs to them."""
        n = bounds.count()
        j = rows.select(*(F.col(k).alias(f"r_{k}") for k in own), "_x")
        return _near(bounds, n).join(j, _same(own)).select(*bounds.columns, "_x").filter(inside)

    while n_open := open_.count():
        few = open_.filter(F.col("m") <= small)
        lists = held(few.select(*interval).distinct()).groupBy(*interval).agg(F.sort_array(F.collect_list("_x")).alias("xs"))
        listed = few.join(_named(lists, "r_"), _same(interval))
        done.append(written(listed.select(*own, "rank", F.get("r_xs", (F.col("rank") - F.col("past")).cast("int")).alias("x"))))
        many = open_.filter(F.col("m") > small)
        if n_open == done[-1].count():
            break
        quantiles = F.percentile_approx("_x", [k / (pivots + 1) for k in range(1, pivots + 1)], 20 * pivots)
        cut = written(held(many.select(*interval).distinct()).groupBy(*interval).agg(F.array_distinct(quantiles).alias("cuts")))
        below = F.size(F.filter("cuts", lambda c: c < F.col("_x")))
        at = F.when(F.array_contains("cuts", F.col("_x")), 1).otherwise(0)
        # Even numbers are the ranges between bounds, odd ones the bounds.
        counts = held(cut).groupBy(*interval, (2 * below + at).alias("bin")).agg(F.count("*").alias("n"))
        ended = F.sum("n").over(Window.partitionBy(*interval).orderBy("bin")) + F.col("past")
        counted = counts.withColumn("ended", ended).withColumn("began", F.col("ended") - F.col("n"))
        hit = many.join(_named(counted, "r_"), [*_same(interval), (F.col("rank") >= F.col("r_began")) & (F.col("rank") < F.col("r_ended"))])
        hit = hit.join(_named(cut, "u_"), _same(interval, right="u_"))
        hit = written(hit.select(*own, "rank", "lo", "hi", F.col("u_cuts").alias("cuts"), F.col("r_bin").alias("bin"), F.col("r_began").alias("began"), F.col("r_n").alias("n")))
        k = F.floor(F.col("bin") / 2).cast("int")
        done.append(hit.filter("bin % 2 = 1").select(*own, "rank", F.get("cuts", k).alias("x")))
        lower = F.when(k > 0, F.get("cuts", F.greatest(k - 1, F.lit(0)))).otherwise(F.col("lo"))
        upper = F.when(k < F.size("cuts"), F.get("cuts", k)).otherwise(F.col("hi"))
        open_ = written(hit.filter("bin % 2 = 0").select(*own, "rank", lower.alias("lo"), upper.alias("hi"), F.col("began").alias("past"), F.col("n").alias("m")))
    values = done[0]
    for d in done[1:]:
        values = values.unionByName(d)
    values = written(values)
    low, high = _named(values, "r_"), _named(values, "u_")
    j = targets.join(low, [*_same(own), F.floor("place") == F.col("r_rank")]).join(high, [*_same(own, right="u_"), F.ceil("place") == F.col("u_rank")])
    part = F.col("place") - F.floor("place")
    between = F.when(part == 0, F.col("r_x")).otherwise(F.col("r_x") * (1 - part) + F.col("u_x") * part)
    j = j.select(*own, "name", between.alias("x"))
    return j.groupBy(*own).agg(*(F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in shares))
