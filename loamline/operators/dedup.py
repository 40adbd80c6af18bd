"""Exact groups, Hamming pairs by blocks, set pairs by prefixes and keep-first removal."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.operators.lineage import written


def average_hash(values: Column) -> Column:
    """64 bits: which of 64 values exceed their mean, the first in the highest bit."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(values)
    return F.transform(F.array(mean), lambda m: F.aggregate(values, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x.cast("double") > m, 1).otherwise(0).cast("long"))))[0]


def hamming(a: Column, b: Column) -> Column:
    """Number of bits that differ."""
    return F.bit_count(a.bitwiseXOR(b))


def hash_classes(df: DataFrame, key: str, h: str) -> DataFrame:
    """(hash, rep, n): rows of equal hash stand for one another; the smallest key represents them."""
    return df.groupBy(F.col(h).alias("h")).agg(F.min(key).alias("rep"), F.count("*").alias("n"))


#: From so many hashes on, keys take two blocks or three, and there are more of them.
SOME_HASHES, MANY_HASHES = 20_000, 3_000_000


def _blocks(k: int, spare: int, bits: int = 64):
    """Widths and places of ``k + spare`` blocks of a hash, and all choices of ``spare`` of them."""
    n = k + spare
    widths = [bits // n + (i < bits % n) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)], list(combinations(range(n), spare))


def _spare(df: DataFrame) -> int:
    """Blocks that make a key: one for few hashes, two or three where keys of fewer would be shared by too many; all find the same."""
    n = df.count()
    return 1 if n < SOME_HASHES else 2 if n < MANY_HASHES else 3


def _listed(df: DataFrame, h: str, k: int, spare: int) -> DataFrame:
    """``df`` with a row for every choice of blocks of ``h``, and a key of what stands in them."""
    blocks, choices = _blocks(k, spare)
    value = lambda i: F.shiftrightunsigned(F.col(h), blocks[i][0]).bitwiseAND(F.lit((1 << blocks[i][1]) - 1))
    keys = F.array(*[F.struct(F.lit(c).alias("choice"), F.xxhash64(*[value(i) for i in own]).alias("key")) for c, own in enumerate(choices)])
    return df.withColumn("_k", F.explode(keys)).select(*df.columns, "_k.choice", "_k.key")


def _first_choice(differ: Column, choice: Column, k: int, spare: int) -> Column:
    """Whether a choice of blocks is the first in which two hashes agree; ``differ`` is their exclusive or."""
    blocks, choices = _blocks(k, spare)
    same = F.filter(F.array(*[F.when(F.shiftrightunsigned(differ, at).bitwiseAND(F.lit((1 << w) - 1)) == 0, i) for i, (at, w) in enumerate(blocks)]), lambda i: i.isNotNull())
    return F.get(F.lit([list(c) for c in choices]), choice) == F.slice(same, 1, spare)


def hamming_matches(left: DataFrame, right: DataFrame, hashes: tuple[str, str], k: int, spare: int | None = None) -> DataFrame:
    """Rows of ``left`` and ``right`` side by side, as structs l and r, where both of two hashes are at most ``k`` bits apart.

    A hash is cut into ``k + spare`` blocks. Two hashes at most k bits apart agree in
    ``spare`` blocks or more, so each row is listed under every choice of that many blocks
    of the first hash; see ``_spare``. A match is made once, under the
    first blocks in which they agree.
    """
    one, two = hashes
    spare = spare or _spare(right)
    x = _listed(left, one, k, spare).select(F.struct(*left.columns).alias("l"), "choice", "key")
    y = _listed(right, one, k, spare).select(F.struct(*right.columns).alias("r"), F.col("choice").alias("choice_r"), F.col("key").alias("key_r"))
    near = lambda h: F.bit_count(F.col(f"l.{h}").bitwiseXOR(F.col(f"r.{h}"))) <= k
    j = x.join(y, (F.col("choice") == F.col("choice_r")) & (F.col("key") == F.col("key_r")))
    return j.filter(near(one) & near(two) & _first_choice(F.col(f"l.{one}").bitwiseXOR(F.col(f"r.{one}")), F.col("choice"), k, spare)).select("l", "r")


def hamming_pairs(classes: DataFrame, k: int, spare: int | None = None) -> DataFrame:
    """(a, b, distance) of all class representatives a < b at most ``k`` bits apart; see ``hamming_matches``."""
    own, spare = classes.select("rep", "h"), spare or _spare(classes)
    x = _listed(own, "h", k, spare).alias("x")
    y = _listed(own, "h", k, spare).alias("y")
    differ = F.col("x.h").bitwiseXOR(F.col("y.h"))
    j = x.join(y, (F.col("x.choice") == F.col("y.choice")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")))
    near = j.filter((F.bit_count(differ) <= k) & _first_choice(differ, F.col("x.choice"), k, spare))
    return near.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.bit_count(differ).cast("long").alias("distance"))


#: Share of a set in percent that stands in ``early`` beyond what any near set must meet once.
MARGIN = 10


def _margin(n: int) -> int:
    return max(1, n * MARGIN // 100)


def early(n: int, percent: int) -> int:
    """How many of a set's ``n`` elements, in an order that all sets follow, ``may_pair`` has to see."""
    return n - -(-n * percent // 100) + _margin(n)


def may_pair(firsts: DataFrame, percent: int) -> DataFrame:
    """(id) of ``firsts(id, n, s)`` that may have 100 * intersection >= percent * union with another; ``s`` are the first ``early(n)`` of n elements.

    Two such sets have ``percent`` of the larger one in common, and of either no more than
    the rest comes after ``early`` elements without the margin. So one finds as many of its first elements
    among the other's first ones as the smaller one's margin is. A set whose first elements are met less
    often, in sets of a size that fits, is near none; most sets end here, and no pair is made.
    """
    held = firsts.select("id", "n", F.explode("s").alias("e"))
    of = Window.partitionBy("e").orderBy("n")
    fits = lambda less, more: percent * more <= 100 * less
    met = held.withColumns({"less": F.lag("n").over(of), "more": F.lead("n").over(of)}).filter(fits(F.col("less"), F.col("n")) | fits(F.col("n"), F.col("more")))
    smaller = F.ceil(F.col("n") * percent / 100)
    least = F.greatest(F.lit(1).cast("long"), F.floor(smaller * MARGIN / 100))
    return met.groupBy("id", "n").agg(F.count("*").alias("met")).filter(F.col("met") >= least).select("id")


#: Up to so many pairs, only the sets in them are shuffled: their ids are broadcast.
BROADCAST_PAIRS = 1_000_000


def _listed_sets(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Sets with elements, as (id, s, n), and (id, n, e, rest): each one's first elements, rarest first; see ``set_pairs``."""
    sized = written(sets.select("id", "s", F.size("s").cast("long").alias("n")).filter("n > 0"))
    held = sized.select("id", "n", F.explode("s").alias("e"))
    shared = held.groupBy("e").agg(F.count("*").alias("holders")).filter("holders > 1")
    rank = Window.partitionBy("id").orderBy(F.col("holders").desc(), F.col("e").desc())
    return sized, written(held.join(shared, "e").withColumn("rest", F.row_number().over(rank).cast("long")).filter(f"100 * rest >= {percent} * n").drop("holders"))


def _near(left: DataFrame, right: DataFrame, sized: DataFrame, percent: int, when: str = "true") -> DataFrame:
    """(a, b, shared) of near sets a < b of which ``left`` and ``right`` list a common element, on the condition ``when`` on x and y."""
    fits = F.expr(f"x.id < y.id AND ({when}) AND {percent} * x.n <= 100 * y.n AND {percent} * y.n <= 100 * x.n AND {100 + percent} * least(x.rest, y.rest) >= {percent} * (x.n + y.n)")
    able = written(left.alias("x").join(right.alias("y"), F.col("x.e") == F.col("y.e")).filter(fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
    few = able.count() <= BROADCAST_PAIRS

    def side(node):
        own = sized.join(F.broadcast(able.select(F.col(node).alias("id")).distinct()), "id", "left_semi") if few else sized
        return own.select(F.col("id").alias(node), F.col("s").alias(f"s_{node}"), F.col("n").alias(f"n_{node}"))

    both = able.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("shared"), "n_a", "n_b")
    return both.filter(f"100 * shared >= {percent} * (n_a + n_b - shared)").select("a", "b", "shared")


def set_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared) of all a < b of ``sets(id, s)`` with 100 * intersection >= percent * union; ``s`` are distinct longs.

    Exact, by prefixes: elements are ordered by how many sets hold them, rarest first. Two
    sets that are similar enough share an element early in both, so only the first ones,
    about a fifth at 80 percent, are joined, on condition of fitting sizes and of enough
    elements after the shared one. Elements of one set only count for the order alone.
    """
    sized, listed = _listed_sets(sets, percent)
    return _near(listed, listed, sized, percent)


#: Rounds of leaders at most, and one in how many open sets a round must decide for another one.
LEADER_ROUNDS, WORTH = 4, 50


def keep_first_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(id, dup_of) of a walk through ``sets(id, s)`` in order of id that drops a set near an earlier kept one; sets near none may be missing.

    A set that no earlier open set shares a listed element with is kept for sure. Such
    leaders are compared with the open sets that share an element with them, one leader for each
    element, and near ones are dropped, so a group of near copies goes without pairs among
    its members. After a few rounds, or one that decides little, all pairs of what is
    open are made, and the walk decides. Sets kept after a round may be an earlier
    original of sets dropped in it; those are compared last.
    """
    sized, listed = _listed_sets(sets, percent)
    still, gone, kept = listed, [], []
    n = still.select("id").distinct().count()
    for at in range(LEADER_ROUNDS):
        least = still.groupBy("e").agg(F.min("id").alias("least"))
        leads = written(still.join(least, "e").groupBy("id").agg(F.bool_and(F.col("id") == F.col("least")).alias("leads")).filter("leads").select("id"))
        first = still.join(leads, "id", "left_semi")
        near = _near(first, still, sized, percent)
        gone.append(written(near.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("dup_of")).withColumn("round", F.lit(at))))
        kept.append(leads.withColumn("round", F.lit(at)))
        still = written(still.join(leads.union(gone[-1].select("id")), "id", "left_anti"))
        before, n = n, still.select("id").distinct().count()
        if not n or WORTH * (before - n) < before:
            break
    walked = written(keep_first(still.select("id").distinct(), _near(still, still, sized, percent).select("a", "b")))
    dropped = written(reduce(DataFrame.unionByName, gone))
    kept.append(walked.filter("dup_of IS NULL").select("id", F.lit(LEADER_ROUNDS).alias("round")))
    later = listed.join(reduce(DataFrame.unionByName, kept), "id")
    missed = _near(later, listed.join(dropped, "id"), sized, percent, "x.round > y.round AND x.id < y.dup_of")
    earliest = missed.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("other"))
    mended = dropped.join(earliest, "id", "left").select("id", F.least("dup_of", "other").alias("dup_of"))
    return mended.unionByName(walked)


def keep_first(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, dup_of) of a walk in order of id, a number or a struct, that drops a row near an earlier kept one.

    Rounds decide all rows whose earlier neighbours are decided: kept if none of those is
    kept, else dropped as a copy of the earliest. There are as many rounds as the longest
    chain of rows that wait for each other, and each decides one row at least. A round
    writes what it decides and what is left of the links, which carry what is known of their
    earlier ends; rows without links are looked at once.
    """
    pairs = written(links.select(F.col("b").alias("id"), F.col("a").alias("near")).distinct())
    waiting = pairs.select("id").distinct()
    if pairs.select(F.col("near").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti").limit(1).count():
        raise ValueError("links name rows that aren't among the nodes")
    # What is known of an earlier end: kept, dropped, or null while it waits itself.
    undecided = written(pairs.join(waiting.select(F.col("id").alias("near"), F.lit(True).alias("waits")), "near", "left").select("id", "near", F.when(F.col("waits").isNull(), True).alias("kept")))
    free = nodes.select("id").join(waiting, "id", "left_anti").select("id", F.lit(None).cast(nodes.schema["id"].dataType).alias("dup_of"))
    parts = [free]
    while undecided.limit(1).count():
        first = undecided.groupBy("id").agg(F.min(F.when(F.col("kept"), F.col("near"))).alias("dup_of"), F.min(F.when(F.col("kept").isNull(), F.col("near"))).alias("waits"))
        ready = written(first.filter("waits IS NULL OR dup_of < waits").select("id", "dup_of"))
        parts.append(ready)
        left = undecided.join(ready.select("id"), "id", "left_anti")
        now = ready.select(F.col("id").alias("near"), F.col("dup_of").isNull().alias("now"))
        undecided = written(left.join(now, "near", "left").select("id", "near", F.coalesce("kept", "now").alias("kept")))
    return reduce(DataFrame.unionByName, parts)
