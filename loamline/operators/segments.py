"""Scans along the time of each key in segments: a key's rows are cut by time, so a key of any length is spread over tasks.

A scan of a large key runs in three steps. Each segment (a key's rows in one range of time) is summed up on
its own; the summaries of a key, one small value for each of its segments, are walked
through in order, which gives what each segment starts from; then each segment is gone
through with that. Segments are the same ranges of time for all large keys, by quantiles of
their rows, so rows of equal time stay together. Keys without more than their share of the
rows are one segment and are gone through once; ``ranks.cut`` says which are large.
"""

from __future__ import annotations

import pickle

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from loamline.operators import ranks

SEGMENTS = 64


def cut(df: DataFrame, key: str, time: str, segments: int = SEGMENTS) -> tuple[DataFrame, bool]:
    """``df`` with ``_part``, the range of time that a row of a large key lies in, else -1; and whether there are large keys."""
    return ranks.cut(df, key, F.col(time), segments)


class Ema:
    """Exponential means as affine maps: n values that turn x into y turn s into y + (1 - alpha)^n (s - x), x being the first of them.

    ``apply`` gives the mean at each value, the one before it and that one's last change; before
    the first value the mean counts as 0 and unchanged. The mean itself begins with
    the first value, or with ``seed``.
    """

    BLOCK = 128

    def __init__(self, alpha: float, seed: float | None = None):
        import numpy as np

        self.alpha, self.seed = alpha, seed
        steps = np.arange(self.BLOCK)
        self.weights = np.where(steps[:, None] >= steps, alpha * (1 - alpha) ** np.maximum(steps[:, None] - steps, 0), 0.0)

    def _means(self, x, start: float):
        import numpy as np

        out = np.empty(len(x))
        for at in range(0, len(x), self.BLOCK):
            part = x[at : at + self.BLOCK]
            k = len(part)
            # Against the start, so that a series that stays where it is stays exactly there.
            out[at : at + k] = start + self.weights[:k, :k] @ (part - start)
            start = out[at + k - 1]
        return out

    def add(self, summary, x):
        """Summary (values, mean from the first one after them, the one before, first value) of a segment as its values come."""
        n, y, before, first = summary or (0, float(x[0]), float(x[0]), float(x[0]))
        means = self._means(x, y)
        return n + len(x), float(means[-1]), float(means[-2]) if len(x) > 1 else y, first

    def begin(self, summary):
        return self.start(summary[3])

    def start(self, first):
        """What a key begins from, by its first value."""
        return (float(first) if self.seed is None else self.seed), 0.0, 0.0

    def carry(self, state, summary):
        s, last, _ = state
        n, y, before, first = summary
        now = y + (1 - self.alpha) ** n * (s - first)
        if n > 1:
            last = before + (1 - self.alpha) ** (n - 1) * (s - first)
        return now, now, now - last

    def apply(self, state, x):
        import numpy as np

        s, last, change = state
        means = self._means(x, s)
        before = np.concatenate([[last], means[:-1]])
        changes = np.concatenate([[change], (means - before)[:-1]])
        return (means, before, changes), (float(means[-1]), float(means[-1]), float(means[-1] - before[-1]))


class Refractory:
    """Picks at least ``wait`` after the last pick, by a jump table.

    From every row the next pick is known, so for a last pick before a segment the last one
    after it is: a step function, as later rows lead to later picks. Steps that lead to the
    same pick are one, so few are left.
    """

    def __init__(self, wait: float):
        if wait <= 0:
            raise ValueError("a wait must be positive")
        self.wait = wait

    def add(self, summary, t):
        """Summary (limits, exits): a last pick whose wait ends by ``limits[i]`` leads to the pick ``exits[i]``."""
        import numpy as np

        k = len(t)
        after = np.searchsorted(t, t + self.wait)
        way = np.where(after < k, after, np.arange(k))
        while not np.array_equal(way, further := way[way]):
            way = further
        ends = np.append(np.flatnonzero(way[1:] != way[:-1]), k - 1)
        limits, exits = t[ends], t[way[ends]]
        if summary is None:
            return limits, exits
        first_limits, first_exits = summary
        at = np.searchsorted(limits, first_exits + self.wait)
        through = np.where(at < len(limits), exits[np.minimum(at, len(exits) - 1)], first_exits)
        later = limits > first_limits[-1]
        limits, exits = np.concatenate([first_limits, limits[later]]), np.concatenate([through, exits[later]])
        kept = np.append(np.flatnonzero(exits[1:] != exits[:-1]), len(exits) - 1)
        return limits[kept], exits[kept]

    def begin(self, summary):
        return None

    def start(self, first):
        return None

    def carry(self, last, summary):
        import numpy as np

        limits, exits = summary
        at = 0 if last is None else int(np.searchsorted(limits, last + self.wait))
        return exits[at].item() if at < len(exits) else last

    def apply(self, last, t):
        import numpy as np

        after = np.searchsorted(t, t + self.wait).tolist()
        at = 0 if last is None else int(np.searchsorted(t, last + self.wait))
        picked = np.zeros(len(t))
        while at < len(after):
            picked[at], last = 1.0, t[at].item()
            at = after[at]
        return (picked,), last


def _runs(b, key: int, part: int):
    """(first row, end, key, part) of the runs of equal key and part in a batch."""
    import numpy as np
    import pyarrow.compute as pc

    if b.num_rows == 0:
        return
    k = pc.fill_null(b.column(key).dictionary_encode(null_encoding="encode").indices, -1).to_numpy()
    p = b.column(part).to_numpy()
    cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]) | (p[1:] != p[:-1])) + 1).tolist(), b.num_rows]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield lo, hi, b.column(key)[lo].as_py(), int(p[lo])


def scan(df: DataFrame, key: str, order: list[str], value: str, op, outs: list[str], segments: int = SEGMENTS) -> DataFrame:
    """``df`` with doubles ``outs``, what ``op`` gives along each key's rows in order; values mustn't be null."""
    parts, several = cut(df, key, order[0], segments)
    kind = df.schema[key].dataType.simpleString()
    dealt = parts.filter("_part >= 0").select(key, "_part", *dict.fromkeys([*order, value])).repartition(key, "_part").sortWithinPartitions(key, "_part", *order)
    at_value = dealt.columns.index(value)

    def summarize(batches):
        import pyarrow as pa

        now, summary = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], b.schema.field(0).type), pa.array([now[1]], pa.int32()), pa.array([pickle.dumps(summary)], pa.binary())], names=[key, "_part", "_summary"])

        for b in batches:
            values = b.column(at_value).to_numpy()
            for lo, hi, k, p in _runs(b, 0, 1):
                if now != (k, p):
                    if now is not None:
                        yield done()
                    now, summary = (k, p), None
                summary = op.add(summary, values[lo:hi])
        if now is not None:
            yield done()

    def fold(batches):
        import pyarrow as pa

        now, state = None, None
        for b in batches:
            states = []
            for k, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                summary = pickle.loads(raw)
                if now != (k,):
                    now, state = (k,), op.begin(summary)
                states.append(pickle.dumps(state))
                state = op.carry(state, summary)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(states, pa.binary())], names=[key, "_part", "_state"])

    summaries = dealt.mapInArrow(summarize, f"`{key}` {kind}, _part int, _summary binary")
    states = summaries.repartition(key).sortWithinPartitions(key, "_part").mapInArrow(fold, f"`{key}` {kind}, _part int, _state binary")
    # A segment's state comes as a row before its first one; a key in one segment begins by itself.
    headed = parts.withColumn("_state", F.lit(None).cast(BinaryType()))
    headed = headed.unionByName(states, allowMissingColumns=True) if several else headed
    walked = headed.repartition(key, "_part").sortWithinPartitions(key, "_part", F.col("_state").isNull(), *order)
    names, kept = walked.columns, df.columns

    def walk(batches):
        import numpy as np
        import pyarrow as pa

        now, state = None, None
        for b in batches:
            column = b.column(names.index("_state"))
            rows = column.is_null().to_numpy(zero_copy_only=False)
            values = b.column(names.index(value)).filter(pa.array(rows)).to_numpy()
            before = np.concatenate([[0], np.cumsum(rows)])
            found = [np.empty(len(values)) for _ in outs]
            for lo, hi, k, p in _runs(b, names.index(key), names.index("_part")):
                own = slice(before[lo], before[hi])
                if not rows[lo]:
                    state = pickle.loads(column[lo].as_py())
                elif now != (k, p):
                    state = op.start(values[own.start])
                now = k, p
                if own.stop > own.start:
                    results, state = op.apply(state, values[own])
                    for f, r in zip(found, results, strict=False):
                        f[own] = r
            left = b.filter(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*(left.column(names.index(c)) for c in kept), *(pa.array(f) for f in found)], names=[*kept, *outs])

    # Rows of states have no other columns, so these may be null on the way.
    fields = [StructField(f.name, f.dataType) for f in df.schema.fields]
    return walked.mapInArrow(walk, StructType([*fields, *(StructField(o, DoubleType()) for o in outs)]))


def _named(df: DataFrame, key: str, *columns: str) -> DataFrame:
    return df.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), *columns)


def _of_part(key: str) -> Column:
    return F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p"))


def lagged(df: DataFrame, key: str, order: list[str], value: str, outs: list[str], segments: int = SEGMENTS) -> DataFrame:
    """``df`` with the key's last values before each row, the nearest first; null where there are fewer.

    Within a segment they come from a window; for its first rows from the last rows of the
    key's segments before, of which only as many as there are ``outs`` are looked at.
    """
    k = len(outs)
    parts, several = cut(df, key, order[0], segments)
    if not several:
        whole = Window.partitionBy(key).orderBy(*order)
        return df.select("*", *(F.lag(value, n + 1).over(whole).alias(o) for n, o in enumerate(outs)))
    own = Window.partitionBy(key, "_part").orderBy(*order)
    newest = Window.partitionBy(key, "_part").orderBy(*(F.desc(c) for c in order))
    large = parts.filter("_part >= 0")
    tails = large.select(key, "_part", F.struct(F.col(value).alias("x")).alias("tail"), F.row_number().over(newest).alias("back")).filter(F.col("back") <= k)
    heads = large.select(key, "_part").distinct().select(key, "_part", F.lit(None).cast(tails.schema["tail"].dataType).alias("tail"), F.lit(k + 1).alias("back"))
    # In a key's small table each segment has a head, then its last rows; k of those lie within 2k rows.
    before = Window.partitionBy(key).orderBy("_part", F.desc("back")).rowsBetween(-2 * k, -1)
    carried = tails.unionByName(heads).withColumn("_past", F.reverse(F.collect_list("tail").over(before))).filter(F.col("back") == k + 1)
    j = parts.join(_named(carried, key, "_past"), _of_part(key), "left").withColumn("_i", F.row_number().over(own))
    found = {o: F.when(F.col("_i") > n + 1, F.lag(value, n + 1).over(own)).otherwise(F.get("_past", (F.lit(n + 1) - F.col("_i"))).getField("x")) for n, o in enumerate(outs)}
    return j.withColumns(found).select(*df.columns, *outs)


def last_before(df: DataFrame, key: str, order: list[Column], time: str, seen: Column, out: str, segments: int = SEGMENTS, forward: bool = True) -> DataFrame:
    """``df`` with ``out``, the last ``seen`` that isn't null among the key's rows before each, by ``order``; the first after it if not ``forward``.

    ``order`` begins with the column ``time``. A segment's first rows get what its key's other segments hold.
    """
    parts, several = cut(df, key, time, segments)
    parts = parts.withColumn("_seen", seen)
    own = Window.partitionBy(key, "_part").orderBy(*order)
    rows = own.rowsBetween(Window.unboundedPreceding, -1) if forward else own.rowsBetween(1, Window.unboundedFollowing)
    near = (F.last if forward else F.first)("_seen", ignorenulls=True).over(rows)
    if not several:
        return parts.withColumn("_near", near).select(*df.columns, F.col("_near").alias(out))
    ordered = F.struct(*order)
    large = parts.filter("_part >= 0")
    held = large.filter("_seen IS NOT NULL").groupBy(key, "_part").agg((F.max_by if forward else F.min_by)("_seen", ordered).alias("_held"))
    every = large.select(key, "_part").distinct()
    both = every.join(_named(held, key, "_held"), _of_part(key), "left").select(key, "_part", "_held")
    of_key = Window.partitionBy(key).orderBy("_part")
    others = of_key.rowsBetween(Window.unboundedPreceding, -1) if forward else of_key.rowsBetween(1, Window.unboundedFollowing)
    carried = both.withColumn("_carried", (F.last if forward else F.first)("_held", ignorenulls=True).over(others))
    j = parts.withColumn("_near", near).join(_named(carried, key, "_carried"), _of_part(key), "left")
    return j.select(*df.columns, F.coalesce("_near", "_carried").alias(out))
