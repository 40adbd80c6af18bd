"""Near-duplicate documents by b-bit MinHash.

1. Every document becomes its set of distinct word shingles (64-bit hashes), and from it
   ``BANDS * ROWS`` minima, of which the low ``BITS`` bits are kept, packed in longs, and
   one hash for each band of ``ROWS`` whole minima.
2. Documents of equal sets form classes; only the smallest id of each class goes on, so
   thousands of copies cost one row.
3. Candidates are representatives that share a band's hash. In a bucket each is paired
   with one leader, the member of most shared buckets. A pair goes on if its similarity, estimated by
   bit counts and corrected for chance matches of low bits, isn't far below the bound.
4. What is left is confirmed on the full shingle sets and linked; links give components.
5. In a bucket whose other members are not in one component, pairs of them are found by
   how they differ from the leader (see ``apart_pairs``), without pairing all of them, and
   confirmed likewise. No pair is left out that could change a component.

At similarity 0.8 a pair misses all 64 bands of 8 minima with probability 8e-6, and the
margin of the estimate is more than five standard deviations. Sets are compared by 48 bits
of each shingle's hash: two of ten thousand shingles each that have none in common seem to
share one with probability 4e-7.

Defined results: null and empty texts have no shingles, are linked with nothing and each
is its own component; rows with the same id fall in one component, linked with what any of their
texts is linked with, and equal texts fall in one component; a
row with a null id is never linked and has a null component; an empty table gives an
empty result. Other columns pass through ``drop_near_duplicates``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.common import discard, documents, materialize, text_slices
from loamline.llm.components import connected_components

BANDS, ROWS, BITS = 64, 8, 2
#: Pairs estimated lower than the bound less this margin are not confirmed.
MARGIN = 0.12
#: As many ids are broadcast at most, about 100 MB on an executor.
BROADCAST_IDS = 4_000_000
#: Words whose hashes a worker remembers; bytes of texts and rows of sets that it unpacks at a time.
KNOWN_WORDS, SLICE_BYTES, SLICE_ROWS = 150_000, 4 << 20, 1_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x):
    """Finalizer that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[bytes], known: dict[bytes, int]):
    """64-bit hash of each word; ``known`` is a bounded table of hashes."""
    import xxhash

    found = [known.get(w) for w in words]
    if None in found:
        if len(known) > KNOWN_WORDS:
            known.clear()
        for i, f in enumerate(found):
            if f is None:
                found[i] = known[words[i]] = xxhash.xxh64_intdigest(words[i])
    return np.array(found, "u8")


def shingle_set(text: str | None, width: int, known: dict[bytes, int]):
    """Sorted distinct hashes of ``width``-word shingles; A-Z lower-cased, split at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, "u8")
    h = _word_hashes(words, known)
    with np.errstate(over="ignore"):
        n = max(1, len(h) - width + 1)
        out = np.full(n, np.uint64(min(width, len(h))))
        for k in range(min(width, len(h))):
            out = _mixed(out * _MIX + h[k : k + n])
    return np.unique(out)


class Signer:
    """Minima of a shingle set under fixed random functions, in blocks of bounded size."""

    def __init__(self, bands: int, rows: int, bits: int):
        rng = np.random.default_rng(20240607)
        self.bands, self.rows, self.bits = bands, rows, bits
        self.mul = (rng.integers(0, 1 << 31, bands * rows, dtype="u4") << np.uint32(1)) | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, bands * rows, dtype="u4")
        self.buffer = np.empty((bands * rows, 256), "u4")
        per = 64 // bits
        self.shifts = (np.arange(bands * rows) % per * bits).astype("u8")
        self.starts = np.arange(0, bands * rows, per)

    def sign(self, shingles):
        """(band hashes, packed low bits)"""
        folded = (shingles ^ (shingles >> np.uint64(32))).astype("u4")
        low = None
        for at in range(0, len(folded), 256):
            part = folded[at : at + 256]
            block = self.buffer[:, : len(part)]
            np.multiply(self.mul[:, None], part, out=block)
            np.add(block, self.add[:, None], out=block)
            least = block.min(axis=1)
            low = least if low is None else np.minimum(low, least)
        with np.errstate(over="ignore"):
            hashes = np.arange(self.bands, dtype="u8") * _MIX
            for column in low.reshape(self.bands, self.rows).T.astype("u8"):
                hashes = _mixed(hashes * _MIX + column)
        kept = (low & np.uint32((1 << self.bits) - 1)).astype("u8") << self.shifts
        return hashes.astype("i8"), np.bitwise_or.reduceat(kept, self.starts).astype("i8")


def signatures(df: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, low): set_a and set_b name the shingle set in 128 bits."""

    def sign(batches):
        import xxhash

        import pyarrow as pa

        known, signer = {}, Signer(bands, rows, bits)
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
        for b, at, texts in ((b, at, texts) for b in batches for at, texts in text_slices(b.column(1), SLICE_BYTES)):
            out = []
            for doc, text in zip(b.column(0).slice(at, len(texts)).to_pylist(), texts.to_pylist(), strict=True):
                s = shingle_set(text, width, known)
                if len(s):
                    whole = s.tobytes()
                    out.append((doc, len(s), *(np.array([xxhash.xxh64_intdigest(whole, seed=k) for k in (1, 2)], "u8").astype("i8").tolist()), *signer.sign(s)))
                else:
                    out.append((doc, 0, None, None, None, None))
            cols = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "low"])

    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return docs.mapInArrow(sign, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, low array<long>")


def estimate(a: Column, b: Column, minima: int = BANDS * ROWS, bits: int = BITS) -> Column:
    """Similarity from packed low bits: the share of equal ones, less the chance of 2^-bits."""
    lanes = sum(1 << (i * bits) for i in range(64 // bits))
    lanes -= (1 << 64) if lanes >= 1 << 63 else 0

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        folded = z
        for k in range(1, bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(z, k))
        return F.bit_count(folded.bitwiseAND(F.lit(lanes)))

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, n: s + n)
    chance = 2.0**-bits
    return (F.lit(1.0) - unequal / F.lit(float(minima)) - chance) / (1 - chance)


def _pack_set(shingles) -> bytes:
    """A sorted set in about five bytes a hash: 48 bits of each, as compressed planes of differences."""
    import zstandard

    steps = np.diff(shingles >> np.uint64(16), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view("u1").reshape(-1, 8).T.tobytes())


def _unpack_set(raw: bytes):
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "u1").reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("u8").ravel(), dtype="u8")


def packed_sets(ids: DataFrame, df: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, shingles) of the texts of ``ids(doc_id)``, packed; ``key`` tells apart the sets of one id.

    Up to ``BROADCAST_IDS`` ids are broadcast to the scan of the texts; beyond that the
    texts are shuffled to them.
    """
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def to_sets(batches):
        import pyarrow as pa
        import xxhash

        known = {}
        for b, at, texts in ((b, at, texts) for b in batches for at, texts in text_slices(b.column(1), SLICE_BYTES)):
            sets = [_pack_set(shingle_set(t, width, known)) for t in texts.to_pylist()]
            keys = [xxhash.xxh64_intdigest(s) >> 1 for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "key", "shingles"])

    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    sets = materialize(texts.mapInArrow(to_sets, "doc_id long, key long, shingles binary"), "sets")
    repeated = sets.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    return sets.dropDuplicates(["doc_id", "key"]) if repeated.limit(1).count() else sets


def _slices(batches):
    """Batches of ``SLICE_ROWS`` rows at most."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(at, SLICE_ROWS)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(u, v, ...)`` with the packed sets x and y and their keys."""
    side = lambda node, key, name: sets.select(F.col("doc_id").alias(node), F.col("key").alias(key), F.col("shingles").alias(name)).hint("merge")
    return pairs.join(side("u", "u_key", "x"), "u").join(side("v", "v_key", "y"), "v")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets have 100 * intersection >= percent * union."""

    def compare(batches):
        import pyarrow as pa

        for b in _slices(batches):
            keep, last, x = [], None, None
            for left, right in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if left != last:
                    last, x = left, _unpack_set(left)
                y = _unpack_set(right)
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["u", "v"])

    joined = _with_sets(pairs.select("u", "v"), sets)
    return joined.select("u", "v", "x", "y").mapInArrow(compare, "u long, v long").distinct()


_DIFFERENCE = "lead long, lead_key long, node long, node_key long, component long, n long, apart long, shingle long"


def differences(balls: DataFrame, sets: DataFrame) -> DataFrame:
    """A row for each shingle that stands in just one of the sets of ``u`` and ``v``, for ``balls(u, v, component)``.

    ``n`` is the size of v's set and ``apart`` the number of its rows.
    """

    def differ(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in _DIFFERENCE.split(", ")]

        def packed(rows, found):
            counts = [len(f) for f in found]
            cols = [np.repeat(np.array(c, "i8"), counts) for c in zip(*rows, strict=True)]
            cols += [np.repeat(np.array(counts, "i8"), counts), np.concatenate(found).view("i8")]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

        rows, found, held = [], [], 0
        for b in _slices(batches):
            for u, u_key, v, v_key, component, x, y in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                own = _unpack_set(y)
                rows.append((u, u_key, v, v_key, component, len(own)))
                found.append(np.setxor1d(_unpack_set(x), own))
                held += len(found[-1])
                if held >= 100_000:
                    yield packed(rows, found)
                    rows, found, held = [], [], 0
        if rows:
            yield packed(rows, found)

    columns = _with_sets(balls, sets).select("u", "u_key", "v", "v_key", "component", "x", "y")
    return columns.mapInArrow(differ, _DIFFERENCE)


def apart_pairs(apart: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of nodes around one leader, in different components, that may be similar enough.

    Let D(x) be the shingles in which x differs from the leader, n(x) the size of x's set
    and k = (100 - percent) / (100 + percent). Sets x and y are similar enough if and only if
    they differ in k * (n(x) + n(y)) shingles at most, and they differ in
    |D(x)| + |D(y)| - 2 * |D(x) and D(y)|. So either |D(x)| + |D(y)| <= k * (n(x) + n(y)),
    and then both are linked with the leader already, or D(x) and D(y) share half of what
    is over. They are joined on their shared differences, rarest first: the first shared one
    must have enough others after it in both, and as a partner has n(x) * 100 / percent
    shingles at most, the last ones of x needn't be listed.

    Most differences are shared within one component only, by copies of one another; only
    shingles that several components around a leader have are kept, before anything is
    joined. A node is then set against each other component that has the shingle, as one row
    with the component's extremes, and stays if it can reach those; only what is left on both
    sides is paired, so nodes of one component are never paired with each other.
    """
    ball, own = ["lead", "lead_key"], ["node", "node_key"]
    # A partial aggregate: a shingle of many nodes travels as one row from each task, and the join can be split.
    held = apart.groupBy(*ball, "shingle").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("holders"))
    counted = apart.join(held.filter("a < b").select(*ball, "shingle", "holders"), [*ball, "shingle"])
    rank = Window.partitionBy(*ball, *own).orderBy(F.col("holders").desc(), F.col("shingle").desc())
    ranked = counted.withColumn("rest", F.row_number().over(rank).cast("long")).filter(f"{percent} * (apart - rest) <= {100 - percent} * n")
    # The shingles that x and y must share, times 2 * (100 + percent), are the sum of what each of them needs.
    listed = materialize(ranked.withColumn("needs", F.expr(f"{100 + percent} * apart - {100 - percent} * n")).drop("holders", "node_key", "apart"), "differences")
    sides = listed.groupBy(*ball, "shingle", "component").agg(F.min("needs").alias("least_needs"), F.max("rest").alias("most_rest"), F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    reach = f"""component <> other AND {percent} * n <= 100 * most_n AND {percent} * least_n <= 100 * n
        AND needs + least_needs <= {2 * (100 + percent)} * least(rest, most_rest)"""
    facing = listed.join(sides.withColumnRenamed("component", "other"), [*ball, "shingle"]).filter(reach)
    facing = materialize(facing.select(*ball, "shingle", "component", "other", "node", "n", "needs", "rest"), "facing")
    side = lambda name, a, b: facing.filter(f"{a} < {b}").select(*ball, "shingle", F.col(a).alias("a"), F.col(b).alias("b"), *(F.col(c).alias(f"{c}_{name}") for c in ("node", "n", "needs", "rest")))
    fits = f"""{percent} * n_x <= 100 * n_y AND {percent} * n_y <= 100 * n_x
        AND needs_x + needs_y <= {2 * (100 + percent)} * least(rest_x, rest_y)"""
    pairs = side("x", "component", "other").join(side("y", "other", "component"), [*ball, "shingle", "a", "b"]).filter(fits)
    found = materialize(pairs.select(F.least("node_x", "node_y").alias("u"), F.greatest("node_x", "node_y").alias("v")).distinct(), "apart")
    discard(listed, facing)
    return found


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``df(doc_id, text)``."""
    signed = materialize(signatures(df, width), "signatures")
    full = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes")
    member = full.select("doc_id", "set_a", "set_b").join(classes, ["set_a", "set_b"]).select("doc_id", "rep")
    reps = full.join(classes.select("set_a", "set_b", F.col("rep").alias("doc_id")), ["set_a", "set_b", "doc_id"], "left_semi").select("doc_id", "set_a", "bands", "low").dropDuplicates(["doc_id", "set_a"])

    banded = reps.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    buckets = materialize(banded.join(shared, "bucket").distinct(), "buckets")
    spread = buckets.groupBy("node").agg(F.count("*").alias("spread"))
    lead = buckets.join(spread, "node").groupBy("bucket").agg(F.min_by("node", F.struct(-F.col("spread"), F.xxhash64("node", F.lit(0)), "node")).alias("lead"))
    led = materialize(buckets.join(lead, "bucket").filter("node <> lead"), "led")
    discard(buckets)
    low = reps.select(F.col("doc_id").alias("node"), "low")

    def likely(pairs: DataFrame) -> DataFrame:
        side = lambda node, name: low.select(F.col("node").alias(node), F.col("low").alias(name))
        both = pairs.join(side("u", "x"), "u").join(side("v", "y"), "v")
        return materialize(both.filter(estimate(F.col("x"), F.col("y")) >= percent / 100 - MARGIN).select("u", "v").distinct(), "likely")

    pairs = likely(led.select(F.col("lead").alias("u"), F.col("node").alias("v")).distinct())
    sets = packed_sets(_ends(pairs), df, width)
    links = materialize(confirm(pairs, sets, percent), "links")
    discard(sets, pairs)
    done = [led, classes, links]

    settled = connected_components(links)
    placed = led.join(settled, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("bucket")
    balls = materialize(placed.join(open_, "bucket").select(F.col("lead").alias("u"), F.col("node").alias("v"), "component").distinct(), "balls")
    done += [settled, balls]
    if balls.limit(1).count():
        sets = packed_sets(_ends(balls), df, width)
        differing = materialize(differences(balls, sets), "differing")
        apart = apart_pairs(differing, percent)
        discard(differing)
        pairs = likely(apart)
        done.append(materialize(confirm(pairs, sets, percent), "links"))
        links = links.union(done[-1])
        discard(sets, apart, pairs)

    # Rows of one id may have several sets: these are one component too.
    several = member.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v"))
    several = materialize(several, "members")
    repeated = several.filter("u < v").select("doc_id")
    if repeated.limit(1).count():
        links = links.union(member.join(repeated, "doc_id").join(several.select("doc_id", "u"), "doc_id").filter("rep <> u").select("u", F.col("rep").alias("v")))
    settled = connected_components(links)
    discard(*done)
    ids = signed.select("doc_id", "n_shingles").join(several.select("doc_id", F.col("u").alias("node")), "doc_id", "left")
    return ids.join(settled, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))


def drop_near_duplicates(df: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, that of the smallest id, with all its columns; rows that repeat an id go too.

    A row with a null id is never linked and stays.
    """
    near = near_duplicates(df.select("doc_id", "text"), width, percent)
    kept = near.filter("doc_id = component_id").select("doc_id").distinct()
    one = df.join(kept, "doc_id", "left_semi")
    repeated = one.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    twice = one.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.join(repeated, "doc_id", "left_anti").unionByName(twice).unionByName(df.filter(F.col("doc_id").isNull()))


def op5_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: four-word shingles at similarity 0.8 over all documents."""
    near = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), width=4)
    return near.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _oracle(width: int, percent: int) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < {width} THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + {width - 1}], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {width - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(id, seen) AS (SELECT DISTINCT u, u FROM e UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.seen),
m AS (SELECT id, min(seen) AS c FROM r GROUP BY id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, doc_id)::BIGINT AS component_id, coalesce(m.c, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = doc_id
"""


ORACLE = _oracle(4, 80)
