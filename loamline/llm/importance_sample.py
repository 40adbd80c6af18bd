"""Importance resampling of documents towards a target distribution of hashed word runs.

1. A fixed split of the tokenizers library cuts a text, A-Z lower-cased, into words with
   their offsets. Each pair of offsets, of a run's first and last word, bounds a feature;
   its words joined by one space are hashed by crc32 into a bucket. A document's buckets are
   written once, two bytes a feature, and everything later reads those.
2. Tasks add up histograms of their documents; the sums of all documents and of all target
   texts, a row for each bucket, give each bucket's gain.
3. A document's weight is the floored mean of its gains; a hash of its id gives the noise
   that turns the weight into a score, so the highest scores are a sample by weight.
4. Scores are whole numbers of a bounded range, so a histogram of scores tells how many lie
   above each and where the sample ends; only within one score are documents sorted.

Texts are split in pieces of ``PIECE`` characters that end between words, so a long text
takes bounded memory.

Defined results: null and empty texts, and those without words, have no features and weight
0. A null id stands for an empty text where ids are hashed and comes before all others among
ties. Repeated rows are documents of their own with equal scores and get places one after
another. An empty table gives an empty result, an empty target no sums. Only the id and the
text are read; other columns don't pass through.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.common import documents, materialize, text_slices

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, "2024", 20, 10
#: Characters of a text that are split at a time; known features of a worker; bytes of texts in a slice.
PIECE, KNOWN, SLICE_BYTES = 16_384, 500_000, 8 << 20
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATORS = re.compile(_BETWEEN)


def splitter():
    """The untrained split: what stands between words is removed."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(_BETWEEN), "removed")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters that end between words."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > size and (found := _SEPARATORS.search(text, at + size)):
            end = found.start()
        yield text[at:end]
        at = end


def runs(split, text: str | None, low: int = 1, high: int = 1) -> Iterator[tuple[int, list[str]]]:
    """(words, features) of each piece of a text; runs that reach over the end of a piece belong to the next one."""
    lower = (text or "").encode().lower().decode()
    carried: list[str] = []
    for piece in pieces(lower):
        offsets = [x for _, x in split.pre_tokenize_str(piece)]
        n_words = len(offsets)
        if carried and offsets:
            before = " ".join(carried) + " "
            piece, shift, starts = before + piece, len(before), 0
            earlier = []
            for word in carried:
                earlier.append((starts, starts + len(word)))
                starts += len(word) + 1
            offsets = earlier + [(a + shift, b + shift) for a, b in offsets]
        features = []
        held = len(carried) if n_words else 0
        for n in range(low, high + 1):
            # A window of n words ends with its last one; those that end among the carried words were made before.
            for (a, _), (_, b) in zip(offsets[max(0, held - n + 1) :], offsets[max(0, held - n + 1) + n - 1 :], strict=False):
                features.append(piece[a:b] if n == 1 else _SEPARATORS.sub(" ", piece[a:b]))
        yield n_words, features
        if offsets and high > 1:
            carried = [piece[a:b] for a, b in offsets[1 - high :]]


def bucketed(df: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets) of ``df(doc_id, text)``, buckets as packed unsigned numbers."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        split, known = splitter(), {}

        def place(feature: str) -> int:
            found = known.get(feature)
            if found is None:
                if len(known) >= KNOWN:
                    known.clear()
                found = known[feature] = zlib.crc32(feature.encode()) % buckets
            return found

        for b in batches:
            for lo, texts in text_slices(b.column(1), SLICE_BYTES):
                words, sizes, packed = [], [], []
                for text in texts.to_pylist():
                    n_words, parts = 0, []
                    for n, features in runs(split, text, low, high):
                        n_words += n
                        parts.append(np.fromiter(map(place, features), kind, len(features)))
                    own = np.concatenate(parts) if parts else np.empty(0, kind)
                    words.append(n_words)
                    sizes.append(len(own))
                    packed.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n_words", "n_features", "buckets"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def _numbers(column, kind: str):
    """All packed numbers of an Arrow array of binaries, in order."""
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), kind)


def histogram(packed: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features in each bucket; a task gives a row for each of its buckets."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def add(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(buckets, "i8")
        for b in batches:
            for _, part in text_slices(b.column(0), SLICE_BYTES):
                total += np.bincount(_numbers(part, kind), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype("i4")), pa.array(total[held])], names=["bucket", "n"])

    sums = packed.select("buckets").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in sums.collect():
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln(target share / source share)) of each bucket, every bucket with one more feature."""
    more, s_total, t_total = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log((t + 1.0) * (s_total + more) / ((s + 1.0) * (t_total + more)))) for s, t in zip(source, target, strict=True)]


def weighed(packed: DataFrame, gain: list[int]) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of a document's gains, 0 without features."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"
    shared = packed.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array(shared.value, "i8")
        for b in batches:
            weights = []
            for lo, part in text_slices(b.column(3), SLICE_BYTES):
                sizes = b.column(2).slice(lo, len(part)).to_numpy()
                sums = np.concatenate([[0], np.cumsum(table[_numbers(part, kind)])])
                ends = np.cumsum(sizes)
                weights.append((sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.concatenate(weights) if weights else np.empty(0, "i8"))], names=["doc_id", "n_words", "n_features", "weight"])

    return packed.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln(u))) of a number u in (0, 1) made from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(u)))


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``scored`` with ``rank`` of the drawn documents; see the module's fourth step."""
    able = F.col("n_words") >= least_words
    # A row for each score: whole numbers between bounds that the corpus' size sets in its logarithm only.
    sums = scored.filter(able).groupBy("score").agg(F.count("*").alias("n"))
    most = (sums.agg(F.sum("n")).first()[0] or 0) * percent // 100
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    drawn = sums.select("score", above.alias("above")).filter(F.col("above") < most)
    placed = scored.join(F.broadcast(drawn), "score", "left")
    in_score = F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    top = placed.filter(able & F.col("above").isNotNull()).withColumn("rank", F.col("above") + in_score)
    rest = placed.filter(~able | F.col("above").isNull()).withColumn("rank", F.lit(None).cast("long"))
    return top.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).unionByName(rest).drop("above")


def sample(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS, seed: str = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of all documents; ``target(text)`` sets the distribution."""
    packed = materialize(bucketed(docs, low, high, buckets), "buckets")
    wanted = bucketed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), low, high, buckets)
    gain = gains(histogram(packed, buckets), histogram(wanted, buckets))
    scored = weighed(packed, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(materialize(scored, "scores"), percent, least_words)


def op13_importance_sample(spark, sf_dir: str) -> DataFrame:
    """Query: a tenth of the documents, drawn towards the benchmark's words."""
    found = sample(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
sw AS (SELECT rid, unnest(ws) AS w FROM d), tw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
wb AS (SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % {BUCKETS} AS b FROM (SELECT w FROM sw UNION SELECT w FROM tw), tab),
s AS (SELECT b, count(*) AS s FROM sw JOIN wb USING (w) GROUP BY 1), t AS (SELECT b, count(*) AS t FROM tw JOIN wb USING (w) GROUP BY 1),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM sw) + {BUCKETS}) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM tw) + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (b)),
x AS (SELECT rid, floor(sum(gain) / count(*))::BIGINT AS weight FROM sw JOIN wb USING (w) JOIN g USING (b) GROUP BY 1),
y AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN x USING (rid)),
r AS (SELECT *, n_features >= {LEAST_WORDS} AS able FROM y),
n AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS FIRST) AS i, count(*) FILTER (able) OVER () AS total FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND i <= total * {PERCENT} // 100 THEN i END AS rank FROM n
"""
