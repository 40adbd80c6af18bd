"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in column expression, so scan, metrics and verdict run in one
stage without a shuffle and without user functions.

Defined results: a null or empty text has no words and fails the base rule; a null
``doc_id`` is kept as it is; repeated rows are judged one by one; an empty table gives
an empty result; extra columns pass through ``apply_rules``, and metric columns live in
one struct ``metrics`` so that they clash with nothing (an input column of that name is
replaced). Windows and lines of a text are compared by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import space_words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as was at by are this from or an not "
    "der die und das den von zu mit ist des im dem nicht ein eine als auch es an auf "
    "le la les de et un une du que qui dans en pour pas sur est il au par ce "
    "el los las y del se por con su para al lo como si más o no una"
).split()

#: Positions take the low bits of a sort key and the hash the rest.
_POSITION_BITS = 31


@dataclass(frozen=True)
class Rule:
    """``low * scale <= metric / base <= high * scale`` in thousandths; None is no bound."""

    name: str
    metric: str
    base: str | None
    low: int | None
    high: int | None


#: The threshold table; bounds of ratios are in thousandths.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2000, 15000),
    Rule("symbol_word_ratio", "n_symbols", "n_words", None, 100),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 20, None),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 500),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", None, 300),
    Rule("bullet_line_ratio", "n_bullet_lines", "n_lines", None, 900),
)


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, width: int = 3) -> Column:
    """Number of words that lie in ``width``-word windows standing twice or more in ``words``.

    Windows are compared by 64-bit hashes. One sort of packed longs (high bits of the
    hash, then the position) brings candidates together; only those are compared by
    their whole hashes and turned back into positions.
    """
    low = (1 << _POSITION_BITS) - 1
    n = F.size(words)

    def of_hashes(h: Column) -> Column:
        keys = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))

        def candidates(s: Column) -> Column:
            high = lambda k: F.shiftright(F.get(s, k), _POSITION_BITS)
            near = F.filter(s, lambda e, k: F.coalesce(F.shiftright(e, _POSITION_BITS) == high(k - 1), F.lit(False)) | F.coalesce(F.shiftright(e, _POSITION_BITS) == high(k + 1), F.lit(False)))
            pairs = F.sort_array(F.transform(near, lambda e: F.struct(F.get(h, e.bitwiseAND(F.lit(low)).cast("int")).alias("h"), e.bitwiseAND(F.lit(low)).alias("p"))))

            def covered(ps: Column) -> Column:
                same = lambda e, k: F.coalesce(F.get(ps, k)["h"] == e["h"], F.lit(False))
                starts = F.sort_array(F.transform(F.filter(ps, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["p"]))
                steps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(width).cast("long"), F.coalesce(F.get(p, k + 1) - x, F.lit(width).cast("long"))))
                return _bind(starts, lambda p: F.aggregate(steps(p), F.lit(0).cast("long"), lambda a, x: a + x))

            return _bind(pairs, covered)

        return _bind(keys, candidates)

    hashes = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))
    return F.when(n >= width, _bind(hashes, of_hashes)).otherwise(F.lit(0).cast("long"))


def metrics(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Every metric of the table, as column expressions over ``text`` and its words and lines."""
    size = lambda c: F.size(c).cast("long")
    return {
        "n_words": size(words),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
        "n_lines": size(lines),
        "n_dup_lines": size(lines) - size(F.array_distinct(lines)),
        "n_ellipsis_lines": size(F.filter(lines, lambda x: F.rtrim(x).endswith("..."))),
        "n_bullet_lines": size(F.filter(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))),
        "n_stop_words": size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
        "n_repeat_words": repeated_words(words),
    }


def verdict(m: Column, rules=RULES) -> Column:
    """True where each rule of the table holds; compared in whole numbers."""
    held = F.lit(True)
    for r in rules:
        value = m[r.metric] * 1000 if r.base else m[r.metric]
        base = m[r.base] if r.base else F.lit(1)
        if r.low is not None:
            held = held & (value >= base * r.low)
        if r.high is not None:
            held = held & (value <= base * r.high)
    return held


def apply_rules(df: DataFrame, text_col: str = "text", rules=RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``df`` with the struct ``metrics`` and the booleans ``base_failed`` and ``kept``."""
    own = [c for c in df.columns if c not in ("metrics", "base_failed", "kept")]

    def of_parts(x: Column) -> Column:
        m = metrics(x["text"], x["words"], x["lines"])
        return _bind(F.struct(*[c.alias(k) for k, c in m.items()]), judged)

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < min_words) | (m["n_repeat_words"] * 100 > m["n_words"] * max_repeat_percent)
        return F.struct(m.alias("metrics"), failed.alias("base_failed"), (~failed & verdict(m, rules)).alias("kept"))

    def parts(text: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return _bind(F.struct(text.alias("text"), space_words(text).alias("words"), lines.alias("lines")), of_parts)

    # One expression for all of it: a filter on the verdict then repeats nothing when it is pushed down.
    whole = df.select(*own, _bind(F.coalesce(F.col(text_col), F.lit("")), parts).alias("metrics"))
    return whole.select(*own, "metrics.metrics", "metrics.base_failed", "metrics.kept")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Query: the rules over all documents, with the base metrics as columns."""
    from loamline.llm.common import documents

    judged = apply_rules(documents(spark, sf_dir).select("doc_id", "text"))
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")
    return judged.select("doc_id", *[F.col(f"metrics.{k}").alias(k) for k in shown], "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, (w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM s WHERE len(w) >= 3)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(3)) AS k) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...')) AS n_ellipsis_lines,
  len(list_filter(lines, lambda x: substr(ltrim(x, ' '), 1, 1) IN ('-', '*', '•'))) AS n_bullet_lines,
  len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words, coalesce(cov.n, 0) AS n_repeat_words
  FROM s LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, n_lines::BIGINT AS n_lines,
  n_stop_words::BIGINT AS n_stop_words, base_failed,
  NOT base_failed AND 1000 * word_chars >= 2000 * n_words AND 1000 * word_chars <= 15000 * n_words
    AND 1000 * n_symbols <= 100 * n_words AND 1000 * n_stop_words >= 20 * n_words
    AND 1000 * n_dup_lines <= 500 * n_lines AND 1000 * n_ellipsis_lines <= 300 * n_lines
    AND 1000 * n_bullet_lines <= 900 * n_lines AS kept
FROM f
"""
