"""Licence scan: a positional index of rare licence words, all in built-in functions.

A template is a licence sentence with a mandatory key phrase at a place in it. Its words
form the licence vocabulary, which is fixed by ``TEMPLATES``; so are the sizes of all that
is collected or repeated below. The steps:

1. Document frequencies of the vocabulary over the whole corpus give each word's IDF
   (one row for each vocabulary word comes back).
2. The index maps a word to its postings, (template, place). A template is entered under
   the two words of its key phrase with the highest IDF only. A phrase can't stand
   without its rarest words, so the lookup loses none.
3. A file's words are looked up under first entries; each posting gives a start of the
   template's key phrase. Only files with such a start are looked up under second entries,
   and the starts on which both agree by relative position are candidates.
4. A candidate is aligned with its whole template: all words of the key phrase must stand
   at their places, and the words that stand at theirs must have at least ``LEAST_SHARE``
   of the template's IDF, except for the basic phrases, which count wherever they stand.
   The file's score is the highest share of an accepted one.

Defined results: a null or empty text has no words, no labels and score 0; null ids and
repeated rows are scanned like others; an empty table gives an empty result; extra
columns pass through ``scan`` and the results live in one struct ``licence``, which
replaces an input column of that name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import documents

#: What stands between words: all ASCII characters but digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence sentence; ``key`` must stand in it. ``base`` marks the three basic phrases."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        """Place of the key phrase in the sentence, in words."""
        w, k = self.words, self.key.split()
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


# Licence sentences and their mandatory phrases, in lower case.
TEMPLATES = (
    Template("cc-by", "cc by", "cc by", base=True),
    Template("gpl", "licensed under the gnu general public license version 3", "general public license", base=True),
    Template("reserved", "all rights reserved", "all rights reserved", base=True),
    Template("mit", "released under the mit license", "mit license"),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use in source and binary forms"),
    Template("mpl", "mozilla public license version 2 0", "mozilla public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    Template("lgpl", "gnu lesser general public license version 2 1", "lesser general public license"),
    Template("agpl", "gnu affero general public license version 3", "affero general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "and or distribute this software for any purpose"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    Template("epl", "eclipse public license version 2 0", "eclipse public license"),
    Template("boost", "boost software license version 1 0", "boost software license"),
    Template("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "altered source versions must be plainly marked"),
    Template("apache", "you may not use this file except in compliance with the license", "use this file except in compliance"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form must reproduce"),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "used to endorse or promote products"),
)
#: Share of a template's IDF that must stand in the text around its key phrase.
LEAST_SHARE = 0.5
VOCABULARY = tuple(sorted({w for t in TEMPLATES for w in t.words}))


def file_words(text: Column) -> Column:
    """The file's words, in their own case; positions count from 0."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BETWEEN), lambda w: w != "")


def _licence_word(w: Column) -> Column:
    """Lower-cased word if it is ASCII; only those can equal a vocabulary word."""
    return F.when(F.octet_length(w) == F.length(w), F.lower(w))


def idf_table(df: DataFrame, text_col: str = "text") -> dict[str, float]:
    """IDF of each vocabulary word over all rows; at most ``len(VOCABULARY)`` rows return."""
    present = F.array_distinct(F.filter(F.transform(file_words(F.col(text_col)), _licence_word), lambda w: w.isin(list(VOCABULARY))))
    counted = {r.w: r.n for r in df.select(F.explode(present).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = df.count()
    return {w: math.log((total + 1) / (counted.get(w, 0) + 1)) + 1 for w in VOCABULARY}


def rare_index(idf: dict[str, float]) -> list[dict[str, list[tuple[int, int]]]]:
    """Postings (template, place in its key phrase) under the rarest word of each key phrase, and under the second rarest."""
    index: list[dict[str, list[tuple[int, int]]]] = [{}, {}]
    for n, t in enumerate(TEMPLATES):
        ranked = sorted(enumerate(t.key.split()), key=lambda x: (-idf[x[1]], x[0]))
        for entries, (place, word) in zip(index, ranked, strict=False):
            entries.setdefault(word, []).append((n, place))
    return index


def _looked_up(words: Column, entries: dict[str, list[tuple[int, int]]]) -> Column:
    """Starts of key phrases from the postings of all words under ``entries``: 256 * start + template, which needs a long."""
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.coalesce(_licence_word(F.get(words, i)).isin(list(entries)), F.lit(False)))
    postings = F.create_map(*(x for w, ps in entries.items() for x in (F.lit(w), F.array(*(F.lit(n - 256 * place).cast("long") for n, place in ps)))))
    starts = F.transform(at, lambda i: F.transform(F.element_at(postings, _licence_word(F.get(words, i))), lambda p: i.cast("long") * 256 + p))
    return F.when(F.size(words) > 0, F.flatten(starts)).otherwise(F.array().cast("array<bigint>"))


def _aligned(words: Column, start: Column, template: Column, idf: dict[str, float]) -> Column:
    """The span at a candidate: its template's fixed fields, whether the whole key phrase stands there, and its IDF share."""

    def fixed(t: Template) -> Column:
        total = sum(idf[w] for w in t.words)
        places = range(t.key_at, t.key_at + len(t.key.split()))
        parts = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(j - t.key_at).alias("at"), F.lit(idf[w] / total).alias("share"), F.lit(j in places).alias("key")) for j, w in enumerate(t.words)))
        return F.struct(F.lit(t.label).alias("label"), F.lit(len(t.key.split())).alias("key_words"), F.lit(t.base).alias("base"), parts.alias("parts"))

    own = F.element_at(F.array(*map(fixed, TEMPLATES)), template + 1)
    standing = F.filter(own["parts"], lambda p: F.coalesce(_licence_word(F.get(words, start + p["at"])) == p["w"], F.lit(False)))
    whole = F.size(F.filter(standing, lambda p: p["key"])) == own["key_words"]
    share = F.aggregate(standing, F.lit(0.0), lambda s, p: s + p["share"])
    return F.struct(own["label"].alias("label"), own["key_words"].alias("key_words"), own["base"].alias("base"), start.cast("long").alias("start"), share.alias("share"), whole.alias("whole"))


def scan(df: DataFrame, text_col: str = "text", idf: dict[str, float] | None = None) -> DataFrame:
    """``df`` with a struct ``licence``: n_words, spans (label, key_words, base, start, share) and score."""
    idf = idf or idf_table(df, text_col)
    first, second = rare_index(idf)
    own = [c for c in df.columns if c != "licence"]
    words, starts, spans = F.col("licence.words"), F.col("licence.starts"), F.col("licence.spans")
    found = df.select(*own, F.struct(file_words(F.col(text_col)).alias("words")).alias("licence"))
    found = found.select(*own, F.struct(words.alias("words"), _looked_up(words, first).alias("starts")).alias("licence"))
    found = found.select(*own, F.struct(words.alias("words"), F.when(F.size(starts) > 0, F.array_intersect(starts, _looked_up(words, second))).alias("starts")).alias("licence"))
    aligned = F.transform(starts, lambda s: _aligned(words, F.shiftright(s, 8).cast("int"), s.bitwiseAND(F.lit(255)).cast("int"), idf))
    accepted = F.filter(aligned, lambda s: s["whole"] & (s["base"] | (F.round(s["share"], 9) >= LEAST_SHARE)))
    found = found.select(*own, F.struct(F.size(words).cast("long").alias("n_words"), accepted.alias("spans")).alias("licence"))
    shown = F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in ("label", "key_words", "base", "start", "share"))))
    score = F.coalesce(F.array_max(F.transform(spans, lambda s: s["share"])), F.lit(0.0))
    return found.select(*own, F.struct(F.col("licence.n_words"), F.coalesce(shown, F.array()).alias("spans"), score.alias("score")).alias("licence"))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Query: licence labels of all documents."""
    found = scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    spans = F.col("licence.spans")
    base = F.filter(spans, lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    joined = lambda xs: F.array_join(F.sort_array(F.array_distinct(F.transform(xs, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id",
        F.col("licence.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(spans).alias("labels"),
        F.round(F.col("licence.score"), 6).alias("score"),
    )


def _oracle() -> str:
    quote = lambda xs: ", ".join(f"'{x}'" for x in xs)
    template = ", ".join(f"({n}, '{t.label}', {str(t.base).lower()}, {j}, '{w}', {t.key_at}, {len(t.key.split())})" for n, t in enumerate(TEMPLATES) for j, w in enumerate(t.words))
    lower = "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH t(n, label, base, j, w, key_at, key_len) AS (VALUES {template}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce({lower.replace("x,", "text,", 1)}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p AS (SELECT rid, i - 1 AS i, ws[i] AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) WHERE ws[i] IN ({quote(VOCABULARY)})),
idf AS (SELECT v.w, ln(((SELECT count(*) FROM d) + 1) / (coalesce(c.n, 0) + 1)) + 1 AS idf
  FROM (SELECT DISTINCT w FROM t) v LEFT JOIN (SELECT w, count(DISTINCT rid) AS n FROM p GROUP BY w) c USING (w)),
hit AS (SELECT p.rid, t.n, t.label, t.base, t.key_len, p.i - (t.j - t.key_at) AS start, t.j BETWEEN t.key_at AND t.key_at + t.key_len - 1 AS is_key, idf.idf
  FROM p JOIN t USING (w) JOIN idf USING (w)),
tot AS (SELECT n, sum(idf) AS total FROM t JOIN idf USING (w) GROUP BY n),
al AS (SELECT rid, n, label, base, start, sum(idf) AS got FROM hit JOIN tot USING (n) GROUP BY rid, n, label, base, start, key_len
  HAVING sum(is_key::INT) = key_len AND (base OR round(sum(idf) / any_value(total), 9) >= {LEAST_SHARE})),
r AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(got / total) AS score
  FROM al JOIN tot USING (n) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM d LEFT JOIN r USING (rid)
"""


ORACLE = _oracle()
