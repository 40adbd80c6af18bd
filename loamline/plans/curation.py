"""Curation queries over documents, benchmark, embeddings and pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamline.functions.arrays import bind
from loamline.operators import dedup, metrics, ranks, simhash
from loamline.operators.lineage import written
from loamline.operators.selection import percentiles
from loamline.operators.shingles import hashed_sets
from loamline.operators.shingles import words as _words
from loamline.sources import manifests
from loamline.sources.tables import table

#: Characters below which a document is too short; words of a window that counts as a leak; bits between near hashes.
LEAST_CHARS, LEAK_WORDS, NEAR_BITS = 64, 8, 5
#: As many hashes of windows are broadcast at most, about 100 MB on an executor.
BROADCAST_WINDOWS = 4_000_000
#: As many ids of documents that may be near copies are broadcast at most.
BROADCAST_NEAR = 4_000_000
#: Words of a shingle, and the share of them in percent that near copies have in common.
NEAR_WORDS, NEAR_PERCENT = 4, 80


def _windows(text):
    """Distinct windows of ``LEAK_WORDS`` words."""
    words = _words(text)

    def of(w):
        many = F.transform(F.sequence(F.lit(1), F.size(w) - LEAK_WORDS + 1), lambda i: F.array_join(F.slice(w, i, LEAK_WORDS), " "))
        return F.array_distinct(F.when(F.size(w) >= LEAK_WORDS, many).otherwise(F.array().cast("array<string>")))

    return bind(words, of)


def leaks(spark, sf):
    """(doc_id, origin, n_windows): the first benchmark item that shares a window with a document.

    Documents' windows are only looked up by their hashes among the benchmark's, which are
    broadcast up to ``BROADCAST_WINDOWS``; what is left is compared as text and counted.
    """
    hashed = lambda df, key: df.select(key, F.explode(_windows(F.col("text"))).alias("w")).select(key, F.xxhash64("w").alias("h"), "w")
    items = written(hashed(table(spark, sf, "benchmark"), "item_id"))
    hashes = items.select("h").distinct()
    if hashes.count() <= BROADCAST_WINDOWS:
        hashes = F.broadcast(hashes)
    docs = hashed(table(spark, sf, "documents"), "doc_id").join(hashes, "h", "left_semi")
    return docs.join(items, ["h", "w"]).groupBy("doc_id").agg(F.min("item_id").alias("origin"), F.countDistinct("w").alias("n_windows"))


def qa_gate_rows(spark, sf):
    """Each document with the first reason to drop it: corrupt, too short, exact copy, leak; else kept."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    # The text's digest stands for it in the shuffle; counts are made before.
    digests = written(docs.select("doc_id", "source", F.length("text").alias("n"), F.sha2("text", 256).alias("h")))
    first = digests.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    marked = digests.join(first, "h", "left").join(leaks(spark, sf).select("doc_id", "origin"), "doc_id", "left")
    reason = F.when(F.col("n").isNull() | (F.col("n") == 0), "corrupt").when(F.col("n") < LEAST_CHARS, "too_short").when(F.col("doc_id") > F.col("first_id"), "exact_duplicate").when(F.col("origin").isNotNull(), "leak").otherwise("kept")
    return marked.select("doc_id", "source", reason.alias("reason"), F.when(reason == "exact_duplicate", F.col("first_id")).when(reason == "leak", F.col("origin")).alias("origin"))


def qa_gate_report(spark, sf):
    return qa_gate_rows(spark, sf).groupBy("source", "reason").agg(F.count("*").alias("n"))


def exact_dup_groups(spark, sf):
    g = table(spark, sf, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("digest"))
    return g.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("n > 1")


def crossclass_conflicts(spark, sf):
    """Documents whose exact text also stands in another source."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"))
    split = d.groupBy("digest").agg(F.min("source").alias("a"), F.max("source").alias("b"), F.count("*").alias("n")).filter("a <> b")
    return d.join(split, "digest").select("doc_id", "source", "digest", "n")


def leak_first_match(spark, sf):
    return leaks(spark, sf)


def embedding_hashes(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", dedup.average_hash(F.col("embedding")).alias("h"))


def _classes(docs):
    """(doc_id, h) of documents with words: the first of their two SimHashes."""
    return simhash.simhashes(docs).select("doc_id", F.col("level").alias("h"))


def hash_class_members(spark, sf):
    """Each document with words, with the one that represents all of its hash."""
    h = written(_classes(table(spark, sf, "documents")))
    return h.join(dedup.hash_classes(h, "doc_id", "h"), "h").select("doc_id", "h", "rep", "n")


def near_pairs_hash(spark, sf):
    """Pairs of representatives at most ``NEAR_BITS`` bits apart with enough shingles in common; ``hash_class_members`` has their members."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    classes = written(dedup.hash_classes(_classes(docs), "doc_id", "h"))
    return simhash.confirmed(written(dedup.hamming_pairs(classes, NEAR_BITS)), docs)


def near_pair_summary(spark, sf):
    """Near pairs by distance and by whether their sources agree."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    p = near_pairs_hash(spark, sf).join(d.select(F.col("doc_id").alias("a"), F.col("source").alias("sa")), "a").join(d.select(F.col("doc_id").alias("b"), F.col("source").alias("sb")), "b")
    return p.groupBy("distance", (F.col("sa") == F.col("sb")).alias("same_source")).agg(F.count("*").alias("n"))


def keep_first_copies(docs, order):
    """(doc_id, id, dup_of) of each of ``docs(doc_id, text)``, walked through by ``id``, the value of ``order``.

    A row goes if an earlier kept one has at least ``NEAR_PERCENT`` of their shingles in
    common with it; all such pairs are found. Texts of equal words stand for one another,
    so copies aren't paired. A text without words is nobody's copy.
    """
    firsts = written(hashed_sets(docs.select("doc_id", order.alias("id"), "text"), NEAR_WORDS, lambda n: dedup.early(n, NEAR_PERCENT)))
    listed = firsts.select("doc_id", "id", "digest")
    first = written(listed.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("id", "doc_id")).alias("m")).select("digest", F.col("m.id").alias("rep"), F.col("m.doc_id").alias("doc_id")))
    near = written(dedup.may_pair(firsts.join(first.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "n", "s"), NEAR_PERCENT).select(F.col("id").alias("doc_id")))
    if near.count() <= BROADCAST_NEAR:
        near = F.broadcast(near)
    sets = hashed_sets(docs.select("doc_id", order.alias("id"), "text").join(near, "doc_id", "left_semi"), NEAR_WORDS)
    copies = dedup.keep_first_sets(sets.select("id", "s"), NEAR_PERCENT).filter("dup_of IS NOT NULL")
    decided = first.drop("doc_id").join(copies.withColumnRenamed("id", "rep"), "rep", "left")
    joined = listed.join(decided, "digest", "left")
    return joined.select("doc_id", "id", F.coalesce("dup_of", F.when(F.col("id") != F.col("rep"), F.col("rep"))).alias("dup_of"))


def near_dup_keep_first(spark, sf):
    """Each document, and the earliest kept one that it is a near copy of."""
    return keep_first_copies(table(spark, sf, "documents"), F.col("doc_id")).select("doc_id", "dup_of")


def diversity_topk(spark, sf):
    """The hundred longest documents that are left when near copies are gone; of near copies the longest stays."""
    d = table(spark, sf, "documents")
    longest_first = F.struct((-F.coalesce(F.col("n_chars").cast("long"), F.lit(0))).alias("less"), F.col("doc_id"))
    kept = keep_first_copies(d, longest_first).filter("dup_of IS NULL").select("doc_id")
    return d.select("doc_id", "n_chars").join(kept, "doc_id").orderBy(F.desc("n_chars"), "doc_id").limit(100)


def source_prefix_counts(spark, sf):
    """Documents by the source token of their names: parts between underscores, without numbers and ``test`` at the end; ``(none)`` if nothing is left."""
    i = F.col("doc_id")
    stem = F.concat_ws("_", F.when(i % 9 != 4, F.regexp_replace("source", r"([0-9]+)$", "_$1")), F.when(i % 5 == 0, "test"), F.lpad(i.cast("string"), 4, "0"))
    token = F.regexp_replace(stem, r"(^|_)((\d+|test)(_|$))+$", "")
    return table(spark, sf, "documents").groupBy(F.coalesce(F.nullif(token, F.lit("")), F.lit("(none)")).alias("prefix"), "lang").agg(F.count("*").alias("n"))


def length_stats(spark, sf):
    d = table(spark, sf, "documents").select("source", "n_chars")
    places = percentiles(d, ["source"], "n_chars", {"median": 0.5, "p95": 0.95}).withColumnsRenamed({"source": "s"})
    g = d.groupBy("source").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean"))
    j = g.join(places, F.col("source").eqNullSafe(F.col("s")), "left")
    return j.select(*g.columns, F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


def imbalance(spark, sf):
    g = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return g.agg(F.max("n").alias("largest"), F.min("n").alias("smallest"), F.round(F.max("n") / F.min("n"), 6).alias("ratio"))


def class_weights(spark, sf):
    """Inverse frequency weights of the sources, divided by their mean."""
    g = table(spark, sf, "documents").groupBy(F.col("source").alias("cls")).agg(F.count("*").alias("n"))
    return metrics.class_weights(g).withColumnRenamed("cls", "source")


def group_split(spark, sf, share: float = 0.2):
    """Whole groups of equal text to validation, class by class, until the share is reached; never the last group.

    Groups come in the order of their digest; the running total is over group sizes, not
    over rows, and by ranges of the digest.
    """
    d = table(spark, sf, "documents").select("source", F.md5(F.col("text").cast("binary")).alias("grp"))
    sizes = d.groupBy("source", "grp").agg(F.count("*").alias("n"))
    place = F.coalesce(F.conv(F.substring("grp", 1, 15), 16, 10).cast("long"), F.lit(-1))
    r = ranks.running(sizes, "source", place, ["grp"], F.col("n"))
    # The last group is the one with which the total is reached.
    return r.select("source", "grp", "n", ((F.col("before") < F.floor(F.col("total") * share)) & (F.col("before") + F.col("n") < F.col("total"))).alias("val"))


def _sharded_rows(spark, sf, share: float):
    """(source, name, grp) of each document: its language, or a shard of it if that is too large for the share."""
    d = table(spark, sf, "documents").select("source", F.col("lang").alias("grp"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"))
    sizes = d.groupBy("source", "grp").agg(F.count("*").alias("n"))
    totals = sizes.groupBy("source").agg(F.sum("n").alias("total"))
    cap = F.greatest(F.lit(1), F.bround(F.col("total") * share * 0.5)).cast("long")
    plan = sizes.join(totals, "source").select("source", "grp", F.when(F.col("n") > cap, F.ceil(F.col("n") / cap)).otherwise(1).cast("long").alias("shards"))
    # Digests are numbers of 40 hex digits; their remainder is built up from pieces of eight.
    sha = F.sha1("name")
    rest = F.lit(0).cast("long")
    for at in range(0, 40, 8):
        rest = (rest * F.lit(2**32) + F.conv(F.substring(sha, at + 1, 8), 16, 10).cast("long")) % F.col("shards")
    placed = d.join(F.broadcast(plan), ["source", "grp"])
    return placed.select("source", "name", F.when(F.col("shards") > 1, F.concat("grp", F.lit("#s"), rest.cast("string"))).otherwise(F.col("grp")).alias("grp"))


def _sides(sub, share: float):
    """(source, grp, n, val) of ``sub(source, grp)``: whole groups by digest go to validation until the share is reached, never the last one."""
    own = sub.groupBy("source", "grp").agg(F.count("*").alias("n"), F.md5(F.first("grp").cast("binary")).alias("digest"))
    r = ranks.running(own, "source", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"), ["grp"], F.col("n"))
    return r.select("source", "grp", "n", ((F.col("before") < F.floor(F.col("total") * share)) & (F.col("before") + F.col("n") < F.col("total"))).alias("val"))


def sharded_split(spark, sf, share: float = 0.2):
    """(source, grp, n, val) where one group is each language of a source, cut into shards if it is too large for the share.

    A group with more than half the validation rows is cut into as few shards as fit, by a
    digest of the row's name modulo their number. A group is never on both sides.
    """
    return _sides(_sharded_rows(spark, sf, share), share)


def split_rows(spark, sf, share: float = 0.2):
    """(source, grp, name, val): the side of each document."""
    rows = written(_sharded_rows(spark, sf, share))
    return rows.join(_sides(rows, share), ["source", "grp"]).select("source", "grp", "name", "val")


def overlap(sides):
    """One row (n_groups, n_overlap, n_training, n_validation) of ``sides(source, grp, val)``, whose rows say on which side each document is."""
    both = sides.groupBy("source", "grp").agg(F.max("val").alias("any_val"), F.min("val").alias("all_val"), F.count("*").alias("n"), F.sum(F.col("val").cast("long")).alias("v"))
    mixed = F.col("any_val") != F.col("all_val")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(F.count("*").alias("n_groups"), total(mixed.cast("long")).alias("n_overlap"), total(F.col("n") - F.col("v")).alias("n_training"), total(F.col("v")).alias("n_validation"))


def split_overlap(spark, sf):
    """Groups that have documents on both sides of the split: none, or the split is broken."""
    return overlap(split_rows(spark, sf))


def checked_split(spark, sf):
    """The split's rows, if no group is on both sides; a row of such a group is an error when it is read."""
    return assert_disjoint(split_rows(spark, sf))


def assert_disjoint(sides):
    """``sides`` with an error in place of the name of a row whose group is on both sides."""
    mixed = sides.groupBy("source", "grp").agg(F.min("val").alias("a"), F.max("val").alias("b")).filter("a <> b").select("source", "grp", F.lit(True).alias("mixed"))
    told = F.raise_error(F.concat(F.lit("a group is on both sides: "), F.concat_ws("/", "source", "grp"))).cast("string")
    return sides.join(mixed, ["source", "grp"], "left").select("source", "grp", F.when(F.col("mixed"), told).otherwise(F.col("name")).alias("name"), "val")


def split_report(spark, sf):
    return group_split(spark, sf).groupBy("source").agg(F.sum(F.when(F.col("val"), F.col("n")).otherwise(0)).alias("n_val"), F.sum("n").alias("n_all"), F.count("*").alias("n_groups"))


def first_k_per_class(spark, sf, k: int = 5):
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf, "documents").select("source", "doc_id", F.row_number().over(w).cast("long").alias("place")).filter(F.col("place") <= k)


def spot_sample(spark, sf, k: int = 5):
    """k rows spread evenly over each class."""
    ranked = ranks.numbered(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id")
    picked = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * (F.col("total") - 1) / F.lit(k - 1)).cast("long"))
    return ranked.filter(F.array_contains(picked, F.col("before"))).select("source", "doc_id", F.col("before").alias("i"))


def prefix_split(spark, sf):
    """The first four fifths of each source's rows for training."""
    r = ranks.numbered(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id")
    return r.groupBy("source").agg(F.sum(F.when(F.col("before") < F.floor(F.col("total") * 0.8), 1).otherwise(0)).alias("n_train"), F.count("*").alias("n_all"))


def dataset_fingerprint(spark, sf):
    """Rows of each source and one digest of their names in order.

    Names are numbered by range-wise places and digested in blocks of 1,000 places, the
    blocks' digests in blocks again, so that no row holds more than 1,000 of them, however
    sparse ids are; three levels serve a billion names.
    """
    placed = ranks.numbered(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id")
    d = placed.select("source", F.col("before").alias("k"), F.concat(F.lit("doc_"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("x"), F.lit(1).cast("long").alias("n"))
    for _ in range(3):
        whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]), "\n")
        d = d.groupBy("source", F.floor(F.col("k") / 1000).alias("k")).agg(F.sha2(whole, 256).alias("x"), F.sum("n").alias("n"))
    return d.groupBy("source").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]), "\n"), 256).alias("fingerprint"))


def url_parts(spark, sf):
    """Pages by host and language folder of their address."""
    u = table(spark, sf, "pages").select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1).alias("folder"))
    return u.groupBy("host", "folder").agg(F.count("*").alias("n"))


def attribution_credits(spark, sf):
    """Each source's credit line: its documents, languages in order, first eight ids and how many more."""
    first = ranks.numbered(table(spark, sf, "documents").select("source", "doc_id", "lang"), "source", "doc_id")
    g = first.groupBy("source").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("before") < 8, F.col("doc_id")))), " ").alias("ids"))
    return g.select("source", "n", "langs", "ids", F.when(F.col("n") > 8, F.concat(F.lit("+"), (F.col("n") - 8).cast("string"), F.lit(" more"))).otherwise("").alias("more"))


def license_order(spark, sf):
    """Licence lines, the most frequent first, those of equal frequency by digest."""
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line")).filter(F.lower("line").rlike("licen[sc]e|all rights reserved"))
    return lines.groupBy(F.md5(F.col("line").cast("binary")).alias("line")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "line")


def label_balance(spark, sf):
    """Labelled documents by kind: how many, and the ratio of toxic to safe ones."""
    g = table(spark, sf, "labels").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0)).alias("n_toxic"), F.coalesce(F.sum(F.when(F.col("toxic") == 0, 1)), F.lit(0)).alias("n_safe"))
    return g.select("n", "n_toxic", "n_safe", F.round(F.try_divide("n_toxic", "n_safe"), 6).alias("ratio"))


def manifest_reconcile(spark, sf):
    """Two manifests of different spelling, made from documents and pages, as one row for each name."""
    d = table(spark, sf, "documents").select(F.concat(F.lit("docs/"), F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 6)).alias("path"), F.col("lang").alias("class"), F.lit(" ").alias("license"), "source", (F.col("doc_id") * 2).alias("ord"))
    p = table(spark, sf, "pages").select(F.concat(F.lit("pages/x/"), F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 3)).alias("file"), F.lit("cc0").alias("license"), F.col("url").alias("image_url"), (F.col("page_id") * 2 + 1).alias("ord"))
    return manifests.reconcile(manifests.union_manifests(d, p), "ord").select("name", "path", "cls", "license", "source", "url", "n_rows")


QUERIES = {f.__name__: f for f in (qa_gate_report, qa_gate_rows, exact_dup_groups, crossclass_conflicts, leak_first_match, embedding_hashes, hash_class_members, near_pairs_hash, near_pair_summary, near_dup_keep_first, diversity_topk, source_prefix_counts, length_stats, imbalance, class_weights, group_split, sharded_split, split_overlap, checked_split, label_balance, split_report, first_k_per_class, spot_sample, prefix_split, dataset_fingerprint, url_parts, attribution_credits, license_order, manifest_reconcile)}

_W = f"(SELECT %s, unnest(range(1, len(ws) - {LEAK_WORDS - 2})) AS i, ws FROM (SELECT %s, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM %s))"
_LEAK = f"""
dw AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {LEAK_WORDS - 1}], ' ') AS w FROM {_W % ('doc_id', 'doc_id', 'documents')}),
bw AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + {LEAK_WORDS - 1}], ' ') AS w FROM {_W % ('item_id', 'item_id', 'benchmark')}),
lk AS (SELECT doc_id, min(item_id) AS origin, count(DISTINCT w) AS n_windows FROM dw JOIN bw USING (w) GROUP BY doc_id)"""
_QA = f"""{_LEAK}, fi AS (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text),
qa AS (SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL OR d.text = '' THEN 'corrupt' WHEN length(d.text) < {LEAST_CHARS} THEN 'too_short' WHEN d.doc_id > first_id THEN 'exact_duplicate' WHEN origin IS NOT NULL THEN 'leak' ELSE 'kept' END AS reason, first_id, origin
FROM documents d LEFT JOIN fi USING (text) LEFT JOIN lk USING (doc_id))"""
_HASH = "m AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e, list_sum(embedding::DOUBLE[]) / 64 AS mean FROM embeddings), hs AS (SELECT id, label, bit_xor(CASE WHEN e[i] > mean THEN CASE WHEN i = 1 THEN (-9223372036854775808)::BIGINT ELSE (1::BIGINT << (64 - i)::INTEGER) END ELSE 0::BIGINT END) AS h FROM (SELECT id, label, e, mean, unnest(range(1, 65)) AS i FROM m) GROUP BY id, label)"
_DOCS = f"""{simhash.SQL}, hs AS (SELECT doc_id, bit_or(CASE WHEN bp THEN CASE WHEN k = 0 THEN (-9223372036854775808)::BIGINT ELSE (1::BIGINT << (63 - k)::INTEGER) END ELSE 0::BIGINT END) AS h FROM sb GROUP BY 1),
cl AS (SELECT h, min(doc_id) AS rep, count(*) AS n FROM hs GROUP BY 1)"""
_PAIRS = f"hp AS (SELECT x.rep AS u, y.rep AS v, bit_count(xor(x.h, y.h))::BIGINT AS distance FROM cl x JOIN cl y ON x.rep < y.rep AND bit_count(xor(x.h, y.h)) <= {NEAR_BITS}), {simhash.confirm_sql('hp')}, np AS (SELECT u AS a, v AS b, distance FROM hp JOIN cf USING (u, v))"
_GRP = "sz AS (SELECT source, md5(text) AS grp, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY grp) - n AS before, row_number() OVER (PARTITION BY source ORDER BY grp) AS rn, sum(n) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS k FROM sz), gs AS (SELECT source, grp, n, before < floor(total * 0.2::DOUBLE) AND rn < k AS val FROM r)"

_SHARDS = """dn AS (SELECT source, lang, 'doc_' || doc_id || '.txt' AS name FROM documents), cg AS (SELECT source, lang, count(*) AS n FROM dn GROUP BY 1, 2),
cp AS (SELECT *, greatest(1, round_even(sum(n) OVER (PARTITION BY source) * 0.2::DOUBLE * 0.5::DOUBLE, 0)::BIGINT) AS cap FROM cg),
ng AS (SELECT dn.source, CASE WHEN n > cap THEN dn.lang || '#s' || ((('0x' || substr(sha1(name), 1, 20))::HUGEINT % ceil(n / cap)::HUGEINT * (1208925819614629174706176::HUGEINT % ceil(n / cap)::HUGEINT) + ('0x' || substr(sha1(name), 21, 20))::HUGEINT) % ceil(n / cap)::HUGEINT) ELSE dn.lang END AS grp, name FROM dn JOIN cp ON cp.source = dn.source AND cp.lang = dn.lang),
sn AS (SELECT source, grp, count(*) AS n FROM ng GROUP BY 1, 2),
sv AS (SELECT source, grp, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY md5(grp) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < floor(sum(n) OVER (PARTITION BY source) * 0.2::DOUBLE) AND lead(n) OVER (PARTITION BY source ORDER BY md5(grp)) IS NOT NULL AS val FROM sn)"""
_WALK = f"""ws AS (SELECT doc_id, row_number() OVER (ORDER BY {{order}}) AS rn, n_chars, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT rn, array_to_string(w[i:i + {NEAR_WORDS - 1}], ' ') AS g FROM (SELECT rn, w, unnest(range(1, greatest(len(w) - {NEAR_WORDS - 1}, 1) + 1)) AS i FROM ws WHERE len(w) > 0)),
nn AS (SELECT rn, count(*) AS n FROM sh GROUP BY 1),
cc AS (SELECT a.rn AS u, b.rn AS v, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.rn < b.rn GROUP BY 1, 2),
li AS (SELECT v, list(u ORDER BY u) AS us FROM cc JOIN nn x ON x.rn = u JOIN nn y ON y.rn = v WHERE 100 * c >= {NEAR_PERCENT} * (x.n + y.n - c) GROUP BY v),
st AS (SELECT v, us, row_number() OVER (ORDER BY v) AS i FROM li),
wk(i, v, dup, gone) AS (SELECT i, v, us[1], [v] FROM st WHERE i = 1
  UNION ALL SELECT st.i, st.v, list_filter(us, lambda x: NOT list_contains(gone, x))[1], CASE WHEN len(list_filter(us, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, st.v) ELSE gone END FROM wk JOIN st ON st.i = wk.i + 1),
kp AS (SELECT ws.doc_id, ws.n_chars, o.doc_id AS dup_of FROM ws LEFT JOIN wk ON wk.v = ws.rn LEFT JOIN ws o ON o.rn = wk.dup)"""
ORACLES = {
    "near_dup_keep_first": f"WITH RECURSIVE {_WALK.format(order='doc_id')} SELECT doc_id, dup_of FROM kp",
    "diversity_topk": f"WITH RECURSIVE {_WALK.format(order='coalesce(n_chars, 0) DESC, doc_id')} SELECT doc_id, n_chars FROM kp WHERE dup_of IS NULL ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 100",
    "label_balance": "SELECT count(*) AS n, count(*) FILTER (toxic = 1) AS n_toxic, count(*) FILTER (toxic = 0) AS n_safe, round(count(*) FILTER (toxic = 1) / nullif(count(*) FILTER (toxic = 0), 0), 6) AS ratio FROM labels",
    "sharded_split": f"WITH {_SHARDS} SELECT source, grp, n, val FROM sv",
    "split_overlap": f"WITH {_SHARDS}, w AS (SELECT ng.source, ng.grp, val FROM ng JOIN sv ON sv.source = ng.source AND sv.grp = ng.grp), o AS (SELECT source, grp, count(DISTINCT val) AS k, count(*) AS n, count(*) FILTER (val) AS v FROM w GROUP BY 1, 2) SELECT count(*) AS n_groups, count(*) FILTER (k > 1) AS n_overlap, sum(n - v)::BIGINT AS n_training, sum(v)::BIGINT AS n_validation FROM o",
    "checked_split": f"WITH {_SHARDS} SELECT ng.source, ng.grp, ng.name, val FROM ng JOIN sv ON sv.source = ng.source AND sv.grp = ng.grp",
    "qa_gate_report": f"WITH {_QA} SELECT source, reason, count(*) AS n FROM qa GROUP BY 1, 2",
    "qa_gate_rows": f"WITH {_QA} SELECT doc_id, source, reason, CASE reason WHEN 'exact_duplicate' THEN first_id WHEN 'leak' THEN origin END AS origin FROM qa",
    "exact_dup_groups": "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "crossclass_conflicts": "WITH g AS (SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1) SELECT doc_id, source, digest, n FROM (SELECT doc_id, source, md5(text) AS digest FROM documents) JOIN g USING (digest)",
    "leak_first_match": f"WITH {_LEAK} SELECT doc_id, origin, n_windows FROM lk",
    "embedding_hashes": f"WITH {_HASH} SELECT id, label, h FROM hs",
    "hash_class_members": f"WITH {_DOCS} SELECT doc_id, h, rep, n FROM hs JOIN cl USING (h)",
    "near_pairs_hash": f"WITH {_DOCS}, {_PAIRS} SELECT a, b, distance FROM np",
    "near_pair_summary": f"WITH {_DOCS}, {_PAIRS} SELECT distance, x.source = y.source AS same_source, count(*) AS n FROM np JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b GROUP BY 1, 2",
    "source_prefix_counts": "WITH s AS (SELECT lang, string_split(concat_ws('_', CASE WHEN doc_id % 9 <> 4 THEN regexp_replace(source, '([0-9]+)$', '_\\1') END, CASE WHEN doc_id % 5 = 0 THEN 'test' END, CASE WHEN doc_id < 10000 THEN lpad(doc_id::VARCHAR, 4, '0') ELSE substr(doc_id::VARCHAR, 1, 4) END), '_') AS p FROM documents), k AS (SELECT lang, p, coalesce(list_max(list_filter(range(1, len(p) + 1), lambda i: NOT regexp_full_match(p[i], '[0-9]+|test'))), 0) AS last FROM s) SELECT CASE last WHEN 0 THEN '(none)' ELSE array_to_string(p[1:last], '_') END AS prefix, lang, count(*) AS n FROM k GROUP BY 1, 2",
    "length_stats": "SELECT source, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.95), 6) AS p95 FROM documents GROUP BY 1",
    "imbalance": "SELECT max(n) AS largest, min(n) AS smallest, round(max(n) / min(n), 6) AS ratio FROM (SELECT count(*) AS n FROM documents GROUP BY source)",
    "class_weights": "WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source, n, round((1 / n) / (SELECT avg(1 / n) FROM g), 6) AS weight FROM g",
    "group_split": f"WITH {_GRP} SELECT source, grp, n, val FROM gs",
    "split_report": f"WITH {_GRP} SELECT source, sum(CASE WHEN val THEN n ELSE 0 END)::BIGINT AS n_val, sum(n)::BIGINT AS n_all, count(*) AS n_groups FROM gs GROUP BY 1",
    "first_k_per_class": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents QUALIFY place <= 5",
    "spot_sample": "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id, i FROM r WHERE list_contains(list_transform(range(5), lambda j: floor(j * (n - 1) / 4)::BIGINT), i)",
    "prefix_split": "WITH r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, sum((i <= floor(n * 0.8::DOUBLE))::INTEGER)::BIGINT AS n_train, count(*) AS n_all FROM r GROUP BY 1",
    "dataset_fingerprint": "WITH a AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, 'doc_' || doc_id AS x FROM documents), b AS (SELECT source, k // 1000 AS k, sha256(string_agg(x, chr(10) ORDER BY k)) AS x, count(*) AS n FROM a GROUP BY 1, k // 1000), c AS (SELECT source, k // 1000 AS k, sha256(string_agg(x, chr(10) ORDER BY k)) AS x, sum(n) AS n FROM b GROUP BY 1, k // 1000), d AS (SELECT source, k // 1000 AS k, sha256(string_agg(x, chr(10) ORDER BY k)) AS x, sum(n) AS n FROM c GROUP BY 1, k // 1000) SELECT source, sum(n)::BIGINT AS n, sha256(string_agg(x, chr(10) ORDER BY k)) AS fingerprint FROM d GROUP BY 1",
    "url_parts": "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS folder, count(*) AS n FROM pages GROUP BY 1, 2",
    "attribution_credits": "WITH r AS (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) SELECT source, count(*) AS n, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) FILTER (i <= 8) AS ids, CASE WHEN count(*) > 8 THEN '+' || (count(*) - 8) || ' more' ELSE '' END AS more FROM r GROUP BY 1",
    "license_order": "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT md5(line) AS line, count(*) AS n FROM l WHERE regexp_matches(lower(line), 'licen[sc]e|all rights reserved') GROUP BY 1",
    "manifest_reconcile": "WITH u AS (SELECT 'docs/' || substr(md5(coalesce(text, '')), 1, 6) AS path, lang AS cls, NULL AS license, source, NULL AS url, doc_id * 2 AS ord FROM documents UNION ALL SELECT 'pages/x/' || substr(md5(coalesce(url, '')), 1, 3), NULL, 'cc0', NULL, url, page_id * 2 + 1 FROM pages), n AS (SELECT *, string_split(path, '/')[-1] AS name FROM u) SELECT name, path, cls, license, source, url, count(*) OVER (PARTITION BY name) AS n_rows FROM n QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord DESC) = 1",
}
