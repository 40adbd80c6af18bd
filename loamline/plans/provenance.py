"""Leaks, conflicts and provenance joins over documents, labels and pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.functions import feedback as fb
from loamline.functions import sources as so
from loamline.operators import dedup, ranks, simhash
from loamline.operators.lineage import written
from loamline.plans.triage import feedback_entries
from loamline.sources.tables import table

#: Bits by which both hashes of near copies may differ; classes of sides that a shape must lie between.
NEAR_BITS = 5
#: Bits by which a fetched document must differ from held-out ones, less one.
FETCH_BITS = 6
LEAST_SIDE, ASPECTS, LEAST_SPREAD, MOST_AREA = 2, (0.4, 200.0), 0.02, 50_000


def leak_matches(staged, reference, docs):
    """(doc_id, kind, origin) of staged rows with a copy in the reference; an exact one beats a near one, then the reference's order counts.

    ``staged(doc_id, digest, level, step, rep)``, ``reference(ord, origin, digest, level, step, rep)``;
    ``ord`` puts held-out rows first. Rows of equal digest or hashes stand for one another;
    hashes that are near are confirmed on the shingles of the documents that represent them.
    """
    by_digest = reference.filter("digest IS NOT NULL").groupBy("digest").agg(F.min_by("origin", "ord").alias("exact"))
    exact = staged.join(by_digest, "digest").select("doc_id", "exact")
    hashes = staged.filter("level IS NOT NULL").select("level", "step", "rep").distinct()
    ref = reference.filter("level IS NOT NULL").groupBy("level", "step", "rep").agg(F.min("ord").alias("ord"), F.min_by("origin", "ord").alias("origin"))
    found = written(dedup.hamming_matches(hashes, ref, ("level", "step"), NEAR_BITS).select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"), "r.ord", "r.origin"))
    near = simhash.confirmed(found, docs).groupBy(F.col("a").alias("rep")).agg(F.min_by("origin", "ord").alias("near"))
    near = staged.select("doc_id", "rep").join(near, "rep").select("doc_id", "near")
    both = exact.join(near, "doc_id", "full")
    return both.select("doc_id", F.when(F.col("exact").isNotNull(), "exact").otherwise("near").alias("kind"), F.coalesce("exact", "near").alias("origin"))


def _hashed(spark, sf):
    """(doc_id, source, digest, level, step, rep); ``rep`` is the smallest id of equal hashes, null without words."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    digest = F.when(F.col("text") != "", F.sha2("text", 256)).alias("digest")
    hashes = written(simhash.simhashes(docs))
    reps = hashes.groupBy("level", "step").agg(F.min("doc_id").alias("rep"))
    return written(docs.select("doc_id", "source", digest).join(hashes.join(reps, ["level", "step"]), "doc_id", "left"))


def _documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def leak_report(spark, sf):
    """Staged documents (a third) that copy held-out ones (another third) or the pool: exact first, held-out first, then by id."""
    d = _hashed(spark, sf)
    part = F.col("doc_id") % 3
    held = (part == 1).cast("int")
    origin = F.concat(F.when(part == 1, "held_out:").otherwise("pool:"), F.col("doc_id").cast("string"))
    reference = d.filter(part != 0).select(F.struct((1 - held).alias("pool"), "doc_id").alias("ord"), origin.alias("origin"), "digest", "level", "step", "rep")
    return leak_matches(d.filter(part == 0), reference, _documents(spark, sf))


def audit_leakage(spark, sf):
    """Test documents (a tenth) with a copy in training: how many of each kind, and how many of them are from the same source."""
    d = _hashed(spark, sf)
    test = F.col("doc_id") % 10 == 0
    reference = d.filter(~test).select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("origin"), "digest", "level", "step", "rep")
    found = leak_matches(d.filter(test), reference, _documents(spark, sf))
    own = d.select("doc_id", "source")
    j = found.join(own, "doc_id").join(own.select(F.col("doc_id").alias("origin"), F.col("source").alias("other")), "origin")
    return j.groupBy("kind").agg(F.count("*").alias("n"), F.sum((F.col("source") == F.col("other")).cast("long")).alias("n_same_source"))


def crossclass_near(spark, sf):
    """Documents with a near copy in another source, and the last such partner by id.

    Documents of equal hashes stand together: each group keeps its last id and the last one
    of another source, which is enough for every member's last partner.
    """
    d = _hashed(spark, sf).filter("level IS NOT NULL").select("doc_id", "source", "level", "step", "rep")
    by_source = d.groupBy("level", "step", "rep", "source").agg(F.max("doc_id").alias("last"))
    top = by_source.groupBy("level", "step", "rep").agg(F.max(F.struct("last", "source")).alias("a"))
    second = by_source.join(top.select("rep", "a"), "rep").filter("source <> a.source").groupBy("rep").agg(F.max("last").alias("b"))
    groups = written(top.join(second, "rep", "left").select("level", "step", "rep", "a", "b"))
    found = dedup.hamming_matches(groups.select("level", "step", "rep"), groups, ("level", "step"), NEAR_BITS)
    found = written(found.select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"), F.col("r.a").alias("top"), F.col("r.b").alias("second")))
    near = simhash.confirmed(found, _documents(spark, sf)).select(F.col("a").alias("rep"), "top", "second")
    partner = F.when(F.col("top.source") != F.col("source"), F.col("top.last")).otherwise(F.col("second"))
    # A group meets itself too, so partners of equal hashes are among them; sources of a group are few against its rows.
    found = by_source.select("rep", "source").join(near, "rep").groupBy("rep", "source").agg(F.max(partner).alias("partner"))
    return d.join(found.filter("partner IS NOT NULL"), ["rep", "source"]).select("doc_id", "source", "partner")


def fetch_dedup(spark, sf):
    """Fetched documents (two thirds) that are kept: none near a held-out one, none near an earlier kept one; by one hash and the shingles.

    Rows of equal hash stand for one another, so copies aren't paired.
    """
    docs = _documents(spark, sf)
    h = written(simhash.simhashes(docs).select("doc_id", "level"))
    held = dedup.hash_classes(h.filter("doc_id % 3 = 1"), "doc_id", "level").select(F.col("h").alias("level"), F.col("h").alias("same"), "rep")
    classes = written(dedup.hash_classes(h.filter("doc_id % 3 <> 1"), "doc_id", "level"))
    found = dedup.hamming_matches(classes.select("rep", F.col("h").alias("level"), F.col("h").alias("same")), held, ("level", "same"), FETCH_BITS)
    near = simhash.confirmed(written(found.select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"))), docs)
    free = written(classes.join(near.select(F.col("a").alias("rep")).distinct(), "rep", "left_anti"))
    links = simhash.confirmed(written(dedup.hamming_pairs(free, NEAR_BITS).select("a", "b")), docs)
    kept = dedup.keep_first(free.select(F.col("rep").alias("id")), links)
    return kept.filter("dup_of IS NULL").select(F.col("id").alias("doc_id"))


def _name(doc_id):
    return F.concat(F.lit("img_"), doc_id.cast("string"), F.lit(".jpg"))


def _manifest(spark, sf):
    """A manifest row for most documents: observation ids repeat, some fields are empty."""
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    licenses = F.array(*map(F.lit, ("cc0", "cc-by", "cc-by-nc", "cc-by", "")))
    return d.filter(i % 11 != 4).select(
        i.alias("ord"), (i % 2).alias("file_no"), F.nullif(F.floor(i / 4), F.lit(0)).alias("observation_id"), _name(i).alias("name"), F.nullif(F.get(licenses, (i % 5).cast("int")), F.lit("")).alias("license"),
        F.when(i % 3 == 0, F.col("source")).alias("photographer_name"), F.when(i % 3 == 1, F.concat(F.lit("login_"), "lang")).alias("photographer_login"), F.when(i % 7 != 2, F.concat(F.lit("by "), "source")).alias("attribution"),
    )


def survivors_provenance(spark, sf):
    """Documents that are kept by length, with what the manifest knows of their name; null where it has no row."""
    d = table(spark, sf, "documents").filter("n_chars >= 64").select("doc_id", "source", _name(F.col("doc_id")).alias("name"))
    m = _manifest(spark, sf).select("name", "license", "observation_id")
    return d.join(m, "name", "left").select("doc_id", "name", "license", "observation_id")


def _joined(spark, sf):
    """Pool images with the first manifest row of their observation, manifests in order of their names."""
    first = _manifest(spark, sf).filter("observation_id IS NOT NULL").groupBy("observation_id").agg(F.min_by(F.struct("license", "photographer_name", "photographer_login", "attribution"), F.struct("file_no", "ord")).alias("p"))
    pool = table(spark, sf, "documents").filter("n_chars >= 64").select("doc_id", "lang", F.floor(F.col("doc_id") / 4).alias("observation_id"))
    j = pool.join(first, "observation_id", "left")
    name = F.coalesce(so.first_filled(F.col("p.photographer_name"), F.col("p.photographer_login"), F.col("p.attribution")), F.lit("Unknown"))
    return j.select("doc_id", "lang", "observation_id", F.col("p").isNotNull().alias("found"), F.coalesce("p.license", F.lit("unknown")).alias("license"), F.trim(name).alias("photographer"))


def attribution_summary(spark, sf):
    """Pool images with and without provenance, their observations and photographers, and whether any licence forbids commercial use."""
    j = _joined(spark, sf)
    when = lambda c: F.when(F.col("found"), F.col(c))
    return j.agg(
        F.count("*").alias("n_pool"), F.sum((~F.col("found")).cast("long")).alias("n_unprovenanced"), F.countDistinct(when("observation_id")).alias("n_observations"), F.countDistinct(when("photographer")).alias("n_photographers"),
        F.coalesce(F.max(F.col("found") & F.col("license").isin(*so.NONCOMMERCIAL)), F.lit(False)).alias("noncommercial"),
    )


def license_breakdown(spark, sf):
    """Images and observations of each licence, the most common first."""
    return _joined(spark, sf).filter("found").groupBy("license").agg(F.count("*").alias("n"), F.countDistinct("observation_id").alias("n_observations")).orderBy(F.desc("n"), "license")


def photographer_credits(spark, sf):
    """Observations of each photographer and licence: how many, the first eight, how many more; names without regard to case."""
    own = _joined(spark, sf).filter("found").select("photographer", "license", "observation_id").distinct()
    r = ranks.numbered(own.withColumn("credit", F.concat_ws("\u0000", "photographer", "license")), "credit", "observation_id")
    g = r.groupBy("photographer", "license").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("before") < 8, F.col("observation_id")))), ", ").alias("ids"))
    return g.select("photographer", "license", "n", "ids", F.when(F.col("n") > 8, F.concat(F.lit("+"), (F.col("n") - 8).cast("string"), F.lit(" more"))).otherwise("").alias("more")).orderBy(F.lower("photographer"), "license")


def group_provenance(spark, sf):
    """Each document's group: the manifest's, else the older provenance file's, else its source without number; the last row of a name wins."""
    d = table(spark, sf, "documents").select("doc_id", "source", _name(F.col("doc_id")).alias("name"))
    m = _manifest(spark, sf).filter("observation_id IS NOT NULL").groupBy("name").agg(F.max_by("observation_id", "ord").alias("newer"))
    old = table(spark, sf, "labels").filter("quality = 1").groupBy(_name(F.col("doc_id")).alias("name")).agg(F.max(F.concat(F.lit("old_"), F.col("doc_id").cast("string"))).alias("older"))
    j = d.join(m, "name", "left").join(old, "name", "left")
    return j.select("doc_id", F.coalesce(F.concat(F.lit("obs_"), F.col("newer").cast("string")), "older", F.regexp_replace("source", r"(_?(\d+|test))+$", "")).alias("grp"))


def worklist_feedback(spark, sf):
    """The hundred longest documents that nobody has labelled, with the feedback on their name, if any."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.concat(F.lit("shot "), F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 12), F.lit(".jpg")).alias("filename"))
    known = table(spark, sf, "labels").filter("quality IS NOT NULL").select("doc_id")
    top = d.join(known, "doc_id", "left_anti").orderBy(F.desc("n_chars"), "doc_id").limit(100)
    f = feedback_entries(spark, sf).groupBy(F.trim("filename").alias("filename")).agg(F.min_by(F.struct("status", "corrected"), "doc_id").alias("f"))
    return top.join(f, "filename", "left").select("doc_id", "filename", "f.status", "f.corrected")


def pending_uploads(spark, sf):
    """Named feedback rows that aren't in the ledger of uploads, which here holds every third one."""
    e = feedback_entries(spark, sf).select("doc_id", F.trim("filename").alias("filename"), "status")
    ledger = e.filter("doc_id % 3 = 0").select("filename")
    return e.filter("filename <> ''").join(ledger, "filename", "left_anti").select("doc_id", "filename", fb.sanitize_stem(F.col("filename")).alias("sent_as"))


def batch_merge(spark, sf):
    """The server's manifest after a batch: rows whose name it held before are left out, repeated names within the batch stay."""
    e = feedback_entries(spark, sf).select("doc_id", F.trim("filename").alias("filename"))
    held, batch = e.filter("doc_id % 4 = 0"), e.filter("doc_id % 4 <> 0")
    fresh = batch.join(held.select("filename").distinct(), "filename", "left_anti")
    return held.select("doc_id", "filename", F.lit(False).alias("fresh")).union(fresh.select("doc_id", "filename", F.lit(True)))


def media_credits(spark, sf):
    """Still images of occurrences with an allowed licence, their place in the occurrence, date and credit line."""
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    pick = lambda xs, k: F.get(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int"))
    marks = ("http://creativecommons.org/licenses/by/4.0/legalcode", "", "http://creativecommons.org/licenses/by-nc/4.0/", "CC0_1_0", "https://creativecommons.org/publicdomain/zero/1.0/")
    entry = lambda k: F.struct(pick(("StillImage", "Sound", None), i + k).alias("type"), F.when((i + k) % 7 != 0, F.concat(F.lit("https://x/"), i.cast("string"), F.lit(f"/{k}"))).alias("identifier"), pick(marks, i + 2 * k).alias("license"), F.when((i + k) % 4 == 0, F.col("source")).alias("rightsHolder"), F.when((i + k) % 4 == 1, F.concat(F.lit("c_"), "lang")).alias("creator"))
    dates = ("2021-06-14T11:23:15", "2021-06-14", "2021-06-14/2021-06-15", "", None)
    occ = d.select(i.alias("occurrence_id"), F.array(*map(entry, range(3))).alias("media"), pick(marks, i).alias("occ_license"), F.when(i % 5 == 0, F.lit("holder")).alias("occ_holder"), F.when(i % 2 == 0, F.col("lang")).alias("recorded_by"), so.event_date(pick(dates, i)).alias("day"))
    m = occ.select("*", F.posexplode(so.still_images(F.col("media"))).alias("pos", "m"))
    code = so.media_license(F.col("m.license"), F.col("occ_license"))
    credit = so.attribution(F.col("code"), F.col("occurrence_id"), F.col("m.rightsHolder"), F.col("occ_holder"), F.col("m.creator"), F.col("recorded_by"))
    return m.withColumn("code", code).filter("code IS NOT NULL").select("occurrence_id", "pos", "code", "day", credit.alias("credit"))


def committed_names(spark, sf):
    """Names of kept documents in the pool: numbers of each language run on from the highest one there."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    there = d.filter("doc_id % 6 = 0").groupBy("lang").agg(F.max(F.col("doc_id") % 100).alias("most"))
    fresh = ranks.numbered(d.filter("doc_id % 6 <> 0"), "lang", "doc_id").join(there, "lang", "left")
    index = F.coalesce(F.col("most") + 1, F.lit(0)) + F.col("before")
    ext = F.when(F.col("doc_id") % 2 == 0, "JPEG").otherwise("png")
    return fresh.select("doc_id", so.committed_name(F.lit("gbif v2.1"), F.col("lang"), index, ext).alias("name"))


def shape_gate(spark, sf):
    """Why a document's shape fails, the first reason that applies: corrupt, low_resolution, bad_aspect, flat; and whether it is oversized.

    Its width is its longest line, its height the number of lines, its colour the share of distinct ones among its characters.
    """
    d = table(spark, sf, "documents").select("doc_id", "text")
    lines = F.split("text", "\n")
    s = d.select("doc_id", "text", F.array_max(F.transform(lines, F.length)).cast("long").alias("w"), F.size(lines).cast("long").alias("h"), F.size(F.array_distinct(F.split("text", ""))).alias("distinct"))
    aspect = F.when(F.col("h") == 0, 0.0).otherwise(F.col("w") / F.col("h"))
    spread = F.try_divide("distinct", F.length("text"))
    drop = F.when(F.coalesce(F.col("text"), F.lit("")) == "", "corrupt").when(F.least("w", "h") < LEAST_SIDE, "low_resolution").when(~aspect.between(*ASPECTS), "bad_aspect").when(spread < LEAST_SPREAD, "flat")
    return s.select("doc_id", "w", "h", drop.alias("reason"), F.coalesce(F.col("w") * F.col("h") > MOST_AREA, F.lit(False)).alias("oversized"))


def map_filters(spark, sf):
    """Feedback rows that can stand on a map, by filter: all, confirmed ones, and all others, rows without a state among them."""
    e = feedback_entries(spark, sf).select(F.nullif(F.lower(F.trim("status")), F.lit("none")).alias("state"), "synthetic", so.usable_place(F.col("latitude"), F.col("longitude")).alias("there"))
    shown = e.filter("there AND NOT synthetic")
    confirmed = F.coalesce(F.col("state").isin("confirmed", "corrected"), F.lit(False))
    modes = F.array(F.struct(F.lit("all").alias("mode"), F.lit(True).alias("in")), F.struct(F.lit("confirmed").alias("mode"), confirmed.alias("in")), F.struct(F.lit("unconfirmed").alias("mode"), (~confirmed).alias("in")))
    return shown.select(F.explode(modes).alias("m")).groupBy("m.mode").agg(F.sum(F.col("m.in").cast("long")).alias("n"), F.count("*").alias("n_mappable"))


def exported_names(spark, sf):
    """Names of exported photos of errors and purchases, and how many events share one: those of one second collide."""
    e = table(spark, sf, "events").filter("event_type IN ('error', 'purchase')").select("event_id", so.feedback_name(F.col("ts"), F.col("event_type"), F.lit("confirmed")).alias("name"))
    sizes = e.groupBy("name").agg(F.count("*").alias("n_named"))
    return e.join(sizes, "name").select("event_id", "name", "n_named")


QUERIES = {f.__name__: f for f in (leak_report, audit_leakage, crossclass_near, fetch_dedup, survivors_provenance, attribution_summary, license_breakdown, photographer_credits, group_provenance, worklist_feedback, pending_uploads, batch_merge, media_credits, committed_names, shape_gate, map_filters, exported_names)}

_TWO = f"{simhash.SQL}, hd AS (SELECT doc_id, source, CASE WHEN text <> '' THEN sha256(text) END AS digest, level, step, min(doc_id) FILTER (level IS NOT NULL) OVER (PARTITION BY level, step) AS rep FROM documents LEFT JOIN hb USING (doc_id))"
_CLOSE = f"bit_count(xor(a.level, b.level)) <= {NEAR_BITS} AND bit_count(xor(a.step, b.step)) <= {NEAR_BITS}"
#: cf(u, v): representatives that are near, both ways round.
_TWO = f"""{_TWO}, rp AS (SELECT DISTINCT rep, level, step FROM hd WHERE level IS NOT NULL), cp AS (SELECT a.rep AS u, b.rep AS v FROM rp a JOIN rp b ON {_CLOSE}), {simhash.confirm_sql("cp")}"""
_CONFIRM_HELD = simhash.confirm_sql("ch", "nh")
_CONFIRM_FREE = simhash.confirm_sql("cl", "nl")
_MF = """mf AS (SELECT doc_id AS ord, doc_id % 2 AS file_no, nullif(doc_id // 4, 0) AS observation_id, 'img_' || doc_id || '.jpg' AS name, nullif(['cc0', 'cc-by', 'cc-by-nc', 'cc-by', ''][doc_id % 5 + 1], '') AS license,
  CASE WHEN doc_id % 3 = 0 THEN source END AS photographer_name, CASE WHEN doc_id % 3 = 1 THEN 'login_' || lang END AS photographer_login, CASE WHEN doc_id % 7 <> 2 THEN 'by ' || source END AS attribution FROM documents WHERE doc_id % 11 <> 4)"""
_JN = f"""{_MF}, fp AS (SELECT * FROM mf WHERE observation_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY file_no, ord) = 1),
jn AS (SELECT d.doc_id, d.doc_id // 4 AS observation_id, fp.ord IS NOT NULL AS found, coalesce(license, 'unknown') AS license, coalesce(photographer_name, photographer_login, attribution, 'Unknown') AS photographer FROM documents d LEFT JOIN fp ON fp.observation_id = d.doc_id // 4 WHERE n_chars >= 64)"""


def _entries_sql() -> str:
    from loamline.plans.triage import _ENTRIES

    return _ENTRIES


_MARKS = "['http://creativecommons.org/licenses/by/4.0/legalcode', '', 'http://creativecommons.org/licenses/by-nc/4.0/', 'CC0_1_0', 'https://creativecommons.org/publicdomain/zero/1.0/']"
_LIC = "CASE WHEN lower({x}) LIKE '%creativecommons.org/publicdomain/zero/1.0%' OR lower({x}) LIKE '%cc0_1_0%' THEN 'CC0_1_0' WHEN lower({x}) LIKE '%creativecommons.org/licenses/by/4.0%' OR lower({x}) LIKE '%cc_by_4_0%' THEN 'CC_BY_4_0' END"
ORACLES = {
    "leak_report": f"WITH {_TWO}, s AS (SELECT * FROM hd WHERE doc_id % 3 = 0), r AS (SELECT *, row_number() OVER (ORDER BY doc_id % 3 = 2, doc_id) AS ord, CASE WHEN doc_id % 3 = 1 THEN 'held_out:' ELSE 'pool:' END || doc_id AS origin FROM hd WHERE doc_id % 3 <> 0), e AS (SELECT s.doc_id, arg_min(origin, ord) AS o FROM s JOIN r USING (digest) GROUP BY 1), n AS (SELECT a.doc_id, arg_min(b.origin, b.ord) AS o FROM s a JOIN cf ON cf.u = a.rep JOIN r b ON b.rep = cf.v GROUP BY 1) SELECT coalesce(e.doc_id, n.doc_id) AS doc_id, CASE WHEN e.o IS NOT NULL THEN 'exact' ELSE 'near' END AS kind, coalesce(e.o, n.o) AS origin FROM e FULL JOIN n ON e.doc_id = n.doc_id",
    "audit_leakage": f"WITH {_TWO}, e AS (SELECT t.doc_id, min(r.doc_id) AS o FROM hd t JOIN hd r USING (digest) WHERE t.doc_id % 10 = 0 AND r.doc_id % 10 <> 0 GROUP BY 1), n AS (SELECT a.doc_id, min(b.doc_id) AS o FROM hd a JOIN cf ON cf.u = a.rep JOIN hd b ON b.rep = cf.v WHERE a.doc_id % 10 = 0 AND b.doc_id % 10 <> 0 AND a.doc_id NOT IN (SELECT doc_id FROM e) GROUP BY 1), f AS (SELECT 'exact' AS kind, * FROM e UNION ALL SELECT 'near', * FROM n) SELECT kind, count(*) AS n, sum((x.source = y.source)::INTEGER)::BIGINT AS n_same_source FROM f JOIN hd x ON x.doc_id = f.doc_id JOIN hd y ON y.doc_id = f.o GROUP BY 1",
    "crossclass_near": f"WITH {_TWO} SELECT a.doc_id, a.source, max(b.doc_id) AS partner FROM hd a JOIN cf ON cf.u = a.rep JOIN hd b ON b.rep = cf.v AND a.source <> b.source GROUP BY 1, 2",
    "fetch_dedup": f"WITH RECURSIVE {simhash.SQL}, fc AS (SELECT doc_id % 3 = 1 AS held, level, min(doc_id) AS rep FROM hb GROUP BY 1, 2), ch AS (SELECT a.rep AS u, b.rep AS v FROM fc a JOIN fc b ON NOT a.held AND b.held AND bit_count(xor(a.level, b.level)) <= {FETCH_BITS}), {_CONFIRM_HELD}, c AS (SELECT rep AS doc_id, level FROM fc WHERE NOT held AND rep NOT IN (SELECT u FROM nh)), cl AS (SELECT a.doc_id AS u, b.doc_id AS v FROM c a JOIN c b ON a.doc_id < b.doc_id AND bit_count(xor(a.level, b.level)) <= {NEAR_BITS}), {_CONFIRM_FREE}, l AS (SELECT v, list(u) AS us, row_number() OVER (ORDER BY v) AS i FROM nl GROUP BY 1), wk(i, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT l.i, CASE WHEN len(list_filter(us, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, v) ELSE gone END FROM wk JOIN l ON l.i = wk.i + 1) SELECT doc_id FROM c WHERE NOT list_contains((SELECT arg_max(gone, i) FROM wk), doc_id)",
    "survivors_provenance": f"WITH {_MF} SELECT doc_id, 'img_' || doc_id || '.jpg' AS name, mf.license, mf.observation_id FROM documents LEFT JOIN mf ON mf.name = 'img_' || doc_id || '.jpg' WHERE n_chars >= 64",
    "attribution_summary": f"WITH {_JN} SELECT count(*) AS n_pool, count(*) FILTER (NOT found) AS n_unprovenanced, count(DISTINCT observation_id) FILTER (found) AS n_observations, count(DISTINCT photographer) FILTER (found) AS n_photographers, bool_or(found AND license = 'cc-by-nc') AS noncommercial FROM jn",
    "license_breakdown": f"WITH {_JN} SELECT license, count(*) AS n, count(DISTINCT observation_id) AS n_observations FROM jn WHERE found GROUP BY 1",
    "photographer_credits": f"WITH {_JN}, u AS (SELECT DISTINCT photographer, license, observation_id FROM jn WHERE found), r AS (SELECT *, row_number() OVER (PARTITION BY photographer, license ORDER BY observation_id) AS i FROM u) SELECT photographer, license, count(*) AS n, string_agg(observation_id::VARCHAR, ', ' ORDER BY observation_id) FILTER (i <= 8) AS ids, CASE WHEN count(*) > 8 THEN '+' || (count(*) - 8) || ' more' ELSE '' END AS more FROM r GROUP BY 1, 2",
    "group_provenance": f"WITH {_MF}, o AS (SELECT 'img_' || doc_id || '.jpg' AS name, 'old_' || doc_id AS older FROM labels WHERE quality = 1) SELECT doc_id, coalesce('obs_' || mf.observation_id, older, regexp_replace(d.source, '(_?([0-9]+|test))+$', '')) AS grp FROM documents d LEFT JOIN mf ON mf.name = 'img_' || d.doc_id || '.jpg' LEFT JOIN o ON o.name = 'img_' || d.doc_id || '.jpg'",
    "worklist_feedback": f"WITH {_entries_sql()}, raw AS (SELECT doc_id, filename, ['confirmed', 'corrected', 'discarded', 'Confirmed', 'none', 'corrected ', 'confirmed', 'liked', 'synthetic_confirmed', 'corrected', 'confirmed'][doc_id % 11 + 1] AS status, corrected FROM g1), w AS (SELECT doc_id, 'shot ' || substr(md5(coalesce(text, '')), 1, 12) || '.jpg' AS filename FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL) ORDER BY n_chars DESC, doc_id LIMIT 100), f AS (SELECT filename, arg_min(status, doc_id) AS status, arg_min(corrected, doc_id) AS corrected FROM raw GROUP BY 1) SELECT doc_id, w.filename, status, corrected FROM w LEFT JOIN f USING (filename)",
    "pending_uploads": f"WITH {_entries_sql()} SELECT doc_id, filename, regexp_replace(filename, '[^A-Za-z0-9_.-]+', '_', 'g') AS sent_as FROM g1 WHERE filename <> '' AND filename NOT IN (SELECT filename FROM g1 WHERE doc_id % 3 = 0)",
    "batch_merge": f"WITH {_entries_sql()} SELECT doc_id, filename, FALSE AS fresh FROM g1 WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, filename, TRUE FROM g1 WHERE doc_id % 4 <> 0 AND filename NOT IN (SELECT filename FROM g1 WHERE doc_id % 4 = 0)",
    "media_credits": f"""WITH m AS (SELECT doc_id AS occurrence_id, k, ['StillImage', 'Sound', NULL][(doc_id + k) % 3 + 1] AS type, (doc_id + k) % 7 <> 0 AS has, {_MARKS}[(doc_id + 2 * k) % 5 + 1] AS lic, {_MARKS}[doc_id % 5 + 1] AS olic, CASE WHEN (doc_id + k) % 4 = 0 THEN source END AS holder, CASE WHEN (doc_id + k) % 4 = 1 THEN 'c_' || lang END AS creator,
      CASE WHEN doc_id % 5 = 0 THEN 'holder' END AS oh, CASE WHEN doc_id % 2 = 0 THEN lang END AS rec, CASE WHEN doc_id % 5 < 3 THEN '2021-06-14' END AS day FROM documents CROSS JOIN (SELECT unnest(range(3)) AS k)),
      s AS (SELECT *, row_number() OVER (PARTITION BY occurrence_id ORDER BY k) - 1 AS pos, CASE WHEN lic <> '' THEN {_LIC.format(x="lic")} ELSE {_LIC.format(x="olic")} END AS code FROM m WHERE coalesce(type, 'StillImage') = 'StillImage' AND has)
      SELECT occurrence_id, pos::INTEGER AS pos, code, day, '© ' || coalesce(holder, oh, creator, rec, 'unknown') || ', licensed ' || CASE code WHEN 'CC0_1_0' THEN 'CC0-1.0' ELSE 'CC-BY-4.0' END || ' (via GBIF, occurrence ' || occurrence_id || ')' AS credit FROM s WHERE code IS NOT NULL""",
    "committed_names": "WITH t AS (SELECT lang, max(doc_id % 100) AS most FROM documents WHERE doc_id % 6 = 0 GROUP BY 1) SELECT doc_id, 'qa_gbif_v2_1_' || lang || '_' || printf('%04d', coalesce(most + 1, 0) + row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) || CASE WHEN doc_id % 2 = 0 THEN '.jpg' ELSE '.png' END AS name FROM documents LEFT JOIN t USING (lang) WHERE doc_id % 6 <> 0",
    "shape_gate": f"WITH s AS (SELECT doc_id, text, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))::BIGINT AS w, len(string_split(text, chr(10)))::BIGINT AS h, len(list_distinct(string_split(text, ''))) / nullif(length(text), 0) AS spread FROM documents) SELECT doc_id, w, h, CASE WHEN coalesce(text, '') = '' THEN 'corrupt' WHEN least(w, h) < {LEAST_SIDE} THEN 'low_resolution' WHEN w / h < {ASPECTS[0]} OR w / h > {ASPECTS[1]} THEN 'bad_aspect' WHEN spread < {LEAST_SPREAD} THEN 'flat' END AS reason, coalesce(w * h > {MOST_AREA}, FALSE) AS oversized FROM s",
    "map_filters": f"WITH {_entries_sql()}, s AS (SELECT st IN ('confirmed', 'corrected') AS c FROM g1 WHERE NOT synthetic AND (lat <> 0 OR lng <> 0) AND abs(lat) <= 90) SELECT mode, CASE mode WHEN 'all' THEN count(*) WHEN 'confirmed' THEN count(*) FILTER (c) ELSE count(*) FILTER (NOT c) END AS n, count(*) AS n_mappable FROM s CROSS JOIN (VALUES ('all'), ('confirmed'), ('unconfirmed')) v(mode) GROUP BY mode",
    "exported_names": "WITH x AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H-%M-%SZ') || '_' || event_type || '_confirmed.jpg' AS name FROM events WHERE event_type IN ('error', 'purchase')) SELECT event_id, name, count(*) OVER (PARTITION BY name) AS n_named FROM x",
}
