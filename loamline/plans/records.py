"""Readers, sinks, listings, quotas and display columns over the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamline.functions import decisions as d
from loamline.functions import feedback as fb
from loamline.operators import metrics as m
from loamline.operators import ranks
from loamline.operators.lineage import written
from loamline.operators.selection import percentiles
from loamline.plans.evaluation import CLS, PERTURBATIONS, _perturbed
from loamline.plans.predictions import SQL, predictions
from loamline.plans.triage import feedback_entries
from loamline.sources import index, manifests, sinks
from loamline.sources.tables import events, table
from loamline.streaming.event_streams import BATCH_FILES, shared
from loamline.streaming.keyed_state import accept_once

# Class names, the bands of blur and confidence, and what is shown for an alert, an uncertain row and any other.
CLASSES = ("poison_ivy", "poison_oak", "poison_sumac", "safe_plants")
BLUR_BANDS, COLOUR_BANDS = (100, 500), (0.50, 0.70)
HEADLINES = ("Likely ", "Possible ", "")
SUBTITLES = ("% match · always verify before touching", "Low confidence · verify visually before touching", "Verify visually before touching")


def manifest_files(spark, sf):
    """Documents and pages as manifest files with broken lines, read back tolerantly and reconciled; lines beat the older entries."""
    lines, entries = shared(spark, "manifest-lines"), shared(spark, "manifest-entries")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    row = F.to_json(F.struct(F.concat(F.lit("docs/"), F.substring("h", 1, 6), F.lit(".txt")).alias("path"), F.col("lang").alias("class"), F.nullif(F.floor(F.col("doc_id") / 3), F.lit(0)).alias("observation_id"), F.col("doc_id").alias("line")))
    docs.select(F.when(F.col("doc_id") % 13 == 5, F.concat(F.substring(row, 1, 20), F.lit("..."))).when(F.col("doc_id") % 17 == 5, "").otherwise(row).alias("value")).write.text(lines)
    old = docs.select(F.concat(F.lit("old/"), F.substring("h", 1, 6), F.lit(".txt")).alias("file"), F.lit("cc0").alias("license"), F.concat(F.lit("http://x/"), "source").alias("image_url"), F.col("doc_id").alias("occurrence_id"), F.col("doc_id").alias("line"))
    old.filter("line % 2 = 0").write.json(entries)
    first = manifests.read_lines(spark, lines, "path string, class string, observation_id long, line long")
    second = manifests.read_lines(spark, entries, "file string, license string, image_url string, occurrence_id long, line long")
    return manifests.by_priority(first, second, ordinal="line").select("name", "path", "cls", "license", "url", "observation_id", "n_rows")


def keyed_merge(spark, sf):
    """A manifest after later rows are merged into it, by name: the last fresh row of a name replaces the old one; done twice, it stays so."""
    path = shared(spark, "keyed")
    rows = table(spark, sf, "documents").select(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 4).alias("name"), F.col("doc_id").alias("ord"), "source")
    old = rows.filter("ord % 2 = 0").groupBy("name").agg(F.max_by(F.struct("ord", "source"), "ord").alias("s")).select("name", "s.*")
    fresh = rows.filter("ord % 2 = 1")
    sinks.merged(old, fresh, "name", "ord").write.json(path)
    again = manifests.read_lines(spark, path, "name string, ord long, source string")
    return sinks.merged(again, fresh, "name", "ord")


def append_observations(spark, sf):
    """Rows that an append-only manifest holds after two batches: those without an observation aren't written."""
    path = shared(spark, "appended")
    rows = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") % 4 != 0, F.concat(F.lit("obs_"), F.floor(F.col("doc_id") / 5).cast("string"))).alias("observation_id"))
    for batch in (rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1")):
        sinks.append_rows(batch, path, "observation_id")
    return manifests.read_lines(spark, path, "doc_id long, observation_id string")


def commit_without_overwrite(spark, sf):
    """What stands under each name after two commits: a name that is there already isn't written again."""
    path = shared(spark, "pool")
    rows = table(spark, sf, "documents").groupBy(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 3).alias("name"), (F.col("doc_id") % 2).alias("batch")).agg(F.min("doc_id").alias("doc_id"))
    rows.filter("batch = 0").select("name", "doc_id").write.parquet(path)
    sinks.commit(rows.filter("batch = 1").select("name", "doc_id"), path, "name")
    return spark.read.parquet(path)


def upload_ledger(spark, sf, folder=None):
    """Names accepted from a stream of uploads, each once, with the first id and the last, whose image replaces the earlier ones."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", BATCH_FILES).parquet(f"{sf}/documents.parque[t]")
    named = stream.select(F.concat(F.lit("up_"), F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 12)).alias("filename"), "doc_id")
    return accept_once(named, folder or shared(spark, "ledger"))


def hash_index_refresh(spark, sf):
    """An index of digests after a new listing: reused where time and size are as before, made anew otherwise, gone files pruned."""
    d, home = table(spark, sf, "documents"), shared(spark, "hash-index")
    listed = lambda rows, less: rows.select(F.col("doc_id").alias("path"), (F.col("n_chars") % 7 - less).alias("mtime"), F.octet_length("text").alias("size"), "text")
    touched = F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    index.refresh(listed(d.filter("doc_id % 4 <> 1"), touched), home, "path", ["mtime", "size"], "digest", lambda: F.concat(F.lit("old_"), F.col("path").cast("string")))
    now, _ = index.refresh(listed(d.filter("doc_id % 11 <> 7"), F.lit(0)), home, "path", ["mtime", "size"], "digest", lambda: F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return now.select(F.col("path").alias("doc_id"), "digest", "reused")


def frame_listing(spark, sf):
    """Frames by number (six digits or more), class and blur as their file names tell, the newest first; names without blur have 0, the last ``_b`` counts."""
    e = events(spark, sf)
    blur = F.when(F.col("event_id") % 3 == 0, F.lit("")).when(F.col("event_id") % 7 == 0, "_bx").otherwise(F.concat(F.lit("_b"), F.floor("value").cast("string")))
    kind = F.when(F.col("event_id") % 5 == 0, F.concat("event_type", F.lit("_b12_leaf"))).otherwise(F.col("event_type"))
    names = e.select("event_id", F.concat(F.format_string("%06d", "event_id"), F.lit("_"), kind, blur, F.lit(".jpg")).alias("filename"))
    stem = F.regexp_replace("filename", r"\.jpg$", "")
    rest = F.regexp_replace(stem, r"^[0-9]+_", "")
    tail = F.regexp_extract(rest, r"^.*_b(.*)$", 1).try_cast("double")
    own = names.select("filename", F.regexp_extract("filename", r"^([0-9]+)_", 1).try_cast("long").alias("idx"), F.when(tail.isNotNull(), F.regexp_extract(rest, r"^(.*)_b.*$", 1)).otherwise(rest).alias("cls"), F.coalesce(tail, F.lit(0.0)).alias("blur")).filter("idx IS NOT NULL")
    band = F.when(F.col("blur") < BLUR_BANDS[0], "Blurry").when(F.col("blur") < BLUR_BANDS[1], "OK").otherwise("Sharp")
    return own.withColumn("band", band).orderBy(F.desc("idx"))


def resume_counters(spark, sf):
    """The next free number of each class of frames: one more than the highest, 0 for a class without numbers."""
    f = frame_listing(spark, sf).select("cls", "idx")
    every = events(spark, sf).select(F.col("event_type").alias("cls")).distinct().union(spark.createDataFrame([("none_yet",)], "cls string"))
    return every.join(f, "cls", "left").groupBy("cls").agg(F.coalesce(F.max("idx") + 1, F.lit(0).cast("long")).alias("next"))


def session_listing(spark, sf):
    """Sessions (a user's day), local and synced copies together: the bytes of both, how many places hold it, the newest first."""
    e = events(spark, sf).select(F.concat(F.lit("s"), F.floor(F.col("t") / 86_400_000_000).cast("string"), F.lit("_"), F.col("user_id").cast("string")).alias("session"), F.octet_length("props").cast("long").alias("n_bytes"), "event_id")
    local, synced = e.filter("event_id % 3 <> 0"), e.filter("event_id % 4 <> 0")
    both = local.withColumn("synced", F.lit(0)).unionByName(synced.withColumn("synced", F.lit(1)))
    return both.groupBy("session").agg(F.sum("n_bytes").alias("n_bytes"), F.countDistinct("synced").alias("n_places"), (F.max("synced") == 1).alias("is_synced")).orderBy(F.desc("session"))


def tta_average(spark, sf):
    """Mean confidence of each row and class over a clean and a flattened pass; a class that only one pass reports has that one's."""
    p = _perturbed(spark, sf).filter("name IN ('clean', 'flat')").select("vec_id", F.posexplode("probs").alias("cls", "p")).filter("p >= 0.05")
    return p.groupBy("vec_id", "cls").agg(F.round(F.avg("p"), 6).alias("confidence"), F.count("*").alias("n_passes"))


def url_quota(spark, sf, target: int = 120):
    """Addresses of a class from several hosts: of each the first by its share of the target and ten more, each address once, trimmed to the target."""
    p = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"))
    first = p.groupBy("host", "url").agg(F.min("page_id").alias("page_id"))
    sizes = p.groupBy("host").agg(F.count("*").alias("n"))
    quota = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("total")))).select("host", (F.floor(F.lit(target) * F.col("n") / F.col("total")) + 10).alias("quota"))
    own = ranks.numbered(first, "host", "page_id").join(F.broadcast(quota), "host").filter("before < quota")
    return own.groupBy("url").agg(F.min(F.struct("host", "page_id")).alias("s")).select("s.host", "s.page_id", "url").orderBy("host", "page_id").limit(target)


def display_rows(spark, sf):
    """What the app shows of each prediction: hedged headline and line, cut percent, colour band, and the time of its number as minutes and seconds."""
    p = predictions(spark, sf)
    name = F.initcap(F.replace(F.get(F.array(*map(F.lit, CLASSES)), "pred"), F.lit("_"), F.lit(" ")))
    sev = F.when(d.emitted(F.col("probs")), d.severity(F.col("conf"), d.alert_threshold(F.col("pred")))).otherwise("ignore")
    percent = F.floor(F.col("conf") * 100).cast("string")
    by_severity = lambda alert, uncertain, other: F.when(sev == "alert", alert).when(sev == "uncertain", uncertain).otherwise(other)
    head = F.concat(by_severity(*map(F.lit, HEADLINES)), name)
    line = by_severity(F.concat(F.lit("~"), percent, F.lit(SUBTITLES[0])), *map(F.lit, SUBTITLES[1:]))
    colour = F.when(F.col("conf") < COLOUR_BANDS[0], "yellow").when(F.col("conf") < COLOUR_BANDS[1], "orange").otherwise("red")
    clock = F.format_string("%02d:%02d", F.floor(F.col("vec_id") / 60), F.col("vec_id") % 60)
    quoted = F.when(head.contains(",") | head.contains('"'), F.concat(F.lit('"'), F.replace(head, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(head)
    return p.select("vec_id", head.alias("headline"), line.alias("subtitle"), colour.alias("colour"), clock.alias("clock"), quoted.alias("csv"))


def size_stats(spark, sf):
    """Spread of document shapes by language: percentiles of the longest line, distinct shapes, and the share of extreme aspects."""
    lines = F.split("text", "\\n")
    s = table(spark, sf, "documents").filter("text <> ''").select("lang", F.array_max(F.transform(lines, F.length)).alias("w"), F.size(lines).alias("h"))
    aspect = F.col("w") / F.col("h")
    s = written(s)
    places = percentiles(s, ["lang"], "w", {"p10": 0.1, "median": 0.5, "p90": 0.9}).withColumnsRenamed({"lang": "l"})
    g = s.groupBy("lang").agg(F.min("w").alias("least"), F.max("w").alias("most"), F.countDistinct("w", "h").alias("n_shapes"), F.round(F.avg(((aspect > 2) | (aspect < 0.5)).cast("int")), 6).alias("extreme"))
    j = g.join(places, F.col("lang").eqNullSafe(F.col("l")))
    return j.select(*g.columns, *(F.round(c, 6).alias(c) for c in ("p10", "median", "p90")))


def common_sizes(spark, sf):
    """The eight most common lengths of documents; of equally common ones the shorter first."""
    return table(spark, sf, "documents").groupBy("n_chars").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "n_chars").limit(8)


def folder_sizes(spark, sf):
    """Files and bytes of each source, and how many are too small to be real."""
    s = F.coalesce(F.octet_length("text"), F.lit(0))
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(s).alias("n_bytes"), F.sum((s < 1000).cast("long")).alias("n_tiny"))


def soft_labels(spark, sf):
    """Labelled documents with the softened label of their class; a class without one is an error."""
    soft = spark.createDataFrame([(0, [0.9, 0.1]), (1, [0.2, 0.8])], "quality int, soft array<double>")
    known = table(spark, sf, "labels").filter("quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    j = known.join(F.broadcast(soft), "quality", "left")
    return j.select("doc_id", F.when(F.col("soft").isNull(), F.raise_error(F.lit("a class has no soft label"))).otherwise(F.col("soft")[1]).alias("soft"))


def legacy_triage(spark, sf):
    """The older rules for feedback: confirmed and corrected rows only, no gate; copied, skipped or missing."""
    e = feedback_entries(spark, sf).select("doc_id", "filename", "original", "corrected", "status")
    label = F.when(F.col("status") == "confirmed", F.col("original")).when(F.col("status") == "corrected", F.col("corrected"))
    label = F.when(label == "not_a_plant", fb.SAFE).otherwise(label)
    files = table(spark, sf, "documents").filter("n_chars >= 64").select("doc_id", F.lit(True).alias("there"))
    j = e.join(files, "doc_id", "left").withColumn("label", label)
    outcome = F.when(~F.coalesce(F.col("label").isin(*fb.HARMFUL, fb.SAFE), F.lit(False)), "skipped").when(F.col("there").isNull(), "error").otherwise("copied")
    return j.select("doc_id", outcome.alias("outcome"), F.when(outcome == "copied", F.concat("label", F.lit("/feedback_"), "filename")).alias("target"))


def legacy_class_weights(spark, sf):
    """Inverse frequency weights of the classes that are there, numbered from 0, divided by their mean.

    There are as many weights as classes with rows; a number among them without rows counts as one row and is no error.
    """
    g = written(predictions(spark, sf).groupBy(F.col("pred").alias("cls")).agg(F.count("*").alias("n")))
    t = g.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    every = t.select("total", "classes", F.explode(F.sequence(F.lit(0), (F.col("classes") - 1).cast("int"))).alias("cls"))
    w = every.join(g, "cls", "left").select("cls", F.coalesce("n", F.lit(0)).alias("n"), (F.col("total") / (F.col("classes") * F.coalesce("n", F.lit(1)))).alias("w"))
    # Rows here are as many as classes.
    return w.crossJoin(F.broadcast(w.agg(F.avg("w").alias("mean")))).select("cls", "n", F.round(F.col("w") / F.col("mean"), 6).alias("weight"))


def calibration_report(spark, sf):
    """One row: accuracy, mean confidence and their gap, calibration errors, recall of harmful rows and misses."""
    p = predictions(spark, sf)
    own = p.agg(F.count("*").alias("n"), m.share(m.count_if(F.col("y") == F.col("pred")), F.count("*")).alias("accuracy"), F.round(F.avg("conf"), 6).alias("mean_conf"), m.share(m.count_if((F.col("y") < CLS - 1) & (F.col("pred") < CLS - 1)), m.count_if(F.col("y") < CLS - 1)).alias("toxic_recall"), m.count_if((F.col("y") < CLS - 1) & (F.col("pred") == CLS - 1)).alias("n_missed"))
    b = m.calibration_bins(p).filter("n > 0").agg(F.round(F.sum(F.col("gap") * F.col("n")) / F.sum("n"), 4).alias("ece"), F.round(F.max("gap"), 4).alias("mce"))
    return own.crossJoin(F.broadcast(b)).withColumn("conf_gap", F.round(F.col("mean_conf") - F.col("accuracy"), 6))


def baseline_comparison(spark, sf):
    """Accuracy of each perturbed set against the clean one; none where the baseline is no better than chance."""
    g = _perturbed(spark, sf).groupBy("name").agg(m.share(m.count_if(F.col("y") == F.col("pred")), F.count("*")).alias("accuracy"))
    base = g.filter("name = 'clean'").select(F.col("accuracy").alias("base"))
    return g.crossJoin(F.broadcast(base)).select("name", "accuracy", F.when(F.col("base") > 1 / CLS, F.round(F.col("accuracy") - F.col("base"), 6)).alias("gain"))


def verdict_rows(spark, sf):
    """A row for each frame: its class, severity and confidence, or no_detection where no harmful class beats the safe one."""
    p = predictions(spark, sf)
    seen = d.emitted(F.col("probs"))
    return p.select("vec_id", F.when(seen, F.get(F.array(*map(F.lit, CLASSES)), "pred")).otherwise("no_detection").alias("verdict"), F.when(seen, d.severity(F.col("conf"), d.alert_threshold(F.col("pred")))).alias("severity"), F.when(seen, F.round("conf", 6)).alias("confidence"))


def correction_options(spark, sf):
    """Labels that a user may choose instead of each prediction, in the classes' order."""
    p = predictions(spark, sf).groupBy("pred").agg(F.count("*").alias("n"))
    names = F.array(*map(F.lit, CLASSES))
    return p.select("pred", "n", F.array_join(F.filter(names, lambda c: c != F.get(names, "pred")), ",").alias("options"))


def pair_classes(spark, sf):
    """Documents of equal text by the sorted pair of their sources: pairs across sources, and within one."""
    g = table(spark, sf, "documents").groupBy(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"), "source").agg(F.count("*").alias("n"))
    x, y = g.select("h", F.col("source").alias("a"), F.col("n").alias("na")), g.select("h", F.col("source").alias("b"), F.col("n").alias("nb"))
    # Sources of one text are few, however many copies there are; copies are counted, not paired.
    j = x.join(y, "h").filter("a <= b")
    return j.groupBy("a", "b").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))).cast("long").alias("n")).filter("n > 0")


QUERIES = {f.__name__: f for f in (manifest_files, keyed_merge, append_observations, commit_without_overwrite, upload_ledger, hash_index_refresh, frame_listing, resume_counters, session_listing, tta_average, url_quota, display_rows, size_stats, common_sizes, folder_sizes, soft_labels, legacy_triage, legacy_class_weights, calibration_report, baseline_comparison, verdict_rows, correction_options, pair_classes)}

_FRAMES = """fr AS (SELECT event_id AS idx, event_type, printf('%06d', event_id) || '_' || event_type || CASE WHEN event_id % 5 = 0 THEN '_b12_leaf' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 7 = 0 THEN '_bx' ELSE '_b' || floor(value)::BIGINT END || '.jpg' AS filename, event_type || CASE WHEN event_id % 5 = 0 THEN '_b12_leaf' ELSE '' END || CASE WHEN event_id % 3 <> 0 AND event_id % 7 = 0 THEN '_bx' ELSE '' END AS cls, CASE WHEN event_id % 3 = 0 OR event_id % 7 = 0 THEN 0 ELSE floor(value) END AS blur FROM events)"""


def _sql_parts() -> tuple[str, str]:
    from loamline.plans import evaluation, triage

    return evaluation._PERT, triage._ENTRIES


_PERT, _ENTRIES = _sql_parts()
_NAMES = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"
_TITLES = "['Poison Ivy', 'Poison Oak', 'Poison Sumac', 'Safe Plants']"
_SEV = "CASE WHEN list_max(probs[1:3]) <= probs[4] THEN 'ignore' WHEN conf >= CASE pred WHEN 2 THEN 0.52::DOUBLE ELSE 0.4::DOUBLE END THEN 'alert' WHEN conf >= CASE pred WHEN 2 THEN 0.52::DOUBLE ELSE 0.4::DOUBLE END - 0.2::DOUBLE THEN 'uncertain' ELSE 'ignore' END"
ORACLES = {
    "manifest_files": "WITH h AS (SELECT doc_id, lang, source, substr(md5(coalesce(text, '')), 1, 6) || '.txt' AS name FROM documents), a AS (SELECT name, 'docs/' || name AS path, lang AS cls, NULL AS license, NULL AS url, nullif(doc_id // 3, 0)::VARCHAR AS observation_id, count(*) OVER (PARTITION BY name) AS n_rows FROM h WHERE doc_id % 13 <> 5 AND doc_id % 17 <> 5 QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id DESC) = 1), b AS (SELECT name, 'old/' || name AS path, NULL AS cls, 'cc0' AS license, 'http://x/' || source AS url, nullif(doc_id, 0)::VARCHAR AS observation_id, count(*) OVER (PARTITION BY name) AS n_rows FROM h WHERE doc_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id DESC) = 1) SELECT * FROM a UNION ALL SELECT * FROM b WHERE name NOT IN (SELECT name FROM a)",
    "keyed_merge": "WITH r AS (SELECT substr(md5(coalesce(text, '')), 1, 4) AS name, doc_id AS ord, source FROM documents) SELECT name, ord, source FROM r QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord % 2 DESC, ord DESC) = 1",
    "append_observations": "SELECT doc_id, 'obs_' || (doc_id // 5) AS observation_id FROM documents WHERE n_chars % 4 <> 0",
    "commit_without_overwrite": "WITH r AS (SELECT substr(md5(coalesce(text, '')), 1, 3) AS name, doc_id FROM documents) SELECT name, doc_id FROM r QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id % 2, doc_id) = 1",
    "upload_ledger": "SELECT 'up_' || substr(md5(coalesce(text, '')), 1, 12) AS filename, min(doc_id) AS doc_id, max(doc_id) AS last_id FROM documents GROUP BY 1",
    "hash_index_refresh": "SELECT doc_id, CASE WHEN doc_id % 4 <> 1 AND doc_id % 5 <> 0 AND text IS NOT NULL THEN 'old_' || doc_id ELSE md5(coalesce(text, '')) END AS digest, doc_id % 4 <> 1 AND doc_id % 5 <> 0 AND text IS NOT NULL AS reused FROM documents WHERE doc_id % 11 <> 7",
    "frame_listing": f"WITH {_FRAMES} SELECT filename, idx, cls, blur::DOUBLE AS blur, CASE WHEN blur < 100 THEN 'Blurry' WHEN blur < 500 THEN 'OK' ELSE 'Sharp' END AS band FROM fr",
    "resume_counters": f"WITH {_FRAMES}, c AS (SELECT DISTINCT event_type AS cls FROM events UNION ALL SELECT 'none_yet') SELECT c.cls, coalesce(max(idx) + 1, 0) AS next FROM c LEFT JOIN fr USING (cls) GROUP BY 1",
    "session_listing": "WITH e AS (SELECT 's' || (epoch_us(ts) // 86400000000) || '_' || user_id AS session, strlen(props) AS n, event_id FROM events), b AS (SELECT *, 0 AS synced FROM e WHERE event_id % 3 <> 0 UNION ALL SELECT *, 1 FROM e WHERE event_id % 4 <> 0) SELECT session, sum(n)::BIGINT AS n_bytes, count(DISTINCT synced) AS n_places, max(synced) = 1 AS is_synced FROM b GROUP BY 1",
    "tta_average": f"WITH {SQL}, {_PERT}, x AS (SELECT vec_id, (i - 1)::INTEGER AS cls, probs[i] AS p FROM pt CROSS JOIN (SELECT unnest(range(1, 5)) AS i) WHERE name IN ('clean', 'flat') AND probs[i] >= 0.05) SELECT vec_id, cls, round(avg(p), 6) AS confidence, count(*) AS n_passes FROM x GROUP BY 1, 2",
    "url_quota": "WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages), q AS (SELECT host, floor(120 * count(*) / (SELECT count(*) FROM pages)) + 10 AS quota FROM p GROUP BY 1), f AS (SELECT host, url, min(page_id) AS page_id FROM p GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS i FROM f) SELECT host, page_id, url FROM r JOIN q USING (host) WHERE i <= quota QUALIFY row_number() OVER (PARTITION BY url ORDER BY host, page_id) = 1 ORDER BY host, page_id LIMIT 120",
    "display_rows": f"WITH {SQL}, s AS (SELECT vec_id, conf, {_TITLES}[pred + 1] AS t, {_SEV} AS sev FROM pr), h AS (SELECT *, CASE sev WHEN 'alert' THEN '{HEADLINES[0]}' WHEN 'uncertain' THEN '{HEADLINES[1]}' ELSE '' END || t AS headline FROM s) SELECT vec_id, headline, CASE sev WHEN 'alert' THEN '~' || floor(conf * 100)::BIGINT || '{SUBTITLES[0]}' WHEN 'uncertain' THEN '{SUBTITLES[1]}' ELSE '{SUBTITLES[2]}' END AS subtitle, CASE WHEN conf < 0.5 THEN 'yellow' WHEN conf < 0.7 THEN 'orange' ELSE 'red' END AS colour, CASE WHEN vec_id // 60 < 10 THEN '0' ELSE '' END || (vec_id // 60) || ':' || lpad((vec_id % 60)::VARCHAR, 2, '0') AS clock, headline AS csv FROM h",
    "size_stats": "WITH s AS (SELECT lang, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS w, len(string_split(text, chr(10))) AS h FROM documents WHERE text <> '') SELECT lang, min(w)::INTEGER AS least, round(quantile_cont(w, 0.1), 6) AS p10, round(quantile_cont(w, 0.5), 6) AS median, round(quantile_cont(w, 0.9), 6) AS p90, max(w)::INTEGER AS most, count(DISTINCT (w, h)) AS n_shapes, round(avg((w / h > 2 OR w / h < 0.5)::INTEGER), 6) AS extreme FROM s GROUP BY 1",
    "common_sizes": "SELECT n_chars, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, n_chars LIMIT 8",
    "folder_sizes": "SELECT source, count(*) AS n, sum(coalesce(strlen(text), 0))::BIGINT AS n_bytes, count(*) FILTER (coalesce(strlen(text), 0) < 1000) AS n_tiny FROM documents GROUP BY 1",
    "soft_labels": "SELECT doc_id, CASE quality WHEN 1 THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END AS soft FROM labels WHERE quality IS NOT NULL",
    "legacy_triage": f"WITH {_ENTRIES}, raw AS (SELECT e.doc_id, CASE WHEN e.doc_id % 41 = 0 THEN ' ' ELSE e.filename END AS filename, original, corrected, ['confirmed', 'corrected', 'discarded', 'Confirmed', 'none', 'corrected ', 'confirmed', 'liked', 'synthetic_confirmed', 'corrected', 'confirmed'][e.doc_id % 11 + 1] AS status, n_chars >= 64 AS there FROM g1 e JOIN documents USING (doc_id)), l AS (SELECT *, CASE status WHEN 'confirmed' THEN original WHEN 'corrected' THEN corrected END AS l0 FROM raw), m AS (SELECT *, CASE l0 WHEN 'not_a_plant' THEN 'safe_plants' ELSE l0 END AS label FROM l), o AS (SELECT *, CASE WHEN label IS NULL OR label NOT IN ('poison_ivy', 'poison_oak', 'poison_sumac', 'safe_plants') THEN 'skipped' WHEN NOT there THEN 'error' ELSE 'copied' END AS outcome FROM m) SELECT doc_id, outcome, CASE WHEN outcome = 'copied' THEN label || '/feedback_' || filename END AS target FROM o",
    "legacy_class_weights": f"WITH {SQL}, g AS (SELECT pred, count(*) AS n FROM pr GROUP BY 1), k AS (SELECT count(*) AS k, sum(n) AS total FROM g), w AS (SELECT cls::INTEGER AS cls, coalesce(n, 0) AS n, total / (k * coalesce(n, 1)) AS w FROM (SELECT unnest(range(k)) AS cls, k, total FROM k) c LEFT JOIN g ON g.pred = c.cls) SELECT cls, n, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w",
    "calibration_report": f"WITH {SQL}, b AS (SELECT least(floor(round(conf * 10, 9)), 9) AS bin, count(*) AS n, round(abs(avg(conf) - avg((y = pred)::INTEGER)), 6) AS gap FROM pr GROUP BY 1), e AS (SELECT round(sum(gap * n) / sum(n), 4) AS ece, round(max(gap), 4) AS mce FROM b) SELECT count(*) AS n, round(avg((y = pred)::INTEGER), 6) AS accuracy, round(avg(conf), 6) AS mean_conf, round(count(*) FILTER (y < 3 AND pred < 3) / count(*) FILTER (y < 3), 6) AS toxic_recall, count(*) FILTER (y < 3 AND pred = 3) AS n_missed, any_value(ece) AS ece, any_value(mce) AS mce, round(round(avg(conf), 6) - round(avg((y = pred)::INTEGER), 6), 6) AS conf_gap FROM pr, e",
    "baseline_comparison": f"WITH {SQL}, {_PERT}, g AS (SELECT name, round(avg((y = pred)::INTEGER), 6) AS accuracy FROM pt GROUP BY 1) SELECT g.name, g.accuracy, CASE WHEN b.accuracy > 0.25 THEN round(g.accuracy - b.accuracy, 6) END AS gain FROM g, g b WHERE b.name = 'clean'",
    "verdict_rows": f"WITH {SQL}, s AS (SELECT vec_id, conf, {_NAMES}[pred + 1] AS t, list_max(probs[1:3]) > probs[4] AS seen, {_SEV} AS sev FROM pr) SELECT vec_id, CASE WHEN seen THEN t ELSE 'no_detection' END AS verdict, CASE WHEN seen THEN sev END AS severity, CASE WHEN seen THEN round(conf, 6) END AS confidence FROM s",
    "correction_options": f"WITH {SQL} SELECT pred, count(*) AS n, array_to_string(list_filter({_NAMES}, lambda c: c <> {_NAMES}[pred + 1]), ',') AS options FROM pr GROUP BY pred",
    "pair_classes": "WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), p AS (SELECT least(x.source, y.source) AS a, greatest(x.source, y.source) AS b FROM d x JOIN d y ON x.t = y.t AND x.doc_id < y.doc_id) SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2",
}
