"""Manifests of all shapes, class folders and saved search pages, written from the tables and read back, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.operators import ranks
from loamline.sources import folders, paged, variants
from loamline.sources.tables import table
from loamline.streaming.event_streams import shared

#: Entries of a manifest document, results of a page; folders that are classes, and one that is never scanned.
BLOCK, PAGE = 100, 50
CLASSES, HELD_OUT, FIRST = ["de", "en", "fr"], "Testing", 5


def _blocks(rows, entry):
    """(block, items): JSON texts of ``entry`` in order of ``doc_id``, ``BLOCK`` ids together."""
    g = rows.select(F.lpad(F.floor(F.col("doc_id") / BLOCK).cast("string"), 12, "0").alias("block"), F.struct("doc_id", entry.alias("e")).alias("s")).groupBy("block")
    return g.agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["e"]), ",\n ").alias("items"))


def manifest_shapes(spark, sf):
    """Documents as manifests of four shapes, some broken, read back without a schema: lines beat entries, those a bare list, that a flat map."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", F.concat(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 5), F.lit(".jpg")).alias("name"))
    at = {k: shared(spark, f"shapes-{k}") for k in ("lines", "entries", "list", "map")}
    own = lambda k: d.filter(F.col("doc_id") % 4 == k)
    row = F.to_json(F.struct(F.concat(F.lit("a/"), "name").alias("path"), F.col("lang").alias("class"), F.floor(F.col("doc_id") / 12).alias("observation_id"), F.col("doc_id").alias("line")))
    own(0).select(F.when(F.col("doc_id") % 13 == 5, F.concat(F.substring(row, 1, 20), F.lit("..."))).when(F.col("doc_id") % 17 == 5, "").otherwise(row)).write.text(at["lines"])
    entry = F.to_json(F.struct(F.concat(F.lit("b/"), "name").alias("filename"), F.col("lang").alias("cls"), F.lit("").alias("license"), F.concat(F.lit("http://x/"), "source").alias("image_url"), F.col("doc_id").alias("occurrence_id")))
    listed = _blocks(own(1), entry)
    # Every seventh document ends too early.
    tail = F.when(F.col("block").cast("long") % 7 == 3, "").otherwise("]}")
    listed.select("block", F.concat(F.lit('{"version": 1, "entries": [\n '), "items", tail)).write.partitionBy("block").text(at["entries"])
    bare = _blocks(own(2), F.to_json(F.struct(F.concat(F.lit("c/"), "name").alias("file"), "source", F.col("source").alias("attribution"))))
    bare.select("block", F.concat(F.lit("["), "items", F.lit("]"))).write.partitionBy("block").text(at["list"])
    flat = F.concat(F.lit('"d'), F.col("doc_id").cast("string"), F.lit("/"), "name", F.lit('": '), F.when(F.col("doc_id") % 11 == 0, "7").otherwise(F.to_json(F.struct(F.lit("cc0").alias("license"), F.col("doc_id").alias("obs_id")))))
    _blocks(own(3), flat).select("block", F.concat(F.lit("{"), "items", F.lit("}"))).write.partitionBy("block").text(at["map"])

    blobs = [variants.normalized(variants.entries(variants.documents(spark, at[k]))) for k in ("entries", "list", "map")]
    return variants.provenance(variants.normalized(variants.lines(spark, at["lines"], "line")), *blobs)


def _class_folders(spark, sf, contents=True):
    """Documents as files in folders of their language, with all that a scan has to pass over or report; the listing of what lies there."""
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    folder = F.when(i % 37 == 8, ".cache").when(i % 41 == 9, HELD_OUT).when(i % 43 == 10, "unsorted").otherwise(F.col("lang"))
    number = F.lpad(i.cast("string"), 9, "0")
    name = F.when(i % 17 == 3, F.concat(F.lit("."), number, F.lit(".jpg"))).when(i % 19 == 4, F.concat(number, F.lit(".txt"))).when(i % 23 == 5, F.concat(F.lit("sub/"), number, F.lit(".jpg"))).otherwise(F.concat(number, F.lit(".PNG")))
    content = F.when(i % 29 == 6, F.lit(b"")).when(i % 31 == 7, F.concat("raw", F.lit(b"\xff"))).otherwise(F.col("raw"))
    root = shared(spark, "folders")
    folders.write_files(d.select(F.concat_ws("/", folder, name).alias("path"), content.alias("content")), root)
    return folders.listing(spark, root, (HELD_OUT,), contents)


def folder_scan(spark, sf):
    """Each folder of a scan: whether it is a class, its files, what is passed over, what can't be read, and its bytes."""
    return folders.split_scan(_class_folders(spark, sf), CLASSES)


def folder_first_files(spark, sf):
    """The first files of each folder by name, and their sizes."""
    return folders.first_files(_class_folders(spark, sf, contents=False), FIRST)


def saved_pages(spark, sf):
    """Rows of saved search pages, one query for each host: some pages are broken and give none."""
    p = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("query"), F.length("html").alias("n_chars"))
    placed = ranks.numbered(p, "query", "page_id").withColumn("offset", F.floor(F.col("before") / PAGE) * PAGE)
    results = F.transform(F.sort_array(F.collect_list(F.struct("before", "page_id", "url", "n_chars"))), lambda r: F.struct(r["page_id"].alias("id"), r["url"].alias("url"), r["n_chars"].alias("n_chars")))
    pages = placed.groupBy("query", "offset").agg(F.max("total").alias("count"), results.alias("results"))
    whole = F.to_json(F.struct("offset", F.lit(PAGE).alias("limit"), (F.col("offset") + PAGE >= F.col("count")).alias("endOfRecords"), "count", "results"))
    broken = (F.col("offset") > 0) & (F.length("query") % 5 == 0)
    root = shared(spark, "search")
    folders.write_files(pages.select(F.concat("query", F.lit("/"), F.col("offset").cast("string"), F.lit(".json")).alias("path"), F.when(broken, F.substring(whole, 1, 40)).otherwise(whole).alias("content")), root)
    return paged.read_pages(spark, root, "query string, place long, id long, url string, n_chars long")


QUERIES = {f.__name__: f for f in (manifest_shapes, folder_scan, folder_first_files, saved_pages)}

_NAME = "substr(md5(coalesce(text, '')), 1, 5) || '.jpg' AS name"
_FILES = f"""fd AS (SELECT doc_id AS i, CASE WHEN doc_id % 37 = 8 THEN '.cache' WHEN doc_id % 41 = 9 THEN '{HELD_OUT}' WHEN doc_id % 43 = 10 THEN 'unsorted' ELSE lang END AS folder,
  CASE WHEN doc_id % 17 = 3 THEN 'dot' WHEN doc_id % 19 = 4 THEN 'txt' WHEN doc_id % 23 = 5 THEN 'sub' ELSE 'ok' END AS kind,
  CASE WHEN doc_id % 29 = 6 THEN 0 WHEN doc_id % 31 = 7 THEN strlen(coalesce(text, '')) + 1 ELSE strlen(coalesce(text, '')) END AS n, doc_id % 29 = 6 OR doc_id % 31 = 7 OR coalesce(text, '') = '' AS bad FROM documents),
fl AS (SELECT * FROM fd WHERE folder NOT IN ('.cache', '{HELD_OUT}'))"""
ORACLES = {
    "manifest_shapes": f"""WITH d AS (SELECT doc_id, lang, source, doc_id // {BLOCK} AS block, {_NAME} FROM documents),
      u AS (SELECT 0 AS rank, -doc_id AS o, name, lang AS cls, NULL AS source, NULL AS license, NULL AS attribution, NULL AS url, nullif(doc_id // 12, 0)::VARCHAR AS observation_id FROM d WHERE doc_id % 4 = 0 AND doc_id % 13 <> 5 AND doc_id % 17 <> 5
        UNION ALL SELECT 1, doc_id, name, lang, NULL, NULL, NULL, 'http://x/' || source, doc_id::VARCHAR FROM d WHERE doc_id % 4 = 1 AND block % 7 <> 3
        UNION ALL SELECT 2, doc_id, name, NULL, source, NULL, source, NULL, NULL FROM d WHERE doc_id % 4 = 2
        UNION ALL SELECT 3, doc_id, name, NULL, NULL, 'cc0', NULL, NULL, doc_id::VARCHAR FROM d WHERE doc_id % 4 = 3 AND doc_id % 11 <> 0)
      SELECT name, cls, source, license, attribution, url, observation_id, rank FROM u QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank, o) = 1""",
    "folder_scan": f"WITH {_FILES} SELECT folder, folder IN ('de', 'en', 'fr') AS known, count(*) FILTER (kind = 'ok') AS n_files, count(*) FILTER (kind <> 'ok') AS n_passed, count(*) FILTER (kind = 'ok' AND bad) AS n_corrupt, coalesce(sum(n) FILTER (kind = 'ok'), 0)::BIGINT AS n_bytes FROM fl GROUP BY 1",
    "folder_first_files": f"WITH {_FILES} SELECT folder, lpad(i::VARCHAR, 9, '0') || '.PNG' AS name, n::BIGINT AS length FROM fl WHERE kind = 'ok' QUALIFY row_number() OVER (PARTITION BY folder ORDER BY i) <= {FIRST}",
    "saved_pages": f"WITH p AS (SELECT page_id, url, length(html) AS n_chars, regexp_extract(url, '^https?://([^/?#]+)', 1) AS query FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY page_id) - 1 AS place FROM p) SELECT query, place, page_id AS id, url, n_chars FROM r WHERE NOT (place >= {PAGE} AND length(query) % 5 = 0)",
}
