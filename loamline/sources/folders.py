"""Class folders as tables: what lies in them, what is passed over, and what can't be read."""

from __future__ import annotations

import os
import zlib
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "class_folders"
# Extensions of files that count.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tif", ".tiff", ".webp")


def write_files(files: DataFrame, uri: str) -> int:
    """Write each of ``files(path, content)`` below ``uri``, a folder mounted on all machines; gives how many.

    A file gets its name when it is complete, so a retried task changes nothing.
    """
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"a folder mounted on all machines is needed, not {uri}")
    root = unquote(parsed.path)

    def write(batches):
        import uuid

        import pyarrow as pa

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                full = os.path.join(root, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                part = os.path.join(root, f"{uuid.uuid4().hex}.part")
                with open(part, "wb") as out:
                    out.write(content or b"")
                os.replace(part, full)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    total = files.select("path", F.col("content").cast("binary")).mapInArrow(write, "n long").agg(F.sum("n")).first()[0]
    return total or 0


class Share(InputPartition):
    """The files of one folder whose names hash to one of several slots."""

    def __init__(self, folder: str, slot: int, slots: int):
        super().__init__((folder, slot, slots))
        self.folder, self.slot, self.slots = folder, slot, slots


class FolderReader(DataSourceReader):
    """All files below the folders of a root, in shares, so that a large folder is opened by several tasks."""

    def __init__(self, options):
        self.root = unquote(urlparse(options["path"]).path)
        self.exclude = {x for x in options.get("exclude", "").split("/") if x}
        self.contents = options.get("contents", "true") == "true"
        self.slots = int(options.get("slots", 16))

    def partitions(self) -> list[Share]:
        """Only the folders of the root are listed here; tasks list what is in them."""
        with os.scandir(self.root) as found:
            names = sorted(e.name for e in found if e.is_dir() and not e.name.startswith(".") and e.name not in self.exclude)
        return [Share(n, slot, self.slots) for n in names for slot in range(self.slots)]

    def read(self, share: Share):
        if share is None:
            return
        top = os.path.join(self.root, share.folder)
        for here, _, names in os.walk(top):
            depth = 1 + (0 if here == top else os.path.relpath(here, top).count(os.sep) + 1)
            for name in names:
                if zlib.crc32(name.encode()) % share.slots != share.slot:
                    continue
                path, content = os.path.join(here, name), None
                about = os.stat(path)
                if self.contents:
                    with open(path, "rb") as f:
                        content = f.read()
                yield share.folder, name, depth, about.st_size, int(about.st_mtime * 1_000_000), content


class ClassFolders(DataSource):
    """``spark.read.format("class_folders").load(root)``; Spark's own file sources pass over empty files and names with a leading dot."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "folder string, name string, depth int, length long, modified long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)


def listing(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), contents: bool = True) -> DataFrame:
    """(folder, name, depth, length, modified, content, counted) of all files below a root, however deep.

    ``folder`` is the first folder below the root, and a file counts if it lies right in it, has
    a known extension and no leading dot. Folders with a leading dot and excluded ones are
    left out, as are files in the root. Without ``contents`` no file is opened.
    """
    if urlparse(root).scheme not in ("", "file"):
        raise ValueError(f"a folder mounted on all machines is needed, not {root}")
    spark.dataSource.register(ClassFolders)
    rows = spark.read.format(FORMAT).option("exclude", "/".join(exclude)).option("contents", str(contents).lower()).load(root)
    extension = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    return rows.withColumn("counted", (F.col("depth") == 1) & extension.isin(*EXTENSIONS) & ~F.col("name").startswith("."))


def readable(content: Column) -> Column:
    """Whether a file's content stands for something: not empty, and valid text here."""
    return (F.length(content) > 0) & F.is_valid_utf8(content.cast("string"))


def split_scan(files: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """(folder, known, n_files, n_passed, n_corrupt, n_bytes) of each folder of a listing.

    Without ``classes`` every folder is one; else others are reported with ``known`` false.
    Only counted files are opened; of those, unreadable ones are told apart.
    """
    known = F.col("folder").isin(classes) if classes is not None else F.lit(True)
    good = F.when(F.col("counted"), readable(F.col("content")))
    sums = lambda c: F.sum(c.cast("long"))
    g = files.select("folder", "counted", "length", good.alias("good")).groupBy("folder").agg(sums(F.col("counted")).alias("n_files"), sums(~F.col("counted")).alias("n_passed"), F.coalesce(sums(~F.col("good")), F.lit(0)).alias("n_corrupt"), F.coalesce(F.sum(F.when(F.col("counted"), F.col("length"))), F.lit(0)).alias("n_bytes"))
    return g.select("folder", known.alias("known"), "n_files", "n_passed", "n_corrupt", "n_bytes")


def first_files(files: DataFrame, k: int) -> DataFrame:
    """(folder, name, length) of the first ``k`` counted files of each folder by name.

    A folder's names are first cut down slot by slot, so none is sorted in one task as a whole.
    """
    names = files.filter("counted").select("folder", "name", "length").withColumn("slot", F.pmod(F.xxhash64("name"), F.lit(64)))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("name"))
    few = names.withColumn("i", place("folder", "slot")).filter(F.col("i") <= k)
    return few.withColumn("i", place("folder")).filter(F.col("i") <= k).select("folder", "name", "length")
