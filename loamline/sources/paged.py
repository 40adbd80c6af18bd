"""Saved pages of a paged search as a table: one partition for each page, and filters that leave pages unopened."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

#: The search's rows beyond this place can't be asked for.
MOST_OFFSET = 100_000
FORMAT = "saved_pages"


class Page(InputPartition):
    """A page's file, its query and the place of its first row."""

    def __init__(self, path: str, query: str, offset: int):
        super().__init__((path, query, offset))
        self.path, self.query, self.offset = path, query, offset


class PageReader(DataSourceReader):
    """Pages below a folder: ``<query>/<offset>.json``, each with ``results``."""

    def __init__(self, schema: StructType, options):
        self.schema = schema
        self.root = unquote(urlparse(options["path"]).path)
        self.most = int(options.get("mostOffset", MOST_OFFSET))
        self.queries: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality on ``query`` chooses folders, so no page of another one is opened; all else is left to Spark."""
        for f in filters:
            values = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if values is not None and f.attribute == ("query",):
                self.queries = set(values) if self.queries is None else self.queries & set(values)
            else:
                yield f

    def partitions(self) -> list[Page]:
        """All pages of the wanted queries up to the largest offset, up to the one that tells that it is the last."""
        pages = []
        for query in sorted(os.listdir(self.root)):
            if query.startswith(".") or (self.queries is not None and query not in self.queries):
                continue
            offsets = sorted(int(name[:-5]) for name in os.listdir(os.path.join(self.root, query)) if name.endswith(".json") and name[:-5].isdigit())
            pages += [Page(os.path.join(self.root, query, f"{at}.json"), query, at) for at in offsets if at <= self.most]
        return pages

    def read(self, partition: Page) -> Iterator[tuple]:
        """Rows of a page; one that can't be parsed or has no results gives none, as a failed request does."""
        if partition is None:
            return
        try:
            with open(partition.path, encoding="utf-8") as f:
                page = json.load(f)
        except ValueError:
            return
        names = [f for f in self.schema.names if f not in ("query", "place")]
        for k, row in enumerate(page.get("results") or [] if isinstance(page, dict) else []):
            yield (partition.query, partition.offset + k, *(row.get(n) for n in names))


class SavedPages(DataSource):
    """``spark.read.format("saved_pages").schema(...)``: ``query``, ``place`` and the fields of the results by name."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "query string, place long, id long, url string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(schema, self.options)


def read_pages(spark: SparkSession, path: str, schema: str, most_offset: int = MOST_OFFSET) -> DataFrame:
    """Rows of all saved pages below ``path``; ``schema`` begins with ``query string, place long``."""
    if urlparse(path).scheme not in ("", "file"):
        raise ValueError(f"a folder mounted on all machines is needed, not {path}")
    spark.dataSource.register(SavedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).schema(schema).option("mostOffset", most_offset).load(path)
