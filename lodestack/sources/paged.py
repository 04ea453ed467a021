"""Paged JSON sources as a Python data source: one partition a run of pages.

Pages are files ``<query>-<number>.json`` of a folder that all executors see, as a collector
leaves them; each holds an object with a list of rows.  A short or empty page ends its query.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "query string, page int, pos int, body string, size int"
_NAME = re.compile(r"^(.+)-(\d+)\.json$")


class Pages(InputPartition):
    def __init__(self, query: str, files: list[tuple[int, str]]) -> None:
        self.query, self.files = query, files


class PagedReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder = options["path"]
        self.rows_key = options.get("rows", "items")
        self.run = max(1, int(options.get("pagesPerTask", "20")))

    def partitions(self) -> list[InputPartition]:
        found: dict[str, list[tuple[int, str]]] = {}
        for name in os.listdir(self.folder):
            m = _NAME.match(name)
            if m:
                found.setdefault(m[1], []).append((int(m[2]), os.path.join(self.folder, name)))
        out: list[InputPartition] = []
        for query, files in sorted(found.items()):
            files.sort()
            out += [Pages(query, files[i : i + self.run]) for i in range(0, len(files), self.run)]
        return out

    def read(self, partition: Pages) -> Iterator[tuple]:
        for number, path in partition.files:
            with open(path, encoding="utf-8") as f:
                rows = json.load(f).get(self.rows_key) or []
            for pos, row in enumerate(rows):
                yield partition.query, number, pos, json.dumps(row, ensure_ascii=False, sort_keys=True), len(rows)
            if not rows:
                yield partition.query, number, -1, None, 0


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


def read_pages(spark: SparkSession, folder: str, rows: str = "items", page_size: int = 50) -> DataFrame:
    """query, page, pos and JSON body of every row; pages are read by tasks, names only by the driver.

    What lies behind a query's first short or empty page belongs to an older run and is left out.
    """
    spark.dataSource.register(PagedSource)
    read = spark.read.format("paged_json").option("rows", rows).load(folder)
    last = read.where(F.col("size") < page_size).groupBy("query").agg(F.min("page").alias("last"))
    kept = read.join(last, "query", "left").where(F.col("last").isNull() | (F.col("page") <= F.col("last")))
    return kept.where("body is not null").select("query", "page", "pos", "body")


def first_of(pages: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows of a paged source in an order, as a scan that stops mid-page gives them."""
    return pages.orderBy(*order).limit(n)


def collections(roots: DataFrame, children: DataFrame) -> DataFrame:
    """Collections of two scans (id, parent_id, title), one row an id, by parent and title; roots have parent 0."""
    both = roots.select("id", F.lit(0).cast("long").alias("parent_id"), "title").unionByName(children.select("id", F.coalesce(F.col("parent_id").cast("long"), F.lit(0)).alias("parent_id"), "title"))
    return both.groupBy("id").agg(F.min(F.struct("parent_id", "title")).alias("c")).select("id", "c.parent_id", "c.title").orderBy("parent_id", "title", "id")


def collection_id(item: Column, field: str = "collection") -> Column:
    """Id of the collection that a JSON item is in, from its nested object; 0 if there is none."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(item), f"$.{field}['$id']", "long"), F.lit(0).cast("long"))
