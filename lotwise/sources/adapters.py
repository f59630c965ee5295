"""Pluggable sources: a Python data source over pages of an adapter, and reference tables from JSON."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class ListingPages(DataSource):
    """SRC17: ``spark.read.format("listing_pages")`` with options ``module``, ``adapter`` and ``pages``.

    An adapter is a class made from the options, with ``scrape(page) -> iterator of (key, title, price_cents)``; each
    page is a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> str:
        return "page int, record_key string, title string, price_cents bigint"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.pages = dict(options), int(options.get("pages", 1))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(1, self.pages + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        adapter = getattr(importlib.import_module(self.options["module"]), self.options["adapter"])(self.options)
        for key, title, price in adapter.scrape(partition.value):
            yield partition.value, key, title, price


class Numbered:
    """An adapter without a network, for tests: ten numbered rows on each page."""

    def __init__(self, options: dict):
        pass

    def scrape(self, page: int) -> Iterator[tuple[str, str, int]]:
        for i in range(10):
            yield f"{page}-{i}", f"20{10 + i} Toyota Sienna", (page * 10 + i) * 100_00


class Exported:
    """An adapter of pages that lie as Parquet in folders ``page=n`` below the option ``root``, in any store that Arrow reads."""

    def __init__(self, options: dict):
        self.root = options["root"]

    def scrape(self, page: int) -> Iterator[tuple[str, str, int]]:
        from pyarrow import dataset, fs

        store, path = fs.FileSystem.from_uri(f"{self.root}/page={page}")
        for batch in dataset.dataset(path, filesystem=store, format="parquet").to_batches(columns=["record_key", "title", "price_cents"]):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def seeds(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC11: a JSON array of reference rows."""
    return spark.read.schema(schema).json(path, multiLine=True)


def union_of_searches(found: list[DataFrame], key: str, order: list, most: int) -> DataFrame:
    """SRC18: rows of several searches, each key once, the first ``most`` in order."""
    from functools import reduce

    return reduce(DataFrame.unionByName, found).dropDuplicates([key]).orderBy(*order, F.col(key)).limit(most)
