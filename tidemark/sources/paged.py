"""A resumable source of items that a provider gives page by page: a stream whose offset is the number of pages read.

Pages lie as JSON lines in folders `page=N` under one root, as a fetcher leaves them. A run reads the pages that have come since the last one, a
partition for each, and the stream's checkpoint keeps the cursor: a run that fails or is stopped is taken up at the page after the last finished batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

ITEM = "provider string, page long, guid string, title string, link string, published string, body string"


@dataclass(frozen=True)
class Provider:
    """Where a provider's JSON holds what an item needs; paths into nested objects have dots."""

    guid: str
    title: str
    link: str
    published: str
    body: str
    #: What a link is made of where the provider gives none.
    fallback: str = ""

    def item(self, raw: dict) -> tuple[str | None, ...] | None:
        """guid, title, link, published, body as text; None for an entry without a title or an identity."""

        def get(path: str) -> str | None:
            value = raw
            for key in path.split("."):
                value = value.get(key) if isinstance(value, dict) else None
            return None if value is None else str(value)

        guid, title = get(self.guid), get(self.title)
        if not guid or not title or not title.strip():
            return None
        return guid, title, get(self.link) or (self.fallback.format(guid) if self.fallback else None), get(self.published), get(self.body)


PROVIDERS: dict[str, Provider] = {
    "search_by_date": Provider("objectID", "title", "url", "created_at", "story_text", "https://news.example/item?id={}"),
    "releases": Provider("id", "name", "html_url", "published_at", "body"),
    "papers": Provider("id", "title", "links.abstract", "submitted", "abstract"),
    "crawl": Provider("page_id", "title", "url", "fetched", "html"),
}


def register(name: str, provider: Provider) -> None:
    PROVIDERS[name] = provider


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


class _Page(InputPartition):
    def __init__(self, number: int):
        self.value = self.number = number


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str, name: str, provider: Provider):
        self.root, self.name, self.provider = root, name, provider

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        """Pages from the first on without a gap; one that is missing is waited for, as what comes after would be skipped."""
        from pyarrow import fs

        files, path = _open(self.root)
        found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
        numbers = {int(m[1]) for f in found if (m := re.search(r"page=(\d+)$", f.path))}
        n = 0
        while n in numbers:
            n += 1
        return {"pages": n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Page(n) for n in range(start["pages"], end["pages"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        files, path = _open(self.root)
        for f in sorted(files.get_file_info(fs.FileSelector(f"{path}/page={partition.number}")), key=lambda f: f.path):
            if f.base_name.startswith(("_", ".")):
                continue
            with files.open_input_stream(f.path) as stream:
                for line in stream.read().decode().splitlines():
                    if line.strip() and (item := self.provider.item(json.loads(line))):
                        yield (self.name, partition.number, *item)

    def commit(self, end: dict) -> None:
        """Nothing to give back: pages stay."""


class PagedSource(DataSource):
    """Options: `path`, the root folder, which all executors can open; `provider`, a name in `PROVIDERS`."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return ITEM

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], self.options["provider"], PROVIDERS[self.options["provider"]])


def read_pages(spark: SparkSession, root: str, provider: str) -> DataFrame:
    """The stream of a provider's items, `ITEM`. Entries without title or identity are left out; a page that is no JSON fails the run, and
    the next one reads it again."""
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("paged").option("path", root).option("provider", provider).load()
