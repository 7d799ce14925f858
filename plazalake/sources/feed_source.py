"""Feeds as a data source: ``spark.dataSource.register(FeedSource)``, then

    spark.read.format("feeds").option("path", folder).load()
    spark.read.format("feeds").option("feeds", '{"name": "https://...", ...}').load()

One partition per feed, so feeds are fetched side by side, each by a task of its own.
A feed that can't be fetched or read becomes a row with its error.
"""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plazalake.sources.feeds import ENTRY, read_entries
from plazalake.sources.payloads import ERROR, Empty

SCHEMA = f"feed string, pos int, {ENTRY}, error string"


@dataclass
class Feed(InputPartition):
    name: str
    place: str


class FeedReader(DataSourceReader):
    def __init__(self, options):
        self.timeout = float(options.get("timeout", 15))
        self.feeds = json.loads(options.get("feeds", "{}"))
        self.path = options.get("path")
        if not self.feeds and not self.path:
            raise ValueError("give a folder of recorded feeds as path, or places by name as feeds")

    def partitions(self):
        found = dict(self.feeds)
        if self.path:
            system, folder = fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")
            scheme = self.path.split("://")[0] + "://" if "://" in self.path else "file://"
            for info in system.get_file_info(fs.FileSelector(folder)):
                if info.is_file and not info.base_name.startswith((".", "_")):
                    found[info.base_name.rsplit(".", 1)[0]] = scheme + info.path
        return [Feed(name, place) for name, place in sorted(found.items())]

    def fetch(self, place: str) -> str:
        if place.startswith(("http://", "https://")):
            with urllib.request.urlopen(place, timeout=self.timeout) as answer:  # noqa: S310
                return answer.read().decode("utf-8", "replace")
        system, path = fs.FileSystem.from_uri(place)
        with system.open_input_stream(path) as f:
            return f.read().decode("utf-8", "replace")

    def read(self, partition: Feed):
        try:
            found = read_entries(self.fetch(partition.place))
            if not found:
                raise Empty("no entries")
        except Exception as e:  # noqa: BLE001  a feed that fails leaves the others alone
            yield (partition.name, None, *(None,) * len(ENTRY.split(",")), str(e)[:ERROR] or type(e).__name__)
            return
        for i, row in enumerate(found):
            yield (partition.name, i, *row, None)


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)
