"""Connectors by source type, and cursor-paged services as a Python data source."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from corpusloom.sources import feeds, tables

#: What reads the changes of a source type.
CONNECTORS = {
    "WEBSITE": feeds.website_changes,
    "GITHUB": feeds.manifest_diff,
    "GOOGLE_DRIVE": feeds.drive_changes,
    "POSTGRES": tables.keyset_page,
    "REST_API": feeds.rest_items,
    "ARXIV": feeds.atom_entries,
}


def connector(source_type: str) -> Callable:
    """The reader of a source type; uploads have nothing to sync."""
    if source_type == "FILE_UPLOAD":
        raise ValueError("uploads have nothing to sync")
    if source_type not in CONNECTORS:
        raise ValueError(f"unsupported source type: {source_type}")
    return CONNECTORS[source_type]


def rest_source(fetch: Callable[[str, str | None], dict], name: str = "rest_pages") -> type[DataSource]:
    """A data source of JSON pages for spark.dataSource.register(); fetch(url, cursor) gives one page as a dict.

    Options: url names one or more services, comma-joined, each read in a task of
    its own; cursor is where to begin; cursor_field names the next cursor. Rows:
    url, page, cursor (the next one), body, as feeds.rest_items() reads them.

    As a stream, the offset is each service's cursor. The driver follows the cursors,
    after the first batch those of at most pages_per_batch pages a service (default
    100), and each page is fetched in a task of its own. A page that was read and has no next cursor is
    asked for again in later batches, until it has one; it is not read twice.
    """

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.urls = [u.strip() for u in options.get("url", "").split(",") if u.strip()]
            self.begin = options.get("cursor") or None
            self.field = options.get("cursor_field", "next_cursor")

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(u) for u in self.urls]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            cursor, page = self.begin, 0
            while True:
                body = fetch(partition.value, cursor)
                cursor = body.get(self.field)
                yield partition.value, page, cursor, json.dumps(body, ensure_ascii=False)
                page += 1
                if not cursor:
                    break

    class Stream(DataSourceStreamReader):
        def __init__(self, options):
            self.urls = [u.strip() for u in options.get("url", "").split(",") if u.strip()]
            self.begin = options.get("cursor") or None
            self.field = options.get("cursor_field", "next_cursor")
            self.most = int(options.get("pages_per_batch", "100"))
            self.reached: dict | None = None

        def initialOffset(self) -> dict:
            return {u: {"cursor": self.begin, "read": False, "page": 0} for u in self.urls}

        def walk(self, url: str, at: dict, most: int) -> Iterator[tuple[str | None, int, dict]]:
            """(cursor, page, offset after it) of the pages from an offset on."""
            while most > 0:
                following = fetch(url, at["cursor"]).get(self.field)
                cursor, page = at["cursor"], at["page"]
                if at["read"]:
                    if not following:
                        return
                    at = {"cursor": following, "read": False, "page": page}
                    continue
                at = {"cursor": following or cursor, "read": not following, "page": page + 1}
                most -= 1
                yield cursor, page, at
                if not following:
                    return

        def latestOffset(self) -> dict:
            # After a restart the offset reached is not told before a batch is planned: cursors are then followed to their end.
            now, most = (self.reached, self.most) if self.reached else (self.initialOffset(), 1 << 62)
            for url in self.urls:
                for _, _, at in self.walk(url, now[url], most):
                    now = now | {url: at}
            self.reached = now
            return now

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            self.reached = end
            pages = lambda u: self.walk(u, start[u], end[u]["page"] - start[u]["page"])
            return [InputPartition((u, cursor, page)) for u in self.urls for cursor, page, _ in pages(u)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            url, cursor, page = partition.value
            body = fetch(url, cursor)
            yield url, page, body.get(self.field), json.dumps(body, ensure_ascii=False)

        def commit(self, end: dict) -> None:
            """The checkpoint holds the offset; a service keeps nothing."""

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "url string, page int, cursor string, body string"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Stream(self.options)

    return Pages
