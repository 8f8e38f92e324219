"""A Spark data source for paged JSON services: one partition for each query, pages followed by cursor.

    spark.dataSource.register(PagedJson)
    spark.read.format("paged_json").option("urls", "a b").load()
    spark.read.format("paged_json").option("urls", "a").option("params", '{"seasons[]": [2023, 2024], "player_ids[]": [1, 2, 3]}')
        .option("split", '{"seasons[]": 1, "player_ids[]": 100}').load()

Filters of the service are given as `params`: a list is a parameter that is repeated. `split` names the lists that are
dealt into partitions and how many of their values a request has, so seasons or batches of ids are read side by side. A
page that fails is asked for again from its own cursor, not from the first page.

The schema is (url, page, record): records stay JSON text, to be parsed by `from_json` under a declared schema. With
the option pushdown, which needs spark.sql.python.filterPushdown.enabled, filters on url leave out whole queries. As a stream, each batch
reads the pages after the cursors of the batch before. Any scheme that Python opens works; file:// stands in for a
service in tests.
"""

from __future__ import annotations

import itertools
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader

MOST_PAGES = 10_000


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "url string, page int, record string"

    def reader(self, schema) -> PagedJsonReader:
        pushed = self.options.get("pushdown", "false") == "true"
        return PushedReader(self.options) if pushed else PagedJsonReader(self.options)

    def simpleStreamReader(self, schema) -> PagedJsonStream:
        return PagedJsonStream(self.options)


def queries(urls: Iterable[str], params: dict, split: dict) -> list[str]:
    """The urls with their parameters; each list that `split` names is dealt into requests of so many values."""
    parts = []
    for name, value in params.items():
        values = value if isinstance(value, list) else [value]
        size = int(split.get(name, 0)) or max(1, len(values))
        batches = [values[k : k + size] for k in range(0, len(values), size)]
        parts.append([[(name, _written(v)) for v in batch] for batch in batches])
    out = []
    for url in urls:
        for chosen in itertools.product(*parts):
            text = urllib.parse.urlencode([pair for batch in chosen for pair in batch], safe="[]")
            out.append(url if not text else f"{url}{'&' if '?' in url else '?'}{text}")
    return out


def _written(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


class _Pages:
    """Options: urls (separated by blanks), params and split (JSON), token (bearer header), cursor (parameter name), data
    and next (paths in a page), attempts and wait (seconds between them) for a page that fails."""

    def __init__(self, options: dict) -> None:
        self.urls = queries(options.get("urls", "").split(), json.loads(options.get("params", "{}")), json.loads(options.get("split", "{}")))
        self.token = options.get("token")
        self.cursor = options.get("cursor", "cursor")
        self.data = options.get("data", "data").split(".")
        self.next = options.get("next", "meta.next_cursor").split(".")
        self.attempts, self.wait = int(options.get("attempts", "3")), float(options.get("wait", "1"))

    def _get(self, url: str) -> dict | list:
        request = urllib.request.Request(url, headers={"Authorization": f"Bearer {self.token}"} if self.token else {})
        with urllib.request.urlopen(request, timeout=60) as answer:
            return json.load(answer)

    def _page(self, base: str, cursor: str | None) -> tuple[list, str | None]:
        """(records, next cursor) of the page at this cursor."""
        url = base if cursor is None else f"{base}{'&' if '?' in base else '?'}{urllib.parse.urlencode({self.cursor: cursor})}"
        for attempt in range(1, self.attempts + 1):
            try:
                body = self._get(url)
                break
            except (OSError, ValueError):
                if attempt == self.attempts:
                    raise
                time.sleep(self.wait)
        found = body if isinstance(body, list) else _at(body, self.data)
        after = None if isinstance(body, list) else _at(body, self.next)
        return found if isinstance(found, list) else [] if found is None else [found], None if after in (None, "") else str(after)


class PagedJsonReader(_Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str]]:
        base, cursor = partition.value, None
        for page in range(MOST_PAGES):
            records, cursor = self._page(base, cursor)
            for record in records:
                yield base, page, json.dumps(record)
            if cursor is None:
                return
        raise RuntimeError(f"{base} has over {MOST_PAGES} pages")


class PushedReader(PagedJsonReader):
    """With the option pushdown: filters on url leave out whole queries."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("url",):
                self.urls = [u for u in self.urls if u == f.value]
            elif isinstance(f, In) and f.attribute == ("url",):
                self.urls = [u for u in self.urls if u in f.value]
            else:
                yield f


class PagedJsonStream(_Pages, SimpleDataSourceStreamReader):
    """A batch has the next page of each query that has one. Offsets are the number of pages read of a query and the cursor
    after them; a query whose last page has no cursor is done. Services that stream are light: pages pass the driver."""

    def initialOffset(self) -> dict:
        return {u: {"page": 0, "cursor": None, "done": False} for u in self.urls}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], {}
        for url, at in start.items():
            if at["done"]:
                end[url] = at
                continue
            records, after = self._page(url, at["cursor"])
            rows += [(url, at["page"], json.dumps(r)) for r in records]
            end[url] = {"page": at["page"] + 1, "cursor": after, "done": after is None}
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start
        while any(at[u]["page"] < end[u]["page"] for u in start):
            rows, after = self.read({u: at[u] for u in at if at[u]["page"] < end[u]["page"]})
            yield from rows
            at = at | after


def typed(records: DataFrame, schema: T.StructType, column: str = "record") -> DataFrame:
    """The records under a declared schema. Without records there is one partition, so that even an empty snapshot is
    written with its columns and types."""
    parsed = records.select(F.from_json(column, schema).alias("r")).select("r.*")
    return parsed.coalesce(1) if parsed.isEmpty() else parsed


def _at(body, path):
    for name in path:
        body = body.get(name) if isinstance(body, dict) else None
    return body
