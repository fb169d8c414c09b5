"""A Spark data source for map-service answers: one partition per query, answers from files or HTTP.

Format "osm_places" gives (query, name, kind, lat, lon). Option `folder` holds one saved JSON answer
per query (<query>.json); option `endpoint` asks a service instead, one request per second a task.
Both answer shapes are read: search results with an address, and element lists with tags.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PLACE_KEYS = ("suburb", "neighbourhood", "quarter")


class _Query(InputPartition):
    def __init__(self, query: str):
        self.query = query


def places(answer: list | dict) -> Iterator[tuple[str | None, str | None, float | None, float | None]]:
    """(name, kind, lat, lon) of an answer; the name is the first place key that is not empty."""
    items = answer.get("elements", []) if isinstance(answer, dict) else answer
    for item in items:
        address, tags = item.get("address") or {}, item.get("tags") or {}
        name = next((address[k] for k in PLACE_KEYS if address.get(k)), None) or tags.get("name") or item.get("name")
        kind = item.get("type") if not tags else tags.get("place")
        number = lambda v: float(v) if v not in (None, "") else None
        yield name, kind, number(item.get("lat")), number(item.get("lon"))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.queries = [q for q in options.get("queries", "").split("|") if q]
        self.folder, self.endpoint = options.get("folder"), options.get("endpoint")
        self.pause = float(options.get("pause", "1"))

    def partitions(self) -> list[InputPartition]:
        return [_Query(q) for q in self.queries] or [_Query("")]

    def read(self, partition: _Query) -> Iterator[tuple]:
        if not partition.query:
            return
        if self.folder:
            path = Path(self.folder, f"{partition.query}.json")
            answer = json.loads(path.read_text(encoding="utf-8")) if path.exists() else []
        elif self.endpoint:
            url = f"{self.endpoint}?{urllib.parse.urlencode({'q': partition.query, 'format': 'json', 'addressdetails': 1})}"
            with urllib.request.urlopen(url, timeout=30) as r:
                answer = json.load(r)
            time.sleep(self.pause)
        else:
            raise ValueError("osm_places needs the option folder or endpoint")
        for row in places(answer):
            yield (partition.query, *row)


class OsmPlaces(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_places"

    def schema(self) -> str:
        return "query string, name string, kind string, lat double, lon double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
