"""Memory services as Spark data sources, for `spark.read` and `spark.readStream`.

    services.register(spark)
    spark.read.format("mem0_memories").option("connect", "my_clients:mem0").option("scans", '[{"filters": {"user_id": "u"}}]').load()

Options, checked before a client is made:

* `connect`: `module:function`, which makes a client where it is called; executors import it themselves.
* `scans`: a JSON list of scans, the arguments of the service's pages; each is a partition.
* `secret`: the name of an environment variable of the executors; `connect` gets its value. So no secret is in a plan.

Rows are (value, memory_type): a record as JSON, and what letta calls it. Services page by a cursor, so a scan is
read in order, page by page, and a partition holds one page.

*Streams* are for services whose cursor is a record's id (graph edges, and letta's archival passages): the offset is the last id
of each scan, and a batch has the records after one offset, up to another, so that a batch that is read again has the same
records. Ids must be listed in their order, new ones last. A query that starts anew finds the newest id by paging from its
start, with records left out, as services name no last id.
"""

from __future__ import annotations

import importlib
import json
import os
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import live
from .files import SourceError

SCHEMA = "value string, memory_type string"
_OPTIONS = {"connect", "scans", "secret", "path"}


def _connector(text: str, secret: str | None) -> Callable[[], Any]:
    module, _, name = text.partition(":")
    make = getattr(importlib.import_module(module), name)
    if secret is None:
        return make
    if secret not in os.environ:
        raise SourceError(f"the environment variable {secret} is not set")
    return lambda: make(os.environ[secret])


def _row(r: dict) -> tuple[str, str | None]:
    return json.dumps(r, ensure_ascii=False, allow_nan=False), r.get("memory_type")


class Scan(InputPartition):
    """A scan, or its part after one cursor and up to another."""

    def __init__(self, number: int, arguments: dict, after: str | None = None, to: str | None = None) -> None:
        super().__init__(number)
        self.arguments, self.after, self.to = arguments, after, to


class ServiceSource(DataSource):
    """What the services share. Subclasses say how a page is read and what a valid scan is."""

    service = ""
    page: Callable[..., live.Page]
    check: Callable[..., None]
    #: The field that orders records, where a stream can follow it.
    key: str | None = None

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        given = {k.lower(): v for k, v in options.items()}
        if unknown := set(given) - _OPTIONS:
            raise SourceError(f"unknown options: {', '.join(sorted(unknown))}")
        module, _, name = given.get("connect", "").partition(":")
        if not module or not name.isidentifier():
            raise SourceError("the option 'connect' must be module:function")
        try:
            scans = json.loads(given.get("scans", ""))
        except ValueError:
            scans = None
        if not isinstance(scans, list) or not scans or not all(isinstance(s, dict) for s in scans):
            raise SourceError("the option 'scans' must be a JSON list of objects")
        for s in scans:
            try:
                type(self).check(**s)
            except TypeError as error:
                raise SourceError(f"{self.service}: a scan's fields are not valid") from error
        self.connect, self.secret, self.scans = given["connect"], given.get("secret"), scans

    @classmethod
    def name(cls) -> str:
        return f"{cls.service}_memories"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return ScanReader(self)

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        if self.key is None:
            raise SourceError(f"{self.service} has no cursor that a stream can follow")
        return ScanStream(self)

    def records(self, scan: Scan) -> Iterator[dict]:
        """The records of a scan after its cursor, up to and with the record that its end names."""
        try:
            client = _connector(self.connect, self.secret)()
            for r in live.all_pages(type(self).page, client, scan.after, **scan.arguments):
                yield r
                if scan.to is not None and self.cursor(r) == scan.to:
                    return
        except SourceError:
            raise
        except Exception as error:
            raise live.classified(self.service, error) from error

    def cursor(self, r: dict) -> str | None:
        return None if r.get(self.key) is None else str(r[self.key])


class ScanReader(DataSourceReader):
    def __init__(self, source: ServiceSource) -> None:
        self.source = source

    def partitions(self) -> list[Scan]:
        return [Scan(n, s) for n, s in enumerate(self.source.scans)]

    def read(self, partition: Scan) -> Iterator[tuple]:
        yield from map(_row, self.source.records(partition))


class ScanStream(DataSourceStreamReader):
    """Offsets are {scan: last cursor}, empty where nothing was seen."""

    def __init__(self, source: ServiceSource) -> None:
        self.source = source
        self.seen = self.initialOffset()

    def initialOffset(self) -> dict:
        return {str(n): "" for n in range(len(self.source.scans))}

    def latestOffset(self) -> dict:
        for n, s in enumerate(self.source.scans):
            for r in self.source.records(Scan(n, s, self.seen[str(n)] or None)):
                self.seen[str(n)] = self.source.cursor(r) or self.seen[str(n)]
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Scan]:
        moved = [n for n in range(len(self.source.scans)) if start[str(n)] != end[str(n)]]
        return [Scan(n, self.source.scans[n], start[str(n)] or None, end[str(n)]) for n in moved]

    def read(self, partition: Scan) -> Iterator[tuple]:
        yield from map(_row, self.source.records(partition))


class Mem0Source(ServiceSource):
    service, page, check = "mem0", staticmethod(live.mem0_page), staticmethod(lambda filters, page_size=100: live.check_mem0(filters, page_size))


class GraphSource(ServiceSource):
    service, page, check, key = "graphiti", staticmethod(live.graph_page), staticmethod(live.check_graph), "uuid"


class LettaSource(ServiceSource):
    """Blocks and passages of an agent."""

    service, page, check = "letta", staticmethod(live.letta_page), staticmethod(live.check_letta)


def _passages(client: Any, cursor: str | None, agent_id: str) -> live.Page:
    rows, following = live.letta_page(client, f"archival:{cursor or ''}", agent_id)
    return rows, following and following.partition(":")[2]


class LettaPassages(ServiceSource):
    """Passages only, which a stream can follow."""

    service, page, check, key = "letta_archival", staticmethod(_passages), staticmethod(live.check_letta), "id"


SOURCES = (Mem0Source, GraphSource, LettaSource, LettaPassages)


def register(spark: SparkSession) -> None:
    for source in SOURCES:
        spark.dataSource.register(source)


def records(rows: DataFrame) -> DataFrame:
    """(v, memory_type) of a source's rows, as normalisers take them."""
    return rows.select(F.parse_json("value").alias("v"), "memory_type")
