"""Archives, desktop clients and calendars as data sources.

Each reads through a client, named by the option `connect` (`module:function`, called with the
options) so that any library can serve. A client has `folders()`, paths joined by `/`, and
`items(folder, since, limit)`, which yields dicts with the keys of the format's schema, newest
first. Folders are the partitions. `JsonClient` is one for local files.
"""

from __future__ import annotations

import importlib
import json
import operator
import os
from collections.abc import Iterable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

from postloom.sources import items


def load(options: dict, default: str = ""):
    """The client that the options name."""
    module, _, name = (options.get("connect") or default).partition(":")
    return operator.attrgetter(name)(importlib.import_module(module))(options)


class JsonClient:
    """Items in files `<folder path>.jsonl` below the option `path`, one JSON object a line; dates in ISO form."""

    def __init__(self, options: dict):
        self.root, self.date = options["path"], options.get("date", "")

    def folders(self) -> list[str]:
        found = [os.path.relpath(os.path.join(d, f), self.root) for d, _, fs in os.walk(self.root) for f in fs if f.endswith(".jsonl")]
        return sorted(f.removesuffix(".jsonl") for f in found)

    def items(self, folder: str, since: datetime | None, limit: int | None) -> Iterator[dict]:
        with open(os.path.join(self.root, f"{folder}.jsonl"), encoding="utf-8") as f:
            rows = [json.loads(x) for x in f if x.strip()]
        rows.sort(key=lambda r: r.get(self.date) or "", reverse=True)
        kept = (r for r in rows if not since or not r.get(self.date) or datetime.fromisoformat(r[self.date]) >= since)
        for n, r in enumerate(kept):
            if limit is not None and n >= limit:
                return
            yield r


class FolderOf(InputPartition):
    def __init__(self, folder: str):
        self.folder = folder


def _value(v, kind: T.DataType):
    if isinstance(kind, T.TimestampNTZType) and isinstance(v, str):
        return datetime.fromisoformat(v)
    if isinstance(kind, T.ArrayType) and v is not None:
        return [_value(x, kind.elementType) for x in v]
    if isinstance(kind, T.StructType) and isinstance(v, dict):
        return tuple(_value(v.get(f.name), f.dataType) for f in kind.fields)
    return v


class ItemReader(DataSourceReader):
    """`folders` (comma list of parts of paths, in any case), `since` and `limit` (of each folder) are options."""

    def __init__(self, options: dict, schema: T.StructType, date: str):
        self.options, self.schema, self.date = {**options, "date": date}, schema, date
        self.since = datetime.fromisoformat(options["since"]) if options.get("since") else None
        self.limit = int(options["limit"]) if options.get("limit") else None

    def partitions(self) -> list[InputPartition]:
        wanted = [x.strip().lower() for x in self.options.get("folders", "").split(",") if x.strip()]
        return [FolderOf(f) for f in load(self.options, DEFAULT).folders() if not wanted or any(w in f.lower() for w in wanted)]

    def read(self, partition: FolderOf) -> Iterator[tuple]:
        for item in load(self.options, DEFAULT).items(partition.folder, self.since, self.limit):
            row = {"folder": partition.folder, **item}
            yield tuple(_value(row.get(f.name), f.dataType) for f in self.schema.fields)


class Pushing:
    """For readers with `date` and `since`: a lower bound of the date in a query goes to the client. Only with the option `push`, as Spark refuses such readers unless spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == (self.date,) and isinstance(f.value, datetime):
                self.since = max(filter(None, (self.since, f.value)))
            yield f  # Spark applies it again: clients may be coarse


class PushingItemReader(Pushing, ItemReader):
    pass


def pushes(spark: SparkSession) -> dict[str, str]:
    """The option `push`, where Spark pushes filters to Python sources."""
    return {"push": "true"} if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true" else {}


DEFAULT = "postloom.sources.adapters:JsonClient"


class _Items(DataSource):
    ddl, date = "", ""

    def schema(self) -> str:
        return self.ddl

    def reader(self, schema) -> DataSourceReader:
        return (PushingItemReader if self.options.get("push") == "true" else ItemReader)(dict(self.options), schema, self.date)


class Archive(_Items):
    """spark.read.format("mail_archive"): items of an archive file."""

    ddl, date = items.ARCHIVE_ITEM, "delivery_time"

    @classmethod
    def name(cls) -> str:
        return "mail_archive"


class Desktop(_Items):
    """spark.read.format("desktop_mail"): items of a desktop client's folders, newest first, so a client may stop at `since`."""

    ddl, date = items.DESKTOP_ITEM, "received_time"

    @classmethod
    def name(cls) -> str:
        return "desktop_mail"


class Calendar(_Items):
    """spark.read.format("desktop_calendar"): appointments, repeated ones once for each date."""

    ddl, date = items.CALENDAR_ITEM, "start"

    @classmethod
    def name(cls) -> str:
        return "desktop_calendar"


def register(spark: SparkSession) -> None:
    for source in (Archive, Desktop, Calendar):
        spark.dataSource.register(source)


def read_archive(spark: SparkSession, bots: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Messages of an archive."""
    register(spark)
    return items.archive_messages(spark.read.format("mail_archive").options(**pushes(spark), **options).load(), bots)


def read_desktop(spark: SparkSession, bots: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Messages of a desktop client; by default of its inbox and sent items."""
    register(spark)
    return items.desktop_messages(spark.read.format("desktop_mail").options(**{"folders": "inbox,sent items", **pushes(spark), **options}).load(), bots)


def read_calendar(spark: SparkSession, start: str, end: str, **options: str) -> DataFrame:
    """Meetings that start in [start, end)."""
    from postloom.operators.calendar import starting_within

    register(spark)
    return starting_within(items.meetings(spark.read.format("desktop_calendar").options(**{"since": start, **pushes(spark), **options}).load()), start, end)


def current_address(options: dict) -> str | None:
    """The address of the client's user, where it knows one."""
    return getattr(load(options, DEFAULT), "address", None)
