"""A streaming source over mailboxes: one folder of Parquet files for each account, with a date in each row.

An offset is the latest date of each account, so a query's checkpoint holds the accounts' watermarks. A batch
reads each account from its watermark less an overlap, as messages may be delivered late; what is read
twice for that is told apart by the keyed state behind the source, so each message is taken once.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_EPOCH = datetime.datetime(1970, 1, 1)


def _micros(t: datetime.datetime) -> int:
    return (t - _EPOCH) // datetime.timedelta(microseconds=1)


@dataclass
class Span(InputPartition):
    """An account's messages after `low` up to `high`, in microseconds; both ends may be met again by the next batch's overlap."""

    account: str
    low: int
    high: int


class MailboxReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema):
        self.path, self.date, self.names = options["path"], options.get("date", "date"), [f.name for f in schema.fields]
        self.overlap = int(float(options.get("overlap_hours", "1")) * 3_600_000_000)
        since = options.get("since")
        self.since = _micros(datetime.datetime.fromisoformat(since)) if since else -(1 << 62)

    def _folder(self, account: str) -> ds.Dataset:
        store, root = fs.FileSystem.from_uri(self.path)
        return ds.dataset(f"{root}/{account}", filesystem=store, format="parquet")

    def _latest(self, account: str) -> int | None:
        """The largest date in the account's files, from their statistics."""
        best = None
        for part in self._folder(account).get_fragments():
            meta = part.metadata
            at = meta.schema.names.index(self.date)
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(at).statistics
                if stats is not None and stats.has_min_max:
                    top = _micros(stats.max.replace(tzinfo=None))
                    best = top if best is None else max(best, top)
        return best

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(root).type == fs.FileType.NotFound:
            return {}
        accounts = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory)
        found = {a: self._latest(a) for a in accounts}
        return {a: v for a, v in found.items() if v is not None}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(a, max(self.since, start[a] - self.overlap - 1) if a in start else self.since, high) for a, high in end.items() if start.get(a) != high]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        at = pc.field(self.date)
        kind = self._folder(partition.account).schema.field(self.date).type
        when = lambda us: pa.scalar(us, pa.timestamp("us")).cast(pa.timestamp("us", kind.tz) if kind.tz else pa.timestamp("us"))
        keep = at <= when(partition.high)
        if partition.low > -(1 << 62):
            keep = keep & (at > when(partition.low))
        for b in self._folder(partition.account).to_batches(columns=[n for n in self.names if n != "account"], filter=keep):
            if b.num_rows:
                columns = [pa.array([partition.account] * b.num_rows, pa.string()) if n == "account" else b.column(n) for n in self.names]
                yield pa.RecordBatch.from_arrays(columns, self.names)


class MailboxSource(DataSource):
    """Options: path; date (column), overlap_hours, since (where an account starts that has no watermark). The schema, given by the reader, may have `account`."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def streamReader(self, schema) -> MailboxReader:
        return MailboxReader(self.options, schema)
