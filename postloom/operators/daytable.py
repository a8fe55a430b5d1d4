"""A table of dated rows by day: what changes is written, the rest stays where it is.

A version is a manifest that names, for each write, the days it holds. Rows are never rewritten in
place: a removal writes the keys that go, a change writes these and the rows as they are now, and both
are merged where the days concerned are read. Retention leaves whole days out of the manifest and opens
only the day that it cuts. Of two writers that start from one version, one gets a Conflict; what the
other has written is in no version, and vacuum() deletes it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from postloom.operators import ingest
from postloom.operators.manifest import Manifest

#: The day of rows without a date.
UNDATED = "none"
#: Parts of a day from which compact() makes one.
TIER = 8


@dataclass(frozen=True)
class DayTable:
    """One version. `content`: schema, key, date (or null), and the parts (name, seq, days with their number of rows) of rows and of removed keys. Rows of one key may be several; remove() and update_flags() leave rows without a key alone, retain() doesn't."""

    spark: SparkSession
    path: str
    version: int
    content: dict

    @staticmethod
    def create(rows: DataFrame, path: str, key: str, date: str | None = "date") -> DayTable:
        """A table of these rows in the folder `path`, which has none yet. An empty table has no parts; without a date column all rows are of one day."""
        content = {"schema": rows.schema.jsonValue(), "key": key, "date": date, "rows": [], "gone": [], "seq": 0}
        none = DayTable(rows.sparkSession, path.rstrip("/"), -1, content)
        return none._commit([none._part("rows", rows, 0)], [])

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> DayTable:
        at, content = Manifest(spark, f"{path.rstrip('/')}/versions").read(version)
        if at < 0:
            raise FileNotFoundError(f"{path}: no table")
        return DayTable(spark, path.rstrip("/"), at, content)

    # --- writing ----------------------------------------------------------------------------------

    def _day(self) -> Column:
        date = self.content["date"]
        return F.coalesce(F.col(date).cast("date").cast("string"), F.lit(UNDATED)) if date else F.lit(UNDATED)

    def _part(self, kind: str, rows: DataFrame, seq: int) -> dict:
        """Writes rows, or keys with their day, by day; nothing but the number of rows of each day comes back."""
        name = f"{seq:010d}-{uuid.uuid4().hex}"
        at = f"{self.path}/{kind}/stored_part={name}"
        (rows.withColumn("stored_day", self._day()) if kind == "rows" else rows).write.partitionBy("stored_day").parquet(at)
        if not Manifest(self.spark, at).subfolders():
            return {"name": name, "seq": seq, "days": {}}
        columns = self._schema() if kind == "rows" else StructType([self._schema()[self.content["key"]]])
        days = self.spark.read.schema(StructType([*columns, *_PLACE])).option("basePath", f"{self.path}/{kind}").parquet(at).groupBy("stored_day").count()
        return {"name": name, "seq": seq, "days": {r["stored_day"]: r["count"] for r in days.collect()}}  # a row a day

    def _commit(self, rows: list[dict], gone: list[dict]) -> DayTable:
        """The version with more parts, whose sequence number is the next."""
        parts = {"rows": [*self.content["rows"], *rows], "gone": [*self.content["gone"], *gone]}
        return self._as(parts, self.content["seq"] + 1)

    def _as(self, parts: dict, seq: int) -> DayTable:
        content = self.content | {k: [p for p in v if p["days"]] for k, v in parts.items()} | {"seq": seq}
        return replace(self, version=Manifest(self.spark, f"{self.path}/versions").commit(self.version, content), content=content)

    def append(self, rows: DataFrame) -> DayTable:
        """All rows, known keys or not."""
        return self._commit([self._part("rows", rows.select(*self._schema().names), self.content["seq"])], [])

    def insert(self, rows: DataFrame) -> DayTable:
        """One row of each key that the table lacks, the smallest by its values."""
        return self.append(ingest.insert_new(self.read(), rows.select(*self._schema().names), self.content["key"]))

    def _without(self, gone: DataFrame, instead: DataFrame | None = None) -> DayTable:
        """The version without the keys of some of its rows, and with other rows in their place."""
        seq = self.content["seq"]
        keys = self._part("gone", gone.select(self.content["key"], self._day().alias("stored_day")).distinct(), seq)
        if not keys["days"]:
            return self
        return self._commit([self._part("rows", instead, seq)] if instead is not None else [], [keys])

    def remove(self, keys: DataFrame) -> DayTable:
        """Without the rows of these keys. A key that is appended later counts again."""
        return self._without(self._of(keys))

    def update_flags(self, news: DataFrame) -> DayTable:
        """Flags by key as `ingest.update_flags` sets them; only keys with a row that changes are written."""
        key = self.content["key"]
        was = self._of(news)
        now = ingest.update_flags(was, news, key)
        flags = [F.col(f) for f in ingest.FLAGS]
        old, new = (t.groupBy(key).agg(F.sort_array(F.collect_set(F.struct(*flags))).alias("f")) for t in (was, now))
        changed = old.alias("o").join(new.alias("n"), key).where("not (o.f <=> n.f)").select(key)
        return self._without(was.join(changed, key, "left_semi"), now.join(changed, key, "left_semi"))

    def _of(self, keys: DataFrame) -> DataFrame:
        key = self.content["key"]
        return self.read().join(keys.select(key).distinct(), key, "left_semi")

    def retain(self, now: str, days: int) -> DayTable:
        """As `ingest.retain`: undated rows stay. Earlier days are left out unread; of the day that is cut, the keys of earlier rows go. A key (or null) with an earlier and a later row on that day keeps the later."""
        cut = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
        day = self.spark.range(1).select(cut.cast("date").cast("string")).first()[0]
        kept = {k: [p | {"days": {d: n for d, n in p["days"].items() if d == UNDATED or d >= day}} for p in self.content[k]] for k in ("rows", "gone")}
        table = self if kept == {k: self.content[k] for k in kept} else self._as(kept, self.content["seq"])
        edge, key, date = table.read([day]), self.content["key"], F.col(self.content["date"])
        early = edge.where(date < cut)
        keys = early.select(F.col(key).alias("gone_key")).distinct()
        return table._without(early, edge.where(date >= cut).join(keys, F.col(key).eqNullSafe(F.col("gone_key")), "left_semi"))

    def compact(self, tier: int = TIER) -> DayTable:
        """Days with removed keys, or of `tier` parts and more, become one part each."""
        parts: dict[str, int] = {}
        for p in self.content["rows"]:
            for d in p["days"]:
                parts[d] = parts.get(d, 0) + 1
        dirty = {d for p in self.content["gone"] for d in p["days"]} | {d for d, n in parts.items() if n >= tier}
        if not dirty:
            return self
        made = self._part("rows", self.read(sorted(dirty)), self.content["seq"])
        rest = [p | {"days": {d: n for d, n in p["days"].items() if d not in dirty}} for p in self.content["rows"]]
        return self._as({"rows": [*rest, made], "gone": []}, self.content["seq"] + 1)

    def vacuum(self, versions: int = 1) -> DayTable:
        """Deletes the files of days that none of the last versions names. No other writer may be at work."""
        manifest = Manifest(self.spark, f"{self.path}/versions")
        named = {(k, p["name"], d) for v in manifest.versions()[-versions:] for k in ("rows", "gone") for p in manifest.read(v)[1][k] for d in p["days"]}
        for kind in ("rows", "gone"):
            for part in Manifest(self.spark, f"{self.path}/{kind}").subfolders():
                folder = Manifest(self.spark, f"{self.path}/{kind}/{part}")
                for day in folder.subfolders():
                    if (kind, part.removeprefix("stored_part="), day.removeprefix("stored_day=")) not in named:
                        folder.delete(day)
        return self

    # --- reading ------------------------------------------------------------------------------------

    def _schema(self) -> StructType:
        return StructType.fromJson(self.content["schema"])

    def _read(self, kind: str, schema: StructType, days: set[str]) -> DataFrame | None:
        """Rows of these days, with `stored_part` and `stored_day`; only the folders of the days are listed."""
        at = [f"{self.path}/{kind}/stored_part={p['name']}/stored_day={d}" for p in self.content[kind] for d in p["days"] if d in days]
        if not at:
            return None
        return self.spark.read.schema(StructType([*schema, *_PLACE])).option("basePath", f"{self.path}/{kind}").parquet(*at)

    def days(self) -> set[str]:
        return {d for p in self.content["rows"] for d in p["days"]}

    def read(self, days: list[str] | None = None) -> DataFrame:
        """The rows, of some days (`yyyy-MM-dd`, or UNDATED) if given. Days without removed keys are read without a join."""
        schema, key = self._schema(), self.content["key"]
        wanted = self.days() if days is None else self.days() & set(days)
        dirty = wanted & {d for p in self.content["gone"] for d in p["days"]}
        clean, merged = self._read("rows", schema, wanted - dirty), self._read("rows", schema, dirty)
        found = [] if clean is None else [clean]
        if merged is not None:
            seq = F.substring("stored_part", 1, 10)
            gone = self._read("gone", StructType([schema[key]]), dirty).groupBy(F.col(key).alias("gone_key"), F.col("stored_day").alias("gone_day")).agg(F.max(seq).alias("gone_seq"))
            found.append(merged.join(gone, F.col(key).eqNullSafe(F.col("gone_key")) & (F.col("stored_day") == F.col("gone_day")) & (seq < F.col("gone_seq")), "left_anti"))
        none = self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, [f.select(*schema.names) for f in found]) if found else none


_PLACE = StructType().add("stored_part", StringType()).add("stored_day", StringType())
