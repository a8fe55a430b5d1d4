"""Secret scans over an incremental ledger of content-addressed blobs, as DataFrame operations.

Each version of a path is a blob, addressed by the SHA-256 of its text. The ledger holds, for each
blob and rule version scanned, the spans found (none included). A scan takes only pairs that the
ledger lacks, adds them, and joins the findings to every path and version that holds the blob.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import stored


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern` whose group `group` has `least` characters or more."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


#: The base kinds and their limits, in order.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: Formats of keys that services and tools hand out publicly.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("host_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = "1"


def matches(text: Column, rule: Rule) -> Column:
    """array<struct<start,end,rank,kind>> in code points, end exclusive: matches alternate with what lies between them, so lengths add up to places."""
    rank = [r.kind for r in RULES].index(rule.kind) if rule in RULES else 99
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    pieces = F.arrays_zip(F.transform(F.slice(between, 1, F.size(whole)), F.length).alias("gap"), F.transform(whole, F.length).alias("n"), F.transform(part, F.length).alias("m"))
    spot = lambda a, b: F.struct(a.alias("start"), b.alias("end"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"))
    none = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        return F.struct((start + p["n"]).alias("at"), F.when(p["m"] >= rule.least, F.concat(acc["found"], F.array(spot(start, start + p["n"])))).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda acc: acc["found"])
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def findings(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of all rules by start, then kind in the order of the rules."""
    return F.array_sort(F.concat(*[matches(text, r) for r in rules]), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))


class Ledger:
    """The ledger in a folder, as versions of parts: each scan appends one, which counts once its success file is there. What a broken scan left is not read, and the next one writes beside it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _parts(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return [f"{self.path}/{n}" for n in sorted(names) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]

    def read(self) -> DataFrame:
        """Each blob and rule version once; two scans that ran side by side may both have found the same."""
        parts = self._parts()
        rows = self.spark.read.schema(LEDGER).parquet(*parts) if parts else self.spark.createDataFrame([], LEDGER)
        return rows.dropDuplicates(["blob", "rule_version"])

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, path: str = "path", text: str = "text") -> DataFrame:
        """Findings by path, as scan() gives them; what was unseen is scanned and committed first."""
        at = f"{self.path}/{uuid.uuid4().hex}"
        _unseen(_versions(versions, path, text), self.read(), rules, rule_version).write.parquet(at)
        return _joined(_versions(versions, path, text), self.read().where(F.col("rule_version") == rule_version))


LEDGER = "blob string, rule_version string, spans array<struct<start:int,end:int,rank:int,kind:string>>"


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings by path: path, blob, spans; new rows of the ledger, written to the shared folder).

    `versions` holds every historical version of every path, one row each. Null texts count as
    empty. Rows of one path repeat if its versions do; a null path is a path. Of equal texts one is
    read by the rules; findings return to all rows. Texts with no findings have an empty list. An empty table gives no rows.
    """
    rows = _versions(versions, path, text)
    new = stored(_unseen(rows, ledger, rules, rule_version), "ledger").dropDuplicates(["blob", "rule_version"])
    known = new if ledger is None else new.unionByName(ledger.where(F.col("rule_version") == rule_version).select(*new.columns))
    return _joined(rows, known), new


def _versions(versions: DataFrame, path: str, text: str) -> DataFrame:
    rows = versions.select(F.col(f"`{path}`").alias("path"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.withColumn("blob", F.sha2("text", 256))


def _unseen(rows: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], rule_version: str) -> DataFrame:
    """Ledger rows of the blobs that the ledger lacks for this rule version."""
    blobs = rows.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    # one row of each blob: its smallest path; more rows of that path and blob are the same text
    unseen = rows.alias("r").join(blobs.alias("b"), F.expr("r.blob = b.blob and r.path <=> b.path"), "left_semi")
    return unseen.select("blob", F.lit(rule_version).alias("rule_version"), findings(F.col("text"), rules).alias("spans"))


def _joined(rows: DataFrame, known: DataFrame) -> DataFrame:
    """path, blob and spans of every row."""
    hits = known.select("blob", "spans").where(F.size("spans") > 0)
    found = rows.select("path", "blob").join(hits, "blob", "left")
    return found.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,rank:int,kind:string>>")))
