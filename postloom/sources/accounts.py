"""Account strings, folders and attachments as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
SERVERS = {"gmail": ("imap.gmail.com", 993), "yahoo": ("imap.mail.yahoo.com", 993), "outlook": ("outlook.office365.com", 993), "hotmail": ("outlook.office365.com", 993)}
SKIPPED = ("trash", "deleted", "deleted items", "deleted messages", "spam", "junk", "bulk", "drafts", "draft", "[gmail]/trash", "[gmail]/spam", "[gmail]/drafts", "[gmail]/all mail")
SKIPPED_PARTS = ("trash", "spam", "junk", "bulk")
MIME_TYPES = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/msword", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/vnd.ms-powerpoint", "text/plain", "text/csv", "text/html")
EXTENSIONS = (".pdf", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt", ".txt", ".csv", ".log", ".json", ".xml", ".html", ".htm", ".md")


def parse_accounts(rows: DataFrame, column: str = "accounts") -> DataFrame:
    """A row for each `provider:user:secret` between semicolons whose provider is known; secrets may hold colons."""
    spark = rows.sparkSession
    known = F.create_map(*[x for p, (h, port) in SERVERS.items() for x in (F.lit(p), F.struct(F.lit(h).alias("host"), F.lit(port).alias("port")))])
    each = rows.withColumn("entry", F.explode(F.filter(F.transform(F.split(column, ";"), lambda e: F.trim(e)), lambda e: e != "")))
    parts = F.split("entry", ":", 3)
    out = each.withColumn("provider", F.lower(F.trim(F.get(parts, 0)))).withColumn("username", F.trim(F.get(parts, 1))).withColumn("secret", F.get(parts, 2)).withColumn("s", F.try_element_at(known, F.col("provider")))
    return out.where("s is not null and secret is not null").select(*[c for c in rows.columns if c != column], "provider", "username", "secret", "s.host", "s.port")


def identities(rows: DataFrame) -> DataFrame:
    """Distinct addresses of `manual` (comma list) and `accounts`, lower-cased."""
    named = F.split(F.coalesce("manual", F.lit("")), ",")
    users = F.transform(F.split(F.coalesce("accounts", F.lit("")), ";"), lambda e: F.coalesce(F.get(F.split(e, ":"), 1), F.lit("")))
    return rows.select(F.explode(F.transform(F.concat(named, users), lambda a: F.lower(F.trim(a)))).alias("address")).where("address <> ''").distinct()


def kept_folders(rows: DataFrame, folder: str = "folder") -> DataFrame:
    name = F.lower(F.col(folder))
    return rows.where(~name.isin(*SKIPPED) & ~name.rlike("|".join(SKIPPED_PARTS)))


def folder_name(line: Column) -> Column:
    """The last quoted word of a server's folder line, else its last word."""
    quoted = F.regexp_extract(line, r'"([^"]*)"\s*$', 1)
    return F.when(quoted != "", quoted).otherwise(F.regexp_extract(line, r"(\S+)\s*$", 1))


def is_extractable(mime: Column, filename: Column) -> Column:
    ext = F.regexp_extract(F.lower(F.coalesce(filename, F.lit(""))), r"(\.[^.]+)$", 1)
    return F.coalesce(F.lower(mime).isin(*MIME_TYPES), F.lit(False)) | ext.isin(*EXTENSIONS)


def folder_paths(folders: DataFrame, path: str) -> DataFrame:
    """id, path, depth of folders (id, parent, name) from their roots. Each level is a join with the one above, written under `path`, so trees may be of any size and depth. Folders without a root (below a parent that isn't there, or in a circle) are left out."""
    spark, most = folders.sparkSession, folders.count()
    children = folders.where("parent is not null").select("id", "parent", "name")
    level = folders.where("parent is null").select("id", F.col("name").alias("path"), F.lit(1).alias("depth"))
    written: list[str] = []
    while True:
        if len(written) > most:
            raise ValueError("folders lie within themselves: an id below a root is met again")
        written.append(f"{path}/{len(written) + 1}")
        level.write.parquet(written[-1])
        above = spark.read.schema(level.schema).parquet(written[-1])
        if above.isEmpty():
            return spark.read.schema(level.schema).parquet(*written)
        level = children.join(above.withColumnRenamed("id", "parent"), "parent").select("id", F.concat("path", F.lit("/"), "name").alias("path"), (F.col("depth") + 1).alias("depth"))


# Names of a desktop client's own folders, and their numbers there.
DEFAULT_FOLDERS = {"inbox": 6, "sent": 5, "sent items": 5, "outbox": 4, "drafts": 16, "deleted": 3, "deleted items": 3, "junk": 23, "junk email": 23}


def default_folder(name: Column) -> Column:
    """The number of a known folder, in any case; null for others, which are looked up by name."""
    known = F.create_map(*[x for n, k in DEFAULT_FOLDERS.items() for x in (F.lit(n), F.lit(k))])
    return F.try_element_at(known, F.lower(F.trim(name)))


def find_folders(folders: DataFrame, wanted: DataFrame, path: str) -> DataFrame:
    """name, id, path: of each wanted `name` the first folder so called, in any case, in depth-first order (by path, segment by segment). Of all folders of a name one is left before names meet, so a name that many have meets in no one task."""
    named = folder_paths(folders, path).join(folders.select("id", F.lower("name").alias("low")), "id")
    first = named.groupBy("low").agg(F.min(F.struct(F.split("path", "/").alias("at"), "id", "path")).alias("f"))
    return wanted.select("name", F.lower("name").alias("low")).distinct().join(first, "low").select("name", "f.id", "f.path")
