"""Mail files (RFC 822) and their attachments as rows, and a mail server as a data source."""

from __future__ import annotations

import email
import email.header
import email.utils
import imaplib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime
from email.message import Message
from html import unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from postloom.sources.accounts import SERVERS, SKIPPED, SKIPPED_PARTS
from postloom.sources.adapters import Pushing, load, pushes

SCHEMA = "path string, message_id string, in_reply_to string, refs array<string>, sender string, sender_name string, recipients_to array<string>, recipients_cc array<string>, subject string, sent_date timestamp_ntz, body_text string, body_html string, importance_header string, attachments array<struct<filename:string,content_type:string,size_bytes:bigint,content:binary>>, invitation struct<summary:string,start:string,end:string,location:string,organizer:string,attendees:array<string>,details:string>, error string"
MOST_ATTACHMENT_BYTES = 25 * 1024 * 1024


def decoded(value: str | None) -> str:
    """Encoded words of a header, joined by spaces."""
    if not value:
        return ""
    parts = [p.decode(c or "utf-8", "replace") if isinstance(p, bytes) else p for p, c in email.header.decode_header(value)]
    return " ".join(x.strip() for x in parts if x.strip())


def addresses(value: str | None) -> list[str]:
    return [a for _, a in email.utils.getaddresses([decoded(value)]) if a]


def _text(part: Message) -> str:
    raw = part.get_payload(decode=True) or b""
    try:
        return raw.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return raw.decode("latin-1")


def calendar_fields(text: str) -> dict:
    """Fields of an invitation, whole; folded lines are joined."""
    out: dict = {"summary": "", "start": "", "end": "", "location": "", "organizer": "", "attendees": [], "details": ""}
    names = {"SUMMARY": "summary", "DTSTART": "start", "DTEND": "end", "LOCATION": "location", "ORGANIZER": "organizer", "DESCRIPTION": "details"}
    for line in re.sub(r"\r?\n[ \t]", "", text).splitlines():
        head, _, value = line.partition(":")
        name = head.split(";")[0].upper()
        value = re.sub(r"(?i)^mailto:", "", value.strip())
        if name == "ATTENDEE":
            out["attendees"].append(value)
        elif name in names and not out[names[name]]:
            out[names[name]] = value.replace("\\n", "\n").replace("\\,", ",")
    return out


def parse(raw: bytes, path: str = "") -> dict:
    """One message; whatever can't be read is in `error`, never raised."""
    row = {"path": path, "refs": [], "recipients_to": [], "recipients_cc": [], "attachments": [], "invitation": None, "error": None, "sent_date": None}
    try:
        m = email.message_from_bytes(raw)
        name, sender = email.utils.parseaddr(decoded(m.get("From")))
        plain = html = ics = None
        for part in m.walk():
            kind, file = part.get_content_type(), decoded(part.get_filename())
            if part.is_multipart():
                continue
            if file or (part.get_content_disposition() or "") == "attachment":
                content = part.get_payload(decode=True) or b""
                row["attachments"].append({"filename": file, "content_type": kind, "size_bytes": len(content), "content": content if len(content) <= MOST_ATTACHMENT_BYTES else None})
            elif kind == "text/plain" and plain is None:
                plain = _text(part)
            elif kind == "text/html" and html is None:
                html = _text(part)
            elif kind == "text/calendar" and ics is None:
                ics = _text(part)
        body = plain if plain is not None else html_text(html) if html else ""
        if ics:
            row["invitation"] = calendar_fields(ics)
            body = f"{body}\n\n{ics}" if body else ics
        try:
            row["sent_date"] = email.utils.parsedate_to_datetime(m.get("Date")).replace(tzinfo=None) if m.get("Date") else None
        except (TypeError, ValueError):
            pass
        row |= {"message_id": (m.get("Message-ID") or "").strip().strip("<>"), "in_reply_to": (m.get("In-Reply-To") or "").strip().strip("<>"), "refs": [x.strip("<>") for x in (m.get("References") or "").split()], "sender": sender, "sender_name": name, "recipients_to": addresses(m.get("To")), "recipients_cc": addresses(m.get("Cc")), "subject": decoded(m.get("Subject")), "body_text": body, "body_html": html or "", "importance_header": m.get("X-Priority") or ""}
    except Exception as e:  # noqa: BLE001  a broken message must not stop a scan of millions
        row["error"] = f"{type(e).__name__}: {e}"
    return {k: row.get(k) for k in _NAMES}


_NAMES = ["path", "message_id", "in_reply_to", "refs", "sender", "sender_name", "recipients_to", "recipients_cc", "subject", "sent_date", "body_text", "body_html", "importance_header", "attachments", "invitation", "error"]


def html_text(html: str) -> str:
    """The rules of functions.text.html_to_text for one string, where mail is parsed in Python."""
    t = re.sub(r"(?is)<!--.*?-->|<(script|style|head|noscript)\b.*?</\1>", " ", html)
    t = re.sub(r"""(?is)<a\b[^>]*href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>""", r"[\2](\1)", t)
    t = re.sub(r"(?i)<br\s*/?>|</?(?:p|div|li|tr|h[1-6]|ul|ol|table|section|article|nav|header|footer)\b[^>]*>", "\n", t)
    t = unescape(re.sub(r"(?s)<[^>]*>", "", t))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", re.sub(r"[ \t\r\f]+", " ", t))).strip()


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """All message files under a path, one row each; unreadable ones have `error`."""
    return parse_column(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def parse_column(files: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([parse(bytes(c or b""), n) for n, c in zip(p["path"], p["content"])], columns=_NAMES)

    return files.mapInPandas(run, SCHEMA)


# --- attachments ----------------------------------------------------------------------------------


def _xml_text(raw: bytes, member: str, paragraph: str, joined: str = "") -> list[str]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        out = []
        for name in sorted((n for n in z.namelist() if re.fullmatch(member, n)), key=lambda n: [int(x) for x in re.findall(r"\d+", n)]):
            root = ElementTree.fromstring(z.read(name))
            out.append("\n".join(t for p in root.iter() if p.tag.endswith("}" + paragraph) and (t := joined.join(x.text or "" for x in p.iter() if x.tag.endswith("}t")))))
        return out


def docx(raw: bytes) -> str:
    return "\n".join(_xml_text(raw, r"word/document\.xml", "p"))


def pptx(raw: bytes) -> str:
    return "\n\n".join(f"[Slide {i}]\n{t}" for i, t in enumerate(_xml_text(raw, r"ppt/slides/slide\d+\.xml", "p"), 1) if t)


def xlsx(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = ["".join(t.text or "" for t in s.iter() if t.tag.endswith("}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        out = []
        for n in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            rows = []
            for row in (e for e in ElementTree.fromstring(z.read(n)).iter() if e.tag.endswith("}row")):
                cells = []
                for c in row:
                    v = next((x.text or "" for x in c.iter() if x.tag.endswith(("}v", "}t"))), "")
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                if any(cells):
                    rows.append(" | ".join(cells))
            out.append(f"[Sheet: {n.rsplit('/', 1)[1][:-4]}]\n" + "\n".join(rows))
        return "\n\n".join(out)


def plain(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def pdf(raw: bytes) -> str:
    from pypdf import PdfReader  # where it is installed

    return "\n".join(t for p in PdfReader(io.BytesIO(raw)).pages if (t := p.extract_text()))


#: What reads each kind; callers may add to it or replace entries.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {".docx": docx, ".pptx": pptx, ".xlsx": xlsx, ".pdf": pdf, ".html": lambda b: html_text(plain(b)), ".htm": lambda b: html_text(plain(b))}
# What is read as plain text.
TEXT_EXTENSIONS = {".txt", ".csv", ".log", ".json", ".xml", ".md"}
BY_MIME = {"application/pdf": ".pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx", "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx", "text/html": ".html"}


def extract_text(filename: str, raw: bytes | None, mime: str = "", extractors: dict[str, Callable[[bytes], str]] = EXTRACTORS) -> str:
    """Text by type, else by extension, else as plain text if the type or extension is one of text; nothing for other, too large or unreadable files."""
    if not raw or len(raw) > MOST_ATTACHMENT_BYTES:
        return ""
    kind, ext = (mime or "").lower(), "." + filename.rsplit(".", 1)[-1].lower() if "." in (filename or "") else ""
    extract = extractors.get(BY_MIME.get(kind, "")) or extractors.get(ext) or (plain if kind.startswith("text/") or ext in TEXT_EXTENSIONS else None)
    if extract is None:
        return ""
    try:
        return extract(raw).strip()
    except Exception:  # noqa: BLE001  a broken attachment has no text
        return ""


def attachment_texts(mail: DataFrame, extractors: dict[str, Callable[[bytes], str]] = EXTRACTORS) -> DataFrame:
    """message_id, filename, text of all attachments."""
    rows = mail.selectExpr("message_id", "inline(attachments)")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"message_id": p["message_id"], "filename": p["filename"], "text": [extract_text(f, bytes(c) if c is not None else None, t, extractors) for f, c, t in zip(p["filename"], p["content"], p["content_type"])]})

    return rows.mapInPandas(run, "message_id string, filename string, text string")


# --- mail servers ---------------------------------------------------------------------------------


class Folder(InputPartition):
    def __init__(self, account: str, folder: str):
        self.account, self.folder = account, folder


class MailServerReader(DataSourceReader):
    """One partition for each account and folder. `connect` (a dotted name in the options, `module:function`, by default IMAP) is called with the options and gives an object with accounts(), folders(account) and fetch(account, folder, since, limit), which yields (date, raw message), newest first.

    Folders of deleted mail, drafts and junk are left out. Other options: accounts and folders
    (comma lists), since, limit (messages of each folder), and push (see adapters.Pushing; servers
    compare by the day).
    """

    date = "date"

    def __init__(self, options: dict):
        self.options = options
        self.since = datetime.fromisoformat(options["since"]) if options.get("since") else None
        self.limit = int(options["limit"]) if options.get("limit") else None

    def _client(self):
        return load(self.options, "postloom.sources.rfc822:ImapClient.from_options")

    def partitions(self) -> list[InputPartition]:
        client = self._client()
        named = lambda k: [x.strip() for x in self.options.get(k, "").split(",") if x.strip()]
        return [Folder(a, f) for a in named("accounts") or client.accounts() for f in named("folders") or client.folders(a) if wanted(f)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        for date, raw in self._client().fetch(partition.account, partition.folder, self.since, self.limit):
            yield (partition.account, partition.folder, date, raw)


def wanted(folder: str) -> bool:
    """The rule of accounts.kept_folders() for one name."""
    low = folder.lower()
    return low not in SKIPPED and not any(part in low for part in SKIPPED_PARTS)


class PushingMailServerReader(Pushing, MailServerReader):
    pass


class MailServer(DataSource):
    """spark.dataSource.register(MailServer); spark.read.format("mail_server").option("connect", ...).option("accounts", "a,b").load(); for IMAP, .option("account_secrets", ...), then parse_column()."""

    @classmethod
    def name(cls) -> str:
        return "mail_server"

    def schema(self) -> str:
        return "account string, folder string, date timestamp_ntz, content binary"

    def reader(self, schema) -> DataSourceReader:
        return (PushingMailServerReader if self.options.get("push") == "true" else MailServerReader)(dict(self.options))


def read_server(spark: SparkSession, **options: str) -> DataFrame:
    """Messages of the accounts of a mail server (see MailServerReader for the options), parsed; `path` names account and folder."""
    spark.dataSource.register(MailServer)
    rows = spark.read.format("mail_server").options(**pushes(spark), **options).load()
    return parse_column(rows.select(F.concat_ws("/", "account", "folder").alias("path"), "content"))


class ImapClient:
    """IMAP over TLS with the standard library: read-only, server-side SINCE, newest first, without marking messages as read."""

    def __init__(self, hosts: dict[str, tuple[str, int, str]], connect: Callable | None = None):
        self.hosts, self.connect = hosts, connect or imaplib.IMAP4_SSL  # account -> host, port, secret

    @staticmethod
    def from_options(options: dict) -> ImapClient:
        """Of the option `account_secrets`, `provider:user:secret;...` (a name that Spark redacts)."""
        hosts = {}
        for entry in options.get("account_secrets", "").split(";"):
            provider, _, rest = entry.strip().partition(":")
            user, _, secret = rest.partition(":")
            if provider.strip().lower() in SERVERS and secret:
                hosts[user.strip()] = (*SERVERS[provider.strip().lower()], secret)
        return ImapClient(hosts)

    def accounts(self) -> list[str]:
        return sorted(self.hosts)

    @contextmanager
    def _open(self, account: str):
        host, port, secret = self.hosts[account]
        c = self.connect(host, port)
        try:
            c.login(account, secret)
            yield c
        finally:
            c.logout()

    def folders(self, account: str) -> list[str]:
        with self._open(account) as c:
            return [(re.findall(r'"([^"]*)"\s*$', x.decode()) or x.decode().split()[-1:])[0] for x in c.list()[1]]

    def fetch(self, account: str, folder: str, since: datetime | None, limit: int | None) -> Iterator[tuple[datetime | None, bytes]]:
        with self._open(account) as c:
            c.select(f'"{folder}"', readonly=True)
            _, found = c.search(None, *(["SINCE", since.strftime("%d-%b-%Y")] if since else ["ALL"]))
            for n in found[0].split()[::-1][:limit]:
                head, raw = c.fetch(n, "(INTERNALDATE BODY.PEEK[])")[1][0]
                at = imaplib.Internaldate2tuple(head)
                yield datetime(*at[:6]) if at else None, raw
