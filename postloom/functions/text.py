"""Text of messages: column in, column out, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What begins a signature, a legal footer, or quoted history; long addresses, header lines, and words.
SIGNATURES = (r"--\s*$", r"_{3,}", r"-{3,}", r"(?i:Sent from my (?:iPhone|iPad|Galaxy|Android|BlackBerry))", r"(?i:Sent from (?:Mail|Outlook|Yahoo) for)", r"(?i:Get Outlook for)", r"(?i:Sent from Outlook$)", r"(?i:Sent via)")
DISCLAIMERS = (
    r"^(?:CONFIDENTIALITY|DISCLAIMER|LEGAL NOTICE|PRIVILEGED)",
    r"This (?:e-?mail|message|communication) (?:and any|is|may) (?:attachments?|intended|contain)",
    r"(?:intended solely|authorized recipient|not intended for)",
    r"(?:may contain (?:confidential|privileged)|if you (?:are not|have received) (?:the intended|this))",
    r"(?:please (?:notify|delete|disregard)|do not (?:copy|distribute|forward|disseminate))",
    r"(?:unsubscribe|opt.out|email preferences|manage.{0,10}subscription)",
)
SIGNATURE = "^(?:" + "|".join(SIGNATURES) + ")"
DISCLAIMER = "(?i)(?:" + "|".join(DISCLAIMERS) + ")"
WROTE = r"(?im)^On\s+(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|\d).{10,120}wrote:[ \t]*$"
FORWARDED = r"(?im)^-{2,}[ \t]*(?:Forwarded message|Original Message)[ \t]*-{2,}[ \t]*$"
LONG_URL = r"(?m)^https?://\S{50,}$"
HEADER = r"^(?:From|To|Subject|Date|Folder):"
TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_\-.]*[\p{L}\p{N}_])?"


def strip(c: Column) -> Column:
    """Without the white space (what `\\s` matches) at both ends."""
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def bind(value: Column, shape: Callable[[Column], Column]) -> Column:
    """`shape` of a value that is computed once: columns in lambdas are computed wherever they are named."""
    return F.get(F.transform(F.array(value), shape), 0)


def lines_of(c: Column) -> Column:
    return F.split(c, "\n", -1)


def _first(lines: Column, test) -> Column:
    """Place from 1 of the first line that passes, or one past the end."""
    at = F.array_position(F.transform(lines, test), True)
    return F.when(at > 0, at).otherwise(F.size(lines).cast("long") + 1).cast("int")


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def clean_text(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), LONG_URL, "")
    t = F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    return strip(F.array_join(F.transform(lines_of(t), strip), "\n"))


def strip_boilerplate(text: Column) -> Column:
    """struct<body, signature, disclaimer>: the first footer line takes all that follows, the first signature line the rest before it."""
    part = lambda lines, a, n: F.array_join(F.slice(lines, a, n), "\n")

    def cut(lines: Column, footer: Column, sign: Column) -> Column:
        return F.struct(part(lines, F.lit(1), sign - 1).alias("body"), part(lines, sign, footer - sign).alias("signature"), part(lines, footer, F.size(lines) - footer + 1).alias("disclaimer"))

    def below(lines: Column) -> Column:
        sign = lambda footer: _first(F.slice(lines, F.lit(1), footer - 1), lambda x: strip(x).rlike(SIGNATURE))
        return bind(_first(lines, lambda x: strip(x).rlike(DISCLAIMER)), lambda footer: bind(sign(footer), lambda at: cut(lines, footer, at)))

    return bind(lines_of(F.coalesce(text, F.lit(""))), below)


def _cut_at(body: Column) -> Column:
    """Place from 1 at which quoted history begins, 0 if none: an attribution line, else a forward header, else two quoted lines in a row."""
    place = lambda found, otherwise: F.when(found != "", F.instr(body, found)).otherwise(otherwise)
    quoted = bind(F.regexp_extract(body, r"(?:^|\n)([^\S\n]*>[^\n]*\n[^\S\n]*>)", 1), lambda q: F.when(q == "", F.lit(0)).when(body.startswith(q), F.lit(1)).otherwise(F.instr(body, F.concat(F.lit("\n"), q)) + 1))
    return bind(F.regexp_extract(body, WROTE, 0), lambda w: place(w, bind(F.regexp_extract(body, FORWARDED, 0), lambda f: place(f, quoted))))


def segment(text: Column) -> Column:
    """struct<fresh, quoted, signature, disclaimer, original_length, cleaned_length>."""

    def parts(s: Column) -> Column:
        return bind(s["body"], lambda body: bind(_cut_at(body), lambda at: made(s, body, at)))

    def made(s: Column, body: Column, at: Column) -> Column:
        fresh = clean_text(F.when(at > 0, F.regexp_replace(F.substr(body, F.lit(1), at - 1), r"\s+$", "")).otherwise(body))
        quoted = clean_text(F.when(at > 0, F.substr(body, at)).otherwise(F.lit("")))
        return bind(fresh, lambda f: F.struct(f.alias("fresh"), quoted.alias("quoted"), strip(s["signature"]).alias("signature"), strip(s["disclaimer"]).alias("disclaimer"), F.length(F.coalesce(text, F.lit(""))).alias("original_length"), F.length(f).alias("cleaned_length")))

    return bind(strip_boilerplate(text), parts)


def split_header_body(document: Column) -> Column:
    """struct<header, body>: header lines up to the first blank line, which goes, or the first other line, which stays."""
    def at(lines: Column, stop: Column) -> Column:
        blank = (strip(F.get(lines, stop - 1)) == "") & (stop > 1)
        head = F.when(stop > 0, F.slice(lines, F.lit(1), stop - 1)).otherwise(lines)
        rest = F.when(stop == 0, lines).when(blank, F.slice(lines, stop + 1, F.size(lines))).otherwise(F.slice(lines, F.greatest(stop, F.lit(1)), F.size(lines)))
        return F.struct(F.array_join(head, "\n").alias("header"), F.array_join(rest, "\n").alias("body"))

    stop = lambda lines: F.array_position(F.transform(lines, lambda x, i: ((strip(x) == "") & (i > 0)) | ~x.rlike(HEADER)), True).cast("int")
    return bind(lines_of(F.coalesce(document, F.lit(""))), lambda lines: bind(stop(lines), lambda s: at(lines, s)))


def pack_paragraphs(text: Column, most: int) -> Column:
    """Chunks of whole paragraphs, packed greedily up to `most` characters; one long paragraph is not split."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, p: Column) -> Column:
        full = (F.length(acc["now"]) + F.length(p) + 2 > most) & (acc["now"] != "")
        joined = F.when(acc["now"] != "", F.concat(acc["now"], F.lit("\n\n"), p)).otherwise(p)
        return F.struct(F.when(full, F.array_append(acc["done"], strip(acc["now"]))).otherwise(acc["done"]).alias("done"), F.when(full, p).otherwise(joined).alias("now"))

    packed = lambda t: F.aggregate(F.split(t, "\n\n", -1), start, step, lambda acc: F.when(strip(acc["now"]) != "", F.array_append(acc["done"], strip(acc["now"]))).otherwise(acc["done"]))
    return bind(text, lambda t: F.when(F.length(t) <= most, F.array(t)).otherwise(packed(t)))


def attachment_sections(document: Column) -> Column:
    """array<struct<name, text>> of `[Attachment: name]` sections with text."""
    parts = F.slice(F.split(F.coalesce(document, F.lit("")), r"\[Attachment: ", -1), 2, 1_000_000)
    closed = F.filter(parts, lambda p: F.instr(p, "]") > 0)

    def section(p: Column) -> Column:
        after = F.substr(p, F.instr(p, "]") + 1)
        text = F.when(F.instr(after, "\n") > 0, F.substr(after, F.instr(after, "\n") + 1)).otherwise(after)
        return F.struct(F.substring_index(p, "]", 1).alias("name"), strip(text).alias("text"))

    return F.filter(F.transform(closed, section), lambda s: s["text"] != "")


def first_line(document: Column, most: int = 120) -> Column:
    useful = F.filter(F.transform(lines_of(F.coalesce(document, F.lit(""))), strip), lambda x: (x != "") & ~x.rlike(HEADER) & ~x.startswith(">"))
    return F.coalesce(F.substr(F.get(useful, 0), F.lit(1), F.lit(most)), F.lit(""))


def normalize_subject(subject: Column) -> Column:
    """Without one reply or forward mark, of the spellings listed."""
    return strip(F.regexp_replace(F.coalesce(subject, F.lit("")), r"^(?:RE:|Re:|FW:|Fwd:|re:|fw:)\s*", ""))


def normalize_body(body: Column) -> Column:
    """The whole body in lower case, with single spaces and without what phones add."""
    t = F.regexp_replace(F.lower(F.coalesce(body, F.lit(""))), r"\s+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"sent from my [\p{L}\p{N}_]+", ""), r"get outlook for [\p{L}\p{N}_]+", "")
    return strip(t)


def body_hash(body: Column) -> Column:
    """16 hex digits, null for blank bodies."""
    n = normalize_body(body)
    return F.when(n != "", F.substring(F.sha2(n, 256), 1, 16))


def html_to_text(html: Column, links: bool = True) -> Column:
    """Readable text of an HTML page; with `links`, anchors become [text](address)."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style|head|noscript)\b.*?</\1>", " ")
    if links:
        t = F.regexp_replace(t, r"""(?is)<a\b[^>]*href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>""", "[$2]($1)")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</?(?:p|div|li|tr|h[1-6]|ul|ol|table|section|article|nav|header|footer)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\r\f]+", " "), r" ?\n ?", "\n")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def decode_text(raw: Column) -> Column:
    """UTF-8 where the bytes are, else Latin-1, which any bytes are."""
    return F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))
