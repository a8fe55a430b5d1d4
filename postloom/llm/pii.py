"""Format-preserving pseudonyms for personal data, as DataFrame operations.

A value becomes slots, each a number below a radix; an alternating Feistel network over the two
halves of the slots permutes them under a key, and the slots are written back in the value's own
format. The network is a bijection of the values of one kind: equal values stay equal and
different ones different across all documents, and who holds the key can undo it. Separators,
country codes and prefixes are no slots, so a value keeps its pseudonym in every layout.

The key reaches the plan as a scalar subquery over a row of its own, so that plans, event logs and
the UI don't show it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: The days of 1901 to 2099 are 108 times 673, so two slots name each day and each name is a day.
FIRST_DAY, DAY_RADICES = "1901-01-01", (108, 673)
#: Those of them from the 13th of a month on are 36 times 1223, in 2388 months.
LATE_RADICES, MONTHS = (36, 1223), 2388
#: Characters of an IBAN by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _call(shape: Callable[[Column], Column], value: Column) -> Column:
    """`value` bound to a lambda variable, so that what `shape` makes of it is computed once."""
    return F.get(F.transform(F.array(value), shape), 0)


def _slot(v: Column, m: Column | int, base: Column | int) -> Column:
    as_int = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    return F.struct(v.cast("long").alias("v"), as_int(m).alias("m"), as_int(base).alias("base"))


#: A key: a column in queries, or a plain string.
Key = Column | str


def secret(spark: SparkSession, key: Key) -> Column:
    """The key as a scalar subquery, whose value plans don't show."""
    return spark.createDataFrame([(key,)], "key string").scalar()


def feistel(slots: Column, key: Key, tweak: str) -> Column:
    """The slots with v permuted; each v stays below its m. Even rounds change the first half by the second, odd rounds the second by the first."""
    half = F.ceil(F.size(slots) / 2).cast("int")
    key = key if isinstance(key, Column) else F.lit(key)

    def shifted(part: Column, other: Column, r: Column) -> Column:
        seed = F.concat_ws("|", key, F.lit(tweak), r.cast("string"), F.array_join(F.transform(other, lambda s: s["v"].cast("string")), ","))
        return F.transform(part, lambda s, i: _slot((s["v"] + F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")), 256), 1, 12), 16, 10).cast("long")) % s["m"], s["m"], s["base"]))

    def step(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(F.when(even, shifted(acc["a"], acc["b"], r)).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(shifted(acc["b"], acc["a"], r)).alias("b"))

    start = F.struct(F.slice(slots, F.lit(1), half).alias("a"), F.slice(slots, half + 1, F.size(slots)).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))


def _char_slot(c: Column) -> Column:
    """A digit, a lower-case or an upper-case letter moves within its kind; what else is there stays."""
    code = F.ascii(c)
    return F.when(c.rlike("[0-9]"), _slot(code - 48, 10, 48)).when(c.rlike("[a-z]"), _slot(code - 97, 26, 97)).when(c.rlike("[A-Z]"), _slot(code - 65, 26, 65)).otherwise(_slot(F.lit(0), 1, code))


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _written(slots: Column) -> Column:
    return F.array_join(F.transform(slots, lambda s: F.char(s["base"] + s["v"])), "")


def _laid_out(m: Column, kept: str, chars: Column) -> Column:
    """`m` with its characters of the class `kept` replaced by `chars`, one by one."""
    return F.array_join(F.zip_with(F.split(m, kept, -1), chars, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a digit string whose last digit is the check digit."""
    return F.aggregate(_chars(F.reverse(digits)), F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")), lambda acc, c: F.struct((acc["i"] + 1).alias("i"), (acc["s"] + F.when(acc["i"] % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).alias("s")), lambda acc: acc["s"])


#: Mail providers, whose domains name nobody.
PROVIDERS = "aol.com fastmail.com free.fr gmail.com gmx.de gmx.net googlemail.com hotmail.com icloud.com laposte.net live.com mail.ru me.com msn.com orange.fr outlook.com proton.me protonmail.com qq.com t-online.de web.de yahoo.com yandex.ru"
#: Labels that make a public suffix together with a country's two letters.
SECOND_LEVEL = "ac|co|com|edu|gob|gov|mil|ne|net|nom|or|org"


def _email(m: Column, key: Key) -> Column:
    """The local part and the domain's labels before its public suffix are permuted, each for itself; domains of mail providers stay. Domains differing in case only get one pseudonym."""
    permuted = lambda part, tweak: _written(feistel(F.transform(_chars(part), _char_slot), key, tweak))
    local, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    own = F.regexp_extract(host, rf"(?i)^(.+?)(?:\.(?:{SECOND_LEVEL})(?=\.[a-z]{{2}}$))?\.[a-z]{{2,24}}$", 1)
    moved = F.when(F.lower(host).isin(PROVIDERS.split()), host).otherwise(F.concat(permuted(own, "host"), F.substr(host, F.length(own) + 1)))
    return F.concat(permuted(local, "email"), F.lit("@"), moved)


def _card(m: Column, key: Key) -> Column:
    """The first digit and the separators stay; the digits between are permuted and the check digit fits them."""

    def moved(digits: Column) -> Column:
        body = F.substr(digits, F.lit(2), F.length(digits) - 2)
        return F.concat(F.substring(digits, 1, 1), _written(feistel(F.transform(_chars(body), _char_slot), key, "card")))

    checked = lambda x: F.concat(x, ((10 - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string"))
    return _laid_out(m, "[0-9]", _chars(_call(checked, _call(moved, F.regexp_replace(m, "[^0-9]", "")))))


def _mod97(text: Column) -> Column:
    """The remainder of ISO 7064: letters count as 10 to 35."""
    return F.aggregate(_chars(text), F.lit(0), lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97)


def _is_iban(m: Column) -> Column:
    plain = F.regexp_replace(m, "[^0-9A-Z]", "")
    return F.substr(plain, F.lit(3), F.lit(2)).between("02", "98") & (_mod97(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))) == 1)


def _iban(m: Column, key: Key) -> Column:
    """The country and the separators stay; the account's characters are permuted and the check digits fit them."""
    country = F.substring(m, 1, 2)
    account = _written(feistel(F.transform(_chars(F.regexp_replace(F.substr(m, F.lit(5)), "[^0-9A-Z]", "")), _char_slot), key, "iban"))
    checked = lambda x: F.concat(country, F.lpad((98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x)
    return _laid_out(m, "[0-9A-Z]", _chars(_call(checked, account)))


#: Country codes of one and two digits; others have three.
COUNTRY_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}"


def _phone(m: Column, key: Key) -> Column:
    """The country code and a leading or bracketed 0 stay, so a number keeps its pseudonym with and without them. A first digit stays 2 to 9, or itself; in North American numbers area and exchange stay in 0 to 1 or 2 to 9."""
    code = F.regexp_extract(m, rf"^(?:(?:\+|00)(?:{COUNTRY_CODES})(?:[ .-]?\(0\))?|\(?0)", 0)

    def moved(digits: Column) -> Column:
        american = code.isin("", "+1", "001") & (F.length(digits) == 10)

        def slot(c: Column, i: Column) -> Column:
            lead = (i == 0) | (american & (i == 3))
            return F.when(lead & c.rlike("[2-9]"), _slot(F.ascii(c) - 50, 8, 50)).when(lead & american, _slot(F.ascii(c) - 48, 2, 48)).when(lead, _slot(F.lit(0), 1, F.ascii(c))).otherwise(_char_slot(c))

        return F.transform(feistel(F.transform(_chars(digits), slot), key, "phone"), lambda s: F.char(s["base"] + s["v"]))

    rest = F.substr(m, F.length(code) + 1)
    return F.concat(code, _laid_out(rest, "[0-9]", _call(moved, F.regexp_replace(rest, "[^0-9]", ""))))


def _ssn(m: Column, key: Key) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(i)).cast("int") for i in (1, 2, 3))
    slots = F.array(_slot(F.when(area > 666, area - 2).otherwise(area - 1), 898, 0), _slot(group - 1, 99, 0), _slot(serial - 1, 9999, 0))
    return _call(lambda s: F.format_string("%03d-%02d-%04d", F.when(s[0]["v"] >= 665, s[0]["v"] + 2).otherwise(s[0]["v"] + 1), s[1]["v"] + 1, s[2]["v"] + 1), feistel(slots, key, "ssn"))


def _address(m: Column, key: Key) -> Column:
    """A first octet of 1 to 223 stays in that range; others stay as they are."""
    slots = F.transform(F.split(m, r"\."), lambda o, i: F.when((i == 0) & o.cast("int").between(1, 223), _slot(o.cast("int") - 1, 223, 1)).when(i == 0, _slot(F.lit(0), 1, o.cast("int"))).otherwise(_slot(o.cast("int"), 256, 0)))
    return F.array_join(F.transform(feistel(slots, key, "address"), lambda s: (s["base"] + s["v"]).cast("string")), ".")


def _day(m: Column, pattern: str) -> Column:
    return F.try_to_timestamp(m, F.lit(pattern)).cast("date")


def _from_first(day: Column) -> Column:
    return F.date_diff(day, F.lit(FIRST_DAY).cast("date"))


def _written_day(days: Column, m: Column, pattern: str) -> Column:
    """The day so many days after the first one, as `m` is written: with one-digit days and months if it has one."""
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), days.cast("int"))
    return F.when(m.rlike(r"(?<!\d)\d(?!\d)"), F.date_format(day, pattern)).otherwise(F.date_format(day, pattern.replace("d", "dd").replace("M", "MM")))


def _date(pattern: str) -> Callable[[Column, Key], Column]:
    def moved(m: Column, key: Key) -> Column:
        day = _from_first(_day(m, pattern))
        high, low = DAY_RADICES
        slots = F.array(_slot(F.floor(day / low), high, 0), _slot(day % low, low, 0))
        return _call(lambda s: _written_day(s[0]["v"] * low + s[1]["v"], m, pattern), feistel(slots, key, "date"))

    return moved


def _late_date(pattern: str) -> Callable[[Column, Key], Column]:
    """Days from the 13th on, permuted among themselves: with the month first, no other day is read so, and what comes out must not be read with the day first."""

    def begin(month: Column) -> Column:
        return _from_first(F.add_months(F.lit(FIRST_DAY).cast("date"), month)) - 12 * month

    def moved(m: Column, key: Key) -> Column:
        day = _day(m, pattern)
        rank = _from_first(day) - 12 * (12 * (F.year(day) - 1901) + F.month(day))
        high, low = LATE_RADICES
        slots = F.array(_slot(F.floor(rank / low), high, 0), _slot(rank % low, low, 0))

        def written(n: Column) -> Column:
            near = F.floor(n * MONTHS / (high * low)).cast("int")
            month = F.array_max(F.filter(F.array(near - 1, near, near + 1), lambda x: begin(x) <= n))
            return _written_day(n + 12 * (month + 1), m, pattern)

        return _call(written, _call(lambda s: s[0]["v"] * low + s[1]["v"], feistel(slots, key, "late_date")))

    return moved


def _is_date(pattern: str) -> Callable[[Column], Column]:
    return lambda m: F.coalesce(_day(m, pattern).between(F.lit(FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date")), F.lit(False))


def _slash_date(m: Column, key: Key) -> Column:
    """Day first where that is a date, else month first."""
    return F.when(_is_date("d/M/yyyy")(m), _date("d/M/yyyy")(m, key)).otherwise(_late_date("M/d/yyyy")(m, key))


def _iban_pattern() -> str:
    def account(n: int) -> str:
        return f"(?:[ -]?[A-Z0-9]{{4}}){{{n // 4}}}" + (f"[ -]?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")

    return r"(?<!\w)(?=[A-Z]{2}\d)(?:" + "|".join(f"(?:{names.replace(' ', '|')})\\d{{2}}{account(n - 4)}" for n, names in IBAN_LENGTHS.items()) + r")(?!\w)"


#: North America; France and Spain, whose groups tell where a number ends; other country codes, 6 to 12 digits behind them; then national forms: France, Spain, and area codes with a leading 0.
PHONES = (
    r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}",
    r"(?:\+|00)33[ .-]?(?:\(0\)[ .-]?)?[1-9](?:[ .-]?\d{2}){4}",
    r"(?:\+|00)34[ .-]?[1-9]\d{2}(?:(?:[ .-]?\d{2}){3}|(?:[ .-]?\d{3}){2})",
    r"\+[1-9]\d{9,14}",
    r"\+(?!1[ .(-])\d{2,3}[ -]?\d{2,4}[ -]?\d{3,4}(?:[ -]?\d{2,4})?(?![ ./-]?\d)",
    r"(?:\+[1-9]\d{0,2}[ .-]?|00[1-9]\d{0,2}[ .-])(?:\(\d{1,4}\)[ .-]?)?\d(?:[ ./-]?\d){5,11}",
    r"\(\d{3}\) ?\d{3}-\d{4}",
    r"\d{3}[.-]\d{3}[.-]\d{4}",
    r"[2-9]\d{2} [2-9]\d{2} \d{4}",
    r"\([2-9]\d{2}\) ?\d{3} \d{4}",
    r"0[1-9](?:[ .-]\d{2}){4}",
    r"[2-9]\d{2}(?:[ .-]\d{2}){3}",
    r"(?:\(0[1-9]\d{1,4}\) ?|0[1-9]\d{1,4}[ /-])(?:\d{5,8}(?:-\d{1,4})?|\d{2,4}(?: \d{2,4}){1,3})",
)


@dataclass(frozen=True)
class Kind:
    """A kind of value: what finds it in text, what else must hold of a match, how it is permuted."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    permute: Callable[[Column, Key], Column]


_TRUE = lambda m: F.lit(True)
KINDS = (
    Kind("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])", _TRUE, _email),
    Kind("phone", rf"(?<![\w+])(?:{'|'.join(PHONES)})(?![\w])", _TRUE, _phone),
    Kind("card", r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])", lambda m: luhn_sum(F.regexp_replace(m, "[^0-9]", "")) % 10 == 0, _card),
    Kind("iban", _iban_pattern(), _is_iban, _iban),
    Kind("ssn", r"(?<![\w.+-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])", _TRUE, _ssn),
    Kind("address", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)", _TRUE, _address),
    Kind("date_iso", r"(?<![\w.-])\d{4}-\d{1,2}-\d{1,2}(?![\w-])", _is_date("yyyy-M-d"), _date("yyyy-M-d")),
    Kind("date_dots", r"(?<![\w.])\d{1,2}\.\d{1,2}\.\d{4}(?![\w]|\.\d)", _is_date("d.M.yyyy"), _date("d.M.yyyy")),
    Kind("date_slash", r"(?<![\w/])\d{1,2}/\d{1,2}/\d{4}(?![\w/])", lambda m: _is_date("d/M/yyyy")(m) | _is_date("M/d/yyyy")(m), _slash_date),
)


def any_kind(kinds: tuple[Kind, ...] = KINDS) -> str:
    """One pattern for all kinds; groups that a kind refers back to are renumbered."""
    out, groups = [], 0
    for k in kinds:
        body = k.pattern.replace(r"\1", f"\\{groups + 1}") if r"\1" in k.pattern else k.pattern
        groups += r"\1" in k.pattern
        out.append(f"(?:{body})")
    return "|".join(out)


def _found(docs: DataFrame, key: str, kinds: tuple[Kind, ...], text: str) -> DataFrame:
    """r (the row as it was), t (its text), f (null, or gaps between matches, and for each match its kind or null and what stands in its place)."""
    pattern = any_kind(kinds)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col(f"`{text}`").alias("t"), secret(docs.sparkSession, key).alias("key"))

    def moved(m: Column) -> Column:
        out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("out"))
        for k in reversed(kinds):
            out = F.when(m.rlike(f"^(?:{k.pattern})$") & k.valid(m), F.struct(F.lit(k.name).alias("kind"), k.permute(m, F.col("key")).alias("out"))).otherwise(out)
        return out

    t = F.col("t")
    found = F.when(t.rlike(pattern), F.struct(F.split(t, pattern, -1).alias("gaps"), F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), moved).alias("values")))
    return rows.select("r", "t", found.alias("f"))


def _rebuilt() -> Column:
    parts = F.zip_with("f.gaps", F.transform("f.values", lambda v: v["out"]), lambda g, v: F.array(g, F.coalesce(v, F.lit(""))))
    return F.when(F.col("f").isNull(), F.col("t")).otherwise(F.array_join(F.flatten(parts), ""))


def pseudonymize(docs: DataFrame, key: str, kinds: tuple[Kind, ...] = KINDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with each personal value replaced by its pseudonym, n_values, and `kinds` (map of kind to count; only kinds found).

    Matches are leftmost and do not overlap; a match that fails its kind's check (Luhn, mod 97, calendar)
    stays. Null text stays null, empty stays empty, both with no values; repeated rows and null ids
    are kept. Dates outside 1901 to 2099 stay. No shuffle. An empty table gives no rows.
    """
    names = F.filter(F.transform("f.values", lambda v: v["kind"]), lambda k: k.isNotNull())
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct("names")), lambda n: F.struct(n.alias("key"), F.size(F.filter("names", lambda k: k == n)).cast("long").alias("value"))))
    rows = _found(docs, key, kinds, text).withColumn("names", F.coalesce(names, F.array().cast("array<string>")))
    return rows.select(F.col("r").getField(doc_id).alias("doc_id"), _rebuilt().alias("text"), F.size("names").cast("long").alias("n_values"), counts.alias("kinds"))


def pseudonymize_documents(docs: DataFrame, key: str, kinds: tuple[Kind, ...] = KINDS, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The same documents and columns, with pseudonyms in the text and the characters counted anew.

    Null texts stay null (and have a null count), empty ones empty; repeated rows, null ids and all
    other columns, whatever their names, stay as they are. An empty table gives an empty table.
    """
    rows = _found(docs, key, kinds, text).withColumn("new", _rebuilt())
    changed = {text: F.col("new")} | ({n_chars: F.length("new").cast(docs.schema[n_chars].dataType)} if n_chars in docs.columns else {})
    return rows.select(*[changed.get(c, F.col("r").getField(c)).alias(c) for c in docs.columns])
