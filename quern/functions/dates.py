"""Dates in twenty formats: detection, ISO 8601 texts, typed dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.diagnostics import INFO, RISKY, WARNING, diagnostic
from quern.functions.lookup import lookup
from quern.functions.text import group, has, let, trim

#: Names of the formats.
FORMATS = (
    "Iso8601", "IsoDate", "IsoWeekDate", "YearOnly", "UsDate", "EuDate", "Ambiguous", "LongDate", "AbbrevDate", "Time12", "Time24",
    "UnixSeconds", "UnixMillis", "Hl7Date", "GedcomApprox", "GedcomRange", "GedcomPeriod", "GedcomBeforeAfter", "GedcomInterpreted", "Unknown",
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SHORT = tuple(m[:3] for m in MONTHS)
#: A whole word as ASCII letters bound it.
WORD = "(?<![A-Za-z])({})(?![A-Za-z])"
WEEK = r"^([0-9]{4})(?:W([0-9]{2})([0-9])?|-W([0-9]{2})(?:-([0-9]))?)$"
TIME24 = r"^T?[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"


def number(c: Column) -> Column:
    return c.try_cast("bigint")


def detect(text: Column) -> Column:
    """The name of the first format that fits, `Unknown` if none does."""
    return let(trim(text), _form)


def _form(s: Column) -> Column:
    """`detect` of a trimmed text. What the text is made of comes first and spares most texts most patterns."""
    letters = s.rlike("[A-Za-z]")
    made = F.struct(
        s.alias("s"),
        letters.alias("letters"),
        F.when(letters, F.upper(s)).otherwise(s).alias("u"),
        (~letters & s.rlike("^[0-9]+$")).alias("digits"),
        F.length(s).alias("size"),
        F.when(has(s, "/"), F.split(s, "/")).alias("slash"),
        F.when(has(s, "."), F.split(s, r"\.")).alias("dot"),
        F.when(has(s, "-"), F.split(s, "-")).alias("dash"),
    )
    return let(made, lambda x: F.when(x["s"].isNull() | (x["s"] == ""), "Unknown").when(x["digits"], _of_digits(x["s"], x["size"])).otherwise(_of_others(x)))


def _in_year(s: Column) -> Column:
    return number(F.substring(s, 1, 4)).between(1900, 9999) & number(F.substring(s, 5, 2)).between(1, 12)


def _of_digits(s: Column, size: Column) -> Column:
    n = number(s)
    return (
        F.when((size == 8) & _in_year(s) & number(F.substring(s, 7, 2)).between(1, 31), "Hl7Date")
        .when((size >= 14) & _in_year(s), "Hl7Date")
        .when(size == 4, "YearOnly")
        .when((size == 13) & (n > 946_684_800_000) & (n < 4_200_000_000_000), "UnixMillis")
        .when(size.isin(9, 10) & (n > 946_684_800) & (n < 4_200_000_000), "UnixSeconds")
        .otherwise("Unknown")
    )


def _of_others(x: Column) -> Column:
    s, u, letters, size, slash, dot, dash = (x[k] for k in ("s", "u", "letters", "size", "slash", "dot", "dash"))
    u32 = lambda c: F.when(c.rlike(r"^\+?[0-9]{1,10}$"), number(c))
    order = lambda m, n: F.when(m > 12, "EuDate").when(n > 12, "UsDate").otherwise("Ambiguous")
    ascii_ = s.rlike(r"^[\x00-\x7F]*$")
    ambiguous = let(F.struct(u32(F.get(slash, 0)).alias("a"), u32(F.get(slash, 1)).alias("b")), lambda y: F.when(y["a"].isNotNull() & y["b"].isNotNull(), order(y["a"], y["b"])))
    octets = lambda c, i: F.octet_length(F.get(c, i))

    def pointed(y: Column) -> Column:
        p, q, r = y["p"], y["q"], y["r"]
        return F.when(r.isNotNull() & p.between(1, 31) & q.between(1, 12) & (octets(dot, 2) >= 4), "EuDate").when((octets(dot, 0) == 4) & (p >= 1900) & q.between(1, 12) & r.between(1, 31), "IsoDate")

    three = lambda c: F.struct(*(u32(F.get(c, i)).alias(n) for i, n in enumerate("pqr")))
    dashed = let(three(dash), lambda y: F.when(y["p"].isNotNull() & y["q"].isNotNull() & (y["r"] >= 1900), order(y["p"], y["q"])))
    low = F.lower(s)
    digit = s.rlike("[0-9]")
    words = F.when(letters & digit, (
        F.when(low.rlike(WORD.format("|".join(MONTHS))), "LongDate")
        .when(low.rlike(WORD.format("|".join(SHORT))), "AbbrevDate")
        .when(low.rlike(WORD.format("am|pm")), "Time12")
    ))
    return F.coalesce(
        F.when(s.rlike(r"://|www\.|@|\\|^/"), "Unknown"),
        F.when(letters & s.rlike("^[A-Za-z]"), (
            F.when(u.rlike("^(ABT|ABOUT|EST|CAL) ") | s.rlike("^(circa|CIRCA) "), "GedcomApprox")
            .when(u.rlike("^(BET|BETWEEN) "), "GedcomRange")
            .when(u.rlike("^(FROM|TO) "), "GedcomPeriod")
            .when(u.rlike("^(BEF|BEFORE|AFT|AFTER) "), "GedcomBeforeAfter")
            .when(u.startswith("INT "), "GedcomInterpreted")
            .when(s.startswith("c. "), "GedcomApprox")
        )),
        F.when((size > 14) & s.rlike("^[0-9]{14}") & _in_year(s), "Hl7Date"),
        F.when((size >= 19) & (has(s, "T") | s.rlike(r"^[\s\S]{10} [0-9]")) & s.rlike("[-:]") & ascii_, "Iso8601"),
        F.when((size == 10) & (F.size(dash) >= 3) & s.rlike(r"^[\s\S]{4}-[\s\S]{2}-[\s\S]{2}$") & ascii_, "IsoDate"),
        F.when(letters & has(s, "W") & s.rlike(WEEK), "IsoWeekDate"),
        F.when(F.size(slash) == 3, ambiguous),
        F.when((F.size(dot) == 3) & ~has(s, ".."), let(three(dot), pointed)),
        F.when((F.size(dash) == 3) & (octets(dash, 0) <= 2) & (octets(dash, 1) <= 2) & (octets(dash, 2) == 4) & ~s.rlike("[T:]"), dashed),
        words,
        F.when(has(s, ":") & s.rlike(TIME24), "Time24"),
        F.lit("Unknown"),
    )


def _ymd(y: Column, m: Column, d: Column) -> Column:
    """A calendar date as text, NULL if there is no such day."""
    return let(F.struct(y.alias("y"), m.alias("m"), d.alias("d")), lambda x: _date(x["y"], x["m"], x["d"]))


def _date(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.when(m.between(1, 12) & (d >= 1) & (d <= last), F.when(y > 9999, F.concat(y.cast("string"), F.substring(text, 5, 6))).otherwise(text))


def year(text: Column) -> Column:
    """The year of its digits: below 30 in this century, two digits from 30 on in the last."""
    n = F.when(text.rlike(r"^\+?[0-9]{1,9}$"), number(text))
    return F.when((F.octet_length(text) <= 2) & (n < 100), F.when(n < 30, n + 2000).otherwise(n + 1900)).otherwise(n)


def month_number(name: Column) -> Column:
    return lookup({m: i + 1 for i, m in enumerate(SHORT)}, F.lower(F.substring(name, 1, 3)))


def hl7_zone(suffix: Column) -> Column:
    """`+HHMM` at the end becomes `+HH:MM`."""
    return F.regexp_replace(suffix, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")


def unix_iso(seconds: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def week_iso(s: Column) -> Column:
    """An ISO week date as a calendar date; Monday without a day."""
    y = number(group(s, WEEK, 1))
    w = number(F.when(F.regexp_extract(s, WEEK, 2) != "", F.regexp_extract(s, WEEK, 2)).otherwise(F.regexp_extract(s, WEEK, 4)))
    day = F.coalesce(F.nullif(F.regexp_extract(s, WEEK, 3), F.lit("")), F.nullif(F.regexp_extract(s, WEEK, 5), F.lit("")), F.lit("1")).cast("int")
    monday = F.trunc(F.make_date(y.cast("int"), F.lit(1), F.lit(4)), "WEEK")
    return F.when(w.between(1, 53) & day.between(1, 7) & (y >= 1), F.date_format(F.date_add(monday, ((w - 1) * 7 + day - 1).cast("int")), "yyyy-MM-dd"))


def to_iso(text: Column, day_first: Column | bool = False) -> Column:
    """The text as ISO 8601, NULL for formats without a calendar date and for days that don't exist."""
    first = F.lit(day_first) if isinstance(day_first, bool) else day_first
    return let(trim(text), lambda s: let(F.struct(s.alias("s"), _form(s).alias("f")), lambda x: _to_iso(x["s"], x["f"], first)))


def _to_iso(s: Column, f: Column, day_first: Column) -> Column:
    u32 = lambda c: F.when(c.rlike(r"^\+?[0-9]{1,9}$"), number(c))

    def parts(seps: str, make) -> Column:
        """`make` of three parts between the first of `seps` that is there, or dashes."""
        cut = F.split(s, "-")
        for sep in reversed(seps):
            cut = F.when(has(s, sep), F.split(s, sep if sep != "." else r"\.")).otherwise(cut)
        return let(cut, lambda p: F.when(F.size(p) == 3, make(*(F.get(p, i) for i in range(3)))))

    def us(a: Column, b: Column, y: Column) -> Column:
        return _ymd(year(y), u32(a), u32(b))

    def eu(a: Column, b: Column, y: Column) -> Column:
        return _ymd(year(y), u32(b), u32(a))

    def iso() -> Column:
        out = F.regexp_replace(F.regexp_replace(s, r"^([\s\S]{4})\.", "$1-"), r"^([\s\S]{7})\.", "$1-")
        valid = _ymd(u32(F.substring(s, 1, 4)), u32(F.substring(s, 6, 2)), u32(F.substring(s, 9, 2)))
        return F.when(valid.isNotNull(), F.regexp_replace(out, r"^([\s\S]{10}) ", "$1T"))

    lead = s.rlike("^[0-9]")

    def long(p: Column) -> Column:
        day, month = (F.when(lead, F.get(p, i)).otherwise(F.get(p, 1 - i)) for i in (0, 1))
        return F.when(F.size(p) >= 3, _ymd(u32(F.get(p, 2)), month_number(month), u32(F.regexp_replace(day, ",+$", ""))))

    def short(p: Column) -> Column:
        first = F.get(p, 0).rlike("^[0-9]")
        day, month = (F.when(first, F.get(p, i)).otherwise(F.get(p, 1 - i)) for i in (0, 1))
        return F.when(F.size(p) >= 3, _ymd(year(F.get(p, 2)), month_number(month), u32(day)))

    day = F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))
    time = F.concat_ws(":", F.substring(s, 9, 2), F.substring(s, 11, 2), F.substring(s, 13, 2))
    hl7 = F.when(F.length(s) >= 14, F.concat(day, F.lit("T"), time, hl7_zone(F.substring(s, 15, 1000)))).otherwise(day)
    return (
        F.when(f.isin("Iso8601", "IsoDate"), iso())
        .when(f == "UsDate", parts("/", us))
        .when(f == "EuDate", parts("./", eu))
        .when(f == "Ambiguous", parts("/", lambda a, b, y: F.when(day_first, eu(a, b, y)).otherwise(us(a, b, y))))
        .when(f == "LongDate", let(F.split(s, r"\s+"), long))
        .when(f == "AbbrevDate", let(F.split(trim(F.translate(s, "-,", "  ")), r"\s+"), short))
        .when(f == "YearOnly", F.concat(s, F.lit("-01-01")))
        .when(f == "UnixSeconds", unix_iso(number(s)))
        .when(f == "UnixMillis", unix_iso(F.floor(number(s) / 1000)))
        .when(f == "Hl7Date", hl7)
        .when(f == "IsoWeekDate", week_iso(s))
    )


def to_date(text: Column, day_first: Column | bool = False) -> Column:
    return F.try_to_date(F.substring(to_iso(text, day_first), 1, 10))


def to_datetime(text: Column, day_first: Column | bool = False) -> Column:
    """A timestamp without a zone; a date alone is its midnight."""
    return to_iso(text, day_first).try_cast("timestamp_ntz")


def note(text: Column) -> Column:
    """The diagnostic of a text taken for a date; the text itself is never changed."""

    def one(f: Column) -> Column:
        told = lambda risk, hint: diagnostic("coerced", F.concat(F.lit("date:"), f), "datetime", risk, hint)
        return (
            F.when(f == "Ambiguous", told(RISKY, "day and month can't be told apart"))
            .when(f.isin("GedcomApprox", "GedcomRange", "Unknown"), told(WARNING, "no exact date"))
            .otherwise(told(INFO, None))
        )

    return let(detect(text), one)


def column_format(df: DataFrame, text: str) -> DataFrame:
    """One row: the formats of a column, how many are dates and how many ambiguous, the dominant one (ties: the name first in
    the alphabet) and whether days come first as far as unambiguous dates tell. Nulls aren't looked at."""
    found = df.where(F.col(text).isNotNull()).select(detect(F.col(text)).alias("format")).groupBy("format").agg(F.count("*").alias("n"))
    n, f = F.col("n"), F.col("format")
    of = lambda *names: F.coalesce(F.sum(F.when(f.isin(*names), n)), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return found.agg(
        total.alias("total"),
        (total - of("Unknown")).alias("dates"),
        of("Ambiguous").alias("ambiguous"),
        F.min_by("format", F.struct(-n, f)).alias("dominant"),
        F.when(of("EuDate") > 0, F.when(of("UsDate") == 0, True)).when(of("UsDate") > 0, False).alias("day_first"),
    ).withColumn("date_share", F.when(F.col("total") > 0, F.col("dates") / F.col("total")).otherwise(0.0))


def parse_hl7(text: Column) -> Column:
    """A clinical timestamp of 4, 6, 8 or at least 14 digits as ISO 8601; a day is only looked at up to 31."""

    def one(s: Column) -> Column:
        part = lambda a, n: F.substring(s, a, n)
        whole = number(part(1, 4)).between(1900, 9999)
        month = number(part(5, 2)).between(1, 12)
        rest = F.substring(s, 15, 1000)
        frac = F.regexp_extract(rest, r"^\.[^+-]*", 0)
        zone = F.when(rest.startswith("."), F.regexp_extract(rest, r"^\.[^+-]*([\s\S]*)$", 1)).otherwise(rest)
        zone = F.when(F.length(zone) >= 5, F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))).otherwise("")
        day = F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2))
        time = F.concat(F.concat_ws(":", part(9, 2), part(11, 2), part(13, 2)), frac, zone)
        return (
            F.when(s.rlike("^[0-9]{4}$"), F.when(whole, s))
            .when(s.rlike("^[0-9]{6}$"), F.when(whole & month, F.concat_ws("-", part(1, 4), part(5, 2))))
            .when(s.rlike("^[0-9]{8}") & month & number(part(7, 2)).between(1, 31), F.when(s.rlike("^[0-9]{14}"), F.concat(day, F.lit("T"), time)).otherwise(day))
        )

    return let(trim(text), one)
