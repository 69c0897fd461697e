"""What an unknown text may be: ranked guesses over twenty kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import currency, dates, identifiers, units
from quern.functions.lookup import lookup
from quern.functions.text import FLOAT, I64, if_float, integer, let, trim, whole

#: Words for null and for booleans.
NULL_WORDS = ("null", "none", "nil", "n/a", "na", "nan", "undefined", "-", "", "unknown")
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "on", "off", "t", "f")
#: Kinds of the identifiers that are guesses; the others are left to more specific rules.
KIND_OF = {
    "Iban": "Iban", "CreditCard": "CreditCard", "Isbn10": "Isbn", "Isbn13": "Isbn", "UsSsn": "Ssn", "UsEin": "Ein", "EuVat": "VatNumber", "Phone": "Phone",
}
KINDS = (
    "Integer", "Float", "Boolean", "Date", "Currency", "UnitValue", "Uuid", "Email", "Url", "IpAddress", "Json", "Iban", "CreditCard", "Isbn", "Ssn",
    "Ein", "VatNumber", "Phone", "NullSentinel", "PlainString",
)


def guesses(text: Column) -> Column:
    """ARRAY<STRUCT<kind, sub, confidence>>, the surest first; equally sure ones in the order of the rules.

    `sub` is a date's format or a unit's category. An email address and a text of four numbers that is no IP address end
    the search.
    """

    def parts(s: Column) -> Column:
        return F.struct(
            s.alias("s"), F.lower(s).alias("l"), dates.detect(s).alias("d"), currency.parse(s)["format"].alias("money"), units.parse(s)["category"].alias("quantity"),
            units.parse_weight(s).isNotNull().alias("weight"), units.parse_pack(s).isNotNull().alias("pack"), identifiers.detect(s).alias("ids"),
        )

    return let(trim(text), lambda s: let(parts(s), _guesses))


def _guess(when: Column, kind: str | Column, confidence: float | Column, sub: Column | None = None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    made = F.struct(lit(kind).alias("kind"), (F.lit(None).cast("string") if sub is None else sub).alias("sub"), lit(confidence).cast("double").alias("confidence"))
    return F.when(F.coalesce(when, F.lit(False)), made)


def _guesses(x: Column) -> Column:
    s, low, date, money = x["s"], x["l"], x["d"], x["money"]
    flag = s.isin("0", "1")
    fits = F.coalesce(integer(s).between(*map(whole, I64)), F.lit(False))
    number = s.rlike(FLOAT) & ~fits & (F.abs(s.try_cast("double")) < float("inf"))
    url = s.rlike("^(https?|ftp)://")
    email = ~url & s.rlike(r"^[^@ ]+@[^@ ]*\.[^@ ]*$")
    first = F.array(
        _guess(low.isin(*NULL_WORDS), "NullSentinel", 0.95),
        _guess(low.isin(*BOOLEAN_WORDS), "Boolean", 0.9),
        _guess(fits, "Integer", F.when(flag, 0.5).otherwise(0.95)),
        _guess(fits, "Float", F.when(flag, 0.5).otherwise(0.7)),
        _guess(number, "Float", 0.95),
        _guess(flag, "Boolean", 0.6),
    )
    with_email = F.array(_guess(email, "Email", 0.9))
    category = F.when(x["quantity"].isNotNull(), x["quantity"]).when(x["weight"] | x["pack"], "Weight")
    sure = F.when(x["quantity"].isNull() & ~x["weight"], 0.8).otherwise(0.85)
    bracket = F.replace(F.regexp_extract(s, r"^\(([\s\S]*)\)$", 1), F.lit(","), F.lit(""))
    numbers = s.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")
    octets = F.forall(F.split(s, r"\."), lambda p: F.coalesce(p.try_cast("decimal(38,0)") <= 255, F.lit(False)))
    second = F.array(
        _guess(date != "Unknown", "Date", F.when(date == "Ambiguous", 0.6).otherwise(0.85), date),
        _guess(money != "NotCurrency", "Currency", F.when(money == "EuropeanLocale", 0.7).otherwise(0.9)),
        _guess(s.rlike(r"^\([\s\S]*\)$") & if_float(bracket).isNotNull(), "Currency", 0.85),
        _guess(category.isNotNull(), "UnitValue", sure, category),
        _guess(low.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), "Uuid", 0.95),
        _guess(url, "Url", 0.95),
        _guess(numbers & octets, "IpAddress", 0.9),
        _guess(numbers & ~octets, "PlainString", 0.95),
    )
    code = F.upper(F.regexp_replace(s, r"\p{IsWhite_Space}", ""))
    variety = F.size(F.array_distinct(F.split(F.substring(code, 5, 40), ""))) > 2
    ids = F.filter(x["ids"], lambda g: g["kind"].isin(*KIND_OF))
    third = F.array(
        _guess(s.rlike(r"^[0-9A-Fa-f:]*$") & s.rlike(":[^:]*:"), "IpAddress", 0.8),
        _guess(s.rlike(r"^(\{[\s\S]*\}|\[[\s\S]*\])$") & F.try_parse_json(s).isNotNull(), "Json", 0.95),
        _guess(code.rlike("^[A-Z]{2}(?!0[01])[0-9]{2}[A-Z0-9]{11,30}$") & variety, "Iban", 0.8),
    )
    named = F.transform(ids, lambda g: F.struct(lookup(KIND_OF, g["kind"]).alias("kind"), F.lit(None).cast("string").alias("sub"), g["confidence"].alias("confidence")))
    rest = F.when(numbers & ~octets, second).otherwise(F.concat(second, third, named))
    every = F.when(email, F.concat(first, with_email)).otherwise(F.concat(first, rest))
    return let(F.filter(every, lambda g: g.isNotNull()), lambda found: _ranked(s, found, ~email & ~(numbers & ~octets)))


def _ranked(s: Column, found: Column, whole_search: Column) -> Column:
    """Digits that are a card, a book or a date are less likely plain numbers; then by confidence."""
    card = F.exists(found, lambda g: g["kind"].isin("CreditCard", "Isbn") & (g["confidence"] >= 0.85))
    dated = F.exists(found, lambda g: g["sub"].isin("Hl7Date", "UnixSeconds", "UnixMillis")) & s.rlike("^[0-9]+$")
    sure = lambda g: (
        F.when(whole_search & dated & g["kind"].isin("Integer", "Float"), 0.4).when(whole_search & card & (g["kind"] == "Integer"), 0.5).otherwise(g["confidence"])
    )
    placed = F.transform(found, lambda g, i: F.struct((-sure(g)).alias("less"), i.alias("at"), g["kind"].alias("kind"), g["sub"].alias("sub")))
    plain = F.array(F.struct(F.lit(-1.0).alias("less"), F.lit(0).alias("at"), F.lit("PlainString").alias("kind"), F.lit(None).cast("string").alias("sub")))
    ordered = F.array_sort(F.when(F.size(placed) > 0, placed).otherwise(plain))
    return F.transform(ordered, lambda g: F.struct(g["kind"].alias("kind"), g["sub"].alias("sub"), (-g["less"]).alias("confidence")))


def guess_column(df: DataFrame, text: str, out: str = "guesses") -> DataFrame:
    """`df` with the guesses of a column, worked out once for each distinct text.

    For columns with few distinct values: the table of those is joined back, broadcast where Spark finds it small.
    """
    known = df.select(text).distinct().withColumn(out, guesses(F.col(text))).withColumnRenamed(text, "_text")
    return df.join(known, F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")
