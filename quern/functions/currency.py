"""Amounts of money in texts, and conversion between currencies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions import variants as V
from quern.functions.diagnostics import WARNING, diagnostic
from quern.functions.lookup import lookup

#: Symbols before an amount in the order they are tried, and their codes.
SYMBOLS = {
    "HK$": "HKD", "NT$": "TWD", "NZ$": "NZD", "A$": "AUD", "C$": "CAD", "R$": "BRL", "S$": "SGD", "Z$": "ZWD", "CHF": "CHF", "kr": "SEK",
    "zł": "PLN", "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₩": "KRW", "₽": "RUB", "₺": "TRY",
}
#: Codes before or after an amount.
CODES = (
    "USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CHF", "CNY", "INR", "KRW", "BRL", "MXN", "SGD", "HKD", "NOK", "SEK", "DKK", "NZD", "ZAR", "RUB",
    "TRY", "PLN", "THB", "TWD", "ILS", "AED", "SAR", "BTC", "ETH",
)
#: Units of a currency for a US dollar, as of 2026-01.
RATES = {
    "USD": 1.0, "EUR": 0.92, "GBP": 0.79, "JPY": 148.0, "CAD": 1.36, "AUD": 1.55, "CHF": 0.88, "CNY": 7.24, "INR": 83.5, "KRW": 1310.0,
    "BRL": 4.97, "MXN": 17.2, "SGD": 1.34, "HKD": 7.82, "NOK": 10.5, "SEK": 10.3, "DKK": 6.87, "NZD": 1.63, "ZAR": 18.8, "RUB": 89.0,
    "TRY": 30.2, "PLN": 4.01, "THB": 35.1, "TWD": 31.5, "ILS": 3.65, "AED": 3.67, "SAR": 3.75, "PHP": 56.0, "IDR": 15700.0, "MYR": 4.72,
    "CZK": 23.1, "HUF": 365.0, "CLP": 910.0, "COP": 3950.0, "ARS": 830.0, "EGP": 30.9, "NGN": 890.0, "KES": 156.0, "VND": 24500.0,
}
RATES_AS_OF = "2026-01"
FULL_WIDTH = "".join(chr(0xFF10 + i) for i in range(10)) + "，．", "0123456789,."


def half_width(c: Column) -> Column:
    return F.translate(c, *FULL_WIDTH)


def is_number(c: Column) -> Column:
    """Whether a text is a number once separators are out."""
    bare = F.translate(half_width(X.trim(c)), ", '", "")
    dots = F.replace(bare, F.lit("."), F.lit(""))
    number = F.when(bare.rlike(r"\..*\."), dots).otherwise(bare)
    return F.coalesce(number.rlike(X.FLOAT) | number.rlike(X.SPECIAL), F.lit(False))


def amount(c: Column) -> Column:
    """The number of an amount: European with a comma after a dot, dots only, or separators to be dropped."""

    def one(s: Column) -> Column:
        dotless = F.replace(s, F.lit("."), F.lit(""))
        return (
            F.when(s.rlike(r"\.[^.]*,[^.]*$"), X.any_float(F.replace(dotless, F.lit(","), F.lit("."))))
            .when(s.rlike(r"^[^,]*\.[^,]*\.[^,]*$"), X.any_float(dotless))
            .otherwise(X.any_float(F.translate(s, ", '", "")))
        )

    return X.let(half_width(c), one)


def parse(text: Column) -> Column:
    """STRUCT<amount, code, format>: format is SymbolPrefix, CodePrefix, CodeSuffix, EuropeanLocale or NotCurrency."""
    signed = lambda s: F.struct(
        F.when(s.rlike(r"^\([\s\S]*\)$") & (F.length(s) >= 2), F.lit("-")).when(s.startswith("-"), F.lit("-")).otherwise("").alias("sign"),
        F.when(s.rlike(r"^\([\s\S]*\)$") & (F.length(s) >= 2), F.regexp_replace(s, r"^\(|\)$", "")).otherwise(F.regexp_replace(s, "^-", "")).alias("s"),
    )
    return X.let(X.trim(text), lambda t: X.let(signed(t), lambda x: _parse(x["sign"], x["s"])))


def _parse(sign: Column, s: Column) -> Column:
    symbol = r"^(" + "|".join(map(re.escape, SYMBOLS)) + r")([\s\S]*)$"
    prefix, suffix = r"^([^ ]*) ([\s\S]*)$", r"^([\s\S]*) ([^ ]*)$"
    out = lambda number, code, name: F.struct(number.cast("double").alias("amount"), code.cast("string").alias("code"), F.lit(name).alias("format"))
    # A shorter symbol can follow a longer one's failure; only `$` and the rest are alternatives, so one pattern does.
    after = X.trim(F.regexp_extract(s, symbol, 2))
    first, last = F.upper(F.regexp_extract(s, prefix, 1)), F.upper(F.regexp_extract(s, suffix, 2))
    dotted = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    none = F.lit(None)
    return (
        F.when(s.rlike(symbol) & is_number(after), out(amount(F.concat(sign, after)), lookup(SYMBOLS, F.regexp_extract(s, symbol, 1)), "SymbolPrefix"))
        .when(first.isin(*CODES) & is_number(F.regexp_extract(s, prefix, 2)), out(amount(F.concat(sign, F.regexp_extract(s, prefix, 2))), first, "CodePrefix"))
        .when(last.isin(*CODES) & is_number(F.regexp_extract(s, suffix, 1)), out(amount(F.concat(sign, F.regexp_extract(s, suffix, 1))), last, "CodeSuffix"))
        .when(s.rlike(r"\.[^.]*,[^.]*$") & dotted.rlike(X.FLOAT), out(X.plain_float(F.concat(sign, dotted)), none, "EuropeanLocale"))
        .otherwise(out(none, none, "NotCurrency"))
    )


def coerce_currency(value: Column) -> Column:
    """STRUCT<value, coerced, diag> of a JSON value: a text with an amount becomes its number."""

    def one(p: Column) -> Column:
        told = diagnostic("coerced", F.concat(F.lit("currency "), F.coalesce(p["code"], F.lit("(unknown)"))), "f64", WARNING, "store amounts as numbers, codes apart")
        return F.when(p["amount"].isNotNull(), F.struct(p["amount"].alias("value"), F.lit(True).alias("coerced"), told.alias("diag")))

    return X.let(parse(V.string(value)), one)


def rate(source: Column, target: Column) -> Column:
    """The built-in rate; 1 for equal codes, known or not; NULL for unknown ones."""
    return F.when(source == target, F.lit(1.0)).otherwise(lookup(RATES, F.upper(target)) / lookup(RATES, F.upper(source)))


def convert(value: Column, source: Column, target: Column) -> Column:
    return value * rate(source, target)


def convert_with(df: DataFrame, rates: DataFrame, value: str, source: str, target: str, out: str) -> DataFrame:
    """`df` with `value` converted by the user's rates (columns `from`, `to`, `rate`). Spark broadcasts them if they are small."""
    table = rates.select(F.col("from").alias("_from"), F.col("to").alias("_to"), F.col("rate").alias("_rate"))
    joined = df.join(table, (F.col(source) == F.col("_from")) & (F.col(target) == F.col("_to")), "left")
    same = F.when(F.col(source) == F.col(target), F.lit(1.0))
    return joined.withColumn(out, F.col(value) * F.coalesce(F.col("_rate"), same)).drop("_from", "_to", "_rate")
