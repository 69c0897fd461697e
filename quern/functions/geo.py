"""Coordinates in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import any_float, let, trim


def parse(text: Column) -> Column:
    """STRUCT<latitude, longitude, format, datum>, NULL if the text isn't a pair: ISO 6709, then degrees with marks, then decimals.

    The order is latitude first, never swapped; the datum is always Unknown.
    """
    return let(F.regexp_replace(trim(text), "º", "°"), lambda s: F.coalesce(_iso(s), _marked(s), _decimal(s)))


def _pair(lat: Column, lng: Column, name: str, fine: Column) -> Column:
    made = F.struct(lat.alias("latitude"), lng.alias("longitude"), F.lit(name).alias("format"), F.lit("Unknown").alias("datum"))
    return F.when(lat.isNotNull() & lng.isNotNull() & fine, made)


def _iso(s: Column) -> Column:
    bare = F.regexp_replace(s, "/+$", "")
    pattern = r"^([+-][^+-]*)([+-][\s\S]*)$"
    part = lambda n: any_float(F.when(bare.rlike(pattern), F.regexp_extract(bare, pattern, n)))
    return let(F.struct(part(1).alias("a"), part(2).alias("b")), lambda x: _pair(x["a"], x["b"], "Iso6709", (F.abs(x["a"]) <= 90) & (F.abs(x["b"]) <= 180)))


def _degrees(c: Column) -> Column:
    """One to three numbers as degrees, minutes and seconds; S and W are negative."""

    def one(n: Column) -> Column:
        at = lambda i: F.get(n, i)
        size = F.when(F.size(n) == 1, at(0)).when(F.size(n) == 2, at(0) + at(1) / 60).when(F.size(n) == 3, at(0) + at(1) / 60 + at(2) / 3600)
        return F.when(F.upper(c).rlike("[SW]"), -size).otherwise(size)

    found = F.transform(F.regexp_extract_all(c, F.lit("[0-9.]+"), F.lit(0)), lambda x: F.when(x.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), x.try_cast("double")))
    return let(F.filter(found, lambda x: x.isNotNull()), one)


def _marked(s: Column) -> Column:
    # The first N parts the two, else the first S.
    north, south = r"^([^Nn]*[Nn])([\s\S]*)$", r"^([^Ss]*[Ss])([\s\S]*)$"
    plain = r"^(\S*)\s([\s\S]*)$"
    part = lambda n: F.when(s.rlike(north), F.regexp_extract(s, north, n)).when(s.rlike(south), F.regexp_extract(s, south, n)).when(s.rlike(plain), F.regexp_extract(s, plain, n))
    return F.when(F.contains(s, F.lit("°")), _pair(_degrees(part(1)), _degrees(part(2)), "Dms", F.lit(True)))


def _decimal(s: Column) -> Column:
    parts = F.when(F.contains(s, F.lit(",")), F.transform(F.split(s, ","), trim)).otherwise(F.split(s, r"\s+"))

    def one(p: Column) -> Column:
        return let(F.struct(any_float(F.get(p, 0)).alias("a"), any_float(F.get(p, 1)).alias("b")), lambda x: F.when(F.size(p) == 2, _pair(x["a"], x["b"], "DecimalDegrees", (F.abs(x["a"]) <= 90) & (F.abs(x["b"]) <= 180))))

    return let(parts, one)


def coordinate_order(df: DataFrame, first: str, second: str) -> DataFrame:
    """One row: LngLat if only the first of a pair ever exceeds 90, LatLng if only the second does, else Ambiguous."""
    over = lambda c: F.coalesce(F.bool_or(F.abs(F.col(c)) > 90), F.lit(False))
    found = df.agg(over(first).alias("a"), over(second).alias("b"))
    return found.select(F.when(F.col("a") & ~F.col("b"), "LngLat").when(F.col("b") & ~F.col("a"), "LatLng").otherwise("Ambiguous").alias("order"))
