"""What a user knows and the engine doesn't: rates, factors, names. Nothing consults these on its own."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.lookup import lookup

PAIRS = "`from` string, `to` string, rate double"


class NoLookups:
    """Knows nothing."""

    def exchange_rate(self, source: str, target: str) -> float | None:
        return None

    def conversion_factor(self, source: str, target: str) -> float | None:
        return None

    def lookup(self, table: str, key: str) -> str | None:
        return None


@dataclass
class StaticLookups(NoLookups):
    """Held in dictionaries: rates and factors by pair, names by table and key."""

    rates: dict[tuple[str, str], float] = field(default_factory=dict)
    factors: dict[tuple[str, str], float] = field(default_factory=dict)
    tables: dict[str, dict[str, str]] = field(default_factory=dict)

    def exchange_rate(self, source: str, target: str) -> float | None:
        return self.rates.get((source, target))

    def conversion_factor(self, source: str, target: str) -> float | None:
        return self.factors.get((source, target))

    def lookup(self, table: str, key: str) -> str | None:
        return self.tables.get(table, {}).get(key)

    def rates_frame(self, spark: SparkSession) -> DataFrame:
        """from, to, rate, for `currency.convert_with`."""
        return spark.createDataFrame([(a, b, r) for (a, b), r in self.rates.items()], PAIRS)

    def factors_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(a, b, r) for (a, b), r in self.factors.items()], PAIRS)

    def column(self, table: str, key: Column) -> Column:
        """A small table's entry as an expression."""
        known = self.tables.get(table, {})
        return lookup(known, key) if known else F.lit(None).cast("string")
