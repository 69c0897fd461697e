"""Small constant tables as map literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(table: dict, key: Column) -> Column:
    """The table's entry for a key, NULL where there is none."""
    pairs = [F.lit(x) for k, v in table.items() for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), key)
