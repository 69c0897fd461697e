"""Deep merge and path assignment on JSON texts, for which VARIANT has no recursive expression: Arrow UDFs."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.diagnostics import INFO, WARNING
from quern.functions.paths import Segment, parse_path

DIAGNOSTICS = T.ArrayType(
    T.StructType([T.StructField(n, T.IntegerType() if n == "risk" else T.StringType()) for n in ("path", "kind", "a", "b", "risk", "suggestion")])
)


def _load(text: str | None) -> Any:
    return None if text is None else json.loads(text)


def dumps(value: Any) -> str:
    """Compact, with keys in order, as the engine writes objects."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def merged(left: Any, right: Any) -> Any:
    """Objects field by field; of anything else the right one."""
    if isinstance(left, dict) and isinstance(right, dict):
        return left | {k: merged(left[k], v) if k in left else v for k, v in right.items()}
    return right


def differences(left: Any, right: Any, path: str = "") -> list[tuple]:
    """What a merge keeps and overrides: new fields, then changed leaves."""
    if not (isinstance(left, dict) and isinstance(right, dict)):
        if left == right and type(left) is type(right):
            return []
        loses = isinstance(left, dict | list) and not isinstance(right, dict | list)
        return [(path or "(root)", "overridden", dumps(left), dumps(right), WARNING if loses else INFO, None)]
    out = []
    for k in sorted(right):
        here = f"{path}.{k}" if path else k
        out += differences(left[k], right[k], here) if k in left else [(here, "preserved", k, None, INFO, None)]
    return out


def assigned(value: Any, segments: tuple[Segment, ...], new: Any) -> Any:
    """`value` with `new` at a path. What is missing is made: objects before names, arrays (padded with nulls) before
    indexes. Where something of another type is in the way, nothing changes."""
    if not segments:
        return new
    at, rest = segments[0], segments[1:]
    if value is None:
        value = [] if isinstance(at, int) else {}
    if isinstance(at, int):
        if not isinstance(value, list):
            return value
        grown = value + [None] * (at + 1 - len(value))
        grown[at] = assigned(grown[at], rest, new)
        return grown
    if not isinstance(value, dict):
        return value
    return value | {at: assigned(value.get(at), rest, new)}


def _merge(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([b if a is None else a if b is None else dumps(merged(_load(a), _load(b))) for a, b in zip(left, right, strict=True)], dtype=object)


def _differences(left: pd.Series, right: pd.Series) -> pd.Series:
    names = DIAGNOSTICS.elementType.names
    found = [[] if a is None or b is None else [dict(zip(names, d, strict=True)) for d in differences(_load(a), _load(b))] for a, b in zip(left, right, strict=True)]
    return pd.Series(found, dtype=object)


def merge(left: Column, right: Column) -> Column:
    """Deep merge of two JSON texts; a NULL one leaves the other."""
    return F.pandas_udf(_merge, T.StringType())(left, right)


def merge_diagnostics(left: Column, right: Column) -> Column:
    """ARRAY<STRUCT<path, kind, a, b, risk, suggestion>> of a merge."""
    return F.pandas_udf(_differences, DIAGNOSTICS)(left, right)


def set_path(value: Column, path: str, new: Column) -> Column:
    """The JSON text with the JSON text `new` at a path."""
    segments = parse_path(path)

    def put(texts: pd.Series, news: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else dumps(assigned(_load(a), segments, _load(b))) for a, b in zip(texts, news, strict=True)], dtype=object)

    return F.pandas_udf(put, T.StringType())(value, new)
