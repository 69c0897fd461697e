"""JSON values as VARIANT columns: parsing, kinds, text of values, navigation, predicates."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import NOT_FOUND, OK, OUT_OF_BOUNDS, TYPE_MISMATCH
from quern.functions.paths import Segment, parse_path
from quern.functions.text import let, trim

#: What a text must look like at its ends to be tried as JSON in the middle of a path.
OBJECT_TEXT, ARRAY_TEXT = r"^\{[\s\S]*\}$", r"^\[[\s\S]*\]$"


def from_json(text: Column, strict: bool = False) -> Column:
    """The value of a JSON text, a byte order mark before it dropped. NULL if it isn't JSON, or an error if `strict`."""
    mark = "\ufeff"
    bare = F.when(text.startswith(mark), F.regexp_replace(text, f"^{mark}", "")).otherwise(text)
    return F.parse_json(bare) if strict else F.try_parse_json(bare)


def to_json(value: Column) -> Column:
    return F.to_json(value)


def _indented(text: str) -> str:
    """Compact JSON on lines of their own, two blanks a level; scalars stay as they are written."""
    out, depth, before = [], 0, ""
    for token in re.findall(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+', text):
        if token in "}]":
            depth -= 1
            out.append(token if before in ("{", "[") else "\n" + "  " * depth + token)
        else:
            if before in ("{", "[", ","):
                out.append("\n" + "  " * depth)
            out.append(": " if token == ":" else token)
            depth += token in ("{", "[")
        before = token
    return "".join(out)


def pretty(value: Column) -> Column:
    """JSON for reading. Spark indents only values of a known type, so this runs in Python."""

    @F.pandas_udf("string")
    def indent(texts: pd.Series) -> pd.Series:
        return texts.map(_indented, na_action="ignore")

    return indent(F.to_json(value))


def from_row(row: Column) -> Column:
    """A struct, array or map as a value."""
    return F.to_variant_object(row)


def _array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _map(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def form(value: Column) -> Column:
    """ARRAY, OBJECT, or a scalar's type. Only the top is looked at, where a schema goes through the whole value."""
    return F.when(_array(value).isNotNull(), "ARRAY").when(_map(value).isNotNull(), "OBJECT").otherwise(F.schema_of_variant(value))


def kind(value: Column) -> Column:
    """null, bool, integer, float, string, array or object; NULL for an absent value. A float without a fraction is `float` here."""
    return let(
        form(value),
        lambda s: F.when(s.isNull(), F.lit(None).cast("string"))
        .when(s == "STRING", "string")
        .when(s == "BIGINT", "integer")
        .when(s == "VOID", "null")
        .when(s == "BOOLEAN", "bool")
        .when(s == "ARRAY", "array")
        .when(s == "OBJECT", "object")
        # an integer beyond 64 signed bits is a decimal of scale 0 and 19 digits at least
        .when(s.rlike(r"^DECIMAL\((19|20),0\)$"), "integer")
        .otherwise("float"),
    )


def schema_kind(value: Column) -> Column:
    """The kind as schemas see it: a float without a fraction is an integer."""
    return let(
        F.struct(kind(value).alias("k"), F.try_variant_get(value, "$", "double").alias("d")),
        lambda x: F.when((x["k"] == "float") & (x["d"] == F.floor(x["d"])), F.lit("integer")).otherwise(x["k"]),
    )


def number_text(value: Column) -> Column:
    """A number as text: floats without a fraction end in `.0`."""
    text = F.to_json(value)
    return F.when((kind(value) == "float") & ~text.rlike(r"[.eE]"), F.concat(text, F.lit(".0"))).otherwise(text)


def string(value: Column) -> Column:
    """The text of a string value, NULL for other kinds."""
    return F.when(form(value) == "STRING", F.try_variant_get(value, "$", "string"))


def elements(value: Column) -> Column:
    """The elements of an array value; a text that holds an array is parsed; anything else has none."""
    return F.coalesce(_array(value), _array(parsed(value)), F.array().cast("array<variant>"))


def fields(value: Column) -> Column:
    """The fields of an object value as a map, NULL for other kinds."""
    return _map(value)


def quoted(*segments: Segment) -> str:
    """Segments as a variant path."""
    one = lambda s: f"[{s}]" if isinstance(s, int) else "['" + s + "']" if "'" not in s else '["' + s + '"]'
    return "$" + "".join(map(one, segments))


def parsed(value: Column) -> Column:
    """The value of a text that looks like JSON."""
    text = trim(string(value))
    return F.when(text.rlike(OBJECT_TEXT) | text.rlike(ARRAY_TEXT), F.try_parse_json(text))


def _hop(value: Column, segment: Segment) -> Column:
    """A text that holds JSON is parsed before a step into it."""
    text = trim(string(value))
    looks = text.rlike(ARRAY_TEXT) if isinstance(segment, int) else text.rlike(OBJECT_TEXT) | text.rlike(ARRAY_TEXT)
    return F.coalesce(F.when(looks, F.try_parse_json(text)), value)


def walk(value: Column, path: str | tuple[Segment, ...]) -> Column:
    """STRUCT<value, status>: what stands at a path, and OK, NOT_FOUND, TYPE_MISMATCH or OUT_OF_BOUNDS."""
    segments = parse_path(path) if isinstance(path, str) else path
    here = F.struct(value.alias("value"), F.when(value.isNull(), NOT_FOUND).otherwise(OK).alias("status"))
    if not segments:
        return here
    for segment in segments:
        here = let(here, partial(_step, segment))
    # Most paths lead through objects and arrays only; the steps tell why one doesn't.
    direct = F.try_variant_get(value, quoted(*segments), "variant")
    return F.when(direct.isNotNull(), F.struct(direct.alias("value"), F.lit(OK).alias("status"))).otherwise(here)


def _step(segment: Segment, x: Column) -> Column:
    def inside(v: Column) -> Column:
        s = form(v)
        found = F.try_variant_get(v, quoted(segment), "variant")
        if isinstance(segment, int):
            missing = F.when(s == "ARRAY", OUT_OF_BOUNDS).otherwise(TYPE_MISMATCH)
        else:
            # Arrays have no names; other kinds can't be stepped into.
            missing = F.when(s.isin("OBJECT", "ARRAY"), NOT_FOUND).otherwise(TYPE_MISMATCH)
        return F.struct(found.alias("value"), F.when(found.isNotNull(), OK).otherwise(missing).alias("status"))

    return F.when(x["status"] == OK, let(_hop(x["value"], segment), inside)).otherwise(x)


def _inside(spot: str, v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, spot, "variant"), F.try_variant_get(parsed(v), spot, "variant"))


def at(value: Column, path: str) -> Column:
    """What stands at a path, NULL if nothing does."""
    segments = parse_path(path)
    if not segments:
        return value
    here = value
    for segment in segments:
        here = let(here, partial(_inside, quoted(segment)))
    return F.coalesce(F.try_variant_get(value, quoted(*segments), "variant"), here)


def status(value: Column, path: str) -> Column:
    return walk(value, path)["status"]


def has(value: Column, path: str) -> Column:
    """Whether the path exists, a null there included."""
    return status(value, path) == OK


def is_null(value: Column) -> Column:
    return F.is_variant_null(value)


def is_kind(name: str) -> Callable[[Column], Column]:
    return lambda value: F.coalesce(kind(value) == name, F.lit(False))


is_string, is_array, is_object = is_kind("string"), is_kind("array"), is_kind("object")


def keys(value: Column) -> Column:
    return F.map_keys(fields(value))


def size(value: Column) -> Column:
    """Elements of an array or fields of an object, NULL for other kinds."""
    return F.when(_array(value).isNotNull(), F.size(_array(value))).when(fields(value).isNotNull(), F.size(fields(value)))


def is_empty(value: Column) -> Column:
    return size(value) == 0


def merge_shallow(left: Column, right: Column) -> Column:
    """Top-level fields of `right` win, nulls too; anything but two objects is `right`. Text of JSON in, text out."""
    a, b = fields(left), fields(right)
    both = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))
    return F.when(a.isNotNull() & b.isNotNull(), F.to_json(F.to_variant_object(both))).otherwise(F.to_json(right))


VARIANT = T.VariantType()
