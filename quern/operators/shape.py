"""Typed contracts over JSON objects: fields with coercion and defaults, unknown fields dropped, kept or refused."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import InvalidSpec, ShapingFailed
from quern.functions import text as X
from quern.functions import variants as V
from quern.functions.coerce import SPARK, coerce, default
from quern.functions.diagnostics import INFO, WARNING, diagnostic
from quern.plans.config import ABSORBING, LENIENT, STRICT, Level, Mode, ShapeConfig

#: A field's diagnostic.
TOLD = "struct<path:string,kind:string,a:string,b:string,risk:int,suggestion:string>"
#: JSON schema types.
JSON_TYPES = {"string": "string", "bool": "boolean", "f32": "number", "f64": "number", "raw": "object"}


@dataclass(frozen=True)
class FieldSpec:
    """A field of a contract. `type` is a coercion target, or another ShapeSpec for `flatten`; `array` makes it a list of that.

    coerce: bend the value as far as possible. default: the type's default for a missing or null value, and with `coerce`
    for one that can't be bent. skip: always the default; the key isn't used up. flatten: a nested contract read from the same
    object. overflow: whatever no field uses. parse_json_string: a text that holds JSON is parsed first.
    """

    name: str
    type: Any = "string"
    optional: bool = False
    array: bool = False
    coerce: bool = False
    default: bool = False
    rename: str | None = None
    skip: bool = False
    flatten: bool = False
    overflow: bool = False
    parse_json_string: bool = False
    description: str | None = None

    @property
    def key(self) -> str:
        return self.rename or self.name

    @property
    def spark_type(self) -> str:
        if self.flatten:
            return "struct<" + ",".join(f"`{f.name}`:{f.spark_type}" for f in self.type.fields) + ">"
        if self.overflow:
            return "map<string,variant>"
        return f"array<{SPARK[self.type]}>" if self.array else SPARK[self.type]


@dataclass(frozen=True)
class ShapeSpec:
    name: str
    fields: tuple[FieldSpec, ...] = field(default_factory=tuple)
    description: str = ""

    def __post_init__(self):
        keys = [f.key for f in self.fields if not (f.skip or f.flatten or f.overflow)]
        if twice := sorted({k for k in keys if keys.count(k) > 1}):
            raise InvalidSpec(f"{self.name}: two fields read {', '.join(twice)}")
        if sum(f.overflow for f in self.fields) > 1:
            raise InvalidSpec(f"{self.name}: two overflow fields")

    def known(self) -> list[str]:
        """The keys that fields use up."""
        out = []
        for f in self.fields:
            out += f.type.known() if f.flatten else [] if f.skip or f.overflow else [f.key]
        return out

    def tool_definition(self) -> dict:
        """The contract as a tool's input schema; fields that aren't optional are required."""
        listed = [f for f in self.fields if not f.overflow]
        kind = lambda f: "array" if f.array else "object" if f.flatten else JSON_TYPES.get(f.type, "integer")
        properties = {f.key: {"type": kind(f)} | ({"description": f.description} if f.description else {}) for f in listed}
        return {
            "name": re.sub(r"(?<!^)(?=[A-Z])", "_", self.name).lower(),
            "description": self.description,
            "input_schema": {"type": "object", "properties": properties, "required": [f.key for f in listed if not f.optional]},
        }

    def apply(self, df: DataFrame, doc: str, mode: Mode = LENIENT, value: str = "value", default_missing: bool = False) -> DataFrame:
        """`df` with STRUCT `value`, `_residual` (what a mode that absorbs kept), `_diag` and `_error` (NULL if the row fits).

        `default_missing` gives fields that are missing their type's default in any mode. Fields are coerced as they say
        themselves, whatever the mode's level.
        """
        made = shape_struct(self, F.col(doc), default_missing)
        out = df.withColumn("_shape", made)
        error = F.col("_shape.error")
        if mode is STRICT:
            unknown = F.map_keys(F.col("_shape.unknown"))
            bent = F.filter("_shape.diag", lambda d: d["kind"] == "coerced")
            error = F.coalesce(
                error,
                F.when(F.size(unknown) > 0, F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", "))),
                F.when(F.size(bent) > 0, F.concat(F.lit("coerced: "), F.array_join(F.transform(bent, lambda d: d["path"]), ", "))),
            )
        residual = F.when(F.lit(mode is ABSORBING), F.col("_shape.unknown"))
        return out.withColumns({value: F.when(error.isNull(), F.col("_shape.value")), "_residual": residual, "_diag": F.col("_shape.diag"), "_error": error}).drop("_shape")

    def split(self, df: DataFrame, doc: str, mode: Mode = STRICT) -> tuple[DataFrame, DataFrame]:
        """Rows that fit, and rows that don't with their `_error`."""
        out = self.apply(df, doc, mode)
        return out.where(F.col("_error").isNull()).drop("_error"), out.where(F.col("_error").isNotNull())

    def strictly(self, df: DataFrame, doc: str) -> DataFrame:
        """Rows that fit; one that doesn't fails the query."""
        out = self.apply(df, doc, STRICT)
        return out.where(F.when(F.col("_error").isNull(), True).otherwise(F.raise_error(F.col("_error")).cast("boolean"))).drop("_error")


def _told(path: str, d: Column) -> Column:
    return F.when(d.isNotNull(), F.struct(F.lit(path).alias("path"), d["kind"].alias("kind"), d["a"].alias("a"), d["b"].alias("b"), d["risk"].alias("risk"), d["suggestion"].alias("suggestion")).cast(TOLD))


def _read(f: FieldSpec, fields: Column, default_missing: bool) -> Column:
    """STRUCT<value, error, diag> of a field."""
    out = lambda value, error=None, diag=None: F.struct(
        value.cast(f.spark_type).alias("value"),
        (F.lit(None) if error is None else error).cast("string").alias("error"),
        F.array_compact(F.array(*(diag or [F.lit(None).cast(TOLD)]))).alias("diag"),
    )
    empty = F.array().cast(f.spark_type) if f.array else F.lit(None).cast(f.spark_type) if f.optional or f.type == "raw" else default(f.type)
    if f.skip:
        return out(empty)
    config = ShapeConfig(level=Level.BEST_EFFORT if f.coerce else Level.EXACT)
    raw = F.try_element_at(fields, F.lit(f.key))
    if f.parse_json_string:
        text = V.string(raw)
        raw = F.coalesce(F.when(text.isNotNull(), F.try_parse_json(text)), raw)

    def one(v: Column) -> Column:
        absent, null = v.isNull(), F.coalesce(F.is_variant_null(v), F.lit(False))
        if f.type == "raw" and not f.array:
            present = out(v)
        elif f.array:
            wrapped = F.when(V.kind(v) == "array", V.elements(v)).otherwise(F.array(v)) if f.coerce else F.when(V.kind(v) == "array", V.elements(v))
            each = F.transform(wrapped, lambda e: coerce(e, f.type, config, chain=False)) if f.type != "raw" else F.transform(wrapped, lambda e: F.struct(e.alias("value"), F.lit(True).alias("ok"), F.lit(None).cast("struct<kind:string,a:string,b:string,risk:int,suggestion:string>").alias("diag")))

            def listed(c: Column) -> Column:
                fine = F.coalesce(F.forall(c, lambda x: x["ok"]), F.lit(False))
                told = F.filter(F.transform(c, lambda x: _told(f.key, x["diag"])), lambda x: x.isNotNull())
                bad = F.struct(empty.alias("value"), (F.lit(None) if f.default and f.coerce else F.lit(f"{f.key}: not an array of {f.type}")).cast("string").alias("error"), F.array().cast(f"array<{TOLD}>").alias("diag"))
                good = F.struct(F.transform(c, lambda x: x["value"]).cast(f.spark_type).alias("value"), F.lit(None).cast("string").alias("error"), told.alias("diag"))
                return F.when(fine, good).otherwise(bad)

            present = X.let(each, listed)
        else:

            def single(c: Column) -> Column:
                failed = out(F.lit(None), F.concat(F.lit(f"{f.key}: not "), F.lit(f.type)), [_told(f.key, c["diag"])])
                if f.coerce and f.default:
                    lost = diagnostic("error_defaulted", f.key, "default", WARNING, None)
                    failed = out(empty, None, [_told(f.key, lost)])
                return F.when(c["ok"], out(c["value"], None, [_told(f.key, c["diag"])])).otherwise(failed)

            present = X.let(coerce(v, f.type, config, optional=f.optional, chain=False), single)
        if f.optional:
            return F.when(absent | null, out(F.lit(None))).otherwise(present)
        if f.default or (default_missing and not f.coerce):
            gone = absent | null if f.default else absent
            return F.when(gone, out(empty)).otherwise(present)
        missing = out(empty) if default_missing else out(F.lit(None), F.lit(f"{f.key}: missing"))
        return F.when(absent, missing).otherwise(present)

    return X.let(raw, one)


def shape_struct(spec: ShapeSpec, doc: Column, default_missing: bool = False) -> Column:
    """STRUCT<value, unknown, diag, error> of a document; a document that is no object has an error only."""
    known = spec.known()

    def read(s: ShapeSpec, fields: Column) -> Column:
        parts = []
        for f in s.fields:
            if f.flatten:
                inner = read(f.type, fields)
                parts.append((f, X.let(inner, lambda x: F.struct(x["value"].alias("value"), x["error"].alias("error"), x["diag"].alias("diag")))))
            elif not f.overflow:
                parts.append((f, _read(f, fields, default_missing)))
        every = F.struct(*(c.alias(f"c{i}") for i, (_, c) in enumerate(parts)))

        def joined(x: Column) -> Column:
            at = {f.name: f"c{i}" for i, (f, _) in enumerate(parts)}
            rest = F.map_filter(fields, lambda k, _: ~k.isin(*known)) if known else fields
            value = F.struct(*((F.when(F.lit(not f.optional) | (F.size(rest) > 0), rest) if f.overflow else x[at[f.name]]["value"]).alias(f.name) for f in s.fields))
            error = F.coalesce(*(x[c]["error"] for c in at.values())) if at else F.lit(None).cast("string")
            diag = F.flatten(F.array(*(x[c]["diag"] for c in at.values()))) if at else F.array().cast(f"array<{TOLD}>")
            return F.struct(value.alias("value"), error.alias("error"), diag.alias("diag"))

        return X.let(every, joined)

    keeps = any(f.overflow for f in spec.fields)

    def whole(fields: Column) -> Column:
        unknown = F.map_filter(fields, lambda k, _: ~k.isin(*known)) if known else fields
        notes = F.transform(F.map_keys(unknown), lambda k: F.struct(k.alias("path"), F.lit("preserved" if keeps else "dropped").alias("kind"), k.alias("a"), F.lit(None).alias("b"), F.lit(INFO).alias("risk"), F.lit(None).alias("suggestion")).cast(TOLD))
        return X.let(read(spec, fields), lambda r: F.struct(r["value"].alias("value"), unknown.alias("unknown"), F.concat(r["diag"], notes).alias("diag"), r["error"].alias("error")))

    def none(reason: str) -> Column:
        kind = "struct<" + ",".join(f"`{f.name}`:{f.spark_type}" for f in spec.fields) + ">"
        return F.struct(F.lit(None).cast(kind).alias("value"), F.lit(None).cast("map<string,variant>").alias("unknown"), F.array().cast(f"array<{TOLD}>").alias("diag"), F.lit(reason).alias("error"))

    fields = V.fields(doc)
    return F.when(fields.isNotNull(), X.let(fields, whole)).otherwise(none("(root): not an object"))


def to_json(spec: ShapeSpec, value: Column, pretty: bool = False) -> Column:
    """A shaped value as JSON again: its fields by their keys, flattened ones in place, then the overflow."""

    def entries(s: ShapeSpec, v: Column) -> list[Column]:
        out = []
        for f in s.fields:
            if f.flatten:
                out += entries(f.type, v[f.name])
            elif f.overflow:
                out.append(F.coalesce(v[f.name], F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))))
            else:
                boxed = F.to_variant_object(F.array(v[f.name]))
                item = v[f.name] if f.type == "raw" and not f.array else F.try_variant_get(boxed, "$[0]", "variant")
                out.append(F.create_map(F.lit(f.key), F.coalesce(item, F.parse_json(F.lit("null")))))
        return out

    whole = F.to_variant_object(F.map_concat(*entries(spec, value)))
    return V.pretty(whole) if pretty else F.to_json(whole)


def check(df: DataFrame) -> DataFrame:
    """Raises on the driver if any row was refused, naming the first."""
    bad = df.where(F.col("_error").isNotNull()).select("_error").head()
    if bad:
        raise ShapingFailed(bad[0])
    return df
