"""Schemas of JSON rows: inference, external constraints, audit.

Rows are DataFrames with `row_idx` (BIGINT, from 0) and `doc` (VARIANT). Rows that aren't objects count in the totals and are
otherwise skipped. Field names are the data's own, at the top level only.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions import variants as V
from quern.functions.lookup import lookup

#: Kinds from the widest, which wins ties, and their names in reports.
WIDEST = ("string", "object", "array", "float", "integer", "bool", "null")
NAMES = {"string": "String", "object": "Object", "array": "Array", "float": "Float", "integer": "Integer", "bool": "Bool", "null": "Null"}
#: Names of kinds in schema files.
TYPE_NAMES = {
    "string": "string text varchar", "integer": "integer int bigint smallint", "float": "float double real numeric decimal", "bool": "boolean bool",
    "array": "array", "object": "object json jsonb", "null": "null",
}


def parse_type(name: str) -> str | None:
    return {n: kind for kind, names in TYPE_NAMES.items() for n in names.split()}.get(name.lower())


@dataclass(frozen=True)
class InferenceConfig:
    """Only the first threshold has a use; the others are accepted and looked at by nothing."""

    required_threshold: float = 1.0
    consistency_threshold: float = 0.95
    max_enum_cardinality: int = 20


@dataclass(frozen=True)
class Constraint:
    """What is said of a field from outside. Both flags replace what was inferred, defaults too."""

    type: str | None = None
    required: bool = False
    nullable: bool = True
    max_length: int | None = None
    min_value: float | None = None
    max_value: float | None = None
    allowed: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Field:
    name: str
    total: int
    present: int
    absent: int
    nulls: int
    kinds: dict[str, int]
    samples: tuple[str, ...] = ()
    outside: Constraint | None = None

    @property
    def dominant(self) -> str | None:
        """The most frequent kind, the wider one among equals; None if there are only nulls."""
        return max(self.kinds, key=lambda k: (self.kinds[k], -WIDEST.index(k)), default=None)

    @property
    def fill_rate(self) -> float:
        return (self.present - self.nulls) / self.total if self.total else 0.0

    @property
    def appears_required(self) -> bool:
        return not self.absent and not self.nulls

    @property
    def mixed(self) -> bool:
        return len(self.kinds) > 1

    @property
    def consistency(self) -> float:
        every = sum(self.kinds.values())
        return self.kinds[self.dominant] / every if every else 1.0

    @property
    def type(self) -> str | None:
        return self.outside.type if self.outside and self.outside.type else self.dominant

    @property
    def nullable(self) -> bool:
        return self.outside.nullable if self.outside else self.nulls > 0


@dataclass(frozen=True)
class Schema:
    """Fields in the order of their first rows."""

    fields: dict[str, Field]
    total: int
    config: InferenceConfig = field(default_factory=InferenceConfig)

    def required(self, f: Field) -> bool:
        return f.outside.required if f.outside else f.fill_rate >= self.config.required_threshold

    def with_constraints(self, constraints: dict[str, Constraint]) -> Schema:
        """Constraints on fields that weren't seen are passed over."""
        return replace(self, fields={n: replace(f, outside=constraints.get(n, f.outside)) for n, f in self.fields.items()})

    def summary(self) -> str:
        lines = [f"{'Field':<20} {'Type':<10} {'Fill%':<8} {'Null%':<8} {'Consistency':<10} {'Mixed?':<8}", "-" * 74]
        for f in self.fields.values():
            nulls = f.nulls / f.total * 100 if f.total else 0.0
            kind = NAMES[f.dominant] if f.dominant else "null"
            lines.append(f"{f.name:<20} {kind:<10} {f'{f.fill_rate * 100:.1f}':<8} {f'{nulls:.1f}':<8} {f'{f.consistency * 100:.1f}':<10} {'YES' if f.mixed else 'no':<8}")
        return "\n".join(lines)

    def as_dict(self) -> dict:
        fields = {
            f.name: {
                "type": NAMES[f.dominant] if f.dominant else "null", "fill_rate": f.fill_rate, "null_count": f.nulls, "present_count": f.present,
                "absent_count": f.absent, "mixed_type": f.mixed, "consistency": f.consistency,
            } | ({"sample_values": list(f.samples)} if f.samples else {})
            for f in self.fields.values()
        }
        return {"total_records": self.total, "fields": fields}


def field_counts(rows: DataFrame) -> DataFrame:
    """One row a field: field, present, nulls, a count for each kind, first_row. One shuffle of as many rows as there are fields."""
    each = rows.select("row_idx", F.explode(V.fields(F.col("doc"))).alias("field", "value")).select("row_idx", "field", V.schema_kind(F.col("value")).alias("kind"))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in WIDEST]
    return each.groupBy("field").agg(F.count("*").alias("present"), *counts, F.min("row_idx").alias("first_row")).withColumnRenamed("n_null", "nulls")


def field_samples(rows: DataFrame, most: int = 20) -> DataFrame:
    """field, samples: the first `most` distinct texts of a field in order of their rows."""
    each = rows.select("row_idx", F.explode(V.fields(F.col("doc"))).alias("field", "value"))
    texts = each.select("row_idx", "field", V.string(F.col("value")).alias("text")).where(F.col("text").isNotNull())
    first = texts.groupBy("field", "text").agg(F.min("row_idx").alias("at"))
    place = F.row_number().over(Window.partitionBy("field").orderBy("at", "text"))
    kept = first.withColumn("place", place).where(F.col("place") <= most)
    return kept.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("samples"))


def infer(rows: DataFrame, config: InferenceConfig | None = None, samples: bool = True) -> Schema:
    """The schema of rows. What reaches the driver is a row a field.

    A field is absent in each row before the first that has it, object or not, and in each later object without it.
    """
    total, objects = rows.agg(F.count("*"), F.count_if(V.fields(F.col("doc")).isNotNull())).first()
    found = field_counts(rows).orderBy("first_row", "field").collect()
    after = {r["field"]: total - 1 - r["first_row"] for r in found}
    if objects < total and found:
        is_object = V.fields(F.col("doc")).isNotNull()
        counted = rows.agg(*(F.count_if(is_object & (F.col("row_idx") > r["first_row"])) for r in found)).first()
        after = {r["field"]: n for r, n in zip(found, counted, strict=True)}
    told = {r["field"]: tuple(r["samples"]) for r in field_samples(rows).collect()} if samples else {}
    fields = {
        r["field"]: Field(
            r["field"], total, r["present"], r["first_row"] + after[r["field"]] - (r["present"] - 1), r["nulls"],
            {k: r[f"n_{k}"] for k in WIDEST[:-1] if r[f"n_{k}"]}, told.get(r["field"], ()),
        )
        for r in found
    }
    return Schema(fields, total, config or InferenceConfig())


def looks_numeric(text: Column) -> Column:
    """Whether coercion could make a number of a text; wider than coercion itself."""

    def one(s: Column) -> Column:
        bare = F.translate(s, ",'_", "")
        words = ("null", "none", "n/a", "nil", "nan", "infinity", "-infinity", "+infinity", "inf", "-inf")
        return F.lower(s).isin(*words) | bare.rlike("^[-+]*0[xXoObB]") | X.if_float(bare).isNotNull()

    return F.coalesce(X.let(X.trim(text), one), F.lit(False))


def coercible(value: Column, kind: Column, expected: str) -> Column:
    text = F.try_variant_get(value, "$", "string")
    if expected in ("integer", "float"):
        out = (kind == "string") & looks_numeric(text)
        return out | (kind == "integer") if expected == "float" else out
    if expected == "bool":
        words = ("true", "false", "yes", "no", "1", "0", "t", "f", "on", "off")
        return (kind == "string") & F.lower(X.trim(text)).isin(*words) | (kind == "integer")
    return kind.isin("integer", "float", "bool") if expected == "string" else F.lit(False)


VIOLATION = "struct<field:string,kind:string,expected:string,actual:string>"
STAT = "struct<field:string,clean:int,coercible:int,violations:int,missing:int>"


def _violation(name: Column | str, kind: str, expected: Column | str, actual: Column | str) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(text(name).alias("field"), F.lit(kind).alias("kind"), text(expected).alias("expected"), text(actual).alias("actual")).cast(VIOLATION)


def _number_text(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def _checked(f: Field, schema: Schema, value: Column) -> Column:
    """STRUCT<violations, stat> of a field's value, NULL if absent."""
    expected, limits = f.type, f.outside or Constraint()

    def one(x: Column) -> Column:
        v, kind, number = x["v"], x["k"], x["d"]
        text = F.when(kind == "string", F.try_variant_get(v, "$", "string"))
        found = []
        mismatch, loose = F.lit(False), F.lit(False)
        if expected:
            loose = (kind != expected) & coercible(v, kind, expected)
            mismatch = (kind != expected) & ~loose
            found.append(F.when(mismatch, _violation(f.name, "TypeMismatch", NAMES[expected], F.concat(lookup(NAMES, kind), F.lit(" ("), F.to_json(v), F.lit(")")))))
        if limits.max_length is not None:
            found.append(F.when(F.char_length(text) > limits.max_length, _violation(f.name, "ConstraintViolation", f"max_length {limits.max_length}", F.concat(F.lit("length "), F.char_length(text)))))
        numeric = kind.isin("integer", "float")
        if limits.min_value is not None:
            found.append(F.when(numeric & (number < limits.min_value), _violation(f.name, "ConstraintViolation", f"min_value {_number_text(limits.min_value)}", F.to_json(v))))
        if limits.max_value is not None:
            found.append(F.when(numeric & (number > limits.max_value), _violation(f.name, "ConstraintViolation", f"max_value {_number_text(limits.max_value)}", F.to_json(v))))
        if limits.allowed is not None:
            shown = F.coalesce(text, F.when(numeric, V.number_text(v)), F.to_json(v))
            allowed = "one of [" + ", ".join(f'"{a}"' for a in limits.allowed) + "]"
            found.append(F.when(~shown.isin(*limits.allowed), _violation(f.name, "ConstraintViolation", allowed, shown)))
        told = F.filter(F.array(*found), lambda z: z.isNotNull()) if found else F.array().cast(f"array<{VIOLATION}>")
        checks = X.let(told, lambda t: F.struct(t.alias("violations"), _stat(f.name, (F.size(t) == 0) & ~loose, loose, F.size(t), F.lit(False)).alias("stat")))
        null = _violation(f.name, "UnexpectedNull", NAMES[expected] if expected else "non-null", "null")
        clean = F.struct(F.array().cast(f"array<{VIOLATION}>").alias("violations"), _stat(f.name, F.lit(True), F.lit(False), F.lit(0), F.lit(False)).alias("stat"))
        bad = F.struct(F.array(null).alias("violations"), _stat(f.name, F.lit(False), F.lit(False), F.lit(1), F.lit(False)).alias("stat"))
        missing = F.array(_violation(f.name, "MissingRequired", NAMES[expected] if expected else "any", "absent")) if schema.required(f) else F.array().cast(f"array<{VIOLATION}>")
        gone = F.struct(missing.alias("violations"), _stat(f.name, F.lit(False), F.lit(False), F.lit(0), F.lit(True)).alias("stat"))
        return F.when(v.isNull(), gone).when(kind == "null", clean if f.nullable else bad).otherwise(checks)

    return X.let(F.struct(value.alias("v"), V.schema_kind(value).alias("k"), F.try_variant_get(value, "$", "double").alias("d")), one)


def _stat(name: str, clean: Column, loose: Column, violations: Column, missing: Column) -> Column:
    return F.struct(F.lit(name).alias("field"), clean.cast("int").alias("clean"), loose.cast("int").alias("coercible"), violations.alias("violations"), missing.cast("int").alias("missing")).cast(STAT)


@dataclass(frozen=True)
class Report:
    """violations: row_idx, field, kind, expected, actual. field_stats: field, clean, coercible, violations, missing, a row a
    field. totals: total_records, total_violations, one row."""

    violations: DataFrame
    field_stats: DataFrame
    totals: DataFrame

    def summary(self) -> str:
        t = self.totals.first()
        lines = [f"Audit: {t['total_records']} records, {t['total_violations']} violations"]
        lines += [f"\n{'Field':<20} {'Clean':<8} {'Coercible':<10} {'Violation':<10} {'Missing':<8}", "-" * 56]
        for r in self.field_stats.orderBy("field").collect():
            lines.append(f"{r['field']:<20} {r['clean']:<8} {r['coercible']:<10} {r['violations']:<10} {r['missing']:<8}")
        return "\n".join(lines)


def checked(rows: DataFrame, schema: Schema) -> DataFrame:
    """row_idx, violations, stats: every field's checks of every row, in one narrow pass."""
    known = [f for f in schema.fields.values()]

    def of(fields: Column) -> Column:
        checks = F.array(*(_checked(f, schema, F.try_element_at(fields, F.lit(f.name))) for f in known)) if known else F.array().cast(f"array<struct<violations:array<{VIOLATION}>,stat:{STAT}>>")
        names = F.filter(F.map_keys(fields), lambda k: ~k.isin(*(f.name for f in known)) if known else F.lit(True))
        unknown = F.transform(names, lambda k: _violation(k, "UnknownField", "not present", "present"))
        return X.let(checks, lambda c: F.struct(F.concat(F.flatten(F.transform(c, lambda x: x["violations"])), unknown).alias("violations"), F.transform(c, lambda x: x["stat"]).alias("stats")))

    fields = V.fields(F.col("doc"))
    return rows.select("row_idx", fields.alias("fields")).select("row_idx", F.when(F.col("fields").isNotNull(), of(F.col("fields"))).alias("c")).select("row_idx", "c.violations", "c.stats")


def audit(rows: DataFrame, schema: Schema) -> Report:
    """Rows against a schema. Nothing is collected."""
    every = checked(rows, schema)
    violations = every.select("row_idx", F.explode("violations").alias("v")).select("row_idx", "v.*")
    sums = [F.sum(f"s.{c}").alias(c) for c in ("clean", "coercible", "violations", "missing")]
    stats = every.select(F.explode("stats").alias("s")).groupBy("s.field").agg(*sums)
    totals = every.agg(F.count("*").alias("total_records"), F.coalesce(F.sum(F.when(F.col("violations").isNotNull(), F.size("violations"))), F.lit(0)).alias("total_violations"))
    return Report(violations, stats, totals)


def display(row: Column, name: Column, kind: Column, expected: Column, actual: Column) -> Column:
    return F.format_string("Row %d: field '%s' — %s: expected %s, got %s", row, name, kind, expected, actual)
