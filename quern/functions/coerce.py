"""Coercion of JSON values to declared types, with at most one diagnostic a value.

`coerce` gives STRUCT<value, ok, coerced, diag>: the typed value (NULL if there is none), whether the value has its
type now, whether it was changed, and what to tell about it. Rules are tried in a fixed order that is part of their meaning:
plain numbers, radix digits, US, European and other groupings, underscores, null words.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.errors import NOT_FOUND, OUT_OF_BOUNDS, TYPE_MISMATCH
from quern.functions import text as X
from quern.functions import variants as V
from quern.functions.diagnostics import INFO, RISKY, WARNING, diagnostic, none
from quern.functions.paths import parse_path
from quern.plans.config import Level, Packs, ShapeConfig

#: Integer targets: Spark type, least and largest value.
INTEGERS = {
    "i8": ("tinyint", -(2**7), 2**7 - 1),
    "i16": ("smallint", -(2**15), 2**15 - 1),
    "i32": ("int", -(2**31), 2**31 - 1),
    "i64": ("bigint", -(2**63), 2**63 - 1),
    "u8": ("smallint", 0, 2**8 - 1),
    "u16": ("int", 0, 2**16 - 1),
    "u32": ("bigint", 0, 2**32 - 1),
    "u64": ("decimal(20,0)", 0, 2**64 - 1),
    "usize": ("decimal(20,0)", 0, 2**64 - 1),
    "isize": ("bigint", -(2**63), 2**63 - 1),
}
FLOATS = {"f32": "float", "f64": "double"}
SPARK = {k: v[0] for k, v in INTEGERS.items()} | FLOATS | {"bool": "boolean", "string": "string", "raw": "variant"}
#: Words that stand for no value, and for true and false.
NULL_WORDS = ("null", "none", "n/a", "na", "nil", "nan", "unknown", "undefined", "-")
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "on", "y", "t"), ("false", "0", "no", "off", "n", "f")
F32_MAX, F32_TINY, EXACT_F64 = 3.4028235677973366e38, 7.006492321624085e-46, 2**53


def result(target: str, value: Column | None, ok: Column | bool, coerced: Column | bool, diag: Column | None = None) -> Column:
    kind = SPARK[target]
    typed = F.lit(None).cast(kind) if value is None else value.cast(kind)
    flag = lambda x: F.lit(x) if isinstance(x, bool) else x
    return F.struct(typed.alias("value"), flag(ok).alias("ok"), flag(coerced).alias("coerced"), (none() if diag is None else diag).alias("diag"))


def _changed(target: str, value: Column, source: str, risk: int, hint: str | None = None) -> Column:
    return result(target, value, True, True, diagnostic("coerced", source, target, risk, hint))


def _refused(target: str, source: str, risk: int, hint: str) -> Column:
    return result(target, None, False, False, diagnostic("coerced", source, target, risk, hint))


def _unchanged(target: str) -> Column:
    """A value of another type that no rule takes."""
    return result(target, None, False, False)


def _to_null(target: str, source: str, config: ShapeConfig, optional: bool, chain: bool) -> Column:
    """A word for no value: null where that is allowed, the default for a bare type if null words are followed up."""
    diag = diagnostic("coerced", source, "null", WARNING, "use an actual null in the source data")
    if optional:
        return result(target, None, True, True, diag)
    if chain:
        return result(target, default(target), True, True, diag)
    return result(target, None, False, True, diag)


def default(target: str) -> Column:
    return F.lit("").cast("string") if target == "string" else F.lit(False) if target == "bool" else F.lit(0).cast(SPARK[target])


def fits(value: Column, target: str) -> Column:
    _, low, high = INTEGERS[target]
    return value.between(X.whole(low), X.whole(high))


def _integer_text(t: Column, target: str, level: Level, after: Column) -> Column:
    """A trimmed text to an integer; `after` is what happens to texts that are no integer."""

    def within(value: Column, source: str, risk: int, hint: str, low: int = X.I64[0], high: int = X.I64[1]) -> Column:
        """NULL where the value is NULL or out of bounds."""
        fitting = lambda v: F.when(fits(v, target), _changed(target, v, source, risk, hint)).otherwise(_refused(target, source, RISKY, "integer overflows the target type"))
        return X.let(value, lambda v: F.when(v.between(X.whole(low), X.whole(high)), fitting(v)))

    # A rule is only tried on texts with its separator, and its value is worked out once.
    tried = [F.when(X.whole_number(t), within(t.try_cast("decimal(38,0)"), "string", INFO, "use an integer type in the source data", high=X.U64_MAX))]
    tried.append(F.when(t.startswith("0"), within(X.radix(t), "radix-prefixed string", WARNING, "use a decimal integer in the source data")))
    if level >= Level.BEST_EFFORT:
        separators = "remove thousands separators from numeric strings"
        scored = lambda bare: F.coalesce(
            within(X.integer(bare), "underscore-formatted string", WARNING, "remove underscores from numeric strings"),
            within(X.radix(bare), "underscore-formatted radix string", WARNING, "remove underscores and use decimal integers"),
        )
        tried += [
            F.when(X.has(t, ","), within(X.let(X.us_thousands(t), X.integer), "comma-formatted string", WARNING, separators)),
            F.when(X.has(t, "."), within(X.let(X.european(t), X.integer), "European-formatted string", WARNING, "use a dot for decimals and commas for thousands")),
            F.when(X.has(t, "'") | X.has(t, " "), within(X.let(X.other_thousands(t), X.integer), "locale-formatted string", WARNING, separators)),
            F.when(X.has(t, "_"), X.let(X.underscores(t), scored)),
        ]
    return F.coalesce(*tried, after)


def _float_text(t: Column, target: str, config: ShapeConfig, optional: bool, chain: bool, after: Column) -> Column:
    hint = "string-to-float coercion may lose decimal precision"
    best = config.level >= Level.BEST_EFFORT

    def number(value: Column, source: str, note: str) -> Column:
        """NULL where the value is NULL."""

        def one(v: Column) -> Column:
            out = _changed(target, v, source, WARNING, note)
            if target == "f32":
                out = F.when((F.abs(v) < F32_TINY) & (v != 0), _refused(target, source, WARNING, "value underflows f32")).otherwise(out)
                out = F.when(F.abs(v) >= F32_MAX, _refused(target, source, RISKY, "value overflows f32 range")).otherwise(out)
            return F.when(F.abs(v) == float("inf"), _refused(target, source, RISKY, "Infinity can't be represented in JSON")).otherwise(out)

        return X.let(value, lambda v: F.when(v.isNotNull(), one(v)))

    # A rule is only tried on texts with its separator, and its value is worked out once.
    tried = [F.when(t.rlike(X.FLOAT), number(t.try_cast("double"), "string", hint))]
    if best:
        fine = lambda v: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
        for there, value, source in (
            (X.has(t, ","), X.us_thousands(t), "comma-formatted string"),
            (X.has(t, "."), X.european(t), "European-formatted string"),
            (X.has(t, "'") | X.has(t, " "), X.other_thousands(t), "locale-formatted string"),
            (X.has(t, "_"), X.underscores(t), "underscore-formatted string"),
        ):
            found = X.let(X.let(value, X.any_float), fine)
            tried.append(F.when(there, number(found, source, "remove separators from numeric strings")))
    out = F.coalesce(*tried, after)
    infinite = _refused(target, "string", RISKY, "Infinity can't be represented in JSON")
    nan = _to_null(target, "NaN string", config, optional, chain) if best else _unchanged(target)
    return F.when(~F.right(t, F.lit(1)).between("0", "9") & t.rlike(X.SPECIAL), F.when(F.lower(t).rlike("nan$"), nan).otherwise(infinite)).otherwise(out)


def _string(t: Column, raw: Column, target: str, config: ShapeConfig, optional: bool, chain: bool) -> Column:
    """A text to another type."""
    after = _unchanged(target)
    if config.packs is not Packs.NONE and (target in FLOATS or target in ("i64", "i32", "u64", "u32")):
        after = _packs(t, target, config.packs)
    if config.level >= Level.BEST_EFFORT:
        lower = F.lower(raw if target == "bool" else t)
        after = F.when(lower.isin(*NULL_WORDS), _to_null(target, "null-sentinel string", config, optional, chain)).otherwise(after)
        # An object or array is no value of the target yet, but the text was opened up and that is told.
        after = F.when(_holds_json(t), result(target, None, False, True, stringified())).otherwise(after)
    if target == "bool":
        word = F.lower(t)
        return (
            F.when(word.isin(*TRUE_WORDS), _changed(target, F.lit(True), "string", INFO))
            .when(word.isin(*FALSE_WORDS), _changed(target, F.lit(False), "string", INFO))
            .otherwise(after)
        )
    if target in INTEGERS:
        return _integer_text(t, target, config.level, after)
    return _float_text(t, target, config, optional, chain, after)


def _holds_json(t: Column) -> Column:
    return F.coalesce(t.rlike(r"^(\{[\s\S]*\}|\[[\s\S]*\])$") & F.try_parse_json(t).isNotNull(), F.lit(False))


def stringified() -> Column:
    return diagnostic("coerced", "stringified JSON", "parsed value", WARNING, "send structured data instead of JSON in a string")


def _packs(t: Column, target: str, packs: Packs) -> Column:
    """Currency, then units. A pack's number is a float, so it never fits an integer type."""
    from quern.functions import currency, units

    found = F.lit(None).cast("double")
    source = "pack"
    if packs in (Packs.UNITS, Packs.ALL):
        found, source = units.parse(t)["amount"], "unit string"
    if packs in (Packs.CURRENCY, Packs.ALL):
        found, source = F.coalesce(currency.parse(t)["amount"], found), "currency or unit string" if packs is Packs.ALL else "currency string"
    if target not in FLOATS:
        return _unchanged(target)
    return X.let(found, lambda v: F.when(v.isNotNull(), _changed(target, v, source, WARNING, "store numbers without symbols")).otherwise(_unchanged(target)))


def coerce(value: Column, target: str, config: ShapeConfig | None = None, optional: bool = False, chain: bool = True) -> Column:
    """`value` (VARIANT) as `target`.

    `optional`: null and words for it stay null. `chain`: a word for null becomes the default of a bare type (as a value
    taken by a path does; a struct's field doesn't). An absent value is not ok and has no diagnostic.
    """
    config = config or ShapeConfig()
    if target == "raw":
        return result(target, value, True, False)
    facts = F.struct(value.alias("v"), V.kind(value).alias("k"), F.try_variant_get(value, "$", "string").alias("s"))
    return X.let(facts, lambda x: _by_kind(x["v"], x["k"], x["s"], target, config, optional, chain))


def _missing(target: str, config: ShapeConfig, optional: bool) -> Column:
    """A JSON null."""
    if optional:
        return result(target, None, True, False)
    if config.level >= Level.BEST_EFFORT:
        return result(target, default(target), True, True, diagnostic("defaulted", "null → default", None, WARNING, "consider an optional field"))
    return _unchanged(target)


def coerce_text(text: Column, target: str, config: ShapeConfig | None = None, optional: bool = False, chain: bool = True) -> Column:
    """`coerce` of a text (STRING) as a JSON string value, without the way through VARIANT. A NULL counts as a JSON null."""
    config = config or ShapeConfig()
    if target in ("raw", "string") or config.level < Level.STRING_COERCION:
        return coerce(F.try_variant_get(F.to_variant_object(F.array(text)), "$[0]", "variant"), target, config, optional, chain)
    there = lambda raw: X.let(X.trim_bound(raw), lambda t: _string(t, raw, target, config, optional, chain))
    return X.let(text, lambda raw: F.when(raw.isNull(), _missing(target, config, optional)).otherwise(there(raw)))


def _by_kind(v: Column, k: Column, s: Column, target: str, config: ShapeConfig, optional: bool, chain: bool) -> Column:
    level = config.level
    safe, text, best = (level >= x for x in (Level.SAFE_WIDENING, Level.STRING_COERCION, Level.BEST_EFFORT))
    out = _unchanged(target)
    if best:
        only = V.elements(v)
        inner = X.let(only[0], lambda e: _exact(e, V.kind(e), target, "single-element array", WARNING))
        array = F.when((k == "array") & (F.size(only) == 1), inner) if target != "string" else F.when(F.lit(False), out)
        out = array.otherwise(out)
    dec, dbl = F.try_variant_get(v, "$", "decimal(38,0)"), F.try_variant_get(v, "$", "double")
    if target in INTEGERS:
        whole = X.let(dec.cast("decimal(38,0)"), lambda d: F.when(fits(d, target), _changed(target, d, "float", INFO, "use an integer in the source data")).otherwise(_refused(target, "float", RISKY, "value overflows the target type")))
        fraction = _refused(target, "float", RISKY, "float has fractional part")
        number = F.when(k == "float", F.when((dbl == F.floor(dbl)) & dbl.between(-(2.0**63), 2.0**63), whole).otherwise(fraction) if safe else _unchanged(target))
        over = _refused(target, "integer", RISKY, "value overflows the target type") if safe else _unchanged(target)
        number = number.when(k == "integer", F.when(fits(dec, target), result(target, dec, True, False)).otherwise(over))
        flag = _changed(target, F.try_variant_get(v, "$", "boolean").cast("int"), "bool", INFO, "use an integer type in the source data") if safe else _unchanged(target)
        out = number.when(k == "bool", flag).otherwise(out)
    elif target in FLOATS:
        exact = _refused(target, "integer", WARNING, "integer to float needs safe widening")
        risk = F.when(F.abs(dec) > EXACT_F64, WARNING).otherwise(INFO)
        widened = result(target, dbl, True, True, diagnostic("coerced", "integer", target, risk)) if safe else exact
        float_ = result(target, dbl, True, False)
        if target == "f32" and safe:
            float_ = F.when((F.abs(dbl) < F32_TINY) & (dbl != 0), _refused(target, "f64", WARNING, "value underflows f32")).otherwise(float_)
            float_ = F.when(F.abs(dbl) >= F32_MAX, _refused(target, "f64", RISKY, "value overflows f32 range")).otherwise(float_)
        flag = _changed(target, F.try_variant_get(v, "$", "boolean").cast("int"), "bool", INFO, "use a numeric type in the source data") if safe else _unchanged(target)
        out = F.when(k == "integer", widened).when(k == "float", float_).when(k == "bool", flag).otherwise(out)
    elif target == "bool":
        other = _refused(target, "integer", RISKY, "integer other than 0 or 1")
        number = F.when(dec.isin(0, 1), _changed(target, dec == 1, "integer", INFO, "use a boolean type in the source data")).otherwise(other)
        out = F.when((k == "integer") & F.lit(safe), number).when(k == "bool", result(target, F.try_variant_get(v, "$", "boolean"), True, False)).otherwise(out)
    else:
        for name, source, value, risk, there in (
            ("array", "object/array", F.to_json(v), WARNING, best),
            ("object", "object/array", F.to_json(v), WARNING, best),
            ("bool", "bool", F.to_json(v), INFO, text),
            ("integer", "number", F.to_json(v), INFO, text),
            ("float", "number", V.number_text(v), INFO, text),
        ):
            out = F.when(k == name, _changed(target, value, source, risk) if there else _unchanged(target)).otherwise(out)
        out = F.when(k == "string", result(target, s, True, False)).otherwise(out)
    if text and target != "string":
        out = F.when(k == "string", X.let(X.trim(s), lambda t: _string(t, s, target, config, optional, chain))).otherwise(out)
    return F.when(k == "null", _missing(target, config, optional)).when(k.isNull(), _unchanged(target)).otherwise(out)


def _exact(v: Column, k: Column, target: str, source: str, risk: int) -> Column:
    """A value of the target's own kind, taken as it is; others aren't coerced again."""
    dec = F.try_variant_get(v, "$", "decimal(38,0)")
    if target in INTEGERS:
        mine, value = (k == "integer") & fits(dec, target), dec
    elif target in FLOATS:
        mine, value = k.isin("integer", "float"), F.try_variant_get(v, "$", "double")
    elif target == "bool":
        mine, value = k == "bool", F.try_variant_get(v, "$", "boolean")
    else:
        mine, value = k == "string", F.try_variant_get(v, "$", "string")
    diag = diagnostic("coerced", source, target, risk, "unwrap single-element arrays in the source data")
    return F.when(mine, result(target, value, True, True, diag)).otherwise(result(target, None, False, True, diag))


def coerce_array(value: Column, target: str, config: ShapeConfig | None = None) -> Column:
    """An array to ARRAY<target>, element by element: STRUCT<value, ok, coerced, diag>; more than one diagnostic is summed up in one. A text that
    holds an array is taken for it at the loosest level, which is told if the elements have nothing to tell."""
    config = config or ShapeConfig()
    text = X.trim(V.string(value))
    opened = F.coalesce(text.rlike(V.ARRAY_TEXT) & F.try_parse_json(text).isNotNull(), F.lit(False)) if config.level >= Level.BEST_EFFORT else F.lit(False)
    each = F.transform(V.elements(value), lambda e: coerce(e, target, config))

    def summed(items: Column) -> Column:
        told = F.filter(F.transform(items, lambda x, i: F.struct(i.alias("i"), x["diag"].alias("d"))), lambda x: x["d"].isNotNull())
        worst = F.array_max(F.transform(told, lambda x: x["d"]["risk"]))
        paths = F.array_join(F.transform(told, lambda x: F.concat(F.lit("["), x["i"].cast("string"), F.lit("]"))), ", ")
        diag = F.when(F.size(told) == 1, told[0]["d"]).when(F.size(told) > 1, diagnostic("coerced", F.concat(F.lit("mixed array "), paths), target, worst))
        return F.struct(
            F.transform(items, lambda x: x["value"]).alias("value"),
            F.forall(items, lambda x: x["ok"]).alias("ok"),
            (F.exists(items, lambda x: x["coerced"]) | opened).alias("coerced"),
            F.coalesce(diag, F.when(opened, stringified())).alias("diag"),
        )

    return F.when((V.kind(value) == "array") | opened, X.let(each, summed))


def extract(value: Column, path: str, target: str, config: ShapeConfig | None = None, optional: bool = False) -> Column:
    """STRUCT<value, ok, coerced, diag, status>: what stands at a path as `target`."""

    def one(x: Column) -> Column:
        return X.let(
            coerce(x["value"], target, config, optional),
            lambda c: F.struct(
                c["value"].alias("value"), c["ok"].alias("ok"), c["coerced"].alias("coerced"), c["diag"].alias("diag"),
                F.when(x["status"] != "ok", x["status"]).when(c["ok"], F.lit("ok")).otherwise(F.lit("coercion_failed")).alias("status"),
            ),
        )

    return X.let(V.walk(value, path), one)


def try_maybe(value: Column, path: str, target: str, config: ShapeConfig | None = None) -> Column:
    """STRUCT<value, status, diag>: status is `none` where the path is missing, out of bounds or null, or null before its end; `ok`; or why
    there is no value though something is there."""
    segments = parse_path(path)
    gone = [F.coalesce(F.is_variant_null(V.walk(value, segments[:n])["value"]), F.lit(False)) for n in range(len(segments))]
    null_before = reduce(lambda a, b: a | b, gone, F.lit(False))

    def one(x: Column) -> Column:
        missing = x["status"].isin(NOT_FOUND, OUT_OF_BOUNDS) | ((x["status"] == TYPE_MISMATCH) & null_before)
        nothing = missing | ((x["status"] == "ok") & F.coalesce(F.is_variant_null(x["there"]), F.lit(False)))
        return F.struct(F.when(~nothing, x["value"]).alias("value"), F.when(nothing, F.lit("none")).otherwise(x["status"]).alias("status"), F.when(~nothing, x["diag"]).alias("diag"))

    found = lambda e: F.struct(e["value"].alias("value"), e["status"].alias("status"), e["diag"].alias("diag"), V.at(value, path).alias("there"))
    return X.let(X.let(extract(value, path, target, config, optional=True), found), one)


def maybe(value: Column, path: str, target: str, config: ShapeConfig | None = None) -> Column:
    """The value at a path; NULL where it is missing or null, or null before its end. A value that can't be coerced fails the query; `try_maybe`
    tells of it instead."""
    found = try_maybe(value, path, target, config)
    failed = F.raise_error(F.concat(F.lit(f"{path}: "), found["status"])).cast(SPARK[target])
    return F.when(found["status"].isin("ok", "none"), found["value"]).otherwise(failed)


def required(value: Column, path: str, target: str, config: ShapeConfig | None = None) -> Column:
    """The value at a path; a row without one fails the query."""
    found = extract(value, path, target, config)
    return F.when(found["status"] == "ok", found["value"]).otherwise(F.raise_error(F.concat(F.lit(f"{path}: "), found["status"])).cast(SPARK[target]))


def shape(value: Column, path: str, target: str, mode, config: ShapeConfig | None = None) -> Column:
    """`extract` at the coercion level of a mode."""
    return extract(value, path, target, (config or ShapeConfig()).with_mode(mode))


#: User types: the target that a value is coerced to first, and what makes the type's value of it (NULL refuses it).
USER_TYPES: dict[str, tuple[str, Callable[[Column], Column]]] = {}


def register_type(name: str, base: str, make: Callable[[Column], Column]) -> None:
    if base not in SPARK:
        raise ValueError(f"unknown target {base!r}")
    USER_TYPES[name] = base, make


def coerce_user(value: Column, name: str, config: ShapeConfig | None = None, optional: bool = False) -> Column:
    """STRUCT<value, ok, coerced, diag> of a registered type."""
    base, make = USER_TYPES[name]

    def one(c: Column) -> Column:
        made = X.let(c["value"], make)
        return F.struct(made.alias("value"), (c["ok"] & (made.isNotNull() | c["value"].isNull())).alias("ok"), c["coerced"].alias("coerced"), c["diag"].alias("diag"))

    return X.let(coerce(value, base, config, optional), one)
