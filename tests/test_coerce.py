"""Rule tables: value, target, what comes out and how risky that was."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quern.functions import coerce as C
from quern.functions import variants as V
from quern.plans.config import ABSORBING, LENIENT, STRICT, Level, Mode, Packs, ShapeConfig, SourceHint
from quern.plans.queries import as_value

#: JSON text, target, value (None: no value), ok, risk (None: no diagnostic).
CASES = [
    ('"42"', "i64", 42, True, 0), ('" 42 "', "i64", 42, True, 0), ('"300"', "u8", None, False, 2), ('"-1"', "u8", None, False, 2),
    ('"18446744073709551615"', "u64", Decimal("18446744073709551615"), True, 0), ('"18446744073709551615"', "i64", None, False, 2), ('"0xFF"', "i64", 255, True, 1),
    ('"0b101"', "i64", 5, True, 1), ('"0o17"', "i64", 15, True, 1), ('"-0x10"', "i64", None, False, None), ('"1,234"', "i64", 1234, True, 1),
    ('"1,23"', "i64", None, False, None), ('"1.234.567"', "i64", 1234567, True, 1), ('"1\'234"', "i64", 1234, True, 1), ('"1 234"', "i64", 1234, True, 1),
    ('"1_000"', "i64", 1000, True, 1), ('"1__0"', "i64", None, False, None), ('"_1"', "i64", None, False, None), ('"0xF_F"', "i64", 255, True, 1),
    ('"N/A"', "i64", 0, True, 1), ('"nan"', "f64", 0.0, True, 1), ('"Infinity"', "f64", None, False, 2), ('"1e400"', "f64", None, False, 2),
    ('"1e39"', "f32", None, False, 2), ('"1e-50"', "f32", None, False, 1), ('"3.5"', "f64", 3.5, True, 1), ('"1.0d"', "f64", None, False, None),
    ('"1.234,56"', "f64", 1234.56, True, 1), ('"yes"', "bool", True, True, 0), ('" OFF "', "bool", False, True, 0), ('"2"', "bool", None, False, None),
    ("1", "bool", True, True, 0), ("2", "bool", None, False, 2), ("1.5", "bool", None, False, None), ("42", "string", "42", True, 0), ("42.0", "string", "42.0", True, 0),
    ("true", "string", "true", True, 0), ("true", "i8", 1, True, 0), ("true", "f64", 1.0, True, 0), ("300", "u8", None, False, 2), ("200", "u8", 200, True, None),
    ("3.0", "i64", 3, True, 0), ("3.7", "i64", None, False, 2), ("7", "f64", 7.0, True, 0), ("9007199254740993", "f64", 9007199254740992.0, True, 1),
    ('{"b":1,"a":[2]}', "string", '{"a":[2],"b":1}', True, 1), ("null", "i64", 0, True, 1), ("null", "string", "", True, 1), ("[7]", "i64", 7, True, 1),
    ('["42"]', "i64", None, False, 1), ("[1,2]", "i64", None, False, None), ('"abc"', "i64", None, False, None), ('""', "i64", None, False, None),
]


def values(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("v", V.from_json(F.col("t")))


@pytest.mark.parametrize("target", sorted({c[1] for c in CASES}))
def test_rules(spark, target):
    cases = [c for c in CASES if c[1] == target]
    rows = values(spark, [c[0] for c in cases]).select("i", C.coerce(F.col("v"), target).alias("x")).orderBy("i").collect()
    for (text, _, value, ok, risk), r in zip(cases, rows, strict=True):
        assert (r.x.value, r.x.ok, r.x.diag.risk if r.x.diag else None) == (value, ok, risk), text


def test_levels(spark):
    texts = ["7", '"7"', "true", '"N/A"', "null"]
    expected = {
        Level.EXACT: [(False, None), (False, None), (False, None), (False, None), (False, None)],
        Level.SAFE_WIDENING: [(True, 7.0), (False, None), (True, 1.0), (False, None), (False, None)],
        Level.STRING_COERCION: [(True, 7.0), (True, 7.0), (True, 1.0), (False, None), (False, None)],
        Level.BEST_EFFORT: [(True, 7.0), (True, 7.0), (True, 1.0), (True, 0.0), (True, 0.0)],
    }
    df = values(spark, texts)
    for level, want in expected.items():
        rows = df.select("i", C.coerce(F.col("v"), "f64", ShapeConfig(level=level)).alias("x")).orderBy("i").collect()
        assert [(r.x.ok, r.x.value) for r in rows] == want, level


def test_optional_and_absent(spark):
    df = values(spark, ["null", '"N/A"', "not json"])
    rows = df.select("i", C.coerce(F.col("v"), "i64", optional=True).alias("x")).orderBy("i").collect()
    assert [(r.x.value, r.x.ok) for r in rows] == [(None, True), (None, True), (None, False)]


def test_walk(spark):
    doc = '{"a":[{"b":"7"}],"s":"{\\"x\\":[1,2]}","n":null,"d":"[5]"}'
    paths = {
        "a[0].b": "ok", "a[1]": "index_out_of_bounds", "a.b": "path_not_found", "zz": "path_not_found", "a[0].b.c": "type_mismatch", "s.x[1]": "ok", "n": "ok",
        "n.x": "type_mismatch", "d[0]": "ok",
    }
    df = values(spark, [doc])
    row = df.select(*(V.status(F.col("v"), p).alias(f"c{i}") for i, p in enumerate(paths))).first()
    assert list(row) == list(paths.values())
    assert df.select(C.extract(F.col("v"), "s.x[1]", "i64")["value"]).first()[0] == 2
    assert df.select(C.maybe(F.col("v"), "n", "i64")).first()[0] is None
    with pytest.raises(Exception, match="path_not_found"):
        df.select(C.required(F.col("v"), "zz", "i64")).collect()


def test_bom_and_duplicate_keys(spark):
    rows = values(spark, ['﻿{"a":1}', '{"a":1,"a":2}', "{"]).select(F.to_json("v")).collect()
    assert [r[0] for r in rows] == ['{"a":1}', '{"a":2}', None]


def test_array_summary(spark):
    df = values(spark, ['["1","x","0x2"]', '["1"]', '["1", 2]'])
    rows = df.select("i", C.coerce_array(F.col("v"), "i64").alias("x")).orderBy("i").collect()
    assert (rows[0].x.value, rows[0].x.ok) == ([1, None, 2], False)
    assert "mixed array [0], [2]" in rows[0].x.diag.a
    assert rows[1].x.diag.a == "string"
    assert (rows[2].x.value, rows[2].x.ok) == ([1, 2], True)


def test_packs(spark):
    df = values(spark, ['"$1,234.50"', '"5 kg"', '"5"'])
    config = ShapeConfig(packs=Packs.ALL)
    rows = df.select("i", C.coerce(F.col("v"), "f64", config).alias("x"), C.coerce(F.col("v"), "i64", config)["ok"].alias("y")).orderBy("i").collect()
    assert [r.x.value for r in rows] == [1234.5, 5.0, 5.0]
    assert [r.y for r in rows] == [False, False, True]


def test_config():
    assert ShapeConfig(level=Level.EXACT).with_source_hint(SourceHint.CSV).level is Level.BEST_EFFORT
    assert ShapeConfig().with_coercion(Level.EXACT).with_source_hint(SourceHint.ENV).level is Level.EXACT
    assert ShapeConfig(level=Level.EXACT).with_source_hint(SourceHint.JSON).level is Level.EXACT
    assert Mode.parse(" Strict ") is STRICT and STRICT.fail_fast and ABSORBING.require_all and not LENIENT.reject_unknown
    with pytest.raises(ValueError, match="lenient"):
        Mode.parse("loose")


def test_user_types(spark):
    C.register_type("even", "i64", lambda v: F.when(v % 2 == 0, v))
    df = values(spark, ['"4"', "3", "null"])
    rows = df.select("i", C.coerce_user(F.col("v"), "even", optional=True).alias("x")).orderBy("i").collect()
    assert [(r.x.value, r.x.ok) for r in rows] == [(4, True), (None, False), (None, True)]


def test_diagnostics(spark, capsys):
    from quern.functions import diagnostics as D

    df = values(spark, ['"7"', '"0x7"', "7"]).select("i", F.array_compact(F.array(C.coerce(F.col("v"), "u8")["diag"])).alias("_diag"))
    assert D.rows(df).count() == 2 and D.rows(df, at_least=D.WARNING).count() == 1
    text = D.rows(df).where("i = 1").select(D.display(F.col("diag"), "a.b")).first()[0]
    assert text.startswith("[warning] at 'a.b': coerced radix-prefixed string → u8 — ")
    D.show(df)
    assert "radix" in capsys.readouterr().err


def test_lookups(spark):
    from quern.sources.lookups import NoLookups, StaticLookups

    known = StaticLookups({("USD", "EUR"): 0.5}, {("a", "b"): 3.0}, {"t": {"k": "v"}})
    assert (known.exchange_rate("USD", "EUR"), known.conversion_factor("a", "b"), known.lookup("t", "k"), known.lookup("t", "z")) == (0.5, 3.0, "v", None)
    assert NoLookups().exchange_rate("USD", "EUR") is None
    assert known.rates_frame(spark).count() == known.factors_frame(spark).count() == 1
    df = spark.createDataFrame([("k",), ("z",)], "k string")
    assert [r[0] for r in df.select(known.column("t", F.col("k"))).collect()] == ["v", None]


@pytest.mark.parametrize("target", ["i64", "f64"])
def test_a_text_is_coerced_as_its_json_value_is(spark, target):
    texts = ["1,234", "1.234,56", "1.234.567", "1'234.5", "1 234", "1_000", "0x1_f", "0x1f", " 7 ", "n/a", "[1]", "9" * 40, "-inf", "x", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", C.coerce_text(F.col("t"), target).alias("a"), C.coerce(as_value(F.col("t")), target).alias("b")).collect():
        assert row["a"] == row["b"], row["t"]


def test_a_separator_rule_is_planned_once(spark):
    """Each rule's patterns stand once in a plan, behind its separator: not once to ask and once more to tell."""
    plan = spark.range(1).select(C.coerce_text(F.col("id").cast("string"), "i64")["value"].alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("('[0-9]{3})+") == 1
