from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quern.errors import InvalidSpec
from quern.functions import variants as V
from quern.operators import schema as S
from quern.operators.shape import FieldSpec, ShapeSpec, to_json
from quern.plans.config import ABSORBING, STRICT


def rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_idx long, t string").select("row_idx", V.from_json(F.col("t")).alias("doc"))


def test_inference_counts_rows_that_are_no_objects(spark):
    found = S.infer(rows(spark, ["1", '{"a":1}', "2", '{"b":"x","a":null}', '{"b":2.0}']))
    a, b = found.fields["a"], found.fields["b"]
    assert (found.total, list(found.fields)) == (5, ["a", "b"])
    assert (a.present, a.nulls, a.absent, a.kinds) == (2, 1, 2, {"integer": 1})  # one row before it, one later object
    assert (b.present, b.absent, b.kinds, b.dominant, b.samples) == (2, 3, {"string": 1, "integer": 1}, "string", ("x",))
    assert a.fill_rate == pytest.approx(0.2) and b.mixed and b.consistency == 0.5


def test_empty_table(spark):
    none = rows(spark, ["{}"]).limit(0)
    found = S.infer(none)
    assert (found.total, found.fields) == (0, {})
    assert S.audit(none, found).totals.first().total_records == 0


def test_audit_of_training_data_is_clean(spark):
    df = rows(spark, ['{"a":1,"b":"x"}', '{"a":2,"b":null}', '{"a":3}'])
    assert S.audit(df, S.infer(df)).violations.count() == 0


def test_audit_kinds(spark):
    known = S.infer(rows(spark, ['{"a":1,"b":"x"}', '{"a":2,"b":"y"}'])).with_constraints({"b": S.Constraint(max_length=2, allowed=("x", "y")), "nothing": S.Constraint()})
    df = rows(spark, ['{"a":"7","b":"x"}', '{"a":"z","b":"long"}', '{"b":"x","c":1}', '{"a":null,"b":null}', "5"])
    report = S.audit(df, known)
    kinds = sorted((r.row_idx, r.field, r.kind) for r in report.violations.collect())
    assert kinds == [
        (1, "a", "TypeMismatch"), (1, "b", "ConstraintViolation"), (1, "b", "ConstraintViolation"), (2, "a", "MissingRequired"), (2, "c", "UnknownField"), (3, "a", "UnexpectedNull"),
    ]
    stats = {r.field: (r.clean, r.coercible, r.violations, r.missing) for r in report.field_stats.collect()}
    assert stats == {"a": (0, 1, 2, 1), "b": (3, 0, 2, 0)}
    assert tuple(report.totals.first()) == (5, 6)


SPEC = ShapeSpec(
    "UserRecord",
    (
        FieldSpec("id", "i64", coerce=True),
        FieldSpec("name", "string", rename="label", default=True),
        FieldSpec("score", "f64", optional=True, coerce=True),
        FieldSpec("tags", "i64", array=True, coerce=True, default=True),
        FieldSpec("where", ShapeSpec("Place", (FieldSpec("city", "string", optional=True),)), flatten=True),
        FieldSpec("extra", "raw", optional=True, parse_json_string=True),
        FieldSpec("secret", "i64", skip=True),
        FieldSpec("rest", overflow=True),
    ),
)


def test_shape(spark):
    doc = '{"id":"7","label":"x","score":"1,234.5","tags":["1",2],"city":"Ulm","extra":"{\\"k\\":1}","secret":9,"more":true}'
    r = SPEC.apply(rows(spark, [doc, '{"id":1,"tags":"3"}', '{"label":"x"}', '{"id":2,"label":5}', "7", '{"id":3,"tags":["x"]}']), "doc").orderBy("row_idx").collect()
    v = r[0].value
    assert (v.id, v.name, v.score, v.tags, v.where.city, v.secret, sorted(v.rest)) == (7, "x", 1234.5, [1, 2], "Ulm", 0, ["more", "secret"])
    assert sorted(d.kind for d in r[0]._diag) == ["coerced", "coerced", "coerced", "preserved", "preserved"]
    assert (r[1].value.tags, r[1].value.name, r[1].value.score) == ([3], "", None)
    assert r[2]._error == "id: missing" and r[3]._error == "label: not string" and r[4]._error.startswith("(root)")
    assert r[5].value.tags == []


def test_modes(spark):
    df = rows(spark, ['{"id":1,"label":"x"}', '{"id":"1","label":"x"}', '{"id":1,"label":"x","zz":1}'])
    good, bad = SPEC.split(df, "doc", STRICT)
    assert good.count() == 1
    assert sorted(r._error for r in bad.collect()) == ["coerced: id", "unknown fields: zz"]
    kept = SPEC.apply(df, "doc", ABSORBING).orderBy("row_idx").collect()
    assert [sorted(r._residual) for r in kept] == [[], [], ["zz"]]
    with pytest.raises(Exception, match="unknown fields"):
        SPEC.strictly(df.where("row_idx = 2"), "doc").collect()


def test_round_trip(spark):
    doc = '{"id":7,"label":"x","city":"Ulm","more":{"a":[1]}}'
    text = SPEC.apply(rows(spark, [doc]), "doc").select(to_json(SPEC, F.col("value"))).first()[0]
    back = json.loads(text)
    assert (back["id"], back["label"], back["city"], back["more"]) == (7, "x", "Ulm", {"a": [1]})


def test_specs():
    with pytest.raises(InvalidSpec):
        ShapeSpec("X", (FieldSpec("a"), FieldSpec("b", rename="a")))
    with pytest.raises(InvalidSpec):
        ShapeSpec("X", (FieldSpec("a", overflow=True), FieldSpec("b", overflow=True)))
    tool = SPEC.tool_definition()
    assert tool["name"] == "user_record"
    assert tool["input_schema"]["properties"]["tags"] == {"type": "array"} and "score" not in tool["input_schema"]["required"]
