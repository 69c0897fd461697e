"""Further queries over the shared tables: contracts, diagnostics, guesses, packs, sources, providers and handlers, with their SQL."""

from __future__ import annotations

import json
import sqlite3
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import cli
from quern.errors import QuernError
from quern.functions import coerce as C
from quern.functions import currency, dates, detect, diagnostics, geo, identifiers, medical, providers, units
from quern.functions import variants as V
from quern.operators import schema as S
from quern.operators import shape as H
from quern.operators.registry import HandlerRegistry
from quern.plans.config import ABSORBING, LENIENT, MODES, Level, Mode, ShapeConfig, SourceHint
from quern.plans.queries import as_value, bent, c, obj, query, table
from quern.sources.databases import SparkSource, SqliteSource
from quern.sources.files import read_json_rows, read_jsonl, write_json
from quern.sources.lookups import NoLookups, StaticLookups
from quern.streaming import operators as streams


def folder(spark) -> str:
    """A new folder for files that a query writes and reads back."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    own = tempfile.mkdtemp(prefix="quern-query-")
    return f"{shared.rstrip('/')}/{Path(own).name}" if shared else own


# Sources


@query("SELECT event_id, event_type, true AS numbered FROM events")
def read_json_lines(spark, sf):
    path = folder(spark) + "/lines"
    write_json(table(spark, sf, "events").select(F.to_json(F.struct("event_id", "event_type")).alias("doc")), "doc", path)
    rows = read_jsonl(spark, path)
    n = F.lit(table(spark, sf, "events").count())
    return rows.select(C.extract(c("doc"), "event_id", "i64")["value"].alias("event_id"), V.string(V.at(c("doc"), "event_type")).alias("event_type"), c("row_idx").between(0, n - 1).alias("numbered"))


@query("SELECT n_nationkey, n_name, (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS row_idx, 1::BIGINT AS objects FROM nation")
def read_json_array(spark, sf):
    """A file that holds one array, and one that holds an object."""
    root = folder(spark)
    whole = table(spark, sf, "nation").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("doc"))
    write_json(whole, "doc", f"{root}/array")
    write_json(spark.createDataFrame([('{"one":1}',)], "doc string"), "doc", f"{root}/object")
    rows = read_json_rows(spark, f"{root}/array")
    objects = read_json_rows(spark, f"{root}/object", single=True).agg(F.count("*").alias("objects"))
    return rows.select(C.extract(c("doc"), "n_nationkey", "i64")["value"].alias("n_nationkey"), V.string(V.at(c("doc"), "n_name")).alias("n_name"), "row_idx").crossJoin(objects)


@query("""
SELECT n_nationkey, n_name, 'array' AS kind, n_nationkey AS nested, (SELECT count(*) FROM nation WHERE n_regionkey = 2) AS counted, 'key,name,extra' AS columns FROM nation WHERE n_regionkey = 2""")
def read_sqlite(spark, sf):
    """A database file made of the nations: bound parameters, JSON in texts, columns and counts."""
    path = tempfile.mkdtemp(prefix="quern-query-") + "/nations.db"
    with sqlite3.connect(path) as connection:
        connection.execute("CREATE TABLE nations (key INTEGER, name TEXT, region INTEGER, extra TEXT)")
        rows = [(r["n_nationkey"], r["n_name"], r["n_regionkey"], json.dumps([r["n_nationkey"]])) for r in table(spark, sf, "nation").collect()]
        connection.executemany("INSERT INTO nations VALUES (?, ?, ?, ?)", rows)
    source, sql = SqliteSource(spark, path), "SELECT key, name, extra FROM nations"
    doc = c("doc")
    return source.query_with(sql + " WHERE region = ?", [2]).select(
        C.extract(doc, "key", "i64")["value"].alias("n_nationkey"),
        V.string(V.at(doc, "name")).alias("n_name"),
        V.kind(V.at(doc, "extra")).alias("kind"),
        C.extract(doc, "extra[0]", "i64")["value"].alias("nested"),
        F.lit(source.count(sql + " WHERE region = 2")).alias("counted"),
        F.lit(",".join(source.columns(sql))).alias("columns"),
    )


@query("SELECT s_suppkey, s_name, 2::BIGINT AS counted FROM supplier WHERE s_suppkey <= 3 AND s_suppkey > 1")
def read_table(spark, sf):
    """The protocol of sources over a table of the session, parameters bound."""
    table(spark, sf, "supplier").createOrReplaceTempView("quern_suppliers")
    source = SparkSource(spark)
    found = source.query_with("SELECT s_suppkey, s_name FROM quern_suppliers WHERE s_suppkey <= ? AND s_suppkey > ?", [3, 1])
    n = source.count("SELECT s_suppkey FROM quern_suppliers WHERE s_suppkey IN (2, 3)")
    return found.select(C.extract(c("doc"), "s_suppkey", "i64")["value"].alias("s_suppkey"), V.string(V.at(c("doc"), "s_name")).alias("s_name"), F.lit(n).alias("counted"))


@query("""
SELECT p_partkey, '{"key":' || p_partkey || ',"size":' || p_size || '}' AS plain, '{' || chr(10) || '  "key": ' || p_partkey || ',' || chr(10) || '  "size": ' || p_size || chr(10) || '}' AS pretty,
  '{"more":true,"p_partkey":' || p_partkey || '}' AS shaped, p_size AS raw FROM part""")
def values_out(spark, sf):
    spec = H.ShapeSpec("Out", (H.FieldSpec("key", "i64", rename="p_partkey"), H.FieldSpec("rest", overflow=True)))
    value = obj(c("p_partkey").alias("key"), c("p_size").alias("size"))
    df = spec.apply(table(spark, sf, "part").select("p_partkey", value.alias("v"), obj(c("p_partkey"), F.lit(True).alias("more")).alias("doc")), "doc")
    return df.select("p_partkey", V.to_json(c("v")).alias("plain"), V.pretty(c("v")).alias("pretty"), H.to_json(spec, c("value")).alias("shaped"), C.coerce(V.at(c("v"), "size"), "raw")["value"].cast("int").alias("raw"))


@query("""
SELECT * FROM (VALUES ('string', 'string'), ('text', 'string'), ('VARCHAR', 'string'), ('bigint', 'integer'), ('int', 'integer'), ('real', 'float'), ('Decimal', 'float'), ('boolean', 'bool'),
  ('jsonb', 'object'), ('array', 'array'), ('null', 'null'), ('circle', NULL)) AS t(name, kind)""")
def type_names(spark, sf):
    names = ("string", "text", "VARCHAR", "bigint", "int", "real", "Decimal", "boolean", "jsonb", "array", "null", "circle")
    return spark.createDataFrame([(n, S.parse_type(n)) for n in names], "name string, kind string")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'even' END AS parity, 1.25::DOUBLE * p_size AS price, NULL::VARCHAR AS nothing FROM part")
def lookups(spark, sf):
    known = StaticLookups(rates={("EUR", "USD"): 1.25}, tables={"parity": {"0": "even"}})
    df = table(spark, sf, "part").select("p_partkey", (c("p_size") % 2).cast("string").alias("odd"), c("p_size").cast("double").alias("size"), F.lit("EUR").alias("f"), F.lit("USD").alias("t"))
    out = currency.convert_with(df, known.rates_frame(spark), "size", "f", "t", "price")
    return out.select("p_partkey", known.column("parity", c("odd")).alias("parity"), "price", F.lit(NoLookups().lookup("parity", "0")).cast("string").alias("nothing"))


@query("""
SELECT (SELECT 'Schema inferred from ' || count(*) || ' records:' FROM nation) AS inferred, (SELECT count(*) FROM nation) AS total, (SELECT count(*) FILTER (length(n_name) > 6) FROM nation) AS violations,
  (SELECT n_nationkey::VARCHAR FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 3) AS inspected, 'Path error: index_out_of_bounds' AS past_end""")
def command_line(spark, sf):
    """What the three commands print of a file that holds the nations in one array."""
    path = folder(spark) + "/nations"
    write_json(table(spark, sf, "nation").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("doc")), "doc", path)
    limits = Path(tempfile.mkdtemp(prefix="quern-query-")) / "limits.json"
    limits.write_text(json.dumps({"fields": {"n_name": {"type": "string", "max_length": 6}}}))
    told = cli.audit(spark, path, str(limits), 1.0, True).splitlines()
    try:
        past_end = cli.inspect(spark, path, "[1000]", None)
    except QuernError as e:
        past_end = str(e)
    row = (
        cli.infer(spark, path, 1.0, "table").splitlines()[0],
        S.infer(cli.read_source(spark, path), samples=False).total,
        sum("ConstraintViolation" in x and x.startswith("  Row") for x in told),
        cli.inspect(spark, path, "[3].n_nationkey", "int"),
        past_end,
    )
    return spark.createDataFrame([row], "inferred string, total long, violations long, inspected string, past_end string")


# Coercion


@query("""
SELECT p_partkey, p_size::VARCHAR AS number_text, 'true' AS bool_text, 1 AS bool_int, 0.0::DOUBLE AS bool_float, CASE WHEN p_size * 5 <= 127 THEN p_size * 5 END AS narrow, p_size::DOUBLE AS widened,
  NULL::FLOAT AS over, '[' || p_size || ']' AS array_text, '{"a":' || p_size || '}' AS object_text, p_size AS single, 'coercion_failed' AS several, '18446744073709551615' AS wide FROM part""")
def coerce_kinds(spark, sf):
    n = c("p_size")
    doc = V.from_row(F.struct(
        n.alias("n"), F.lit(True).alias("yes"), F.lit(False).alias("no"), (n * 5).alias("five"), F.array(n).alias("one"), F.array(n, n).alias("two"), F.struct(n.alias("a")).alias("o"), F.lit(1e300).alias("huge")
    ))
    df = table(spark, sf, "part").select("p_partkey", doc.alias("d"), V.from_json(F.lit("18446744073709551615")).alias("w"))
    value = lambda path, target: C.extract(c("d"), path, target)["value"]
    return df.select(
        "p_partkey", value("n", "string").alias("number_text"), value("yes", "string").alias("bool_text"), value("yes", "i32").alias("bool_int"), value("no", "f64").alias("bool_float"),
        value("five", "i8").cast("int").alias("narrow"), value("n", "f64").alias("widened"), value("huge", "f32").alias("over"), value("one", "string").alias("array_text"), value("o", "string").alias("object_text"),
        value("one", "i32").alias("single"), C.extract(c("d"), "two", "i32")["status"].alias("several"), C.coerce(c("w"), "u64")["value"].cast("string").alias("wide"),
    )


@query("""
SELECT p_partkey, false AS exact_float, NULL::DOUBLE AS exact_text, p_size::DOUBLE AS safe, p_size AS text, p_size::DOUBLE AS csv, NULL::DOUBLE AS json_source, false AS strict_ok, true AS lenient_ok FROM part""")
def coerce_settings(spark, sf):
    n = c("p_size")
    text = n.cast("string")
    base = ShapeConfig()
    got = lambda v, target, config: C.coerce(v, target, config)
    money = as_value(F.concat(F.lit("$"), text, F.lit(".00")))
    exact = base.with_coercion(Level.EXACT)
    number = V.at(obj(n.alias("n")), "n")
    return table(spark, sf, "part").select(
        "p_partkey",
        got(number, "f64", exact)["ok"].alias("exact_float"),
        got(as_value(text), "f64", exact)["value"].alias("exact_text"),
        got(number, "f64", base.with_coercion(Level.SAFE_WIDENING))["value"].alias("safe"),
        got(as_value(text), "i32", base.with_coercion(Level.STRING_COERCION))["value"].alias("text"),
        got(money, "f64", base.with_source_hint(SourceHint.CSV))["value"].alias("csv"),
        got(money, "f64", base.with_source_hint(SourceHint.JSON))["value"].alias("json_source"),
        got(as_value(text), "i32", base.with_mode("strict"))["ok"].alias("strict_ok"),
        C.shape(obj(text.alias("t")), "t", "i32", LENIENT)["ok"].alias("lenient_ok"),
    )


@query("""
SELECT o_orderkey, false AS ok, true AS coerced, 'stringified JSON>parsed value' AS told, o_orderkey * 2 AS total, '[' || o_orderkey || ',"' || o_orderkey || '"]' AS as_text, 'path_not_found' AS plain FROM orders""")
def coerce_stringified_json(spark, sf):
    k = c("o_orderkey").cast("string")
    text = F.concat(F.lit("["), k, F.lit(',"'), k, F.lit('"]'))
    df = table(spark, sf, "orders").select("o_orderkey", bent(text, "i64").alias("x"), C.coerce_array(as_value(text), "i64").alias("a"), bent(text, "string").alias("s"), V.status(V.from_json(F.lit("{}")), "x").alias("plain"))
    return df.select(
        "o_orderkey", "x.ok", "x.coerced", F.concat_ws(">", "x.diag.a", "x.diag.b").alias("told"), F.aggregate("a.value", F.lit(0).cast("long"), lambda z, v: z + v).alias("total"), c("s.value").alias("as_text"), "plain"
    )


@query("""
SELECT p_partkey, p_size AS there, 'none' AS missing, 'none' AS null_value, 'none' AS past_end, 'none' AS below_null, 'coercion_failed' AS failed, 'type_mismatch' AS through_number, NULL::INT AS nothing FROM part""")
def maybe_statuses(spark, sf):
    doc = F.concat(F.lit('{"n":'), c("p_size").cast("string"), F.lit(',"z":null,"a":[1],"w":"words"}'))
    d = c("d")
    status = lambda path: C.try_maybe(d, path, "i32")["status"]
    return table(spark, sf, "part").select("p_partkey", V.from_json(doc).alias("d")).select(
        "p_partkey", C.maybe(d, "n", "i32").alias("there"), status("q").alias("missing"), status("z").alias("null_value"), status("a[5]").alias("past_end"), status("z.deeper").alias("below_null"),
        status("w").alias("failed"), status("n.deeper").alias("through_number"), C.maybe(d, "z.deeper", "i32").alias("nothing"),
    )


@query("SELECT p_partkey, 'object,array,string,integer,bool,null' AS kinds, true AS is_null, true AS is_string, false AS not_string, true AS no_elements, false AS elements, p_size AS shaped FROM part")
def value_predicates(spark, sf):
    doc = F.concat(F.lit('{"o":{},"a":['), c("p_size").cast("string"), F.lit('],"s":"x","i":1,"b":true,"n":null}'))
    d = c("d")
    at = lambda path: V.at(d, path)
    return table(spark, sf, "part").select("p_partkey", V.from_json(doc).alias("d")).select(
        "p_partkey",
        F.concat_ws(",", *(V.kind(at(x)) for x in "oasibn")).alias("kinds"),
        V.is_null(at("n")).alias("is_null"), V.is_string(at("s")).alias("is_string"), V.is_string(at("i")).alias("not_string"),
        V.is_empty(at("o")).alias("no_elements"), V.is_empty(at("a")).alias("elements"),
        C.shape(d, "a[0]", "i32", ABSORBING)["value"].alias("shaped"),
    )


# Contracts and diagnostics


PERSON = H.ShapeSpec("Address", (H.FieldSpec("city", "string"), H.FieldSpec("zip", "i64", coerce=True)))
VISIT = H.ShapeSpec(
    "PatientVisit",
    (
        H.FieldSpec("age", "i64", coerce=True, description="in years"),
        H.FieldSpec("weight", "f64", optional=True, coerce=True),
        H.FieldSpec("scores", "i64", array=True, coerce=True),
        H.FieldSpec("tags", "string", array=True, optional=True),
        H.FieldSpec("secret", "string", skip=True),
        H.FieldSpec("address", PERSON, flatten=True),
        H.FieldSpec("extra", "raw", parse_json_string=True),
    ),
    "One visit.",
)


def visits(spark, sf) -> DataFrame:
    k = c("c_custkey")
    n = k.cast("string")
    doc = F.concat(
        F.lit('{"age":"'), n, F.lit('","weight":'), F.when(k % 2 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), n, F.lit('.5"'))), F.lit(',"scores":["1",2,"'), n, F.lit('"],"secret":"s","city":"c'), n,
        F.lit('","zip":"'), n, F.lit('","extra":"{\\"deep\\":'), n, F.lit('}","unknown":1}'),
    )
    return table(spark, sf, "customer").select("c_custkey", V.from_json(doc).alias("doc"))


@query("""
SELECT c_custkey, c_custkey AS age, CASE WHEN c_custkey % 2 = 1 THEN c_custkey + 0.5::DOUBLE END AS weight, c_custkey + 3 AS scores, true AS no_tags, '' AS secret, 'c' || c_custkey AS city, c_custkey AS zip,
  c_custkey AS deep, 'secret,unknown' AS dropped, true AS fits FROM customer""")
def shape_fields(spark, sf):
    out = VISIT.apply(visits(spark, sf), "doc", LENIENT)
    dropped = F.filter("_diag", lambda d: d["kind"] == "dropped")
    v = "value."
    return out.select(
        "c_custkey", v + "age", v + "weight", F.aggregate(v + "scores", F.lit(0).cast("long"), lambda a, x: a + x).alias("scores"), c(v + "tags").isNull().alias("no_tags"), v + "secret", v + "address.city", v + "address.zip",
        C.extract(c(v + "extra"), "deep", "i64")["value"].alias("deep"), F.array_join(F.transform(dropped, lambda d: d["path"]), ",").alias("dropped"), c("_error").isNull().alias("fits"),
    )


@query("""
SELECT 'patient_visit' AS name, 'One visit.' AS description, 'in years' AS told, 'integer' AS age, 'array' AS scores, 'age,scores,secret,address,extra' AS required, 'lenient,absorbing,strict' AS modes, 'strict' AS parsed""")
def shape_tool_definition(spark, sf):
    d = VISIT.tool_definition()
    schema = d["input_schema"]
    row = (d["name"], d["description"], schema["properties"]["age"]["description"], schema["properties"]["age"]["type"], schema["properties"]["scores"]["type"], ",".join(schema["required"]), ",".join(map(str, MODES.values())), str(Mode.parse(" Strict ")))
    return spark.createDataFrame([row], "name string, description string, told string, age string, scores string, required string, modes string, parsed string")


@query("""
SELECT text, count(*) AS n FROM (
  SELECT unnest(['[info] at ''age'': coerced string → i64 — use an integer type in the source data', '[info] at ''unknown'': dropped unknown field ''unknown''']) AS text FROM customer
  UNION ALL SELECT '[warning] at ''weight'': coerced string → f64 — string-to-float coercion may lose decimal precision' FROM customer WHERE c_custkey % 2 = 1) GROUP BY 1""")
def diagnostic_rows(spark, sf):
    """Diagnostics one a row, as sinks get them, with their text."""
    out = VISIT.apply(visits(spark, sf), "doc", LENIENT).select("c_custkey", "_diag")
    d = c("diag")
    found = diagnostics.rows(out).select(diagnostics.display(d, d["path"]).alias("text"), d["path"].alias("path")).where(c("path").isin("age", "weight", "unknown"))
    return found.groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (c_custkey % 2 = 1) AS warnings, count(*) AS rows FROM customer")
def diagnostic_filter(spark, sf):
    """Diagnostics from a warning on; rows whose diagnostics nobody reads cost nothing, as the column is pruned."""
    out = VISIT.apply(visits(spark, sf), "doc", LENIENT).select("c_custkey", "_diag")
    return diagnostics.rows(out, at_least=diagnostics.WARNING).agg(F.count("*").alias("warnings")).crossJoin(out.agg(F.count("*").alias("rows")))


# Schemas


def region_docs(spark, sf) -> DataFrame:
    k = c("n_nationkey")
    doc = F.concat(F.lit('{"name":"'), c("n_name"), F.lit('","mixed":'), F.when(k % 5 == 0, F.lit('"a"')).otherwise(k.cast("string")), F.when(k >= 5, F.lit(',"late":true')).otherwise(""), F.lit("}"))
    return table(spark, sf, "nation").select(k.cast("long").alias("row_idx"), V.from_json(doc).alias("doc"))


@query("""
SELECT 'name' AS field, 1.0::DOUBLE AS fill_rate, true AS appears_required, 1.0::DOUBLE AS consistency, (SELECT string_agg(n_name, ',' ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 20) AS samples, true AS required, true AS in_summary
UNION ALL SELECT 'mixed', 1.0, true, 0.8, 'a', true, true UNION ALL SELECT 'late', 0.8, false, 1.0, '', true, true""")
def schema_samples(spark, sf):
    found = S.infer(region_docs(spark, sf), S.InferenceConfig(required_threshold=0.8))
    lines = found.summary().splitlines()
    rows = [(f.name, f.fill_rate, f.appears_required, f.consistency, ",".join(f.samples), found.required(f), any(x.startswith(f.name) for x in lines)) for f in found.fields.values()]
    return spark.createDataFrame(rows, "field string, fill_rate double, appears_required boolean, consistency double, samples string, required boolean, in_summary boolean")


@query("""
SELECT told, count(*) AS n FROM (
  SELECT unnest(list_filter([
    CASE WHEN length(n_name) > 6 THEN 'Row ' || n_nationkey || ': field ''name'' — ConstraintViolation: expected max_length 6, got length ' || length(n_name) END,
    CASE WHEN n_nationkey % 5 = 0 THEN 'Row ' || n_nationkey || ': field ''mixed'' — ConstraintViolation: expected one of ["1", "2", "3", "4"], got a' END,
    CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey > 4 THEN 'Row ' || n_nationkey || ': field ''mixed'' — ConstraintViolation: expected one of ["1", "2", "3", "4"], got ' || n_nationkey END,
    CASE WHEN n_nationkey >= 5 THEN 'Row ' || n_nationkey || ': field ''late'' — UnknownField: expected not present, got present' END], lambda x: x IS NOT NULL)) AS told FROM nation) GROUP BY 1""")
def audit_constraints(spark, sf):
    rows = region_docs(spark, sf)
    seen = S.infer(rows.where("row_idx < 5"), samples=False)
    limits = {"name": S.Constraint("string", max_length=6), "mixed": S.Constraint(allowed=("1", "2", "3", "4"))}
    found = S.audit(rows, seen.with_constraints(limits)).violations.where(~((c("field") == "mixed") & (c("kind") == "TypeMismatch")))
    told = S.display(c("row_idx"), c("field"), c("kind"), c("expected"), c("actual"))
    return found.groupBy(told.alias("told")).agg(F.count("*").alias("n"))


# Guesses


_SAMPLES = (
    ("N/A", "NullSentinel"), ("0", "Boolean"), ("(1,234.50)", "Currency"), ("123e4567-e89b-12d3-a456-426614174000", "Uuid"), ("https://example.com/a", "Url"), ("192.168.0.1", "IpAddress"),
    ("999.168.0.1", "PlainString"), ("fe80::1ff:fe23:4567:890a", "IpAddress"), ('{"a":1}', "Json"), ("GB82WEST12345698765432", "Iban"), ("123-45-6789", "Ssn"), ("12-3456789", "Ein"),
    ("4111111111111111", "CreditCard"), ("9780306406157", "Isbn"), ("20240115", "Date"), ("1700000000", "Date"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{k}')" for t, k in _SAMPLES) + ") AS t(text, kind)")
def guess_kinds(spark, sf):
    """The surest guess of texts of every kind; digits that are a card, a book or a date are no plain numbers."""
    df = spark.createDataFrame([(t,) for t, _ in _SAMPLES], "text string")
    return df.select("text", detect.guesses(c("text"))[0]["kind"].alias("kind"))


# Packs


@query("""
SELECT o_orderkey, CASE WHEN day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day_first, CASE WHEN day(o_orderdate) <= 12 THEN 'Ambiguous' ELSE 'EuDate' END AS told,
  strftime(o_orderdate, '%Y-%m-%d') || 'T10:20:30+05:30' AS zoned, CAST(o_orderdate AS DATE) AS as_date, epoch(o_orderdate::DATE) + 37230 AS seconds FROM orders""")
def date_day_first(spark, sf):
    d = c("o_orderdate")
    text = F.date_format(d, "dd/MM/yyyy")
    told = F.regexp_replace(dates.note(text)["a"], "^date:", "")
    stamp = F.concat(F.date_format(d, "yyyyMMdd"), F.lit("102030+0530"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.dayofmonth(d) <= 12, dates.to_iso(text, day_first=True)).alias("day_first"),
        told.alias("told"),
        dates.to_iso(stamp).alias("zoned"),
        dates.to_date(F.date_format(d, "yyyy-MM-dd")).alias("as_date"),
        F.unix_timestamp(dates.to_datetime(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 10:20:30"))).cast("timestamp")).cast("double").alias("seconds"),
    )


@query("""
SELECT p_partkey, p_size + 0.5::DOUBLE AS money, 'currency USD' AS money_told, p_size::DOUBLE AS quantity, 'unit kg' AS quantity_told, true AS not_money, p_size * 0.453592::DOUBLE AS mass, p_size * 0.3048::DOUBLE AS length FROM part""")
def pack_coercions(spark, sf):
    n = c("p_size").cast("string")
    df = table(spark, sf, "part").select(
        "p_partkey", currency.coerce_currency(as_value(F.concat(F.lit("$"), n, F.lit(".50")))).alias("m"), units.coerce_unit(as_value(F.concat(n, F.lit(" kg")))).alias("q"),
        currency.coerce_currency(as_value(n)).isNull().alias("not_money"), units.to_mass(F.concat(n, F.lit(" lb"))).alias("mass"), units.to_length(F.concat(n, F.lit(" ft"))).alias("length"),
    )
    return df.select("p_partkey", c("m.value").alias("money"), c("m.diag.a").alias("money_told"), c("q.value").alias("quantity"), c("q.diag.a").alias("quantity_told"), "not_money", "mass", "length")


@query("""
SELECT c_custkey, list_sum([CASE WHEN i % 2 = 0 THEN (CASE WHEN substr(t, i, 1)::INT * 2 > 9 THEN substr(t, i, 1)::INT * 2 - 9 ELSE substr(t, i, 1)::INT * 2 END) ELSE substr(t, i, 1)::INT END FOR i IN range(1, 16)]) % 10 = 0 AS npi,
  'Email' AS first FROM (SELECT c_custkey, '80840' || lpad(c_custkey::VARCHAR, 10, '0') AS t FROM customer)""")
def identifier_detection(spark, sf):
    n = F.lpad(c("c_custkey").cast("string"), 10, "0")
    email = F.concat(F.lit("c"), n, F.lit("@mail.example.org"))
    return table(spark, sf, "customer").select("c_custkey", identifiers.validate(n, "UsNpi")["is_valid"].alias("npi"), identifiers.detect(email)[0]["kind"].alias("first"))


@query("SELECT c_custkey, 'Unknown' AS datum, 'Iso6709' AS format FROM customer")
def geo_datum(spark, sf):
    text = F.concat(F.lit("+"), (c("c_custkey") % 80).cast("string"), F.lit(".5-012.25/"))
    return table(spark, sf, "customer").select("c_custkey", geo.parse(text).alias("g")).select("c_custkey", "g.datum", "g.format")


@query("""
SELECT * FROM (VALUES ('glucose', 'mg/dL', true, 70.0::DOUBLE, 100.0::DOUBLE, 'Low'), ('Glu', 'mg/dL', true, 70.0, 100.0, 'Low'), ('stardust', 'mg/dL', false, NULL, NULL, NULL)) AS t(analyte, unit, known, low, high, class)""")
def lab_ranges(spark, sf):
    df = spark.createDataFrame([("glucose", "mg/dL"), ("Glu", "mg/dL"), ("stardust", "mg/dL")], "analyte string, unit string")
    known = F.lower("analyte").isin(*medical.known_analytes())
    range_ = medical.reference_range(c("analyte"), c("unit"))
    return df.select("analyte", "unit", known.alias("known"), range_["low"].alias("low"), range_["high"].alias("high"), medical.classify_lab(F.lit(60.0), c("analyte"), c("unit")).alias("class"))


# Providers, streams and handlers


@query("""
SELECT o_orderkey, 'm' || o_orderkey AS id, o_orderpriority AS text, 'look' AS tool, '{"key":' || o_orderkey || '}' AS input, 'thinking' AS other, 'end_turn' AS stop_reason, o_custkey AS input_tokens, 3::BIGINT AS cache_read, true AS asks,
  'm' || o_orderkey || '|stop|look|' || (o_custkey + 7) AS as_openai, o_orderpriority || '|stop|look|' || o_custkey AS as_ollama, o_orderpriority || '|end_turn|ollama_look|' || o_custkey AS from_ollama FROM orders""")
def provider_formats(spark, sf):
    """One provider's responses in the common shape, in two others' formats, and one of these read back."""
    k = c("o_orderkey").cast("string")
    blocks = F.concat(
        F.lit('[{"type":"text","text":"'), c("o_orderpriority"), F.lit('"},{"type":"tool_use","id":"t'), k, F.lit('","name":"look","input":{"key":'), k, F.lit('}},{"type":"thinking","thinking":"..."}]'),
    )
    body = F.concat(
        F.lit('{"id":"m'), k, F.lit('","model":"x","content":'), blocks, F.lit(',"stop_reason":"end_turn","usage":{"input_tokens":'), c("o_custkey").cast("string"),
        F.lit(',"output_tokens":"7","cache_read_input_tokens":3}}'),
    )
    provider = providers.PROVIDERS
    r = c("r")
    df = table(spark, sf, "orders").select("o_orderkey", provider["anthropic"].parse(V.from_json(body)).alias("r"))
    df = df.select("*", V.from_json(provider["openai"].emit(r)).alias("a"), V.from_json(provider["ollama"].emit(r)).alias("b"))
    df = df.select("*", provider["ollama"].parse(c("b")).alias("back"))
    text = lambda v, path: V.string(V.at(c(v), path))
    count = lambda v, path: C.extract(c(v), path, "i64")["value"].cast("string")
    return df.select(
        "o_orderkey", "r.id", providers.text(r).alias("text"), providers.tool_uses(r)[0]["name"].alias("tool"), providers.tool_uses(r)[0]["input"].alias("input"),
        F.filter("r.content", lambda x: x["kind"] == "unknown")[0]["block_type"].alias("other"), "r.stop_reason", "r.usage.input_tokens", "r.usage.cache_read", providers.has_tool_use(r).alias("asks"),
        F.concat_ws("|", text("a", "id"), text("a", "choices[0].finish_reason"), text("a", "choices[0].message.tool_calls[0].function.name"), count("a", "usage.total_tokens")).alias("as_openai"),
        F.concat_ws("|", text("b", "message.content"), text("b", "done_reason"), text("b", "message.tool_calls[0].function.name"), count("b", "prompt_eval_count")).alias("as_ollama"),
        F.concat_ws("|", providers.text(c("back")), "back.stop_reason", providers.tool_uses(c("back"))[0]["id"], c("back.usage.input_tokens").cast("string")).alias("from_ollama"),
    )


@query("""
SELECT c_custkey::VARCHAR AS stream_id, 'n' || c_custkey AS text, 'look' AS tool, '{"key":' || c_custkey || '}' AS input, 'tool_use' AS stop_reason, true AS done FROM customer""")
def stream_tool_calls(spark, sf):
    """Streams in three chunks that cut a tool call's arguments, assembled into messages."""
    n = c("c_custkey").cast("string")
    line = lambda delta, more="": F.concat(F.lit('data: {"choices":[{"delta":'), delta, F.lit(f"{more}}}]}}\n\n"))
    first = line(F.concat(F.lit('{"content":"n'), n, F.lit('"}')))
    call = line(F.concat(F.lit('{"tool_calls":[{"index":0,"id":"c'), n, F.lit('","function":{"name":"look","arguments":"{\\"key\\":"}}]}')))
    rest = line(F.concat(F.lit('{"tool_calls":[{"index":0,"function":{"arguments":"'), n, F.lit('}"}}]}')))
    last = line(F.lit("{}"), ',"finish_reason":"tool_calls"')
    whole = F.concat(first, call, rest, last, F.lit("data: [DONE]\n\n"))
    third = F.ceil(F.length(whole) / 3).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(i.cast("long").alias("seq"), F.substring(whole, i * third + 1, third).alias("chunk")))
    df = table(spark, sf, "customer").select(n.alias("stream_id"), F.lit("openai").alias("provider"), F.explode(chunks).alias("x")).select("stream_id", "x.seq", "provider", "x.chunk")
    out = streams.messages(df)
    calls = c("tool_calls")[0]
    return out.select("stream_id", "text", calls["name"].alias("tool"), calls["input"].alias("input"), "stop_reason", "done")


@query("SELECT c_custkey, 0 AS pos, '\"' || c_custkey || ' in 2,look\"' AS result, NULL::VARCHAR AS error FROM customer UNION ALL SELECT c_custkey, 1, NULL, 'ValueError: no' FROM customer UNION ALL SELECT c_custkey, 2, NULL, NULL FROM customer")
def handlers_awaited(spark, sf):
    """An async handler, one that fails, and a name that nobody handles."""
    registry = HandlerRegistry()

    async def look(value):
        return f"{value['key']} in {len(registry)},{registry.names()[1]}"

    async def fail(value):
        raise ValueError("no")

    registry.register("look", look)
    registry.register_raw("fail", fail)
    key = F.concat(F.lit('{"key":'), c("c_custkey").cast("string"), F.lit("}"))
    use = lambda name: F.struct(F.lit("tool_use").alias("kind"), F.lit(name).alias("id"), F.lit(name).alias("name"), key.alias("input"))
    df = table(spark, sf, "customer").select("c_custkey", F.struct(F.array(use("look"), use("fail"), use("nobody")).alias("content")).alias("r"))
    return registry.apply(df, "r", "c_custkey", wait=True).select("c_custkey", "pos", "result", "error")


@query("SELECT p_partkey, p_size * 100 AS cents, CASE WHEN p_size % 2 = 0 THEN p_size END AS even FROM part")
def user_types(spark, sf):
    C.register_type("cents", "f64", lambda v: (v * 100).cast("int"))
    C.register_type("even", "i32", lambda v: F.when(v % 2 == 0, v))
    text = as_value(c("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", C.coerce_user(text, "cents")["value"].alias("cents"), C.coerce_user(text, "even")["value"].alias("even"))
