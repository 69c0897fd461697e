"""Queries over the shared tables, one or more for each family of operators, with the SQL that says what they must give.

Messy inputs are made inside a query from clean columns, so that SQL can start from the clean side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import coerce as C
from quern.functions import currency, dates, detect, geo, identifiers, medical, merge, providers, units
from quern.functions import variants as V
from quern.functions.diagnostics import risk_text
from quern.operators import schema as S
from quern.operators.registry import HandlerRegistry
from quern.operators.shape import FieldSpec, ShapeSpec
from quern.plans.config import ABSORBING, STRICT, Level, Packs, ShapeConfig
from quern.session import ship, spread
from quern.streaming import operators as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

c = F.col


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def as_value(text: Column) -> Column:
    """A text as a JSON string value."""
    return F.try_variant_get(F.to_variant_object(F.array(text)), "$[0]", "variant")


def bent(text: Column, target: str, config: ShapeConfig | None = None) -> Column:
    return C.coerce_text(text, target, config)


def obj(*columns: Column) -> Column:
    return V.from_row(F.struct(*columns))


LINE = ("l_orderkey", "l_linenumber")


# Navigation and coercion


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS sum_k FROM events GROUP BY 1")
def extract_props_k(spark, sf):
    found = C.extract(V.from_json(c("props")), "k", "i64")["value"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(found).alias("sum_k"))


@query("""
SELECT event_id, 'ok' AS there, 'path_not_found' AS missing, 'type_mismatch' AS through_number, 'index_out_of_bounds' AS past_end, 'path_not_found' AS name_of_array,
  (CAST(json_extract_string(props, '$.k') AS BIGINT) + 1) AS in_text, 3 AS fields, 'a,b,s' AS names, true AS has_null
FROM events""")
def navigate_statuses(spark, sf):
    k = V.at(V.from_json(c("props")), "k")
    inner = F.concat(F.lit('{"n":'), (k.cast("bigint") + 1).cast("string"), F.lit("}"))
    doc = V.from_json(F.concat(F.lit('{"a":['), F.to_json(k), F.lit('],"b":{"x":null,"y":'), F.to_json(k), F.lit('},"s":'), F.to_json(as_value(inner)), F.lit("}")))
    df = table(spark, sf, "events").select("event_id", doc.alias("d"))
    d = c("d")
    return df.select(
        "event_id",
        V.status(d, "a[0]").alias("there"),
        V.status(d, "b.zz").alias("missing"),
        V.status(d, "b.y.z").alias("through_number"),
        V.status(d, "a[7]").alias("past_end"),
        V.status(d, "a.k").alias("name_of_array"),
        C.extract(d, 's["n"]', "i64")["value"].alias("in_text"),
        V.size(d).alias("fields"),
        F.array_join(V.keys(d), ",").alias("names"),
        V.has(d, "b.x").alias("has_null"),
    )


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM lineitem")
def coerce_us_thousands(spark, sf):
    text = F.format_number("l_extendedprice", 2)
    return table(spark, sf, "lineitem").select(*LINE, bent(text, "f64")["value"].alias("price"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM lineitem")
def coerce_european(spark, sf):
    text = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    # Below a thousand there is no point, and a lone comma isn't a European number.
    text = F.when(c("l_extendedprice") < 1000, F.translate(text, ",", ".")).otherwise(text)
    return table(spark, sf, "lineitem").select(*LINE, bent(text, "f64")["value"].alias("price"))


@query("SELECT l_orderkey, l_linenumber, l_orderkey * 1000 AS swiss, l_orderkey * 1000 AS spaced, l_orderkey * 1000 AS scored FROM lineitem")
def coerce_separators(spark, sf):
    df = table(spark, sf, "lineitem").select(*LINE, F.format_number(c("l_orderkey") * 1000, 0).alias("text"))
    return df.select(
        *LINE, *(bent(F.translate("text", ",", sep), "i64")["value"].alias(name) for name, sep in (("swiss", "'"), ("spaced", " "), ("scored", "_")))
    )


@query("SELECT l_orderkey, l_linenumber, l_orderkey AS hexadecimal, l_partkey AS octal, l_suppkey AS binary_ FROM lineitem")
def coerce_radix(spark, sf):
    text = lambda p, n, base: F.concat(F.lit(p), F.conv(n.cast("string"), 10, base))
    return table(spark, sf, "lineitem").select(
        *LINE,
        bent(text("0x", c("l_orderkey"), 16), "i64")["value"].alias("hexadecimal"),
        bent(text("0o", c("l_partkey"), 8), "i32")["value"].cast("long").alias("octal"),
        bent(text("0b", c("l_suppkey"), 2), "u32")["value"].alias("binary_"),
    )


@query("SELECT l_orderkey, l_linenumber, l_linestatus = 'O' AS open, l_returnflag = 'R' AS returned FROM lineitem")
def coerce_bool_words(spark, sf):
    words = F.when(c("l_linestatus") == "O", " Yes ").otherwise("off")
    flag = V.from_row(F.struct(F.when(c("l_returnflag") == "R", 1).otherwise(0).alias("f")))
    return table(spark, sf, "lineitem").select(*LINE, bent(words, "bool")["value"].alias("open"), C.extract(flag, "f", "bool")["value"].alias("returned"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey BETWEEN 0 AND 255 AS fits, CASE WHEN l_partkey <= 255 THEN l_partkey END AS value,
  CASE WHEN l_partkey <= 255 THEN 'info' ELSE 'risky' END AS risk FROM lineitem""")
def coerce_range_u8(spark, sf):
    df = table(spark, sf, "lineitem").select(*LINE, bent(c("l_partkey").cast("string"), "u8").alias("x"))
    return df.select(*LINE, c("x.ok").alias("fits"), c("x.value").cast("long").alias("value"), risk_text(c("x.diag.risk")).alias("risk"))


@query("SELECT l_orderkey, l_linenumber, l_quantity = floor(l_quantity) AS whole, CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity::BIGINT END AS quantity, false AS priced FROM lineitem")
def coerce_float_to_int(spark, sf):
    df = table(spark, sf, "lineitem").select(*LINE, C.coerce(as_number(c("l_quantity")), "i64").alias("q"), C.coerce(as_number(c("l_extendedprice").cast("long") + F.lit(0.5)), "i64").alias("p"))
    return df.select(*LINE, c("q.ok").alias("whole"), c("q.value").alias("quantity"), c("p.ok").alias("priced"))


def as_number(value: Column) -> Column:
    return F.try_variant_get(F.to_variant_object(F.array(value)), "$[0]", "variant")


@query("""
SELECT level, target, ok, count(*) AS n FROM (
  SELECT unnest(['exact', 'safe', 'string', 'best']) AS level, unnest([0, 1, 2, 3]) AS rank, o_orderkey FROM orders) o,
  (VALUES ('i64'), ('f64'), ('bool'), ('string')) t(target),
  LATERAL (SELECT CASE target WHEN 'string' THEN true WHEN 'bool' THEN rank = 3 AND o_orderkey % 4 = 0 ELSE (rank >= 2 AND o_orderkey % 4 <> 0) OR (rank = 3) END AS ok)
GROUP BY ALL""")
def coerce_levels(spark, sf):
    text = F.when(c("o_orderkey") % 4 == 0, "N/A").otherwise(F.concat(F.lit("7"), c("o_orderkey").cast("string")))
    df = table(spark, sf, "orders").select(as_value(text).alias("v"))
    levels = {"exact": Level.EXACT, "safe": Level.SAFE_WIDENING, "string": Level.STRING_COERCION, "best": Level.BEST_EFFORT}
    each = [
        F.struct(F.lit(n).alias("level"), F.lit(t).alias("target"), C.coerce(c("v"), t, ShapeConfig(level=x))["ok"].alias("ok"))
        for n, x in levels.items()
        for t in ("i64", "f64", "bool", "string")
    ]
    return df.select(F.explode(F.array(*each)).alias("x")).groupBy("x.level", "x.target", "x.ok").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_custkey END AS custkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS optional_custkey,
  CASE WHEN o_orderkey % 5 = 0 THEN 'warning' ELSE 'info' END AS risk FROM orders""")
def null_sentinel_default(spark, sf):
    text = F.when(c("o_orderkey") % 5 == 0, F.element_at(F.array(*map(F.lit, ("N/A", "null", "None", "-", "undefined"))), (c("o_orderkey") % 25 / 5 + 1).cast("int"))).otherwise(c("o_custkey").cast("string"))
    df = table(spark, sf, "orders").select("o_orderkey", as_value(text).alias("v"))
    df = df.select("o_orderkey", C.coerce(c("v"), "i64").alias("x"), C.coerce(c("v"), "i64", optional=True).alias("y"))
    return df.select("o_orderkey", c("x.value").alias("custkey"), c("y.value").alias("optional_custkey"), risk_text(c("x.diag.risk")).alias("risk"))


@query("SELECT CASE o_orderkey % 4 WHEN 0 THEN 'risky' WHEN 1 THEN 'warning' WHEN 2 THEN 'warning' ELSE 'info' END AS risk, count(*) AS n FROM orders GROUP BY 1")
def diag_risk_counts(spark, sf):
    k = c("o_orderkey")
    text = F.when(k % 4 == 0, "300").when(k % 4 == 1, "0x7f").when(k % 4 == 2, None).otherwise("7")
    found = bent(text, "u8")["diag"]["risk"]
    return table(spark, sf, "orders").groupBy(F.coalesce(risk_text(found), F.lit("none")).alias("risk")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, length(o_orderpriority) AS letters, 2 AS elements, o_custkey AS second, true AS ok FROM orders")
def coerce_arrays(spark, sf):
    doc = obj(F.array(F.length("o_orderpriority").cast("string"), c("o_custkey").cast("string")).alias("a"))
    df = table(spark, sf, "orders").select("o_orderkey", C.coerce_array(V.at(doc, "a"), "i64").alias("x"))
    return df.select("o_orderkey", c("x.value")[0].cast("long").alias("letters"), F.size("x.value").alias("elements"), c("x.value")[1].alias("second"), c("x.ok").alias("ok"))


# Dates


@query("""
SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS iso, strftime(l_shipdate, '%Y-%m-%d') AS european, strftime(l_shipdate, '%Y-%m-%d') AS long_, CASE WHEN month(l_shipdate) <> 5 THEN strftime(l_shipdate, '%Y-%m-%d') END AS short_,
  CASE WHEN day(l_shipdate) > 12 THEN 'UsDate' ELSE 'Ambiguous' END AS format FROM lineitem""")
def date_us_to_iso(spark, sf):
    d = c("l_shipdate")
    us = F.date_format(d, "MM/dd/yyyy")
    return table(spark, sf, "lineitem").select(
        *LINE,
        dates.to_iso(us).alias("iso"),
        dates.to_iso(F.date_format(d, "dd.MM.yyyy")).alias("european"),
        dates.to_iso(F.date_format(d, "MMMM d, yyyy")).alias("long_"),
        dates.to_iso(F.date_format(d, "dd-MMM-yy")).alias("short_"),  # May is taken for a long name
        dates.detect(us).alias("format"),
    )


@query("""
SELECT event_id, CASE WHEN epoch(ts) > 946684800 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS seconds,
  CASE WHEN epoch(ts) > 946684800 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS millis, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS hl7 FROM events""")
def date_unix_to_iso(spark, sf):
    n = F.floor(c("ts").cast("timestamp").cast("double")).cast("long")
    return table(spark, sf, "events").select(
        "event_id",
        dates.to_iso(n.cast("string")).alias("seconds"),
        dates.to_iso((n * 1000 + 7).cast("string")).alias("millis"),
        medical.parse_hl7_datetime(F.date_format("ts", "yyyyMMddHHmmss")).alias("hl7"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS monday FROM orders")
def date_iso_week(spark, sf):
    d = c("o_orderdate").cast("date")
    thursday = F.date_add(F.trunc(d, "WEEK"), 3)
    week = F.concat(F.year(thursday), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    return table(spark, sf, "orders").select("o_orderkey", dates.to_iso(F.concat(week, F.lit("-"), F.weekday(d) + 1)).alias("day"), dates.to_iso(week).alias("monday"))


@query("""
SELECT count(*) AS total, count(*) AS dates, count(*) FILTER (day(o_orderdate) <= 12) AS ambiguous,
  CASE WHEN count(*) FILTER (day(o_orderdate) <= 12) >= count(*) FILTER (day(o_orderdate) > 12) THEN 'Ambiguous' ELSE 'UsDate' END AS dominant,
  false AS day_first, 1.0::DOUBLE AS date_share FROM orders""")
def date_column_format(spark, sf):
    return dates.column_format(table(spark, sf, "orders").select(F.date_format("o_orderdate", "MM/dd/yyyy").alias("d")), "d")


# Currency


@query("""
SELECT o_orderkey, round(o_totalprice, 2) AS amount, CASE o_orderkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' ELSE 'PLN' END AS code,
  -round(o_totalprice, 2) AS negative FROM orders""")
def currency_parse(spark, sf):
    n, k = F.format_number("o_totalprice", 2), c("o_orderkey") % 3
    text = F.when(k == 0, F.concat(F.lit("€"), n)).when(k == 1, F.concat(F.lit("GBP "), n)).otherwise(F.concat(n, F.lit(" pln")))
    df = table(spark, sf, "orders").select("o_orderkey", currency.parse(text).alias("x"), currency.parse(F.concat(F.lit("($"), n, F.lit(")"))).alias("y"))
    return df.select("o_orderkey", "x.amount", "x.code", c("y.amount").alias("negative"))


@query("""
SELECT c_custkey, c_acctbal * ((CASE c_nationkey % 3 WHEN 0 THEN 0.92 WHEN 1 THEN 148.0 ELSE 1.36 END)::DOUBLE / (0.79)::DOUBLE) AS converted,
  c_acctbal * 2.0::DOUBLE AS by_table FROM customer""")
def currency_convert(spark, sf):
    to = F.element_at(F.array(F.lit("EUR"), F.lit("JPY"), F.lit("CAD")), c("c_nationkey") % 3 + 1)
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.lit("GBP").alias("f"), to.alias("t"))
    rates = spark.createDataFrame([("GBP", t, 2.0) for t in ("EUR", "JPY", "CAD")], "from string, to string, rate double")
    out = currency.convert_with(df, rates, "c_acctbal", "f", "t", "by_table")
    return out.select("c_custkey", currency.convert(c("c_acctbal"), c("f"), c("t")).alias("converted"), "by_table")


# Units


@query("""
SELECT l_orderkey, l_linenumber, l_quantity AS amount, ['kg', 'lb', 'ft', 'mL'][l_linenumber % 4 + 1] AS unit, ['Weight', 'Weight', 'Length', 'Volume'][l_linenumber % 4 + 1] AS category,
  l_quantity + l_linenumber * (1.0::DOUBLE / 12.0::DOUBLE) AS feet FROM lineitem""")
def unit_parse(spark, sf):
    word = F.element_at(F.array(*map(F.lit, (" kg", "LBR", " Feet", " ml"))), c("l_linenumber") % 4 + 1)
    n = c("l_quantity").cast("long").cast("string")
    two = units.parse(F.concat(n, F.lit(" ft "), c("l_linenumber").cast("string"), F.lit(" in")))
    df = table(spark, sf, "lineitem").select(*LINE, units.parse(F.concat(n, word)).alias("x"), two.alias("y"))
    return df.select(*LINE, "x.amount", "x.unit", "x.category", c("y.amount").alias("feet"))


@query("""
SELECT l_orderkey, l_linenumber, l_quantity * 0.453592::DOUBLE AS kilograms, l_quantity * 1.8::DOUBLE + 32.0::DOUBLE AS fahrenheit, NULL::DOUBLE AS unknown FROM lineitem""")
def unit_convert(spark, sf):
    q = c("l_quantity")
    one = lambda a, b: units.convert(q, F.lit(a), F.lit(b))
    return table(spark, sf, "lineitem").select(*LINE, one("lb", "kg").alias("kilograms"), one("°C", "°F").alias("fahrenheit"), one("kg", "km").alias("unknown"))


@query("""
SELECT p_partkey, p_size::BIGINT AS of_box, (p_size * 12)::BIGINT AS times, p_size::BIGINT AS packs, (p_size * 500)::BIGINT AS bottles, 'mL' AS per_unit, p_size::DOUBLE AS weight, 'Gross' AS qualifier FROM part""")
def pack_notation(spark, sf):
    n = c("p_size").cast("string")
    df = table(spark, sf, "part").select(
        "p_partkey",
        units.parse_pack(F.concat(F.lit("Box of "), n)).alias("a"),
        units.parse_pack(F.concat(n, F.lit("x12-count"))).alias("b"),
        units.parse_pack(F.concat(n, F.lit("x500ml"))).alias("d"),
        units.parse_weight(F.concat(F.lit("gross wt: "), n, F.lit(" kg"))).alias("e"),
    )
    return df.select("p_partkey", c("a.total_units").alias("of_box"), c("b.total_units").alias("times"), c("b.packs").alias("packs"), c("d.total_units").alias("bottles"), c("d.per_pack.unit").alias("per_unit"), c("e.amount").alias("weight"), c("e.qualifier").alias("qualifier"))


# Identifiers

_CARD = "('4' || lpad(o_orderkey::VARCHAR, 15, '0'))"


@query(f"""
SELECT o_orderkey, (list_sum([CASE WHEN i % 2 = 1 THEN (CASE WHEN substr({_CARD}, i, 1)::INT * 2 > 9 THEN substr({_CARD}, i, 1)::INT * 2 - 9 ELSE substr({_CARD}, i, 1)::INT * 2 END) ELSE substr({_CARD}, i, 1)::INT END FOR i IN range(1, 17)]) % 10) = 0 AS valid,
  CASE WHEN (list_sum([CASE WHEN i % 2 = 1 THEN (CASE WHEN substr({_CARD}, i, 1)::INT * 2 > 9 THEN substr({_CARD}, i, 1)::INT * 2 - 9 ELSE substr({_CARD}, i, 1)::INT * 2 END) ELSE substr({_CARD}, i, 1)::INT END FOR i IN range(1, 17)]) % 10) = 0 THEN 'Visa' END AS brand
FROM orders""")
def luhn_card(spark, sf):
    text = F.concat(F.lit("4"), F.lpad(c("o_orderkey").cast("string"), 15, "0"))
    df = table(spark, sf, "orders").select("o_orderkey", identifiers.validate(text, "CreditCard").alias("x"))
    return df.select("o_orderkey", c("x.is_valid").alias("valid"), c("x.detail").alias("brand"))


@query("""
SELECT o_orderkey, (list_sum([substr('978' || lpad(o_orderkey::VARCHAR, 10, '0'), i, 1)::INT * (CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END) FOR i IN range(1, 14)]) % 10) = 0 AS isbn13,
  (list_sum([substr(lpad(o_orderkey::VARCHAR, 10, '0'), i, 1)::INT * (11 - i) FOR i IN range(1, 11)]) % 11) = 0 AS isbn10,
  (list_sum([substr(lpad(o_orderkey::VARCHAR, 10, '0'), i, 1)::INT * (11 - i) FOR i IN range(1, 10)]) + substr(lpad(o_orderkey::VARCHAR, 10, '0'), 10, 1)::INT) % 11 = 0 AND o_orderkey > 0 AS nhs,
  ('3214282912345698765432161182'::HUGEINT % 97) = 1 AS iban
FROM orders""")
def checksum_identifiers(spark, sf):
    n = F.lpad(c("o_orderkey").cast("string"), 10, "0")
    ok = lambda text, kind: identifiers.validate(text, kind)["is_valid"]
    return table(spark, sf, "orders").select(
        "o_orderkey", ok(F.concat(F.lit("978"), n), "Isbn13").alias("isbn13"), ok(n, "Isbn10").alias("isbn10"), ok(n, "UkNhs").alias("nhs"), ok(F.lit("GB82 WEST 1234 5698 7654 32"), "Iban").alias("iban")
    )


@query("""
SELECT c_custkey, true AS made_valid, true AS email, c_custkey % 100 <> 0 AS ssn, true AS ein, true AS uuid, true AS vat, true AS phone FROM customer""")
def shaped_identifiers(spark, sf):
    k = c("c_custkey")
    body = F.lpad(k.cast("string"), 18, "0")
    left = F.pmod(F.concat(body, F.lit("131400")).cast("decimal(38,0)"), F.lit(97).cast("decimal(38,0)"))
    iban = F.concat(F.lit("DE"), F.lpad((98 - left).cast("int").cast("string"), 2, "0"), body)
    ok = lambda text, kind: identifiers.validate(text, kind)["is_valid"]
    h = F.md5(k.cast("string").cast("binary"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return table(spark, sf, "customer").select(
        "c_custkey",
        ok(iban, "Iban").alias("made_valid"),
        ok(F.concat(F.lit("user."), k.cast("string"), F.lit("@mail.example.com")), "Email").alias("email"),
        ok(F.concat(F.lit("123-"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("-1234")), "UsSsn").alias("ssn"),
        ok(F.concat(F.lit("12-"), F.lpad((k % 1000000 + 1).cast("string"), 7, "0")), "UsEin").alias("ein"),
        ok(F.upper(uuid), "Uuid").alias("uuid"),
        ok(F.concat(F.lit("DE "), F.lpad(k.cast("string"), 9, "0")), "EuVat").alias("vat"),
        ok(F.concat(F.lit("+1 (555) "), F.lpad(k.cast("string"), 7, "0")), "Phone").alias("phone"),
    )


# Coordinates


@query("""
SELECT c_custkey, (c_custkey % 90)::DOUBLE AS latitude, -(c_custkey % 180)::DOUBLE AS longitude, (c_custkey % 90) + (c_custkey % 60) / 60.0::DOUBLE AS marked, (c_custkey % 90)::DOUBLE AS iso FROM customer""")
def geo_parse(spark, sf):
    lat, lng = (c("c_custkey") % 90).cast("string"), (c("c_custkey") % 180).cast("string")
    plain = F.concat(lat, F.lit(".0, -"), lng, F.lit(".0"))
    marked = F.concat(lat, F.lit("°"), (c("c_custkey") % 60).cast("string"), F.lit("'N "), lng, F.lit("°W"))
    iso = F.concat(F.lit("+"), lat, F.lit("-"), lng, F.lit("/"))
    df = table(spark, sf, "customer").select("c_custkey", geo.parse(plain).alias("p"), geo.parse(marked).alias("m"), geo.parse(iso).alias("i"))
    return df.select("c_custkey", "p.latitude", "p.longitude", c("m.latitude").alias("marked"), c("i.latitude").alias("iso"))


@query("SELECT CASE WHEN max(abs(c_custkey % 200)) > 90 THEN 'LngLat' ELSE 'Ambiguous' END AS \"order\" FROM customer")
def geo_order(spark, sf):
    return geo.coordinate_order(table(spark, sf, "customer").select((c("c_custkey") % 200).alias("a"), (c("c_custkey") % 80).alias("b")), "a", "b")


# Clinical values


@query("""
SELECT p_partkey, round(b, 9) AS bmi, CASE WHEN b < 16 THEN 'severe thinness' WHEN b < 17 THEN 'moderate thinness' WHEN b < 18.5 THEN 'mild thinness' WHEN b < 25 THEN 'normal'
  WHEN b < 30 THEN 'overweight' WHEN b < 35 THEN 'obese class I' WHEN b < 40 THEN 'obese class II' ELSE 'obese class III' END AS class,
  round(0.007184 * pow(w, 0.425) * pow(170.0, 0.725), 9) AS bsa, round(142 * pow(least(w / 50 / 0.7, 1), -0.241) * pow(greatest(w / 50 / 0.7, 1), -1.2) * pow(0.9938, p_size) * 1.012, 6) AS egfr,
  round((140.0 - p_size) * w / (72.0 * (w / 50)), 6) AS clearance, round(9.0 + 0.8 * (4.0 - p_size / 20.0), 9) AS calcium, (140.0 - (100.0 + p_size))::DOUBLE AS gap
FROM (SELECT p_partkey, p_size, (40 + p_size)::DOUBLE AS w, (40 + p_size)::DOUBLE / (1.7::DOUBLE * 1.7::DOUBLE) AS b FROM part)""")
def clinical_measures(spark, sf):
    w, age = (c("p_size") + 40).cast("double"), c("p_size")
    value = medical.bmi(w, F.lit(1.7))
    return table(spark, sf, "part").select(
        "p_partkey",
        F.round(value, 9).alias("bmi"),
        medical.bmi_class(value).alias("class"),
        F.round(medical.bsa(w, F.lit(170.0)), 9).alias("bsa"),
        F.round(medical.egfr(w / 50, age, F.lit(True)), 6).alias("egfr"),
        F.round(medical.creatinine_clearance(w / 50, age, w, F.lit(False)), 6).alias("clearance"),
        F.round(medical.corrected_calcium(F.lit(9.0), age / 20.0), 9).alias("calcium"),
        medical.anion_gap(F.lit(140.0), F.lit(100.0), age.cast("double")).alias("gap"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_quantity * 0.0555::DOUBLE AS glucose, l_quantity / 88.4::DOUBLE AS creatinine, (l_quantity - 2.15::DOUBLE) * 10.929::DOUBLE AS hba1c, l_quantity AS same, NULL::DOUBLE AS unknown,
  CASE WHEN l_quantity * 3 < 40 THEN 'CriticalLow' WHEN l_quantity * 3 < 70 THEN 'Low' WHEN l_quantity * 3 > 100 THEN 'High' ELSE 'Normal' END AS class FROM lineitem""")
def lab_convert_classify(spark, sf):
    q = c("l_quantity")
    to = lambda a, s, t: medical.convert_lab(q, F.lit(a), F.lit(s), F.lit(t))
    return table(spark, sf, "lineitem").select(
        *LINE,
        to("Blood Sugar", "mg/dL", "mmol/L").alias("glucose"),
        to("creat", "µmol/L", "mg/dl").alias("creatinine"),
        to("a1c", "%", "mmol/mol").alias("hba1c"),
        to("sodium", "mEq/L", "meq/l").alias("same"),
        to("moonstone", "mg/dL", "mmol/L").alias("unknown"),
        medical.classify_lab(q * 3, F.lit("glu"), F.lit("mg/dL")).alias("class"),
    )


@query("""
SELECT p_partkey, 'µg' AS unit, 'twice daily' AS abbreviation, p_brand AS component, 3 AS fields, p_retailprice AS value, p_brand AS display, 'final' AS status, 1.5::DOUBLE AS low FROM part""")
def clinical_records(spark, sf):
    doc = F.to_json(F.struct(
        F.lit("final").alias("status"), F.struct(F.array(F.struct(F.lit("x").alias("code"), c("p_brand").alias("display"))).alias("coding")).alias("code"),
        F.struct(c("p_retailprice").alias("value"), F.lit("mg").alias("unit")).alias("valueQuantity"), F.array(F.struct(F.struct(F.lit(1.5).alias("value")).alias("low"))).alias("referenceRange"),
    ))
    df = table(spark, sf, "part").select(
        "p_partkey",
        medical.pharma_unit(F.lit("MCG")).alias("unit"),
        medical.pharma_abbreviation(F.lit("bid")).alias("abbreviation"),
        medical.hl7_segment(F.concat(F.lit("PID|1^"), c("p_brand"), F.lit("|"))).alias("seg"),
        medical.fhir_observation(V.from_json(doc)).alias("o"),
    )
    return df.select("p_partkey", "unit", "abbreviation", c("seg")[1][1].alias("component"), F.size("seg").alias("fields"), "o.value", "o.display", "o.status", c("o.reference_low").alias("low"))


# Schemas, contracts, merging


def event_rows(spark, sf) -> DataFrame:
    """Events as objects: the value missing in every seventh, a text in every fifth, null in every eleventh."""
    k = c("event_id")
    value = F.when(k % 11 == 0, '"v":null,').when(k % 7 == 0, "").when(k % 5 == 0, '"v":"12.5",').otherwise('"v":12.5,')
    text = F.concat(F.lit("{"), value, F.lit('"id":'), k.cast("string"), F.lit(',"type":"'), c("event_type"), F.lit('"}'))
    return table(spark, sf, "events").select((k - F.lit(first_id(spark, sf))).alias("row_idx"), V.from_json(text).alias("doc"))


def first_id(spark, sf) -> int:
    return table(spark, sf, "events").agg(F.min("event_id")).first()[0]


@query("""
WITH e AS (SELECT event_id AS k, event_id - min(event_id) OVER () AS i FROM events), t AS (SELECT count(*) AS total, min(i) FILTER (k % 11 = 0 OR k % 7 <> 0) AS f FROM e)
SELECT 'v' AS field, total, count(*) FILTER (k % 11 = 0 OR k % 7 <> 0) AS present, count(*) FILTER (k % 11 = 0) AS nulls, total - count(*) FILTER (k % 11 = 0 OR k % 7 <> 0) AS absent,
  'float' AS dominant, count(*) FILTER (k % 11 <> 0 AND k % 7 <> 0 AND k % 5 <> 0) AS n_dominant, 2 AS kinds FROM e, t GROUP BY total
UNION ALL SELECT 'id', total, total, 0, 0, 'integer', total, 1 FROM t UNION ALL SELECT 'type', total, total, 0, 0, 'string', total, 1 FROM t""")
def schema_infer_events(spark, sf):
    found = S.infer(event_rows(spark, sf), samples=False)
    rows = [(f.name, f.total, f.present, f.nulls, f.absent, f.dominant, f.kinds[f.dominant], len(f.kinds)) for f in found.fields.values()]
    return spark.createDataFrame(rows, "field string, total long, present long, nulls long, absent long, dominant string, n_dominant long, kinds int")


@query("""
SELECT kind, count(*) AS n, sum(row_idx)::BIGINT AS rows FROM (
  SELECT event_id - min(event_id) OVER () AS row_idx, event_id AS k FROM events) e,
  LATERAL (SELECT unnest(CASE WHEN k % 11 = 0 THEN ['UnexpectedNull'] WHEN k % 7 = 0 THEN ['MissingRequired'] WHEN k % 5 = 0 THEN [] ELSE ['ConstraintViolation'] END) AS kind) GROUP BY 1""")
def schema_audit_events(spark, sf):
    rows = event_rows(spark, sf)
    limits = {"v": S.Constraint("float", required=True, nullable=False, max_value=12.0), "type": S.Constraint("string", required=True)}
    found = S.audit(rows, S.infer(rows, samples=False).with_constraints(limits))
    return found.violations.groupBy("kind").agg(F.count("*").alias("n"), F.sum("row_idx").alias("rows"))


@query("""
SELECT field, clean, coercible, violations, missing FROM (
  SELECT 'v' AS field, count(*) FILTER (event_id % 11 = 0 OR (event_id % 7 <> 0 AND event_id % 5 <> 0)) AS clean, count(*) FILTER (event_id % 11 <> 0 AND event_id % 7 <> 0 AND event_id % 5 = 0) AS coercible, 0::BIGINT AS violations,
    count(*) FILTER (event_id % 11 <> 0 AND event_id % 7 = 0) AS missing FROM events
  UNION ALL SELECT unnest(['id', 'type']), count(*), 0, 0, 0 FROM events)""")
def schema_field_stats(spark, sf):
    rows = event_rows(spark, sf)
    return S.audit(rows, S.infer(rows, samples=False)).field_stats


ORDER = ShapeSpec(
    "OrderRecord",
    (
        FieldSpec("key", "i64", rename="o_orderkey"),
        FieldSpec("price", "f64", rename="o_totalprice", coerce=True, default=True),
        FieldSpec("status", "string", rename="o_orderstatus", optional=True),
        FieldSpec("note", "string", default=True),
        FieldSpec("rest", overflow=True),
    ),
)


def order_docs(spark, sf) -> DataFrame:
    """Orders as objects: prices are text, some of them no number; the priority is a field that the contract doesn't know."""
    k = c("o_orderkey")
    price = F.when(k % 9 == 0, "much").otherwise(F.format_number("o_totalprice", 2))
    doc = obj(k.alias("o_orderkey"), price.alias("o_totalprice"), c("o_orderstatus"), c("o_orderpriority").alias("priority"))
    return table(spark, sf, "orders").select(k, doc.alias("doc"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 0.0 ELSE round(o_totalprice, 2) END AS price, o_orderstatus AS status, '' AS note, o_orderpriority AS priority, 1 AS residual,
  CASE WHEN o_orderkey % 9 = 0 THEN 'error_defaulted,preserved' ELSE 'coerced,preserved' END AS told FROM orders""")
def shape_overflow(spark, sf):
    out = ORDER.apply(order_docs(spark, sf), "doc", ABSORBING)
    told = F.array_join(F.transform("_diag", lambda d: d["kind"]), ",")
    return out.select("o_orderkey", "value.price", "value.status", "value.note", V.string(c("value.rest")["priority"]).alias("priority"), F.size("_residual").alias("residual"), told.alias("told"))


@query("SELECT 'unknown fields: priority' AS reason, count(*) AS n FROM orders")
def shape_strict_rejects(spark, sf):
    _, refused = ORDER.split(order_docs(spark, sf), "doc", STRICT)
    return refused.groupBy(c("_error").alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, '{\"a\":' || o_orderkey || ',\"b\":{\"y\":2},\"c\":null}' AS merged FROM orders")
def merge_shallow(spark, sf):
    left = obj(c("o_orderkey").alias("a"), F.struct(F.lit(1).alias("x")).alias("b"), F.lit(3).alias("c"))
    return table(spark, sf, "orders").select("o_orderkey", V.merge_shallow(left, V.from_json(F.lit('{"b":{"y":2},"c":null}'))).alias("merged"))


@query("""
SELECT o_orderkey, '{"a":' || o_orderkey || ',"b":{"x":1,"y":2},"d":5}' AS merged, 2 AS told, '{"a":' || o_orderkey || ',"b":{"x":1,"z":[null,7]},"d":[1]}' AS placed FROM orders""")
def merge_deep(spark, sf):
    left = F.concat(F.lit('{"a":'), c("o_orderkey").cast("string"), F.lit(',"b":{"x":1},"d":[1]}'))
    right = F.lit('{"b":{"y":2},"d":5}')
    return table(spark, sf, "orders").select(
        "o_orderkey", merge.merge(left, right).alias("merged"), F.size(merge.merge_diagnostics(left, right)).alias("told"), merge.set_path(left, "b.z[1]", F.lit("7")).alias("placed")
    )


@query("SELECT l_orderkey, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY 1")
def explode_lines(spark, sf):
    docs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct(c("l_quantity").alias("q")))).alias("lines"))
    each = docs.select("l_orderkey", F.explode(V.elements(V.at(obj(c("lines")), "lines"))).alias("line"))
    return each.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(C.extract(c("line"), "q", "i64")["value"]).alias("quantity"))


# Guesses


@query("""
SELECT kind, sub, count(*) AS n FROM (SELECT unnest(['Integer', 'Float', 'Date', 'Currency', 'UnitValue', 'Email', 'PlainString', 'Boolean']) AS kind,
  unnest([NULL, NULL, 'IsoDate', NULL, 'Weight', NULL, NULL, NULL]) AS sub, o_orderkey FROM orders) GROUP BY ALL""")
def guess_type_top1(spark, sf):
    k, n = c("o_orderkey"), c("o_custkey").cast("string")
    made = F.array(
        F.concat(F.lit("5"), n), F.concat(n, F.lit(".25")), F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("$"), n, F.lit(".50")), F.concat(n, F.lit(" kg")),
        F.concat(F.lit("a"), n, F.lit("@b.org")), F.concat(F.lit("order "), F.regexp_replace(c("o_orderpriority"), "[^A-Z]", ""), F.lit(" sent")), F.when(k % 2 == 0, "yes").otherwise("FALSE"),
    )
    texts = table(spark, sf, "orders").select(F.explode(made).alias("t"))
    top = detect.guess_column(texts, "t").select(c("guesses")[0].alias("g"))
    return top.groupBy("g.kind", "g.sub").agg(F.count("*").alias("n"))


# Streams and providers


def sse_chunks(spark, sf) -> DataFrame:
    """Each conversation as one stream of events; every turn is a text block."""
    turn = F.concat(
        F.lit("event: content_block_delta\ndata: "),
        F.to_json(F.struct(F.lit("content_block_delta").alias("type"), c("turn").cast("int").alias("index"), F.struct(F.lit("text_delta").alias("type"), c("text")).alias("delta"))),
        F.lit("\r\n\r\n"),
    )
    rows = table(spark, sf, "conversations").where(c("text").isNotNull())
    return rows.select(c("conv_id").cast("string").alias("stream_id"), c("turn").alias("seq"), F.lit("anthropic").alias("provider"), turn.alias("chunk"))


@query("SELECT conv_id::VARCHAR AS stream_id, string_agg(text, '' ORDER BY turn) AS text, false AS done FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def sse_messages(spark, sf):
    return streams.messages(sse_chunks(spark, sf)).select("stream_id", "text", "done")


@query("SELECT conv_id::VARCHAR AS stream_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS n, 'text_delta' AS kind, text FROM conversations WHERE text IS NOT NULL")
def sse_events(spark, sf):
    return streams.sse_events(sse_chunks(spark, sf)).select("stream_id", "n", "kind", "text")


def bodies(spark, sf) -> DataFrame:
    """Each order as the response of a provider, with one text and one tool use."""
    k = c("o_orderkey").cast("string")
    call = F.struct(F.struct(F.lit("look").alias("name"), F.concat(F.lit('{"key":'), k, F.lit("}")).alias("arguments")).alias("function"), F.concat(F.lit("call_"), k).alias("id"))
    choice = F.struct(F.struct(F.lit("assistant").alias("role"), c("o_orderpriority").alias("content"), F.array(call).alias("tool_calls")).alias("message"), F.lit("tool_calls").alias("finish_reason"))
    usage = F.struct(c("o_custkey").alias("prompt_tokens"), F.lit("7").alias("completion_tokens"))
    doc = obj(F.concat(F.lit("r"), k).alias("id"), F.lit("m").alias("model"), F.array(choice).alias("choices"), usage.alias("usage"))
    return table(spark, sf, "orders").select("o_orderkey", doc.alias("doc"))


@query("""
SELECT o_orderkey, 'r' || o_orderkey AS id, o_orderpriority AS text, '{"key":' || o_orderkey || '}' AS input, 'tool_use' AS stop_reason, o_custkey AS input_tokens, 7 AS output_tokens,
  '{"content":[{"text":"' || o_orderpriority || '","type":"text"},{"id":"call_' || o_orderkey || '","input":{"key":' || o_orderkey || '},"name":"look","type":"tool_use"}],"id":"r' || o_orderkey ||
  '","model":"m","stop_reason":"tool_use","type":"message","usage":{"input_tokens":' || o_custkey || ',"output_tokens":7}}' AS emitted FROM orders""")
def provider_normalise(spark, sf):
    df = bodies(spark, sf).select("o_orderkey", providers.parse_openai(c("doc")).alias("r"))
    emitted = F.to_json(V.from_json(providers.emit_anthropic(c("r"))))
    return df.select(
        "o_orderkey", "r.id", providers.text(c("r")).alias("text"), providers.tool_uses(c("r"))[0]["input"].alias("input"), "r.stop_reason", "r.usage.input_tokens", c("r.usage.output_tokens").cast("int").alias("output_tokens"), emitted.alias("emitted")
    )


@query("SELECT o_orderkey, 0 AS pos, 'call_' || o_orderkey AS id, (o_orderkey * 2)::VARCHAR AS result FROM orders")
def tool_dispatch(spark, sf):
    registry = HandlerRegistry()
    registry.register_sync("look", lambda value: value["key"] * 2)
    parsed = bodies(spark, sf).select("o_orderkey", providers.parse_openai(c("doc")).alias("r"))
    return registry.apply(parsed, "r", "o_orderkey").select("o_orderkey", "pos", "id", "result")


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price, o_custkey::DOUBLE AS weight FROM orders")
def coerce_packs(spark, sf):
    config = ShapeConfig(packs=Packs.ALL)
    price, weight = F.concat(F.lit("$"), F.format_number("o_totalprice", 2)), F.concat(c("o_custkey").cast("string"), F.lit(" kg"))
    return table(spark, sf, "orders").select("o_orderkey", bent(price, "f64", config)["value"].alias("price"), bent(weight, "f64", config)["value"].alias("weight"))
