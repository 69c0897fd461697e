from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.functions import currency, dates, detect, geo, identifiers, medical, units


def run(spark, function, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", function(F.col("t")).alias("x")).orderBy("i").collect()
    return [tuple(r.x) if hasattr(r.x, "asDict") else r.x for r in rows]


def test_dates(spark):
    cases = {
        "2026-04-02": ("IsoDate", "2026-04-02"), "2026-02-30": ("IsoDate", None), "04/13/2026": ("UsDate", "2026-04-13"), "13/04/26": ("EuDate", "2026-04-13"),
        "4/5/26": ("Ambiguous", "2026-04-05"), "13.04.2026": ("EuDate", "2026-04-13"), "2026.04.13": ("IsoDate", "2026-04-13"), "02-11-1999": ("Ambiguous", "1999-02-11"),
        "2026-W14": ("IsoWeekDate", "2026-03-30"), "2026W143": ("IsoWeekDate", "2026-04-01"), "2026-W54": ("IsoWeekDate", None), "1999": ("YearOnly", "1999-01-01"),
        "April 2, 2026": ("LongDate", "2026-04-02"), "2 Apr 26": ("AbbrevDate", "2026-04-02"), "Feb 30, 2020": ("AbbrevDate", None),
        "20260402": ("Hl7Date", "2026-04-02"), "20260402101112.5+0200": ("Hl7Date", "2026-04-02T10:11:12.5+02:00"), "1775088000": ("UnixSeconds", "2026-04-02T00:00:00Z"),
        "1775088000123": ("UnixMillis", "2026-04-02T00:00:00Z"), "2026-04-02 10:11:12": ("Iso8601", "2026-04-02T10:11:12"), "12:30 pm": ("Time12", None), "23:59": ("Time24", None),
        "ABT 1850": ("GedcomApprox", None), "BET 1 AND 2": ("GedcomRange", None), "FROM 1900": ("GedcomPeriod", None), "BEF 1900": ("GedcomBeforeAfter", None),
        "INT 1900": ("GedcomInterpreted", None), "a@b.c": ("Unknown", None), "": ("Unknown", None), "marching 3": ("Unknown", None),
    }
    assert run(spark, dates.detect, cases) == [v[0] for v in cases.values()]
    assert run(spark, dates.to_iso, cases) == [v[1] for v in cases.values()]
    assert run(spark, lambda c: dates.to_iso(c, True), ["4/5/26"]) == ["2026-05-04"]
    assert str(run(spark, dates.to_date, ["4/13/2026"])[0]) == "2026-04-13"
    assert run(spark, lambda c: dates.note(c)["risk"], ["4/5/26", "abc", "2026-04-02"]) == [2, 1, 0]


def test_column_format(spark):
    df = spark.createDataFrame([("04/13/2026",), ("04/05/2026",), ("x",), (None,)], "d string")
    r = dates.column_format(df, "d").first()
    assert (r.total, r.dates, r.ambiguous, r.day_first) == (3, 2, 1, False)
    empty = dates.column_format(df.limit(0), "d").first()
    assert (empty.total, empty.date_share, empty.dominant) == (0, 0.0, None)


def test_currency(spark):
    cases = {
        "$1,234.56": (1234.56, "USD"), "(€12.50)": (-12.5, "EUR"), "-£5": (-5.0, "GBP"), "usd 12": (12.0, "USD"), "12.5 EUR": (12.5, "EUR"), "1.234,56": (1234.56, None),
        "HK$5": (5.0, "HKD"), "R$ 1.234,56": (1234.56, "BRL"), "¥１２": (12.0, "JPY"), "abc": (None, None), "12.99": (None, None), "": (None, None), None: (None, None),
    }
    assert [x[:2] for x in run(spark, currency.parse, cases)] == list(cases.values())
    df = spark.createDataFrame([("USD", "EUR"), ("XXX", "XXX"), ("USD", "XXX")], "a string, b string")
    assert [r[0] for r in df.select(currency.rate(F.col("a"), F.col("b"))).collect()] == [0.92, 1.0, None]


def test_units(spark):
    cases = {
        "5 kg": (5.0, "kg", "Weight"), "5kg": (5.0, "kg", "Weight"), "10 KGM": (10.0, "kg", "Weight"), "12LBR": (12.0, "lb", "Weight"), "1,234.5 lbs": (1234.5, "lb", "Weight"),
        "98.6 °F": (98.6, "°F", "Temperature"), "98.6 ºF": (98.6, "°F", "Temperature"), "3 fl oz": (3.0, "fl oz", "Volume"), "3 m/s²": (3.0, "m/s²", "Speed"),
        "5 lb 3 oz": (5.1875, "lb", "Weight"), "5": None, "kg": None, "": None, None: None,
    }
    assert run(spark, units.parse, cases) == list(cases.values())
    packs = {"dozen": 12, "6x500ml": 3000, "case of 12": 12, "24-ct": 24, "12 pack": 12, "pk/6": 6, "3x12-count": 36, "0x1f": None, "box of x": None}
    assert [x and x[0] for x in run(spark, units.parse_pack, packs)] == list(packs.values())
    assert run(spark, units.parse_weight, ["net wt 5 kg", "tare: 3 lb", "5 kg", "net wt 5 m"]) == [(5.0, "kg", "Net"), (3.0, "lb", "Tare"), (5.0, "kg", "Unspecified"), None]
    assert run(spark, units.to_mass, ["2 lb", "3 kg"]) == pytest.approx([0.907184, 3.0])


def test_identifiers(spark):
    valid = {
        "Iban": "GB82 WEST 1234 5698 7654 32", "CreditCard": "4111 1111 1111 1111", "Isbn10": "0-306-40615-2", "Isbn13": "978-0-306-40615-7", "UsSsn": "123-45-6789",
        "UsEin": "12-3456789", "UsNpi": "1234567893", "UkNhs": "943 476 5919", "EuVat": "DE123456789", "Uuid": "550E8400-e29b-41d4-a716-446655440000",
        "Email": "a.b@mail.example.org", "Phone": "+1 (555) 123-4567",
    }
    wrong = {
        "Iban": "GB83 WEST 1234 5698 7654 32", "CreditCard": "4111 1111 1111 1112", "Isbn10": "0306406153", "Isbn13": "9780306406158", "UsSsn": "666-45-6789",
        "UsEin": "00-3456789", "UsNpi": "1234567890", "UkNhs": "9434765918", "EuVat": "DE12345678", "Uuid": "550e8400e29b41d4a716446655440000", "Email": "a..b@x.org",
        "Phone": "+0 555 123 4567",
    }
    df = spark.createDataFrame([tuple(valid.values()), tuple(wrong.values())], ", ".join(f"{k} string" for k in valid))
    rows = df.select(*(identifiers.validate(F.col(k), k)["is_valid"].alias(k) for k in valid)).collect()
    assert [tuple(r) for r in rows] == [(True,) * 12, (False,) * 12]
    assert run(spark, lambda c: identifiers.validate(c, "CreditCard")["detail"], ["4111111111111111", "5555555555554444", "378282246310005"]) == ["Visa", "Mastercard", "Amex"]


def test_geo(spark):
    cases = {
        "40.7128, -74.0060": (40.7128, -74.006), "+40.7128-074.0060/": (40.7128, -74.006), "40°30'N 74°15'W": (40.5, -74.25), "10 20": (10.0, 20.0), "91, 10": None,
        "100 20": None, "abc": None, "": None, None: None,
    }
    assert [x and x[:2] for x in run(spark, geo.parse, cases)] == list(cases.values())


def test_medical(spark):
    assert run(spark, medical.parse_hl7_datetime, ["2026", "202604", "202613", "20260431", "20260402101112+0200", "1800", "x"]) == ["2026", "2026-04", None, "2026-04-31", "2026-04-02T10:11:12+02:00", None, None]
    assert run(spark, medical.pharma_abbreviation, ["po", "BID", "zz"]) == ["oral", "twice daily", None]
    assert run(spark, medical.hl7_segment, ["PID|a^b|"]) == [[["PID"], ["a", "b"], [""]]]
    assert len(medical.known_analytes()) == len(set(medical.known_analytes()))


def test_guesses(spark):
    cases = {
        "42": "Integer", "0": "Boolean", "3.5": "Float", "yes": "Boolean", "n/a": "NullSentinel", "a@b.co": "Email", "2026-04-02": "Date", "$5": "Currency", "5 kg": "UnitValue",
        "https://x.y": "Url", "1.2.3.4": "IpAddress", "1.2.3.400": "PlainString", '{"a":1}': "Json", "GB82WEST12345698765432": "Iban", "4111111111111111": "CreditCard",
        "20260402": "Date", "hello there": "PlainString", "": "NullSentinel",
    }
    found = run(spark, detect.guesses, cases)
    assert [g[0].kind for g in found] == list(cases.values())
    assert all([x.confidence for x in g] == sorted((x.confidence for x in g), reverse=True) for g in found)
