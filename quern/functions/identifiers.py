"""Identifiers with checksums or shapes: validation and detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import let, trim

#: Kinds in the order they are tried, and how sure a match is.
CONFIDENCE = {
    "Uuid": 0.98, "Iban": 0.95, "CreditCard": 0.90, "Isbn13": 0.90, "Isbn10": 0.85, "Email": 0.90, "EuVat": 0.75, "UsNpi": 0.80, "UkNhs": 0.75,
    "UsSsn": 0.50, "UsEin": 0.50, "Phone": 0.40,
}
#: The number of a VAT identifier by country.
VAT = {
    "AT": "U.{8}", "BE": "[0-9]{10}", "BG": "[0-9]{9,10}", "CY": ".{9}", "CZ": "[0-9]{8,10}", "DE": "[0-9]{9}", "DK": "[0-9]{8}", "EE": "[0-9]{9}",
    "EL": "[0-9]{9}", "GR": "[0-9]{9}", "ES": ".{9}", "FI": "[0-9]{8}", "FR": ".{11}", "GB": "(.{9}|.{12}|(GD|HA)[0-9]{3})", "HR": "[0-9]{11}",
    "HU": "[0-9]{8}", "IE": ".{8,9}", "IT": "[0-9]{11}", "LT": "([0-9]{9}|[0-9]{12})", "LU": "[0-9]{8}", "LV": "[0-9]{11}", "MT": "[0-9]{8}",
    "NL": "[0-9]{9}B[0-9]{2}", "PL": "[0-9]{10}", "PT": "[0-9]{9}", "RO": "[0-9]{2,10}", "SE": "[0-9]{12}", "SI": "[0-9]{8}", "SK": "[0-9]{10}",
}
#: Card brands by first digits, in order.
BRANDS = (
    ("^4", "Visa"), ("^5[1-5]", "Mastercard"), ("^(222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)", "Mastercard"), ("^3[47]", "Amex"),
    ("^(6011|65)", "Discover"), ("^(5018|5020|5038|6304|6759|6761|6763)", "Maestro"), ("^35", "JCB"), ("^3[068]", "Diners Club"),
)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _values(digits: Column) -> Column:
    """The digits as numbers; X is 10."""
    return F.transform(F.split(digits, ""), lambda d: F.when(F.upper(d) == "X", 10).otherwise(F.coalesce(d.try_cast("int"), F.lit(0))))


def _weighted(digits: Column, weight) -> Column:
    """The sum of digits times `weight(place)`."""
    return F.aggregate(F.transform(_values(digits), lambda d, i: d * weight(i)), F.lit(0), lambda a, x: a + x)


def _result(valid: Column, normalized: Column, detail: Column | None = None) -> Column:
    valid = F.coalesce(valid, F.lit(False))
    return F.struct(
        valid.alias("is_valid"),
        normalized.alias("normalized"),
        (F.lit(None).cast("string") if detail is None else F.when(valid, detail)).alias("detail"),
        F.when(~valid, F.lit("invalid")).alias("error"),
    )


def _iban(s: Column) -> Column:
    def one(u: Column) -> Column:
        turned = F.concat(F.substring(u, 5, 40), F.substring(u, 1, 4))
        letters = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("^[A-Z]$"), (F.ascii(c) - 55).cast("string")).otherwise(c))
        left = F.aggregate(F.split(F.array_join(letters, ""), ""), F.lit(0), lambda a, d: (a * 10 + F.coalesce(d.try_cast("int"), F.lit(0))) % 97)
        return _result(u.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (left == 1), u, F.substring(u, 1, 2))

    return let(F.upper(F.regexp_replace(s, r"\p{IsWhite_Space}", "")), one)


def _card(s: Column) -> Column:
    brand = F.lit("Unknown")
    for pattern, name in reversed(BRANDS):
        brand = F.when(_digits(s).rlike(pattern), name).otherwise(brand)
    return let(_digits(s), lambda d: _result(d.rlike("^[0-9]{13,19}$") & ~d.rlike("^0+$") & F.call_function("luhn_check", d), d, brand))


def _isbn10(s: Column) -> Column:
    return let(F.regexp_replace(s, "[^0-9Xx]", ""), lambda d: _result((F.length(d) == 10) & (_weighted(d, lambda i: F.lit(10) - i) % 11 == 0), d))


def _isbn13(s: Column) -> Column:
    return let(_digits(s), lambda d: _result(d.rlike("^97[89][0-9]{10}$") & (_weighted(d, lambda i: F.when(i % 2 == 0, 1).otherwise(3)) % 10 == 0), d))


def _ssn(s: Column) -> Column:
    shape = trim(s).rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return _result(shape, _digits(s))


def _ein(s: Column) -> Column:
    return let(_digits(s), lambda d: _result(trim(s).rlike("^(?!00)[0-9]{2}-(?!0000000)[0-9]{7}$"), F.concat_ws("-", F.substring(d, 1, 2), F.substring(d, 3, 9))))


def _npi(s: Column) -> Column:
    return let(_digits(s), lambda d: _result((F.length(d) == 10) & F.call_function("luhn_check", F.concat(F.lit("80840"), d)), d))


def _nhs(s: Column) -> Column:
    def one(d: Column) -> Column:
        left = _weighted(F.substring(d, 1, 9), lambda i: F.lit(10) - i) % 11
        check = F.when(left == 0, 0).otherwise(11 - left)
        return _result(d.rlike("^[0-9]{10}$") & ~d.rlike("^0+$") & (check == F.substring(d, 10, 1).try_cast("int")), d)

    return let(_digits(s), one)


def _vat(s: Column) -> Column:
    shape = "^(" + "|".join(k + v for k, v in VAT.items()) + ")$"
    return let(F.upper(F.regexp_replace(s, r"\p{IsWhite_Space}", "")), lambda u: _result(u.rlike(r"^[\x00-\x7F]{4,}$") & u.rlike(shape), u, F.substring(u, 1, 2)))


def _uuid(s: Column) -> Column:
    return let(F.lower(trim(s)), lambda u: _result(u.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), u))


def _email(s: Column) -> Column:
    def one(t: Column) -> Column:
        local, domain = F.regexp_extract(t, "^([^@]*)@", 1), F.regexp_extract(t, "@([^@]*)$", 1)
        shape = t.rlike(r"^[^@ ]+@[^@ ]+$") & (F.octet_length(local) <= 64) & ~local.rlike(r"^\.|\.$|\.\.")
        labels = F.forall(F.split(domain, r"\.", -1), lambda x: (x != "") & ~x.rlike("^-|-$|_"))
        return _result(shape & F.contains(domain, F.lit(".")) & labels, t, domain)

    return let(trim(s), one)


def _phone(s: Column) -> Column:
    t = trim(s)
    return _result(t.rlike(r"^\+?[0-9 ()./-]*$") & ~t.rlike(r"^\+[^0-9]*0") & _digits(s).rlike("^[0-9]{10,15}$"), _digits(s))


#: Validators by kind.
VALIDATORS = {
    "Uuid": _uuid, "Iban": _iban, "CreditCard": _card, "Isbn13": _isbn13, "Isbn10": _isbn10, "Email": _email, "EuVat": _vat, "UsNpi": _npi, "UkNhs": _nhs,
    "UsSsn": _ssn, "UsEin": _ein, "Phone": _phone,
}


def validate(text: Column, kind: str) -> Column:
    """STRUCT<is_valid, normalized, detail, error>. The detail is a country, a card's brand or an email's domain."""
    return VALIDATORS[kind](text)


def detect(text: Column) -> Column:
    """ARRAY<STRUCT<kind, confidence>> of all kinds that fit, the surest first; equals in the order of CONFIDENCE."""

    def one(s: Column) -> Column:
        tried = F.array(*(F.when(validate(s, k)["is_valid"], F.struct(F.lit(-c).alias("less"), F.lit(i).alias("at"), F.lit(k).alias("kind"))) for i, (k, c) in enumerate(CONFIDENCE.items())))
        return F.transform(F.array_sort(F.filter(tried, lambda x: x.isNotNull())), lambda x: F.struct(x["kind"].alias("kind"), (-x["less"]).alias("confidence")))

    return let(trim(text), one)
