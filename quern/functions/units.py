"""Quantities with units: standard codes, suffixes, compounds, pack sizes, qualified weights, conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions import variants as V
from quern.functions.diagnostics import WARNING, diagnostic
from quern.functions.lookup import lookup

#: Standard codes by unit, and units by category. Some codes are renamed without scaling.
STANDARD = {
    "kg": "KGM TNE KG", "g": "GRM", "mg": "MGM", "lb": "LBR LB", "oz": "OZA OZ", "m": "MTR YRD MR", "cm": "CMT CM", "mm": "MMT MM", "km": "KMT",
    "ft": "FOT FT", "in": "INH IN", "L": "LTR LT LI", "mL": "MLT ML", "gal": "GLL GA GL", "°C": "CEL CE", "°F": "FAH FA", "K": "KEL", "s": "SEC",
    "min": "MIN", "h": "HUR HR DA",
}
CODES = {code: unit for unit, codes in STANDARD.items() for code in codes.split()}
#: The texts of each unit, lower case.
SPELLINGS = {
    "Weight": {
        "kg": ("kg", "kgs", "kilogram", "kilograms"), "g": ("g", "grams", "gram"), "mg": ("mg",), "lb": ("lb", "lbs", "pound", "pounds"),
        "oz": ("oz", "ounce", "ounces"), "stone": ("stone",), "tons": ("tons", "ton"), "tonne": ("tonne", "tonnes"),
    },
    "Length": {
        "km": ("km",), "m": ("m",), "cm": ("cm",), "mm": ("mm",), "mi": ("mi", "miles", "mile"), "ft": ("ft", "feet", "foot"),
        "in": ("in", "inch", "inches"), "nmi": ("nautical miles", "nautical mile", "nmi", "nm"), "yd": ("yd", "yard", "yards"),
    },
    "Temperature": {"°C": ("°c", "celsius"), "°F": ("°f", "fahrenheit"), "K": ("kelvin", "k")},
    "Volume": {
        "L": ("l", "liters", "litres", "liter", "litre"), "mL": ("ml",), "gal": ("gal", "gallons", "gallon"), "qt": ("qt", "quart", "quarts"),
        "pt": ("pt", "pint", "pints"), "fl oz": ("fl oz",), "cup": ("cup", "cups"),
    },
    "Data": {"KB": ("kb",), "MB": ("mb",), "GB": ("gb",), "TB": ("tb",), "PB": ("pb",), "bytes": ("bytes", "byte")},
    "Time": {
        "ms": ("ms", "milliseconds", "millisecond"), "s": ("seconds", "second", "sec", "s"), "min": ("minutes", "minute", "min"),
        "h": ("hours", "hour", "hrs", "hr", "h"),
    },
    "Frequency": {"THz": ("thz",), "GHz": ("ghz",), "MHz": ("mhz",), "kHz": ("khz",), "Hz": ("hz",)},
    "Power": {"TW": ("tw",), "GW": ("gw",), "MW": ("mw",), "kW": ("kw",), "hp": ("hp",), "W": ("w",)},
    "Electrical": {
        "kV": ("kv",), "mV": ("mv",), "V": ("v",), "mA": ("ma",), "A": ("a",), "mAh": ("mah",), "Ah": ("ah",), "µF": ("uf",), "nF": ("nf",),
        "pF": ("pf",), "Ω": ("ohm",), "kΩ": ("kohm",),
    },
    "Pressure": {"mmHg": ("mmhg",), "MPa": ("mpa",), "kPa": ("kpa",), "hPa": ("hpa",), "Pa": ("pa",), "bar": ("bar",), "psi": ("psi",), "atm": ("atm",)},
    "Energy": {"kWh": ("kwh",), "Wh": ("wh",), "kJ": ("kj",), "J": ("j",), "cal": ("cal",), "kcal": ("kcal",), "BTU": ("btu",)},
    "Speed": {"km/h": ("km/h",), "mph": ("mph",), "m/s": ("m/s",), "m/s²": ("m/s²",), "knots": ("knots", "knot", "kn")},
    "Area": {"m²": ("m²",), "km²": ("km²",), "ft²": ("ft²",), "hectare": ("hectare", "hectares"), "acre": ("acre", "acres")},
    "Unknown": {"lux": ("lux",), "dB": ("db",), "ppm": ("ppm",), "mohm": ("mohm",)},
}
UNIT_OF = {text: unit for units in SPELLINGS.values() for unit, texts in units.items() for text in texts}
CATEGORY = {unit: category for category, units in SPELLINGS.items() for unit in units}
#: What a unit is multiplied by, by pair. There are no others: neither chains nor reverses follow from these.
FACTORS = {
    "g kg": 0.001, "kg g": 1000.0, "mg kg": 0.000001, "mg g": 0.001, "g mg": 1000.0, "lb kg": 0.453592, "kg lb": 2.20462, "oz kg": 0.0283495,
    "oz lb": 0.0625, "lb oz": 16.0, "oz g": 28.3495, "g oz": 0.035274, "km m": 1000.0, "m km": 0.001, "cm m": 0.01, "mm m": 0.001, "m cm": 100.0,
    "m mm": 1000.0, "mi km": 1.60934, "km mi": 0.621371, "ft m": 0.3048, "m ft": 3.28084, "in cm": 2.54, "cm in": 0.393701, "in m": 0.0254,
    "ft in": 12.0, "in ft": 1.0 / 12.0, "nmi km": 1.852, "km nmi": 0.539957, "nmi mi": 1.15078, "ml l": 0.001, "l ml": 1000.0, "gal l": 3.78541,
    "l gal": 0.264172, "kb mb": 0.001, "mb kb": 1000.0, "mb gb": 0.001, "gb mb": 1000.0, "gb tb": 0.001, "tb gb": 1000.0, "s min": 1.0 / 60.0,
    "min s": 60.0, "min h": 1.0 / 60.0, "h min": 60.0, "h s": 3600.0, "s h": 1.0 / 3600.0, "ms s": 0.001, "s ms": 1000.0,
}
#: Temperatures as scale and offset.
FORMULAS = {
    "c f": (9.0 / 5.0, 32.0), "f c": (5.0 / 9.0, -32.0 * 5.0 / 9.0), "c k": (1.0, 273.15), "k c": (1.0, -273.15),
    "f k": (5.0 / 9.0, -32.0 * 5.0 / 9.0 + 273.15), "k f": (9.0 / 5.0, -273.15 * 9.0 / 5.0 + 32.0),
}
WORDS = sorted(UNIT_OF, key=len, reverse=True)
TAIL = r"^([\s\S]*[0-9.])\s*([^0-9.]+)$"


def numeric(s: Column) -> Column:
    """The number of an amount's text: plain, European, dots only, or with checked separators."""
    return X.let(s, _numeric)


def _numeric(s: Column) -> Column:
    decimal = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    bare = F.translate(s, ",'_", "")
    grouped = ~X.has(s, ",") | s.rlike(r"^-*[^.,]*(,[0-9]{3})*(\.[^,]*)?$")
    fine = s.rlike("[,'_]") & ~s.rlike(r",,|''|__|^-?[,'_]|[,'_]$") & grouped
    return F.coalesce(
        X.any_float(s),
        F.when(s.rlike(r"\.[^.]*,[^.]*$"), X.any_float(decimal)),
        F.when(s.rlike(r"^[^,]*\.[^,]*\.[^,]*$"), X.any_float(F.replace(s, F.lit("."), F.lit("")))),
        F.when(fine, X.any_float(bare)),
    )


def standard_unit(code: Column) -> Column:
    """The unit of a standard code, whatever its case."""
    return lookup(CODES, F.upper(code))


def _found(amount: Column, unit: Column) -> Column:
    made = lambda x: F.when(x["a"].isNotNull() & x["u"].isNotNull(), F.struct(x["a"].alias("amount"), x["u"].alias("unit"), lookup(CATEGORY, x["u"]).alias("category")))
    return X.let(F.struct(amount.alias("a"), unit.alias("u")), made)


def parse(text: Column) -> Column:
    """STRUCT<amount, unit, category>, NULL if the text isn't a quantity: a code after the last blank, an attached code, a unit at
    the end, or two quantities of which the second is added to the first."""
    return X.let(X.trim(text), lambda t: X.let(F.struct(t.alias("t"), F.replace(F.lower(t), F.lit("º"), F.lit("°")).alias("s")), lambda x: _parse(x["t"], x["s"])))


def _cut(c: Column, pattern: str, *groups: int) -> Column:
    """A pattern's groups as an array, NULL where it doesn't match."""
    return F.when(c.rlike(pattern), F.array(*(F.regexp_extract(c, pattern, i) for i in groups)))


def _parse(t: Column, s: Column) -> Column:
    # A code can only be what is in the table, so the number before it is looked at only then.
    code = lambda p: X.let(standard_unit(X.trim(F.get(p, 1))), lambda u: F.when(u.isNotNull(), _found(numeric(F.lower(X.trim(F.get(p, 0)))), u)))
    spaced, three, two = r"^([\s\S]*) ([^ ]*)$", r"^([\s\S]+)([A-Za-z]{3})$", r"^([\s\S]+)([A-Za-z]{2})$"
    out = [F.when(guard, X.let(_cut(t, pattern, 1, 2), code)) for guard, pattern in ((X.has(t, " "), spaced), (F.lit(True), three), (F.lit(True), two))]
    tail = lambda p: X.let(lookup(UNIT_OF, X.trim(F.get(p, 1))), lambda u: F.when(u.isNotNull(), _found(numeric(X.trim(F.get(p, 0))), u)))
    return F.coalesce(*out, X.let(_cut(s, TAIL, 1, 2), tail), compound(s))


def compound(s: Column) -> Column:
    """`5 ft 11 in`: the second quantity in the first one's unit, added."""
    pattern = r"^([^A-Za-z°]*[0-9.])\s*([^0-9.]+?)\s*([0-9][0-9.]*)\s*([^0-9.]+)$"

    def one(p: Column) -> Column:
        units = F.struct(lookup(UNIT_OF, X.trim(F.get(p, 1))).alias("a"), lookup(UNIT_OF, X.trim(F.get(p, 3))).alias("b"))
        return X.let(units, lambda u: _found(numeric(X.trim(F.get(p, 0))) + X.plain_float(F.get(p, 2)) * factor(u["b"], u["a"]), u["a"]))

    return X.let(_cut(s, pattern, 1, 2, 3, 4), one)


#: Units that the conversion tables know by another name.
TABLE_NAMES = {"°C": "c", "°c": "c", "°F": "f", "°f": "f", "K": "k", "L": "l", "mL": "ml", "KB": "kb", "MB": "mb", "GB": "gb", "TB": "tb", "PB": "pb"}


def _name(unit: Column) -> Column:
    return F.coalesce(lookup(TABLE_NAMES, unit), unit)


def factor(source: Column, target: Column) -> Column:
    """What to multiply by: 1 for the same unit, NULL for unknown pairs and for temperatures."""
    return F.when(_name(source) == _name(target), F.lit(1.0)).otherwise(lookup(FACTORS, F.concat_ws(" ", _name(source), _name(target))))


def convert(amount: Column, source: Column, target: Column) -> Column:
    """The amount in another unit, NULL for unknown pairs; the same unit leaves it as it is."""
    pair = F.concat_ws(" ", _name(source), _name(target))
    scale = F.coalesce(lookup(FACTORS, pair), lookup({k: v[0] for k, v in FORMULAS.items()}, pair))
    offset = F.coalesce(lookup({k: v[1] for k, v in FORMULAS.items()}, pair), F.lit(0.0))
    return F.when(_name(source) == _name(target), amount).otherwise(amount * scale + offset)


def coerce_unit(value: Column) -> Column:
    """STRUCT<value, coerced, diag> of a JSON value: a text with a quantity becomes its number."""

    def one(p: Column) -> Column:
        told = diagnostic("coerced", F.concat(F.lit("unit "), p["unit"]), "f64", WARNING, "store amounts as numbers, units apart")
        return F.when(p["amount"].isNotNull(), F.struct(p["amount"].alias("value"), F.lit(True).alias("coerced"), told.alias("diag")))

    return X.let(parse(V.string(value)), one)


def _count(c: Column) -> Column:
    return F.when(X.trim(c).rlike(r"^\+?[0-9]{1,18}$"), X.trim(c).try_cast("bigint"))


#: Words for a number of units.
PACK_WORDS = {"each": 1, "ea": 1, "dozen": 12, "dz": 12, "gross": 144, "hundred": 100}


def parse_pack(text: Column) -> Column:
    """STRUCT<total_units, packs, per_pack>, NULL if the text isn't a pack size."""

    def parts(s: Column) -> Column:
        # The first x parts a multiplier from a count or a quantity; `0x` before a hexadecimal digit is a number.
        rest = X.group(s, r"^([^x]*)x([\s\S]*)$", 2)
        single = F.coalesce(
            _count(X.group(s, r"^(?:case|pack|box|carton|bag) of ([\s\S]*)$", 1)),
            _count(X.group(s, r"^([\s\S]*?)-?ct$", 1)),
            _count(F.when(s.rlike("[- ]pack"), F.replace(F.replace(s, F.lit("-pack"), F.lit("")), F.lit(" pack"), F.lit("")))),
            _count(X.group(s, r"^pk[/ ]([\s\S]*)$", 1)),
        )
        return F.struct(
            lookup(PACK_WORDS, s).cast("bigint").alias("word"),
            _count(F.when(~s.rlike("^0x[0-9a-f]"), X.group(s, r"^([^x]*)x([\s\S]*)$", 1))).alias("times"),
            _count(F.replace(F.replace(rest, F.lit("-count"), F.lit("")), F.lit("count"), F.lit(""))).alias("number"),
            parse(rest).alias("each"),
            single.alias("single"),
        )

    def one(x: Column) -> Column:
        none = F.lit(None)
        size = lambda total, packs=none, per=none: F.struct(total.cast("bigint").alias("total_units"), packs.cast("bigint").alias("packs"), per.cast("struct<amount:double,unit:string,category:string>").alias("per_pack"))
        whole = F.when(x["each"]["amount"] >= 0, F.floor(x["each"]["amount"])).otherwise(0)
        return (
            F.when(x["word"].isNotNull(), size(x["word"]))
            .when(x["times"].isNotNull() & x["number"].isNotNull(), size(x["times"] * x["number"], x["times"]))
            .when(x["times"].isNotNull() & x["each"].isNotNull(), size(x["times"] * whole, x["times"], x["each"]))
            .when(x["single"].isNotNull(), size(x["single"]))
        )

    return X.let(F.lower(X.trim(text)), lambda s: X.let(parts(s), one))


def parse_weight(text: Column) -> Column:
    """STRUCT<amount, unit, qualifier> of a weight said to be net, gross or tare, or neither."""

    def one(s: Column) -> Column:
        qualifier = (
            F.when(s.rlike(r"^(net wt|net weight|n\.w\.|nw:)"), "Net")
            .when(s.rlike(r"^(gross wt|gross weight|g\.w\.|gw:)"), "Gross")
            .when(s.rlike(r"^(tare|t\.w\.|tw:)"), "Tare")
            .otherwise("Unspecified")
        )
        bare = F.regexp_replace(s, r"^(net weight|net wt|gross weight|gross wt|tare weight|tare|n\.w\.|g\.w\.|t\.w\.|nw:|gw:|tw:)+:*\.*", "")
        quantity = parse(F.when(qualifier == "Unspecified", s).otherwise(X.trim(bare)))
        return X.let(quantity, lambda p: F.when(p["category"] == "Weight", F.struct(p["amount"].alias("amount"), p["unit"].alias("unit"), qualifier.alias("qualifier"))))

    return X.let(F.lower(X.trim(text)), one)


def _to_base(text: Column, base: str) -> Column:
    return X.let(parse(text), lambda p: convert(p["amount"], p["unit"], F.lit(base)))


def to_mass(text: Column) -> Column:
    """Kilograms of a quantity."""
    return _to_base(text, "kg")


def to_length(text: Column) -> Column:
    """Metres of a quantity."""
    return _to_base(text, "m")


def to_temperature(text: Column) -> Column:
    """Degrees Celsius of a quantity."""
    return _to_base(text, "c")
