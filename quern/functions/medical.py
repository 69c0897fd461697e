"""Clinical values: laboratory units and ranges, body measures, pharmacy words, HL7 segments, FHIR observations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.dates import parse_hl7 as parse_hl7_datetime  # noqa: F401
from quern.functions.lookup import lookup
from quern.functions.text import let

#: Analyte, other names, US unit, SI unit, factor from US to SI.
ANALYTES = """
glucose | blood sugar, glu, blood glucose, fasting glucose, fbg | mg/dL | mmol/L | 0.0555
sodium | na, na+ | mEq/L | mmol/L | 1.0
potassium | k, k+ | mEq/L | mmol/L | 1.0
chloride | cl, cl- | mEq/L | mmol/L | 1.0
bicarbonate | hco3, co2, total co2 | mEq/L | mmol/L | 1.0
bun | blood urea nitrogen, urea nitrogen, urea | mg/dL | mmol/L | 0.357
creatinine | creat, cr, scr | mg/dL | µmol/L | 88.4
calcium | ca, ca++, total calcium | mg/dL | mmol/L | 0.25
cholesterol | total cholesterol, chol, tc | mg/dL | mmol/L | 0.02586
hdl | hdl cholesterol, hdl-c | mg/dL | mmol/L | 0.02586
ldl | ldl cholesterol, ldl-c | mg/dL | mmol/L | 0.02586
triglycerides | trig, tg | mg/dL | mmol/L | 0.01129
hemoglobin | hgb, hb | g/dL | g/L | 10.0
hematocrit | hct | % | L/L | 0.01
wbc | white blood cells, leukocytes | K/µL | ×10⁹/L | 1.0
platelets | plt | K/µL | ×10⁹/L | 1.0
alt | sgpt, alanine aminotransferase | U/L | µkat/L | 0.0167
ast | sgot, aspartate aminotransferase | U/L | µkat/L | 0.016667
alp | alkaline phosphatase, alk phos | U/L | µkat/L | 0.0167
ggt | gamma-gt, gamma glutamyl transferase | U/L | µkat/L | 0.0167
ldh | lactate dehydrogenase | U/L | µkat/L | 0.0167
bilirubin | bili, total bilirubin, tbili | mg/dL | µmol/L | 17.1
albumin | alb | g/dL | g/L | 10.0
total protein | tp, protein | g/dL | g/L | 10.0
tsh | thyroid stimulating hormone, thyrotropin | µIU/mL | mIU/L | 1.0
free t4 | ft4, free thyroxine | ng/dL | pmol/L | 12.87
free t3 | ft3, free triiodothyronine | pg/mL | pmol/L | 1.536
hba1c | a1c, hemoglobin a1c, glycated hemoglobin | % | mmol/mol | 10.93
crp | c-reactive protein, hs-crp | mg/L | nmol/L | 9.524
iron | serum iron, fe | µg/dL | µmol/L | 0.179
ferritin | | ng/mL | µg/L | 1.0
tibc | total iron binding capacity | µg/dL | µmol/L | 0.179
vitamin d | 25-oh vitamin d, 25-hydroxyvitamin d, calcidiol | ng/mL | nmol/L | 2.496
vitamin b12 | b12, cobalamin | pg/mL | pmol/L | 0.738
folate | folic acid, vitamin b9 | ng/mL | nmol/L | 2.266
uric acid | urate, ua | mg/dL | µmol/L | 59.48
phosphorus | phosphate, phos | mg/dL | mmol/L | 0.323
magnesium | mg++ | mg/dL | mmol/L | 0.411
troponin i | tni, hs-tni, troponin | ng/mL | µg/L | 1.0
bnp | b-type natriuretic peptide | pg/mL | ng/L | 1.0
nt-probnp | n-terminal pro-bnp | pg/mL | ng/L | 1.0
psa | prostate specific antigen | ng/mL | µg/L | 1.0
cortisol | serum cortisol | µg/dL | nmol/L | 27.59
testosterone | total testosterone | ng/dL | nmol/L | 0.0347
"""
#: Analyte, unit, low, high, critical low, critical high, context.
RANGES = """
glucose | mg/dL | 70 | 100 | 40 | 400 | adult_fasting
glucose | mmol/L | 3.9 | 5.6 | 2.2 | 22.2 | adult_fasting
sodium | mEq/L | 136 | 145 | 120 | 160 | adult
potassium | mEq/L | 3.5 | 5.0 | 2.5 | 6.5 | adult
chloride | mEq/L | 98 | 106 | | | adult
bicarbonate | mEq/L | 22 | 29 | 10 | 40 | adult
bun | mg/dL | 7 | 20 | | 100 | adult
creatinine | mg/dL | 0.7 | 1.3 | | 10 | adult
calcium | mg/dL | 8.5 | 10.5 | 6 | 13 | adult
cholesterol | mg/dL | 0 | 200 | | | adult_desirable
hdl | mg/dL | 40 | 60 | | | adult
ldl | mg/dL | 0 | 100 | | | adult_optimal
triglycerides | mg/dL | 0 | 150 | | 500 | adult
hemoglobin | g/dL | 12 | 17.5 | 7 | 20 | adult
hematocrit | % | 36 | 51 | 20 | 60 | adult
wbc | K/µL | 4.5 | 11 | 2 | 30 | adult
platelets | K/µL | 150 | 400 | 50 | 1000 | adult
alt | U/L | 7 | 56 | | | adult
ast | U/L | 10 | 40 | | | adult
alp | U/L | 44 | 147 | | | adult
bilirubin | mg/dL | 0.1 | 1.2 | | 15 | adult
albumin | g/dL | 3.5 | 5.5 | 1.5 | | adult
tsh | µIU/mL | 0.4 | 4.0 | 0.01 | 100 | adult
free t4 | ng/dL | 0.8 | 1.8 | | | adult
hba1c | % | 4.0 | 5.6 | | 14 | adult
crp | mg/L | 0 | 3 | | | adult
iron | µg/dL | 60 | 170 | | | adult
ferritin | ng/mL | 12 | 300 | | 1000 | adult
vitamin d | ng/mL | 30 | 100 | 10 | 150 | adult
vitamin b12 | pg/mL | 200 | 900 | 100 | | adult
psa | ng/mL | 0 | 4 | | 100 | adult_male
cortisol | µg/dL | 6 | 18 | | 60 | adult_morning
uric acid | mg/dL | 3 | 7 | | 12 | adult
"""
#: What pharmacy units are written as.
PHARMA_UNITS = {
    "mcg": "µg", "ug": "µg", "microgram": "µg", "micrograms": "µg", "µg": "µg", "cc": "mL", "iu": "IU", "i.u.": "IU", "mg": "mg", "ml": "mL", "g": "g",
    "gram": "g", "grams": "g", "l": "L", "liter": "L", "litre": "L", "meq": "mEq", "units": "units", "unit": "units",
}
#: Pharmacy abbreviations of routes, times and forms.
ABBREVIATIONS = {
    "oral": "PO", "intravenous": "IV", "intramuscular": "IM", "subcutaneous": "SQ SC SUBQ SUB-Q", "rectal": "PR", "sublingual": "SL",
    "topical": "TOP TOPICAL", "inhaled": "INH", "right eye": "OD", "left eye": "OS", "both eyes": "OU", "nasogastric tube": "GT NGT", "nasal": "NAS",
    "vaginal": "VAG", "transdermal": "TD TRANSDERMAL", "once daily": "QD DAILY", "twice daily": "BID", "three times daily": "TID",
    "four times daily": "QID", "every 4 hours": "Q4H", "every 6 hours": "Q6H", "every 8 hours": "Q8H", "every 12 hours": "Q12H", "at bedtime": "QHS HS",
    "every morning": "QAM", "every evening": "QPM", "as needed": "PRN", "immediately": "STAT", "every other day": "QOD", "once weekly": "QW WEEKLY",
    "twice weekly": "BIW", "before meals": "AC", "after meals": "PC", "tablet": "TAB TABS", "capsule": "CAP CAPS", "suspension": "SUSP",
    "solution": "SOLN SOL", "injection": "INJ", "suppository": "SUPP", "extended-release": "CR ER XR XL SR LA", "delayed-release": "DR EC",
    "orally disintegrating tablet": "ODT", "metered-dose inhaler": "MDI", "dry powder inhaler": "DPI", "drops": "GTT GTTS", "ampule": "AMP",
    "elixir": "ELIX", "ointment": "OINT", "lotion": "LOT",
}


def _rows(table: str) -> list[list[str]]:
    return [[x.strip() for x in line.split("|")] for line in table.strip().splitlines()]


CANONICAL = {name: row[0] for row in _rows(ANALYTES) for name in [row[0], *filter(None, (x.strip() for x in row[1].split(",")))]}
US, SI = ({row[0]: row[i].lower() for row in _rows(ANALYTES)} for i in (2, 3))
FACTOR = {row[0]: float(row[4]) for row in _rows(ANALYTES)}


def known_analytes() -> list[str]:
    return list(CANONICAL)


def canonical(analyte: Column, aliases: dict[str, str] | None = None, case_insensitive: bool = True) -> Column:
    """The analyte's own name; `aliases` are the user's names for known ones."""
    name = F.lower(analyte) if case_insensitive else analyte
    return lookup(CANONICAL, F.coalesce(lookup(aliases, name), name) if aliases else name)


def convert_lab(value: Column, analyte: Column, source: Column, target: Column, aliases: dict[str, str] | None = None, case_insensitive: bool = True) -> Column:
    """A laboratory value in its other unit; NULL for unknown analytes and pairs. The same unit leaves it as it is.

    HbA1c isn't proportional: its line holds for all of its names.
    """

    def one(x: Column) -> Column:
        us, si, a, s, t = lookup(US, x["a"]), lookup(SI, x["a"]), x["a"], x["s"], x["t"]
        to_si, to_us = (s == us) & (t == si), (s == si) & (t == us)
        return (
            F.when(a.isNull(), F.lit(None).cast("double"))
            .when(s == t, value)
            .when((a == "hba1c") & to_si, (value - 2.15) * 10.929)
            .when((a == "hba1c") & to_us, value / 10.929 + 2.15)
            .when(to_si, value * lookup(FACTOR, a))
            .when(to_us, value / lookup(FACTOR, a))
        )

    return let(F.struct(canonical(analyte, aliases, case_insensitive).alias("a"), F.lower(source).alias("s"), F.lower(target).alias("t")), one)


def reference_range(analyte: Column, unit: Column) -> Column:
    """STRUCT<low, high, critical_low, critical_high, context> of an analyte in a unit, NULL if there is none."""
    key = F.concat_ws("|", F.coalesce(canonical(analyte), F.lower(analyte)), F.lower(unit))
    tables = [{f"{r[0]}|{r[1].lower()}": float(r[i]) for r in _rows(RANGES) if r[i]} for i in (2, 3, 4, 5)]
    context = {f"{r[0]}|{r[1].lower()}": r[6] for r in _rows(RANGES)}

    def one(k: Column) -> Column:
        low, high, worst, best = (lookup(t, k) for t in tables)
        made = F.struct(low.alias("low"), high.alias("high"), worst.alias("critical_low"), best.alias("critical_high"), lookup(context, k).alias("context"))
        return F.when(low.isNotNull(), made)

    return let(key, one)


def classify_lab(value: Column, analyte: Column, unit: Column) -> Column:
    """CriticalLow, CriticalHigh, Low, High or Normal; NULL without a range. Bounds are normal."""
    return let(
        reference_range(analyte, unit),
        lambda r: F.when(r.isNull(), F.lit(None).cast("string"))
        .when(value < r["critical_low"], "CriticalLow")
        .when(value > r["critical_high"], "CriticalHigh")
        .when(value < r["low"], "Low")
        .when(value > r["high"], "High")
        .otherwise("Normal"),
    )


def bmi(kilograms: Column, metres: Column) -> Column:
    return F.when(metres <= 0, 0.0).otherwise(kilograms / F.nullif(metres * metres, F.lit(0.0)))


def bmi_class(value: Column) -> Column:
    out = F.lit("obese class III")
    for below, name in ((40.0, "obese class II"), (35.0, "obese class I"), (30.0, "overweight"), (25.0, "normal"), (18.5, "mild thinness"), (17.0, "moderate thinness"), (16.0, "severe thinness")):
        out = F.when(value < below, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def bsa(kilograms: Column, centimetres: Column) -> Column:
    """Body surface by Du Bois."""
    return 0.007184 * F.pow(kilograms, F.lit(0.425)) * F.pow(centimetres, F.lit(0.725))


def egfr(creatinine: Column, age: Column, female: Column) -> Column:
    """Filtration rate by CKD-EPI 2021."""
    ratio = creatinine / F.when(female, 0.7).otherwise(0.9)
    low = F.pow(F.least(ratio, F.lit(1.0)), F.when(female, -0.241).otherwise(-0.302))
    return 142.0 * low * F.pow(F.greatest(ratio, F.lit(1.0)), F.lit(-1.2)) * F.pow(F.lit(0.9938), age.cast("double")) * F.when(female, 1.012).otherwise(1.0)


def corrected_calcium(calcium: Column, albumin: Column) -> Column:
    return calcium + 0.8 * (4.0 - albumin)


def anion_gap(sodium: Column, chloride: Column, bicarbonate: Column) -> Column:
    return sodium - (chloride + bicarbonate)


def creatinine_clearance(creatinine: Column, age: Column, kilograms: Column, female: Column) -> Column:
    """Clearance by Cockcroft and Gault; 0 without creatinine."""
    amount = (140.0 - age.cast("double")) * kilograms * F.when(female, 0.85).otherwise(1.0)
    return F.when(creatinine <= 0, 0.0).otherwise(amount / F.nullif(72.0 * creatinine, F.lit(0.0)))


def pharma_unit(unit: Column) -> Column:
    """The usual text of a pharmacy unit; unknown ones keep theirs."""
    return let(F.replace(unit, F.lit("μ"), F.lit("µ")), lambda u: F.coalesce(lookup(PHARMA_UNITS, F.lower(u)), u))


def pharma_abbreviation(text: Column) -> Column:
    return lookup({short: name for name, shorts in ABBREVIATIONS.items() for short in shorts.split()}, F.upper(text))


def hl7_segment(text: Column) -> Column:
    """ARRAY<ARRAY<STRING>>: fields, then components."""
    return F.transform(F.split(text, r"\|", -1), lambda field: F.split(field, r"\^", -1))


def fhir_observation(value: Column) -> Column:
    """STRUCT of an observation's code, display, value, unit, value_string, reference range, status and time; NULL without a code."""
    text = lambda v, path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    number = lambda v, path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, path, "double"))
    code = F.try_variant_get(value, "$.code", "variant")
    made = F.struct(
        F.coalesce(text(value, "$.code.coding[0].code"), F.lit("")).alias("code"),
        F.coalesce(text(value, "$.code.coding[0].display"), text(value, "$.code.text"), F.lit("")).alias("display"),
        number(value, "$.valueQuantity.value").alias("value"),
        F.when(F.try_variant_get(value, "$.valueQuantity.unit", "variant").isNotNull(), text(value, "$.valueQuantity.unit")).otherwise(text(value, "$.valueQuantity.code")).alias("unit"),
        text(value, "$.valueString").alias("value_string"),
        number(value, "$.referenceRange[0].low.value").alias("reference_low"),
        number(value, "$.referenceRange[0].high.value").alias("reference_high"),
        F.coalesce(text(value, "$.status"), F.lit("unknown")).alias("status"),
        text(value, "$.effectiveDateTime").alias("effective_datetime"),
    )
    return F.when(code.isNotNull(), made)
