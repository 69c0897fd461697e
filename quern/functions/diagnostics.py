"""Diagnostics: what was changed, defaulted, dropped, kept or overridden, and how risky that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFO, WARNING, RISKY = 0, 1, 2
RISKS = ("info", "warning", "risky")
KINDS = ("coerced", "defaulted", "dropped", "preserved", "error_defaulted", "overridden")
TYPE = "struct<kind:string,a:string,b:string,risk:int,suggestion:string>"
STOP_REASONS = ("end_turn", "tool_use", "max_tokens", "stop_sequence", "unknown")


def _text(x: Column | str | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("string")


def diagnostic(kind: str, a: Column | str | None, b: Column | str | None, risk: Column | int, suggestion: str | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), _text(a).alias("a"), _text(b).alias("b"), (risk if isinstance(risk, Column) else F.lit(risk)).cast("int").alias("risk"), _text(suggestion).alias("suggestion")).cast(TYPE)


def none() -> Column:
    return F.lit(None).cast(TYPE)


def kind_text(d: Column) -> Column:
    k, a, b = d["kind"], d["a"], d["b"]
    return (
        F.when(k == "coerced", F.concat(F.lit("coerced "), a, F.lit(" → "), b))
        .when(k == "defaulted", F.concat(F.lit("defaulted "), a))
        .when(k == "dropped", F.concat(F.lit("dropped unknown field '"), a, F.lit("'")))
        .when(k == "preserved", F.concat(F.lit("preserved unknown field '"), a, F.lit("' in overflow")))
        .when(k == "error_defaulted", F.concat(F.lit("coercion failed for '"), a, F.lit("', using default: "), b))
        .when(k == "overridden", F.concat(F.lit("overridden "), a, F.lit(" → "), b))
    )


def risk_text(risk: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RISKS)), risk + 1)


def display(d: Column, path: Column | str) -> Column:
    """`[risk] at 'path': what — suggestion`."""
    head = F.concat(F.lit("["), risk_text(d["risk"]), F.lit("] at '"), _text(path), F.lit("': "), kind_text(d))
    return F.concat(head, F.coalesce(F.concat(F.lit(" — "), d["suggestion"]), F.lit("")))


def rows(df: DataFrame, diagnostics: str = "_diag", at_least: int = INFO) -> DataFrame:
    """A row for each diagnostic of risk `at_least` in an array column, beside the other columns: what sinks are fed with."""
    out = df.select(*[c for c in df.columns if c != diagnostics], F.explode(diagnostics).alias("diag"))
    return out.where(F.col("diag.risk") >= at_least)


def to_sinks(stream: DataFrame, *sinks, diagnostics: str = "_diag", at_least: int = INFO):
    """A streaming writer that hands each batch's diagnostics, one a row, to every sink: functions of a DataFrame."""

    def batch(df: DataFrame, _: int) -> None:
        found = rows(df, diagnostics, at_least)
        for sink in sinks:
            sink(found)

    return stream.writeStream.foreachBatch(batch)


def show(df: DataFrame, diagnostics: str = "_diag", most: int = 100) -> None:
    """Prints the first diagnostics to the driver's standard error."""
    import sys

    found = rows(df, diagnostics)
    for r in found.select(display(F.col("diag"), F.lit("")).alias("text")).limit(most).collect():
        print(r["text"], file=sys.stderr)
