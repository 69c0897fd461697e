"""Command line: infer, audit, inspect."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import QuernError
from quern.functions import variants as V
from quern.functions.coerce import extract
from quern.operators import schema as S
from quern.session import session
from quern.sources.files import read_json_rows

TARGETS = {"string": "string", "number": "i64", "int": "i64", "i64": "i64", "float": "f64", "f64": "f64", "bool": "bool"}


def read_source(spark: SparkSession, source: str) -> DataFrame:
    """row_idx, doc of a file, or of standard input for `-`."""
    if source != "-":
        return read_json_rows(spark, source, single=True)
    value = json.loads(sys.stdin.read())
    if not isinstance(value, list | dict):
        raise QuernError("expected an array of rows or an object")
    rows = value if isinstance(value, list) else [value]
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "row_idx long, text string").select("row_idx", V.from_json(F.col("text"), True).alias("doc"))


def constraints(path: str) -> dict[str, S.Constraint]:
    with open(path) as f:
        fields = json.load(f).get("fields", {})
    out = {}
    for name, d in fields.items():
        required = d.get("required") is True
        nullable = d["nullable"] if isinstance(d.get("nullable"), bool) else not required
        kind = S.parse_type(d["type"]) if isinstance(d.get("type"), str) else None
        out[name] = S.Constraint(kind, required, nullable, d.get("max_length"))
    return out


def infer(spark: SparkSession, source: str, threshold: float, form: str) -> str:
    found = S.infer(read_source(spark, source), S.InferenceConfig(threshold), samples=form == "json")
    if form == "json":
        return json.dumps(found.as_dict(), indent=2, ensure_ascii=False)
    return f"Schema inferred from {found.total} records:\n\n{found.summary()}"


def audit(spark: SparkSession, source: str, schema: str | None, threshold: float, verbose: bool) -> str:
    rows = read_source(spark, source).cache()
    found = S.infer(rows, S.InferenceConfig(threshold), samples=False)
    if schema:
        found = found.with_constraints(constraints(schema))
    report = S.audit(rows, found)
    text = report.summary()
    if verbose:
        shown = report.violations.orderBy("row_idx", "field").select(S.display(*(F.col(c) for c in ("row_idx", "field", "kind", "expected", "actual"))).alias("t"))
        text += "\n\n" + "\n".join(f"  {r['t']}" for r in shown.toLocalIterator())
    rows.unpersist()
    return text


def inspect(spark: SparkSession, source: str, path: str | None, kind: str | None) -> str:
    text = sys.stdin.read() if source == "-" else "\n".join(r[0] for r in spark.read.text(source, wholetext=True).collect())
    doc = spark.createDataFrame([(text,)], "t string").select(V.from_json(F.col("t"), True).alias("doc"))
    walked = doc.select(V.walk(F.col("doc"), path or "").alias("w")).select("w.status", V.pretty(F.col("w.value")).alias("text")).first()
    if walked["status"] != "ok":
        raise QuernError(f"Path error: {walked['status']}")
    if kind not in TARGETS:
        return walked["text"]
    found = doc.select(extract(F.col("doc"), path or "", TARGETS[kind]).alias("x")).select("x.*").first()
    if found["status"] != "ok":
        raise QuernError(f"Extract error: {found['status']}")
    return str(found["value"]).lower() if kind == "bool" else str(found["value"])


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quern")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("infer", "audit", "inspect"):
        sub = commands.add_parser(name)
        sub.add_argument("-s", "--source", required=True, help="a JSON file, or - for standard input")
        if name != "inspect":
            sub.add_argument("--required-threshold", type=float, default=1.0)
        if name == "infer":
            sub.add_argument("-f", "--format", choices=("table", "json"), default="table")
        if name == "audit":
            sub.add_argument("--schema")
            sub.add_argument("-v", "--verbose", action="store_true")
        if name == "inspect":
            sub.add_argument("-p", "--path")
            sub.add_argument("-t", "--as-type")
    o = parser.parse_args(args)
    spark = session("quern-cli")
    try:
        if o.command == "infer":
            print(infer(spark, o.source, o.required_threshold, o.format))
        elif o.command == "audit":
            print(audit(spark, o.source, o.schema, o.required_threshold, o.verbose))
        else:
            print(inspect(spark, o.source, o.path, o.as_type))
    except (QuernError, ValueError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
