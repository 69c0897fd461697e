"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What every session needs for the semantics of the operators: UTC, ANSI, duplicate JSON keys (the last wins).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
}

#: A table with fewer bytes a core than this is dealt out to all cores.
SMALL = 16 << 20

_shipped: set[str] = set()


def session(name: str = "quern", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; dots in further names are written as two underscores."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python workers, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(suffix=".zip", prefix="quern-")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, str(p.relative_to(root.parent)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """`df` on all cores, for expressions that cost far more than a read. Small files are often one row group and so one task, whatever their
    number of splits; a table beyond SMALL bytes a core has splits enough and is returned as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL * cores else df
