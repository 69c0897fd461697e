"""What the training-data operators share: Arrow column appending, the shared folder, table access."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import ship

#: Bytes of one Arrow slice that a compute function sees at once.
SLICE_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of about `limit` bytes, one row at least."""
    rows = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def release() -> None:
    """Gives the memory that this worker has freed back to the system: allocators keep what was the peak, and a worker lives on."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's; Arrow's system pool doesn't call it
        trim(0)


def append_columns(
    df: DataFrame,
    fields: str,
    compute: Callable[[pa.RecordBatch], list[pa.Array]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """`df` with the columns of DDL `fields`, computed slice by slice in Arrow.

    A column of `df` whose name (whatever its case) is among the new ones is replaced, as withColumn does; those of `drop`
    are passed to `compute` but not returned. Rows are neither added nor removed.
    """
    new = T.StructType.fromDDL(fields)
    gone = {f.name.lower() for f in new} | {d.lower() for d in drop}
    kept = [f for f in df.schema if f.name.lower() not in gone]
    schema = T.StructType([*kept, *new])
    names, keep = schema.names, [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *compute(part)], names=names)

    return df.mapInArrow(run, schema)


def texts(part: pa.RecordBatch, name: str = "text") -> list[str]:
    """The strings of a column; null is empty."""
    return [x or "" for x in part.column(name).to_pylist()]


_own: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder. Where neither is set a local
    session gets one of its own; a cluster gets an error, as a folder of the driver's machine is another one on each executor."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="quern-shared-"))
    return _own[0]


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended already; the folder is then the cluster's to clean
        pass


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession() if _written else None
    while spark and _written:
        delete(spark, _written.pop())


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted at the end of the session or of the `settled` that it is taken in."""
    _written.append(f"{shared_dir(spark)}/quern-{tag}-{uuid.uuid4().hex}")
    return _written[-1]


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: lineage ends there, whatever executors are lost."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What `make` returns, materialised; the tables that were written on the way to it are deleted."""
    before = len(_written)
    out = materialise(make(), tag)
    for path in _written[before:-1]:
        delete(out.sparkSession, path)
    del _written[before:-1]
    return out


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def hex_unit(value: Column, salt: str) -> Column:
    """A number in [0, 1) from the md5 of a salted value, the same in every run."""
    text = F.concat(F.lit(salt + ":"), F.coalesce(value.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)
