"""Databases as row sources: SQLite through a Python data source, PostgreSQL and MySQL through JDBC, Spark's own tables."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.errors import ConnectionFailed, QueryFailed
from quern.functions.merge import dumps
from quern.session import ship


class RowSource(Protocol):
    """Rows of a query as a DataFrame with one VARIANT column `doc`; columns by name; a count."""

    def query(self, sql: str) -> DataFrame: ...

    def query_with(self, sql: str, params: list[Any]) -> DataFrame: ...

    def columns(self, sql: str) -> list[str]: ...

    def count(self, sql: str) -> int: ...


def json_value(value: Any) -> Any:
    """A database value as JSON: numbers and booleans stay, text that looks like an object or array is parsed, blobs are text."""
    if isinstance(value, str) and value[:1] + value[-1:] in ("{}", "[]"):
        try:
            return json.loads(value)
        except ValueError:
            return value
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    return value


class _Part(InputPartition):
    pass


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Part(0)]  # a file has one reader

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Rows in batches as they come, never all at once."""
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as connection:
            found = connection.execute(self.options["query"], json.loads(self.options.get("params", "[]")))
            names = [d[0] for d in found.description]
            while rows := found.fetchmany(1000):
                for row in rows:
                    yield (dumps({n: json_value(v) for n, v in zip(names, row, strict=True)}),)


class SqliteDataSource(DataSource):
    """format("quern_sqlite"): options path, query and params (a JSON array); one column `value` of JSON texts."""

    @classmethod
    def name(cls) -> str:
        return "quern_sqlite"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("value", T.StringType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options)


class SqliteSource:
    """A database file that every executor can open."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        ship(spark)
        spark.dataSource.register(SqliteDataSource)
        try:
            sqlite3.connect(f"file:{path}?mode=ro", uri=True).close()
        except sqlite3.Error as e:
            raise ConnectionFailed(str(e)) from e

    def _one(self, sql: str, params: list[Any]) -> sqlite3.Cursor:
        try:
            return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True).execute(sql, params)
        except sqlite3.Error as e:
            raise QueryFailed(str(e)) from e

    def query(self, sql: str) -> DataFrame:
        return self.query_with(sql, [])

    def query_with(self, sql: str, params: list[Any]) -> DataFrame:
        """Parameters are bound by the driver, never written into the text; objects and arrays are bound as JSON text."""
        bound = [dumps(p) if isinstance(p, dict | list) else p for p in params]
        self._one(f"SELECT * FROM ({sql}) LIMIT 0", bound)
        read = self.spark.read.format("quern_sqlite").options(path=self.path, query=sql, params=json.dumps(bound)).load()
        return read.select(F.parse_json("value").alias("doc"))

    def columns(self, sql: str) -> list[str]:
        return [d[0] for d in self._one(f"SELECT * FROM ({sql}) LIMIT 0", []).description]

    def count(self, sql: str) -> int:
        return self._one(f"SELECT COUNT(*) FROM ({sql})", []).fetchone()[0]


def as_values(df: DataFrame, json_columns: tuple[str, ...] = ()) -> DataFrame:
    """JDBC rows as values: decimals and times become text, JSON columns are parsed, other types stay."""
    parts = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.name in json_columns:
            c = F.coalesce(F.try_parse_json(c), F.try_variant_get(F.to_variant_object(F.array(c)), "$[0]", "variant"))
        elif isinstance(f.dataType, T.DecimalType | T.DateType | T.TimestampType | T.TimestampNTZType | T.BinaryType):
            c = c.cast("string")
        parts.append(c.alias(f.name))
    return df.select(F.to_variant_object(F.struct(*parts)).alias("doc"))


class JdbcSource:
    """A database behind a JDBC driver that is on the classpath. `connections` bounds the tasks that read at once."""

    driver, prefix, alias = "", "", "_q"

    def __init__(self, spark: SparkSession, url: str, connections: int = 5, json_columns: tuple[str, ...] = (), **options: str):
        self.spark, self.json_columns = spark, json_columns
        self.options = {"url": url, "driver": self.driver, "numPartitions": str(connections), "fetchsize": "1000", "pushDownAggregate": "true"} | options

    def _load(self, sql: str) -> DataFrame:
        try:
            return self.spark.read.format("jdbc").options(**self.options).option("query", sql).load()
        except Exception as e:
            raise (ConnectionFailed if "onnect" in str(e) or "river" in str(e) else QueryFailed)(str(e)) from e

    def query(self, sql: str) -> DataFrame:
        return as_values(self._load(sql), self.json_columns)

    def query_with(self, sql: str, params: list[Any]) -> DataFrame:
        """JDBC relations can't bind parameters: read a table with `query` and filter it by `SparkSource.query_with`."""
        if params:
            raise QueryFailed("parameters aren't written into SQL text; register the table and use SparkSource")
        return self.query(sql)

    def columns(self, sql: str) -> list[str]:
        return self._load(f"SELECT * FROM ({sql}) AS {self.alias} WHERE 1 = 0").columns

    def count(self, sql: str) -> int:
        return int(self._load(f"SELECT COUNT(*) AS n FROM ({sql}) AS {self.alias}").first()["n"])


class PostgresSource(JdbcSource):
    driver, alias = "org.postgresql.Driver", "_count"


class MysqlSource(JdbcSource):
    """Single-bit integers are booleans, as the driver's own default has it."""

    driver, alias = "com.mysql.cj.jdbc.Driver", "_count"


class SparkSource:
    """Tables and views of the session, with bound parameters."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def query(self, sql: str) -> DataFrame:
        return self.query_with(sql, [])

    def query_with(self, sql: str, params: list[Any]) -> DataFrame:
        bound = [dumps(p) if isinstance(p, dict | list) else p for p in params]
        return as_values(self.spark.sql(sql, args=bound) if bound else self.spark.sql(sql))

    def columns(self, sql: str) -> list[str]:
        return self.spark.sql(sql).columns

    def count(self, sql: str) -> int:
        return self.spark.sql(sql).count()
