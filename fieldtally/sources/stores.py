"""Typed stores: Parquet folders by flight and modality, and SQLite stores through a data source."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import TABLES, VERSION
from .scratch import spread


def write_table(df: DataFrame, root: str, table: str) -> None:
    """Replace the partitions (flight_id, modality) that ``df`` has; others stay. Extra columns are refused."""
    wanted = [f.split()[0] for f in TABLES[table].split(", ")]
    if extra := set(df.columns) - {*wanted, "flight_id", "modality"}:
        raise ValueError(f"{table} has no columns {sorted(extra)}")
    # one task writes all of a partition, so that files don't grow with the tasks times the partitions
    out = df.withColumn("schema_version", F.lit(VERSION)).repartition(spread(df.sparkSession), "flight_id", "modality")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("flight_id", "modality").parquet(f"{root}/{table}")


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A stored table in its declared types; newer versions are refused when read."""
    schema = f"{TABLES[table]}, schema_version int, flight_id long, modality string"
    df = spark.read.schema(schema).parquet(f"{root}/{table}")
    newer = F.raise_error(F.lit(f"{table} was written by a newer version"))
    return df.where(F.when(F.col("schema_version") > VERSION, newer.cast("boolean")).otherwise(F.lit(True))).drop("schema_version")


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, failing when read if a key repeats."""
    bad = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.where(F.when(bad > 0, F.raise_error(F.lit(f"repeated {keys}")).cast("boolean")).otherwise(F.lit(True)))


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], parts: int):
        self.path, self.table, self.columns, self.parts = path, table, columns, parts

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[_Rows]:
        with self._open() as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Rows(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with self._open() as c:
            yield from c.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.first, partition.last))


class SqliteStore(DataSource):
    """``spark.read.format("survey_store").option("table", t).load(path)``: a table of a SQLite or GeoPackage file, by ranges of row ids."""

    #: SQLite's declared types.
    KINDS = {"INTEGER": "long", "REAL": "double", "TEXT": "string", "BLOB": "binary"}

    @classmethod
    def name(cls) -> str:
        return "survey_store"

    def _columns(self) -> list[tuple[str, str]]:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            rows = c.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        return [(r[1], self.KINDS.get(r[2].upper().split("(")[0], "string")) for r in rows]

    def schema(self) -> str:
        return ", ".join(f"`{n}` {k}" for n, k in self._columns())

    def reader(self, schema) -> _SqliteReader:
        return _SqliteReader(self.options["path"], self.options["table"], [f.name for f in schema.fields], int(self.options.get("parts", 8)))


def read_sqlite(spark: SparkSession, path: str, table: str) -> DataFrame:
    spark.dataSource.register(SqliteStore)
    return spark.read.format("survey_store").option("table", table).load(path)
