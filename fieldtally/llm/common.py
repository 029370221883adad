"""What several of the operators need: shared tables, words, column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see.

    Only where the session has none and runs on this machine alone (tests), a temporary folder is set. Elsewhere the
    setting is required: executors could not see a folder of the driver's.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back, so that a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` made and nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def named(column: str) -> Column:
    """A column by its name as it is, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame, new: tuple[str, ...] = (), **beside: Column) -> DataFrame:
    """All columns of ``df`` but those named in ``new`` as one struct ``row``, with the columns ``beside`` next to it.

    An operator works on what it put beside the row and ends with ``row.*`` and the columns named in ``new``; so no column of the input, whatever its
    name, can clash with one of the operator's own. Names in ``new`` are compared without case.
    """
    kept = [named(c) for c in df.columns if c.lower() not in new]
    return df.select(F.struct(*kept).alias("row"), *[v.alias(k) for k, v in beside.items()])


def row_keys(*columns: str) -> tuple[Column, Column]:
    """Two 64-bit hashes that together name a row by its content; a null differs from every value."""
    parts = [x for c in columns for x in (named(c).isNull(), named(c))]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)
