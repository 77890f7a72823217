"""Files as tables."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def sniff_delimiter(spark: SparkSession, path: str, size: int = 2048) -> str:
    """The delimiter of a text file, from its beginning; a comma if that does not tell."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(50).collect())[:size]
    try:
        return csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, schema: str | None = None) -> DataFrame:
    """A file with a header. Give a schema for large files: without one they are read twice."""
    reader = spark.read.option("header", True).option("sep", delimiter or sniff_delimiter(spark, path))
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, timestamps without a zone taken as those of the session's zone."""
    df = spark.read.parquet(path)
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", partition_by: list[str] | None = None, mode: str = "error") -> None:
    writer = df.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by a hash of ``keys`` in four tasks for each core, however few files or row groups it was read from; for narrow rows that then grow."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)
