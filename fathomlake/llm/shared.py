"""Folders shared by all executors, and names that are free in a DataFrame."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode a new one if unset.

    A session on a cluster must name the folder: a temporary folder of one
    machine would be lost with it, so its absence is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    present = spark.sparkContext.getCheckpointDir()
    if present is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="fathomlake-"))
        present = spark.sparkContext.getCheckpointDir()
    return present.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; whoever owns the folder clears it
        pass


def shared_table(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It is removed when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a table in the shared folder, its lineage cut."""
    path = shared_table(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._fl_path = path
    return out


def forget(df: DataFrame) -> None:
    """Remove what ``cut`` wrote. Nothing that reads it may be run any more."""
    _remove(df.sparkSession, df._fl_path)


#: Rows of a few longs that are broadcast, at most (about 50 MB in memory).
SENT_ROWS = 250_000


def sent_if_small(df: DataFrame) -> DataFrame:
    """A kept table of a few longs a row, to be broadcast if it has at most ``SENT_ROWS`` rows, and else joined as Spark chooses."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def free(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        name = f"_fl_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def appended(docs: DataFrame, kept: list[Column], fields: list[StructField], start: Callable[[], Callable[[list[str | None]], list[pa.Array]]], text: str = "text") -> DataFrame:
    """The columns ``kept``, and those that a function computes from each batch's texts.

    ``start`` makes the function, once for each task. What is kept goes through as Arrow columns,
    so a null beside a large id leaves that id as it is.
    """
    rows = docs.select(*kept, F.col(text).cast("string").alias("_text"))
    out = StructType(rows.schema.fields[:-1] + fields)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for b in batches:
            columns = [*b.columns[:-1], *compute(b.columns[-1].to_pylist())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(run, out)


def numbered(rows: DataFrame, keys: list[str], name: str, block: int = 100_000) -> DataFrame:
    """The values of ``keys``, each as often as it occurs, numbered from 0 in ``name``.

    Only the distinct values are moved, with their counts, so that a value of very many rows, such as a
    null id, is one row on the way. What occurs more than ``block`` times is spelled out by several tasks.
    Rows of equal values are alike here, so the result doesn't depend on their order.
    """
    times, b = free(rows, "times", "b")
    counted = rows.groupBy(*keys).agg(F.count("*").alias(times))
    few = counted.filter(F.col(times) <= block).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)).alias(name))
    many = counted.filter(F.col(times) > block).select(*keys, times, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / block))).alias(b))
    many = many.repartition(*keys, b).select(*keys, F.explode(F.sequence(F.col(b) * block, F.least(F.col(times), (F.col(b) + 1) * block) - 1)).alias(name))
    return few.unionByName(many)
