"""What the operators share: the shared folder, written tables, batches of rows, SQL fragments."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch that are turned into Python objects at a time.
SLICE = 256
_WRITTEN: list[str] = []
_TABLES: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode without it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and each row is made once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like written(), in buckets of ``key``, on which joins then move only the rows of the other side.

    ``df`` should be dealt by repartition(dealt(spark), key), so that each bucket is one file, or have few large rows.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/plumbline/{table}"
    _WRITTEN.append(path)
    _TABLES.add(table)
    df.write.bucketBy(dealt(spark), key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(table)
    return spark.read.table(table)


def dealt(spark: SparkSession) -> int:
    """As many as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _forget(spark: SparkSession, path: str) -> None:
    """Drop the table that bucketed() registered for this path, if it did."""
    if (table := path.rsplit("/", 1)[1]) in _TABLES:
        _TABLES.remove(table)
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def python_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Tuples of a few rows at a time, so that long texts are not all Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            piece = batch.slice(at, SLICE)
            yield list(zip(*(column.to_pylist() for column in piece.columns), strict=True))


def arrow_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of ``rows``."""
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def text_of(column: str = "text") -> Column:
    """The text, empty if null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def carried(docs: DataFrame) -> DataFrame:
    """The text as it is, and all other columns in one named row, where no name can clash with those of an operator."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text")


def restored(columns: list[str]) -> list[Column]:
    """The columns that carried() put away, in their order."""
    return [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns]


def fold(doc_id: str = "doc_id", parts: int = 4) -> Column:
    """crc32 of the id as text, modulo ``parts``; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)), F.lit(0)).cast("int")


def ranged(df: DataFrame, order: list[str], name: str, size: int = 100_000) -> DataFrame:
    """``df`` dealt to ranges of ``order`` of about ``size`` rows, written, with _range, the number of a row's range.

    Up to ``size`` rows are one range.
    """
    n = df.count()
    if n <= size:
        return written(df.withColumn("_range", F.lit(0)), name)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // size))
    return written(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), name)


def running(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df``, as ranged() gives it, with running totals along ``order``, up to and with each row.

    A window in each range and one over the sums of all ranges, a row for each.
    """
    held = df.select("*", *(c.alias(f"_v_{n}") for n, c in sums.items()))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = held.groupBy("_range").agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums))
    starts = whole.select(F.col("_range").alias("_of"), *(F.coalesce(F.sum(f"_s_{n}").over(ahead), F.lit(0)).alias(f"_b_{n}") for n in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = held.select(*df.columns, *(F.sum(f"_v_{n}").over(inside).alias(f"_i_{n}") for n in sums))
    totals = [(F.col(f"_b_{n}") + F.col(f"_i_{n}")).alias(n) for n in sums]
    return placed.join(F.broadcast(starts), F.col("_range") == F.col("_of")).select(*(c for c in df.columns if c != "_range"), *totals)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this session has written; results that read them can't be read afterwards."""
    while _WRITTEN:
        _forget(spark, name := _WRITTEN.pop())
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let executors delete the shuffle files of finished steps, which they keep until the driver drops its references."""
    spark.range(1).count()  # the last job is held until there is another
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a table that written() made, when nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        if "/plumbline/" in name:
            _forget(spark, name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
