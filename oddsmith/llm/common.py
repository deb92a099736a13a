"""Helpers shared by the corpus operators: word patterns, ASCII case, tables in the shared folder, prefix sums."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that ends a word: space and \x09 to \x0D.
SPACES = " \t\n\x0b\x0c\r"
WORD_BREAK = "[ \\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_BREAK))


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.lit(0)).otherwise(F.regexp_count(inner, F.lit(WORD_BREAK)) + 1).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of its own only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        os.makedirs(folder, exist_ok=True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what :func:`store` wrote, once nothing will read it again."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """While it lasts, shuffle files go when the query that wrote them ends, not when the driver collects its garbage.

    For frames that are made and run once in it: another run of the same frame would shuffle anew.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def set_aside(df: DataFrame, used: list[str]) -> DataFrame:
    """The frame with columns that are only carried along named by place, so that none clashes; ``toDF`` names them back."""
    return df.toDF(*[c if c in used else f"_{i}" for i, c in enumerate(df.columns)])


def giving_back(run):  # noqa: ANN001, ANN201
    """A function over Arrow batches that returns free memory to the system at the end of its task: workers live on, and the next stage needs it."""

    def whole(batches):  # noqa: ANN001, ANN202
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Exclusive prefix sums of ``value`` within each group, in the given order, without gathering a group in one task.

    Rows are range-sorted by (group, order), so a large group spreads over many partitions.  Each partition adds up
    its own rows; the totals (one row per partition and group) are summed in order and carried over as offsets.
    """
    spark = df.sparkSession
    keys = [*group, *order]
    ranged = store(
        df.repartitionByRange(partitions(spark), *keys).withColumn("_pid", F.spark_partition_id()), f"{name}-ranged"
    )
    totals = ranged.groupBy("_pid", *group).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *group, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = F.lit(True)
    offsets = offsets.select(F.col("_pid").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in group], "_offset")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = local.join(offsets, (F.col("_pid") == F.col("_p")) & same)
    return joined.select(*df.columns, (F.col("_local") + F.col("_offset")).alias("before"))
