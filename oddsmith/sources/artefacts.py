"""Files that a run leaves and later ones go by: depth cuts, gate, flags, split and key lists.

Everything is written and read by Spark, so that paths may be on any file system that it knows.  What is one row per market row or flag stays
distributed; only the gate and the counts of a report, one row per region or cell, are written as one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from oddsmith.functions.scores import r6
from oddsmith.operators import gates

CUTS = "array<double>"
FLAG = "model string, row_id bigint, win string, source string, quarantined int, reason string"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``, on whatever file system it names."""
    try:
        spark.read.format("binaryFile").load(path).limit(0).count()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def stored_cuts(cuts: DataFrame, path: str, group: str = "win") -> DataFrame:
    """The cuts (group, cuts) that ``path`` holds; only where there are none, ``cuts`` are worked out and written.

    The stored ones win however the rows have changed since, so buckets keep their meaning from run to run.
    """
    spark = cuts.sparkSession
    kind = cuts.schema[group].dataType
    if not _exists(spark, path):
        cuts.select(group, F.col("cuts").cast(CUTS)).coalesce(1).write.json(path)
    return spark.read.schema(T.StructType([T.StructField(group, kind), T.StructField("cuts", T.ArrayType(T.DoubleType()))])).json(path)


def write_gate(gate: DataFrame, path: str) -> None:
    """The gate with its rule as JSON lines, one region each, in the order of model, window and bucket (few rows: one file)."""
    rule = F.struct(F.lit(gates.BINS).alias("n_bins"), F.lit(gates.MIN_ROWS).alias("min_rows"), F.lit(gates.ECE_MAX).alias("ece_max"))
    gate.withColumn("rule", rule).coalesce(1).sortWithinPartitions("model", "win", "bucket").write.mode("overwrite").json(path)


def read_gate(spark: SparkSession, path: str) -> DataFrame:
    """The gate that :func:`write_gate` wrote; reading it fails if it was made under another rule."""
    schema = "model string, win string, bucket int, n bigint, ece double, bins string, verdict string, ece_sports double, ece_other double, rule struct<n_bins:int,min_rows:int,ece_max:double>"
    rows = spark.read.schema(schema).json(path)
    same = (F.col("rule.n_bins") == gates.BINS) & (F.col("rule.min_rows") == gates.MIN_ROWS) & (F.col("rule.ece_max") == gates.ECE_MAX)
    checked = F.when(F.coalesce(same, F.lit(False)), F.col("verdict")).otherwise(F.raise_error(F.lit("the stored gate was made under another rule")).cast("string"))
    return rows.withColumn("verdict", checked).drop("rule")


def _cell(value: Column) -> Column:
    return F.coalesce(F.format_number(value, 3), F.lit("-"))


def gate_markdown(gate: DataFrame) -> DataFrame:
    """(value): the gate as Markdown lines in order, a table for each model."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "win", F.col("bucket").cast("string"), F.col("n").cast("string"), _cell(F.col("ece")), "verdict", _cell(F.col("ece_sports")), _cell(F.col("ece_other"))), F.lit(" |"))
    head = ["## {m}", "", "| window | bucket | n | ECE | verdict | sports ECE | other ECE |", "| - | - | - | - | - | - | - |"]
    lines = gate.select("model", F.lit(1).alias("_part"), "win", "bucket", F.lit(0).alias("_k"), line.alias("value"))
    heads = gate.select("model").distinct().select("model", F.lit(0).alias("_part"), F.lit("").alias("win"), F.lit(0).alias("bucket"), F.posexplode(F.array(*map(F.lit, head))).alias("_k", "_h"))
    heads = heads.select("model", "_part", "win", "bucket", "_k", F.replace("_h", F.lit("{m}"), F.col("model")).alias("value"))
    ends = heads.where("_k = 1").withColumn("_part", F.lit(2))
    return heads.unionByName(lines).unionByName(ends).coalesce(1).sortWithinPartitions("model", "_part", "win", "bucket", "_k").select("value")


def write_flags(flags: DataFrame, path: str) -> None:
    """Flags as JSON lines; the summary that belongs to them is :func:`flag_summary`."""
    flags.select("model", "row_id", "win", "source", "quarantined", "reason").write.mode("overwrite").json(path)


def flag_summary(flags: DataFrame) -> DataFrame:
    """Per model and window: probed rows, how many each kind of record stands for, flags and their share."""
    kind = lambda s: F.count_if(F.col("source") == s)
    return flags.groupBy("model", "win").agg(
        F.count("*").alias("n"), kind("memory_probe").alias("n_probed"), kind("normal_stand_in").alias("n_stand_in"), F.sum("quarantined").alias("n_flagged"), r6(F.avg("quarantined")).alias("share"),
    )


def flags_of(spark: SparkSession, table: DataFrame, path: str) -> DataFrame:
    """The flags in force (quarantined = 1): those of the table if it holds any at all, else those of the files."""
    if table.isEmpty():
        table = spark.read.schema(FLAG).json(path)
    return table.where("quarantined = 1")


def write_split(rows: DataFrame, folder: str, key: str, cells: list[str], drawn: str = "drawn") -> DataFrame:
    """The split of the rows as CSV (``split.csv``) and the keys of its calibration side, one a line (``calibration_keys.txt``); returns counts by cell."""
    rows = rows.select(key, *cells, F.when(F.col(drawn), "calibration").otherwise("test").alias("split"))
    rows.write.mode("overwrite").option("header", True).csv(f"{folder}/split.csv")
    write_keys(rows.where("split = 'calibration'"), f"{folder}/calibration_keys.txt", key)
    side = lambda s: F.count_if(F.col("split") == s).alias(s)
    return rows.groupBy(*cells).agg(F.count("*").alias("n"), side("calibration"), side("test"))


def write_keys(rows: DataFrame, path: str, key: str) -> None:
    """Keys in order, one a line, in files that follow one another; :func:`runlog.read_keys` reads them."""
    rows.orderBy(key).select(F.col(key).cast("string").alias("value")).write.mode("overwrite").text(path)


def sample_report(rows: DataFrame, sample: DataFrame, groups: list[str]) -> DataFrame:
    """(grouping, value, n, n_drawn): how the sample lies over the population, group by group; a missing value is told as ``(none)``."""
    told = lambda df, n: df.select(F.inline(F.array(*[F.struct(F.lit(g).alias("grouping"), F.coalesce(F.col(g).cast("string"), F.lit("(none)")).alias("value")) for g in groups]))).groupBy("grouping", "value").agg(F.count("*").alias(n))
    return told(rows, "n").join(told(sample, "n_drawn"), ["grouping", "value"], "left").fillna(0, ["n_drawn"])
