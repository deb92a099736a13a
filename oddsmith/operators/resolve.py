"""Joins that validate what they join: records to moments by key, then by row id, with conflicts and leftovers told or refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.functions.scores import r6

#: Statuses of records that no model was called for.
SKIPPED = ("excluded_by_benchmark_flag", "outcome_date_before_release", "no_news")
OUTCOMES = ("key", "row_id", "conflict", "unresolved")


def resolve(records: DataFrame, moments: DataFrame, keep: list[str]) -> DataFrame:
    """Add ``outcome`` and, as ``m_<column>``, the moment's ``row_id`` and the columns of ``keep``; null unless resolved.

    A record with a ``moment_key`` is looked up by it alone, and conflicts if its ``row_id`` is another; one without is looked up by ``row_id``.  Each record takes
    part in one join: moments are listed under both names.
    """
    told = F.struct("row_id", *keep).alias("_m")
    names = F.array(F.concat(F.lit("k:"), "moment_key"), F.concat(F.lit("r:"), F.col("row_id").cast("string")))
    listed = moments.select(F.explode(names).alias("_name"), told).where("_name is not null")
    name = F.coalesce(F.concat(F.lit("k:"), "moment_key"), F.concat(F.lit("r:"), F.col("row_id").cast("string")))
    named = records.withColumn("_name", F.coalesce(name, F.concat(F.lit("none:"), F.pmod(F.monotonically_increasing_id(), F.lit(997)).cast("string"))))
    met = named.join(listed, "_name", "left")
    conflict = F.col("moment_key").isNotNull() & F.col("row_id").isNotNull() & (F.col("row_id") != F.col("_m.row_id"))
    outcome = F.when(F.col("_m").isNull(), "unresolved").when(conflict, "conflict").when(F.col("moment_key").isNotNull(), "key").otherwise("row_id")
    met = met.withColumn("outcome", outcome)
    good = F.col("outcome").isin("key", "row_id")
    return met.select(*records.columns, "outcome", *[F.when(good, F.col(f"_m.{c}")).alias(f"m_{c}") for c in ("row_id", *keep)])


def asserted(rows: DataFrame, holds: Column, message: Column | str) -> DataFrame:
    """The rows as they are; reading one for which the condition does not hold fails with the message."""
    return rows.where(F.assert_true(F.coalesce(holds, F.lit(False)), message).isNull())


def refuse_changed(resolved: DataFrame, manifests: DataFrame, live: str) -> DataFrame:
    """The resolved records; reading fails at one that is unresolved in a run that was made on another benchmark than the live one."""
    hashes = manifests.select("run_id", F.col("db_sha256").alias("_sha"))
    told = resolved.join(hashes, "run_id", "left")
    fine = (F.col("outcome") != "unresolved") | F.col("_sha").isNull() | (F.col("_sha") == "") | (F.col("_sha") == live)
    return asserted(told, fine, F.concat(F.lit("run "), "run_id", F.lit(": records do not resolve and the benchmark changed since the run"))).drop("_sha")


def must_match(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join that fails at a row without a match."""
    joined = rows.join(others.withColumn("_met", F.lit(True)), keys, "left")
    return asserted(joined, F.col("_met"), F.concat(F.lit("no match for "), F.concat_ws(", ", *[F.concat(F.lit(f"{k} "), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys]))).drop("_met")


def lookups(rows: DataFrame, key: str, wanted: list) -> DataFrame:
    """The rows of the wanted keys; reading fails at one that is missing."""
    kind = rows.schema[key].dataType.simpleString()
    return must_match(rows.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(wanted)], f"{key} {kind}"), rows, [key])


def account(resolved: DataFrame, keys: list[str], arm: Column | None = None) -> DataFrame:
    """What became of the final records, each under the first reason that applies, and the share of failures among calls."""
    reason = (
        F.when(F.col("outcome") == "conflict", "moment_key_mismatch").when(F.col("outcome") == "unresolved", "key_not_in_benchmark").when(F.col("status").isin(*SKIPPED), "skipped")
        .when(F.col("win") != F.col("m_win"), "window_mismatch").when(F.col("p").isNull(), "failed_rows").when(F.col("m_late_dateline"), "dateline_flagged")
        .when(F.lit(False) if arm is None else ~arm, "outside_arm").when(F.col("m_is_ladder"), "ladder").otherwise("scored")
    )
    reasons = ("moment_key_mismatch", "key_not_in_benchmark", "skipped", "window_mismatch", "failed_rows", "dateline_flagged", "outside_arm", "ladder", "scored")
    told = resolved.withColumn("_reason", reason)
    by_id = F.count_if(F.col("moment_key").isNull() & F.col("row_id").isNotNull())
    out = told.groupBy(*keys).agg(F.count("*").alias("final_records"), by_id.alias("joined_by_row_id_only"), *[F.count_if(F.col("_reason") == c).alias(c) for c in reasons])
    called = sum((F.col(c) for c in reasons[4:]), F.lit(0))
    return out.withColumn("failed_share", r6(F.col("failed_rows") / F.greatest(F.lit(1), called)))
