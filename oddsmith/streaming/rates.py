"""Event rates and the latest records of a log: one definition for batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def hourly_errors(events: DataFrame, late: str = "2 hours", error: str = "error", success: str | None = None) -> DataFrame:
    """Errors and successes per hour, successes being events of one type or all that are no errors; on a stream, hours close once the watermark has passed them."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", "1 hour").alias("_w")).agg(F.count_if(F.col("event_type") == error).alias("errors"), F.count_if(F.col("event_type") != error if success is None else F.col("event_type") == success).alias("successes"))
    return counted.select(F.col("_w.start").alias("hour"), "errors", "successes")


def latest_of_log(events: DataFrame, keys: list[str]) -> DataFrame:
    """The last record of each key so far, by (ts, event_id); on a stream, in update mode."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("_last")).select(*keys, "_last.*")


def sliding_errors(events: DataFrame) -> DataFrame:
    """For each error the number of errors in the hour up to it.

    An event goes to its own hour and the next, so a window over one hour of events sees all it needs.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.where("event_type = 'error'").select("event_id", "ts", at.alias("_at"), F.floor(at / HOUR).alias("_own"))
    rows = rows.select("*", F.explode(F.array(F.col("_own"), F.col("_own") + 1)).alias("_hour"))
    near = Window.partitionBy("_hour").orderBy("_at").rangeBetween(1 - HOUR, 0)
    return rows.withColumn("errors", F.count("*").over(near)).where("_hour = _own").select("event_id", "ts", "errors")


def saturation(rates: DataFrame, slots: int = 3) -> DataFrame:
    """(hour, state): when errors outnumber successes in each of ``slots`` hours on end, and when that has ended for as many.

    Takes hourly rates, one row an hour, so its windows grow with time and not with events; hours without events count as quiet.
    """
    span = rates.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    every = span.select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("hour")).join(rates, "hour", "left")
    whole, last = Window.orderBy("hour"), Window.orderBy("hour").rowsBetween(1 - slots, 0)
    over = F.coalesce(F.col("errors") > F.col("successes"), F.lit(False)).cast("int")
    signal = F.when(F.count("*").over(last) < slots, None).when(F.sum("_over").over(last) == slots, "saturated").when(F.sum("_over").over(last) == 0, "clear")
    rows = every.withColumn("_over", over).withColumn("_signal", signal)
    rows = rows.withColumn("state", F.coalesce(F.last("_signal", ignorenulls=True).over(whole), F.lit("clear")))
    return rows.withColumn("_before", F.lag("state", 1, "clear").over(whole)).where("state <> _before").select("hour", "state")


def merged_pauses(events: DataFrame, key: str, minutes: float = 60.0) -> DataFrame:
    """(key, n_pauses, seconds): each error pauses its key for ``value / minutes`` hours; pauses that meet are one."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.where("event_type = 'error'").select(key, start.alias("_a"), (start + F.floor(F.coalesce("value", F.lit(0.0)) / minutes * HOUR)).alias("_b"))
    before = Window.partitionBy(key).orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_until", F.max("_b").over(before))
    # what a pause adds is what lies after all pauses before it
    opens = F.col("_until").isNull() | (F.col("_a") > F.col("_until"))
    added = F.greatest(F.lit(0), F.col("_b") - F.greatest(F.col("_a"), F.coalesce("_until", F.col("_a"))))
    return rows.groupBy(key).agg(F.count_if(opens).alias("n_pauses"), F.floor(F.sum(added) / 1000000).alias("seconds"))
