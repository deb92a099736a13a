"""Maps of forecasts fitted on other folds or another split and applied: what they win back and what they cannot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.functions import scores
from oddsmith.functions.scores import r6
from oddsmith.operators import fits, resampling, scoring

#: Rows that a fit needs, and rows that are scored at least.
LEAST_FIT, LEAST_SCORED, FOLDS = 40, 50, 5


def mapped(train: DataFrame, rows: DataFrame, keys: list[str], method: str) -> DataFrame:
    """Add ``new``: p through the map fitted on the training rows of the same keys, if those are enough; other rows go."""
    enough = train.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= LEAST_FIT).select(*keys)
    train = train.join(enough, keys, "left_semi")
    if method == "isotonic":
        return fits.stepped(rows, fits.isotonic(train, keys), keys, "new")
    maps = fits.platt(train, keys).withColumnsRenamed({"a": "_a", "b": "_b"})
    return rows.join(maps, keys).withColumn("new", scores.sigmoid(F.col("_a") + F.col("_b") * scores.logit(F.col("p")))).drop("_a", "_b")


def recovery(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Brier scores before and after, the share of the gap to the market that is won back, and the resolution before and after, which a rising map cannot raise."""
    y = F.col("y")
    square = lambda c: F.avg((F.col(c) - y) * (F.col(c) - y))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), square("p").alias("_m"), square("new").alias("_r"), square("q").alias("_q")).where(F.col("n") >= LEAST_SCORED)
    before = scoring.murphy(rows, keys).select(*keys, F.col("res").alias("resolution"))
    after = scoring.murphy(rows.withColumn("p", F.col("new")), keys).select(*keys, F.col("res").alias("resolution_after"))
    gap = F.col("_m") - F.col("_q")
    out = out.select(*keys, "n", r6("_m").alias("brier"), r6("_r").alias("brier_after"), r6("_q").alias("brier_market"), F.when(gap > 0, r6((F.col("_m") - F.col("_r")) / gap)).alias("recovered"))
    return out.join(before, keys).join(after, keys)


def crossfitted(rows: DataFrame, keys: list[str], method: str, folds: int = FOLDS) -> DataFrame:
    """:func:`recovery` where each row's map is fitted on the other event folds."""
    folded = resampling.event_folds(rows.select(*keys, "event_id", "p", "q", "y"), "event_id", folds)
    others = folded.withColumn("_out", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("_out <> fold")
    train = others.drop("fold").withColumnRenamed("_out", "fold")
    return recovery(mapped(train, folded, [*keys, "fold"], method), keys)


def split(rows: DataFrame, keys: list[str], method: str, side: str = "split") -> DataFrame:
    """:func:`recovery` on the test side of a map fitted on the calibration side."""
    calibration, test = rows.where(F.col(side) != "test"), rows.where(F.col(side) == "test")
    return recovery(mapped(calibration, test, keys, method), keys)
