"""Memory-probe quarantine and the calibration gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.functions import scores
from oddsmith.functions.scores import r6
from oddsmith.operators.scoring import latest

BINS, MIN_ROWS, ECE_MAX = 3, 30, 0.10
#: Slices of p that are counted before single values.
SLICES = 256


def final_forecasts(calls: DataFrame, runs: DataFrame, models: list[str] | None = None, windows: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The latest final record of each model, mode and row over runs that are not void; later runs and call ids break ties.

    Only given models and windows are read where they are named.  The join of the runs is left to their size.  ``keep`` names the columns that are
    wanted beside model, mode and row: Spark does not find out by itself which ones a record as a whole need not carry through the shuffle.
    """
    for column, wanted in (("model", models), ("win", windows)):
        calls = calls if wanted is None else calls.where(F.col(column).isin(wanted))
    live = calls.where("final = 1").join(runs.where("void = 0"), "run_id")
    keys = ["model", "row_id", "mode"]  # in an order that the aggregates by model and row can take over
    out = latest(live, keys, ["called_at", "started_at", "call_id"], keep)
    return out.select("model", "mode", "row_id", *[c for c in out.columns if c not in keys])


def probe_forecasts(final: DataFrame) -> DataFrame:
    """Probe records, and where a row was not probed its normal one as a stand-in: one aggregate in place of union and anti-join."""
    rest = [c for c in final.columns if c not in ("model", "row_id")]
    by_mode = final.groupBy("model", "row_id").agg(F.max_by(F.struct(*rest), F.col("mode") == "memory_probe").alias("_r"))
    source = F.when(F.col("_r.mode") == "memory_probe", "memory_probe").otherwise("normal_stand_in")
    return by_mode.select("model", "row_id", "_r.*", source.alias("source"))


def flags(probes: DataFrame) -> DataFrame:
    """Quarantine flag and reason of each scored probe record."""
    p, q, y = F.col("p"), F.col("q"), F.col("y")
    right = F.abs(p - y) <= scores.PROBE_MARGIN + scores.EPS
    reason = F.when(~right, "not confidently right").when(scores.quarantined(p, q, y), "right where the market was not").otherwise("priced in")
    return probes.where("p is not null").select("model", "row_id", "win", "source", scores.quarantined(p, q, y).cast("int").alias("quarantined"), reason.alias("reason"))


def news_value(final: DataFrame) -> DataFrame:
    """Per model and window, on rows with news and both modes: mean Brier without news, with it, and the difference."""
    b = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    per = final.where("news_available and p is not null").groupBy("win", "model", "row_id").agg(
        F.max(F.when(F.col("mode") == "memory_probe", b)).alias("without"), F.max(F.when(F.col("mode") == "normal", b)).alias("with")
    )
    per = per.where("`without` is not null and `with` is not null")
    return per.groupBy("win", "model").agg(
        F.count("*").alias("n"), r6(F.avg("without")).alias("brier_without"), r6(F.avg("with")).alias("brier_with"), r6(F.avg(F.col("without") - F.col("with"))).alias("delta"),
        r6(F.avg((F.col("with") < F.col("without")).cast("int"))).alias("helped"), r6(F.avg((F.col("with") > F.col("without")).cast("int"))).alias("hurt"),
    )


def ece(rows: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """Count-weighted mean gap over at most ``bins`` nearly equal bins of p that never split a tied value; with n and bin sizes.

    Walking up the distinct values, bin b closes at the first value that brings the count to round(n b / bins), half to
    even, unless it is the last.  So a value's bin is 1 plus the thresholds reached before it, counting each at most once per value.
    Slices of p of equal width are counted first: only the slices that hold such a count, and the next few, are looked into value
    by value; the others go to a bin as a whole.
    """
    sliced = rows.select(*keys, "p", "y", F.floor(F.col("p") * SLICES).alias("_slice"))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.min("p").alias("p"), F.max("p").alias("_max"))
    upto, whole = Window.partitionBy(*keys).orderBy("_slice"), Window.partitionBy(*keys)
    counts = counts.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(whole), "_top": F.max("_max").over(whole)})
    goal = lambda b: F.bround(F.col("_all") * b / bins)
    before = F.col("_upto") - F.col("n")
    holds = F.lit(False)
    for b in range(1, bins):
        holds = holds | ((before < goal(b)) & (goal(b) <= F.col("_upto")))
    near = F.max(holds).over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(-(bins - 2), 0))
    counts = counts.withColumn("_near", near)
    open_ = counts.where("_near").select(*keys, "_slice", before.alias("_before"), "_all", "_top")
    inside = sliced.join(open_.select(*keys, "_slice"), [*keys, "_slice"], "left_semi").groupBy(*keys, "_slice", "p").agg(F.count("*").alias("n"), F.sum("y").alias("sy"))
    running = F.sum("n").over(Window.partitionBy(*keys, "_slice").orderBy("p"))
    values = inside.withColumn("_in", running).join(open_, [*keys, "_slice"]).select(*keys, "p", "n", (F.col("p") * F.col("n")).alias("sp"), "sy", (F.col("_before") + F.col("_in")).alias("_upto"), "_all", "_top", F.lit(True).alias("_near"))
    values = values.unionByName(counts.where("not _near").select(*keys, "p", "n", "sp", "sy", "_upto", "_all", "_top", "_near"))
    last = None  # the value that closed the bin before
    for b in range(1, bins):
        enough = F.col("_near") & (F.col("_upto") >= goal(b)) & (F.col("p") < F.col("_top"))
        after = F.lit(True) if last is None else F.col("p") > F.col(last)
        values = values.withColumn(f"_edge{b}", F.min(F.when(enough & after, F.col("p"))).over(whole))
        last = f"_edge{b}"
    number: Column = F.lit(1)
    for b in range(1, bins):
        number = number + F.coalesce((F.col("p") > F.col(f"_edge{b}")).cast("int"), F.lit(0))
    each = values.withColumn("bin", number).groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.sum("sp").alias("sp"), F.sum("sy").alias("sy"))
    gap = F.abs(F.col("sp") - F.col("sy"))
    sizes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"].cast("string")), "/")
    return each.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(gap) / F.sum("n")).alias("ece"), sizes.alias("bins"))


def verdict(n: Column, value: Column) -> Column:
    return F.when(n < MIN_ROWS, "insufficient").when(value <= ECE_MAX + scores.EPS, "pass").otherwise("fail")


def gate(rows: DataFrame) -> DataFrame:
    """Verdict of each (model, window, bucket) from the primary rows of the calibration slice, with the sports and other rows' values."""
    keys = ["model", "win", "bucket"]
    rows = rows.where("split = 'calibration' and primary")
    parts = rows.select("*", F.explode(F.array(F.lit("all"), F.when(F.col("sports"), "sports").otherwise("other"))).alias("part"))
    by = ece(parts, [*keys, "part"])
    pick = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    out = by.groupBy(*keys).agg(pick("all", "n").alias("n"), pick("all", "ece").alias("_e"), pick("all", "bins").alias("bins"), pick("sports", "ece").alias("_s"), pick("other", "ece").alias("_o"))
    return out.select(*keys, "n", r6(F.col("_e")).alias("ece"), "bins", verdict(F.col("n"), F.col("_e")).alias("verdict"), r6(F.col("_s")).alias("ece_sports"), r6(F.col("_o")).alias("ece_other"))


def admitted(rows: DataFrame, gate_: DataFrame) -> DataFrame:
    """The rows whose region passed; a missing region counts as not passed."""
    return rows.join(gate_.where("verdict = 'pass'").select("model", "win", "bucket"), ["model", "win", "bucket"], "left_semi")
