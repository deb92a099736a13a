"""Splits that keep events whole, what the others leak, and samples of a fixed size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of a cell that is drawn, rows of a validation sample.
SHARE, SAMPLE = 0.2, 500
#: Bins of the random order in which prefix sums are taken.
BINS = 4_096


def draw_number(label: str, key: str) -> Column:
    """48 random bits of a key; the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(label), F.col(key).cast("string"))), 1, 12), 16, 10).cast("long")


def majority_cells(rows: DataFrame, cells: list[str], event: str) -> DataFrame:
    """(event, cells, size): each event with the cell that most of its rows are in, ties to the cell that comes first."""
    counts = rows.groupBy(event, *cells).agg(F.count("*").alias("_n"))
    out = counts.groupBy(event).agg(F.min_by(F.struct(*cells), F.struct(-F.col("_n"), *cells)).alias("_cell"), F.sum("_n").alias("size"))
    return out.select(event, "_cell.*", "size")


def greedy_fill(events: DataFrame, cells: list[str], event: str, share: float = SHARE) -> DataFrame:
    """(event, cells, size, target, drawn): whole events, in a random order, as long as they bring the cell's rows closer to its target.

    An event is taken if its size is under twice what is missing.  Up to the first that is not, what is missing follows from prefix sums, taken over bins of
    the random order.  From there on an event of a size that has been refused is refused for good, as what is missing only shrinks; so of each size
    only the first few events, as many as could fit, go through one pass in order.  A cell that would stay empty takes its smallest event.
    """
    order = draw_number("grouped", event)
    keyed = events.withColumns({"_u": order, "_bin": F.floor(order / F.lit((1 << 48) // BINS))})
    by_bin = keyed.groupBy(*cells, "_bin").agg(F.sum("size").alias("_s"))
    whole, upto = Window.partitionBy(*cells), Window.partitionBy(*cells).orderBy("_bin")
    goal = F.greatest(F.lit(1), F.bround(F.sum("_s").over(whole) * share)).cast("long")
    by_bin = by_bin.select(*cells, "_bin", (F.sum("_s").over(upto) - F.col("_s")).alias("_base"), goal.alias("target"))
    inside = Window.partitionBy(*cells, "_bin").orderBy("_u", event).rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_base") + F.sum("size").over(inside) - F.col("size")
    placed = keyed.join(by_bin, [*cells, "_bin"]).withColumn("_before", before).withColumn("_at", F.struct("_u", event)).drop("_base", "_bin")
    missing = F.col("target") - F.col("_before")
    first = placed.where(F.col("size") >= 2 * missing).groupBy(*cells).agg(F.min(F.struct("_at", missing.alias("missing"))).alias("_first"))
    sided = placed.join(first, cells, "left")
    taken = F.coalesce(F.col("_at") < F.col("_first._at"), F.lit(True))
    left = F.col("_first.missing")
    rest = sided.where(~taken & (left > 0) & (F.col("size") < 2 * left))
    nth = F.row_number().over(Window.partitionBy(*cells, "size").orderBy("_u", event))
    rest = rest.withColumn("_nth", nth).where(F.col("_nth") <= F.ceil(left / F.col("size")) + 1)
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_u", event])
        open_, chosen = int(rows["missing"].iloc[0]), []
        for size in rows["size"]:
            chosen.append(size < 2 * open_)
            open_ -= size if chosen[-1] else 0
        return rows.loc[chosen, [event]]

    later = rest.select(*cells, event, "_u", "size", left.alias("missing")).groupBy(*cells).applyInPandas(fill, f"{event} {kinds[event]}").withColumn("_late", F.lit(True))
    out = sided.withColumn("_early", taken).join(later, event, "left").withColumn("drawn", F.col("_early") | F.coalesce("_late", F.lit(False)))
    told = out.groupBy(*cells).agg(F.max("drawn").alias("_any"), F.min(F.struct("size", event)).alias("_least"))
    out = out.join(told, cells)
    return out.select(event, *cells, "size", "target", (F.col("drawn") | (~F.col("_any") & (F.col(event) == F.col(f"_least.{event}")))).alias("drawn"))


def grouped_split(rows: DataFrame, cells: list[str], event: str, share: float = SHARE) -> DataFrame:
    """Add ``grouped``, calibration or test, the same for all rows of an event."""
    drawn = greedy_fill(majority_cells(rows, cells, event), cells, event, share).select(event, "drawn")
    return rows.join(drawn, event).withColumn("grouped", F.when(F.col("drawn"), "calibration").otherwise("test")).drop("drawn")


def leakage(rows: DataFrame, keys: list[str], event: str, split: str) -> DataFrame:
    """Rows and events, those of the test side, and how many test rows share an event with the calibration side."""
    test = F.col(split) == "test"
    per = rows.groupBy(*keys, event).agg(F.count("*").alias("n"), F.count_if(test).alias("t"))
    both = (F.col("t") > 0) & (F.col("t") < F.col("n"))
    return per.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count("*").alias("n_events"), F.sum("t").alias("n_test"), F.count_if(F.col("t") > 0).alias("test_events"),
        F.count_if(both).alias("straddling"), F.coalesce(F.sum(F.when(both, F.col("t"))), F.lit(0)).alias("test_inside"),
    )


def fixed_sample(rows: DataFrame, key: str, size: int = SAMPLE) -> DataFrame:
    """``size`` rows drawn without replacement: those that come first in a random order of their keys."""
    return rows.orderBy(draw_number("sample", key), key).limit(size)
