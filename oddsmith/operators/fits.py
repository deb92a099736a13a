"""Fitted maps: isotonic regression over partitions, and Platt scaling by Newton steps on sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.functions import scores
from oddsmith.functions.scores import r6

#: Slices of [0, 1] by which rows meet the steps of a map.
SLICES = 1_024


def pool(p: np.ndarray, n: np.ndarray, s: np.ndarray) -> list[list[float]]:
    """Pool adjacent violators over blocks (first p, count, sum of y) in order of p."""
    out: list[list[float]] = []
    for block in zip(p.tolist(), n.tolist(), s.tolist(), strict=True):
        out.append(list(block))
        while len(out) > 1 and out[-2][2] * out[-1][1] >= out[-1][2] * out[-2][1]:
            _, count, total = out.pop()
            out[-1][1] += count
            out[-1][2] += total
    return out


def isotonic(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, n, fitted): the steps of the isotonic fit of y on p; p is where a step starts.

    Pooling the pooled blocks of parts of a sequence pools the whole.  So rows are counted per distinct p, range-sorted, and
    each partition pools its part of each key; what is left is pooled once more, one group per key.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "p double, n double, s double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[list[float]]] = {}
        types: list[pa.DataType] = []
        for b in batches:
            types = [b.schema.field(k).type for k in keys]
            columns = [b.column(c).to_numpy(zero_copy_only=False) for c in ("p", "n", "s")]
            of = list(zip(*[b.column(k).to_pylist() for k in keys], strict=True))
            starts = [i for i in range(len(of)) if i == 0 or of[i] != of[i - 1]]
            for i, j in zip(starts, [*starts[1:], len(of)], strict=True):
                before = np.array(held.get(of[i], []), float).reshape(-1, 3)
                held[of[i]] = pool(*[np.concatenate([before[:, c], columns[c][i:j]]) for c in range(3)])
        for key, blocks in held.items():
            p, n, s = (list(c) for c in zip(*blocks, strict=True))
            yield pa.RecordBatch.from_arrays([*[pa.array([v] * len(p), t) for v, t in zip(key, types, strict=True)], pa.array(p), pa.array(n), pa.array(s)], [*keys, "p", "n", "s"])

    values = rows.groupBy(*keys, "p").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("s"))
    parts = values.repartitionByRange(*keys, "p").sortWithinPartitions(*keys, "p").mapInArrow(run, schema)
    steps = parts.repartition(*keys).sortWithinPartitions(*keys, "p").mapInArrow(run, schema)
    return steps.select(*keys, "p", F.col("n").cast("long").alias("n"), (F.col("s") / F.col("n")).alias("fitted"))


def stepped(rows: DataFrame, steps: DataFrame, keys: list[str], out: str, p: str = "p") -> DataFrame:
    """Add ``out``: the fitted value of the last step at or below p, of the first one for lower p; rows of keys without steps go.

    Steps go to each slice of p that they reach into, so rows meet by (keys, slice) only the few steps of their slice, and no side is broadcast whole.
    """
    whole = Window.partitionBy(*keys).orderBy("p")
    low = F.when(F.row_number().over(whole) == 1, F.lit(float("-inf"))).otherwise(F.col("p"))
    held = steps.select(*keys, low.alias("_low"), F.lead("p").over(whole).alias("_high"), F.col("fitted").alias(out))
    slice_of = lambda x: F.least(F.greatest(F.floor(x * SLICES), F.lit(0)), F.lit(SLICES)).cast("int")
    first, last = F.when(F.col("_low") == float("-inf"), 0).otherwise(slice_of(F.col("_low"))), F.when(F.col("_high").isNull(), SLICES).otherwise(slice_of(F.col("_high")))
    held = held.withColumn("_slice", F.explode(F.sequence(first, last)))
    met = rows.withColumn("_slice", slice_of(F.col(p))).join(held, [*keys, "_slice"])
    return met.where((F.col(p) >= F.col("_low")) & (F.col("_high").isNull() | (F.col(p) < F.col("_high")))).drop("_slice", "_low", "_high")


def corp(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The decomposition without bins: miscalibration, discrimination and uncertainty by the isotonic fit."""
    steps = isotonic(rows, keys)
    fit = steps.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("fitted")) / F.sum("n")).alias("base"), (F.sum(F.col("n") * F.col("fitted") * F.col("fitted")) / F.sum("n")).alias("ff"))
    brier = rows.groupBy(*keys).agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))
    # the fit is the outcome mean of each step, so its Brier score is base - mean(fitted^2)
    out = fit.join(brier, keys)
    return out.select(*keys, "n", r6(F.col("brier") - F.col("base") + F.col("ff")).alias("mcb"), r6(F.col("ff") - F.col("base") * F.col("base")).alias("dsc"), r6(F.col("base") * (1 - F.col("base"))).alias("unc"))


def platt(rows: DataFrame, keys: list[str], steps: int = 50, ridge: float = 1e-6, tolerance: float = 1e-10) -> DataFrame:
    """(keys, a, b) of y ~ 1 / (1 + exp(-(a + b logit p))): Newton steps, each one pass over the rows.

    A step gathers five sums per key; the coefficients, one row per key, go back with the next.  ``ridge`` is added to the
    Hessian only.  It stops when no coefficient moves by more than ``tolerance``; keys whose outcomes p tells apart, or that have one
    outcome only, have no finite fit, and get the large coefficients of the last step.
    """
    spark = rows.sparkSession
    base = rows.select(*keys, scores.logit(F.col("p")).alias("_x"), "y").persist()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    order = [c.split()[0] for c in kinds.split(", ")]
    at = {tuple(r[k] for k in order): (0.0, 1.0) for r in base.select(*order).distinct().collect()}  # one row per key
    for _ in range(steps):
        now = spark.createDataFrame([(*k, *v) for k, v in at.items()], f"{kinds}, _a double, _b double")
        mu = scores.sigmoid(F.col("_a") + F.col("_b") * F.col("_x"))
        each = base.join(F.broadcast(now), keys).withColumn("_mu", mu).withColumn("_w", F.col("_mu") * (1 - F.col("_mu")))
        g, x, w = F.col("y") - F.col("_mu"), F.col("_x"), F.col("_w")
        sums = each.groupBy(*order).agg(F.sum(g).alias("g0"), F.sum(g * x).alias("g1"), F.sum(w).alias("h00"), F.sum(w * x).alias("h01"), F.sum(w * x * x).alias("h11")).collect()
        moved = 0.0
        for r in sums:
            key = tuple(r[k] for k in order)
            step = np.linalg.solve([[r["h00"] + ridge, r["h01"]], [r["h01"], r["h11"] + ridge]], [r["g0"], r["g1"]])
            at[key] = (at[key][0] + float(step[0]), at[key][1] + float(step[1]))
            moved = max(moved, float(np.abs(step).max()))
        if moved < tolerance:
            break
    base.unpersist()
    return spark.createDataFrame([(*k, round(a, 6), round(b, 6)) for k, (a, b) in sorted(at.items())], f"{kinds}, a double, b double")
