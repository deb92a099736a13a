"""Mixing sources to target weights: hash-random order, range sort, distributed prefix sums, a cut at each budget.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; a source of size 0 gets
target 0; rows of a source with the same ``doc_id`` (or none) stand next to each other, in an order by their texts, and of
rows with the same text too as many are taken as fit; an empty table gives an empty mix.  Documents are never split: the one that crosses the budget is
taken if at least half of it fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prefix_sums, set_aside, store, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: A per-source table of at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 10_000


def order_key(epoch: Column) -> Column:
    """Where a document stands in the random order of an epoch; the same on every run."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), epoch.cast("string")))


def text_digest() -> Column:
    return F.md5(F.concat(F.when(F.col("text").isNull(), "0").otherwise("1"), F.coalesce(F.col("text"), F.lit(""))).cast("binary"))


def tie_key(epoch: Column) -> Column:
    """The order of rows with one order key."""
    return F.md5(F.concat_ws(":", F.col("_digest"), epoch.cast("string")))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """From (source, source_size), one row per source, each source's target.

    Weighted shares, none above ``most`` times its source: in order of the size a unit of weight can take, a source is
    capped if its fair share of what the sources before it leave is more than it may have.
    """
    n = len(weights)
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % n + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    rows = rows.select(
        "*",
        (F.sum(F.col("source_size").cast("double")).over(everything) * share).alias("budget"),
        (F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")).alias("cap_before"),
        F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)).alias("weight_from"),
    )
    rows = rows.withColumn("capped", (F.col("budget") - F.col("cap_before")) * F.col("weight") > F.col("cap") * F.col("weight_from"))
    rows = rows.select(
        "*",
        F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything).alias("cap_sum"),
        F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything).alias("open_weight"),
    )
    fair = F.col("weight") * F.try_divide(F.col("budget") - F.col("cap_sum"), F.col("open_weight"))
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(fair).alias("target"))


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sizes, cuts): doc_id, source, size and digest of each row; target, whole epochs and last place of each source.

    The last place is an order key and tie key, with the number of rows there and how many of them are taken.
    """
    sizes = store(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_digest().alias("_digest")), "sizes")
    goals = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = store(goals.withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    keyed = sizes.join(_small(goals.where("rest > 0")), sizes["source"].eqNullSafe(goals["source"])).select(
        sizes["source"], order_key(F.col("epochs")).alias("key"), tie_key(F.col("epochs")).alias("tie"), "size", "rest"
    )
    places = keyed.groupBy("source", "key", "tie", "size", "rest").agg(F.count("*").alias("n")).withColumn("words", F.col("size") * F.col("n"))
    sums = prefix_sums(places, ["source"], ["key", "tie"], "words", "mix")
    room = F.col("rest") - F.col("before")
    fit = F.when(F.col("size") > 0, F.least(F.col("n"), F.floor(F.try_divide(room, F.col("size")) + 0.5))).otherwise(F.col("n")).cast("long")
    last = sums.where(room >= F.col("size") / 2).groupBy(F.col("source").alias("_s")).agg(F.max(F.struct("key", "tie", fit.alias("fit"), "n")).alias("last"))
    cuts = goals.join(last, goals["source"].eqNullSafe(F.col("_s")), "left").drop("_s", "rest")
    return sizes, store(cuts, "cuts")


def _small(table: DataFrame) -> DataFrame:
    """One row per source: broadcast if it is as small as that."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``_copies``: how often the mix takes the row."""
    c = cuts.select([F.col(x).alias(f"_cut_{x}") for x in cuts.columns])
    last = F.col("_cut_last")
    joined = rows.join(_small(c), rows["source"].eqNullSafe(F.col("_cut_source")))
    joined = joined.withColumn("_place", F.struct(order_key(F.col("_cut_epochs")).alias("key"), tie_key(F.col("_cut_epochs")).alias("tie")))
    at_cut = F.coalesce((F.col("_place.key") == last["key"]) & (F.col("_place.tie") == last["tie"]) & (last["fit"] < last["n"]), F.lit(False))
    inside = F.coalesce(F.col("_place") <= F.struct(last["key"].alias("key"), last["tie"].alias("tie")), F.lit(False)) & last.isNotNull()
    out = joined.withColumn("_copies", F.col("_cut_epochs") + inside.cast("long"))
    if not cuts.where("last.fit < last.n").limit(1).count():
        return out
    # equal rows of which some are taken: numbered by their whole contents, then by where they are
    equal = joined.where(at_cut).withColumn("_hash", F.xxhash64(*[F.col(f"`{x}`") for x in rows.columns])).withColumn("_row", F.monotonically_increasing_id())
    numbered = prefix_sums(equal.withColumn("_one", F.lit(1)), ["_cut_source"], ["_hash", "_row"], "_one", "mix-equal")
    some = numbered.withColumn("_copies", F.col("_cut_epochs") + (F.col("before") < F.col("_cut_last.fit")).cast("long"))
    return out.where(~at_cut).unionByName(some.select(*out.columns))


def mix_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes of the row, repeats counted)."""
    sizes, cuts = plan(docs)
    return _with_cuts(sizes, cuts).select(
        "doc_id",
        "size",
        F.col("_cut_source_size").alias("source_size"),
        F.col("_cut_target").alias("target"),
        (F.col("size") * F.col("_copies")).alias("taken"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, with the columns it came with."""
    _, cuts = plan(docs)
    held = set_aside(docs, ["doc_id", "text", "source"])
    taken = _with_cuts(held.withColumn("_digest", text_digest()), cuts).where("_copies > 0")
    return taken.select(*held.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")).drop("_copy").toDF(*docs.columns)
