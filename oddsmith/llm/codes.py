"""Exact top-k search over binary codes by multi-index hashing, with search radii that grow until they must suffice.

A code of 64 bits is cut into segments.  Codes at distance d differ by at most d / SEGMENTS bits, rounded down, in some
segment, so once every segment has been probed up to radius r, all codes within SEGMENTS * (r + 1) - 1 have been seen.
Rounds raise r by one for the queries whose k-th verified distance is not yet covered.

Index and queries are distinct codes, of which each keeps its k + 1 smallest ids: ties go to the smaller id, so no
more of a group of equal codes can be in a result, and copies cost nothing.

Edge cases: rows with a null id or vector are neither searched nor found; null elements count as 0; repeated ids are
one entry each; fewer than k other rows give a shorter result; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, store

SEGMENTS, BITS = 4, 16
TOP_K = 10


def sign_code(vector: Column) -> Column:
    """64 bits, bit i set if element i is above 0; elements beyond 64 are folded onto the bits again."""
    bit = lambda x, i: F.when(F.coalesce(x, F.lit(0)) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(vector, bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def _segment(code: Column, k: int) -> Column:
    return F.shiftrightunsigned(code, k * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _segments(rows: DataFrame) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(k).alias("segment"), _segment(F.col("code"), k).alias("value")) for k in range(SEGMENTS)])
    return rows.select("code", F.inline(parts))


def search(rows: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """From (id, code) frames: query_id, neighbor_id, distance and rank of the k nearest other rows, ties by id."""
    rows, queries = rows.dropna(subset=["id", "code"]), queries.dropna(subset=["id", "code"])
    by_id = Window.partitionBy("code").orderBy("id")
    firsts = rows.distinct().withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= k + 1)
    lists = store(firsts.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    index = store(_segments(lists), "segments")
    asked = store(queries.select("code").distinct(), "asked")
    active, best = asked, None
    for radius in range(BITS + 1):
        masks = [sum(1 << b for b in bits) for bits in combinations(range(BITS), radius)]
        flips = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<int>")  # folded to one constant
        probes = _segments(active).select(F.col("code").alias("q"), "segment", "value", F.explode(flips).alias("flip"))
        probes = probes.select("q", "segment", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
        found = probes.hint("merge").join(index, ["segment", "value"]).select("q", "code").distinct()
        found = found.select("q", "code", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).alias("distance"))
        if best is not None:
            found = found.unionByName(best.join(active.select(F.col("code").alias("q")), "q", "left_semi")).distinct()
        # each code stands for as many ids as it keeps; k + 1 codes are always enough
        near = Window.partitionBy("q").orderBy("distance", "least")
        small = lists.select("code", F.col("ids")[0].alias("least"), F.size("ids").alias("n"))
        ranked = found.join(small, "code").withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k + 1)
        ranked = store(ranked.select("q", "code", "distance", "n", "_r"), "found")
        before = Window.partitionBy("q").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
        kth = ranked.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(f"_before <= {k} and _before + n > {k}")
        done = kth.where(F.col("distance") <= SEGMENTS * (radius + 1) - 1).select("q")
        part = ranked.select("q", "code", "distance")
        best_new = part if best is None else part.unionByName(best.join(part.select("q").distinct(), "q", "left_anti"))
        after, kept = store(active.join(done, active["code"] == done["q"], "left_anti"), "asked"), store(best_new, "best")
        for old in (ranked, best):
            if old is not None:
                discard(old)
        active, best = after, kept
        if not active.limit(1).count():
            break
    ids = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct()
    pairs = ids.join(best, "q").join(lists, "code").select("query_id", "distance", F.explode("ids").alias("neighbor_id"))
    ranks = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    out = pairs.where("query_id <> neighbor_id").withColumn("rank", F.row_number().over(ranks))
    return out.where(F.col("rank") <= k).select("query_id", "neighbor_id", F.col("distance").cast("int").alias("distance"), F.col("rank").cast("int").alias("rank"))
