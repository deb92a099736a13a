"""Cluster bootstraps from additive sums, and sampling without replacement.

Every statistic here is a function of sums over clusters, so no row is ever resampled: the sums of a cluster are weighted
by how often a draw takes it.  The weights are Poisson(1), from 16 bits of an MD5 of the draw's block and the cluster: clusters need
no numbering, and every engine gets the same weights.  It estimates what drawing with replacement does; weights above
what 16 bits can tell (7) do not occur.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.functions.scores import r6

DRAWS = 2000
_PER_DIGEST = 8
#: Clusters whose weights are held together.
_TOGETHER = 1_000


def thresholds() -> list[int]:
    """A weight is the number of these that a 16-bit number reaches."""
    out, term, total = [], math.exp(-1), math.exp(-1)
    while (edge := math.floor(total * 65536)) < 65535:
        out.append(edge)
        term /= len(out)
        total += term
    return out


def weights(label: str, cluster: str, draws: int) -> np.ndarray:
    """The cluster's weight in every draw."""
    blocks = (hashlib.md5(f"{label}|{k}|{cluster}".encode()).digest() for k in range(-(-draws // _PER_DIGEST)))
    bits = np.frombuffer(b"".join(blocks), ">u2")[:draws]
    return np.searchsorted(np.array(thresholds(), np.uint16), bits, side="right").astype(np.float64)


_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
#: Bytes that one block of MD5 holds beside its end mark and length; digests that are made together.
_ONE_BLOCK, _LANES = 55, 8_192


def _digests(words: np.ndarray) -> np.ndarray:
    """(lanes, 8): the MD5 of one-block messages, given as 16 rows of little-endian words, as eight big-endian 16-bit numbers."""
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        kind = i // 16
        if kind < 2:
            x, y, z = (b, c, d) if kind == 0 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            np.bitwise_and(f, x, out=f)
            np.bitwise_xor(f, z, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, words[_WORD[i]], out=f)
        np.add(f, np.uint32(_SINES[i]), out=f)
        turn = _TURNS[kind][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=g)
        np.left_shift(f, np.uint32(turn), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    out = np.stack([x + np.uint32(start) for x, start in zip((a, b, c, d), _START, strict=True)], axis=1)
    return np.ascontiguousarray(out.astype("<u4")).view(">u2")


@functools.cache
def _table() -> np.ndarray:
    """The weight of each 16-bit number."""
    return np.searchsorted(np.array(thresholds(), np.uint16), np.arange(65_536), side="right").astype(np.uint8)


def all_weights(label: str, clusters: list[str], draws: int, first: int = 0) -> np.ndarray:
    """(clusters, draws), as bytes: :func:`weights` of many clusters, from draw ``first`` on (a multiple of eight): their MD5s are made together, lane by lane."""
    out = np.empty((len(clusters), draws), np.uint8)
    names, before = [c.encode() for c in clusters], first // _PER_DIGEST
    lengths = np.array([len(n) for n in names], np.int64)
    blocks = -(-draws // _PER_DIGEST)
    fits = lengths + len(f"{label}|{before + blocks}|".encode()) <= _ONE_BLOCK
    for i in np.nonzero(~fits)[0].tolist():
        out[i] = weights(label, clusters[i], first + draws)[first:]
    own = np.nonzero(fits)[0]
    if not len(own):
        return out
    longest = int(lengths[own].max())
    text = np.frombuffer(b"".join(names[i].ljust(longest, b"\0") + b"\0" for i in own.tolist()), np.uint8).reshape(len(own), longest + 1).copy()
    text[np.arange(len(own)), lengths[own]] = 0x80
    table, width = _table(), len(own)
    together = max(1, _LANES // width)
    digits = 0
    for start in range(0, blocks, together):
        ks = [k + before for k in range(start, min(blocks, start + together))]
        for size in sorted({len(str(k)) for k in ks}):
            if size != digits:
                digits, ahead = size, len(f"{label}||".encode()) + size
                message = np.zeros((width, 64), np.uint8)
                message[:, ahead : ahead + longest + 1] = text
                message[:, 56:64] = ((lengths[own] + ahead) * 8).astype("<u8").view(np.uint8).reshape(width, 8)
                touched = -(-ahead // 4)  # words that the block's number changes
            same = [k for k in ks if len(str(k)) == size]
            words = np.empty((16, len(same), width), np.uint32)
            words[:] = message.view("<u4").T[:, None, :]
            for j, k in enumerate(same):
                prefix = np.frombuffer(f"{label}|{k}|".encode().ljust(touched * 4, b"\0"), "<u4")
                words[:touched, j] |= prefix[:, None]
            found = table[_digests(words.reshape(16, -1))].reshape(len(same), width, _PER_DIGEST)
            for j, k in enumerate(same):
                at = (k - before) * _PER_DIGEST
                n = min(_PER_DIGEST, draws - at)
                out[own, at : at + n] = found[j, :, :n]
    return out


def dealt_out(rows: DataFrame, cluster: str) -> DataFrame:
    """The rows by cluster, in no more parts than two a core: each task returns all keys and draws, however few its clusters are."""
    spark = rows.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, cluster).sortWithinPartitions(cluster)


def resample(per: DataFrame, keys: list[str], cluster: str, sums: list[str], draws: int = DRAWS, label: str = "w", whole: bool = False) -> DataFrame:
    """(keys, draw, sums): the weighted totals of each draw, from one row of sums per key and cluster (null counts as 0).

    With ``whole`` there is a draw -1 that takes each cluster once, so that what is told of the sample needs no second pass over its rows.

    Clusters are dealt by hash, so each one's weights are made about once for all keys, and a batch's weights and sums are multiplied as matrices; a
    task returns its totals per key and draw, which a last aggregate adds up.
    """
    kinds = {f.name: f.dataType.simpleString() for f in per.schema.fields}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "draw int", *[f"{s} double" for s in sums]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []
        for b in batches:
            types = [b.schema.field(k).type for k in keys]
            values = np.stack([np.nan_to_num(b.column(s).cast(pa.float64()).to_numpy(zero_copy_only=False)) for s in sums], axis=1)
            coded = b.column("_cluster").dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            key_of, of = _codes([b.column(k) for k in keys])
            for start in range(0, len(names), _TOGETHER):
                rows = np.nonzero((code >= start) & (code < start + _TOGETHER))[0]
                w = all_weights(label, names[start : start + _TOGETHER], draws).astype(np.float64)
                w = np.column_stack([np.ones(len(w)), w]) if whole else w
                for g in np.unique(of[rows]).tolist():
                    own = rows[of[rows] == g]
                    # a key that most clusters have is multiplied as it stands, without a copy of its clusters' weights
                    at = code[own] - start
                    if 2 * len(own) >= len(w):
                        v = np.zeros((len(w), len(sums)))
                        np.add.at(v, at, values[own])
                        part = w.T @ v
                    else:
                        part = w[at].T @ values[own]
                    key = key_of[g]
                    totals[key] = totals[key] + part if key in totals else part
        for key, total in totals.items():
            columns = [pa.array([v] * len(total), kind) for v, kind in zip(key, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(draws - len(total), draws, dtype=np.int32)), *[pa.array(np.ascontiguousarray(total[:, j])) for j in range(len(sums))]], [*keys, "draw", *sums])

    named = per.select(*keys, F.coalesce(F.col(cluster).cast("string"), F.lit("None")).alias("_cluster"), *sums)
    return dealt_out(named, "_cluster").mapInArrow(run, schema).groupBy(*keys, "draw").agg(*[F.sum(s).alias(s) for s in sums])


@dataclasses.dataclass
class Spec:
    """One resample of :func:`resample_many`: columns beside the keys, sums, label of its weights, and whether clusters are counted."""

    more: list[str]
    sums: list[str]
    label: str
    counted: bool = False


def resample_many(per: DataFrame, keys: list[str], more: list[str], cluster: str, sums: list[str], specs: list[Spec], draws: int = DRAWS, pooled: tuple[str, str] | None = None, dealt: bool = False) -> DataFrame:
    """(spec, keys, more, draw, events, v): several resamples of the same rows of sums, each by its own keys and weights, in one pass; draw -1 takes each cluster once.

    ``v`` has the weighted sums, ``events`` the clusters where they are counted.  ``pooled`` (a key and a value) adds a group of all values of that key.
    A cluster may have several rows of a key; with ``dealt`` they follow one another in one partition already.
    """
    kinds = {f.name: f.dataType.simpleString() for f in per.schema.fields}
    names = [*keys, *more]
    schema = ", ".join(["spec int", *[f"{k} {kinds[k]}" for k in names], "draw int", "events bigint", "v array<double>"])
    column = {s: i for i, s in enumerate(sums)}
    folded = None if pooled is None else keys.index(pooled[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        events: dict[tuple, int] = {}
        seen: dict[tuple, object] = {}  # the last cluster counted of a key, as one may go on in the next batch
        types: list[pa.DataType] = []
        for b in batches:
            types = [b.schema.field(k).type for k in names]
            values = np.stack([np.nan_to_num(b.column(s).cast(pa.float64()).to_numpy(zero_copy_only=False)) for s in sums], axis=1)
            coded = b.column("_cluster").dictionary_encode()
            clusters, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            found = [_codes([b.column(k) for k in [*keys, *s.more]]) for s in specs]
            for start in range(0, len(clusters), _TOGETHER):
                inside = np.nonzero((code >= start) & (code < start + _TOGETHER))[0]
                some = clusters[start : start + _TOGETHER]
                weights_of = {x: np.column_stack([np.ones(len(some)), all_weights(x, some, draws)]) for x in {s.label for s in specs}}
                for i, s in enumerate(specs):
                    key_of, of = found[i]
                    columns, w = [column[c] for c in s.sums], weights_of[s.label]
                    at = code[inside] - start
                    kinds_here, place = np.unique(of[inside], return_inverse=True)
                    v = np.zeros((len(some), len(kinds_here), len(columns)))
                    np.add.at(v, (at, place), values[np.ix_(inside, columns)])
                    part = (w.T @ v.reshape(len(some), -1)).reshape(len(w.T), len(kinds_here), -1)
                    for j, g in enumerate(kinds_here.tolist()):
                        key = (i, *key_of[g])
                        totals[key] = totals[key] + part[:, j] if key in totals else part[:, j].copy()
                    if s.counted:
                        met = {(i, *key_of[g]): np.unique(at[place == j]) for j, g in enumerate(kinds_here.tolist())}
                        if folded is not None:
                            for key in list(met):
                                whole = (*key[: folded + 1], pooled[1], *key[folded + 2 :])
                                met[whole] = np.union1d(met[whole], met[key]) if whole in met else met[key]
                        for key, found_at in met.items():
                            again = key in seen and some[found_at[0]] == seen[key]
                            events[key] = events.get(key, 0) + len(found_at) - again
                            seen[key] = some[found_at[-1]]
        if folded is not None:
            for key in list(totals):
                whole = (*key[: folded + 1], pooled[1], *key[folded + 2 :])
                totals[whole] = totals[whole] + totals[key] if whole in totals else totals[key]
        for key, total in totals.items():
            i, *values_of = key
            s = specs[i]
            values_of = dict(zip([*keys, *s.more], values_of, strict=True))
            n = len(total)
            columns = [pa.array([values_of.get(k)] * n, kind) for k, kind in zip(names, types, strict=True)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * total.shape[1]), pa.array(np.ascontiguousarray(total).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int32()), *columns, pa.array(np.arange(-1, draws, dtype=np.int32)), pa.array([events.get(key, 0)] * n, pa.int64()), flat], ["spec", *names, "draw", "events", "v"])

    named = per.select(*names, F.coalesce(F.col(cluster).cast("string"), F.lit("None")).alias("_cluster"), *sums)
    parts = (named if dealt else dealt_out(named, "_cluster")).mapInArrow(run, schema)
    longest = max(len(s.sums) for s in specs)
    of = ["spec", *names, "draw"]
    added = parts.groupBy(*of).agg(F.sum("events").alias("events"), *[F.sum(F.get("v", F.lit(j))).alias(f"_{j}") for j in range(longest)])
    return added.select(*of, "events", F.array(*[f"_{j}" for j in range(longest)]).alias("v"))


def _codes(columns: list[pa.Array]) -> tuple[list[tuple], np.ndarray]:
    """The distinct tuples of the columns' values and the place of each row's among them."""
    of = np.zeros(len(columns[0]), np.int64) if columns else np.zeros(0, np.int64)
    for c in columns:
        coded = c.dictionary_encode(null_encoding="encode")
        of = of * len(coded.dictionary) + coded.indices.to_numpy()
        of = np.unique(of, return_inverse=True)[1]
    _, first = np.unique(of, return_index=True)
    return [tuple(c[i].as_py() for c in columns) for i in first.tolist()], of


def ends(drawn: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, low, high): the values at places floor(0.025 n) and floor(0.975 n) of the draws that have one."""
    picked = drawn.select(*keys, value.alias("_v")).groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
    at = lambda share: r6(F.get("_vs", F.floor(F.size("_vs") * F.lit(share)).cast("int")))
    return picked.select(*keys, at(0.025).alias("low"), at(0.975).alias("high"))


def whole(value: Column) -> Column:
    """The value of draw -1, as an aggregate over draws."""
    return F.max(F.when(F.col("draw") == -1, value))


def bounds(value: Column) -> dict[str, Column]:
    """``low`` and ``high`` as in :func:`ends`, of the draws but -1, as aggregates over draws."""
    drawn = F.sort_array(F.collect_list(F.when(F.col("draw") >= 0, value)))
    return {n: r6(F.get(drawn, F.floor(F.size(drawn) * F.lit(share)).cast("int"))) for n, share in (("low", 0.025), ("high", 0.975))}


def bootstrap_mean(rows: DataFrame, keys: list[str], cluster: str, value: str, draws: int = DRAWS) -> DataFrame:
    """Mean with a 95 % interval; fewer than two clusters have no interval."""
    per = rows.where(F.col(value).isNotNull()).groupBy(*keys, cluster).agg(F.sum(value).alias("s"), F.count(value).cast("double").alias("c"), F.lit(1.0).alias("_one"))
    mean = F.try_divide("s", "c")
    found = resample(per, keys, cluster, ["s", "c", "_one"], draws, whole=True).groupBy(*keys).agg(
        whole(F.col("c")).cast("long").alias("n"), whole(F.col("_one")).cast("long").alias("n_clusters"), r6(whole(mean)).alias("mean"), *[v.alias(n) for n, v in bounds(mean).items()]
    )
    alone = F.col("n_clusters") < 2
    return found.withColumns({c: F.when(~alone, F.col(c)) for c in ("low", "high")})


def bootstrap_means(rows: DataFrame, keys: list[str], cluster: str, values: list[str], draws: int = DRAWS) -> DataFrame:
    """Rows, clusters and the mean of each value with its 95 % interval (``<value>_low``, ``<value>_high``), all from one resample.

    A null counts for no mean; a value that fewer than two clusters have gets no interval.
    """
    sums = {f"{n}_{v}": x for v in values for n, x in (("s", F.sum(v)), ("c", F.count(v).cast("double")), ("k", F.max(F.col(v).isNotNull().cast("double"))))}
    mean = lambda v: F.try_divide(F.col(f"s_{v}"), F.nullif(F.col(f"c_{v}"), F.lit(0.0)))
    per = rows.groupBy(*keys, cluster).agg(F.count("*").cast("double").alias("_rows"), F.lit(1.0).alias("_one"), *[x.alias(n) for n, x in sums.items()])
    drawn = resample(per, keys, cluster, ["_rows", "_one", *sums], draws, whole=True)
    found = drawn.groupBy(*keys).agg(
        whole(F.col("_rows")).cast("long").alias("n"), whole(F.col("_one")).cast("long").alias("n_events"), *[whole(F.col(f"k_{v}")).alias(f"k_{v}") for v in values], *[r6(whole(mean(v))).alias(v) for v in values],
        *[x.alias(f"{v}_{e}") for v in values for e, x in bounds(mean(v)).items()],
    )
    told = [c for v in values for c in (F.col(v), *[F.when(F.col(f"k_{v}") > 1, F.col(f"{v}_{e}")).alias(f"{v}_{e}") for e in ("low", "high")])]
    return found.select(*keys, "n", "n_events", *told)


def bootstrap_difference(rows: DataFrame, keys: list[str], cluster: str, value: str, side: Column, draws: int = DRAWS) -> DataFrame:
    """Mean where ``side`` holds less the mean where it does not; the two sets are resampled independently."""
    per = rows.where(F.col(value).isNotNull()).groupBy(*keys, cluster, side.alias("_side")).agg(F.sum(value).alias("s"), F.count(value).cast("double").alias("c"))
    one, other = per.where("_side"), per.where("not _side")
    mean = lambda part: part.groupBy(*keys).agg(F.sum("c").cast("long").alias("n"), (F.sum("s") / F.sum("c")).alias("m"))
    names = lambda df, tag: df.select(*keys, *[F.col(c).alias(f"{c}_{tag}") for c in df.columns if c not in keys])
    point = names(mean(one), "a").join(names(mean(other), "b"), keys).select(*keys, "n_a", "n_b", r6(F.col("m_a") - F.col("m_b")).alias("difference"))
    a = resample(one, keys, cluster, ["s", "c"], draws, "a").select(*keys, "draw", F.try_divide("s", "c").alias("a"))
    b = resample(other, keys, cluster, ["s", "c"], draws, "b").select(*keys, "draw", F.try_divide("s", "c").alias("b"))
    return point.join(ends(a.join(b, [*keys, "draw"]), keys, F.col("a") - F.col("b")), keys)


def _slope(n: str = "n", x: str = "sx", y: str = "sy", xx: str = "sxx", xy: str = "sxy") -> Column:
    return F.try_divide(F.col(n) * F.col(xy) - F.col(x) * F.col(y), F.nullif(F.col(n) * F.col(xx) - F.col(x) * F.col(x), F.lit(0.0)))


def bootstrap_slope(rows: DataFrame, keys: list[str], cluster: str, x: str, y: str, draws: int = DRAWS) -> DataFrame:
    """Least-squares slope of y on x with a 95 % interval, from five sums per cluster; rows without x or y are left out."""
    a, b = F.col(x), F.col(y)
    sums = {"n": F.count("*").cast("double"), "sx": F.sum(a), "sy": F.sum(b), "sxx": F.sum(a * a), "sxy": F.sum(a * b)}
    per = rows.where(a.isNotNull() & b.isNotNull()).groupBy(*keys, cluster).agg(*[v.alias(k) for k, v in sums.items()])
    drawn = resample(per, keys, cluster, list(sums), draws, whole=True)
    return drawn.groupBy(*keys).agg(whole(F.col("n")).cast("long").alias("n"), r6(whole(_slope())).alias("slope"), *[v.alias(n) for n, v in bounds(_slope()).items()])


def bootstrap_bands(rows: DataFrame, keys: list[str], cluster: str, value: str, band: str, least: int = 30, draws: int = DRAWS) -> DataFrame:
    """Mean in bucket 1 less mean in bucket 5 inside each band, averaged over the bands that vote, all resampled together.

    A band votes if both buckets have at least ``least`` rows in the full sample; one that is empty in a draw is left out
    of that draw's average.
    """
    in_bands = [*keys, "_band"]
    rows = rows.where(F.col(value).isNotNull() & F.col("bucket").isin(1, 5) & F.col(band).isNotNull()).withColumn("_band", F.col(band))
    of = lambda b, x: F.sum(F.when(F.col("bucket") == b, x))
    per = rows.groupBy(*in_bands, cluster).agg(of(1, F.col(value)).alias("s1"), of(1, F.lit(1.0)).alias("c1"), of(5, F.col(value)).alias("s5"), of(5, F.lit(1.0)).alias("c5"))
    sums = ["s1", "c1", "s5", "c5"]
    totals = per.groupBy(*in_bands).agg(*[F.sum(c).alias(c) for c in sums])
    voting = totals.where(f"least(c1, c5) >= {least}")
    gap = F.try_divide("s1", "c1") - F.try_divide("s5", "c5")
    point = voting.groupBy(*keys).agg(F.count("*").alias("n_bands"), r6(F.avg(gap)).alias("difference"))
    drawn = resample(per.join(voting.select(*in_bands), in_bands, "left_semi"), in_bands, cluster, sums, draws)
    return point.join(ends(drawn.groupBy(*keys, "draw").agg(F.avg(gap).alias("_gap")), keys, F.col("_gap")), keys)


def bootstrap_classes(rows: DataFrame, keys: list[str], inside: str, cluster: str, value: str, side: Column, least: int = 30, draws: int = DRAWS) -> DataFrame:
    """Mean where ``side`` holds less the mean where not, inside each value of ``inside`` with ``least`` rows on both sides, averaged.

    All are resampled together; in a draw, those with enough rows in that draw count.  Draws without any have no value.
    """
    each = [*keys, inside]
    rows = rows.where(F.col(value).isNotNull() & side.isNotNull())
    of = lambda s, x: F.sum(F.when(side if s else ~side, x).otherwise(0.0))
    per = rows.groupBy(*each, cluster).agg(*[of(s, x).alias(f"{n}{int(s)}") for s in (True, False) for n, x in (("s", F.col(value)), ("c", F.lit(1.0)))])
    sums = ["s1", "c1", "s0", "c0"]
    gap = F.when(F.least("c1", "c0") >= least, F.try_divide("s1", "c1") - F.try_divide("s0", "c0"))
    drawn = resample(per, each, cluster, sums, draws, whole=True).groupBy(*keys, "draw").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"), F.count(gap).alias("_n"), F.avg(gap).alias("_gap"))
    counts = {"n_with": "c1", "n_without": "c0", "n_groups": "_n"}
    return drawn.groupBy(*keys).agg(*[whole(F.col(c)).cast("long").alias(n) for n, c in counts.items()], r6(whole(F.col("_gap"))).alias("difference"), *[v.alias(n) for n, v in bounds(F.col("_gap")).items()])


def bootstrap_pair_r(pairs: DataFrame, keys: list[str], cluster: str, x: str, z: str, least: int = 10, draws: int = DRAWS) -> DataFrame:
    """Mean over pairs (a, b) of the correlation of x and z, with a 95 % interval; pairs of under ``least`` rows are left out."""
    a, b = F.col(x), F.col(z)
    sums = {"n": F.count("*").cast("double"), "sx": F.sum(a), "sz": F.sum(b), "sxx": F.sum(a * a), "szz": F.sum(b * b), "sxz": F.sum(a * b)}
    of = [*keys, "a", "b"]
    per = pairs.groupBy(*of, cluster).agg(*[v.alias(k) for k, v in sums.items()])
    n = F.col("n")
    vx, vz = (n * F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") for c in "xz")
    r = F.when((n >= least) & (vx > 1e-12) & (vz > 1e-12), (n * F.col("sxz") - F.col("sx") * F.col("sz")) / F.sqrt(F.when((vx > 0) & (vz > 0), vx * vz)))
    each = resample(per, of, cluster, list(sums), draws, whole=True).select(*keys, "draw", r.alias("r"))
    drawn = each.groupBy(*keys, "draw").agg(F.count("r").alias("_n"), F.avg("r").alias("r"), F.min("r").alias("_a"), F.max("r").alias("_b"))
    told = {"mean_r": "r", "min_r": "_a", "max_r": "_b"}
    found = drawn.groupBy(*keys).agg(whole(F.col("_n")).alias("n_pairs"), *[r6(whole(F.col(c))).alias(n) for n, c in told.items()], *[v.alias(n) for n, v in bounds(F.col("r")).items()])
    return found.where("n_pairs > 0")


def stratified_split(rows: DataFrame, cells: list[str], key: str, share: float = 0.2) -> DataFrame:
    """Add ``drawn``: in each cell the max(1, round(share n)) rows that come first in a random order (half to even).

    The rank is found as quantile cuts are: bins of the random number are counted first and only the bin of the cut is sorted.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("split"), F.col(key).cast("string"))), 1, 12), 16, 10).cast("long")
    bins = 1 << 12
    keyed = rows.withColumns({"_u": u, "_bin": F.floor(u / F.lit((1 << 48) // bins))})
    counts = keyed.groupBy(*cells, "_bin").agg(F.count("*").alias("_n"))
    whole, upto = Window.partitionBy(*cells), Window.partitionBy(*cells).orderBy("_bin")
    counts = counts.select(*cells, "_bin", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.col("_n"), F.greatest(F.lit(1), F.bround(F.sum("_n").over(whole) * share)).cast("long").alias("_k"))
    at = counts.where("_before < _k and _k <= _before + _n").select(*cells, F.col("_bin").alias("_cut"), (F.col("_k") - F.col("_before")).alias("_place"))
    placed = keyed.join(at, cells)
    inside = placed.where("_bin = _cut").withColumn("drawn", F.row_number().over(Window.partitionBy(*cells).orderBy("_u", key)) <= F.col("_place"))
    others = placed.where("_bin <> _cut").withColumn("drawn", F.col("_bin") < F.col("_cut"))
    return others.unionByName(inside).drop("_u", "_bin", "_cut", "_place")


def event_folds(rows: DataFrame, event: str, k: int = 5) -> DataFrame:
    """Add ``fold``, 0 to k - 1, the same for all rows of an event."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("fold"), F.col(event).cast("string"))), 1, 8), 16, 10).cast("long")
    return rows.withColumn("fold", (u % k).cast("int"))
