"""Source divergence audit: how far the terms of a source are from its language, and the sources of a language from each other.

Terms are counted per (lang, source) inside each task and meet once, by (lang, term), where those in too few documents
go.  What is left, the postings, serves both parts.

* ``term``: a group's postings fall into buckets of about equal count.  A bucket's greatest count and the least share
  that its terms have in the language bound f of all of them, as f grows with p and falls with q while p > q.  Buckets are opened best
  bound first, in growing blocks, until the bounds of all unseen ones are strictly below the group's kth value.
* ``pair``: with a and b the shares in two sources and a0 and b0 those of a term that they don't have, the sum of f over all kept terms is
  V f(a0, b0), plus f(a, b0) - f(a0, b0) over the postings of each side (from counts of equal counts), plus
  f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0) over the terms that both have, which meet in a term's posting list.

All arithmetic is on integers: shares are at most 10^9 + 1, so squares fit a long; shares are divided as decimals.

Edge cases: null text, lang and source are ``''``; repeated rows are documents of their own; a group or language without kept
terms has no ``term`` rows, and its pairs are 0; ties rank by the item's UTF-8 bytes; an empty table gives no rows.  A text is
counted whole, whatever its length; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, store

LEAST_DOCS, TOP = 10, 10
#: Scale and added counts of a share.
SCALE, ADDED = 1_000_000_000, 2
#: A task hands its counts on when it holds this many of them.
HELD = 600_000
#: Counts below 2^BITS have a bucket each; above, counts with the same BITS leading bits share one.
BITS = 10
#: Terms that the first block of buckets opens for each group, and how much larger each next block is.
FIRST, GROWTH = 64, 8

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTED = "lang string, term string, cells array<struct<source: string, n: bigint, d: bigint>>"


def _cells(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    """One row per (lang, term) with a cell for each source: occurrences and documents."""
    for lang in sorted({lang for lang, _ in held}):
        groups = [(s, *counts) for (of, s), counts in held.items() if of == lang]
        place: dict[bytes, int] = {}
        at = np.fromiter((place.setdefault(t, len(place)) for _, n, _ in groups for t in n), np.int64)
        source = np.repeat(np.arange(len(groups), dtype=np.int32), [len(n) for _, n, _ in groups])
        n = np.fromiter((v for _, n, _ in groups for v in n.values()), np.int64)
        d = np.fromiter((d[t] for _, n, d in groups for t in n), np.int64)
        order = np.argsort(at, kind="stable")
        names = pa.DictionaryArray.from_arrays(pa.array(source[order]), pa.array([s for s, _, _ in groups], pa.string())).cast(pa.string())
        cells = pa.StructArray.from_arrays([names, pa.array(n[order]), pa.array(d[order])], ["source", "n", "d"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(place)))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), cells)
        terms = pa.array(list(place), pa.binary()).cast(pa.string())
        yield from pa.Table.from_arrays([pa.array([lang] * len(place), pa.string()), terms, lists], ["lang", "term", "cells"]).to_batches(max_chunksize=20_000)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        for text, lang, source in zip(texts, b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True):
            n, d = held.setdefault((lang, source), (Counter(), Counter()))
            had = len(n)
            words = text.as_py().translate(_LETTERS).split()
            n.update(words)
            d.update(set(words))
            size += len(n) - had
            if size >= HELD:
                yield from _cells(held)
                held, size = {}, 0
    yield from _cells(held)


def postings(docs: DataFrame) -> DataFrame:
    """(lang, term, source, n, in_lang, leads) of each kept term and source that has it.

    ``in_lang`` counts the term in its whole language; ``leads`` marks one row of each term.
    """
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = rows.mapInArrow(_count, _COUNTED).repartition("lang", "term")
    cells = counted.select("lang", "term", F.inline("cells")).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    terms = cells.groupBy("lang", "term").agg(F.sum("d").alias("_docs"), F.sum("n").alias("in_lang"), F.collect_list(F.struct("source", "n")).alias("_cells"))  # one cell per source
    kept = terms.where(F.col("_docs") >= LEAST_DOCS).select("lang", "term", "in_lang", F.posexplode("_cells").alias("_at", "_cell"))
    return kept.select("lang", "term", "_cell.source", "_cell.n", "in_lang", (F.col("_at") == 0).alias("leads"))


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kinds)); without kinds it serves nothing and need not be right."""
    scaled = (count + ADDED).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", scaled, F.greatest(total + kinds * ADDED, F.lit(1)).cast("decimal(28,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, cells): every group with its language's kinds and the share ``zero`` of a term it lacks; every posting with p, q and bucket."""
    found = store(postings(docs), "divergence-postings")
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = found.where("leads").groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("in_lang").alias("lang_total"))
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kinds", "lang_total"])
    groups = store(groups.withColumn("zero", share(F.lit(0), F.col("total"), F.col("kinds"))), "divergence-groups")
    kinds, n = F.col("kinds"), F.col("n")
    cut = F.greatest(F.length(F.bin("n")) - BITS, F.lit(0))
    cells = found.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(n, F.col("total"), kinds).alias("p"), share(F.col("in_lang"), F.col("lang_total"), kinds).alias("q"), "zero",
        F.struct(cut.alias("cut"), F.call_function("div", n, F.pow(F.lit(2), cut).cast("long")).alias("top")).alias("bucket"),
    )
    cells = store(cells, "divergence-cells")
    discard(found)
    return groups, cells


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the terms that two sources share add to their pair, from posting lists in order of source; summed within the task."""
    held: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            columns = [pa.array(c) for c in zip(*held, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), pa.int64())], ["lang", "source", "item", "value"])
            held.clear()

    for b in batches:
        lists = b.column("cells")
        flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
        if not len(flat):
            continue
        p, zero = (flat.field(k).to_numpy() for k in ("p", "zero"))
        sources, langs = flat.field("source").dictionary_encode(), b.column("lang").dictionary_encode()
        source, kinds = sources.indices.to_numpy().astype(np.int64), len(sources.dictionary)
        lang = np.repeat(langs.indices.to_numpy().astype(np.int64), sizes)
        end = np.repeat(np.cumsum(sizes), sizes)
        i = np.arange(len(flat))
        for step in range(1, int(sizes.max())):
            i = i[i + step < end[i]]
            j = i + step
            value = _gap(p[i], p[j]) - _gap(p[i], zero[j]) - _gap(zero[i], p[j]) + _gap(zero[i], zero[j])
            keys, at = np.unique((lang[i] * kinds + source[i]) * kinds + source[j], return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, at, value)
            for key, s in zip(keys.tolist(), sums.tolist(), strict=True):
                held[langs.dictionary[key // kinds // kinds].as_py(), sources.dictionary[key // kinds % kinds].as_py(), sources.dictionary[key % kinds].as_py()] += s
        if len(held) >= HELD:
            yield from out()
    yield from out()


def pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, item, value): each other source of a source's language with their divergence."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("_zero"))
    base = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("kinds") * gap(F.col("zero"), F.col("_zero"))).alias("value"))
    alike = cells.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("_n"))
    one_side = F.sum(F.col("_n") * (gap(F.col("p"), F.col("_zero")) - gap(F.col("zero"), F.col("_zero")))).alias("value")
    side = alike.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(one_side)
    lists = cells.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "zero"))).alias("cells")).select("lang", "cells")
    both = lists.mapInArrow(_meet, "lang string, source string, item string, value bigint")
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = base.unionByName(side).unionByName(turned(side)).unionByName(both).unionByName(turned(both))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_terms(cells: DataFrame, k: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the k terms of each group that stand out most, best-first over buckets."""
    group = ["lang", "source"]
    found = cells.groupBy(*group, "bucket").agg(F.max("p").alias("_p"), F.min("q").alias("_q"), F.count("*").alias("_n")).where("_p > _q")
    found = found.withColumn("bound", gap(F.col("_p"), F.col("_q")))
    reach = F.sum("_n").over(Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket")) - F.col("_n")
    buckets = store(found.select(*group, "bucket", "bound", reach.alias("before")), "divergence-buckets")
    best, low, high = None, 0, FIRST
    while True:
        unseen = buckets.where(F.col("before") >= low)
        if best is not None:
            kth = best.where(F.col("rank") == k).select(*group, F.col("value").alias("_kth"))
            unseen = unseen.join(kth, group, "left").where("_kth is null or bound >= _kth")
            if unseen.isEmpty():
                discard(buckets)
                return best
        opened = unseen.where(F.col("before") < high).select(*group, "bucket")
        seen = cells.join(opened, [*group, "bucket"]).where("p > q").select(*group, F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
        seen = seen if best is None else seen.unionByName(best.drop("rank"))
        last, best = best, store(_top(seen, k), "divergence-best")
        if last is not None:
            discard(last)
        low, high = high, high * GROWTH


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    groups, cells = shares(docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    far = pairs(groups, cells).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    return far.unionByName(top_terms(cells).withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")
