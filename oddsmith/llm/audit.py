"""Filter interaction audit: every order of a set of filters, as a trie whose nodes are shared by the set of filters applied.

The texts are read once: what the filters look at is measured and stored.  The trie is walked depth first over frames of
survivors: applying one more filter gives a child, persisted while its own children are worked out.  Which filters have
been applied decides who survives, not their order, so each set is worked out once (2^n nodes in place of n! orders)
and its edges, the removals by each filter not in it yet, are written to one table in the shared folder.  Orders,
redundant failures, sole failures and Shapley sums are read off those edges.

Edge cases: a null text counts as empty; a null lang is part ``''``; repeated rows count as rows; a row without doc_id is
no copy of another, and rows of one doc_id are no copies of each other; a doc_id with several labels has each mark that one of
them gives; an empty table gives no rows.  Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, store, text_of, words_of

#: Letter of each filter and the condition under which a document fails it; integers only.
FILTERS: dict[str, str] = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_upper > 10 * n_chars",
    "D": "n_symbols > 0",
    "E": "copied",
}
SYMBOLS = "#$%&*|"
COUNTS = ("removed", "good_lost", "toxic_lost")


def measure(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One stored row per document: part, what the filters look at, and the marks of its labels.

    The least doc_id of each repeated text is found by an aggregate on its SHA-256, which combines before the shuffle, and joined
    back; a text that very many documents share is a skewed key of a sort-merge join, which Spark splits.
    """
    text, words = text_of(), F.col("_words")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    length = F.length(text)
    rows = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), words_of(text).alias("_words"), length.cast("long").alias("n_chars"),
        (length - F.length(F.translate(text, upper, ""))).cast("long").alias("n_upper"),
        (length - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("_digest"),
    ).select("*", F.size(words).cast("long").alias("n_words"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))
    rows = store(rows.drop("_words"), "audit-measured")
    first = rows.groupBy("_digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    first = store(first, "audit-first")  # so that the join's inputs are plain shuffles
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id"))
    marks = marks.agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(first, "_digest", "left").withColumn("copied", F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)))
    rows = rows.join(marks, rows["doc_id"] == marks["_id"], "left")
    known = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return store(rows.select("part", "n_words", "n_distinct", "n_chars", "n_upper", "n_symbols", "copied", *known), "audit-rows")


def walk(rows: DataFrame, filters: dict[str, str]) -> DataFrame:
    """(applied, part, filter, n, removed, good_lost, toxic_lost): every edge of the trie, from the table they are written to.

    ``applied`` has one bit for each filter applied before, ``n`` is how many documents of the part had survived them.
    A part of which nobody survived has no row.
    """
    letters, path = list(filters), f"{shared_folder(rows.sparkSession)}/tables/audit-edges-{uuid.uuid4().hex}"
    bit = {x: 1 << i for i, x in enumerate(letters)}
    known: set[int] = set()

    def edges(alive: DataFrame, applied: int) -> None:
        rest = [x for x in letters if not applied & bit[x]]
        lost = lambda x: [F.count_if(F.expr(filters[x]) & mark).alias(c) for c, mark in zip(COUNTS, (F.lit(True), F.col("good"), F.col("toxic")), strict=True)]
        sums = [F.struct(F.lit(x).alias("filter"), *[F.col(f"{c}_{x}").alias(c) for c in COUNTS]) for x in rest]
        by = alive.groupBy("part").agg(F.count("*").alias("n"), *[c.alias(f"{k}_{x}") for x in rest for k, c in zip(COUNTS, lost(x), strict=True)])
        by.select(F.lit(applied).alias("applied"), "part", "n", F.inline(F.array(*sums))).coalesce(1).write.mode("append").parquet(path)

    def descend(alive: DataFrame, applied: int) -> None:
        known.add(applied)
        alive = alive.persist(StorageLevel.MEMORY_AND_DISK)
        edges(alive, applied)
        for x in letters:
            to = applied | bit[x]
            if not applied & bit[x] and to not in known and to != (1 << len(letters)) - 1:
                descend(alive.where(~F.expr(filters[x])), to)
        alive.unpersist()

    descend(rows, 0)
    return rows.sparkSession.read.parquet(path)


def interactions(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """One row per part, order and step: documents kept and removed there, failures removed before, sole failures, marks lost, Shapley sum."""
    edges = walk(measure(docs, labels), filters)
    letters = list(filters)
    bit = {x: 1 << i for i, x in enumerate(letters)}
    everything = sum(bit.values())
    steps = [("".join(o), k + 1, x, sum(bit[y] for y in o[:k])) for o in itertools.permutations(letters) for k, x in enumerate(o)]
    steps = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, applied int")  # n! n rows, whatever the data
    first = edges.where("applied = 0")
    failing = first.select("part", "filter", F.col("removed").alias("_failing"))
    sole = edges.where(F.col("applied") == everything - F.element_at(F.create_map(*[F.lit(v) for p in bit.items() for v in p]), F.col("filter")))
    sole = sole.select("part", "filter", F.col("removed").alias("_sole"))
    counts = failing.join(F.broadcast(steps), "filter").join(edges, ["part", "filter", "applied"], "left").join(sole, ["part", "filter"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return counts.select(
        "part", "filter_order", "step", (zero("n") - zero("removed")).alias("kept"), zero("removed").alias("removed"),
        (F.col("_failing") - zero("removed")).cast("long").alias("redundant"), zero("_sole").alias("unique_fails"), zero("good_lost").alias("good_lost"),
        zero("toxic_lost").alias("toxic_lost"), F.sum(zero("removed")).over(Window.partitionBy("part", "filter")).alias("shapley"),
    )
