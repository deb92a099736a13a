"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations work on the stored bits.

All of it is DataFrame functions.  Edge cases: a null text counts as empty (no words, so it fails ``few_words``);
a null ``doc_id`` and repeated rows are kept as rows of their own; an empty table gives an empty ledger; columns other
than ``doc_id`` and ``text`` are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, text_of, words_of

SYMBOLS = "#*$%&|<>"

#: (bit, name, condition over the measurements); integers only, so that every engine decides alike.
RULES: list[tuple[int, str, str]] = [
    (0, "few_words", "n_words < 50"),
    (1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "100 * n_symbols > 30 * n_words"),
    (3, "duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    (4, "long_words", "word_chars > 20 * n_words"),
    (5, "short_words", "word_chars < 2 * n_words"),
    (6, "shouting", "100 * n_shouted > 30 * word_chars"),
]

#: Policies by version: the rules that reject.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "duplicate_lines", "long_words", "short_words", "shouting"],
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouted"]


def bits_of(policy: str | Iterable[str]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else list(policy)
    known = {name: bit for bit, name, _ in RULES}
    return sum(1 << known[name] for name in set(names))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of its whole text."""
    text = text_of()
    bare = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    step = docs.select(
        "doc_id",
        words_of(text).alias("_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(bare, "[^\\p{Lu}]+", "")).cast("long").alias("n_shouted"),
        lines.alias("_lines"),
    ).select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    # One long per 3-word window: its hash in the high bits, its position in the low ones.  A sort puts equal windows
    # side by side; neighbours are compared word by word, so a clash of hashes counts for nothing.
    step = step.withColumn("_bits", F.expr("length(bin(n_words))")).withColumn(
        "_keys",
        F.expr(
            "if(n_words >= 3, sort_array(transform(sequence(0, cast(n_words as int) - 3), i -> "
            "shiftleft(xxhash64(_words[i], _words[i + 1], _words[i + 2]), _bits) | cast(i as bigint))), "
            "cast(array() as array<bigint>))"
        ),
    )
    place = "cast({} & (shiftleft(1L, _bits) - 1L) as int)"
    equal = (
        "(shiftright(x, _bits) = shiftright({0}, _bits) and _words[{1}] = _words[{2}] "
        "and _words[{1} + 1] = _words[{2} + 1] and _words[{1} + 2] = _words[{2} + 2])"
    )
    near = [equal.format(other, place.format("x"), place.format(other)) for other in ("_keys[j - 1]", "_keys[j + 1]")]
    step = step.withColumn(
        "_starts",
        F.expr(
            f"sort_array(transform(filter(_keys, (x, j) -> (j > 0 and {near[0]}) or (j < n_words - 3 and {near[1]})), "
            f"x -> {place.format('x')}))"
        ),
    )
    covered = "aggregate(_starts, named_struct('n', 0L, 'to', -1), (a, p) -> named_struct('n', a.n + p + 3 - greatest(a.to, p), 'to', p + 3), a -> a.n)"
    return step.withColumn("n_repeat_words", F.expr(covered)).select("doc_id", *MEASURES)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``: a long with one bit for each rule that the text fails."""
    bits = F.lit(0).cast("long")
    for bit, _, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("failed", bits)


def rejected(policy: str | Iterable[str]) -> Column:
    """Whether a ledger row is rejected under a policy."""
    return F.col("failed").bitwiseAND(F.lit(bits_of(policy))) != 0


def ablation(rows: DataFrame, policy: str | Iterable[str]) -> DataFrame:
    """For each rule of a policy, from the ledger alone: documents failing it, failing it alone, and kept without it.

    One row per distinct set of failed bits is counted first; each rule then needs only bitwise tests on those counts.
    """
    mask = bits_of(policy)
    sets = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("bit")) for bit, name, _ in RULES if mask >> bit & 1]
    return (
        sets.select("bits", "n", F.inline(F.array(*rules)))
        .groupBy("rule", "bit")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def keep_good(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with the columns they came with.

    Rows go by exploding an array that is there or not: a filter would be pushed below the ledger, where each of its
    columns would be written out again wherever a later one uses it.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), F.col("text"))
    passed = F.explode(F.when(~rejected(policy), F.array(F.lit(True)))).alias("_passed")
    return ledger(held).select("doc_id", passed).select("doc_id.*")
