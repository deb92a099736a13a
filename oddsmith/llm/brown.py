"""Class-based bigram model: exchange clustering puts words into classes; transitions and emissions give a text's score.

p(word | word before) = p(class | class before) * p(word | class).  Every training word is put into a cluster by the exchange
criterion, the likelihood of the classes' bigrams:

1. the ``LISTED`` most frequent words move in rounds, a hash group of them at a time, each to the cluster that raises the
   likelihood most by its exact counts; after each round the likelihood is counted anew, and a round that lowered it is taken
   back and its groups halved;
2. then every other word, however rare, goes to the cluster that it raises the likelihood most in, against those counts.

The end of a text is a class of its own.  A word that is not in the training texts belongs to the cluster with most distinct words,
each of which keeps room for one unseen word.  Every training word keeps its own count, and so its own emission probability.

Nothing that grows with the corpus is sent to the driver or broadcast: the listed words, the class of each and the class
counts are bounded; counts and classes of all other words meet the texts by shuffle, one dictionary per block of texts.

Edge cases: a null text counts as empty and is scored as the end alone; a null ``doc_id`` counts as the empty string
for the split; repeated rows are rows of their own, in counts and result; with no training text every word is unseen
and N is 0; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, freeing_shuffles, partitions, store

#: Words that move in rounds; all others move once, after them.
LISTED = 1 << 16
CLUSTERS = 62
#: Clusters, then all unlisted words while listed ones move, then the end.
CLASSES = CLUSTERS + 2
UNLISTED, END_CLASS = CLUSTERS, CLUSTERS + 1
#: Ids after those of the listed words.
RARE, END = LISTED, LISTED + 1
ROUNDS = 3
GROUPS = 2
SMOOTH = 0.1
PRIOR = 50.0
#: Row of a word's counts: the classes after it (or before it), then itself after itself.
WIDTH = CLASSES + 1
#: So many words' rows at once have places of 16 bits.
WORDS_PER_BLOCK = (1 << 16) // WIDTH
BLOCKS = -(-LISTED // WORDS_PER_BLOCK)
#: Bytes of text that one block of texts holds.
BLOCK_BYTES = 12_000_000
#: With more shuffle partitions than this, tasks' counts are added up in two steps; the sums are the same.
MANY_TASKS = 64
SEED = 42


def held_out(folds: int = 10) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0


def _blocks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded size, with the texts lower-cased (A-Z) and null as empty."""
    text = pc.ascii_lower(pc.fill_null(b.column("text").cast(pa.large_string()), ""))
    b = b.set_column(b.schema.get_field_index("text"), "text", text)
    at = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False)) // BLOCK_BYTES
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else []
    for i, j in zip(first, [*first[1:], len(at)], strict=True):
        yield b.slice(i, j - i)


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, each token's place among them, number of tokens of each text)."""
    split = pc.ascii_split_whitespace(text)
    values = split.flatten()
    real = pc.not_equal(pc.binary_length(values), 0)
    upto = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)).astype(np.int64)
    counts = np.diff(np.concatenate(([0], upto[ends])))
    coded = values.filter(real).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in _blocks(batch):
            words, at, _ = _words(b.column("text"))
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.bincount(at, minlength=len(words)))], ["word", "n"])


def _coder(listed: list[str]):
    """Blocks of texts as token ids; unlisted words have one id, their hashes stand beside, and each is kept once per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, part, block = pa.array(listed, pa.large_string()), TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in _blocks(batch):
                words, at, counts = _words(b.column("text"))
                number = pc.fill_null(pc.index_in(words, known), RARE).to_numpy(zero_copy_only=False).astype("<i4")
                rare = np.flatnonzero(number == RARE)
                others = words.take(pa.array(rare)).to_pylist()
                hashes = np.zeros(len(words), "<i8")
                hashes[rare] = np.array([xxhash.xxh64_intdigest(w.encode(), SEED) for w in others], np.uint64).view(np.int64)
                ids = number[at]
                miss = ids == RARE
                sides, ends = hashes[at[miss]], np.cumsum(counts)
                upto = np.concatenate(([0], np.cumsum(miss)))[np.concatenate(([0], ends))]
                last = np.array([END], "<i4").tobytes()
                starts = ends - counts
                tokens = [ids[i:j].tobytes() + last for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                unlisted = [sides[i:j].tobytes() for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                n, kind = b.num_rows, b.schema.field("doc_id").type
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n + 1, part << 32 | block)),
                        pa.concat_arrays([b.column("doc_id"), pa.nulls(1, kind)]),
                        pa.array([*b.column("held_out").to_pylist(), None], pa.bool_()),
                        pa.array([*tokens, None], pa.binary()),
                        pa.array([*unlisted, None], pa.binary()),
                        pa.array([None] * n + [others], pa.list_(pa.string())),
                    ],
                    ["block", "doc_id", "held_out", "tokens", "rare", "words"],
                )
                block += 1

    return run


def _row(key: int, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Counts of one block of words, or of class pairs (key below 0), whose counts need 64 bits."""
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([at.astype("<u2").tobytes()]), pa.array([n.astype(_kind(key)).tobytes()])], ["key", "at", "n"])


def _kind(key: int) -> str:
    return "<i8" if key < 0 else "<u4"


def _profiles(classes: np.ndarray):
    """Counts of the classes after and before each listed word, of itself after itself, and of class pairs, in sparse blocks of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = np.zeros(BLOCKS * WORDS_PER_BLOCK * WIDTH, np.int32)
        before = np.zeros(BLOCKS * WORDS_PER_BLOCK * WIDTH, np.int32)
        pairs = np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            codes = b.column("tokens").drop_null()
            if not len(codes):
                continue
            ids = np.frombuffer(b"".join(codes.to_pylist()), "<i4")
            prev = np.concatenate(([END], ids[:-1]))  # a text starts after an end
            c, p = classes[ids], classes[prev]
            pairs += np.bincount(p * CLASSES + c, minlength=len(pairs))
            known = prev < LISTED
            np.add.at(after, prev[known] * WIDTH + c[known], 1)
            known = ids < LISTED
            np.add.at(before, ids[known] * WIDTH + p[known], 1)
            np.add.at(after, ids[known & (ids == prev)] * WIDTH + CLASSES, 1)
        for side, table in ((0, after), (1, before)):
            for k, part in enumerate(table.reshape(-1, WORDS_PER_BLOCK * WIDTH)):
                at = np.flatnonzero(part)
                if len(at):
                    yield _row(2 * k + side, at, part[at])
        at = np.flatnonzero(pairs)
        if len(at):
            yield _row(-1, at, pairs[at])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up sparse blocks; the rows of a partition are of few keys, and each key's sum is of bounded size."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for key, at, n in zip(b.column("key").to_pylist(), b.column("at").to_pylist(), b.column("n").to_pylist(), strict=True):
            if key not in sums:
                sums[key] = np.zeros(CLASSES * CLASSES if key < 0 else WORDS_PER_BLOCK * WIDTH, np.int64)
            sums[key][np.frombuffer(at, "<u2")] += np.frombuffer(n, _kind(key))
    for key, total in sums.items():
        at = np.flatnonzero(total)
        yield _row(key, at, total[at])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(pairs: np.ndarray) -> float:
    """What the classes' bigrams add to the log likelihood: sum of N log N over pairs less that over both margins."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(axis=0)).sum() - _xlogx(pairs.sum(axis=1)).sum())


def gains(pairs: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, self_: float) -> np.ndarray:
    """What :func:`likelihood` is, up to a constant, with a word of class ``own`` in each class instead.

    ``after`` and ``before`` count the classes after and before the word, itself included, ``self_`` itself after itself.
    """
    rest, out, into = pairs.copy(), pairs.sum(axis=1), pairs.sum(axis=0)
    rest[own] -= after
    rest[:, own] -= before
    rest[own, own] += self_
    out[own] -= after.sum()
    into[own] -= before.sum()
    after, before = after.copy(), before.copy()
    after[own] -= self_
    before[own] -= self_
    left = _xlogx(rest)
    rows, columns = _xlogx(rest + after) - left, _xlogx(rest + before[:, None]) - left
    corner = np.diag(rest)
    both = _xlogx(corner + after + before + self_) - np.diag(left)
    gain = rows.sum(axis=1) - np.diag(rows) + columns.sum(axis=0) - np.diag(columns) + both
    sums = after.sum() + self_, before.sum() + self_
    return gain - (_xlogx(out + sums[0]) - _xlogx(out)) - (_xlogx(into + sums[1]) - _xlogx(into))


def _best_classes(pairs: np.ndarray, classes: np.ndarray):
    """For each listed word of the blocks, the cluster that the exchange criterion likes most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[int, dict[int, np.ndarray]] = {}
        for b in batches:
            for key, at, n in zip(b.column("key").to_pylist(), b.column("at").to_pylist(), b.column("n").to_pylist(), strict=True):
                table = np.zeros(WORDS_PER_BLOCK * WIDTH)
                table[np.frombuffer(at, "<u2")] = np.frombuffer(n, _kind(key))
                sides.setdefault(key // 2, {})[key % 2] = table.reshape(-1, WIDTH)
        empty = np.zeros((WORDS_PER_BLOCK, WIDTH))
        words, best = [], []
        for block, side in sides.items():
            right, left = side.get(0, empty), side.get(1, empty)
            for i in np.flatnonzero(right.sum(axis=1) + left.sum(axis=1)).tolist():
                word = block * WORDS_PER_BLOCK + i
                gain = gains(pairs, classes[word], right[i, :CLASSES], left[i, :CLASSES], right[i, CLASSES])
                words.append(word)
                best.append(int(np.argmax(gain[:CLUSTERS])))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.array(best, pa.int32())], ["id", "class"])

    return run


def _rare_profiles(classes: np.ndarray):
    """(hash, at, n): how often each unlisted word stands before (at < CLASSES) and after a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column("tokens").to_pylist()
            ids = np.frombuffer(b"".join(codes), "<i4")
            hashes = np.frombuffer(b"".join(b.column("rare").to_pylist()), "<i8")
            if not len(hashes):
                continue
            at = np.flatnonzero(ids == RARE)
            following, prior = classes[ids[at + 1]], np.where(at > 0, classes[ids[at - 1]], END_CLASS)
            words, which = np.unique(hashes, return_inverse=True)
            cell, n = np.unique(np.concatenate([which * (2 * CLASSES) + following, which * (2 * CLASSES) + CLASSES + prior]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words[cell // (2 * CLASSES)]), pa.array((cell % (2 * CLASSES)).astype(np.int32)), pa.array(n.astype(np.int64))], ["hash", "at", "n"])

    return run


def _rare_best(pairs: np.ndarray):
    """(hash, class): the cluster that each unlisted word raises the likelihood most in, from rows sorted by hash."""
    out, into = pairs.sum(axis=1)[:CLUSTERS], pairs.sum(axis=0)[:CLUSTERS]
    cells = np.concatenate([pairs[:CLUSTERS].T, pairs[:, :CLUSTERS]])  # by at: what the word's counts are added to
    flat = _xlogx(cells)

    def best(hashes: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        gain = np.add.reduceat(_xlogx(cells[at] + n[:, None]) - flat[at], first)
        for side, total in ((at < CLASSES, out), (at >= CLASSES, into)):
            m = np.add.reduceat(np.where(side, n, 0), first)[:, None]
            gain -= _xlogx(total + m) - _xlogx(total)
        return pa.RecordBatch.from_arrays([pa.array(hashes[first]), pa.array(np.argmax(gain, axis=1).astype(np.int32))], ["hash", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 3
        for b in batches:
            now = [np.concatenate([r, b.column(c).to_numpy(zero_copy_only=False)]) for r, c in zip(rest, ("hash", "at", "n"), strict=True)]
            if not len(now[0]):
                continue
            whole = int(np.searchsorted(now[0], now[0][-1]))  # the last word may go on in the next batch
            if whole:
                yield best(*[c[:whole] for c in now])
            rest = [c[whole:] for c in now]
        if len(rest[0]):
            yield best(*rest)

    return run


class Model:
    """Listed words with counts and classes, class counts, and the table of all unlisted training words' counts and classes."""

    def __init__(self, listed: list[str], counts: np.ndarray, classes: np.ndarray, pairs: np.ndarray, types: np.ndarray, n: int, v: int):
        self.listed, self.counts, self.classes, self.pairs, self.types, self.n, self.v = listed, counts, classes, pairs, types, n, v
        self.unseen = int(np.argmax(types[:CLUSTERS]))

    def tables(self) -> dict[str, np.ndarray]:
        """Log10 probabilities: transitions by class pair, emissions by id, and what an unlisted word's emission needs."""
        total = self.pairs.sum(axis=0)
        prior = (total + 1) / (total.sum() + CLASSES)
        transition = (self.pairs + PRIOR * prior) / (self.pairs.sum(axis=1, keepdims=True) + PRIOR)
        under = np.log10(total + SMOOTH * (self.types + 1))
        emission = np.log10(self.counts + SMOOTH) - under[self.classes]
        base = np.log10(self.counts + SMOOTH) - math.log10(self.n + SMOOTH * (self.v + 1))
        return {"transition": np.log10(transition), "emission": emission, "under": under, "base": base, "known": (self.counts > 0).astype(np.int64), "classes": self.classes}


def _token_classes(tokens: bytes, rare: bytes, classes: np.ndarray, table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, classes, counts of the unlisted tokens) of a text, with what its block knows of unlisted words."""
    ids = np.frombuffer(tokens, "<i4")
    at = np.searchsorted(table["hash"], np.frombuffer(rare, "<i8"))
    c = classes[ids]
    c[ids == RARE] = table["class"][at]
    return ids, c, table["n"][at]


def _table(rows: pa.Table, unseen: int) -> dict[str, np.ndarray]:
    """A block's unlisted words in order of their hashes."""
    if not rows.num_rows:
        return {"hash": np.empty(0, np.int64), "n": np.empty(0), "class": np.empty(0, np.int64)}
    words = rows.column("words").combine_chunks().flatten()
    hash_, n, c = (words.field(k) for k in ("hash", "n", "class"))
    return {"hash": hash_.to_numpy(zero_copy_only=False), "n": n.to_numpy(zero_copy_only=False).astype(float), "class": pc.fill_null(c, unseen).to_numpy(zero_copy_only=False).astype(np.int64)}


def cluster(spark: SparkSession, learn: DataFrame, classes: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(classes, pairs, likelihoods): the listed words' exchange, round by round; a round that lowers the likelihood is taken back."""
    groups, turn, said, best = GROUPS, 0, [], None
    for k in range(rounds + 1):
        sums = _class_counts(spark, learn, classes)
        pairs = np.zeros(CLASSES * CLASSES)
        for r in sums.where("key < 0").collect():
            pairs[np.frombuffer(r["at"], "<u2")] += np.frombuffer(r["n"], "<i8")
        pairs = pairs.reshape(CLASSES, CLASSES)
        said.append(likelihood(pairs))
        if best is None or said[-1] >= best[0]:
            if best is not None:
                discard(best[3])
            best = said[-1], classes, pairs, sums
        else:
            discard(sums)
            groups *= 2
        if k < rounds:
            classes = best[1].copy()
            dealt = best[3].where("key >= 0").repartition(BLOCKS, F.floor(F.col("key") / 2))
            group = (np.arange(LISTED) * 2654435761 >> 7) % groups
            for r in dealt.mapInArrow(_best_classes(best[2], classes.copy()), "id int, class int").collect():  # one row per listed word
                if group[r["id"]] == turn % groups:
                    classes[r["id"]] = r["class"]
            turn += 1
    discard(best[3])
    return best[1], best[2], said


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the texts (training and held-out ones) as ids and classes of their tokens and counts of the unlisted."""
    spark = docs.sparkSession
    split = docs.select("doc_id", "text", held_out().alias("held_out"))
    counted = split.where(~F.col("held_out")).select("text").mapInArrow(_count, "word string, n long")
    words = store(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    texts = split.where(~F.col("held_out")).count()
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = words.orderBy(F.desc("n"), "word").limit(LISTED).collect()
    listed = [r["word"] for r in top]
    counts = np.zeros(END + 1, np.int64)
    counts[: len(top)] = [r["n"] for r in top]
    counts[END] = texts
    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = store(split.mapInArrow(_coder(listed), f"block long, doc_id {kind}, held_out boolean, tokens binary, rare binary, words array<string>"), "coded")
    learn = coded.where("not held_out").select("tokens", "rare")
    start = np.concatenate([np.arange(LISTED) % CLUSTERS, [UNLISTED, END_CLASS]]).astype(np.int64)
    classes, pairs, _ = cluster(spark, learn.select("tokens"), start)

    profiles = learn.mapInArrow(_rare_profiles(classes), "hash long, at int, n long").groupBy("hash", "at").agg(F.sum("n").alias("n"))
    dealt = profiles.repartition(partitions(spark), "hash").sortWithinPartitions("hash")
    rare = store(dealt.mapInArrow(_rare_best(pairs), "hash long, class int"), "rare-classes")
    asked = coded.where("words is not null").select("block", F.explode("words").alias("word"))
    known = words.withColumn("hash", F.xxhash64("word")).join(rare, "hash", "left")
    found = asked.join(known.select("word", "n", "class"), "word", "left").select("block", F.xxhash64("word").alias("hash"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "class")
    tables = store(found.groupBy(F.col("block").alias("at")).agg(F.sort_array(F.collect_list(F.struct("hash", "n", "class"))).alias("words")), "block-words")

    types = np.bincount(classes[: len(listed)], minlength=CLASSES).astype(float)
    types[END_CLASS] = 1
    for r in rare.groupBy("class").count().collect():
        types[r["class"]] += r["count"]
    model = Model(listed, counts, classes, pairs, types, total + texts, distinct + (texts > 0))
    final = store(_classified(coded, tables, classes, model.unseen), "classified")
    for old in (coded, tables, rare, words):
        discard(old)
    model.pairs = _final_pairs(final)
    return model, final


def _classified(coded: DataFrame, tables: DataFrame, classes: np.ndarray, unseen: int) -> DataFrame:
    """doc_id, held_out, tokens (ids), classes (one byte for each token) and counts (of the unlisted ones) of each text."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        table = _table(right, unseen)
        found = [_token_classes(t, r, classes, table) for t, r in zip(left.column("tokens").to_pylist(), left.column("rare").to_pylist(), strict=True)]
        sides = [pa.array([x.tobytes() for x in column], pa.binary()) for column in ([c.astype(np.uint8) for _, c, _ in found], [n.astype("<i8") for _, _, n in found])]
        return pa.table([left.column("doc_id"), left.column("held_out"), left.column("tokens"), *sides], names=["doc_id", "held_out", "tokens", "classes", "counts"])

    texts = coded.where("words is null").select("block", "doc_id", "held_out", "tokens", "rare")
    schema = f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, held_out boolean, tokens binary, classes binary, counts binary"
    return texts.groupBy("block").cogroup(tables.groupBy("at")).applyInArrow(run, schema)


def _final_pairs(final: DataFrame) -> np.ndarray:
    """Class pairs of the training texts, with every word in its own class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            c = np.frombuffer(bytes([END_CLASS]) + b"".join(b.column("classes").to_pylist()), np.uint8).astype(np.int64)  # each text ends with an end
            total += np.bincount(c[:-1] * CLASSES + c[1:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    pairs = np.zeros(CLASSES * CLASSES)
    counted = final.where("not held_out").select("classes").mapInArrow(run, "cell int, n long")
    for r in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # one row per class pair
        pairs[r["cell"]] = r["n"]
    return pairs.reshape(CLASSES, CLASSES)


def _class_counts(spark: SparkSession, learn: DataFrame, classes: np.ndarray) -> DataFrame:
    parts = learn.mapInArrow(_profiles(classes), "key long, at binary, n binary")
    if partitions(spark) > MANY_TASKS:
        parts = parts.repartition(partitions(spark), "key", F.spark_partition_id() % MANY_TASKS).mapInArrow(_summed, "key long, at binary, n binary")
    return store(parts.repartition(partitions(spark), "key").mapInArrow(_summed, "key long, at binary, n binary"), "profiles")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    with freeing_shuffles(docs.sparkSession):
        model, final = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model.tables())
    floor, smooth = math.log10(model.n + SMOOTH * (model.v + 1)), SMOOTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            rows = []
            for tokens, classes, counts in zip(*[b.column(k).to_pylist() for k in ("tokens", "classes", "counts")], strict=True):
                ids, c, n = np.frombuffer(tokens, "<i4"), np.frombuffer(classes, np.uint8), np.frombuffer(counts, "<i8")
                other = ids == RARE
                mine, listed = np.log10(n + smooth), ids[~other]
                full = t["transition"][np.concatenate(([END_CLASS], c[:-1])), c].sum() + t["emission"][listed].sum() + mine.sum() - t["under"][c[other]].sum()
                base = t["base"][listed].sum() + mine.sum() - len(n) * floor
                rows.append((len(ids), int(t["known"][listed].sum() + (n > 0).sum()), base, full))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *arrays], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = final.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(model.n).cast("long"))
