"""SimHash near-duplicates: byte-position inverted index, count filter, verification, connected components.

Two 64-bit fingerprints with at most four differing bits share at least four of their eight bytes.  The index therefore
lists each distinct fingerprint under every set of four byte positions with the bytes there: a pair is in a common list
exactly if its tally of shared positional bytes reaches four.  Candidates are verified by their Hamming distance.

A list is not expanded into pairs: a search from one member to all that it reaches yields at most one link per member,
which joins the same members as all pairs would.  Equal fingerprints are one entry, so copies cost nothing.

The corpus stage (:func:`keep_one`) calls texts copies whose distinct 5-word shingles have a Jaccard similarity of 0.8 or more.
It takes the same steps first: prints of those shingles, index, count filter, Hamming distance, then the real similarity, and
components.  Majority bits of texts at 0.8 differ in about 15 of 100, more than one bit a byte, so no radius that covers them
all guarantees a shared byte at any width; for the links that lie beyond the radius, bands of least hashes give further
candidates between groups that the prints have not joined, and each is verified.

Edge cases: a null text counts as empty; a text without words has fingerprint zero and links like any other; one with
fewer words than a shingle has is one shingle; a null ``doc_id`` takes part, and is a component's id only if it has no
other; repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import discard, giving_back, set_aside, store

WIDTH = 4
SEED = 42
RADIUS = 4
POSITIONS = list(combinations(range(8), 8 - RADIUS))

#: Near copies share 4 of 5 of their distinct shingles of so many words.
COPY_WIDTH = 5
COPY_SHARE = (4, 5)
#: Least hashes are compared in bands; two texts of similarity 0.8 share none with probability (1 - 0.8^6)^50 < 3e-7.
BANDS, BAND_ROWS = 50, 6
#: Lists of more members than this are compared by blocks of so many shingles; both ways find the same groups.
PAIRED, BLOCK = 48, 1 << 18
_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 1 << 32, BANDS * BAND_ROWS, np.uint32) | np.uint32(1)
_TERMS = _random.integers(0, 1 << 32, BANDS * BAND_ROWS, np.uint32)


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if more than half of the hashes have it; zero for none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Bit i is set if more than half of the shingles' hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    count = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    to = ends[min(width, len(words)) - 1 :]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts[:count].tolist(), to.tolist(), strict=True)), np.uint64, count)
    return majority(hashes)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fingerprint (a long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            prints = [fingerprint(t.as_py() or b"", width) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries: (set of positions and the bytes there, fingerprint)."""
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False)
        data = np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8).astype(np.int64)
        keys = [(np.int64(k) << 32) | (data[:, list(at)] << np.array([24, 16, 8, 0])).sum(axis=1) for k, at in enumerate(POSITIONS)]
        for key in keys:
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["key", "fp"])


def _forest(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what all verified pairs of a list would join; each member is reached once."""
    links, left = [], prints
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= RADIUS
            if near.any():
                found = left[near]
                left = left[~near]
                links.append((np.full(len(found), at), found))
                frontier.extend(found.tolist())
    return links


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a < b) from index entries that come sorted by key."""
    rest_key, rest_fp = np.empty(0, np.int64), np.empty(0, np.int64)

    def links(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key) < 2:
            return
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(first, len(key)))
        two = first[sizes == 2]
        a, b = fp[two], fp[two + 1]
        close = np.bitwise_count(a ^ b) <= RADIUS
        out = [(a[close], b[close])]
        for at, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            out += _forest(fp[at : at + n])
        a, b = np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    for batch in batches:
        key = np.concatenate([rest_key, batch.column("key").to_numpy(zero_copy_only=False)])
        fp = np.concatenate([rest_fp, batch.column("fp").to_numpy(zero_copy_only=False)])
        if not len(key):
            continue
        whole = int(np.searchsorted(key, key[-1]))  # the last list may go on in the next batch
        yield from links(key[:whole], fp[:whole])
        rest_key, rest_fp = key[whole:], fp[whole:]
    yield from links(rest_key, rest_fp)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``), enough to give all components."""
    listed = distinct.select("fp").mapInArrow(_listed, "key long, fp long")
    spark = distinct.sparkSession
    dealt = listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_verified, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.  Rounds of large star and small star."""
    now = store(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = store(small.where("u <> v").distinct(), "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links, itself included) of every row."""
    prints = store(fingerprints(docs, width), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = store(placed.join(ids, "root").select("fp", "component_id"), "components")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``COPY_WIDTH`` words; none for a text without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    count = max(1, len(words) - COPY_WIDTH + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    to = ends[min(COPY_WIDTH, len(words)) - 1 :]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts[:count].tolist(), to.tolist(), strict=True)), np.uint64, count))


def _band_keys(found: np.ndarray) -> np.ndarray:
    """One key for each band of least hashes."""
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    low = (found >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(low), 1 << 12):
        least = np.minimum(least, (low[None, k : k + (1 << 12)] * _FACTORS[:, None] + _TERMS[:, None]).min(axis=1))
    bands = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(bands[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``_node`` (a hash of the shingles), ``_fp`` (their print) and ``_keys`` to the rows."""
    for b in batches:
        nodes, prints, keys = [], [], []
        for t in b.column("text").cast(pa.binary()):
            found = shingles(t.as_py() or b"")
            nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63))
            prints.append(majority(found))
            keys.append(_band_keys(found).tobytes())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.binary())], [*b.schema.names, "_node", "_fp", "_keys"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nodes = b.column("_node").to_numpy(zero_copy_only=False)
        keys = np.frombuffer(b"".join(b.column("_keys").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(nodes, BANDS))], ["key", "node"])


def _lists(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """From rows sorted by key: the columns in runs of whole lists, with where each list starts and its size."""
    rest = [np.empty(0, np.int64) for _ in columns]

    def run(part: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate(([True], part[0][1:] != part[0][:-1])))
        return part, first, np.diff(np.append(first, len(part[0])))

    for b in batches:
        now = [np.concatenate([r, b.column(c).to_numpy(zero_copy_only=False)]) for r, c in zip(rest, columns, strict=True)]
        if not len(now[0]):
            continue
        whole = int(np.searchsorted(now[0], now[0][-1]))
        if whole:
            yield run([c[:whole] for c in now])
        rest = [c[whole:] for c in now]
    if len(rest[0]):
        yield run(rest)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists with more than one member."""
    for (key, node), _, sizes in _lists(batches, ["key", "node"]):
        many = np.repeat(sizes > 1, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(node[many])], ["key", "node"])


def _candidates(since: int, upto: int | None):
    """Pairs of members of a list that are not of one group yet: the pivots from ``since`` to ``upto`` with all members after them.

    Without ``upto``, only lists of up to ``PAIRED`` members; :func:`_blocks` has the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, node, root), first, sizes in _lists(batches, ["key", "node", "root"]):
            for at, n in zip(first.tolist(), sizes.tolist(), strict=True):
                members, roots = node[at : at + n], root[at : at + n]
                if (roots == roots[0]).all():
                    continue
                if upto is None and n > PAIRED:
                    continue
                for i in range(since, min(n - 1, n if upto is None else upto)):
                    other = members[i + 1 :][roots[i + 1 :] != roots[i]]
                    if len(other):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(other), members[i])), pa.array(other)], ["a", "b"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 1 << 16:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose shingles have a Jaccard similarity of ``COPY_SHARE`` at least."""
    for b in batches:
        keep = []
        for x, y in zip(b.column("x"), b.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both * COPY_SHARE[1] >= (len(x) + len(y) - both) * COPY_SHARE[0])
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of work for lists of more than ``PAIRED`` members of several groups: every two blocks of members meet in one.

    A block holds ``BLOCK`` shingles (or one member), so a unit is of bounded size however many members a list has.
    """
    for (key, node, root, size), first, sizes in _lists(batches, ["key", "node", "root", "size"]):
        for at, n in zip(first.tolist(), sizes.tolist(), strict=True):
            roots = root[at : at + n]
            if n <= PAIRED or (roots == roots[0]).all():
                continue
            block = (np.cumsum(size[at : at + n]) - 1) // BLOCK
            _, block = np.unique(block, return_inverse=True)
            starts = np.searchsorted(block, np.arange(block[-1] + 2))
            for i in range(block[-1] + 1):
                for j in range(i, block[-1] + 1):
                    unit = xxhash.xxh64_intdigest(b"%d %d %d" % (key[at], i, j)) - (1 << 63)
                    for k in {i, j}:
                        part = slice(at + starts[k], at + starts[k + 1])
                        m = starts[k + 1] - starts[k]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, unit)), pa.array(np.full(m, k != i)), pa.array(node[part]), pa.array(root[part])], ["unit", "second", "node", "root"])


def _unit_links(second: np.ndarray, node: np.ndarray, root: np.ndarray, sets: list[bytes]) -> list[tuple[int, int]]:
    """Links between members of a unit's two blocks (or within its one), enough to join what all its links would join."""
    size = np.array([len(x) // 8 for x in sets])
    _, ids = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
    off = np.cumsum(size) - size
    mark = np.zeros(ids.max(initial=0) + 1, np.int32)
    _, group = np.unique(root, return_inverse=True)
    large = np.argmax(np.bincount(group))
    two = second.any()
    found = []
    for i in np.flatnonzero(group != large).tolist():
        if group[i] == large:
            continue
        other = group != group[i]
        if two:
            other &= second != second[i]
        if not other.any() or not size[i]:
            continue
        mark[ids[off[i] : off[i] + size[i]]] = 1
        both = np.add.reduceat(np.append(mark[ids], 0), off)
        mark[ids[off[i] : off[i] + size[i]]] = 0
        near = np.flatnonzero(other & (size > 0) & (both * COPY_SHARE[1] >= (size + size[i] - both) * COPY_SHARE[0]))
        for g in np.unique(group[near]).tolist():  # one link joins a whole group
            found.append((int(node[i]), int(node[near[group[near] == g][0]])))
        if len(near):
            joined = np.isin(group, group[near])
            group[joined | (group == group[i])] = large if (group[near] == large).any() else group[i]
    return found


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the units, from rows sorted by unit."""
    rows: list[tuple] = []

    def out() -> Iterator[pa.RecordBatch]:
        second, node, root = (np.array(c) for c in list(zip(*rows, strict=True))[1:4])
        links = _unit_links(second, node, root, [r[4] for r in rows])
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for b in batches:
        for r in zip(*[b.column(c).to_pylist() for c in ("unit", "second", "node", "root", "set")], strict=True):
            if rows and r[0] != rows[-1][0]:
                yield from out()
                rows = []
            rows.append(r)
    if rows:
        yield from out()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t.as_py() or b"").tobytes() for t in b.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column("_node"), pa.array(sets, pa.binary())], ["node", "set"])


def near_prints(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (columns ``node`` and ``fp``) that join what prints at most ``RADIUS`` bits apart would join.

    The least node of a print stands for it in the links between prints, and is paired with the print's other nodes.
    """
    firsts = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    one, two = firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), firsts.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    between = links(firsts).join(one, "a").join(two, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    within = nodes.join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return between.unionByName(within)


def copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): the rows with ``_row`` and ``_node``, and (node, root) of the nodes that have near copies.

    Equal sets of shingles are one node.  Nodes whose prints are near are candidates, and so are nodes that share a band; the
    links are those whose real Jaccard similarity is high enough.  The prints' links come first.  A pair of a band is left
    untested only if links found before already put both in one group: first each list's least member is tested with the rest, then a few more, then all.  In that last round the lists of up to
    ``PAIRED`` members become pairs, which meet their sets by two joins; of longer ones, blocks of members meet, so a set
    travels once for each block instead of once for each pair.
    """
    spark = docs.sparkSession
    schema = StructType([*docs.schema.fields, StructField("_row", LongType()), StructField("_node", LongType()), StructField("_fp", LongType()), StructField("_keys", BinaryType())])
    rows = store(docs.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(giving_back(_marked), schema), "marked")
    nodes = rows.groupBy("_node").agg(F.first("_keys").alias("_keys"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = nodes.select("_node", "_keys").mapInArrow(giving_back(_banded), "key long, node long")
    lists = store(listed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(giving_back(_shared), "key long, node long"), "lists")
    near = store(near_prints(rows.select(F.col("_node").alias("node"), F.col("_fp").alias("fp")).distinct()), "near-prints")
    asked = lists.select(F.col("node").alias("_node")).union(near.select("a")).union(near.select("b")).distinct()
    firsts = rows.groupBy("_node").agg(F.min("_row").alias("_row")).join(asked, "_node", "left_semi").select("_row")
    sets = store(rows.select("_row", "_node", "text").join(firsts, "_row", "left_semi").select("_node", "text").mapInArrow(giving_back(_sets), "node long, set binary"), "sets")

    def similar(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        return store(sides.select("a", "b", "x", "y").mapInArrow(giving_back(_similar), "a long, b long"), "links")

    edges = similar(near)
    roots = components(edges)
    for since, upto in ((0, 1), (1, 8), (8, None)):
        placed = lists.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        dealt = placed.repartition(n, "key").sortWithinPartitions("key", "node")
        pairs = store(dealt.mapInArrow(giving_back(_candidates(since, upto)), "a long, b long").distinct(), "candidates")
        edges = edges.unionByName(similar(pairs))
        if upto is None:
            sized = placed.join(sets.select("node", (F.length("set") / 8).cast("long").alias("size")), "node").select("key", "node", "root", "size")
            units = sized.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(giving_back(_blocks), "unit long, second boolean, node long, root long")
            units = store(units, "units")
            met = units.join(sets, "node").select("unit", "second", "node", "root", "set").repartition(n, "unit").sortWithinPartitions("unit", "node")
            edges = edges.unionByName(store(met.mapInArrow(giving_back(_met), "a long, b long"), "links"))
        roots = components(edges)
    return rows, roots


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies (see :func:`copies`), with the columns it came with.

    It is the first by ``doc_id`` (nulls last), then by digests of the text and of the whole row; of equal rows it is any.
    """
    named = docs.columns
    docs = set_aside(docs, ["doc_id", "text"])
    rows, roots = copies(docs)
    order = F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text"),
        F.xxhash64(*docs.columns).alias("rest"), "_row",
    )
    least = rows.select("_node", order.alias("_order")).groupBy("_node").agg(F.min("_order").alias("_order"))
    grouped = least.join(roots, least["_node"] == roots["node"], "left").select(F.coalesce("root", "_node").alias("_root"), "_order")
    kept = store(grouped.groupBy("_root").agg(F.min("_order").alias("_order")).select(F.col("_order._row").alias("_row")), "kept")
    return rows.join(kept, "_row", "left_semi").select(*docs.columns).toDF(*named)
