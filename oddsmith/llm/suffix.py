"""Exact removal of repeated byte strings: content-picked anchors, then hash-compared suffix sorts with verification.

A string of ``length`` bytes (``LENGTH`` if not said otherwise) is assigned to the anchor in it: the ``GRAM``-byte piece whose hash is least.  Equal strings have
equal anchors at equal places, so only stretches of text around equal anchors need comparing, and strings around
anchors that occur once occur once.  Each text is cut into stretches (all strings of one anchor) and

1. stretches equal as a whole (by 128-bit digest) are repeats in all their strings;
2. of stretches with the same anchor but different bytes, one of each kind is compared: their suffixes from the anchor
   on are merge-sorted, and their prefixes up to it read backwards; a comparison finds the common length of two by binary search
   over prefix polynomial hashes.  Neighbours' common lengths bound where repeats can be; there, the strings' hashes
   are matched and each match is confirmed byte by byte;
3. an anchor with more kinds than ``KINDS_PER_TASK`` (a passage that very many texts share) is divided first: its stretches
   are divided into cells of neighbouring strings, whose anchor is all that a cell's strings have in common, until few
   kinds share one; a cell of one string is its own anchor.

Edge cases: a null text counts as empty; texts shorter than ``length`` lose nothing; equal texts, and so repeated rows, are
repeats of each other; a null or repeated ``doc_id`` does not matter, as spans are found per distinct text; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, freeing_shuffles, giving_back, partitions, store, text_of

LENGTH = 400
#: For the pipeline: no passage of over 50 words of ordinary prose is shorter.
PASSAGE = 240
GRAM = 64
KINDS_PER_TASK = 4_096
#: Bytes of one text that are cut into stretches at a time.
_STEP = 1 << 22

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base & (2**64 - 1), np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """S[i] = Σ data[j] * base^j over j < i, modulo 2^64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data))[0], out=out[1:])
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hash of every string of ``size`` bytes."""
    n = len(prefix) - size
    return _mixed((prefix[size:] - prefix[:n]) * _powers(n)[1])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    n = len(keys) - width + 1
    full = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(keys)] = keys
    rows = full.reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def stretches(data: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, anchor place, first and last start of the strings assigned to it) of a text, in parts."""
    for at in range(0, max(0, len(data) - length + 1), _STEP):
        part = np.frombuffer(data, np.uint8, min(len(data) - at, _STEP + length - 1), at)
        grams = window_hashes(prefix_hashes(part), GRAM)
        places = np.arange(len(grams), dtype=np.uint64)
        best = _least((grams & ~np.uint64((1 << 24) - 1)) | places, length - GRAM + 1) & np.uint64((1 << 24) - 1)
        best = best.astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
        last = np.append(first[1:], len(best)) - 1
        anchor = best[first]
        yield grams[anchor].view(np.int64), at + anchor, at + first, at + last


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


ROW = "anchor long, key binary, place long, first long, last long, seen boolean, bytes binary"


def _cut(length: int):
    """(anchor, kind, key, place, first, last) of every stretch; of texts with ``within``, of these parts only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        keys: list[bytes] = []
        kinds: list[bytes] = []

        def out() -> pa.RecordBatch:
            anchor, place, first, last = (np.concatenate(c) for c in zip(*parts, strict=True))
            arrays = [pa.array(anchor), pa.array(kinds, pa.binary()), pa.array(keys, pa.binary()), pa.array(place), pa.array(first), pa.array(last)]
            return pa.RecordBatch.from_arrays(arrays, ["anchor", "kind", "key", "place", "first", "last"])

        for b in batches:
            limits = b.column("within").to_pylist() if "within" in b.schema.names else [None] * len(b)
            for key, value, within in zip(b.column("key").to_pylist(), b.column("text").cast(pa.binary()), limits, strict=True):
                text = value.as_py()
                for start, end in [(0, len(text))] if within is None else [(w["start"], w["end"]) for w in within]:
                    for anchor, *places in stretches(text[start:end], length):
                        whole = (anchor, *[start + x for x in places])
                        for k in range(0, len(anchor), 20_000):  # a run of one byte has a stretch for each
                            part = tuple(x[k : k + 20_000] for x in whole)
                            parts.append(part)
                            keys += [key] * len(part[0])
                            kinds += [_digest(text[a : z + length]) for a, z in zip(part[2].tolist(), part[3].tolist(), strict=True)]
                            if len(keys) > 20_000:
                                yield out()
                                parts, keys, kinds = [], [], []
        if keys:
            yield out()

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in ROW.split(", ")])


def _taken(length: int):
    """The bytes of the stretches that are asked of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for key, value, asked in zip(b.column("key").to_pylist(), b.column("text").cast(pa.binary()), b.column("asked").to_pylist(), strict=True):
                text = value.as_py()
                for k in range(0, len(asked), 5_000):
                    rows += [(a["anchor"], key, a["place"], a["first"], a["last"], a["seen"], text[a["first"] : a["last"] + length]) for a in asked[k : k + 5_000]]
                    if len(rows) > 5_000:
                        yield _rows(rows)
                        rows = []
            yield _rows(rows)

    return run


def _divided(cell: int, length: int):
    """Stretches by ``cell`` neighbouring strings, counted from the anchor, whose new anchor is what all strings of a cell share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kinds = [], []
            for r in b.to_pylist():
                origin = r["place"] - (length - GRAM)  # no string of the anchor starts before
                for low in range(origin + (r["first"] - origin) // cell * cell, r["last"] + 1, cell):
                    first, last = max(low, r["first"]), min(low + cell - 1, r["last"])
                    data = r["bytes"][first - r["first"] : last - r["first"] + length]
                    core = data[max(0, low + cell - 1 - first) : low + length - first]
                    name = _digest(b"%d %d " % (r["anchor"], low - origin) + core)
                    rows.append((int.from_bytes(name[:8], "little", signed=True), r["key"], r["place"], first, last, False, data))
                    kinds.append(_digest(data))
            out = _rows(rows)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(kinds, pa.binary())], [*out.schema.names, "kind"])

    return run


class Suffixes:
    """Suffixes of one buffer, from given places up to given ends, compared by prefix hashes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, end: np.ndarray, group: np.ndarray):
        self.data, self.at, self.size, self.group = data, at, end - at, group
        self.prefix, self.inverse = prefix_hashes(data), _powers(len(data) + 1)[1]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common start of suffixes i and j, by binary search."""
        p, q = self.at[i], self.at[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = (self.prefix[p + mid] - self.prefix[p]) * self.inverse[p] == (self.prefix[q + mid] - self.prefix[q]) * self.inverse[q]
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j: by group, then bytes, a shorter one first."""
        n = self.common(i, j)
        ends_i, ends_j = n == self.size[i], n == self.size[j]
        next_i = self.data[np.minimum(self.at[i] + n, len(self.data) - 1)]
        next_j = self.data[np.minimum(self.at[j] + n, len(self.data) - 1)]
        by_bytes = np.where(ends_i | ends_j, ends_i & ~ends_j, next_i < next_j)
        return np.where(self.group[i] == self.group[j], by_bytes, self.group[i] < self.group[j])

    def sorted(self) -> np.ndarray:
        """Merge sort, all merges of a level at once: each suffix's place is its rank in its run plus that in the other."""
        n = len(self.at)
        order, run = np.arange(n), 1
        while run < n:
            place = np.arange(n)
            mine = place // run
            start, stop = np.minimum((mine ^ 1) * run, n), np.minimum(((mine ^ 1) + 1) * run, n)
            low, high, left = start.copy(), stop.copy(), mine % 2 == 0
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_]) // 2
                me, other = order[open_], order[mid]
                goes = np.where(left[open_], self.before(other, me), ~self.before(me, other))
                low[open_] = np.where(goes, mid + 1, low[open_])
                high[open_] = np.where(goes, high[open_], mid)
            target = (mine // 2) * 2 * run + (place - mine * run) + (low - start)
            merged = np.empty_like(order)
            merged[target] = order
            order, run = merged, run * 2
        return order

    def longest(self) -> np.ndarray:
        """The longest start that each suffix has in common with any other of its group."""
        order = self.sorted()
        best = np.zeros(len(order), np.int64)
        if len(order) > 1:
            a, b = order[:-1], order[1:]
            n = np.where(self.group[a] == self.group[b], self.common(a, b), 0)
            np.maximum.at(best, a, n)
            np.maximum.at(best, b, n)
        return best


def repeats(rows: list[tuple], length: int = LENGTH) -> list[tuple[bytes, int, int]]:
    """(key, start, end) of the repeated bytes in the unseen ones of some rows as in ``ROW``, with whole anchors."""
    data = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
    size = np.array([len(r[6]) for r in rows])
    off = np.cumsum(size) - size
    group = np.array([r[0] for r in rows], np.int64)
    place, first, last = (np.array([r[k] for r in rows], np.int64) for k in (2, 3, 4))
    at = off + place - first
    right = Suffixes(data, at, off + size, group).longest()
    mirrored = len(data) - at
    left = Suffixes(np.ascontiguousarray(data[::-1]), mirrored, len(data) - off, group).longest()
    low = np.maximum(first - place, -left)
    high = np.minimum(last - place, right - length)
    count = np.maximum(high - low + 1, 0)
    of = np.repeat(np.arange(len(rows)), count)
    shift = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    if not len(of):
        return []
    prefix, inverse = prefix_hashes(data), _powers(len(data) + 1)[1]
    p = at[of] + shift
    hashed = (prefix[p + length] - prefix[p]) * inverse[p]
    hashed = _mixed(hashed + _mixed(group[of].view(np.uint64) + shift.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
    order = np.lexsort((of, hashed))
    same = hashed[order[1:]] == hashed[order[:-1]]
    head = np.concatenate(([True], ~same))
    rep = order[np.flatnonzero(head)[np.cumsum(head) - 1]]  # each string is confirmed against the first of its hash
    second = np.append(order[1:], order[-1])
    partner = np.where(head, second, rep)
    matched = ~head | np.append(same, False)
    mate = np.full(len(of), -1)
    mate[order[matched]] = of[partner[matched]]
    seen = np.array([r[5] for r in rows])
    wanted = np.flatnonzero((mate >= 0) & ~seen[of])
    spans = []
    if len(wanted):
        breaks = np.flatnonzero((np.diff(wanted) != 1) | (np.diff(of[wanted]) != 0) | (np.diff(mate[wanted]) != 0)) + 1
        for run in np.split(wanted, breaks):
            i, j, s, e = int(of[run[0]]), int(mate[run[0]]), int(shift[run[0]]), int(shift[run[-1]])
            mine, theirs = (data[at[x] + s : at[x] + e + length] for x in (i, j))
            if np.array_equal(mine, theirs):
                spans.append((rows[i][1], int(place[i]) + s, int(place[i]) + e + length))
            else:  # hashes clashed: look at these strings themselves
                for t in range(s, e + 1):
                    here = data[at[i] + t : at[i] + t + length]
                    others = [x for x in np.flatnonzero((group == group[i]) & (low <= t) & (t <= high)) if x != i]
                    if any(np.array_equal(here, data[at[x] + t : at[x] + t + length]) for x in others):
                        spans.append((rows[i][1], int(place[i]) + t, int(place[i]) + t + length))
    return spans


def _compared(length: int):
    """Spans of repeated bytes, from rows sorted by anchor; some whole anchors at a time."""

    def out(some: list[tuple]) -> Iterator[pa.RecordBatch]:
        spans = repeats(some, length) if some else []
        if spans:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*spans, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["key", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held > 1 << 20 and r[0] != rows[-1][0]:
                    yield from out(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[6])
        yield from out(rows)

    return run


def _key() -> Column:
    """Digest of a text: 128 bits of its SHA-256."""
    return F.unhex(F.substring(F.sha2(text_of().cast("binary"), 256), 1, 32))


def spans(docs: DataFrame, length: int = LENGTH, within: str | None = None, made: list[DataFrame] | None = None) -> DataFrame:
    """(key, start, end): spans of repeated bytes of each distinct text, unmerged; ``key`` is the text's digest.

    ``within`` names a column with the parts (start, end) of a text that are looked at, the same for equal texts.  The
    tables that the result is read from are added to ``made``.
    """
    spark = docs.sparkSession
    made = [] if made is None else made

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(store(df, name))
        return made[-1]

    texts = docs.select(_key().alias("key"), text_of().alias("text"), *([F.col(within).alias("within")] if within else []))
    cut = store(texts.mapInArrow(_cut(length), "anchor long, kind binary, key binary, place long, first long, last long"), "stretches")
    anchors = cut.groupBy("anchor").agg(F.count("*").alias("_n")).where("_n > 1").select("anchor")
    shared = kept(cut.join(anchors, "anchor"), "shared")
    discard(cut)
    found, rows = _settle(shared, length, kept)
    ids = docs.select("doc_id", _key().alias("key")).groupBy("key").agg(F.min("doc_id").alias("_one"))
    asked = rows.groupBy("key").agg(F.collect_list(F.struct("anchor", "place", "first", "last", "seen", "many")).alias("asked")).join(ids, "key")
    source = docs.select("doc_id", text_of().alias("text"), _key().alias("_key"))
    joined = source.join(asked, (F.col("_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("_one")))
    many = rows.where("many").select("anchor").distinct()
    taken = kept(joined.select("key", "text", "asked").mapInArrow(_taken(length), ROW), "taken")
    hot = many.limit(1).count() > 0
    compare = [taken.join(many, "anchor", "left_anti") if hot else taken]
    todo = taken.join(many, "anchor", "left_semi") if hot else None
    cell = 1 << (length - GRAM - 1).bit_length() - 1  # no more than a stretch can have
    while todo is not None:
        halves = kept(todo.mapInArrow(_divided(cell, length), ROW + ", kind binary"), "cells")
        cell //= 2
        more, rest = _settle(halves, length, kept, ["bytes"])
        found = found.unionByName(more)
        rest = kept(rest, "kinds")
        compare.append(rest.where("not many").select(*taken.columns))
        todo = rest.where("many").select(*taken.columns)
        if not todo.limit(1).count():
            todo = None
    rows = compare[0]
    for more in compare[1:]:
        rows = rows.unionByName(more)
    dealt = rows.repartition(partitions(spark), "anchor").sortWithinPartitions("anchor")
    return found.unionByName(dealt.mapInArrow(_compared(length), "key binary, start long, end long"))


def _settle(stretched: DataFrame, length: int, kept: Callable[[DataFrame, str], DataFrame], extra: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Spans of the stretches that are equal as a whole, and one row of each kind that must still be compared."""
    at = ["key", "place", "first", "last", *(extra or [])]
    kinds = stretched.groupBy("anchor", "kind").agg(F.count("*").alias("n"), F.min(F.struct(*at)).alias("one"))
    kinds = kept(kinds, "kinds")
    whole = stretched.select("anchor", "kind", "key", "first", "last").join(kinds.where("n > 1").select("anchor", "kind"), ["anchor", "kind"])
    found = whole.select("key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    per = kinds.groupBy("anchor").agg(F.count("*").alias("_kinds"), F.count_if(F.col("n") == 1).alias("_unseen"))
    per = per.where("_kinds > 1 and _unseen > 0").select("anchor", (F.col("_kinds") > KINDS_PER_TASK).alias("many"))
    return found, kinds.join(per, "anchor").select("anchor", "one.*", (F.col("n") > 1).alias("seen"), "many")


def merged(spans_: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans put together."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans_):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def kept_bytes(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for start, end in removed:
        parts.append(text[at:start])
        at = end
    return b"".join([*parts, text[at:]])


def _with_spans(docs: DataFrame, columns: list[str], length: int, within: str | None = None, made: list[DataFrame] | None = None) -> DataFrame:
    """The documents' columns, as ``_given``, with the text (null as empty) in ``_text`` and its spans, if any, in ``_spans``."""
    per_text = spans(docs, length, within, made).distinct().groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_given"), text_of().alias("_text"), _key().alias("_key"))
    return keyed.join(per_text.hint("shuffle_hash"), F.col("_key") == F.col("key"), "left").select("_given", "_text", "_spans")


_RUNS = "array<struct<start:long,end:long>>"


def _with_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans put together, the text as it is."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        runs = [[{"start": s, "end": e} for s, e in merged([(x["start"], x["end"]) for x in found or []])] for found in b.column("_spans").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("_given").field("doc_id"), b.column("_text"), pa.array(runs, kind)], ["doc_id", "text", "runs"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The figures of each text without its spans; of texts with ``runs``, these counted too."""
    for b in batches:
        rows = []
        for value, found in zip(b.column("_text").cast(pa.binary()), b.column("_spans").to_pylist(), strict=True):
            text = value.as_py()
            gone = merged([(s["start"], s["end"]) for s in found or []])
            rows.append((len(text), sum(e - s for s, e in gone), len(gone), hashlib.sha256(kept_bytes(text, gone)).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        given = b.column("_given")
        if given.type.get_field_index("runs") >= 0:
            runs = given.field("runs").to_pylist()
            columns += [[sum(r["end"] - r["start"] for r in some) for some in runs], [len(some) for some in runs]]
            kinds += [pa.int64(), pa.int64()]
        arrays = [given.field("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *_FIGURES[: len(columns)]])


_FIGURES = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "n_passages"]


def digests(docs: DataFrame, length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the sha-256 of the kept bytes of every text.

    With ``passage``, which is at most ``length``, also n_passage_bytes (the bytes that strings of ``passage`` bytes
    cover that also start anywhere else) and n_passages (their maximal runs); these are counted, not removed.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if passage is None:
        return _with_spans(docs, ["doc_id"], length).mapInArrow(_digested, types)
    if passage > length:
        raise ValueError(f"passages of {passage} bytes are longer than strings of {length}")
    made: list[DataFrame] = []
    with freeing_shuffles(docs.sparkSession):
        found = store(_with_spans(docs, ["doc_id"], passage, made=made).mapInArrow(_with_runs, f"doc_id {kind}, text string, runs {_RUNS}"), "runs")
        for table in made:
            discard(table)
        # a repeated string of ``length`` bytes lies in such a run, and so does the other one
        holds = F.exists("runs", lambda r: r["end"] - r["start"] >= length)
        some = _with_spans(found.where(holds), ["doc_id", "runs"], length, "runs")
    given = F.struct("doc_id", "runs").alias("_given")
    rest = found.where(~holds).select(given, F.col("text").alias("_text"), F.lit(None).cast(_RUNS).alias("_spans"))
    return some.unionByName(rest).mapInArrow(_digested, f"{types}, n_passage_bytes long, n_passages long")


def remove_repeats(docs: DataFrame, length: int = PASSAGE) -> DataFrame:
    """The documents without their repeated bytes, with the columns they came with.

    A character that a span cuts through goes as a whole; a text in which nothing is left stays as an empty one.
    ``n_chars``, where there is one, follows the text.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for value, found in zip(b.column("_text").cast(pa.binary()), b.column("_spans").to_pylist(), strict=True):
                text = value.as_py()
                texts.append(kept_bytes(text, merged([(s["start"], s["end"]) for s in found])).decode("utf-8", "ignore") if found else text.decode())
            out = {c: b.column("_given").field(c) for c in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in out:
                out["n_chars"] = pa.array(map(len, texts), pa.int64()).cast(out["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return _with_spans(docs, names, length).mapInArrow(giving_back(run), docs.schema)
