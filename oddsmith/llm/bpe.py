"""Byte-level BPE by DuckDB recursive queries, one in-memory database per Python worker.

Token-position rows join the merge table; in every round each word's leftmost pair of least rank is contracted, until
no word has a pair left.  Ordered aggregation puts a word's tokens, and the bytes they stand for, together.  Texts are
split by the tokenizer's pattern, and every distinct piece of a partition is encoded once.  Rows leave a task some texts at a
time, and when it ends its database and the pieces it remembers go: Spark keeps workers, and the next stage needs their memory.

A piece of more than ``LONG`` bytes is encoded as overlapping chunks, all in the same rounds.  Two chunks are joined at a token
that both have at the same place, so every two neighbours of the result are neighbours in the encoding of some chunk; a
sequence of which that holds is the encoding of the whole.  Chunks that share no token are joined at a new chunk that starts at
a token of the first.

Edge cases: a null text counts as empty and has no tokens; long pieces take time in proportion to their length; repeated rows are encoded alike; an empty table gives an empty result; only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import giving_back

#: Rows of token positions that one recursive query starts from, most rounds it runs, rows that its rounds keep
#: together, and pieces that a task remembers.
ROWS_PER_QUERY = 150_000
ROUNDS_PER_QUERY = 64
ROWS_KEPT = 2_500_000
REMEMBERED = 300_000
#: Bytes of the longest piece that is contracted as a whole, and of the chunks of longer ones (each starts halfway through the last).
LONG, CHUNK = 1_024, 512
#: Characters of text that are encoded together.
CHARS_PER_CALL = 3_000_000
_ODD_SPACE = regex.compile(r"\s\s|^\s|\s$").search

_CONTRACT = """
with recursive rounds as (
    select w, pos, tok, next_pos, next_tok, 0 as round from start
    union all
    select r.w, r.pos,
           case when r.pos = c.pos then c.merged else r.tok end,
           case when r.pos = c.pos then c.after_pos else r.next_pos end,
           case when r.pos = c.pos then c.after_tok when r.next_pos = c.pos then c.merged else r.next_tok end,
           r.round + 1
    from rounds r join (
        select best.w, cast(best.pick & 4294967295 as integer) as pos, cast(best.pick >> 32 as integer) as merged, best.gone, g.next_pos as after_pos, g.next_tok as after_tok
        from (
            select r.w, min((m.merged << 32) | r.pos) as pick, arg_min(r.next_pos, (m.merged << 32) | r.pos) as gone
            from rounds r join merges m on (cast(r.tok as bigint) << 20) + r.next_tok = m.pair
            where r.round < {rounds} group by r.w
        ) best join rounds g on g.w = best.w and g.pos = best.gone
    ) c on r.w = c.w
    where r.pos <> c.gone
)
select w, pos, tok, next_pos, next_tok, round
from rounds join (select w, max(round) as round from rounds group by w) using (w, round)
"""


class Tokenizer:
    """A rank table, in DuckDB between :meth:`open` and :meth:`close`, and the pieces encoded meanwhile."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        merges = [
            ((ranks[b[:i]] << 20) + ranks[b[i:]], rank) for b, rank in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks
        ]
        merges = pa.table({"pair": pa.array([m[0] for m in merges], pa.int64()), "merged": pa.array([m[1] for m in merges], pa.int64())})
        vocab = pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": [b.decode("latin-1") for b in ranks]})
        self.tables = {"merges": merges, "vocab": vocab}
        self.db: duckdb.DuckDBPyConnection | None = None
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(b) for b in ranks]
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pieces: dict[str, tuple[bytes, bytes]] = {}
        self.runs: dict[str, tuple[bytes, bytes]] = {}

    def open(self) -> None:
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "allocator_flush_threshold": "1MB"})  # else its allocator keeps what queries free
        for name, table in self.tables.items():
            self.db.register("given", table)
            self.db.execute(f"create table {name} as select * from given")
            self.db.unregister("given")

    def close(self) -> None:
        """Forget the pieces and give back what the database holds."""
        self.pieces, self.runs = {}, {}
        self.db.close()
        self.db = None

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are new."""
        if len(self.pieces) > REMEMBERED:
            self.pieces = {p: v for p, v in self.pieces.items() if p in pieces}
        new, long = [], []
        for p in pieces:
            if p not in self.pieces:
                whole = p.encode()
                rank = self.ranks.get(whole)  # a piece that is a token as it stands is not contracted
                if rank is not None:
                    self.pieces[p] = rank.to_bytes(4, "little"), whole
                else:
                    (long if len(whole) > LONG else new).append((p, whole))
        found = self._contracted([whole for _, whole in new])
        self.pieces |= {p: found[whole] for p, whole in new}
        parts = {whole[k : k + CHUNK] for _, whole in long for k in range(0, len(whole), CHUNK // 2)}
        chunks = {c: np.frombuffer(v[0], "<u4") for c, v in self._contracted(list(parts)).items()}
        for p, whole in long:
            self.pieces[p] = self._stitched(whole, chunks)

    def _contracted(self, pieces: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """Ids and decoded bytes of each piece, some rows of positions at a time."""
        pieces = sorted(set(pieces), key=len)
        found: dict[bytes, tuple[bytes, bytes]] = {}
        while pieces:
            rows, k = 0, len(pieces)
            while k and rows < ROWS_PER_QUERY:
                k -= 1
                rows += len(pieces[k])
            self._encode(pieces[k:], found)
            del pieces[k:]
        return found

    def _stitched(self, data: bytes, chunks: dict[bytes, np.ndarray]) -> tuple[bytes, bytes]:
        """Ids and decoded bytes of a long piece, from those of its chunks."""

        def coded(at: int) -> tuple[np.ndarray, np.ndarray]:
            part = data[at : at + CHUNK]
            if part not in chunks:
                chunks[part] = np.frombuffer(self._contracted([part])[part][0], "<u4")
            ids = chunks[part]
            return ids, at + np.cumsum(self.size[ids]) - self.size[ids]

        at, done, out = 0, 0, []
        ids, starts = coded(0)
        while at + CHUNK < len(data):
            other = (at + CHUNK // 2) // (CHUNK // 2) * (CHUNK // 2)
            next_ids, next_starts = coded(other)
            _, i, j = np.intersect1d(starts, next_starts, return_indices=True)
            same = (ids[i] == next_ids[j]) & (starts[i] >= done)
            i, j = i[same], j[same]
            if len(i):
                k = int(np.argmin(np.abs(starts[i] - other - CHUNK // 4)))  # far from both chunks' ends
                cut, place = int(i[k]), int(j[k])
            else:
                for cut in np.flatnonzero(starts > max(done, at)).tolist()[::-1]:
                    other = int(starts[cut])
                    next_ids, next_starts = coded(other)
                    pair = data[int(starts[cut - 1]) : other + int(self.size[next_ids[0]])]
                    if next_ids[0] == ids[cut] or self._contracted([pair])[pair][0] == np.array([ids[cut - 1], next_ids[0]], "<u4").tobytes():
                        break
                else:
                    return self._contracted([data])[data]
                place = 0
            out.append(ids[np.searchsorted(starts, done) : cut])
            ids, starts, at, done = next_ids, next_starts, other, int(next_starts[place])
        out.append(ids[np.searchsorted(starts, done) :])
        whole = np.concatenate(out).astype("<u4")
        self.db.register("given", pa.table({"pos": np.arange(len(whole)), "tok": whole}))
        text = self.db.sql("select string_agg(bytes, '' order by pos) from given join vocab on tok = id").fetchall()[0][0]
        self.db.unregister("given")
        return whole.tobytes(), text.encode("latin-1")

    def _encode(self, pieces: list[bytes], into: dict[bytes, tuple[bytes, bytes]]) -> None:
        size = np.array([len(p) for p in pieces])
        first = np.cumsum(size) - size
        w = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        pos = (np.arange(len(w)) - np.repeat(first, size)).astype(np.int32)
        tok = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        last = np.append(w[1:] != w[:-1], True)
        start = pa.table({
            "w": w, "pos": pos, "tok": tok, "next_pos": pa.array(pos + 1, mask=last), "next_tok": pa.array(np.roll(tok, -1), mask=last)
        })
        while start.num_rows:
            rounds = max(2, min(ROUNDS_PER_QUERY, ROWS_KEPT // start.num_rows))
            self.db.register("start", start)
            self.db.execute(f"create or replace temp table state as {_CONTRACT.format(rounds=rounds)}")
            self.db.unregister("start")
            done = self.db.sql(
                "select w, list(tok order by pos) as ids, string_agg(bytes, '' order by pos) as text "
                f"from state join vocab on tok = id where round < {rounds} group by w"
            ).to_arrow_table().combine_chunks()
            if done.num_rows:
                ids = done.column("ids").combine_chunks()
                flat, at = ids.values.to_numpy().astype("<u4").tobytes(), (4 * ids.offsets.to_numpy()).tolist()
                for k, (i, text) in enumerate(zip(done.column("w").to_pylist(), done.column("text").to_pylist(), strict=True)):
                    into[pieces[i]] = flat[at[k] : at[k + 1]], text.encode("latin-1")
            start = self.db.sql(f"select w, pos, tok, next_pos, next_tok from state where round = {rounds}").to_arrow_table()

    def _join(self, pieces: list[str]) -> tuple[bytes, bytes]:
        if len(pieces) == 1:
            return self.pieces[pieces[0]]
        known = [self.pieces[p] for p in pieces]
        return b"".join([k[0] for k in known]), b"".join([k[1] for k in known])

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, the bytes they decode to) of each text.

        Every pattern of this family breaks before a lone space between two characters that are not white space, so
        texts are cut there and each distinct run is put through the pattern once.  A text with other runs of white
        space goes through the pattern as it is.  The runs' ids and bytes are gathered as Arrow arrays, where those
        of a text lie side by side.
        """
        whole = [_ODD_SPACE(t) is not None for t in texts]
        heads = [self.split(t if odd else t[: t.find(" ")] if " " in t else t) for t, odd in zip(texts, whole, strict=True)]
        cut = pc.split_pattern(pa.array(["" if odd else t for t, odd in zip(texts, whole, strict=True)], pa.large_string()), " ")
        first = cut.offsets.to_numpy()
        coded = cut.values.dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        runs = coded.dictionary.to_pylist()
        at[first[:-1]] = len(runs) + np.arange(len(texts))  # a text's first run has no space before it
        new = {r: self.split(" " + r) for r in runs if r not in self.runs}
        self.learn({p for pieces in (*new.values(), *heads) for p in pieces})
        for r, pieces in new.items():
            self.runs[r] = self._join(pieces)
        known = [*map(self.runs.__getitem__, runs), *map(self._join, heads)]
        sides = [pa.array(side, pa.large_binary()).take(pa.array(at)) for side in zip(*known, strict=True)]
        ends = [np.frombuffer(s.buffers()[1], np.int64)[first].tolist() for s in sides]
        data = [memoryview(s.buffers()[2] or b"") for s in sides]
        for k in range(len(texts)):
            ids, decoded = (bytes(d[e[k] : e[k + 1]]) for d, e in zip(data, ends, strict=True))
            yield ids, decoded
        if len(self.runs) > REMEMBERED:
            self.runs.clear()


_SQL = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
_TOKENIZERS: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One per worker process and rank file; the file is part of an installed package, so every worker has it."""
    if (path, pattern) not in _TOKENIZERS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _TOKENIZERS[path, pattern] = Tokenizer(ranks, pattern)
    return _TOKENIZERS[path, pattern]


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, some texts at a time."""
    start, chars = 0, 0
    for k, n in enumerate(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist(), 1):
        chars += n
        if chars >= CHARS_PER_CALL:
            yield batch.slice(start, k - start)
            start, chars = k, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _encoded(docs: DataFrame, path: str, pattern: str, names: list[str], types: list[pa.DataType], row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        bpe.open()
        gc.disable()  # nothing here makes cycles, and each pass over the remembered pieces is long
        try:
            yield from encoded(bpe, batches)
        finally:
            gc.enable()
            bpe.close()

    def encoded(bpe: Tokenizer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _portions(b):
                rows = [row(*x) for x in bpe.encode([t or "" for t in part.column("text").to_pylist()])]
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(giving_back(run), f"doc_id {kind}, " + ", ".join(f"{n} {_SQL[t]}" for n, t in zip(names, types, strict=True)))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded (bytes) of every whole text."""
    return _encoded(docs, path, pattern, ["n_tokens", "ids", "decoded"], [pa.int64(), pa.binary(), pa.binary()], lambda i, d: (len(i) // 4, i, d))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the sha-256 of the ids and of the decoded bytes."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _encoded(docs, path, pattern, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()], lambda i, d: (len(i) // 4, sha(i), sha(d)))
