"""What operators leave in the memory of Python workers, which live on for the next stage."""

import random

import pyarrow as pa

from oddsmith.llm import bpe
from oddsmith.llm.queries import PATTERN, RANKS


def test_bpe_leaves_no_pieces_and_no_database(spark):
    def left(batches):
        """Of the worker: its tokenizers, the pieces and runs they remember, and their open databases."""
        from oddsmith.llm import bpe as here

        for b in batches:
            known = list(here._TOKENIZERS.values())
            row = [len(known), sum(len(t.pieces) + len(t.runs) for t in known), sum(t.db is not None for t in known)]
            yield pa.RecordBatch.from_arrays([pa.array([x] * b.num_rows, pa.int64()) for x in row], ["known", "remembered", "open"])

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(50)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for _ in range(2):  # a worker's second task finds the first one's tokenizer
        assert {r["decoded"].decode() for r in bpe.encode(docs, RANKS, PATTERN).collect()} == set(texts)
    rows = spark.range(0, 64, 1, 16).mapInArrow(left, "known long, remembered long, open long").collect()
    assert any(r["known"] for r in rows)
    assert {(r["remembered"], r["open"]) for r in rows} == {(0, 0)}


def test_bpe_takes_a_batch_some_texts_at_a_time(monkeypatch):
    monkeypatch.setattr(bpe, "CHARS_PER_CALL", 10)
    texts = ["é" * 9, None, "a", "b" * 30, "", None, "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"])
    parts = [p.column("doc_id").to_pylist() for p in bpe._portions(batch)]
    assert parts == [[0, 1, 2], [3], [4, 5, 6]]
    assert not list(bpe._portions(batch.slice(0, 0)))
