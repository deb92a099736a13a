"""The corpus stage's links that come from prints, apart from those of bands."""

import pyarrow as pa
from pyspark.sql import functions as F

from oddsmith.llm import simhash


def pairs(n):
    for k in range(n):
        words = [f"p{k}w{i}" for i in range(400)]
        yield " ".join(words), " ".join(w if i % 200 != 50 or i > 200 * (k % 3) else "edit" for i, w in enumerate(words))


def test_prints_alone_join_what_is_near(spark, monkeypatch):
    def nothing(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([c.slice(0, 0) for c in b.columns], b.schema.names)

    monkeypatch.setattr(simhash, "_shared", nothing)  # no list of a band
    texts = list(pairs(30))
    far = {k for k, (a, b) in enumerate(texts) if (simhash.majority(simhash.shingles(a.encode())) ^ simhash.majority(simhash.shingles(b.encode()))).bit_count() > simhash.RADIUS}
    assert 0 < len(far) < 15
    rows = [(1000 * j + k, t) for k, pair in enumerate(texts) for j, t in enumerate(pair)]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(30)) | {1000 + k for k in far}


def test_nodes_of_near_prints_are_joined(spark):
    nodes = [(5, 0), (3, 0), (9, 0), (4, 0b1111), (8, 0b11111 << 50), (1, -1), (2, -1)]
    found = {(r["a"], r["b"]) for r in simhash.near_prints(spark.createDataFrame(nodes, "node long, fp long")).collect()}
    assert {frozenset(x) for x in found} == {frozenset(x) for x in [(3, 5), (3, 9), (3, 4), (1, 2)]}
    assert simhash.near_prints(spark.createDataFrame(nodes, "node long, fp long").where(F.lit(False))).count() == 0
