"""Quality classifier: Naive Bayes features for a support vector machine, fitted by dual coordinate descent.

A text's features are indicators of hashed n-grams: three bytes in a row, and pairs of neighbouring words' shapes.  Each
is scaled by the log ratio of its smoothed counts in the two classes; on these a linear hinge-loss model is fitted, and
its margins are turned into probabilities on rows kept out of the fit.

The fit uses a bounded sample of the labelled rows (``SAMPLE`` of them, in hash order of their ids) and runs in one
task; every whole text is scored, in parallel.

Edge cases: a null text counts as empty and gets a score like any other; labels without id or value, and ids without a
document, are left out; without labelled rows of both classes every score is the smoothed share of label 1; repeated
rows are scored alike, and of a labelled id on several texts one is learnt from, the same on every run; an empty table gives an empty result; only ``doc_id`` and ``text`` of the documents are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that the model is fitted on.
SAMPLE = 6_000
BUCKETS = 1 << 18
SMOOTH = 1.0
COST = 1.0
EPOCHS = 12
THRESHOLD = 0.3

#: Longest run of one text that is turned into features at a time.
_STEP = 1 << 22
_SHAPES = bytes(
    ord("d") if chr(c).isdigit() and c < 128 else ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else c for c in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.S)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - 18)).astype(np.int32)


class Features:
    """Indices of the n-grams that a text has, each once."""

    def __init__(self) -> None:
        self.stamp = np.zeros(BUCKETS, np.int32)

    def __call__(self, text: bytes) -> np.ndarray:
        raw = np.frombuffer(b"  " + text + b" ", np.uint8)
        parts = []
        for k in range(0, len(raw) - 2, _STEP):
            a = raw[k : k + _STEP + 2].astype(np.uint32)
            parts.append(self._once(_mix((a[:-2] << 16) | (a[1:-1] << 8) | a[2:], 1)))
        parts.append(self._once(self._shapes(text)))
        return self._once(np.concatenate(parts))

    def _once(self, index: np.ndarray) -> np.ndarray:
        order = np.arange(len(index), dtype=np.int32)
        self.stamp[index] = order
        return index[self.stamp[index] == order]

    def _shapes(self, text: bytes) -> np.ndarray:
        words = text.split()
        known: dict[bytes, int] = {}
        codes = []
        for shape in text.translate(_SHAPES).split():
            code = known.get(shape)
            if code is None:
                code = known[shape] = hash_bytes(_RUN.sub(rb"\1", shape)) & 0xFFFFFF
            codes.append(code)
        codes = np.array(codes, np.uint64)
        same = np.array([a == b for a, b in zip(words, words[1:])], bool)
        pairs = (codes[:-1] << np.uint64(24)) | codes[1:] if len(codes) > 1 else codes[:0]
        pairs = np.where(same, np.uint64(7), pairs) if len(pairs) else pairs
        return np.concatenate([_mix(codes, 2), _mix(pairs, 3)])


def hash_bytes(b: bytes) -> int:
    return xxhash.xxh32_intdigest(b)


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and bias of min ½|w|² + Σ cost·max(0, 1 - y·(w·x + b)), where x has ``values`` at a row's indices."""
    w, b, alpha = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    xs = [values[r] for r in rows]
    square = np.array([x @ x + 1.0 for x in xs])
    order = np.random.RandomState(1)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            r, x = rows[i], xs[i]
            gradient = y[i] * (w[r] @ x + b) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * x
                b += step
                alpha[i] = new
    return w, b


def _platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, by Newton steps with Platt's smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        at = at - np.linalg.solve(hessian, x.T @ (p - goal) + 1e-3 * (at - [1.0, 0.0]))
    return float(max(at[0], 1e-3)), float(at[1])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, rows, labels = Features(), [], []
    for b in batches:
        rows += [features(t.as_py() or b"") for t in b.column("text").cast(pa.binary())]
        labels += b.column("quality").to_pylist()
    y = np.where(np.array(labels, float) > 0, 1.0, -1.0)
    scale, offset, weights, bias = 0.0, 0.0, np.zeros(BUCKETS), 0.0
    if min((y > 0).sum(), (y < 0).sum()) >= 2:
        held = np.arange(len(y)) % 4 == 3
        if min((y[held] > 0).sum(), (y[held] < 0).sum()) == 0 or min((y[~held] > 0).sum(), (y[~held] < 0).sum()) == 0:
            held = np.zeros(len(y), bool)
        counts = {s: np.full(BUCKETS, SMOOTH) for s in (1.0, -1.0)}
        for r, s in zip(rows, y, strict=True):
            counts[s][r] += 1
        ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
        fitted = np.flatnonzero(~held)
        share = (y[fitted] > 0).mean()
        cost = COST * np.where(y[fitted] > 0, 0.5 / share, 0.5 / (1 - share))
        norm = np.mean([ratio[r] @ ratio[r] for r in rows]) ** 0.5 or 1.0
        weights, bias = dual_coordinate_descent([rows[i] for i in fitted], ratio / norm, y[fitted], cost, EPOCHS)
        weights = weights * ratio / norm
        margins = np.array([weights[r].sum() + bias for r in rows])
        use = held if held.any() else np.ones(len(y), bool)
        scale, offset = _platt(margins[use], y[use])
    else:
        offset = float(np.log(((y > 0).sum() + 1) / ((y < 0).sum() + 1)))
    yield pa.RecordBatch.from_arrays(
        [pa.array([weights.astype("<f4").tobytes()], pa.binary()), *[pa.array([v], pa.float64()) for v in (bias, scale, offset)]], ["weights", "bias", "scale", "offset"]
    )


def held_out(folds: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias, slope and offset, from at most ``sample`` labelled rows that are not held out."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).select("doc_id", "quality")
    some = known.orderBy(F.md5(F.col("doc_id").cast("string")), "quality").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    # of an id that stands on several texts, the one whose digest is least
    rows = texts.groupBy("doc_id", "quality").agg(F.min(F.struct(F.md5(F.coalesce("text", F.lit("")).cast("binary")), "text")).alias("_one")).select("doc_id", "quality", "_one.text")
    model = rows.select("text", "quality", F.md5(F.col("doc_id").cast("string")).alias("at")).repartition(1).sortWithinPartitions("at")
    row = model.mapInArrow(_fit, "weights binary, bias double, scale double, offset double").first()
    if row is None:  # no labelled rows at all
        return np.zeros(BUCKETS, "<f4"), 0.0, 0.0, 0.0
    return np.frombuffer(row["weights"], "<f4"), row["bias"], row["scale"], row["offset"]


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""
    weights, bias, scale, offset = fit(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # one float per bucket: 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(), shared.value
        for b in batches:
            margins = np.array([w[features(t.as_py() or b"")].sum(dtype=np.float64) + bias for t in b.column("text").cast(pa.binary())], float)
            p = 1 / (1 + np.exp(-np.clip(scale * margins + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p)], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
