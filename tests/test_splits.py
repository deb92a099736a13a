"""Event-grouped splits against a walk over the events, and what splits leak."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from oddsmith.operators import splits


def place(label, key):
    return int(hashlib.md5(f"{label}|{key}".encode()).hexdigest()[:12], 16)


def walked(events):
    """event -> drawn, one after another in each cell."""
    out, cells = {}, defaultdict(list)
    for event, cell, size in events:
        cells[cell].append((place("grouped", event), event, size))
    for found in cells.values():
        target, got, drawn = max(1, round(0.2 * sum(s for *_, s in found))), 0, set()
        for _, e, s in sorted(found):
            if abs(got + s - target) < abs(got - target):
                drawn.add(e)
                got += s
        drawn = drawn or {min((s, e) for _, e, s in found)[1]}
        out |= {e: e in drawn for _, e, _ in found}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_fill_is_that_of_a_walk(spark, seed, monkeypatch):
    monkeypatch.setattr(splits, "BINS", (4_096, 3, 16, 4_096)[seed])
    rng = random.Random(seed)
    events = [(i, f"c{i % 7}", rng.choice([1, 1, 2, 3, 7, 20])) for i in range(400)]
    events += [(1_000 + i, f"c{i}", 500) for i in range(3)] + [(2_000, "alone", 9), (2_001, "two", 4), (2_002, "two", 3), (2_003, "small", 1), (2_004, "small", 1)]
    frame = spark.createDataFrame(events, "event long, cell string, size long")
    got = splits.greedy_fill(frame, ["cell"], "event").collect()
    assert {r["event"]: r["drawn"] for r in got} == walked(events) and len(got) == len(events)
    near = Counter()
    for r in got:
        near[r["cell"]] += r["size"] * r["drawn"]
    most = {c: max(s for _, x, s in events if x == c) for _, c, _ in events}
    assert all(abs(near[r["cell"]] - r["target"]) <= most[r["cell"]] for r in got)


def test_events_go_to_their_majority_and_stay_whole(spark):
    rows = [("e1", "A", 1), ("e1", "A", 1), ("e1", "B", 1), ("e2", "B", 2), ("e2", "A", 2)] + [(f"x{i}", "A" if i % 2 else "B", i % 3) for i in range(200)]
    frame = spark.createDataFrame(rows, "event string, win string, bucket int")
    cells = {r["event"]: (r["win"], r["bucket"], r["size"]) for r in splits.majority_cells(frame, ["win", "bucket"], "event").collect()}
    assert cells["e1"] == ("A", 1, 3) and cells["e2"] == ("A", 2, 2)
    sides = defaultdict(set)
    for r in splits.grouped_split(frame, ["win", "bucket"], "event").collect():
        sides[r["event"]].add(r["grouped"])
    assert all(len(s) == 1 for s in sides.values()) and {"calibration", "test"} == set().union(*sides.values())


def test_leakage_and_samples(spark):
    rows = spark.createDataFrame([("w", "a", "test"), ("w", "a", "calibration"), ("w", "a", "test"), ("w", "b", "test"), ("w", "c", "calibration")], "win string, event string, split string")
    assert tuple(splits.leakage(rows, ["win"], "event", "split").first()) == ("w", 5, 3, 3, 2, 1, 2)
    keys = spark.createDataFrame([(i,) for i in range(900)], "k long")
    got = {r["k"] for r in splits.fixed_sample(keys, "k").collect()}
    assert got == set(sorted(range(900), key=lambda k: place("sample", k))[:500])
