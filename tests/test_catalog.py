"""Every query of the registry against its SQL, and hand-worked cases of the column functions."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsmith import catalog
from oddsmith.functions import scores
from oddsmith.operators import fits, gates, resampling, scoring
from oddsmith.streaming import rates

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return db


def rows_of(frame, columns):
    cell = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), tables.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got, sorted(got.columns)) == rows_of(want, sorted(got.columns))


def test_fees_and_returns(spark):
    fee = lambda rate, price: scores.fee_per_share(F.lit(rate), F.lit(price))
    ret = lambda rate, price, won, cent: scores.buy_return(F.lit(price), F.lit(won), fee(rate, price), F.lit(cent))
    got = spark.range(1).select(
        ret(0.05, 0.4, True, False), fee(0.05, 0.4), ret(0.07, 0.5, True, True), scores.round_up_cent(F.lit(0.03)), scores.round_up_cent(F.lit(0.030000001)), scores.round_up_cent(F.lit(0.0)),
        scores.fee_per_share(F.lit(0.05), F.lit(0.4), F.lit(False)), scores.fee_per_share(F.lit(0.05), F.lit(0.4), F.lit(True), F.lit(2.0)), scores.fee_per_share(F.lit(0.05), F.lit(0.4), F.lit(True), F.lit(None).cast("double")),
    ).first()
    assert [round(x, 6) for x in got] == [1.427184, 0.012, 0.920492, 0.03, 0.04, 0.0, 0.0, 0.00288, 0.012]


def test_cuts_are_those_of_the_sorted_list(spark):
    values = [(f"n{n}", float(v * v % 101)) for n in range(1, 58) for v in range(n)] + [("zero", 0.0), ("zero", None), ("zero", 3.0)]
    cuts = {r[0]: r[1] for r in scoring.quantile_cuts(spark.createDataFrame(values, "g string, v double"), "g", "v").collect()}
    for g in {k for k, _ in values}:
        known = sorted(v for k, v in values if k == g and v is not None)
        assert cuts[g] == [known[int(len(known) * i / 5) - 1] for i in range(1, 5)]


def test_sides_and_books(spark):
    half = spark.createDataFrame([(0.5, 0.0), (0.5, 1.0), (0.49, 0.0), (0.49, 1.0)], "p double, y double").select(scores.wrong_side(F.col("p"), F.col("y"))).collect()
    assert [r[0] for r in half] == [1.0, 0.0, 0.0, 1.0]
    books = [(0.4, 0.5, False), (0.4, None, False), (0.4, 0.5, True), (0.5, 0.4, False), (0.4, 0.4, False), (0.2, 0.71, False)]
    rows = spark.createDataFrame(books, "bid double, ask double, one boolean").withColumn("b", scores.book_status(F.col("bid"), F.col("ask"), F.col("one")))
    assert [r["b"] for r in rows.collect()] == ["ok", "one_sided_book", "one_sided_book", "degenerate_book", "degenerate_book", "degenerate_book"]
    side = rows.select(F.collect_list(scores.trade_side(F.lit(0.9), F.col("bid"), F.col("ask"), F.col("b")))).first()[0]
    assert side == ["Yes"]
    with pytest.raises(ValueError, match="one window"):
        scoring.one_window(spark.createDataFrame([("A",), ("B",)], "win string"))


def test_quarantine_rule(spark):
    cases = [(0.95, 0.55, 1, 1), (0.95, 0.90, 1, 0), (0.60, 0.50, 1, 0), (0.95, 0.55, 0, 0), (0.05, 0.60, 0, 1), (0.90, 0.70, 1, 1), (0.89, 0.70, 1, 0), (0.90, 0.71, 1, 0)]
    rows = spark.createDataFrame(cases, "p double, q double, y int, want int")
    assert all(r["want"] == r["got"] for r in rows.withColumn("got", scores.quarantined(F.col("p"), F.col("q"), F.col("y")).cast("int")).collect())


def walked(pairs, k=3):
    """Bin sizes and value by walking up the distinct values."""
    by = {}
    for p, y in pairs:
        by.setdefault(p, []).append(y)
    bins, now, done = [], [], 0
    for i, p in enumerate(sorted(by)):
        now += [(p, y) for y in by[p]]
        if len(bins) + 1 < k and done + len(now) >= round(len(pairs) * (len(bins) + 1) / k) and i + 1 < len(by):
            bins.append(now)
            done, now = done + len(now), []
    bins.append(now)
    return "/".join(str(len(b)) for b in bins), sum(abs(sum(p - y for p, y in b)) for b in bins) / len(pairs)


def test_ece_never_splits_ties(spark):
    random = __import__("random").Random(2)
    groups = {"ties": [(0.5, k % 2) for k in range(30)], "two": [(0.2 if k < 20 else 0.8, k % 3 == 0) for k in range(40)], "one": [(0.3, 1)]}
    groups |= {f"g{n}": [(random.choice([0.1, 0.25, 0.4, 0.55, 0.9, round(random.random(), 2)]), int(random.random() < 0.5)) for _ in range(n)] for n in range(1, 60, 3)}
    rows = spark.createDataFrame([(g, float(p), float(y)) for g, pairs in groups.items() for p, y in pairs], "g string, p double, y double")
    for r in gates.ece(rows, ["g"]).collect():
        bins, value = walked(groups[r["g"]])
        assert (r["bins"], round(r["ece"], 9)) == (bins, round(value, 9))
    said = spark.createDataFrame([(30, 0.10), (30, 0.101), (29, 0.0)], "n int, e double").select(gates.verdict(F.col("n"), F.col("e"))).collect()
    assert [r[0] for r in said] == ["pass", "fail", "insufficient"]


def test_isotonic_pools_like_one_pass(spark):
    random = __import__("random").Random(4)
    rows = [("ab"[k % 2], round(random.random(), 2), float(random.random() < 0.5)) for k in range(600)]
    got = fits.isotonic(spark.createDataFrame(rows, "g string, p double, y double"), ["g"]).collect()
    for g in "ab":
        values = sorted({p for k, p, _ in rows if k == g})
        sums = [(sum(1 for k, p, _ in rows if (k, p) == (g, v)), sum(y for k, p, y in rows if (k, p) == (g, v))) for v in values]
        # max-min formula: the fit at i is the greatest, over starts up to i, of the least mean over ends from i on
        n = len(values)
        mean = [[sum(s for _, s in sums[i : j + 1]) / max(1, sum(c for c, _ in sums[i : j + 1])) for j in range(n)] for i in range(n)]
        want = [max(min(mean[a][b] for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        steps = sorted((r["p"], r["fitted"]) for r in got if r["g"] == g)
        assert [round([f for p, f in steps if p <= v][-1], 9) for v in values] == [round(w, 9) for w in want]


def test_platt_has_no_gradient_left(spark):
    random = __import__("random").Random(6)
    rows = [(p := random.random(), float(random.random() < p * p)) for _ in range(500)]
    r = fits.platt(spark.createDataFrame([("g", *x) for x in rows], "g string, p double, y double"), ["g"]).first()
    x = np.log(np.clip([p for p, _ in rows], 1e-4, 1 - 1e-4) / (1 - np.clip([p for p, _ in rows], 1e-4, 1 - 1e-4)))
    left = np.array([y for _, y in rows]) - 1 / (1 + np.exp(-(r["a"] + r["b"] * x)))
    assert abs(left.sum()) < 1e-2 and abs((left * x).sum()) < 1e-2


def test_weights_are_poisson():
    w = np.concatenate([resampling.weights("w", str(k), 2000) for k in range(200)])
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02


def test_last_record_wins_and_probes_stand_in(spark):
    calls = spark.createDataFrame(
        [("m", "normal", 1, 10, "r1", "c1", 1, 0.1), ("m", "normal", 1, 11, "void", "c2", 1, 0.9), ("m", "normal", 1, 10, "r2", "c0", 1, 0.2), ("m", "memory_probe", 1, 1, "r1", "c4", 0, 0.7), ("m", "normal", 2, 1, "r1", "c5", 1, 0.4), ("m", "memory_probe", 2, 0, "r1", "c6", 1, 0.6)],
        "model string, mode string, row_id long, called_at long, run_id string, call_id string, final int, p double",
    )
    runs = spark.createDataFrame([("r1", "a", 0), ("r2", "b", 0), ("void", "c", 1)], "run_id string, started_at string, void int")
    final = gates.final_forecasts(calls, runs)
    assert sorted((r["mode"], r["row_id"], r["p"]) for r in final.collect()) == [("memory_probe", 2, 0.6), ("normal", 1, 0.2), ("normal", 2, 0.4)]
    assert sorted((r["row_id"], r["source"], r["p"]) for r in gates.probe_forecasts(final).collect()) == [(1, "normal_stand_in", 0.2), (2, "memory_probe", 0.6)]


def test_streams_give_what_batches_give(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    for name, frame, mode, want in (
        ("rates", rates.hourly_errors(stream(), "3650 days"), "complete", rates.hourly_errors(events)),
        ("last", rates.latest_of_log(stream(), ["user_id", "event_type"]), "complete", rates.latest_of_log(events, ["user_id", "event_type"])),
    ):
        running = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert running.awaitTermination(120)
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, want.collect())) != []


def test_sliding_errors_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    at = sorted(r["ts"] for r in rows.where("event_type = 'error'").collect())
    for r in rates.sliding_errors(rows).collect():
        assert r["errors"] == sum(0 <= (r["ts"] - t).total_seconds() < 3600 for t in at)
