"""Step maps, recalibration, random cuts and dealt residuals against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsmith import catalog
from oddsmith.operators import fits, permutation, recalibration, resampling, stacking, surfaces

SF = "/root/testdata/sf0.001"


def test_steps_are_looked_up_like_searchsorted(spark):
    rng = np.random.default_rng(1)
    knots = {"a": np.unique(np.round(rng.random(300), 3)), "b": np.array([0.5]), "c": np.array([0.0, 0.25, 0.2500001, 1.0]), "d": np.unique(rng.random(40) / 2000 + 0.3)}
    steps = [(k, 1, float(p), 1, float(i)) for k, ps in knots.items() for i, p in enumerate(ps)]
    asked = [(k, 1, float(p)) for k, ps in knots.items() for p in [*rng.random(2_500), *ps, 0.0, 1.0, *(ps + 1e-12).clip(0, 1)]] + [("none", 1, 0.5)]
    rows = spark.createDataFrame(asked, "k string, f int, p double").withColumn("i", F.monotonically_increasing_id())
    got = fits.stepped(rows, spark.createDataFrame(steps, "k string, f int, p double, n long, fitted double"), ["k", "f"], "new").collect()
    assert len(got) == len(asked) - 1
    for r in got:
        ps = knots[r["k"]]
        assert r["new"] == min(max(int(np.searchsorted(ps, r["p"], side="right")) - 1, 0), len(ps) - 1)


def pooled(p, y):
    """Violators pooled over distinct values: knots and values."""
    blocks = []
    for v in np.unique(p):
        blocks.append([v, (p == v).sum(), y[p == v].sum()])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            _, n, s = blocks.pop()
            blocks[-1][1] += n
            blocks[-1][2] += s
    return np.array([b[0] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def test_isotonic_maps_across_folds(spark):
    rows = catalog._scored(spark, SF).select("win", "model", "event_id", F.round("p", 2).alias("p"), "q", "y")
    got = {(r["win"], r["model"]): r for r in recalibration.crossfitted(rows, ["win", "model"], "isotonic").collect()}
    plain = resampling.event_folds(rows, "event_id", 5).toPandas()
    assert len(got) == 20
    for key, part in plain.groupby(["win", "model"]):
        p, q, y, fold = (part[c].to_numpy() for c in ("p", "q", "y", "fold"))
        new = np.full(len(p), np.nan)
        for f in range(5):
            x, v = pooled(p[fold != f], y[fold != f])
            new[fold == f] = v[np.clip(np.searchsorted(x, p[fold == f], side="right") - 1, 0, len(v) - 1)]
        r = got[key]
        m, a, k = (np.mean((x - y) ** 2) for x in (p, new, q))
        assert (r["n"], r["brier"], r["brier_after"], r["brier_market"]) == (len(p), *(pytest.approx(v, abs=1e-6) for v in (m, a, k)))
        assert r["recovered"] is None if m <= k else r["recovered"] == pytest.approx((m - a) / (m - k), abs=1e-5)


def test_fits_need_rows(spark):
    rows = [("few", f"e{i}", 0.01 * i, 0.5, float(i % 2), "calibration" if i < 39 else "test") for i in range(99)] + [("many", f"e{i}", 0.005 * i, 0.4, float(i % 3 == 0), "calibration" if i < 60 else "test") for i in range(120)]
    frame = spark.createDataFrame(rows, "k string, event_id string, p double, q double, y double, split string")
    for method in ("isotonic", "platt"):
        assert [r["k"] for r in recalibration.split(frame, ["k"], method).collect()] == ["many"]


def test_random_cuts(spark):
    rng = np.random.default_rng(4)
    rows = [("g", i, float(np.round(rng.random(), 2)), float(rng.random()), float(rng.random() < 0.4)) for i in range(700)]
    frame = spark.createDataFrame(rows, "g string, row_id long, p double, q double, y double")
    r = permutation.random_cuts(frame, ["g"], "row_id", draws=40).first()
    cell = F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int")
    at = permutation.numbered(frame.withColumn("cell", cell), ["g", "cell"], "row_id").toPandas()
    whole = halves = 0.0
    drawn = np.zeros(40)
    part = lambda b: len(b) * (b["p"].mean() - b["y"].mean()) ** 2 / 700 if len(b) else 0.0
    for _, b in at.groupby("cell"):
        high = b["q"] > b["p"].mean()
        whole += part(b)
        halves += part(b[high]) + part(b[~high])
        for d in range(40):
            cut = permutation.permuted(b["_i"].to_numpy(), len(b), d) < high.sum()
            drawn[d] += part(b[cut]) + part(b[~cut])
    assert tuple(r)[1:] == pytest.approx((700, whole, halves, drawn.mean(), drawn.min(), drawn.max()), abs=1e-6)


def test_dealt_residuals(spark):
    rows = catalog._scored(spark, SF).where("win = 'B'")
    draws = 6
    got = {r["statistic"]: tuple(r)[2:7] for r in surfaces.permuted_null(rows, draws).collect()}
    wide = stacking.common(rows, ["q", "y", "band"]).orderBy("row_id").toPandas()
    q, y, band, ps, models = wide["q"].to_numpy(), wide["y"].to_numpy(), wide["band"].to_numpy(), np.stack(wide["ps"]), wide["models"][0]
    base = np.stack([np.polyval(np.polyfit(q, ps[:, j], 1), q) for j in range(len(models))], axis=1)
    left = ps - base
    numbers = permutation.numbered(stacking.common(rows, ["band"]), ["win", "band"], "row_id").toPandas().set_index("row_id")
    i, n = numbers.loc[wide["row_id"]]["_i"].to_numpy(), numbers.loc[wide["row_id"]]["_n"].to_numpy()
    labels = {r["m"]: r["l"] for r in spark.createDataFrame([(m,) for m in models], "m string").select("m", F.pmod(F.xxhash64("m"), F.lit(1 << 30)).alias("l")).collect()}
    found = []
    for d in range(draws):
        s = np.empty_like(ps)
        for j, m in enumerate(models):
            for b in np.unique(band):
                own = np.nonzero(band == b)[0]
                to = permutation.permuted(i[own], int(n[own[0]]), d, labels[m])
                where = {v: k for k, v in zip(own, i[own])}
                for k, t in zip(own, to):
                    s[where[t], j] = np.clip(base[where[t], j] + left[k, j], 0.01, 0.99)
        found.append(stacking.of_sums(stacking.statistics(q, y, s), len(models)))
    for k, name in enumerate(("departure_r", "residual_r", "both_wrong", "both_wrong_market_right")):
        v = np.sort([f[k] for f in found])
        assert got[name][0] == len(q) and got[name][2:] == pytest.approx((v.mean(), v[0], v[5]), abs=2e-6)
