"""Scores of forecasts, depth buckets and the summaries over them.

Summaries go through one row of sums per event first, so that event counts need no distinct pass over the forecasts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.functions import scores
from oddsmith.functions.scores import r6
from oddsmith.operators import stacking

#: Logarithmic bins per unit that narrow down where a rank lies.
BINS = 64
#: The same for ranks.
RANK_BINS = 1_024
#: A table of cuts has one row per window: never more than this.
MOST_WINDOWS = 1_000
ARMS = ("all", "news")
NO_SKILL = ("always_yes", "always_no", "cheaper_side", "market_favored", "coin_flip")


def scored(rows: DataFrame) -> DataFrame:
    """Add error, Brier scores, edge over the market, band and direction."""
    p, q, y = F.col("p"), F.col("q"), F.col("y")
    out = rows.withColumns({"error": p - y, "brier_model": (p - y) * (p - y), "brier_market": (q - y) * (q - y), "band": scores.band_of(q), "direction": scores.direction(p, q)})
    return out.withColumns({"brier_edge": F.col("brier_market") - F.col("brier_model"), "log_depth": F.when(F.col("depth_usd") > 0, F.ln("depth_usd"))})


def traded(rows: DataFrame, stake: float = 1.0) -> DataFrame:
    """Add side and reason, and for forecasts that trade cost, whether the side won, fee, and return with and without it."""
    p, bid, ask, book = (F.col(c) for c in ("p", "bid", "ask", "book"))
    rows = rows.withColumns({"side": scores.trade_side(p, bid, ask, book), "reason": scores.trade_reason(p, bid, ask, book)})
    side = F.col("side")
    rows = rows.withColumns({"cost": F.when(side == "Yes", ask).when(side == "No", 1 - bid), "won": F.when(side.isNotNull(), (side == "Yes") == (F.col("y") == 1))})
    cost, won = F.col("cost"), F.col("won")
    rows = rows.withColumn("fee", scores.fee_per_share(F.col("fee_rate"), cost, F.col("fees_enabled"), F.col("fee_exponent")))
    rows = rows.withColumn("ret", scores.buy_return(cost, won, F.col("fee"), F.col("venue") == "kalshi", stake))
    return rows.withColumn("ret_nofee", F.try_divide(F.when(won, 1.0).otherwise(0.0), cost) - 1)


def with_arms(rows: DataFrame) -> DataFrame:
    """Each row once in arm ``all`` and, if it had news, once more in arm ``news``."""
    return rows.select("*", F.explode(F.when(F.col("news_available"), F.array(*map(F.lit, ARMS))).otherwise(F.array(F.lit("all")))).alias("arm"))


def with_views(rows: DataFrame) -> DataFrame:
    """Each row in its window's view, and rows of window A with a live book once more in ``A_live``."""
    live = (F.col("win") == "A") & F.col("live_book")
    return rows.select("*", F.explode(F.when(live, F.array(F.lit("A"), F.lit("A_live"))).otherwise(F.array("win"))).alias("view"))


def one_window(rows: DataFrame, column: str = "win") -> DataFrame:
    """The rows as they are; reading them fails if they span more than one window."""
    first, last = rows.agg(F.min(column), F.max(column)).first()
    if first != last:
        raise ValueError(f"rows span windows {first} to {last}; bucket comparisons must stay inside one window")
    return rows


def quantile_cuts(rows: DataFrame, group: str, value: str, parts: int = 5) -> DataFrame:
    """(group, cuts): the upper edges of the first parts - 1 of equal groups: values at 1-based ranks n * i / parts, exact.

    Rank 0, which fewer than ``parts`` values give, is the largest value.  A histogram over logarithmic bins, of bounded
    size, tells in which bin a rank lies; only those bins' distinct values are counted.
    """
    size = F.col(value)
    binned = rows.where(size.isNotNull()).select(group, value, F.when(size > 0, F.floor(F.ln(F.when(size > 0, size)) * BINS)).otherwise(-(10**6)).alias("_bin"))
    counts = binned.groupBy(group, "_bin").agg(F.count("*").alias("_n"))
    upto, whole = Window.partitionBy(group).orderBy("_bin"), Window.partitionBy(group)
    counts = counts.select("*", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_all"))
    rank = lambda i: F.expr(f"_all * {i} div {parts}")
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.when(rank(i) == 0, F.col("_all")).otherwise(rank(i)).alias("rank")) for i in range(1, parts)])
    wanted = counts.select(group, "_bin", "_before", "_n", F.explode(at).alias("_r")).where("_r.rank > _before and _r.rank <= _before + _n")
    wanted = wanted.select(group, "_bin", "_r.i", (F.col("_r.rank") - F.col("_before")).alias("_k"))
    values = binned.join(F.broadcast(wanted.select(group, "_bin").distinct()), [group, "_bin"]).groupBy(group, "_bin", value).agg(F.count("*").alias("_n"))
    reach = F.sum("_n").over(Window.partitionBy(group, "_bin").orderBy(value))
    found = values.select("*", reach.alias("_upto")).join(F.broadcast(wanted), [group, "_bin"]).where("_k <= _upto and _k > _upto - _n")
    return found.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("i", value)))[value].alias("cuts"))


def with_bucket(rows: DataFrame, cuts: DataFrame, group: str, value: str) -> DataFrame:
    """Add ``bucket``, 1 to parts; a value equal to a cut goes below it.

    One row of cuts per group: if there are few they are worked out once, here, and broadcast; else they are joined as they are.
    """
    found = cuts.limit(MOST_WINDOWS + 1).collect()
    if len(found) <= MOST_WINDOWS:
        cuts = F.broadcast(rows.sparkSession.createDataFrame(found, cuts.schema))
    return rows.join(cuts, group).withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col(value))) + 1).drop("cuts")


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of rows, events and trades, and mean scores and returns, by key, from traded rows.

    The means combine before the shuffle, to one row per key and task; events are counted from their distinct keys alone.
    """
    mean = {"brier_model": "brier_model", "brier_market": "brier_market", "brier_edge": "brier_edge", "mean_p": "p", "mean_q": "q"}
    money = {"ret": "ret", "ret_nofee": "ret_nofee", "mean_fee": "fee", "win_rate": "won"}
    n, paid = lambda c: F.count_if(F.col("reason") == c), F.col("reason") == "traded"
    means = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), n("traded").alias("n_traded"), n("one_sided_book").alias("n_one_sided"), n("degenerate_book").alias("n_degenerate"),
        F.count_if(paid & (F.col("fee") > 0)).alias("n_fee_charged"),
        *[r6(F.avg(c)).alias(k) for k, c in mean.items()], *[r6(F.avg(F.when(paid, F.col(c).cast("double")))).alias(k) for k, c in money.items()],
    )
    events = rows.select(*keys, "event_id").distinct().groupBy(*keys).agg(F.count("*").alias("n_events"))
    return means.join(events, keys)


def no_skill(rows: DataFrame) -> DataFrame:
    """Each moment under each strategy that draws no coin: columns strategy and p (1 buys Yes, 0 buys No)."""
    cheaper = F.when(F.col("ask").isNull() | F.col("bid").isNull() | (F.col("ask") <= 1 - F.col("bid")), 1.0).otherwise(0.0)
    favored = F.when(F.col("q") > 0.5, 1.0).when(F.col("q") < 0.5, 0.0).otherwise(0.5)
    return rows.select("*", F.inline(F.array(*[F.struct(F.lit(n).alias("strategy"), p.alias("p")) for n, p in zip(NO_SKILL, (F.lit(1.0), F.lit(0.0), cheaper, favored), strict=False)])))


def coins(row: str, draws: int) -> np.ndarray:
    """A bit for each draw of a row's coin: the first of each hexadecimal digit of MD5s of its key."""
    blocks = b"".join(hashlib.md5(f"coin|{k}|{row}".encode()).digest() for k in range(-(-draws // 32)))
    return np.unpackbits(np.frombuffer(blocks, np.uint8)).reshape(-1, 4)[:draws, 0].astype(np.float64)


def floors(rows: DataFrame, keys: list[str], draws: int = 200) -> DataFrame:
    """Mean return of each no-skill strategy by key; the coin's is the mean over draws of each draw's mean, with its least and greatest draw.

    A coin only chooses between a row's two trades, so both are priced once, and a draw's sums are those of all No trades plus, for each coin that shows
    Yes, the row's difference: one product of bits and differences per batch.
    """
    fixed = traded(no_skill(rows)).where("reason = 'traded'").groupBy(*keys, "strategy").agg(F.avg("ret").alias("m"), F.count("*").alias("n"), F.lit(0).alias("draw"))
    rows = rows.select(*keys, "row_id", "book", "y", "venue", "fee_rate", "fees_enabled", "fee_exponent", F.col("ask").alias("_a"), (1 - F.col("bid")).alias("_b"))
    fee = lambda c: scores.fee_per_share(F.col("fee_rate"), F.col(c), F.col("fees_enabled"), F.col("fee_exponent"))
    rows = rows.withColumns({"_fa": fee("_a"), "_fb": fee("_b"), "_ok": F.col("book") == "ok", "_cent": F.col("venue") == "kalshi"})
    yes = F.when(F.col("_ok") & (F.col("_a") < 1), scores.buy_return(F.col("_a"), F.col("y") == 1, F.col("_fa"), F.col("_cent")))
    no = F.when(F.col("_ok") & (F.col("_b") < 1), scores.buy_return(F.col("_b"), F.col("y") != 1, F.col("_fb"), F.col("_cent")))
    sums = lambda r: [F.coalesce(r, F.lit(0.0)), r.isNotNull().cast("double")]
    both = rows.select(F.struct(*keys).alias("_key"), F.col("row_id").cast("string").alias("row"), F.array(*sums(yes)).alias("yes"), F.array(*sums(no)).alias("no")).withColumn("_text", F.to_json("_key"))

    def measure(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        up, down = stacking._matrix(b.column("yes")), stacking._matrix(b.column("no"))
        heads = np.stack([coins(r, draws) for r in b.column("row").to_pylist()])
        yield 0, (down.sum(axis=0) + heads.T @ (up - down)).ravel()

    kind = both.schema["_key"].dataType.simpleString()
    drawn = stacking.summed(both.select("_text", "row", "yes", "no"), "_text", measure).select(F.from_json("_text", kind).alias("_key"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: F.slice("v", i * 2 + 1, 2))).alias("draw", "_s"))
    drawn = drawn.select("_key.*", "draw", F.get("_s", F.lit(0)).alias("_ret"), F.round(F.get("_s", F.lit(1))).cast("long").alias("n")).where("n > 0")
    coin = drawn.select(*keys, F.lit("coin_flip").alias("strategy"), (F.col("_ret") / F.col("n")).alias("m"), "n", "draw")
    means = fixed.unionByName(coin)
    return means.groupBy(*keys, "strategy").agg(F.sum("n").alias("n"), r6(F.avg("m")).alias("ret"), r6(F.min("m")).alias("least"), r6(F.max("m")).alias("greatest"))


def cells(rows: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """One row per equal-width bin of p: n, sum of p, sum of y."""
    cell = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*keys, cell.alias("cell")).agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"))


def bin_table(rows: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Mean forecast, outcome rate and share of the reliability of each bin."""
    n, whole = F.col("n"), Window.partitionBy(*keys)
    gap = F.col("sp") / n - F.col("sy") / n
    return cells(rows, keys, bins).select(*keys, "cell", "n", r6(F.col("sp") / n).alias("mean_p"), r6(F.col("sy") / n).alias("rate"), r6(n * gap * gap / F.sum("n").over(whole)).alias("contribution"))


def murphy(rows: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Reliability, resolution and uncertainty over equal-width bins of p, from one row per bin."""
    total, n = Window.partitionBy(*keys), F.col("n")
    by_bin = cells(rows, keys, bins).withColumn("base", F.sum("sy").over(total) / F.sum("n").over(total))
    gap, lift = F.col("sp") / n - F.col("sy") / n, F.col("sy") / n - F.col("base")
    share = lambda x: r6(F.sum(x) / F.sum(n))
    base: Column = F.first("base")
    return by_bin.groupBy(*keys).agg(F.sum("n").alias("n"), share(n * gap * gap).alias("rel"), share(n * lift * lift).alias("res"), r6(base * (1 - base)).alias("unc"))


def skill(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Skill against the base rate, and Brier scores of the market and of saying a half or the base rate each time."""
    each = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("y").alias("base"), F.avg("brier_model").alias("m"), F.avg("brier_market").alias("q"))
    naive = F.col("base") * (1 - F.col("base"))
    return each.select(*keys, "n", r6(F.col("m")).alias("brier_model"), r6(F.col("q")).alias("brier_market"), r6(naive).alias("brier_base"), F.lit(0.25).alias("brier_half"), r6(1 - F.try_divide(F.col("m"), naive)).alias("skill"), r6(1 - F.try_divide(F.col("q"), naive)).alias("skill_market"))


def met_pairs(rows: DataFrame, keys: list[str], row: list[str], values: list[str]) -> DataFrame:
    """Each two forecasts of a row, models a < b, with the values of both (``x_`` and ``z_``).

    The forecasts of a row meet in one array of at most the roster's length, so pairs need no join.
    """
    met = rows.groupBy(*keys, *row).agg(F.sort_array(F.collect_list(F.struct("model", *values))).alias("_all"))
    pair = lambda a, b: F.struct(a["model"].alias("a"), b["model"].alias("b"), *[s[v].alias(f"{n}_{v}") for n, s in (("x", a), ("z", b)) for v in values])
    return met.select(*keys, *row, F.inline(F.flatten(F.transform("_all", lambda a: F.transform(F.filter("_all", lambda b: b["model"] > a["model"]), lambda b: pair(a, b))))))


def pair_errors(rows: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """For each pair of models: common rows, correlation of errors, how often both are wrong and how often that is expected."""
    rows = rows.withColumns({"w": scores.wrong_side(F.col("p"), F.col("y")), "market_right": scores.wrong_side(F.col("q"), F.col("y")) == 0})
    each = met_pairs(rows, keys, ["row_id"], ["error", "w", "market_right"])
    both, right = F.col("x_w") * F.col("z_w"), F.col("x_market_right")
    moments = each.groupBy(*keys, "a", "b").agg(
        F.count("*").alias("n"), F.covar_samp("x_error", "z_error").alias("c"), F.stddev_samp("x_error").alias("sx"), F.stddev_samp("z_error").alias("sz"),
        F.avg(both).alias("bw"), (F.avg("x_w") * F.avg("z_w")).alias("ex"), F.avg(F.when(right, both)).alias("br"),
    )
    return moments.where(F.col("n") >= least).select(
        *keys, "a", "b", "n", r6(F.try_divide("c", F.col("sx") * F.col("sz"))).alias("r"), r6(F.col("bw")).alias("both_wrong"),
        r6(F.col("ex")).alias("both_wrong_expected"), r6(F.try_divide("bw", "ex")).alias("ratio"), r6(F.col("br")).alias("both_wrong_market_right"),
    )


def paired(rows: DataFrame, keys: list[str], reference: str) -> DataFrame:
    """Each other model against a reference model on their common rows: mean Brier difference and share of rows won."""
    pairs = met_pairs(rows, keys, ["row_id"], ["brier_model"])
    mine = F.when(F.col("a") == reference, F.col("x_brier_model")).otherwise(F.col("z_brier_model"))
    theirs = F.when(F.col("a") == reference, F.col("z_brier_model")).otherwise(F.col("x_brier_model"))
    pairs = pairs.where((F.col("a") == reference) | (F.col("b") == reference)).select(*keys, F.when(F.col("a") == reference, F.col("b")).otherwise(F.col("a")).alias("model"), (theirs - mine).alias("d"))
    return pairs.groupBy(*keys, "model").agg(F.count("*").alias("n"), r6(F.avg("d")).alias("difference"), r6(F.avg((F.col("d") < 0).cast("int"))).alias("better"))


def answered_by_all(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Row counts and mean scores over the rows that every model present in the group has forecast (relational division)."""
    models = rows.groupBy(*keys).agg(F.count_distinct("model").alias("_models"))
    per = rows.groupBy(*keys, "row_id").agg(F.count("*").alias("_by"), F.avg("p").alias("p"), F.first("y").alias("y"), F.avg("brier_model").alias("brier"))
    full = per.join(models, keys).withColumn("full", F.col("_by") == F.col("_models"))
    return full.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if("full").alias("n_common"), F.first("_models").alias("n_models"), r6(F.avg(F.when(F.col("full"), F.col("brier")))).alias("brier_common"))


def shrinkage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """p = a + b q by least squares, and the fixed point a / (1 - b)."""
    fit = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("p", "q").alias("_b"), F.regr_intercept("p", "q").alias("_a"))
    return fit.select(*keys, "n", r6(F.col("_a")).alias("a"), r6(F.col("_b")).alias("b"), r6(F.try_divide("_a", 1 - F.col("_b"))).alias("fixed_point"))


def latest(rows: DataFrame, keys: list[str], order: list[str], keep: list[str] | None = None) -> DataFrame:
    """The last record of each key, by an aggregate that combines before the shuffle; of ``keep``, where that is given, and not of all columns."""
    rest = [c for c in (rows.columns if keep is None else keep) if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*keys, "_last.*")


def ensembles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Brier scores of the mean, the median and the log-odds mean of a row's forecasts."""
    each = rows.groupBy(*keys, "row_id").agg(F.first("y").alias("y"), F.avg("p").alias("mean"), F.median("p").alias("median"), F.avg(F.ln(F.col("p") / (1 - F.col("p")))).alias("_o"))
    each = each.withColumn("odds", scores.sigmoid(F.col("_o")))
    return each.groupBy(*keys).agg(F.count("*").alias("n"), *[r6(F.avg((F.col(c) - F.col("y")) * (F.col(c) - F.col("y")))).alias(f"brier_{c}") for c in ("mean", "median", "odds")])


def extremizing(rows: DataFrame, keys: list[str], factors: tuple[int, int, int] = (50, 300, 5), clip: float = 0.01) -> DataFrame:
    """The factor (in hundredths, from a grid) on the mean log odds that calibrates best, ties to the smaller, and its test score."""
    each = rows.groupBy(*keys, "row_id", "split").agg(F.first("y").alias("y"), F.avg(scores.logit(F.col("p"), clip)).alias("o"))
    grid = F.sequence(*map(F.lit, factors))
    tried = each.select("*", F.explode(grid).alias("factor")).withColumn("d", scores.sigmoid(F.col("o") * F.col("factor") / 100) - F.col("y"))
    by = tried.groupBy(*keys, "factor").agg(*[F.avg(F.when(F.col("split") == s, F.col("d") * F.col("d"))).alias(s) for s in ("calibration", "test")])
    best = by.groupBy(*keys).agg(F.min_by(F.struct("factor", "calibration", "test"), F.struct(F.round("calibration", 12), "factor")).alias("_b"), F.max(F.when(F.col("factor") == 100, F.col("test"))).alias("_plain"))
    return best.select(*keys, "_b.factor", r6(F.col("_b.calibration")).alias("calibration"), r6(F.col("_b.test")).alias("test"), r6(F.col("_plain")).alias("test_plain"))


def rank_average(rows: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Add the average-tie rank of a value within its group.

    Ranks are prefix counts over bins that follow the order of values, plus the rank within the bin, so no task sorts a whole group.
    """
    size = F.abs(F.col(value))
    place = (F.signum(value) * F.floor(F.log1p(size) * RANK_BINS)).cast("long")
    counts = rows.groupBy(group, value, place.alias("_bin")).agg(F.count("*").alias("_n"))
    bins = counts.groupBy(group, "_bin").agg(F.sum("_n").alias("_s"))
    bins = bins.select(F.col(group).alias("_bg"), F.col("_bin").alias("_bb"), (F.sum("_s").over(Window.partitionBy(group).orderBy("_bin")) - F.col("_s")).alias("_before"))
    upto = F.sum("_n").over(Window.partitionBy(group, "_bin").orderBy(value))
    ranked = counts.withColumn("_upto", upto).join(bins, F.col(group).eqNullSafe(F.col("_bg")) & F.col("_bin").eqNullSafe(F.col("_bb")))
    ranks = ranked.select(F.col(group).alias("_g"), F.col(value).alias("_v"), (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))
    return rows.join(ranks, rows[group].eqNullSafe(F.col("_g")) & rows[value].eqNullSafe(F.col("_v"))).drop("_g", "_v")
