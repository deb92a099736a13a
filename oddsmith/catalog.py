"""Registry of the engine's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsmith.functions import replies, scores
from oddsmith.functions.scores import r6
from oddsmith.operators import exact, fits, gated, gates, news, paths, permutation, recalibration, resampling, resolve, results, runs, scoring, splits, stacking, surfaces
from oddsmith.plans.sql import ORACLE_SQL  # noqa: F401
from oddsmith.sources import fixtures, runlog, shared
from oddsmith.streaming import control, rates

FLAGSHIP = "bucket_scores"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BY_MODEL = ["win", "model"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.moments(spark, sf_dir).where("primary")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(fixtures.forecasts(_primary(spark, sf_dir)))


def _bucketed(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    cuts = scoring.quantile_cuts(_primary(spark, sf_dir), "win", "depth_usd")
    return scoring.with_bucket(_scored(spark, sf_dir) if rows is None else rows, cuts, "win", "depth_usd")


def _final(spark: SparkSession, sf_dir: str, *keep: str, where: Column | None = None) -> DataFrame:
    """The final forecasts with the columns ``keep``, of all market rows or of those that a condition on them holds for."""
    rows = fixtures.moments(spark, sf_dir)
    rows = fixtures.dealt(rows if where is None else rows.where(where))
    return gates.final_forecasts(fixtures.calls(rows), fixtures.runs(spark), keep=list(keep))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.flags(gates.probe_forecasts(_final(spark, sf_dir, "win", "p", "q", "y")))


def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _final(spark, sf_dir, *news.MARKET, "p", where=news.counted())


def _with_points(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return paths.last_prices(rows, fixtures.price_paths(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.parse(fixtures.log_lines(fixtures.calls(fixtures.moments(spark, sf_dir))))


@query
def bucket_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by view (windows, and A with a live book under cuts of its own), arm, model and depth bucket."""
    cuts = scoring.quantile_cuts(scoring.with_views(_primary(spark, sf_dir)), "view", "depth_usd")
    rows = scoring.with_arms(scoring.with_views(scoring.traded(_scored(spark, sf_dir))))
    return scoring.summary(scoring.with_bucket(rows, cuts, "view", "depth_usd"), ["view", "arm", "model", "bucket"])


def _viewed(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """Traded test rows in each view, with the view's buckets; dealt by a column, where one is named, before they become forecasts."""
    cuts = scoring.quantile_cuts(scoring.with_views(_primary(spark, sf_dir)), "view", "depth_usd")
    rows = _primary(spark, sf_dir).where("split = 'test'")
    rows = scoring.scored(fixtures.forecasts(rows if by is None else resampling.dealt_out(rows, by)))
    return scoring.with_bucket(scoring.with_views(scoring.traded(rows)), cuts, "view", "depth_usd")


@query
def bucket_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by view, model and bucket on the test split, with intervals."""
    return results.with_intervals(_viewed(spark, sf_dir, "event_id"), ["view", "model", "bucket"])


@query
def gap_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The depth tests of each model and of all models together."""
    return results.depth_tests(_viewed(spark, sf_dir, "event_id"), ["view", "model"], pooled=("model", "pooled"), dealt=True)


@query
def pooled_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = gap_trend(spark, sf_dir)
    planned = [(v, sum(on_a or v in "BC" for *_, on_a in fixtures.ROSTER)) for v in ("A", "A_live", "B", "C")]
    pooled = tests.where("model = 'pooled'")
    return results.pooled_verdicts(tests.where("model <> 'pooled'"), pooled, ["view"], spark.createDataFrame(planned, "view string, n_planned int"))


@query
def secondary_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows without the filters on price and end date, and the ladder rows, with intervals."""
    rows = fixtures.forecasts(fixtures.moments(spark, sf_dir).where("split = 'test' and not late_dateline"))
    rows = scoring.traded(scoring.scored(rows)).withColumn("kind", F.when(F.col("is_ladder"), "ladders").otherwise("full_set"))
    return results.with_intervals(rows, ["win", "kind", "model"])


@query
def error_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean pair correlation of errors on the rows that all models of a view forecast, overall and by bucket."""
    rows = results.common(_viewed(spark, sf_dir), ["view"])
    overall = results.correlation(rows.withColumn("part", F.lit("all")), ["view", "part"])
    return overall.unionByName(results.correlation(rows.withColumn("part", F.col("bucket").cast("string")), ["view", "part"]))


@query
def error_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the sets that the two models of a pair are from."""
    bridge = F.when(F.col("model").isin([m for m, *_, on_a in fixtures.ROSTER if on_a]), "bridge").otherwise("late")
    return results.by_sets(results.common(_viewed(spark, sf_dir), ["view"]), ["view"], bridge)


@query
def direction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda c: r6(F.avg(c)).alias(c)
    whole = [F.col(c) for c in ("win", "model", "direction")]
    sets = _scored(spark, sf_dir).groupingSets([whole, [*whole, F.col("band")]], *whole, F.col("band"))
    return sets.agg(F.count("*").alias("n"), mean("brier_model"), mean("brier_market"), mean("brier_edge"))


@query
def trade_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.traded(_scored(spark, sf_dir))
    by = rows.groupBy("win", "model", "reason", "side")
    return by.agg(F.count("*").alias("n"), *[r6(F.avg(F.when(F.col("side").isNotNull(), F.col(c).cast("double")))).alias(c) for c in ("cost", "won", "ret", "ret_nofee")], r6(F.avg("fee")).alias("fee"))


@query
def stake_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trades at larger stakes, whose fees lose less to rounding."""
    rows, out = _scored(spark, sf_dir), None
    for stake in (1, 10, 100, 1000):
        part = scoring.traded(rows, stake).where("side is not null").groupBy("win").agg(F.count("*").alias("n"), r6(F.avg("ret")).alias("ret")).withColumn("stake", F.lit(stake))
        out = part if out is None else out.unionByName(part)
    return out


@query
def murphy_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.murphy(_scored(spark, sf_dir), BY_MODEL)


@query
def bin_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.bin_table(_scored(spark, sf_dir), BY_MODEL)


@query
def skill_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.skill(_scored(spark, sf_dir), BY_MODEL)


@query
def pair_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pair_errors(_scored(spark, sf_dir), ["win"])


@query
def paired_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.paired(_scored(spark, sf_dir), ["win"], "m1")


@query
def common_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.answered_by_all(_scored(spark, sf_dir), ["win"])


@query
def shrinkage_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.shrinkage(_scored(spark, sf_dir), BY_MODEL)


@query
def ensemble_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.ensembles(_scored(spark, sf_dir), ["win"])


@query
def extremizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.extremizing(_scored(spark, sf_dir), ["win"])


@query
def no_skill_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.floors(_bucketed(spark, sf_dir, _primary(spark, sf_dir)), ["win", "bucket"])


@query
def bootstrap_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.bootstrap_mean(_scored(spark, sf_dir), BY_MODEL, "event_id", "brier_edge")


@query
def bootstrap_news_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.bootstrap_difference(_scored(spark, sf_dir), BY_MODEL, "event_id", "brier_edge", F.col("news_available"))


@query
def bootstrap_depth_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.bootstrap_slope(_scored(spark, sf_dir), BY_MODEL, "event_id", "log_depth", "brier_edge")


@query
def exact_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`bootstrap_edge` with the standard generator's own draws."""
    return exact.bootstrap_mean(_scored(spark, sf_dir), BY_MODEL, "event_id", "brier_edge", "row_id")


@query
def exact_news_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.bootstrap_difference(_scored(spark, sf_dir), BY_MODEL, "event_id", "brier_edge", F.col("news_available"), "row_id")


@query
def exact_depth_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.bootstrap_slope(_scored(spark, sf_dir), BY_MODEL, "event_id", "log_depth", "brier_edge", "row_id")


@query
def exact_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of folds that are dealt by the generators' shuffles."""
    rows = _primary(spark, sf_dir).select("win", "event_id")
    both = [exact.folds(rows, "event_id", generator=g).withColumn("generator", F.lit(g)) for g in ("numpy", "python")]
    return both[0].unionByName(both[1]).groupBy("generator", "fold").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_events"))


@query
def bootstrap_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.bootstrap_bands(_bucketed(spark, sf_dir), BY_MODEL, "event_id", "brier_edge", "band")


@query
def bootstrap_pair_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = scoring.met_pairs(_scored(spark, sf_dir), ["win"], ["row_id", "event_id"], ["error"])
    return resampling.bootstrap_pair_r(pairs, ["win"], "event_id", "x_error", "z_error")


@query
def final_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _final(spark, sf_dir, "win", "status", "p").groupBy("win", "model", "mode", "status").agg(F.count("*").alias("n"), r6(F.avg("p")).alias("p"))


@query
def record_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the final records find their moments, and what becomes of them."""
    rows = fixtures.moments(spark, sf_dir)
    named = rows.withColumn("moment_key", fixtures.moment_key(F.col("row_id")))
    found = resolve.resolve(fixtures.keyed_records(rows), named, ["win", "late_dateline", "is_ladder", "news_available"])
    return resolve.account(found, ["run_id", "mode"], F.col("m_news_available") | (F.col("mode") == "normal"))


@query
def probe_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.probe_forecasts(_final(spark, sf_dir, "win", "p")).groupBy("win", "model", "source").agg(F.count("*").alias("n"), r6(F.avg("p")).alias("p"))


@query
def quarantine_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _flags(spark, sf_dir)
    return found.groupBy("win", "model", "source", "reason").agg(F.count("*").alias("n"), F.sum("quarantined").alias("quarantined"))


@query
def news_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.news_value(_final(spark, sf_dir, "win", "news_available", "p", "y"))


@query
def calibration_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.gate(_bucketed(spark, sf_dir))


@query
def gated_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the forecasts in regions that passed the gate and that disagree with the price: how many prices drifted towards them."""
    rows = _bucketed(spark, sf_dir)
    return paths.convergence(_with_points(spark, sf_dir, gates.admitted(rows, gates.gate(rows))), ["win", "direction"])


@query
def path_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.coverage(_with_points(spark, sf_dir, _primary(spark, sf_dir)))


@query
def disagreement_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What prices did after forecasts that disagree with them, by whether the market closed within the window."""
    return paths.moves(paths.disagreements(_with_points(spark, sf_dir, _scored(spark, sf_dir))), [*BY_MODEL, "settled"])


@query
def bootstrap_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled means of those moves with intervals."""
    found = paths.disagreements(_with_points(spark, sf_dir, _scored(spark, sf_dir)))
    each = found.select("win", "settled", "event_id", F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in paths.MEASURES])))
    return resampling.bootstrap_mean(each, ["win", "settled", "measure"], "event_id", "v")


@query
def convergence_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convergence beyond chance: forecasts dealt anew among all rated rows (``rule``), and among those that disagree only."""
    rated = _with_points(spark, sf_dir, _scored(spark, sf_dir)).where("last_price is not null")
    apart = permutation.disagrees(F.col("p"), F.col("q"))
    pools = rated.withColumn("pool", F.explode(F.when(apart, F.array(F.lit("rule"), F.lit("disagreements"))).otherwise(F.array(F.lit("rule")))))
    return permutation.excess(pools, [*BY_MODEL, "pool"], "row_id", "event_id")


@query
def window_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window: rows of each kind, events and the size of the largest."""
    kinds = {"n_primary": F.col("primary"), "n_news": F.col("news_available"), "n_sports": F.col("sports"), "n_live": F.col("live_book")}
    kinds |= {"n_one_sided": F.col("book") == "one_sided_book", "n_degenerate": F.col("book") == "degenerate_book"}
    per = fixtures.moments(spark, sf_dir).groupBy("win", "event_id").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in kinds.items()])
    return per.groupBy("win").agg(F.count("*").alias("n_events"), F.max("n").alias("largest_event"), *[F.sum(c).alias(c) for c in ("n", *kinds)])


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ["win", "bucket", "sports"]
    rows = _bucketed(spark, sf_dir, _primary(spark, sf_dir)).select(*cells, "row_id")
    return resampling.stratified_split(rows, cells, "row_id").groupBy(*cells).agg(F.count("*").alias("n"), F.count_if("drawn").alias("n_drawn"))


def _in_play(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucketed(spark, sf_dir, fixtures.moments(spark, sf_dir).where("not late_dateline"))


@query
def event_grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of whole events, filled towards a fifth of their rows."""
    cells = ["win", "bucket", "sports"]
    events = splits.greedy_fill(splits.majority_cells(_in_play(spark, sf_dir), cells, "event_id"), cells, "event_id")
    drawn = F.col("drawn")
    return events.groupBy(*cells, "target").agg(F.sum("size").alias("n"), F.count("*").alias("n_events"), F.coalesce(F.sum(F.when(drawn, F.col("size"))), F.lit(0)).alias("n_drawn"), F.count_if(drawn).alias("events_drawn"))


@query
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the split by rows and the split by events leave of the test side that shares events with the calibration side."""
    rows = splits.grouped_split(_in_play(spark, sf_dir), ["win", "bucket", "sports"], "event_id")
    both = [splits.leakage(rows, ["win"], "event_id", c).withColumn("kind", F.lit(k)) for k, c in (("rows", "split"), ("events", "grouped"))]
    return both[0].unionByName(both[1])


@query
def validation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = splits.fixed_sample(_in_play(spark, sf_dir).select("win", "bucket", "sports", "row_id"), "row_id")
    return drawn.groupBy("win", "bucket", "sports").agg(F.count("*").alias("n"), F.min("row_id").alias("least"), F.max("row_id").alias("greatest"))


@query
def event_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = resampling.event_folds(_primary(spark, sf_dir), "event_id").groupBy("win", "fold", "event_id").agg(F.count("*").alias("n"))
    return per.groupBy("win", "fold").agg(F.sum("n").alias("n"), F.count("*").alias("n_events"))


@query
def price_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, gap = F.col("q"), F.abs(F.col("p") - F.col("q"))
    keys = [scores.price_class(q).alias("price_class"), scores.late_horizon_band(F.col("horizon_days")).alias("horizon"), scores.gap_bin(gap).alias("gap")]
    return _scored(spark, sf_dir).groupBy("win", *keys).agg(F.count("*").alias("n"), r6(F.avg("brier_edge")).alias("brier_edge"))


@query
def loss_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the negative edges and of all, by direction, and the direction's share of the losses."""
    lost = F.sum(F.least(F.col("brier_edge"), F.lit(0.0)))
    by = _scored(spark, sf_dir).groupBy(*BY_MODEL, "direction").agg(F.count("*").alias("n"), lost.alias("_l"), F.sum("brier_edge").alias("_n"))
    return by.select(*BY_MODEL, "direction", "n", (r6(F.col("_l")) + 0.0).alias("losses"), r6(F.col("_n")).alias("net"), (r6(F.col("_l") / F.sum("_l").over(Window.partitionBy(*BY_MODEL))) + 0.0).alias("share"))


@query
def imputed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier scores with failed forecasts dropped, taken as a half, or as wrong as can be."""
    p, y = F.col("p"), F.col("y")
    half = F.coalesce(p, F.lit(0.5)) - y
    by = fixtures.attempts(_primary(spark, sf_dir)).groupBy(*BY_MODEL)
    return by.agg(F.count("*").alias("n"), F.count_if(p.isNull()).alias("n_failed"), r6(F.avg((p - y) * (p - y))).alias("brier_dropped"), r6(F.avg(half * half)).alias("brier_half"), r6(F.avg(F.coalesce((p - y) * (p - y), F.lit(1.0)))).alias("brier_worst"))


@query
def conditional_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.attempts(_primary(spark, sf_dir)).select("win", "row_id", "model", F.col("p").isNull().cast("double").alias("f"))
    pairs = scoring.met_pairs(rows, ["win"], ["row_id"], ["f"])
    given = lambda v: r6(F.avg(F.when(F.col("x_f") == v, F.col("z_f"))))
    return pairs.groupBy("win", "a", "b").agg(F.count("*").alias("n"), given(1).alias("given_failed"), given(0).alias("given_ok"))


@query
def depth_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.rank_average(_primary(spark, sf_dir).select("win", "depth_usd", "q"), "win", "depth_usd", "rx")
    rows = scoring.rank_average(rows, "win", "q", "ry")
    return rows.groupBy("win").agg(F.count("*").alias("n"), r6(F.corr("depth_usd", "q")).alias("pearson"), r6(F.corr("rx", "ry")).alias("spearman"))


@query
def within_event_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of p on q after taking event means off both: from one row of sums per event."""
    p, q = F.col("p"), F.col("q")
    per = _scored(spark, sf_dir).groupBy(*BY_MODEL, "event_id").agg(F.count("*").alias("n"), F.covar_pop(p, q).alias("c"), F.var_pop(q).alias("v"))
    return per.groupBy(*BY_MODEL).agg(F.sum("n").alias("n"), r6(F.try_divide(F.sum(F.col("c") * F.col("n")), F.nullif(F.sum(F.col("v") * F.col("n")), F.lit(0.0)))).alias("slope"))


@query
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most common tags of each window."""
    tags = fixtures.moments(spark, sf_dir).select("win", F.explode("tags").alias("tag")).where("tag is not null")
    by = tags.groupBy("win", F.lower(F.trim("tag")).alias("tag")).agg(F.count("*").alias("n"))
    return by.withColumn("_r", F.row_number().over(Window.partitionBy("win").orderBy(F.desc("n"), "tag"))).where("_r <= 5").drop("_r")


@query
def rounded_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each model's forecasts on its ten commonest values of two decimals."""
    by = _scored(spark, sf_dir).groupBy("model", F.bround("p", 2).alias("v")).agg(F.count("*").alias("n"))
    by = by.withColumn("_r", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("n"), "v")))
    return by.groupBy("model").agg(F.sum("n").alias("n"), r6(F.sum(F.when(F.col("_r") <= 10, F.col("n"))) / F.sum("n")).alias("share"), F.max(F.when(F.col("_r") == 1, F.col("v"))).alias("commonest"))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.replies(_scored(spark, sf_dir)).withColumn("body", replies.body(F.col("reply")))
    return rows.withColumns(replies.classes(F.col("body")))


@query
def reply_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a strict and a lenient parser read from the replies, and the warnings of each."""
    rows = fixtures.replies(_scored(spark, sf_dir)).select("win", "model", "reply")
    both = [F.struct(F.lit(name).alias("reading"), replies.parse(F.col("reply"), name == "lenient").alias("said")) for name in ("strict", "lenient")]
    said = rows.select("win", F.inline(F.array(*both)))
    warned = lambda w: F.count_if(F.array_contains("said.warnings", w)).alias(f"n_{w}")
    return said.groupBy("win", "reading").agg(
        F.count("*").alias("n"), F.count("said.probability").alias("n_parsed"), r6(F.avg("said.probability")).alias("p"), F.count_if("said.bare_integer").alias("n_bare"),
        *[warned(w) for w in ("rejected_number_form", "percent_form", "bare_integer", "extreme")],
    )


@query
def reply_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many replies do what, and how long they are."""
    by = _replies(spark, sf_dir).groupBy("win", "news_available")
    return by.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in (*replies.CLASSES, "bare")], *[r6(F.avg(c)).alias(c) for c in ("body_chars", "body_words")])


@query
def reply_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier edge of replies that hedge, or cite news they had, less that of the others: inside each model, then over models."""
    rows, out = _replies(spark, sf_dir).where("reply is not null"), None
    for name in ("hedge", "cites_news"):
        part = resampling.bootstrap_classes(rows if name == "hedge" else rows.where("news_available"), ["win"], "model", "event_id", "brier_edge", F.col(name) == 1)
        part = part.withColumn("class", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query
def isotonic_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.corp(_scored(spark, sf_dir), BY_MODEL)


@query
def platt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.platt(_scored(spark, sf_dir).where("split = 'calibration'"), BY_MODEL)


@query
def latest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return rates.latest_of_log(events, ["user_id", "event_type"])


@query
def hourly_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.hourly_errors(fixtures.table(spark, sf_dir, "events"))


@query
def sliding_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.sliding_errors(fixtures.table(spark, sf_dir, "events"))


@query
def saturation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When errors outnumber views for hours on end; every hour that has events counts."""
    return rates.saturation(rates.hourly_errors(fixtures.table(spark, sf_dir, "events"), success="view"))


@query
def rate_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the errors of a host within half an hour call for longer pauses."""
    events = fixtures.table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("host", F.concat(F.lit("host"), (F.col("user_id") % 4).cast("string")))
    return control.multipliers(events, "host", 1_800).groupBy("host", "multiplier").agg(F.count("*").alias("n"), F.max("hits").cast("int").alias("most"))


@query
def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run would still do if it were resumed."""
    records, keys = fixtures.calls(fixtures.moments(spark, sf_dir)), ["run_id", "model", "mode", "row_id"]
    plan = records.select(*keys).distinct()
    left = control.to_do(plan, records, keys, ["called_at", "call_id"]).groupBy("run_id", "model").agg(F.count("*").alias("n_left"))
    failed = control.finished(records, keys, ["called_at", "call_id"]).where("status = 'failed'").groupBy("run_id", "model").agg(F.count("*").alias("n_failed"))
    whole = plan.groupBy("run_id", "model").agg(F.count("*").alias("n"))
    return whole.join(left, ["run_id", "model"], "left").join(failed, ["run_id", "model"], "left").fillna(0)


@query
def merged_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.merged_pauses(fixtures.table(spark, sf_dir, "events"), "user_id")


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.summary(_records(spark, sf_dir), ["run_id", "model", "mode"])


@query
def call_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.error_histogram(_records(spark, sf_dir), ["run_id"])


@query
def parse_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.warning_histogram(_records(spark, sf_dir), ["run_id", "model"])


@query
def run_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.guard(_records(spark, sf_dir), fixtures.manifests(spark))


@query
def run_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.recount(_records(spark, sf_dir), fixtures.manifests(spark))


@query
def stacked_ensembles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacking.stack(_scored(spark, sf_dir))


@query
def recalibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacking.recalibrated(_scored(spark, sf_dir), BY_MODEL)


@query
def isotonic_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What isotonic and logistic maps win back, across event folds and from the calibration split, stored or of whole events."""
    rows = splits.grouped_split(_bucketed(spark, sf_dir), ["win", "bucket", "sports"], "event_id")
    rows = shared.cut(rows.select(*BY_MODEL, "event_id", "p", "q", "y", "split", "grouped"))  # four fits read it
    found = {"isotonic, folds": recalibration.crossfitted(rows, BY_MODEL, "isotonic"), "isotonic, split": recalibration.split(rows, BY_MODEL, "isotonic")}
    found |= {"isotonic, whole events": recalibration.split(rows, BY_MODEL, "isotonic", "grouped"), "logistic, whole events": recalibration.split(rows, BY_MODEL, "platt", "grouped")}
    out = None
    for name, part in found.items():
        part = part.withColumn("fit", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query
def random_cut_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much reliability bins hide that are cut by the market's price, against cuts at random."""
    return permutation.random_cuts(_scored(spark, sf_dir), BY_MODEL, "row_id")


@query
def shrinkage_null_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces.permuted_null(_scored(spark, sf_dir))


@query
def covariate_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes of the error on price, depth, horizon, news and sports together."""
    rows = _scored(spark, sf_dir).withColumn("forecast", F.concat_ws("|", "win", "model"))
    return stacking.slopes(rows, "forecast", "error", ["q", "log_depth", "horizon_days", "news_available", "sports"])


@query
def shrinkage_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacking.shrinkage_null(_scored(spark, sf_dir))


@query
def model_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How models agree beyond price, covariates and events, and how often they are wrong together beyond the market, with intervals."""
    return surfaces.agreements(_scored(spark, sf_dir))


@query
def news_ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether news changes what models share or only how far each strays, by swapping one ingredient at a time."""
    return surfaces.swapped(_final(spark, sf_dir, "win", "event_id", "news_available", "p", "q"))


@query
def surface_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What forecasters show that share a fitted surface and nothing else, under three designs."""
    return surfaces.null(_scored(spark, sf_dir))


@query
def news_placebo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacking.news_placebo(_final(spark, sf_dir, "win", "news_available", "p", "q", "y"))


@query
def news_coin_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.coin_flip(news.pairs(_news(spark, sf_dir)))


@query
def news_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.by_band(news.pairs(_news(spark, sf_dir)))


@query
def news_sports_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.sports_moves(news.pairs(_news(spark, sf_dir)))


@query
def news_toward_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.toward_market(news.pairs(_news(spark, sf_dir)))


@query
def news_toward_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.toward_difference(news.pairs(_news(spark, sf_dir)))


@query
def news_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.tails(_final(spark, sf_dir, *news.MARKET, "p", where=news.unfiltered()))


def _settled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Test rows in their views after quarantine and gate, with later prices, and the gate; buckets are those of the window's cuts."""
    rows = _bucketed(spark, sf_dir)
    gate = gates.gate(rows)
    flags = _flags(spark, sf_dir)
    seen = scoring.with_views(scoring.traded(rows.where("split = 'test'")))
    return gated.settled(_with_points(spark, sf_dir, seen), flags, gate), gate


@query
def gated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated.counts(*_settled(spark, sf_dir))


@query
def gated_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`gated_counts` with forecasts dealt anew beside it."""
    return gated.main(*_settled(spark, sf_dir))


@query
def gated_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated.regions(*_settled(spark, sf_dir))


@query
def gated_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated.directions(_settled(spark, sf_dir)[0])


@query
def reporting_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _flags(spark, sf_dir)
    return runs.reporting_line(_records(spark, sf_dir), fixtures.manifests(spark), flags)
