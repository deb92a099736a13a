"""Forecasting tables derived from the star schema: orders are market moments, customers their events, lineitem later prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.functions import calls as calls_of
from oddsmith.functions import scores
from oddsmith.functions.scores import uniform

#: model, intercept and slope of its shrinkage, and whether it forecasts window A
ROSTER = [("m1", 0.10, 0.60, True), ("m2", 0.15, 0.50, True), ("m3", 0.05, 0.80, True), ("m4", 0.20, 0.55, True)]
ROSTER += [("m5", 0.08, 0.75, False), ("m6", 0.12, 0.65, False), ("m7", 0.02, 0.90, False), ("m8", 0.25, 0.45, False)]
#: Customer segments that stand for sports.
SPORTS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
#: run, when it started (ISO), whether it is void
RUNS = [("run1", "2026-01-01", 0), ("run2", "2026-02-01", 0), ("run3", "2026-03-01", 1)]

#: Share of memory probes that know the outcome.
RECALLED = 0.03
#: type, status and message of the errors of failed calls
ERRORS = [
    ("RateLimitError", 429, "model is temporarily rate-limited upstream"), ("NotFoundError", 404, "no such model"), ("APIError", None, "Read timeout"),
    ("APIError", 400, "could not finish the message because max_tokens was reached"), ("NotFoundError", 404, "Temporarily rate-limited, try later"), ("APIConnectionError", None, "Connection reset by peer"),
    (None, 503, "upstream said no"), (None, None, "this model is gated"), ("OddError", 418, "timed out"), ("OddError", None, "nothing is known"), ("BudgetExceededError", 500, "cap"),
]
#: run, template hash, temperature, digest of the benchmark, rows that the run says it did
MANIFESTS = [("run1", "t1", 0.5, "d1", 10), ("run2", "t2", 0.7, "d1", 0), ("run3", "t1", 0.5, "d2", 10)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores, if they come in fewer parts than there are: a small file of one row group would be the work of one task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per market moment: price, book, outcome, fees, tags and the columns derived from them."""
    key = F.col("o_orderkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.select(
        key.alias("row_id"),
        F.col("o_custkey").alias("event_id"),
        F.when(F.col("o_orderstatus") == "P", "A").when(F.col("o_orderstatus") == "F", "B").otherwise("C").alias("win"),
        F.col("o_orderdate").alias("forecast_ts"),
        F.col("o_totalprice").alias("depth_usd"),
        F.array("segment", "o_orderpriority").alias("tags"),
        F.coalesce(F.col("segment").isin(SPORTS), F.lit(False)).alias("sports"),
        (F.lit(0.02) + F.lit(0.96) * uniform("q", key)).alias("_q"),
        (F.lit(0.01) + F.lit(0.2) * uniform("w", key)).alias("_spread"),
        (uniform("o", key) < 0.03).alias("one_sided"),
        uniform("x", key).alias("_odd"),
        uniform("y", key).alias("_y"),
        (uniform("l", key) < 0.1).alias("is_ladder"),
        (uniform("d", key) < 0.03).alias("late_dateline"),
        (uniform("r", key) < 0.02).alias("end_date_revised"),
        F.when(uniform("s", key) < 0.2, "calibration").otherwise("test").alias("split"),
        (uniform("n", key) < 0.4).alias("news_available"),
        (F.lit(40.0) * uniform("h", key)).alias("horizon_days"),
        (uniform("e", key) >= 0.05).alias("fees_enabled"),
        F.when(uniform("z", key) < 0.5, 1.0).alias("fee_exponent"),
        (uniform("ip", key) < 0.04).alias("in_play"),
    )
    open_for = F.floor(F.col("horizon_days") * 86400).cast("decimal(18,6)")
    rows = rows.withColumn("closes_at", F.when(uniform("ct", F.col("row_id")) >= 0.1, F.col("forecast_ts") + F.make_dt_interval(secs=open_for)))
    q, half, odd = F.col("_q"), F.col("_spread") / 2, F.col("_odd")
    low, high = F.greatest(F.lit(0.0), q - half), F.least(F.lit(1.0), q + half)
    rows = rows.withColumns({
        "venue": F.when(F.col("win") == "C", "kalshi").otherwise("polymarket"),
        "price_yes": F.when(F.col("win") == "A", F.bround(q, 2)).otherwise(q),
        "mid_yes": F.when(~F.col("one_sided"), q),
        "bid": F.when(odd < 0.02, high).otherwise(low),
        "ask": F.when(F.col("one_sided"), F.lit(None)).when(odd < 0.02, low).when(odd < 0.03, F.least(F.lit(1.0), low + 0.6)).otherwise(high),
        "y": F.when(F.col("_y") < q, 1.0).otherwise(0.0),
        "fee_rate": F.when(F.col("win") == "C", 0.07).otherwise(0.05),
    })
    rows = rows.withColumns({
        "q": F.when(F.col("win") == "A", F.coalesce("mid_yes", "price_yes")).otherwise(F.col("price_yes")),
        "live_book": F.coalesce(~F.col("one_sided") & (F.col("ask") - F.col("bid") <= scores.LIVE_SPREAD + scores.EPS), F.lit(False)),
        "book": scores.book_status(F.col("bid"), F.col("ask"), F.col("one_sided")),
        "horizon_band": scores.horizon_band(F.col("horizon_days")),
    })
    return rows.withColumn("primary", F.col("q").between(0.05, 0.95) & ~F.col("is_ladder") & ~F.col("late_dateline") & ~F.col("end_date_revised")).drop("_q", "_spread", "_odd", "_y")


def dealt(rows: DataFrame, column: str = "row_id") -> DataFrame:
    """The rows dealt by a column once, before each becomes many forecasts and records: aggregates by that column and more then move nothing."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)


def _models(rows: DataFrame) -> DataFrame:
    models = [F.struct(F.lit(m).alias("model"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("on_a")) for m, a, b, w in ROSTER]
    return rows.select("*", F.inline(F.array(*models))).where("on_a or win <> 'A'")


def _p(noise: Column) -> Column:
    return F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("a") + F.col("b") * F.col("q") + F.lit(0.3) * (noise - 0.5)))


def attempts(rows: DataFrame) -> DataFrame:
    """Each moment's forecast p by each model of the roster; null where it failed."""
    each = _models(rows).withColumn("p", F.when(uniform("f", F.col("model"), F.col("row_id")) >= 0.01, _p(uniform(F.col("model"), F.col("row_id")))))
    return each.drop("a", "b", "on_a")


def forecasts(rows: DataFrame) -> DataFrame:
    """The forecasts that did not fail."""
    return attempts(rows).where("p is not null")


def calls(rows: DataFrame) -> DataFrame:
    """The call log: normal and memory-probe records of each model and moment, with reruns, drafts and a void run."""
    each = _models(rows).select("*", F.explode(F.array(F.lit("normal"), F.lit("memory_probe"))).alias("mode"))
    of = (F.col("mode"), F.col("model"), F.col("row_id"))
    each = each.where((F.col("mode") == "normal") | (F.col("news_available") & (uniform("pm", *of) < 0.8)))
    each = each.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    each = each.where((F.col("k") == 0) | ((F.col("k") == 1) & (uniform("c", *of) < 0.2)) | ((F.col("k") == 2) & (uniform("v", *of) < 0.1)))
    status = F.when(F.col("late_dateline"), "excluded_by_benchmark_flag").when(uniform("f", F.col("model"), F.col("row_id")) < 0.01, "failed").otherwise("ok")
    each = each.withColumns({
        "status": status,
        "run_id": F.element_at(F.array(*[F.lit(r) for r, _, _ in RUNS]), F.col("k") + 1),
        "call_id": F.concat_ws("|", *of, F.col("k").cast("string")),
        "called_at": F.col("forecast_ts") + F.make_dt_interval(secs=F.floor(F.lit(90.0) * uniform("t", F.col("k"), *of)).cast("decimal(18,6)")),
        "final": ((F.col("k") > 0) | (uniform("g", *of) >= 0.05)).cast("int"),
    })
    noise = F.when((F.col("mode") == "normal") & (F.col("k") == 0), uniform(F.col("model"), F.col("row_id"))).otherwise(uniform("p", F.col("k"), *of))
    recalled = (F.col("mode") == "memory_probe") & (uniform("mem", *of) < RECALLED)
    p = F.when(recalled, F.when(F.col("y") == 1, 0.97).otherwise(0.03)).otherwise(_p(noise))
    return each.withColumn("p", F.when(F.col("status") == "ok", p)).drop("a", "b", "on_a", "k")


def moment_key(row: Column) -> Column:
    return F.concat(F.lit("k"), F.substring(F.md5(row.cast("string")), 1, 12))


def keyed_records(rows: DataFrame) -> DataFrame:
    """The final records of the call log with the names that they give their moment: key and row id, either alone, wrong ones, or none."""
    u, row = uniform("rk", F.col("call_id")), F.col("row_id")
    key = F.when(u < 0.8, moment_key(row)).when(u < 0.88, F.lit(None)).when(u < 0.92, moment_key(row)).when(u < 0.95, F.concat(F.lit("gone"), row.cast("string")))
    row_id = F.when((u >= 0.88) & (u < 0.92), row + 1).when((u >= 0.95) & (u < 0.97), -row).when((u < 0.95) & (u >= 0.1), row).when((u >= 0.8) & (u < 0.88), row)
    win = F.when(uniform("rw", F.col("call_id")) < 0.01, F.lit("A")).otherwise(F.col("win"))
    return calls(rows).where("final = 1").select("run_id", "model", "mode", "call_id", "called_at", "status", "p", win.alias("win"), key.alias("moment_key"), row_id.alias("row_id"))


def runs(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(r).alias("run_id"), F.lit(s).alias("started_at"), F.lit(v).alias("void")) for r, s, v in RUNS])))


def price_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of the moments from a day before the forecast to nine days after it, with what orders points of one time."""
    of = ("l_orderkey", "l_partkey", "l_suppkey", F.floor("l_extendedprice"))
    u = lambda label: uniform(label, *[F.col(c) if isinstance(c, str) else c for c in of])
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"))
    points = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    after = F.floor(u("pt") * 864_000) - 86_400
    return points.select(
        F.col("l_orderkey").alias("row_id"), (F.col("o_orderdate") + F.make_dt_interval(secs=after.cast("decimal(18,6)"))).alias("ts"), (F.lit(0.02) + F.lit(0.96) * u("pp")).alias("price_yes"),
        F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("tie"),
    )


#: Openings of replies, and lines that state the forecast: ``{n}`` is a number of two decimals, ``{c}`` its hundredths.
OPENINGS = [
    "", "It is hard to say. ", "According to the news it will.\n", "Guess: ", "Difficult to say: no relevant news is available.\n", "The base rate is typically 30%.\n\n",
    "Bookmakers' odds are -150 for the favorite.\n", "As I recall, the match has already started. ", "It is impossible to know; I can't give a probability.\n", "In 2024 they won 12 games.\n",
    "News coverage suggests so.\nPROBABILITY: 0.3\nOn reflection:\n", "  Without more data this is highly speculative.  \n", "The provided articles show it: $5 was priced in.\n", "Fine",
]
LINES = [
    "PROBABILITY: {n}", "PROBABILITY: {n}", "\nPROBABILITY: {c}%", "PROBABILITY: 0", "PROBABILITY: 0,65", "PROBABILITY: 1/3", "PROBABILITY: **{n}**", "\nProbability = {n}", "PROBABILITY: {n}\nthanks", "{n}", "",
    "probability: 1e-3", "PROBABILITY: {c}", "PROBABILITY: 150%", "PROBABILITY: .005", "PROBABILITY:{n} %  \n",
]


def replies(rows: DataFrame) -> DataFrame:
    """A reply text for each forecast, now and then none: openings of every kind, and the number in every form that a parser meets."""
    of = (F.col("model"), F.col("row_id"))
    pick = lambda label, texts: F.element_at(F.array(*map(F.lit, texts)), F.floor(uniform(label, *of) * len(texts)).cast("int") + 1)
    hundredths = F.floor(F.col("p") * 100).cast("string")
    line = F.replace(F.replace(pick("form", LINES), F.lit("{n}"), F.concat(F.lit("0."), F.lpad(hundredths, 2, "0"))), F.lit("{c}"), hundredths)
    return rows.withColumn("reply", F.when(uniform("said", *of) >= 0.02, F.concat(pick("words", OPENINGS), line)))


def log_lines(rows: DataFrame) -> DataFrame:
    """(value): the call log as JSON lines, with tokens, retries, errors and warnings."""
    u = lambda label: uniform(label, F.col("call_id"))
    failed, k = F.col("status") == "failed", F.floor(u("er") * len(ERRORS)).cast("int") + 1
    pick = lambda i: F.when(failed, F.element_at(F.array(*[F.lit(e[i]) for e in ERRORS]), k))
    number = F.substring("model", 2, 9).cast("int")
    tokens = {"input_tokens": F.floor(u("ti") * 1000), "output_tokens": F.floor(u("to") * 3000)}
    fields = {**{c: F.col(c) for c in ("run_id", "call_id", "row_id", "model", "mode", "win", "called_at", "status", "final")}, "parsed_probability": F.col("p"), **tokens}
    fields |= {"attempt": F.when(u("at") < 0.05, 2).otherwise(1), "transport_try": F.when(u("tt") < 0.1, 2).otherwise(1), "finish_reason": F.when(u("fr") < 0.04, "length").otherwise("stop")}
    fields |= {"cost_usd": calls_of.cost(*tokens.values(), number * 1.0, number * 4.0), "error_type": pick(0), "error_status": pick(1), "error": pick(2)}
    fields |= {"provider": F.when((F.col("model") == "m3") & (u("pr") < 0.01), "host2").otherwise("host1"), "parse_warning": F.array_compact(F.array(F.when(u("pw") < 0.03, "extreme"), F.when(u("pw").between(0.02, 0.06), "percent_form")))}
    fields |= {"served_model": F.when(u("sm") >= 0.02, F.concat("model", F.when(u("sm") < 0.5, "-a").otherwise("-b")))}
    fields |= {"adapter_raw": F.struct(F.floor(u("rt") * 500).alias("reasoning_tokens_used"))}
    return rows.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("value"))


def manifests(spark: SparkSession) -> DataFrame:
    """Manifests of the runs with their JSON text."""
    rows = [(r, bool(v), t, d, n, f'{{"settings": {{"temperature": {x}, "extra_body": {{"reasoning": {{"max_tokens": 1024}}}}}}}}') for (r, _, v), (_, t, x, d, n) in zip(RUNS, MANIFESTS, strict=True)]
    return spark.createDataFrame(rows, "run_id string, void boolean, template_hash string, db_sha256 string, rows_done bigint, manifest string")
