"""Validating joins on hand-worked records."""

import pytest
from pyspark.sql import functions as F

from oddsmith.operators import resolve


@pytest.fixture(scope="module")
def moments(spark):
    return spark.createDataFrame([(1, "k1", "A", False, False), (2, "k2", "B", True, False), (3, "k3", "B", False, True), (4, None, "C", False, False)], "row_id long, moment_key string, win string, late_dateline boolean, is_ladder boolean")


RECORDS = [
    # id, run, key, row_id, win, status, p: outcome, row, reason
    (0, "r", "k1", 1, "A", "ok", 0.5, "key", 1, "scored"), (1, "r", "k1", None, "A", "ok", 0.5, "key", 1, "scored"), (2, "r", "k1", 2, "A", "ok", 0.5, "conflict", None, "moment_key_mismatch"),
    (3, "r", None, 2, "B", "ok", 0.5, "row_id", 2, "dateline_flagged"), (4, "r", "gone", 3, "B", "ok", 0.5, "unresolved", None, "key_not_in_benchmark"), (5, "r", None, 9, "B", "ok", 0.5, "unresolved", None, "key_not_in_benchmark"),
    (6, "s", None, None, "B", "ok", 0.5, "unresolved", None, "key_not_in_benchmark"), (7, "s", None, 4, "C", "failed", None, "row_id", 4, "failed_rows"), (8, "s", "k3", 3, "B", "ok", 0.5, "key", 3, "ladder"),
    (9, "s", "k3", 3, "A", "ok", 0.5, "key", 3, "window_mismatch"), (10, "s", "k3", 3, "A", "no_news", None, "key", 3, "skipped"), (11, "s", None, 4, "C", "ok", 0.2, "row_id", 4, "scored"),
]


@pytest.fixture(scope="module")
def resolved(spark, moments):
    rows = spark.createDataFrame([r[:7] for r in RECORDS], "i int, run_id string, moment_key string, row_id long, win string, status string, p double")
    return resolve.resolve(rows, moments, ["win", "late_dateline", "is_ladder"])


def test_outcomes(resolved):
    assert {r["i"]: (r["outcome"], r["m_row_id"]) for r in resolved.collect()} == {r[0]: r[7:9] for r in RECORDS}


def test_accounts(resolved):
    got = {r["run_id"]: r.asDict() for r in resolve.account(resolved, ["run_id"]).collect()}
    for run in "rs":
        own = [r for r in RECORDS if r[1] == run]
        assert got[run]["final_records"] == len(own) and got[run]["joined_by_row_id_only"] == sum(r[2] is None and r[3] is not None for r in own)
        for reason in {r[9] for r in RECORDS}:
            assert got[run][reason] == sum(r[9] == reason for r in own), reason
    assert got["s"]["failed_share"] == pytest.approx(1 / 3, abs=1e-6) and got["r"]["failed_share"] == 0


def test_refusals(spark, moments, resolved):
    runs = spark.createDataFrame([("r", "old"), ("s", None)], "run_id string, db_sha256 string")
    with pytest.raises(Exception, match="run r: records do not resolve"):
        resolve.refuse_changed(resolved, runs, "live").collect()
    same = spark.createDataFrame([("r", "live"), ("s", "")], "run_id string, db_sha256 string")
    assert resolve.refuse_changed(resolved, same, "live").count() == len(RECORDS)
    rows = spark.createDataFrame([(1, 0.5), (3, 0.25)], "row_id long, v double")
    assert sorted((r["row_id"], r["win"]) for r in resolve.must_match(rows, moments, ["row_id"]).collect()) == [(1, "A"), (3, "B")]
    with pytest.raises(Exception, match="no match for row_id 7"):
        resolve.must_match(rows.unionByName(rows.select(F.lit(7).cast("long").alias("row_id"), "v")), moments, ["row_id"]).collect()
    assert [r["win"] for r in resolve.lookups(moments, "moment_key", ["k3", "k3"]).collect()] == ["B"]
    with pytest.raises(Exception, match="no match for moment_key nope"):
        resolve.lookups(moments, "moment_key", ["k1", "nope"]).count()
