"""What queries move: rows are dealt by market row once, before each becomes many records, and records carry only what is asked for."""

import re

import numpy as np
import pytest

from oddsmith import catalog
from oddsmith.operators import resampling

SF = "/root/testdata/sf0.001"


def shuffles(frame):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", frame._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", ["probe_forecasts", "quarantine_flags"])
def test_final_forecasts_move_once(spark, name):
    found = [s for s in shuffles(catalog.QUERIES[name](spark, SF)) if "row_id" in s]
    assert len(found) == 1 and "model" not in found[0]


def test_final_forecasts_carry_what_is_asked_for(spark):
    assert catalog._final(spark, SF, "p", "win").columns == ["model", "mode", "row_id", "p", "win"]


@pytest.mark.parametrize("name", ["news_tails", "news_coin_flip", "news_toward_market", "news_sports_moves", "news_by_band", "news_toward_difference"])
def test_pairs_move_no_records(spark, name):
    assert not [s for s in shuffles(catalog.QUERIES[name](spark, SF)) if "mode#" in s]


def test_depth_tests_make_rows_once(spark):
    plan = catalog.QUERIES["gap_trend"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 0  # what the tests are worked out from has been written: a row for each draw


def test_weights_of_many_clusters_are_those_of_each():
    names = ["None", "", "é", "x" * 40, "y" * 60, *map(str, range(300))]
    for label, draws, first in (("w", 2000, 0), ("a", 13, 0), ("longer label", 1001, 0), ("w", 100, 80), ("w", 8, 800)):
        assert (resampling.all_weights(label, names, draws, first) == np.stack([resampling.weights(label, c, draws + first)[first:] for c in names])).all()
