"""Files that runs leave: written, read back, and what wins over what."""

import pytest

from oddsmith.operators import resampling
from oddsmith.sources import artefacts, runlog

GATE = "model string, win string, bucket int, n bigint, ece double, bins string, verdict string, ece_sports double, ece_other double"
REGIONS = [("m2", "A", 1, 31, 0.2, "10/10/11", "fail", None, 0.2), ("m1", "B", 2, 40, 0.0512, "14/13/13", "pass", 0.25, 0.0125), ("m1", "A", 10, 3, 0.5, "1/1/1", "insufficient", None, None)]
FLAGS = [("m1", 1, "A", "memory_probe", 1, "x"), ("m1", 2, "A", "normal_stand_in", 0, "y"), ("m1", 3, "B", "memory_probe", 0, "y")]


def test_stored_cuts_win(spark, tmp_path):
    path = str(tmp_path / "cuts")
    first = spark.createDataFrame([("A", [1.0, 2.5]), ("B", [3.0, 4.0])], "win string, cuts array<double>")
    later = spark.createDataFrame([("A", [9.0, 9.5])], "win string, cuts array<double>")
    assert {r.win: r.cuts for r in artefacts.stored_cuts(first, path).collect()} == {"A": [1.0, 2.5], "B": [3.0, 4.0]}
    assert {r.win: r.cuts for r in artefacts.stored_cuts(later, path).collect()} == {"A": [1.0, 2.5], "B": [3.0, 4.0]}


def test_gate_comes_back(spark, tmp_path):
    path, gate = str(tmp_path / "gate"), spark.createDataFrame(REGIONS, GATE)
    artefacts.write_gate(gate, path)
    assert sorted(map(tuple, artefacts.read_gate(spark, path).select(*gate.columns).collect())) == sorted(REGIONS)


def test_gate_of_another_rule_is_refused(spark, tmp_path):
    path = tmp_path / "gate"
    path.mkdir()
    (path / "part.json").write_text('{"model":"m1","win":"A","bucket":1,"n":40,"ece":0.1,"verdict":"pass","rule":{"n_bins":5,"min_rows":30,"ece_max":0.1}}\n')
    with pytest.raises(Exception, match="another rule"):
        artefacts.read_gate(spark, str(path)).collect()


def test_gate_as_markdown(spark):
    got = [r.value for r in artefacts.gate_markdown(spark.createDataFrame(REGIONS, GATE)).collect()]
    head = ["", "| window | bucket | n | ECE | verdict | sports ECE | other ECE |", "| - | - | - | - | - | - | - |"]
    one = ["## m1", *head, "| A | 10 | 3 | 0.500 | insufficient | - | - |", "| B | 2 | 40 | 0.051 | pass | 0.250 | 0.013 |", ""]
    assert got == [*one, "## m2", *head, "| A | 1 | 31 | 0.200 | fail | - | 0.200 |", ""]


def test_flags_of_the_table_come_before_those_of_files(spark, tmp_path):
    path, flags = str(tmp_path / "flags"), spark.createDataFrame(FLAGS, artefacts.FLAG)
    artefacts.write_flags(flags, path)
    none = flags.where("false")
    assert [tuple(r)[:2] for r in artefacts.flags_of(spark, none, path).collect()] == [("m1", 1)]
    other = spark.createDataFrame([("m9", 7, "A", "memory_probe", 1, "x"), ("m9", 8, "A", "memory_probe", 0, "x")], artefacts.FLAG)
    assert [tuple(r)[:2] for r in artefacts.flags_of(spark, other, path).collect()] == [("m9", 7)]
    assert artefacts.flags_of(spark, flags.where("quarantined = 0"), path).count() == 0  # a table without a true flag still wins
    told = {r.win: tuple(r)[2:] for r in artefacts.flag_summary(flags).collect()}
    assert told == {"A": (2, 1, 1, 1, 0.5), "B": (1, 1, 0, 0, 0.0)}


def test_split_and_its_keys(spark, tmp_path):
    rows = spark.createDataFrame([(i, "A" if i < 20 else "B", i % 2) for i in range(40)], "row_id bigint, win string, sports int")
    split = resampling.stratified_split(rows, ["win", "sports"], "row_id")
    counts = artefacts.write_split(split, str(tmp_path), "row_id", ["win", "sports"]).collect()
    assert len(counts) == 4 and all((r.n, r.calibration, r.test) == (10, 2, 8) for r in counts)
    back = spark.read.option("header", True).csv(str(tmp_path / "split.csv")).collect()
    drawn = {r.row_id for r in back if r.split == "calibration"}
    keys = {r.key for r in runlog.read_keys(spark, str(tmp_path / "calibration_keys.txt")).collect()}
    assert len(back) == 40 and len(drawn) == 8 and keys == drawn


def test_report_of_a_sample(spark):
    rows = spark.createDataFrame([(1, 1, None), (2, 1, "test"), (3, 2, "test")], "row_id bigint, bucket int, split string")
    got = {(r.grouping, r.value): (r.n, r.n_drawn) for r in artefacts.sample_report(rows, rows.where("row_id = 2"), ["bucket", "split"]).collect()}
    assert got == {("bucket", "1"): (2, 1), ("bucket", "2"): (1, 0), ("split", "(none)"): (1, 0), ("split", "test"): (2, 1)}
