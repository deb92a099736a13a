"""Operators that return the columns of their input leave every column alone, whatever its name."""

import pytest

from oddsmith.llm import mixing, rules, simhash, suffix

NAMES = ["_node", "_row", "_keys", "_digest", "_copies", "_copy", "_order", "_root", "_place", "_hash", "_one", "_key", "_text", "_spans", "_given", "_words", "_cut_source", "node", "root", "key", "tie", "size", "n", "failed", "a.b", "_1"]


@pytest.mark.parametrize("name,operator", [("rules", rules.keep_good), ("copies", simhash.keep_one), ("suffix", suffix.remove_repeats), ("mix", mixing.mix)])
def test_clashing_columns(spark, name, operator):
    texts = [" ".join(f"w{i}x{k * 7 % 61}" for k in range(70)) for i in range(12)]
    rows = [(i, t, "s", *[f"{n}{i}" for n in NAMES]) for i, t in enumerate([*texts, texts[0]])]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *NAMES])
    out = operator(docs)
    assert out.columns == docs.columns
    given = {r[0]: tuple(r)[2:] for r in rows}
    found = out.collect()
    assert found and all(tuple(r)[2:] == given[r["doc_id"]] for r in found)
