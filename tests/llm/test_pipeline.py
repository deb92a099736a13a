"""The five stages of the pipeline against a plain version: DuckDB for rules and mix, loops and tiktoken for the rest."""

import base64
import random
from collections import Counter

import duckdb
import pandas as pd
import tiktoken

import corpus_pipeline
from oddsmith.llm import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PASSAGE = 240


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


def made():
    rng = random.Random(11)
    texts = [words(rng, rng.randint(60, 130)) for _ in range(18)]
    passage = words(rng, 60)
    texts[3] = texts[3] + " " + passage + " " + words(rng, 30)
    texts[9] = words(rng, 40) + " " + passage + " " + texts[9]
    near = texts[5].split()
    near[20] = "changed"
    texts += [" ".join(near), texts[6], "too short", None, "", "Z" * 30 + " #$%& <tag> |\n" * 60, "the cat sat " * 40]
    rows = [(i if i != 7 else None, t, "en", None if i % 6 == 5 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, (2, words(rng, 70), "en", "s0", 0), (2, texts[2], "en", "s2", 0)]


def plain(rows):
    db = duckdb.connect()
    documents = pd.DataFrame(rows, columns=COLUMNS).astype({"doc_id": "Int64"})
    numbered = documents.assign(doc_id=range(len(documents)))
    db.register("documents", numbered)
    kept = {r[0] for r in db.sql(f"select doc_id from ({queries.ORACLE_SQL['op7_quality_rules']}) where kept").fetchall()}
    rows = [r for i, r in enumerate(rows) if i in kept]
    sets = []
    for r in rows:
        w = r[1].lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    order = lambda r: (r[0] is None, r[0] or 0)
    rows = [min((r for r, x in zip(rows, root, strict=True) if x == g), key=order) for g in sorted(set(root))]
    data = [r[1].encode() for r in rows]
    starts = Counter(d[i : i + PASSAGE] for d in data for i in range(len(d) - PASSAGE + 1))
    cut = []
    for r, d in zip(rows, data, strict=True):
        gone = [False] * len(d)
        for i in range(len(d) - PASSAGE + 1):
            if starts[d[i : i + PASSAGE]] > 1:
                gone[i : i + PASSAGE] = [True] * PASSAGE
        text = bytes(c for c, g in zip(d, gone, strict=True) if not g).decode()
        cut.append((r[0], text, r[2], r[3], len(text)))
    assert sum(len(r[1]) for r in cut) < sum(map(len, data))
    # the mix orders rows by id and then by text: ids are told apart by their text here
    db.register("documents", pd.DataFrame(cut, columns=COLUMNS).astype({"doc_id": "Int64"}))
    mixed = Counter()
    for doc, size, taken in db.sql(f"select doc_id, size, taken from ({queries.ORACLE_SQL['op10_source_mixing']})").fetchall():
        mixed[doc] += taken // size if size else 0
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(queries.RANKS, "rb"))}
    known = tiktoken.Encoding("x", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cut, mixed, known


def test_pipeline_equals_a_plain_one(spark, tmp_path):
    rows = made()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    cut, mixed, known = plain(rows)
    ids = Counter(r[0] for r in cut)
    assert ids[2] == 2 and ids[None] == 1 and len(cut) < len(rows) - 5
    seen = Counter(r["doc_id"] for r in got)
    assert {i: n for i, n in seen.items() if ids[i] == 1} == {i: n for i, n in mixed.items() if n and ids[i] == 1}
    texts = {}
    for r in cut:
        texts.setdefault(r[0], set()).add(r[1])
    for r in got:
        said = bytes(r["decoded"]).decode()
        assert said in texts[r["doc_id"]]
        assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in known.encode_ordinary(said))


def test_stages_on_an_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, start int, _kept int, n int"
    docs = spark.createDataFrame([(1, words(random.Random(1), 80), "en", "a", 9, "k", 1, 2, 3)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "").columns == docs.columns
        assert [r["key"] for r in stage(spark, docs, "").collect()][:1] == ["k"], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0
