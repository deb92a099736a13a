"""Operators 11 to 13 against plain versions on small tables with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from oddsmith.llm import audit, divergence, pii

SCHEMA = "doc_id long, text string, lang string, source string, n int, part string, _row int, term string"
EXTRA = (1, "p", 2, "t")
SPACES = r"[^\x20\x09-\x0D]+"


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


# ---------------------------------------------------------------- personal data

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and checks(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def checks(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(text):
    order = [k for k, *_ in BASE]
    out = [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, text) if ok(m.group())]
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


ODD = [
    None, "", " ", "a@b.c", "a@b@c.d e@f", "x.a@b.c%d@e.f.", "@b.c", "und.34@mail7.example.com geiever", "é.a@b.cé",
    "1.2.3.4.5.6.7.8 300.1.1.1.2.3.4.5 1.2.3 1..2.3.4 0000000001.02.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1111x 4111  1111 1111 1111",
    "4111111111111111 4111111111111112 12 34 4111111111111111", "+1 (017) 555-7713. +12 +123456789 +1------ +1 (017) 555-7713-", "+4111111111111111 ++49 30 1234567",
    "\U0001f600 a@b.c \U0001f600 10.0.0.1", "a" * 50_000, "1" * 50_000, "1." * 30_000, "a@" * 20_000, "+1" + "-" * 20_000, "9 " * 20_000, "x@y.z " * 500,
]


@pytest.mark.parametrize("text", [t for t in ODD if t is not None and len(t) < 5_000])
def test_patterns(text):
    assert pii.patterns(text) == plain_spans(text)


def test_patterns_of_random_texts():
    rng = random.Random(5)
    for _ in range(4_000):
        text = "".join(rng.choice("ab@@..111223+- ()é") for _ in range(rng.randrange(1, 60)))
        assert pii.patterns(text) == plain_spans(text), text


def named(spark):
    """A nickname that mostly stands by one address, in many surroundings; one that only copies tell; common words by both."""
    rng = random.Random(1)
    common = [f"w{i}" for i in range(30)]
    some = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [f"{some(20)} Zorro writes {some(2)} don@diego.example {some(20)}" for _ in range(12)]
    rows += [f"{some(9)} zorro {some(9)}", f"{some(30)} mail don@diego.example {some(5)}"]
    rows += [f"{some(8)} half {some(1)} 10.1.2.3 {some(1)} often {some(9)}" for _ in range(6)] + [f"{some(4)} half {some(4)}" for _ in range(4)]
    rows += [f"{some(4)} often {some(4)}" for _ in range(20)]
    copied = f"{some(5)} unique copy@only.example sentinel {some(5)}"
    rows += [copied] * 9 + [some(25) for _ in range(160)] + ODD
    return [(i if i % 7 else None, t, "en", "s") for i, t in enumerate(rows)]


def plain_revealing(texts):
    joint, of_entity, of_term, shapes = Counter(), Counter(), Counter(), defaultdict(Counter)
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    for text in texts:
        spans = plain_spans(text)
        found = [(m.start(), m.end(), lower(m.group())) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        of_term.update({t for *_, t in found})
        free = [(s, t) for s, e, t in found if not any(s < y and x < e for _, x, y in spans)]
        near = defaultdict(dict)
        for kind, start, end in spans:
            said = text[start:end]
            name = kind, lower(said) if kind in ("email", "ip") else re.sub("[^0-9]", "", said)
            at = sum(s < start for s, _ in free)
            near[name].update({})
            for k in range(max(0, at - 6), min(len(free), at + 6)):
                near[name].setdefault(free[k][1], (free[k - 1][1] if k else "", free[k + 1][1] if k + 1 < len(free) else ""))
        for name, terms in near.items():
            of_entity[name] += 1
            for t, around in terms.items():
                joint[name, t] += 1
                shapes[name, t][around] += 1
    out, n = {}, len(texts)
    for (name, t), j in joint.items():
        seen = shapes[name, t]
        if len(seen) >= 3 and 2 * max(seen.values()) <= j and of_entity[name] < n:
            info = math.log2(n / of_entity[name])
            out[t] = max(out.get(t, -9), math.log2(j * n / (of_entity[name] * of_term[t])) / info)
    return {t: "removed" if d >= 0.95 else "generalised" for t, d in out.items() if d >= 0.85}


def test_personal_data(spark):
    rows = [r for r in named(spark) if r[1] is None or len(r[1]) < 5_000]
    texts = [r[1] or "" for r in rows]
    levels = plain_revealing(texts)
    assert levels == {"zorro": "removed", "writes": "removed", "half": "generalised"}
    want = []
    for (doc, _, *_), text in zip(rows, texts, strict=True):
        base = plain_spans(text)
        added = []
        for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text):
            if m.group().lower() in levels and not any(m.start() < e and s < m.end() for _, s, e in base):
                added.append((levels[m.group().lower()], m.start(), m.end()))
        join = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        counts = [sum(k == kind for k, *_ in base) for kind in ("email", "ip", "card", "phone")]
        want.append((doc, *counts, hashlib.sha256(join(base).encode()).hexdigest(), join(sorted(base + added, key=lambda s: (s[1], pii.KINDS.index(s[0]))))))
    got = pii.digests(table(spark, rows))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_personal_data_in_long_texts_and_none(spark):
    long = [(i, t, "en", "s") for i, t in enumerate(ODD) if t and len(t) >= 5_000]
    got = {r["doc_id"]: r for r in pii.digests(table(spark, long)).collect()}
    assert len(got) == len(long) and sum(r["n_email"] for r in got.values()) == 0
    assert pii.digests(table(spark, [])).count() == 0


def test_sanitised_texts(spark):
    docs = table(spark, named(spark))
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    texts = [r["text"] for r in clean.collect()]
    assert len(texts) == docs.count() and texts.count(None) == 1
    assert not any(pii.patterns(t) or "orro" in t for t in texts if t and len(t) < 300)
    assert any("[EMAIL]" in t for t in texts if t) and any("[IP]" in t for t in texts if t)
    assert "a@b.c" not in texts and "[EMAIL]" in texts


# ---------------------------------------------------------------- filters

FAILS = {
    "A": lambda words, text: len(words) < 100,
    "B": lambda words, text: 100 * len(set(words)) < 80 * len(words),
    "C": lambda words, text: 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
    "D": lambda words, text: bool(re.search("[#$%&*|]", text)),
}


def test_filter_interactions(spark):
    rng = random.Random(2)
    texts = [None, "", "x" * 30_000, "# " * 200] + [
        " ".join((rng.choice("AB#|") if rng.random() < 0.15 else "") + f"w{rng.randrange(rng.choice((20, 5000)))}" for _ in range(rng.choice((20, 99, 100, 101, 150)))) for _ in range(60)
    ]
    texts += [rng.choice(texts) for _ in range(40)]
    rows = [(None if i % 11 == 0 else i % 90, t, rng.choice(["en", "de", None, ""]), "s") for i, t in enumerate(texts)]
    marks = [(i % 70, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(80)] + [(None, 1, 1)]
    good, toxic = ({d for d, *v in marks if d is not None and v[k] == 1} for k in (0, 1))
    judged = []
    for doc, text, lang, _ in rows:
        words = re.findall(SPACES, text or "")
        fails = {x for x, f in FAILS.items() if f(words, text or "")}
        if doc is not None and any(d is not None and d < doc and (t or "") == (text or "") for d, t, *_ in rows):
            fails.add("E")
        judged.append((lang or "", fails, doc in good, doc in toxic))
    want, orders = [], ["".join(o) for o in itertools.permutations("ABCDE")]
    for part in {p for p, *_ in judged}:
        shapley, found = Counter(), []
        for order in orders:
            left = [r for r in judged if r[0] == part]
            for k, x in enumerate(order):
                gone, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                shapley[x] += len(gone)
                failing = [r for r in judged if r[0] == part and x in r[1]]
                found.append((part, order, k + 1, len(left), len(gone), len(failing) - len(gone), sum(r[1] == {x} for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone), x))
        want += [(*r[:9], shapley[r[9]]) for r in found]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = audit.interactions(table(spark, rows), labels)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert audit.interactions(table(spark, []), labels).count() == 0


# ---------------------------------------------------------------- sources


def plain_divergence(rows, least=10, top=10):
    seen, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        seen[lang, source].update(terms)
        docs[lang].update(set(terms))
    f = lambda p, q: (p - q) * (p - q) // (p + q)
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = [g for g in groups if g[0] == lang]
        whole = Counter()
        for g in mine:
            whole.update(seen[g])

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q, p = shares(whole), {g: shares(seen[g]) for g in mine}
        for g in mine:
            pairs = sorted((-sum(f(p[g][t], p[o][t]) for t in kept), o[1].encode()) for o in mine if o != g)
            terms = sorted((-f(p[g][t], q[t]), t.encode()) for t in kept if seen[g][t] and p[g][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(*g, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "The", "é", "ÉCLAIR", "\U0001f600x", "don't", "a1b"] + [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows = [(i, " ".join(rng.choice(words) if rng.random() < 0.7 else words[(i % 5) * 9] for _ in range(rng.randrange(40))), rng.choice(["en", "en", "de", None, ""]), f"s{i % 5}" if i % 6 else None) for i in range(n)]
    return [*rows, *rows[:30], (None, "the " * 5_000, "en", "hot"), (1, None, "xx", "alone"), (2, "rare words only", "yy", "b"), (3, "", "yy", "a"), (4, "x", "yy", "c")]


@pytest.mark.parametrize("first", [64, 3])
def test_divergence(spark, monkeypatch, first):
    monkeypatch.setattr(divergence, "FIRST", first)
    monkeypatch.setattr(divergence, "GROWTH", 2)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "BITS", 3)
    rows = corpus(first)
    got = divergence.audit(table(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows)


def test_divergence_of_nothing(spark):
    assert divergence.audit(table(spark, [])).count() == 0


def test_best_first_opens_few_buckets(spark, monkeypatch):
    opened = []
    keep = divergence.store
    monkeypatch.setattr(divergence, "store", lambda df, name: (opened.append(name), keep(df, name))[1])
    divergence.audit(table(spark, corpus(9))).collect()
    assert 1 <= opened.count("divergence-best") <= 3
