"""The corpus operators against brute force on small tables with nulls, ties, repeats and clashing columns."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import tiktoken
import xxhash

from oddsmith.llm import bpe, brown, chat, codes, mixing, nbsvm, queries, rules, simhash, suffix, urls

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
LONG = " ".join(f"w{i * 7919 % 1009}x" for i in range(400))
COPY = " ".join(f"k{i * 31 % 97}" for i in range(120))
TEXTS = [
    None, "", "   \n\t", "one", "Tiny text here", LONG, LONG, LONG[:900] + " other end " + LONG[200:700], COPY + " tail", "head " + COPY,
    "éclair \U0001f600 naïve  spaces\n\nand\tlines " * 12, "a" * 3000, "the cat sat on the mat and " * 40, "Z" * 30 + " #$%& <tag> |\n" * 8,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, block int, n int, word string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), "k", 1, 2, "w") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "null id", None, None, None, None, None, None, None)], SCHEMA)


def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def test_suffix_dedup(docs):
    rows = plain(docs)
    data = [t.encode() for _, t in rows]
    starts = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    want = []
    for (doc, _), d in zip(rows, data, strict=True):
        gone = [False] * len(d)
        for i in range(len(d) - 399):
            if starts[d[i : i + 400]] > 1:
                gone[i : i + 400] = [True] * 400
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want.append((doc, len(d), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    assert sorted(map(tuple, suffix.digests(docs).collect()), key=str) == sorted(want, key=str)


def test_suffix_dedup_divides_a_shared_passage(spark, monkeypatch):
    monkeypatch.setattr(suffix, "KINDS_PER_TASK", 3)
    texts = [f"{i} " * (i + 1) + LONG[:1200] + f" {i}" * (20 - i) for i in range(12)]
    data = [t.encode() for t in texts]
    starts = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    want = {i: len({j for k in range(len(d) - 399) if starts[d[k : k + 400]] > 1 for j in range(k, k + 400)}) for i, d in enumerate(data)}
    found = suffix.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["n_removed"] for r in found.collect()} == want


@pytest.mark.parametrize("kinds", [4_096, 3])
def test_suffix_query_counts_passages_that_it_leaves(spark, tmp_path, monkeypatch, docs, kinds):
    monkeypatch.setattr(suffix, "KINDS_PER_TASK", kinds)
    passage = " ".join(f"p{i}q" for i in range(60))  # 289 bytes: below the strings that are removed
    texts = [*[r["text"] for r in docs.collect()], "alpha " * 9 + passage, passage + " omega" * 7, passage[:239], LONG[:300] + passage + LONG[300:], "own words " + " ".join(f"z{i}y" for i in range(90))]
    texts += [f"{i} " * (i + 1) + LONG[:500] + f" {i}" * (20 - i) for i in range(8)]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op3_suffix_dedup(spark, str(tmp_path)).collect()
    contract = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(r[c] for c in contract) for r in found) == sorted(map(tuple, suffix.digests(given).collect()))
    data = [(t or "").encode() for t in texts]
    starts = Counter(d[i : i + 240] for d in data for i in range(len(d) - 239))
    for r in found:
        d = data[r["doc_id"]]
        covered = [False] * len(d)
        for i in range(len(d) - 239):
            if starts[d[i : i + 240]] > 1:
                covered[i : i + 240] = [True] * 240
        assert (r["n_passage_bytes"], r["n_passages"]) == (sum(covered), sum(c and (i == 0 or not covered[i - 1]) for i, c in enumerate(covered)))
    alpha, omega = (next(r for r in found if (texts[r["doc_id"]] or "").startswith(t)) for t in ("alpha", passage + " omega"))
    assert alpha["n_removed"] == omega["n_removed"] == 0 and min(alpha["n_passage_bytes"], omega["n_passage_bytes"]) >= len(passage)


def test_suffix_passages_are_not_longer_than_strings(docs):
    assert suffix.digests(docs.limit(0), passage=240).count() == 0
    with pytest.raises(ValueError, match="longer"):
        suffix.digests(docs, 240, 241)


def fingerprint(text):
    words = [w for w in text.translate({i: i + 32 for i in range(65, 91)}).encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs):
    rows = plain(docs)
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for (doc, _), r in zip(rows, root, strict=True):
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    want = sorted(((doc, p, least.get(r)) for (doc, _), p, r in zip(rows, prints, root, strict=True)), key=str)
    got = [(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(least.values()))


def test_simhash_links_at_four_bits(spark):
    prints = [0, 0b1111, 0b11111, -1, -1 << 5, 0b1111 << 40 | 0b1111]
    pairs = {tuple(sorted((a, b))) for a in prints for b in prints if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    got = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    assert {(r["a"], r["b"]) for r in got} <= pairs

    def classes(links):
        of = {p: {p} for p in prints}
        for a, b in links:
            joined = of[a] | of[b]
            of |= dict.fromkeys(joined, joined)
        return {frozenset(x) for x in of.values()}

    assert classes([(r["a"], r["b"]) for r in got]) == classes(pairs)


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_keep_one_planted_copies(spark):
    texts, shares = [], []
    for k in range(120):
        words = [f"d{k}w{i}" for i in range(400)]
        copy, edits = list(words), 0
        goal = (0.8, 0.85, 0.9, 0.95, 0.6)[k % 5]
        while True:  # as many spread edits as the goal allows
            more = list(copy)
            more[7 + edits * 17] = "edit"
            if jaccard(" ".join(words), " ".join(more)) < goal:
                break
            copy, edits = more, edits + 1
        texts.append((" ".join(words), " ".join(copy)))
        shares.append(jaccard(*texts[-1]))
    assert min(shares) < 0.8 and all(s >= 0.8 for k, s in enumerate(shares) if k % 5 < 4)
    rows = [(1000 * j + k, t) for k, pair in enumerate(texts) for j, t in enumerate(pair)]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = {k for k, s in enumerate(shares) if s >= 0.8}
    recall = len([k for k in near if 1000 + k not in kept]) / len(near)
    print("recall", recall, "of", len(near))
    assert recall == 1.0
    assert kept == set(range(120)) | {1000 + k for k in range(120) if k not in near}


def test_keep_one_follows_chains_and_big_groups(spark):
    base = [f"b{i}" for i in range(300)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 300, 5)]
    chain = [" ".join(f"c{i}" for i in range(20 * k, 20 * k + 300)) for k in range(12)]
    rows = list(enumerate([*texts, *chain]))
    kept = [r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == [0, len(texts)]


def test_keep_one_rows_without_an_id_of_their_own(spark):
    other = lambda k: " ".join(f"o{k}w{i}" for i in range(60))
    rows = [(None, other(k)) for k in range(5)] + [(7, other(5)), (7, other(6)), (3, other(7)), (4, other(7) + " end"), (4, other(8))]
    rows += [(7, other(5)), (None, other(0)), (9, other(1))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, other(k)) for k in (0, 2, 3, 4)] + [(9, other(1)), (7, other(5)), (7, other(6)), (3, other(7)), (4, other(8))]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def test_bpe(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(i), known.encode_ordinary(t), t) for i, t in plain(docs))
    rows = bpe.encode(docs, RANKS, PATTERN).collect()
    got = sorted((str(r["doc_id"]), [int.from_bytes(r["ids"][k : k + 4], "little") for k in range(0, len(r["ids"]), 4)], r["decoded"].decode()) for r in rows)
    assert got == want


def test_brown(docs):
    rows = [(i, t.translate({k: k + 32 for k in range(65, 91)}).encode().split()) for i, t in plain(docs)]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter(w for i, ws in rows if not out(i) for w in [*ws, None])
    n, v = counts.total(), len(counts)
    want = {}
    for i, ws in rows:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, None])
        want[i] = (out(i), len(ws) + 1, sum(counts[w] > 0 for w in [*ws, None]), n, round(base, 6))
    got = brown.score(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got} == want
    # the score from the model's own classes, by plain loops
    model, _ = brown.train(docs)
    of = {w.encode(): int(model.classes[i]) for i, w in enumerate(model.listed)}
    pairs, total, types, own = Counter(), Counter(), Counter(), {}
    for i, ws in rows:
        if not out(i):
            for a, b in zip(["</s>", *ws], [*ws, "</s>"], strict=True):
                a, b = (brown.END_CLASS if x == "</s>" else of[x] for x in (a, b))
                pairs[a, b] += 1
                total[b] += 1
    for w in counts:
        types[brown.END_CLASS if w is None else of[w]] += 1
    everything = sum(total.values())

    def emitted(before, word):
        c = brown.END_CLASS if word is None else of.get(word, model.unseen)
        prior = (total[c] + 1) / (everything + brown.CLASSES)
        row = sum(n for (a, _), n in pairs.items() if a == before)
        return c, math.log10((pairs[before, c] + brown.PRIOR * prior) / (row + brown.PRIOR)) + math.log10((counts[word] + 0.1) / (total[c] + 0.1 * (types[c] + 1)))

    scores = {r["doc_id"]: r["score"] for r in got}
    for i, ws in rows:
        before, whole = brown.END_CLASS, 0.0
        for w in [*ws, None]:
            before, part = emitted(before, w)
            whole += part
        if i is not None and sum(1 for k, _ in rows if k == i) == 1:
            assert abs(scores[i] - whole) < 1e-6 * max(1, abs(whole))


def class_pairs(texts, of):
    pairs = np.zeros((brown.CLASSES, brown.CLASSES))
    for ws in texts:
        c = [brown.END_CLASS, *[of[w] for w in ws], brown.END_CLASS]
        np.add.at(pairs, (c[:-1], c[1:]), 1)
    return pairs


def test_brown_gains_are_differences_of_the_likelihood():
    random = np.random.default_rng(5)
    texts = [[f"w{k}" for k in np.minimum(random.geometric(0.15, 40), 12)] for _ in range(30)]  # with words after themselves
    of = {f"w{k}": k % 4 for k in range(1, 13)}
    pairs = class_pairs(texts, of)
    for w in of:
        seen = [(a, b) for ws in texts for a, b in zip(["", *ws], [*ws, ""], strict=True)]
        c = lambda x: of.get(x, brown.END_CLASS)
        after, before = np.zeros(brown.CLASSES), np.zeros(brown.CLASSES)
        for a, b in seen:
            after[c(b)] += a == w
            before[c(a)] += b == w
        gain = brown.gains(pairs, of[w], after, before, float(sum(a == b == w for a, b in seen)))
        for k in range(6):
            moved = brown.likelihood(class_pairs(texts, of | {w: k})) - brown.likelihood(pairs)
            assert abs(moved - (gain[k] - gain[of[w]])) < 1e-6


def test_brown_clusters_every_word(spark, monkeypatch):
    monkeypatch.setattr(brown, "MANY_TASKS", 2)
    random = __import__("random").Random(7)
    nouns, verbs = [f"n{k}" for k in range(60)], [f"v{k}" for k in range(60)]
    texts = [" ".join(x for _ in range(40) for x in (random.choice(nouns), random.choice(verbs))) for _ in range(80)]
    docs = spark.createDataFrame([*enumerate(texts), (1000, texts[0] + " n0 oncea n3 onceb")], "doc_id long, text string")
    got = brown.score(docs).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]
    split = docs.select("doc_id", "text", brown.held_out().alias("held_out"))
    words = sorted({w for t in texts for w in t.split()})
    coded = split.mapInArrow(brown._coder(words[:100]), "block long, doc_id long, held_out boolean, tokens binary, rare binary, words array<string>")
    kept = coded.where("words is null").collect()
    by_id = {r["doc_id"]: r for r in kept}
    for i, t in docs.collect():
        ids = np.frombuffer(by_id[i]["tokens"], "<i4").tolist()
        assert ids == [words.index(w) if w in words[:100] else brown.RARE for w in t.split()] + [brown.END]
        assert [h & (2**64 - 1) for h in np.frombuffer(by_id[i]["rare"], "<i8").tolist()] == [xxhash.xxh64_intdigest(w, 42) for w in t.split() if w not in words[:100]]
    start = np.concatenate([np.arange(brown.LISTED) % brown.CLUSTERS, [brown.UNLISTED, brown.END_CLASS]]).astype(np.int64)
    learn = coded.where("not held_out").select("tokens", "rare")
    classes, pairs, said = brown.cluster(spark, learn.select("tokens"), start, 4)
    assert max(said) > said[0] and brown.likelihood(pairs) == max(said)
    # every word that is not listed gets the class of its largest gain
    rows = learn.mapInArrow(brown._rare_profiles(classes), "hash long, at int, n long").groupBy("hash", "at").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    best = {r["hash"]: r["class"] for r in rows.coalesce(1).sortWithinPartitions("hash").mapInArrow(brown._rare_best(pairs), "hash long, class int").collect()}
    assert len(best) == len(words[100:]) + 2 or len(best) == len(words[100:])
    counts = {}
    for r in rows.collect():
        side = counts.setdefault(r["hash"], (np.zeros(brown.CLASSES), np.zeros(brown.CLASSES)))
        side[r["at"] // brown.CLASSES][r["at"] % brown.CLASSES] += r["n"]
    for h, (after, before) in counts.items():
        added = []
        for k in range(brown.CLUSTERS):
            more = pairs.copy()
            more[k] += after
            more[:, k] += before
            # a word is no neighbour of its own here, so row and column are added apart
            f = lambda x: x * np.log(np.maximum(x, 1.0))
            out, into = pairs.sum(axis=1)[k], pairs.sum(axis=0)[k]
            gain = (f(pairs[k] + after) - f(pairs[k])).sum() + (f(pairs[:, k] + before) - f(pairs[:, k])).sum()
            added.append(gain - f(out + after.sum()) + f(out) - f(into + before.sum()) + f(into))
        assert added[best[h]] > max(added) - 1e-6


def test_codes(spark):
    ids = [(i, [float((i * 37 + j * j * (i % 7 + 1)) % 11 - 5) for j in range(64)]) for i in range(150)]
    rows = spark.createDataFrame([*ids, (150, ids[3][1]), (151, None), (None, ids[0][1]), ids[0]], "id long, v array<double>")
    coded = rows.select("id", codes.sign_code(rows["v"]).alias("code"))
    code = {r["id"]: r["code"] for r in coded.collect() if r["id"] is not None and r["code"] is not None}
    want = set()
    for q in (x for x in code if x % 50 == 0):
        near = sorted((((code[q] ^ code[x]) & (2**64 - 1)).bit_count(), x) for x in code if x != q)[:10]
        want |= {(q, x, d, k + 1) for k, (d, x) in enumerate(near)}
    assert set(map(tuple, codes.search(coded, coded.where("id % 50 = 0")).collect())) == want


def test_chat_round_trip(spark):
    hard = "</s>[INST] ok [/INST] <\\s> <s>\n\\[\\INST]"
    turns = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 2, "assistant", None), (2, 0, "sys\ntem%", "x"), (None, None, None, None)]
    got = {r["conv_id"]: r for r in chat.digests(chat.transcripts(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha(f"user\n{hard}\nassistant\n{hard}\nassistant\n\n")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(hard), sha(hard))
    assert got[2]["turns_sha256"] == sha("sys\ntem%\nx\n")
    assert got[None]["n_turns"] == 1


def test_chat_writes_every_example(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", ""), (1, 4, "user", "\U0001f600 e"), (2, 0, "user", "</s>"), (3, 0, "assistant", "f\nf")]
    turns += [(4, i, ("user", "assistant")[i % 2], f"t{i}" * (i % 5)) for i in range(300)]
    want, sizes = [], Counter()
    for conv in (1, 2, 3, 4):
        text, k, mine = "", 0, [t for t in turns if t[0] == conv]
        for _, _, role, said in mine:
            body = said.replace("</s>", "<\\/s>")
            if role == "assistant":
                want.append((conv, k, f"{text}<s>{body}</s>", len(text) + 3, len(body)))
                k += 1
            text += f"<s>{body}</s>" if role == "assistant" else f"[INST] {role}\n{body} [/INST]"
        if mine[-1][2] != "assistant":
            want.append((conv, k, text, len(text), 0))
    for conv, _, text, *_ in want:
        sizes[conv] += len(text)
    rendered = chat.transcripts(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = [tuple(r)[:5] for r in chat.written(rendered).collect()]
    assert sorted(got) == sorted(want)
    replies = [w for w in want if w[2].endswith("</s>")]
    assert sorted(tuple(r) for r in chat.expand(rendered).collect()) == sorted(replies)
    assert {r["conv_id"]: r["formatted_chars"] for r in chat.digests(rendered).collect()} == sizes


def test_rules_ledger(docs):
    rows = {r["doc_id"]: r for r in rules.ledger(docs).collect()}
    assert rows[0]["n_words"] == 0 and rows[12]["n_repeat_words"] == rows[12]["n_words"] == 280
    for r in rules.ablation(rules.ledger(docs), "base").collect():
        assert r["n_failed"] >= r["n_failed_alone"]
    assert rules.keep_good(docs).columns == docs.columns


def test_url_rules(spark):
    given = {1: "http://A.org/x/1?q", 2: "https://b.example.org/es/p", 3: "x://example.org/en/12", 4: "http://z.com/de/1", 5: None, 6: "no scheme", 7: "http://notexample.org/es/"}
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(list(given.items()), "page_id long, url string")).collect()}
    assert [got[i]["rule"] for i in range(1, 8)] == ["org/", "example.org/es/", "example.org/en/1", "com/de/", None, None, "org/"]
    assert (got[1]["host"], got[1]["path"], got[5]["host"], got[6]["path"]) == ("a.org", "/x/1", "", "")
    assert [got[i]["verdict"] for i in (1, 2, 3, 4)] == ["allow", "block", "block", "block"]


def plain_tree(rows, smooth=5.0):
    """{(host, path): (branch, purity)} from (host, path, label), by plain recursion over levels."""
    import re

    at = {}
    for host in {h for h, _, _ in rows}:
        mine = [([x for x in p.split("/") if x], p) for h, p, _ in rows if h == host]

        def descend(members, prefix, level, host=host):
            deeper = [m for m in members if len(m[0]) > level]
            for segs, p in members:
                if len(segs) <= level:
                    at[host, p] = prefix
            if len(deeper) < urls.MIN_URLS:
                for _, p in deeper:
                    at[host, p] = [*prefix, "**"]
                return
            seen = Counter(m[0][level] for m in deeper)
            groups = {}
            for m in deeper:
                x = m[0][level]
                groups.setdefault(x if seen[x] >= urls.MIN_URLS and not re.search(urls.VARIABLE, x) else "*", []).append(m)
            for x, group in groups.items():
                descend(group, [*prefix, x], level + 1)

        descend(mine, [""], 0)
    now = {key: tuple(parts) for key, parts in at.items()}
    for level in range(max(map(len, now.values())) - 1, 0, -1):
        star = {k: tuple("*" if i == level and x != "**" else x for i, x in enumerate(v)) for k, v in now.items()}

        def count(of):
            out = {}
            for h, p, label in rows:
                if label is not None:
                    out.setdefault((h, of[h, p]), [0, 0])[1 - label] += 1
            return out

        own, pool, after = count(now), count(star), {}
        for (h, p), parts in now.items():
            (g, b), (pg, pb) = own.get((h, parts), (0, 0)), pool.get((h, star[h, p]), (0, 0))
            under = (g + b) * (pg + pb - g - b) * pg * pb
            cross = g * (pb - b) - b * (pg - g)
            alike = (pg + pb) * cross * cross / under < urls.SIGNIFICANT if under else g + b > 0 or pg + pb == 0
            after[h, p] = star[h, p] if alike else parts
        now = after
    labels = [(h, "/".join(now[h, p]), y) for h, p, y in rows if y is not None]
    share = sum(y for _, _, y in labels) / len(labels)
    out = {}
    for (h, p), parts in now.items():
        branch, prior = "/".join(parts), share
        for some in ([y for k, _, y in labels if k == h], [y for _, t, y in labels if t == branch], [y for k, t, y in labels if (k, t) == (h, branch)]):
            prior = (sum(some) + smooth * prior) / (len(some) + smooth)
        out[h, p] = branch, round(prior, 9)
    return out


def test_url_tree_equals_a_plain_one(spark):
    rows = []
    for k in range(100):  # a host of a hundred sections, some good and some bad
        rows += [("big.example", f"/s{chr(97 + k // 10)}{chr(97 + k % 10)}/{i}", 1 if k % 3 else 0) for i in range(22)]
    for end, label in (("good", 1), ("bad", 0)):  # told apart by the sixth segment only
        rows += [("deep.example", f"/a/b/c/d/{end}/item{chr(97 + i % 26)}{chr(97 + i // 26)}/x", label) for i in range(60)]
    rows += [("bare.example", f"/a/b/c/d/bad/{i}", None) for i in range(40)] + [("bare.example", "/rare/path", None), ("", "", None), ("deep.example", "/a", 1)]
    got_paths, tree = urls.template_tree(spark.createDataFrame(rows, "host string, path string, label int"))
    got = got_paths.join(tree, ["host", "template"]).collect()
    want = plain_tree(rows)
    assert {(r["host"], r["path"]): (r["branch"], round(r["purity"], 9)) for r in got} == want
    purity = {(r["host"], r["path"]): r["purity"] for r in got}
    assert purity["deep.example", "/a/b/c/d/bad/itemaa/x"] < 0.5 < purity["deep.example", "/a/b/c/d/good/itemaa/x"]
    assert purity["big.example", "/saa/3"] < 0.5 < purity["big.example", "/sab/3"]


def test_url_judge_edge_cases(spark):
    pages = spark.createDataFrame([(1, None), (1, None), (2, "no url"), (3, "http://A.Example.COM/fr/x?q"), (4, "http://net.org#f")], "page_id int, url string")
    got = sorted(tuple(r)[:5] for r in urls.judge(pages).collect())
    assert got == sorted([(1, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.com", "/fr/x", "com/fr/", "allow"), (4, "net.org", "", None, "allow")])
    assert urls.judge(pages.limit(0)).count() == 0


def test_mixing(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 9 + 1), ["a", "b", None][i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.mix_sizes(docs).collect()
    for s in {r["target"] for r in rows}:
        part = [r for r in rows if r["target"] == s]
        assert abs(sum(r["taken"] for r in part) - s) <= 10
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(rows) == sorted(mixing.mix_sizes(docs).collect())
    assert mixing.mix(docs).count() == sum(r["taken"] // r["size"] for r in rows)


def test_mixing_cuts_rows_without_an_id_of_their_own(spark):
    rows = [(None if i % 3 == 0 else i, f"t{i} " * (i % 9 + 1), ["a", "b", "c"][i // 3 % 3]) for i in range(1800)]
    rows += [(5, "same words here", "a")] * 500 + [(None, None, "b"), (None, "alike " * 4, "d")] + [(None, "alike " * 4, "d")] * 999
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_sizes(docs).collect()
    assert len(found) == len(rows)
    for size, target in {(r["source_size"], r["target"]) for r in found}:
        assert abs(sum(r["taken"] for r in found if (r["source_size"], r["target"]) == (size, target)) - target) <= 5
    assert sorted(found, key=str) == sorted(mixing.mix_sizes(docs).collect(), key=str)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(r["taken"] for r in found)


def test_classifier(spark):
    text = lambda i: "plain words make a calm sentence here " * 5 if i % 2 else "$$ buy!! NOW 999 cl1ck " * 6
    docs = spark.createDataFrame([(i, f"{text(i)} {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    held = [r for r in nbsvm.score(docs, labels).collect() if r["held_out"]]
    assert held and all(r["predicted"] == r["doc_id"] % 2 for r in held)
    assert {r["score"] for r in nbsvm.score(docs, labels.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("run", [suffix.digests, brown.score, simhash.near_duplicates, rules.ledger, mixing.mix_sizes, lambda d: bpe.digests(d, RANKS, PATTERN)])
def test_empty_table(docs, run):
    assert run(docs.limit(0)).count() == 0


def test_copies_by_blocks_are_those_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRED", 3)
    monkeypatch.setattr(simhash, "BLOCK", 700)
    random = __import__("random").Random(3)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(w if random.random() > 0.028 else f"x{k}{i}" for i, w in enumerate(base)) for k in range(60)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert 5 < len(set(root)) < 55
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in kept} == set(root)


def test_repeats_of_any_length_and_clashing_columns(spark, docs):
    passage = " ".join(f"p{i}q" for i in range(60))
    rows = [(1, "alpha " * 9 + passage + " omega", 1, "k"), (2, "beta " * 7 + passage + " end", 2, "k"), (3, passage[:200], 3, "k")]
    given = spark.createDataFrame(rows, "doc_id long, text string, start int, key string")
    out = {r["doc_id"]: r for r in suffix.remove_repeats(given).collect()}
    assert passage[20:-20] not in out[1]["text"] + out[2]["text"] and out[1]["text"].startswith("alpha ") and out[2]["text"].endswith("end")
    assert out[3]["text"] == rows[2][1] and (out[3]["start"], out[3]["key"]) == (3, "k")
    assert suffix.remove_repeats(docs).columns == docs.columns and suffix.remove_repeats(docs).count() == docs.count()


def test_bpe_long_pieces(spark):
    random = __import__("random").Random(5)
    texts = [
        "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)), "b" + "a" * 9_001, "é" * 3_000 + "ab" * 4_000,
        base64.b64encode(random.randbytes(9_000)).decode(), "".join(random.choice(["ab", "the", "ing", "é", "zz", "aaaa", "ЖД"]) for _ in range(6_000)),
    ]
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    known = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for row, text in zip(sorted(bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS, PATTERN).collect()), texts, strict=True):
        assert row["ids"] == b"".join(i.to_bytes(4, "little") for i in known.encode_ordinary(text))
        assert row["decoded"] == text.encode()


def test_dual_coordinate_descent_finds_the_least_objective():
    random = np.random.default_rng(9)
    values = random.normal(size=12)
    rows = [np.sort(random.choice(12, 5, replace=False)) for _ in range(40)]
    y = np.where(random.random(40) < 0.5, 1.0, -1.0)
    cost = np.where(y > 0, 0.7, 1.3)

    def objective(w, b):
        return 0.5 * (w @ w + b * b) + sum(c * max(0.0, 1 - s * (w[r] @ values[r] + b)) for r, s, c in zip(rows, y, cost, strict=True))

    w, b = nbsvm.dual_coordinate_descent(rows, values, y, cost, 2000)
    least = objective(w, b)
    for size in (1e-3, 1e-2, 0.1):
        for _ in range(200):
            assert objective(w + size * random.normal(size=12), b + size * random.normal()) > least - 1e-6


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["good words here", "BAD !!! $$$", None, ""] * 20)], "doc_id long, text string")
    one = spark.createDataFrame([(i, 1) for i in range(0, 80, 4)], "doc_id long, quality int")
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    for labels in (one, none):
        got = nbsvm.score(docs, labels).collect()
        assert len(got) == 80 and all(0 <= r["score"] <= 1 for r in got)
    both = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80) if i % 4 < 2], "doc_id long, quality int")
    twice = docs.unionByName(docs.selectExpr("doc_id", "concat(text, ' other') as text"))
    first, again = (sorted(nbsvm.score(d, both).collect(), key=str) for d in (twice, twice.orderBy("text")))
    assert first == again
    assert nbsvm.score(docs.limit(0), both).count() == 0
