"""Personal data: patterns find the protected entities, and corpus co-occurrence finds the terms that give them away.

1. One pass finds the spans of the patterns and counts, for each entity (one address, one number), the terms within
   ``WINDOW`` terms of it, with their neighbours, in how many documents.
2. A term is a candidate for an entity if it stands near it in at least ``LEAST_CONTEXTS`` different surroundings of which none makes
   up over half: copies of one document are one surrounding, whatever their number.
3. A second pass counts the documents of the candidates.  What a term t discloses of an entity c, out of all there is to disclose, is
   PMI(c; t) / IC(c) = log2(n_ct N / (n_c n_t)) / log2(N / n_c), at most 1.  From ``REMOVE`` on a term is removed, from ``GENERALISE``
   on it is generalised to what kind of word it is, wherever it stands.
4. A third pass writes the patterns' spans again and the places of those terms.

Passes 2 and 4 leave out most terms by a bitmap of fixed size; joins with the exact terms follow, so a full bitmap costs time only.

Edge cases: a null text counts as empty and has no spans; rows with the same or no doc_id are documents of their own; an entity in every
document has nothing left to disclose; terms that overlap a pattern's span are left to it; an empty table gives no rows.  Texts are searched
whole and in linear time, however long; columns that are not asked for are not read.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, store, text_of

WINDOW, LEAST_CONTEXTS = 6, 3
REMOVE, GENERALISE = 0.95, 0.85
#: Bits of the bitmap of terms, and how many terms or counts a task holds at most.
BITS, HELD = 1 << 20, 400_000

#: Kinds of spans in order, and the patterns of the first four.
KINDS = ("email", "ip", "card", "phone", "removed", "generalised")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: A term: letters, digits and all that is not ASCII.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: The same over UTF-8: the bytes of terms in lower case, all others spaces.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
_SPANS = "array<struct<kind: string, start: int, end: int>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_ARROW_TERMS = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Looked for from each ``@`` backwards and forwards, as long runs without one would be tried from each character."""
    done, at = 0, text.find("@")
    while at >= 0:
        local = _LOCAL.match(text[done:at][::-1])
        domain = _DOMAIN.match(text, at) if local else None
        if domain:
            yield at - local.end(), domain.end()
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Four at a time of each dotted chain of numbers."""
    for m in _DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            start, parts = m.start(), m.group().split(".")
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = start + sum(map(len, four)) + 3
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                    yield start, end
                start = end + 1


def luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (twice + sum(map(int, digits[-1::-2]))) % 10 == 0


def patterns(text: str) -> list[Span]:
    """The base spans in order of start and kind."""
    out = [("email", *x) for x in _emails(text)] if "@" in text else []
    if _DOTTED.search(text):
        out += [("ip", *x) for x in _ips(text)] if "." in text else []
        for m in _NUMBER.finditer(text):
            if len(m.group()) >= 12 and 12 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def entity(text: str, span: Span) -> str:
    """What a span says, whatever its case and separators."""
    kind, value = span[0], text[span[1] : span[2]]
    return f"{kind}:{value.translate(_LOWER) if kind in ('email', 'ip') else _NOT_DIGIT.sub('', value)}"


def _outside(spans: list[Span]) -> Callable[[int, int], bool]:
    """Whether a stretch overlaps none of the spans; for stretches asked in order."""
    ends: list[int] = []
    for _, _, end in spans:
        ends.append(max(end, ends[-1] if ends else 0))
    starts = [s for _, s, _ in spans]
    return lambda start, end: not (k := bisect.bisect_left(starts, end)) or ends[k - 1] <= start


def contexts(text: str, spans: list[Span]) -> dict[str, dict[str, tuple[str, str]]]:
    """For each entity of a text the terms near it, each with its neighbours where it first stands there."""
    free = _outside(spans)
    terms = [(m.start(), m.group().translate(_LOWER)) for m in TERM.finditer(text) if free(m.start(), m.end())]
    starts, out = [s for s, _ in terms], {}
    for span in spans:
        near = out.setdefault(entity(text, span), {})
        at = bisect.bisect_left(starts, span[1])
        for k in range(max(0, at - WINDOW), min(len(terms), at + WINDOW)):
            near.setdefault(terms[k][1], (terms[k - 1][1] if k else "", terms[k + 1][1] if k + 1 < len(terms) else ""))
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for b in batches:
        for x in b.column("text"):
            yield x.as_py()


def terms_of(text: str) -> set[bytes]:
    """The terms of a text, in UTF-8."""
    return set(text.encode().translate(_TERMS).split())


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, term, before, after, n): documents by entity, term and neighbours; a null term counts the entity's documents."""
    held: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            columns = [pa.array(c, pa.string()) for c in zip(*held, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), pa.int64())], ["entity", "term", "before", "after", "n"])
            held.clear()

    for text in _texts(batches):
        spans = patterns(text)
        for name, near in contexts(text, spans).items() if spans else ():
            held[name, None, None, None] += 1
            held.update((name, term, *around) for term, around in near.items())
        if len(held) >= HELD:
            yield from out()
    yield from out()


def _bitmap(terms: DataFrame) -> bytes:
    """One bit per hash of a term: never more than BITS bits, whatever the number of terms."""
    size = 32_768  # bits of one piece
    bit = F.pmod(F.xxhash64("term"), F.lit(BITS))
    bits = terms.groupBy(F.call_function("div", bit, F.lit(size)).alias("piece")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(size))).alias("bits"))
    found = {r["piece"]: bytes(r["bits"]) for r in bits.collect()}
    return b"".join(found.get(k, bytes(size // 8)) for k in range(BITS // size))


class _Maybe(dict):
    """Whether a term may be among those of a bitmap; remembered for as many terms as a task holds."""

    def __init__(self, bits: bytes) -> None:
        super().__init__()
        self.bits = bits

    def __missing__(self, term: bytes) -> bool:
        if len(self) >= HELD:
            self.clear()
        h = xxhash.xxh64_intdigest(term, 42) % BITS
        self[term] = said = bool(self.bits[h >> 3] >> (h & 7) & 1)
        return said


def _counter(bits: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, maybe = Counter(), _Maybe(bits)

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "n"])
                held.clear()

        for text in _texts(batches):
            held.update(t for t in terms_of(text) if maybe[t])
            if len(held) >= HELD:
                yield from out()
        yield from out()

    return run


def disclosure(joint: Column, of_entity: Column, of_term: Column, docs: Column) -> Column:
    """PMI of an entity and a term as a share of the entity's information; null if the entity has none."""
    info = F.log2(docs) - F.log2(of_entity)
    return F.when(of_entity < docs, (info + F.log2(joint) - F.log2(of_term)) / info)


def revealing(texts: DataFrame) -> DataFrame:
    """(term, level): stored; the terms that disclose too much of some entity."""
    seen = store(texts.mapInArrow(_mentions, "entity string, term string, before string, after string, n bigint").groupBy("entity", "term", "before", "after").agg(F.sum("n").alias("n")), "pii-contexts")
    entities = seen.where("term is null").select("entity", F.col("n").alias("_of_entity"))
    near = seen.where("term is not null").groupBy("entity", "term").agg(F.sum("n").alias("_joint"), F.count("*").alias("_kinds"), F.max("n").alias("_most"))
    candidates = store(near.where((F.col("_kinds") >= LEAST_CONTEXTS) & (2 * F.col("_most") <= F.col("_joint"))).join(entities, "entity"), "pii-candidates")
    counts = texts.mapInArrow(_counter(_bitmap(candidates)), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("_of_term"))
    known = candidates.join(counts, "term").withColumn("_d", disclosure(F.col("_joint"), F.col("_of_entity"), F.col("_of_term"), F.lit(texts.count())))
    worst = known.groupBy("term").agg(F.max("_d").alias("_d")).where(F.col("_d") >= GENERALISE)
    return store(worst.select("term", F.when(F.col("_d") >= REMOVE, "removed").otherwise("generalised").alias("level")), "pii-terms")


def _locator(bits: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = _Maybe(bits)
        for b in batches:
            base, places = [], []
            for text in _texts([b]):
                spans = patterns(text)
                wanted = {t.decode() for t in terms_of(text) if maybe[t]}
                free = _outside(spans)
                terms = ((m.group().translate(_LOWER), m.start(), m.end()) for m in TERM.finditer(text)) if wanted else ()
                places.append([t for t in terms if t[0] in wanted and free(*t[1:])])
                base.append(spans)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(base, _ARROW_SPANS), pa.array(places, _ARROW_TERMS)], ["doc", "base", "places"])

    return run


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(doc, base, added): the columns of ``keep`` as a struct, the patterns' spans, and those of revealing terms, all in order."""
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), text_of().alias("text"))
    terms = revealing(texts.select("text"))
    kind = texts.schema["doc"].dataType.simpleString()
    located = texts.mapInArrow(_locator(_bitmap(terms)), f"doc {kind}, base {_SPANS}, places array<struct<term: string, start: int, end: int>>")
    located = store(located.withColumn("_row", F.monotonically_increasing_id()), "pii-located")
    places = located.select("_row", F.inline("places")).join(terms, "term").groupBy("_row")  # the places of one document
    added = places.agg(F.array_sort(F.collect_list(F.struct("start", "end", "level"))).alias("_added"))
    turned = F.transform(F.coalesce("_added", F.array()), lambda x: F.struct(x["level"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return located.join(added, "_row", "left").select("doc", "base", turned.alias("added"))


def _ordered(spans: Column) -> Column:
    """By start, then kind."""
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(F.lit(list(KINDS)), x["kind"]).alias("k"), x.alias("span")))
    return F.transform(F.array_sort(keyed), lambda x: x["span"])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts by pattern, digest of the patterns' spans, and all spans."""
    found = find(docs, ["doc_id"])
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc.doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(_ordered(F.concat("base", "added"))).alias("spans"))


def _stand_in(kind: Column, said: Column) -> Column:
    """What replaces a span: its kind; of a generalised term the kind of word; nothing for a removed one."""
    word = F.when(F.rlike(said, F.lit("[0-9]")), "[CODE]").when(ascii_lower(said) != said, "[NAME]").otherwise("[TERM]")
    return F.when(kind == "removed", "").when(kind == "generalised", word).otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))


def sanitise(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their columns, and in place of each text the text without what its spans give away.

    Of overlapping spans the first, or with the same start the one of the kind named first, is replaced whole, and of
    the others what stands after it.
    """
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    step = F.aggregate(
        _ordered(F.concat("base", "added")),
        F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("upto")),
        lambda a, x: F.when(x["end"] <= a["upto"], a).otherwise(
            F.struct(
                F.concat(a["parts"], F.array(F.substring(text, a["upto"] + 1, F.greatest(x["start"] - a["upto"], F.lit(0))), _stand_in(x["kind"], F.substring(text, x["start"] + 1, x["end"] - x["start"])))).alias("parts"),
                x["end"].alias("upto"),
            )
        ),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["upto"] + 1, F.length(text))),
    )
    rows = find(docs, docs.columns).select("doc", F.when(F.col("doc.text").isNotNull(), step).alias("_clean"))
    return rows.select(*[F.col("_clean").alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])
