"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, brown, chat, codes, divergence, mixing, nbsvm, pii, rules, simhash, suffix, urls
from .common import read_table

#: The rank file and pattern of the tokenizer; both are parameters of the operator.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
MARKED = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], given.schema)
    return chat.digests(chat.transcripts(given.unionByName(marked)))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(read_table(spark, sf_dir, "documents"), passage=suffix.PASSAGE)


def op4_code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), codes.sign_code(F.col("embedding")).alias("code"))
    return codes.search(rows, rows.where("id % 50 = 0"))


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(read_table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.ledger(read_table(spark, sf_dir, "documents"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(*columns, rules.rejected("base").alias("base_failed"), (~rules.rejected("v1")).alias("kept"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(read_table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(read_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_url_filter, op3_suffix_dedup, op4_code_search, op5_brown_lm, op6_simhash_dedup,
        op7_quality_rules, op8_byte_bpe, op9_quality_classifier, op10_source_mixing,
        op11_pii, op12_filter_audit, op13_source_divergence, pipeline,
    )
}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = f"case when trim(coalesce(text, ''), {_SPACES}) = '' then [] else string_split_regex(trim(coalesce(text, ''), {_SPACES}), '[ \\x09-\\x0D]+') end"

_CHAT_SQL = r"""
with given as (
    select conv_id, turn, role, text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
           row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k
    from given
), sized as (
    select *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) as body,
           length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) as head
    from turns
), placed as (
    select *, role = 'assistant' as reply,
           sum(case when role = 'assistant' then 7 + body else 16 + head + body end) over (partition by conv_id order by k) as upto,
           count(*) over (partition by conv_id) as n
    from sized
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where reply), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by k) filter (where reply), '')) as loss_sha256,
       cast(sum(case when reply then upto when k = n then upto else 0 end) as bigint) as formatted_chars
from placed group by conv_id
"""

_CODES_SQL = """
with coded as (
    select distinct vec_id as id, list_reduce(list_prepend(0::hugeint, list_transform(range(len(embedding)),
           lambda i: case when embedding[i + 1] > 0 then 1::hugeint << (i % 64) else 0::hugeint end)), lambda a, b: xor(a, b)) as code
    from embeddings where vec_id is not null and embedding is not null
), near as (
    select q.id as query_id, c.id as neighbor_id, cast(bit_count(xor(q.code, c.code)) as integer) as distance
    from coded q join coded c on q.id <> c.id where q.id % 50 = 0
)
select query_id, neighbor_id, distance, cast(rank as integer) as rank from (
    select *, row_number() over (partition by query_id order by distance, neighbor_id) as rank from near
) where rank <= 10
"""

_RULES_SQL = f"""
with docs as (
    select row_number() over () as r, doc_id, coalesce(text, '') as text, {_WORDS} as words from documents
), windows as (
    select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w from (
        select r, words, unnest(range(1, len(words) - 1)) as i from docs
    )
), often as (
    select r, w from windows group by r, w having count(*) > 1
), repeated as (
    select r, count(distinct i + d) as n from windows join often using (r, w), (select unnest([0, 1, 2]) as d) group by r
), measured as (
    select docs.r, doc_id, cast(len(words) as bigint) as n_words,
           cast(length(translate(text, {_SPACES}, '')) as bigint) as word_chars,
           cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
           length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) as n_shouted,
           list_filter(string_split(text, chr(10)), lambda x: trim(x, {_SPACES}) <> '') as lines,
           cast(coalesce(n, 0) as bigint) as n_repeat_words
    from docs left join repeated using (r)
), counted as (
    select *, len(lines) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines from measured
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not ({' or '.join(f'({c})' for _, _, c in rules.RULES)}) as kept
from counted
"""

_MIX_SQL = f"""
with sizes as (
    select doc_id, source, cast(len({_WORDS}) as bigint) as size from documents
), sources as (
    select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as place from sizes group by source
), weighted as (
    select *, [3.0::double, 1.0::double, 2.0::double][place % 3 + 1] as weight, source_size * 2.0::double as cap,
           sum(source_size) over () * 1.5::double as budget from sources
), room as (
    select *, sum(cap) over (order by cap / weight, source nulls last rows unbounded preceding) - cap as cap_before,
           sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as weight_from
    from weighted
), capped as (
    select *, (budget - cap_before) * weight > cap * weight_from as full_up from room
), goals as (
    select source, source_size, case when full_up then cap else
           weight * ((budget - sum(case when full_up then cap else 0 end) over ()) / sum(case when full_up then 0 else weight end) over ()) end as target
    from capped
), rests as (
    select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from goals
), keyed as (
    select s.*, source_size, target, epochs, target - epochs * source_size as rest,
           md5(coalesce(cast(doc_id as varchar), '') || ':' || cast(epochs as varchar)) as key
    from sizes s join rests g on s.source is not distinct from g.source
), summed as (
    select *, coalesce(sum(size) over (partition by source order by key rows between unbounded preceding and 1 preceding), 0) as before from keyed
), cuts as (
    select source, max(key) as last_key from summed where rest > 0 and rest - before >= size / 2 group by source
)
select doc_id, size, source_size, target, cast(size * (epochs + coalesce(key <= last_key, false)::int) as bigint) as taken
from keyed k left join cuts c on k.source is not distinct from c.source
"""

_AUDIT_SQL = f"""
with measured as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, {_WORDS} as words from documents
), marks as (
    select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels where doc_id is not null group by doc_id
), judged as (
    select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, {{
        'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
        'C': 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(text),
        'D': length(translate(text, '#$%&*|', '')) < length(text),
        'E': coalesce(doc_id > min(doc_id) over (partition by text), false)}} as fails
    from measured left join marks using (doc_id)
), counted as (
    select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from judged group by part, fails
), letters as (
    select unnest(['A', 'B', 'C', 'D', 'E']) as x
), orders as (
    select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps as (
    select filter_order, cast(k as integer) as step, filter_order[k] as x, filter_order[:k - 1] as earlier from orders, (select unnest(range(1, 6)) as k)
), held as (
    select part, x, n, good, toxic, fails, case x when 'A' then fails['A'] when 'B' then fails['B'] when 'C' then fails['C'] when 'D' then fails['D'] else fails['E'] end as failing,
           concat(case when fails['A'] then 'A' else '' end, case when fails['B'] then 'B' else '' end, case when fails['C'] then 'C' else '' end,
                  case when fails['D'] then 'D' else '' end, case when fails['E'] then 'E' else '' end) as failed
    from counted, letters
), rows_ as (
    select part, filter_order, step, s.x,
           sum(case when translate(failed, earlier || s.x, '') = failed then n else 0 end) as kept,
           sum(case when failing and translate(failed, earlier, '') = failed then n else 0 end) as removed,
           sum(case when failing and translate(failed, earlier, '') <> failed then n else 0 end) as redundant,
           sum(case when failed = s.x then n else 0 end) as unique_fails,
           sum(case when failing and translate(failed, earlier, '') = failed then good else 0 end) as good_lost,
           sum(case when failing and translate(failed, earlier, '') = failed then toxic else 0 end) as toxic_lost
    from steps s join held h on h.x = s.x group by part, filter_order, step, s.x
)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, x) as bigint) as shapley
from rows_
"""

_DIVERGENCE_SQL = r"""
with docs as (
    select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents
), said as (
    select r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from docs
), kept as (
    select lang, term, count(*) as n from said group by lang, term having count(distinct r) >= 10
), counts as (
    select lang, source, term, count(*) as n from said semi join kept using (lang, term) group by lang, source, term
), langs as (
    select lang, count(*) as kinds, sum(n) as total from kept group by lang
), occurring as (
    select distinct lang, source from docs
), sizes as (
    select lang, source, coalesce(sum(n), 0) as total from occurring left join counts using (lang, source) group by lang, source
), every as (
    select o.lang, o.source, k.term, coalesce(c.n, 0) as n,
           1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (s.total + 2 * l.kinds)::hugeint as p, 1 + (1000000000::hugeint * (k.n + 2)) // (l.total + 2 * l.kinds)::hugeint as q
    from occurring o join kept k using (lang) join langs l using (lang) join sizes s on s.lang = o.lang and s.source = o.source
    left join counts c on c.lang = o.lang and c.source = o.source and c.term = k.term
), far as (
    select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
    from every a join every b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source
), pairs as (
    select a.lang, a.source, b.source as item, coalesce(value, 0) as value
    from occurring a join occurring b on a.lang = b.lang and a.source <> b.source left join far f on f.lang = a.lang and f.source = a.source and f.item = b.source
), found as (
    select lang, source, 'pair' as part, item, value from pairs
    union all select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from every where n > 0 and p > q
), ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from found
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": _CHAT_SQL,
    "op4_code_search": _CODES_SQL,
    "op7_quality_rules": _RULES_SQL,
    "op10_source_mixing": _MIX_SQL,
    "op12_filter_audit": _AUDIT_SQL,
    "op13_source_divergence": _DIVERGENCE_SQL,
}
