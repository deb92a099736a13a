"""SQL of the registered queries, for another engine to check them by."""

from __future__ import annotations

from oddsmith.functions import calls, replies, scores
from oddsmith.operators.resampling import DRAWS, thresholds
from oddsmith.operators import resolve
from oddsmith.operators.paths import MEASURES, MOVES
from oddsmith.sources.fixtures import ERRORS, LINES, MANIFESTS, OPENINGS, RECALLED, ROSTER, RUNS, SPORTS


def _hash(text: str, n: int = 8) -> str:
    return f"cast(('0x' || substr(md5({text}), 1, {n})) as ubigint)"


def _u(text: str) -> str:
    return f"({_hash(text)} / 4294967296.0::double)"


def _brier(p: str, y: str = "y") -> str:
    return f"({p} - {y}) * ({p} - {y})"


def _pick(x: str) -> str:
    return f"round(list_sort(list({x}))[1 + floor(count({x}) * {{}})::int], 6)"


def _ends(x: str) -> str:
    """low and high of a column of draws."""
    return f"{_pick(x).format('0.025::double')} as low, {_pick(x).format('0.975::double')} as high"


_ROSTER = ", ".join(f"('{m}', {a}::double, {b}::double, {str(w).lower()})" for m, a, b, w in ROSTER)
_RUNS = ", ".join(f"('{r}', '{s}', {v})" for r, s, v in RUNS)
_K = "o_orderkey::varchar"
_OF = "mode || '|' || model || '|' || row_id::varchar"
_HORIZON = " ".join(f"when horizon_days >= {low}{f' and horizon_days < {high}' if high else ''} then '{n}'" for n, low, high in scores.HORIZON_BANDS)
MOMENTS = f"""
with base as (
    select o_orderkey as row_id, o_custkey as event_id, case o_orderstatus when 'P' then 'A' when 'F' then 'B' else 'C' end as win, o_orderdate as forecast_ts,
           o_totalprice as depth_usd, [c_mktsegment, o_orderpriority] as tags, coalesce(c_mktsegment in {tuple(SPORTS)}, false) as sports,
           0.02::double + 0.96::double * {_u("'q|' || " + _K)} as q0, 0.01::double + 0.2::double * {_u("'w|' || " + _K)} as spread,
           {_u("'o|' || " + _K)} < 0.03 as one_sided, {_u("'x|' || " + _K)} as odd, {_u("'y|' || " + _K)} as uy, {_u("'l|' || " + _K)} < 0.1 as is_ladder,
           {_u("'d|' || " + _K)} < 0.03 as late_dateline, {_u("'r|' || " + _K)} < 0.02 as end_date_revised,
           case when {_u("'s|' || " + _K)} < 0.2 then 'calibration' else 'test' end as split, {_u("'n|' || " + _K)} < 0.4 as news_available,
           40.0::double * {_u("'h|' || " + _K)} as horizon_days, {_u("'e|' || " + _K)} >= 0.05 as fees_enabled, case when {_u("'z|' || " + _K)} < 0.5 then 1.0::double end as fee_exponent, {_u("'ip|' || " + _K)} < 0.04 as in_play,
           case when {_u("'ct|' || " + _K)} >= 0.1 then o_orderdate + to_seconds(floor(40.0::double * {_u("'h|' || " + _K)} * 86400)) end as closes_at
    from orders left join customer on o_custkey = c_custkey
), booked as (
    select *, case win when 'C' then 'kalshi' else 'polymarket' end as venue, case win when 'A' then round_even(q0, 2) else q0 end as price_yes, case when not one_sided then q0 end as mid_yes,
           greatest(0.0::double, q0 - spread / 2) as lo, least(1.0::double, q0 + spread / 2) as hi, case when uy < q0 then 1.0::double else 0.0::double end as y,
           case win when 'C' then 0.07::double else 0.05::double end as fee_rate from base
), quoted as (
    select *, case when odd < 0.02 then hi else lo end as bid, case when one_sided then null when odd < 0.02 then lo when odd < 0.03 then least(1.0::double, lo + 0.6::double) else hi end as ask,
           case win when 'A' then coalesce(mid_yes, price_yes) else price_yes end as q from booked
), moments as materialized (
    select *, coalesce(not one_sided and ask - bid <= 0.1::double + 1e-9::double, false) as live_book,
           case when one_sided or bid is null or ask is null then 'one_sided_book' when ask <= bid or ask - bid > 0.5 then 'degenerate_book' else 'ok' end as book,
           case {_HORIZON} end as horizon_band, q between 0.05 and 0.95 and not is_ladder and not late_dateline and not end_date_revised as "primary" from quoted
)"""
_BAND = "case " + " ".join(f"when q between {low} and {high} then '{n}'" for n, low, high in scores.PRICE_BANDS) + " end"
SCORED = MOMENTS + f""", attempts as (
    select m.*, model, case when {_u("'f|' || model || '|' || row_id::varchar")} >= 0.01 then least(0.99::double, greatest(0.01::double, a + b * q + 0.3::double * ({_u("model || '|' || row_id::varchar")} - 0.5))) end as p
    from moments m join (values {_ROSTER}) r(model, a, b, on_a) on on_a or win <> 'A' where "primary"
), forecasts as (select * from attempts where p is not null), scored as materialized (
    select *, p - y as error, {_brier('p')} as brier_model, {_brier('q')} as brier_market, {_brier('q')} - {_brier('p')} as brier_edge, {_BAND} as band,
           case when q = 0.5 or p = q then 'no lean' when (p > q) = (q > 0.5) then 'with' else 'against' end as direction, case when depth_usd > 0 then ln(depth_usd) end as log_depth
    from forecasts
)"""


def _traded(source: str, stake: float = 1.0) -> str:
    return f""", sided as (
    select *, case when book <> 'ok' then null when p > ask then 'Yes' when p < bid then 'No' end as side,
           case when book <> 'ok' then book when p > ask or p < bid then 'traded' else 'inside_spread' end as reason from {source}
), costed as (
    select *, case side when 'Yes' then ask when 'No' then 1 - bid end as cost, case when side is not null then (side = 'Yes') = (y = 1) end as won from sided
), feed as (
    select *, case when fees_enabled then coalesce(fee_rate * cost * (1 - cost), 0.0::double) else 0.0::double end as fee from costed
), sized as (select *, {stake}::double / nullif(cost + fee, 0) as shares from feed), traded as materialized (
    select *, case when won then shares else 0 end / nullif(shares * cost + case venue when 'kalshi' then ceil(round_even(shares * fee * 100, 9)) / 100.0 else shares * fee end, 0) - 1 as ret,
           case when won then 1.0::double else 0.0::double end / nullif(cost, 0) - 1 as ret_nofee from sized
)"""


_CUTS = """, ranked as (
    select view, depth_usd, row_number() over (partition by view order by depth_usd) as k, count(*) over (partition by view) as n from (
        select win as view, depth_usd from moments where "primary" union all select 'A_live', depth_usd from moments where "primary" and win = 'A' and live_book)
), cuts as (
    select view, i, depth_usd as cut from ranked, (select unnest([1, 2, 3, 4]) as i) where k = case when n * i // 5 = 0 then n else n * i // 5 end
)"""
_BUCKET = "1 + (select count(*) from cuts c where c.view = t.view and c.cut < t.depth_usd)::int as bucket"
_MEANS = "count(*) as n, round(avg(brier_model), 6) as brier_model, round(avg(brier_market), 6) as brier_market, round(avg(brier_edge), 6) as brier_edge"
_SUMMARY = """count(distinct event_id) as n_events, count(*) as n, count(*) filter (reason = 'traded') as n_traded, count(*) filter (reason = 'one_sided_book') as n_one_sided,
    count(*) filter (reason = 'degenerate_book') as n_degenerate, count(*) filter (reason = 'traded' and fee > 0) as n_fee_charged,
    round(avg(brier_model), 6) as brier_model, round(avg(brier_market), 6) as brier_market, round(avg(brier_edge), 6) as brier_edge, round(avg(p), 6) as mean_p, round(avg(q), 6) as mean_q,
    round(avg(ret) filter (reason = 'traded'), 6) as ret, round(avg(ret_nofee) filter (reason = 'traded'), 6) as ret_nofee, round(avg(fee) filter (reason = 'traded'), 6) as mean_fee,
    round(avg(won::int) filter (reason = 'traded'), 6) as win_rate"""
_BUCKETED = SCORED + _CUTS + f", bucketed as materialized (select *, {_BUCKET} from (select *, win as view from scored) t)"


def _weights(name: str, label: str) -> str:
    """A table of weights by cluster (``cl``, text) and draw."""
    block = f"md5('{label}|' || b::varchar || '|' || cl)"
    bits = f"cast(('0x' || substr({block}, 1 + 4 * i, 4)) as integer)"
    over = " + ".join(f"(bits >= {t})::int" for t in thresholds())
    return f""", {name} as materialized (
    select cl, (8 * b + i)::int as draw, {over} as w from (
        select cl, b, i, {bits} as bits from (select distinct event_id::varchar as cl from moments), (select unnest(range({-(-DRAWS // 8)})) as b), (select unnest(range(8)) as i)) where 8 * b + i < {DRAWS}
)"""


_SAID = f"""case when status = 'ok' then case when mode = 'memory_probe' and {_u("'mem|' || " + _OF)} < {RECALLED} then case when y = 1 then 0.97::double else 0.03::double end
           else least(0.99::double, greatest(0.01::double, a + b * q + 0.3::double * (noise - 0.5))) end end"""
_CALLS = MOMENTS + f""", each as (
    select m.*, model, a, b, mode, k from moments m join (values {_ROSTER}) r(model, a, b, on_a) on on_a or win <> 'A',
           (select unnest(['normal', 'memory_probe']) as mode), (select unnest([0, 1, 2]) as k)
), calls as (
    select *, case when late_dateline then 'excluded_by_benchmark_flag' when {_u("'f|' || model || '|' || row_id::varchar")} < 0.01 then 'failed' else 'ok' end as status,
           {[r for r, _, _ in RUNS]}[k + 1] as run_id, {_OF} || '|' || k::varchar as call_id, forecast_ts + to_seconds(floor(90.0::double * {_u("'t|' || k::varchar || '|' || " + _OF)})) as called_at,
           (k > 0 or {_u("'g|' || " + _OF)} >= 0.05)::int as final,
           case when mode = 'normal' and k = 0 then {_u("model || '|' || row_id::varchar")} else {_u("'p|' || k::varchar || '|' || " + _OF)} end as noise from each
    where (mode = 'normal' or (news_available and {_u("'pm|' || " + _OF)} < 0.8)) and (k = 0 or (k = 1 and {_u("'c|' || " + _OF)} < 0.2) or (k = 2 and {_u("'v|' || " + _OF)} < 0.1))
), latest as materialized (
    select c.*, started_at, {_SAID} as p
    from calls c join (values {_RUNS}) r(run_id, started_at, void) using (run_id) where final = 1 and void = 0
    qualify row_number() over (partition by model, mode, row_id order by called_at desc, started_at desc, call_id desc) = 1
), probes as (
    select *, 'memory_probe' as source from latest where mode = 'memory_probe' union all
    select *, 'normal_stand_in' from latest n where mode = 'normal' and not exists (select 1 from latest p where p.mode = 'memory_probe' and p.model = n.model and p.row_id = n.row_id)
)"""
_PLAIN_CALLS = _CALLS.split(", latest as")[0]

def _literal(value: str | int | None) -> str:
    return "null" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


_MANIFESTS = ", ".join(f"('{r}', {v}, '{t}', {x}, '{d}', {n})" for (r, _, v), (_, t, x, d, n) in zip(RUNS, MANIFESTS, strict=True))
_RECORDS = _PLAIN_CALLS + f""", records as materialized (
    select run_id, call_id, row_id, model, mode, win, called_at, status, final,
           {_SAID} as p,
           case when {_u("'at|' || call_id")} < 0.05 then 2 else 1 end as attempt, case when {_u("'tt|' || call_id")} < 0.1 then 2 else 1 end as transport_try,
           floor({_u("'ti|' || call_id")} * 1000)::bigint as tin, floor({_u("'to|' || call_id")} * 3000)::bigint as tout, floor({_u("'rt|' || call_id")} * 500)::bigint as reasoning,
           {_u("'fr|' || call_id")} < 0.04 as cut, {_u("'pw|' || call_id")} as pw, {_u("'pw|' || call_id")} <= 0.06 as warned, model = 'm3' and {_u("'pr|' || call_id")} < 0.01 as other_host,
           case when {_u("'sm|' || call_id")} >= 0.02 then model || case when {_u("'sm|' || call_id")} < 0.5 then '-a' else '-b' end end as served,
           case when status = 'failed' then floor({_u("'er|' || call_id")} * {len(ERRORS)})::int end as err, substr(model, 2)::int as num from calls
)"""
_FLAGGED = "abs(p - y) <= 0.1::double + 1e-9::double and abs(q - y) >= 0.3::double - 1e-9::double"
_ECE = """, vals as (
    select model, win, bucket, part, p, count(*) as n, sum(y) as sy from (
        select model, win, bucket, p, y, unnest(['all', case when sports then 'sports' else 'other' end]) as part from bucketed where split = 'calibration') group by all
), walked as (
    select *, sum(n) over w as upto, sum(n) over (partition by model, win, bucket, part) as whole, max(p) over (partition by model, win, bucket, part) as top from vals
    window w as (partition by model, win, bucket, part order by p)
), edged as (select *, min(case when upto >= round_even(whole / 3, 0) and p < top then p end) over (partition by model, win, bucket, part) as e1 from walked
), edged2 as (select *, min(case when upto >= round_even(whole * 2 / 3, 0) and p < top and p > e1 then p end) over (partition by model, win, bucket, part) as e2 from edged
), binned as (
    select model, win, bucket, part, 1 + coalesce((p > e1)::int, 0) + coalesce((p > e2)::int, 0) as bin, sum(n) as n, sum(p * n) as sp, sum(sy) as sy from edged2 group by all
), eces as (
    select model, win, bucket, part, sum(n)::bigint as n, sum(abs(sp - sy)) / sum(n) as ece, string_agg(n::bigint::varchar, '/' order by bin) as bins from binned group by all
), gate as materialized (
    select model, win, bucket, max(n) filter (part = 'all') as n, max(ece) filter (part = 'all') as e, max(bins) filter (part = 'all') as bins, max(ece) filter (part = 'sports') as s,
           max(ece) filter (part = 'other') as o, case when max(n) filter (part = 'all') < 30 then 'insufficient' when max(ece) filter (part = 'all') <= 0.1::double + 1e-9::double then 'pass' else 'fail' end as verdict
    from eces group by all
)"""
_LINE = "l_orderkey::varchar || '|' || l_partkey::varchar || '|' || l_suppkey::varchar || '|' || floor(l_extendedprice)::bigint::varchar"
_PATHS = f""", paths as (
    select l_orderkey as row_id, o_orderdate + to_seconds(floor({_u("'pt|' || " + _LINE)} * 864000) - 86400) as ts, 0.02::double + 0.96::double * {_u("'pp|' || " + _LINE)} as price,
           {{'a': l_partkey, 'b': l_suppkey, 'c': l_extendedprice}} as tie from lineitem join orders on l_orderkey = o_orderkey
), points as (
    select row_id, count(*) as n_points, count(*) filter (ts <= ends_at) as n_inside, arg_max(price, {{'ts': ts, 'tie': tie}}) filter (ts <= ends_at) as last_price
    from paths join (select *, least(forecast_ts + interval 72 hour, coalesce(closes_at, forecast_ts + interval 72 hour)) as ends_at from moments) using (row_id) where ts >= forecast_ts group by row_id
), disagreeing as (
    select *, (abs(last_price - p) <= abs(q - p) - 0.02::double)::int as toward_model, (abs(last_price - y) <= abs(q - y) - 0.02::double)::int as toward_outcome, ((p - q) * (y - q) > 0)::int as on_outcome_side,
           (abs(p - q) >= (abs(y - q) + 0.02::double) / 2)::int as halfway, ((p - q) * (y - q) > 0 and abs(p - q) >= (abs(y - q) + 0.02::double) / 2)::int as right_and_halfway,
           (last_price <= 0.01::double or last_price >= 1 - 0.01::double)::int as last_at_extreme, ((p - q) * (0.5 - q) > 0)::int as side_of_half,
           (last_price - q) * sign(p - q) as move_to_model, (last_price - q) * sign(y - q) as move_to_outcome, (last_price - q) * sign(0.5 - q) as move_to_half,
           coalesce(closes_at <= forecast_ts + interval 72 hour, false)::int as settled
    from scored join points using (row_id) where abs(p - q) >= 0.1::double and last_price is not null
)"""
_PAIRS = """, pairs as (
    select a.win, a.row_id, a.event_id, a.model as a, b.model as b, a.error as x, b.error as z, ((a.p >= 0.5) <> (a.y >= 0.5))::int::double as wx, ((b.p >= 0.5) <> (b.y >= 0.5))::int::double as wz,
           (a.q >= 0.5) = (a.y >= 0.5) as right_, a.brier_model as bx, b.brier_model as bz
    from scored a join scored b on a.row_id = b.row_id and a.model < b.model
)"""
_SLOPE = "(n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0)"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _chosen(label: str, values: list[str]) -> str:
    return f"[{', '.join(map(_text, values))}][1 + floor({_u(f"'{label}|' || model || '|' || row_id::varchar")} * {len(values)})::int]"


_REPLIES = SCORED + rf""", replied as (
    select *, case when {_u("'said|' || model || '|' || row_id::varchar")} >= 0.02 then {_chosen('words', OPENINGS)} ||
        replace(replace({_chosen('form', LINES)}, '{{n}}', '0.' || lpad(floor(p * 100)::int::varchar, 2, '0')), '{{c}}', floor(p * 100)::int::varchar) end as reply from scored
), parsed as (
    select *, case when regexp_matches(reply, {_text(rf"(?is)^.*{replies.STATED}(.?)")}) then regexp_extract_all(reply, {_text(rf"(?is)^.*{replies.STATED}(.?)")}, 1) || regexp_extract_all(reply, {_text(rf"(?is)^.*{replies.STATED}(.?)")}, 2)
           || regexp_extract_all(reply, {_text(rf"(?is)^.*{replies.STATED}(.?)")}, 3) end as stated,
           case when regexp_matches(reply, {_text(replies.BARE)}) then [regexp_extract(reply, {_text(replies.BARE)}, 1), regexp_extract(reply, {_text(replies.BARE)}, 2)] end as alone,
           case when regexp_matches(coalesce(reply, ''), {_text(rf"(?ism)\A(.*){replies.LAST_LINE}")}) then regexp_extract(reply, {_text(rf"(?ism)\A(.*){replies.LAST_LINE}")}, 1) else coalesce(reply, '') end as body from replied
), classed as materialized (
    select *, length(inner_) as body_chars, case when inner_ = '' then 0 else len(string_split_regex(inner_, '\s+')) end as body_words, (length(inner_) < {replies.SHORTEST_BODY})::int as bare,
           {', '.join(f"regexp_matches(body, {_text('(?i)' + x)})::int as {name}" for name, x in replies.CLASSES.items())}
    from (select *, regexp_replace(body, '^\s+|\s+$', '', 'g') as inner_ from parsed)
)"""

_PLAY = f""", play as (select *, {_BUCKET} from (select *, win as view from moments where not late_dateline) t)"""
#: Events one after another in each cell, as the rule is worded.
_GROUPED = (MOMENTS + _CUTS + _PLAY).replace("with base as (", "with recursive base as (", 1) + f""", counted as (
    select event_id, win, bucket, sports, count(*) as n from play group by all
), celled as (
    select event_id, arg_min((win, bucket, sports), (-n, win, bucket, sports)) as cell, sum(n)::bigint as size from counted group by event_id
), numbered as materialized (
    select event_id, cell, size, row_number() over (partition by cell order by {_hash("'grouped|' || event_id::varchar", 12)}, event_id) as i, greatest(1, round_even(sum(size) over (partition by cell) * 0.2::double, 0))::bigint as target from celled
), walked as (
    select distinct cell, 0::bigint as i, 0::bigint as got, null::bigint as event_id, false as drawn from numbered union all
    select n.cell, n.i, w.got + case when abs(w.got + n.size - n.target) < abs(w.got - n.target) then n.size else 0 end, n.event_id, abs(w.got + n.size - n.target) < abs(w.got - n.target)
    from walked w join numbered n on n.cell = w.cell and n.i = w.i + 1
), decided as materialized (
    select n.event_id, cell[1] as win, cell[2] as bucket, cell[3] as sports, size, target,
           w.drawn or (not bool_or(w.drawn) over (partition by n.cell) and row_number() over (partition by n.cell order by size, n.event_id) = 1) as drawn
    from numbered n join walked w using (cell, i)
)"""

_VIEWED = SCORED + _CUTS + _traded("scored") + f""", viewed as materialized (
    select *, {_BUCKET} from (select *, unnest(case when win = 'A' and live_book then ['A', 'A_live'] else [win] end) as view from traded where split = 'test') t
)"""


def _intervals(source: str, keys: str) -> str:
    """Summary by key with intervals of Brier edge and return."""
    return _weights("weights", "w") + f""", per as (
    select {keys}, event_id::varchar as cl, sum(brier_edge) as sb, count(brier_edge) as cb, coalesce(sum(ret) filter (reason = 'traded'), 0) as sr, count(ret) filter (reason = 'traded') as cr from {source} group by all
), drawn as (select {keys}, draw, sum(w * sb) / nullif(sum(w * cb), 0) as e, sum(w * sr) / nullif(sum(w * cr), 0) as r from per join weights using (cl) group by all
), edges as (select {keys}, {_pick('e').format('0.025::double')} as edge_low, {_pick('e').format('0.975::double')} as edge_high from drawn where e is not null group by all
), rets as (select {keys}, {_pick('r').format('0.025::double')} as ret_low, {_pick('r').format('0.975::double')} as ret_high from drawn where r is not null group by all
), paid as (select {keys}, count(*) filter (cr > 0) as k from per group by all
), summed as (select {keys}, {_SUMMARY}, count(distinct row_id) as n_markets, round(median(depth_usd), 6) as median_depth, round(median(horizon_days), 6) as median_horizon from {source} group by {keys})
select summed.*, case when n_events > 1 then edge_low end as edge_low, case when n_events > 1 then edge_high end as edge_high, case when k > 1 then ret_low end as ret_low, case when k > 1 then ret_high end as ret_high
from summed left join edges using ({keys}) left join rets using ({keys}) join paid using ({keys})"""


def _ols(c: str) -> str:
    n, sx, sy, sxx, sxy = (f"{c}{x}" for x in ("n", "sx", "sy", "sxx", "sxy"))
    return f"({n} * {sxy} - {sx} * {sy}) / nullif({n} * {sxx} - {sx} * {sx}, 0)"


def _fit_sums(w: str, join: str) -> str:
    """Five sums of returns and of edges on log depth."""
    out = []
    for c, y in (("r", "pay"), ("e", "brier_edge")):
        own = f"filter ({y} is not null and log_depth is not null)"
        out += [f"coalesce(sum({x}) {own}, 0)::double as {c}{n}" for n, x in (("n", "1"), ("sx", "log_depth"), ("sy", y), ("sxx", "log_depth * log_depth"), ("sxy", f"log_depth * {y}"))]
    return ", ".join(out)


_FITS = [f"{c}{x}" for c in "re" for x in ("n", "sx", "sy", "sxx", "sxy")]
_SIDES = ", ".join(f"coalesce(sum({v}) filter ({o} and {v} is not null), 0)::double as {k}_s, count({v}) filter ({o}) as {k}_c" for k, v, o in (("ret", "pay", "true"), ("calm", "pay", "not in_play"), ("edge", "brier_edge", "true")))
_GAPS = ", ".join(f"a.{k}_s / nullif(a.{k}_c, 0) - b.{k}_s / nullif(b.{k}_c, 0) as gap_{k}" for k in ("ret", "calm", "edge"))
_W_SIDES = ", ".join(f"sum(w * {k}_{x}) as {k}_{x}" for k in ("ret", "calm", "edge") for x in "sc")
_P_SIDES = ", ".join(f"sum({k}_{x}) as {k}_{x}" for k in ("ret", "calm", "edge") for x in "sc")
_BAND_SUMS = ["s1", "c1", "s5", "c5", *_FITS]
_MEASURED = ["gap_ret", "gap_calm", "gap_edge", "slope_ret", "slope_edge", *[f"{b}_{m}" for b in ("price", "horizon") for m in ("gap_ret", "slope_ret", "slope_edge")]]


def _banded(tag: str, band: str) -> str:
    gap = "s1 / nullif(c1, 0) - s5 / nullif(c5, 0)"
    return f""", {tag}_per as (
    select view, model, {band} as band_, event_id::varchar as cl, {', '.join(f"coalesce(sum(pay) filter (bucket = {b}), 0)::double as s{b}, count(pay) filter (bucket = {b})::double as c{b}" for b in (1, 5))}, {_fit_sums('', '')}
    from stack where {band} is not null group by all
), {tag}_all as (select view, model, band_, -1 as draw, {', '.join(f'sum({c}) as {c}' for c in _BAND_SUMS)} from {tag}_per group by all having least(sum(c1), sum(c5)) >= 30
), {tag}_each as (
    select * from {tag}_all union all
    select view, model, band_, draw, {', '.join(f'sum(w * {c}) as {c}' for c in _BAND_SUMS)} from {tag}_per semi join {tag}_all using (view, model, band_) join weights using (cl) group by all
), {tag}_found as (
    select view, model, draw, avg({gap}) as {tag}_gap_ret, avg(case when rn >= 3 then {_ols('r')} end) as {tag}_slope_ret, avg(case when en >= 3 then {_ols('e')} end) as {tag}_slope_edge from {tag}_each group by all
), {tag}_votes as (select view, model, count(*) as {tag}_bands from {tag}_all group by all)"""


def _measured(source: str, names: list[str]) -> str:
    each = ", ".join(f"round(max({n}) filter (draw = -1), 6) as {n}, round(list_sort(list({n}) filter (draw >= 0 and {n} is not null))[1 + floor(count({n}) filter (draw >= 0) * 0.025::double)::int], 6) as {n}_low, round(list_sort(list({n}) filter (draw >= 0 and {n} is not null))[1 + floor(count({n}) filter (draw >= 0) * 0.975::double)::int], 6) as {n}_high" for n in names)
    return f"select view, model, {each} from {source} group by all"


_GAP_TREND = _VIEWED + _weights("weights", "w") + _weights("weights_a", "a") + _weights("weights_b", "b") + f""", stack as materialized (
    select *, case when reason = 'traded' then ret end as pay from (select * from viewed union all select * replace ('pooled' as model) from viewed)
), side_1 as (select view, model, event_id::varchar as cl, {_SIDES} from stack where bucket = 1 group by all
), side_5 as (select view, model, event_id::varchar as cl, {_SIDES} from stack where bucket = 5 group by all
), a_ as (select view, model, -1 as draw, {_P_SIDES} from side_1 group by all union all select view, model, draw, {_W_SIDES} from side_1 join weights_a using (cl) group by all
), b_ as (select view, model, -1 as draw, {_P_SIDES} from side_5 group by all union all select view, model, draw, {_W_SIDES} from side_5 join weights_b using (cl) group by all
), gaps as (select a.view, a.model, a.draw, {_GAPS} from a_ a join b_ b on a.view = b.view and a.model = b.model and a.draw = b.draw
), fit_per as (select view, model, event_id::varchar as cl, {_fit_sums('', '')} from stack group by all
), fits as (
    select view, model, -1 as draw, {', '.join(f'sum({c}) as {c}' for c in _FITS)} from fit_per group by all union all select view, model, draw, {', '.join(f'sum(w * {c}) as {c}' for c in _FITS)} from fit_per join weights using (cl) group by all
), slopes as (select view, model, draw, {_ols('r')} as slope_ret, {_ols('e')} as slope_edge from fits){_banded('price', 'band')}{_banded('horizon', 'horizon_band')}, counted as (
    select view, model, count(*) as n, count(distinct event_id) as n_events, count(*) filter (reason = 'traded' and bucket = 1) as traded_1, count(*) filter (reason = 'traded' and bucket = 5) as traded_5, count(*) filter (in_play) as n_in_play,
           count(*) filter (log_depth is null) as n_zero_depth from stack group by all
), joined as (
    select * exclude (price_bands, horizon_bands), coalesce(price_bands, 0) as price_bands, coalesce(horizon_bands, 0) as horizon_bands from counted left join ({_measured('gaps', _MEASURED[:3])}) using (view, model) left join ({_measured('slopes', _MEASURED[3:5])}) using (view, model)
    left join ({_measured('price_found', _MEASURED[5:8])}) using (view, model) left join ({_measured('horizon_found', _MEASURED[8:])}) using (view, model) left join price_votes using (view, model) left join horizon_votes using (view, model)
), tested as materialized (
    select *, gap_ret_low > 0 or gap_ret_high < 0 as gap_excludes_zero, gap_ret < 0 and gap_ret_high < 0 as bucket_1_lower, slope_ret > 0 and slope_ret_low > 0 as trend,
           coalesce(case when (gap_ret < 0) = (price_gap_ret < 0) then 'yes' when (gap_ret < 0) <> (price_gap_ret < 0) then 'no' end, 'no bands') as price_agrees,
           coalesce(case when (gap_ret < 0) = (horizon_gap_ret < 0) then 'yes' when (gap_ret < 0) <> (horizon_gap_ret < 0) then 'no' end, 'no bands') as horizon_agrees from joined
)"""

_SECONDARY = SCORED.replace("on on_a or win <> 'A' where \"primary\"", "on on_a or win <> 'A' where split = 'test' and not late_dateline") + _traded("scored") + ", sets as materialized (select *, case when is_ladder then 'ladders' else 'full_set' end as kind from traded)" + _intervals("sets", "win, kind, model")

def _mean_ends(source: str, keys: str, values: list[str], tag: str = "") -> str:
    """Tables ``point`` and ``bounds``: means of values by key, and their intervals."""
    at = lambda v, share: f"round(list_sort(list({v}) filter ({v} is not null))[1 + floor(count({v}) * {share}::double)::int], 6)"
    return f""", per{tag} as (select {keys}, event_id::varchar as cl, count(*) as k, {', '.join(f'sum({v}) as s_{v}, count({v}) as c_{v}' for v in values)} from {source} group by all
), point{tag} as (select {keys}, sum(k)::bigint as n, count(*) as n_events, {', '.join(f'round(sum(s_{v}) / nullif(sum(c_{v}), 0), 6) as {v}, count(*) filter (c_{v} > 0) as k_{v}' for v in values)} from per{tag} group by all
), drawn{tag} as (select {keys}, draw, {', '.join(f'sum(w * s_{v}) / nullif(sum(w * c_{v}), 0) as {v}' for v in values)} from per{tag} join weights using (cl) group by all
), bounds{tag} as (select {keys}, {', '.join(f"{at(v, '0.025')} as {v}_low, {at(v, '0.975')} as {v}_high" for v in values)} from drawn{tag} group by all)"""


def _told(values: list[str]) -> str:
    return "n, n_events, " + ", ".join(f"{v}, case when k_{v} > 1 then {v}_low end as {v}_low, case when k_{v} > 1 then {v}_high end as {v}_high" for v in values)


def _apart(source: str, keys: str, value: str, side: str) -> str:
    """A table ``apart``: mean where ``side`` holds less mean where not, the two resampled independently."""
    return _weights("weights_a", "a") + _weights("weights_b", "b") + f""", sided_ as (
    select {keys}, event_id::varchar as cl, ({side}) as side_, sum({value}) as s, count({value})::double as c from {source} group by all
), whole_ as (select {keys}, sum(c) filter (side_)::bigint as n_a, sum(c) filter (not side_)::bigint as n_b, round(sum(s) filter (side_) / sum(c) filter (side_) - sum(s) filter (not side_) / sum(c) filter (not side_), 6) as difference from sided_ group by all
), first_ as (select {keys}, draw, sum(w * s) / nullif(sum(w * c), 0) as m from sided_ join weights_a using (cl) where side_ group by all
), second_ as (select {keys}, draw, sum(w * s) / nullif(sum(w * c), 0) as o from sided_ join weights_b using (cl) where not side_ group by all
), apart as (select {keys}, {_ends('d')} from (select {keys}, m - o as d from first_ join second_ using ({keys}, draw)) where d is not null group by all)"""


def _news(keep: str) -> str:
    """A table ``duo`` of forecasts with and without news."""
    return _CALLS + f""", met as (
    select win, model, row_id, event_id, q, y, sports, split, max(p) filter (mode = 'normal') as p_with, max(p) filter (mode = 'memory_probe') as p_without from latest where {keep} and p is not null group by all
), duo as materialized (
    select *, p_with - p_without as move, abs(p_with - p_without) as abs_move, abs(p_without - q) - abs(p_with - q) as toward_market, (p_with - p_without) * (case when y = 1 then 1.0::double else -1.0::double end) as toward_outcome,
           {_brier('p_with')} as brier_with, {_brier('p_without')} as brier_without, {_brier('q')} as brier_market, {_brier('p_without')} - {_brier('p_with')} as d_brier, {_BAND} as band,
           ({_brier('p_without')} > {_brier('p_with')})::int::double as helped, ({_brier('p_without')} < {_brier('p_with')})::int::double as hurt,
           case when abs(p_with - p_without) < 0.02::double then 'no move' when abs(p_without - q) - abs(p_with - q) > 0 then 'toward' else 'away' end as kind
    from met where p_with is not null and p_without is not null
)"""


_DUO = _news('"primary" and news_available and not late_dateline')

_LATEST = ", latest as" + _CALLS.split(", latest as")[1]
_GATED = _BUCKETED + _ECE + _CALLS[len(MOMENTS):] + _PATHS + _traded("bucketed") + f""", gated as materialized (
    select *, not quarantined and verdict = 'pass' as admitted from (
        select t.*, last_price, coalesce(f.flagged, false) as quarantined, coalesce(g.verdict, 'missing') as verdict
        from (select * exclude (view), unnest(case when win = 'A' and live_book then ['A', 'A_live'] else [win] end) as view from traded where split = 'test') t
        left join (select model, row_id, {_FLAGGED} as flagged from probes where p is not null) f using (model, row_id) left join gate g using (model, win, bucket) left join points using (row_id))
)"""
_GATED_APART = "admitted and abs(p - q) >= 0.1::double"


ORACLE_SQL: dict[str, str] = {
    "bucket_scores": SCORED + _CUTS + _traded("scored") + f""", viewed as (
    select *, unnest(case when win = 'A' and live_book then ['A', 'A_live'] else [win] end) as view from traded
), armed as (select *, {_BUCKET}, unnest(case when news_available then ['all', 'news'] else ['all'] end) as arm from viewed t
) select view, arm, model, bucket, {_SUMMARY} from armed group by all""",
    "bucket_intervals": _VIEWED + _intervals("viewed", "view, model, bucket"),
    "secondary_sets": _SECONDARY,
    "gap_trend": _GAP_TREND + " select * from tested",
    "pooled_verdicts": _GAP_TREND + """, models as (select view, count(*) as n_models, count(*) filter (coalesce(bucket_1_lower, false)) as models_clear from tested where model <> 'pooled' group by view)
select view, n_models, n, n_events, models_clear, 2 * models_clear >= n_models as at_least_half, gap_ret, gap_ret_low, gap_ret_high, gap_excludes_zero, gap_ret_low <= 0 and gap_ret_high >= 0 and abs(gap_ret) < 0.05::double as effect_absent,
       trend, price_agrees, horizon_agrees, n_models >= case when view in ('A', 'A_live') then 4 else 8 end as roster_complete from tested join models using (view) where model = 'pooled'""",
    "error_correlation": _VIEWED + _weights("weights", "w") + f""", full_ as (select *, count(distinct model) over (partition by view) as k, count(distinct model) over (partition by view, row_id) as by_ from viewed
), shared as (select *, unnest(['all', bucket::varchar]) as part from full_ where k = by_), paired as (
    select a.view, a.part, a.model as ma, b.model as mb, a.event_id::varchar as cl, a.error as x, b.error as z, ((a.p >= 0.5) <> (a.y >= 0.5))::int as wx, ((b.p >= 0.5) <> (b.y >= 0.5))::int as wz
    from shared a join shared b on a.view = b.view and a.part = b.part and a.row_id = b.row_id and a.model < b.model
), per as (
    select view, part, ma, mb, cl, count(*)::double as n, sum(x) as sx, sum(z) as sz, sum(x * x) as sxx, sum(z * z) as szz, sum(x * z) as sxz from paired group by all
), drawn as (
    select view, part, ma, mb, -1 as draw, sum(n) as n, sum(sx) as sx, sum(sz) as sz, sum(sxx) as sxx, sum(szz) as szz, sum(sxz) as sxz from per group by all union all
    select view, part, ma, mb, draw, sum(w * n), sum(w * sx), sum(w * sz), sum(w * sxx), sum(w * szz), sum(w * sxz) from per join weights using (cl) group by all
), rs as (
    select view, part, draw, (n * sxz - sx * sz) / sqrt((n * sxx - sx * sx) * (n * szz - sz * sz)) as r from drawn where n >= 10 and n * sxx - sx * sx > 1e-12 and n * szz - sz * sz > 1e-12
), points as (select view, part, count(*) as n_pairs, round(avg(r), 6) as mean_r, round(min(r), 6) as min_r, round(max(r), 6) as max_r from rs where draw = -1 group by all
), means as (select view, part, draw, avg(r) as m from rs where draw >= 0 group by all), bounds as (select view, part, {_ends('m')} from means group by all
), wrong as (
    select view, part, round(avg(bw), 6) as both_wrong, round(avg(ex), 6) as both_wrong_expected from (select view, part, ma, mb, avg(wx * wz) as bw, avg(wx) * avg(wz) as ex from paired group by all having count(*) >= 10) group by all
), counted as (select view, part, count(distinct model) as n_models, count(distinct row_id) as n_rows, count(distinct event_id) as n_events from shared group by all)
select *, mean_r > 0.5 and low > 0.5 as confirmed from counted join points using (view, part) join bounds using (view, part) join wrong using (view, part)""",
    "error_sets": _VIEWED + f""", full_ as (select *, count(distinct model) over (partition by view) as k, count(distinct model) over (partition by view, row_id) as by_ from viewed
), shared as (select * from full_ where k = by_), paired as (
    select a.view, a.model as ma, b.model as mb, count(*) as n, covar_samp(a.error, b.error) / nullif(stddev_samp(a.error) * stddev_samp(b.error), 0) as r from shared a join shared b on a.view = b.view and a.row_id = b.row_id and a.model < b.model group by all having count(*) >= 10
), kinds as (select *, case when ma in ('m1', 'm2', 'm3', 'm4') then 'bridge' else 'late' end as ka, case when mb in ('m1', 'm2', 'm3', 'm4') then 'bridge' else 'late' end as kb from paired)
select view, least(ka, kb) || '-' || greatest(ka, kb) as pair_kind, count(*) as n_pairs, max(n) as n_rows, round(avg(r), 6) as mean_r from kinds group by all""",
    "direction_scores": SCORED + f" select win, model, direction, band, {_MEANS} from scored group by grouping sets ((win, model, direction), (win, model, direction, band))",
    "trade_returns": SCORED + _traded("scored") + """
select win, model, reason, side, count(*) as n, round(avg(cost), 6) as cost, round(avg(won::int), 6) as won, round(avg(fee), 6) as fee,
       round(avg(case when side is not null then ret end), 6) as ret, round(avg(case when side is not null then ret_nofee end), 6) as ret_nofee from traded group by all""",
    "stake_returns": SCORED + ", stakes as (" + " union all ".join(f"select * from (with x as (select 1){_traded('scored', s)} select {s} as stake, win, count(*) as n, round(avg(ret), 6) as ret from traded where side is not null group by win)" for s in (1, 10, 100, 1000)) + ") select * from stakes",
    "murphy_decomposition": SCORED + """, cells as (
    select win, model, least(floor(p * 10), 9) as cell, count(*) as n, sum(p) as sp, sum(y) as sy from scored group by all
), based as (select *, sum(sy) over (partition by win, model) / sum(n) over (partition by win, model) as base from cells)
select win, model, sum(n)::bigint as n, round(sum(n * (sp / n - sy / n) ** 2) / sum(n), 6) as rel, round(sum(n * (sy / n - base) ** 2) / sum(n), 6) as res,
       round(any_value(base) * (1 - any_value(base)), 6) as unc from based group by win, model""",
    "bin_table": SCORED + """, cells as (select win, model, least(floor(p * 10), 9)::int as cell, count(*) as n, sum(p) as sp, sum(y) as sy from scored group by all)
select win, model, cell, n, round(sp / n, 6) as mean_p, round(sy / n, 6) as rate, round(n * (sp / n - sy / n) ** 2 / sum(n) over (partition by win, model), 6) as contribution from cells""",
    "skill_scores": SCORED + """, each as (select win, model, count(*) as n, avg(y) as base, avg(brier_model) as m, avg(brier_market) as q from scored group by all)
select win, model, n, round(m, 6) as brier_model, round(q, 6) as brier_market, round(base * (1 - base), 6) as brier_base, 0.25::double as brier_half,
       round(1 - m / nullif(base * (1 - base), 0), 6) as skill, round(1 - q / nullif(base * (1 - base), 0), 6) as skill_market from each""",
    "pair_errors": SCORED + _PAIRS + """
select win, a, b, count(*) as n, round(covar_samp(x, z) / nullif(stddev_samp(x) * stddev_samp(z), 0), 6) as r, round(avg(wx * wz), 6) as both_wrong, round(avg(wx) * avg(wz), 6) as both_wrong_expected,
       round(avg(wx * wz) / nullif(avg(wx) * avg(wz), 0), 6) as ratio, round(avg(wx * wz) filter (right_), 6) as both_wrong_market_right from pairs group by all having count(*) >= 10""",
    "paired_models": SCORED + _PAIRS + """, against as (select win, case a when 'm1' then b else a end as model, case a when 'm1' then bz - bx else bx - bz end as d from pairs where a = 'm1' or b = 'm1')
select win, model, count(*) as n, round(avg(d), 6) as difference, round(avg((d < 0)::int), 6) as better from against group by all""",
    "common_rows": SCORED + """, per as (select win, row_id, count(*) as by_, avg(brier_model) as brier from scored group by all), roster as (select win, count(distinct model) as models from scored group by all)
select win, count(*) as n_rows, count(*) filter (by_ = models) as n_common, any_value(models) as n_models, round(avg(brier) filter (by_ = models), 6) as brier_common from per join roster using (win) group by all""",
    "shrinkage_fit": SCORED + """ select win, model, count(*) as n, round(regr_intercept(p, q), 6) as a, round(regr_slope(p, q), 6) as b,
    round(regr_intercept(p, q) / (1 - regr_slope(p, q)), 6) as fixed_point from scored group by all""",
    "ensemble_scores": SCORED + f""", each as (
    select win, row_id, any_value(y) as y, avg(p) as mean, median(p) as median, 1 / (1 + exp(-avg(ln(p / (1 - p))))) as odds from scored group by win, row_id
) select win, count(*) as n, {', '.join(f'round(avg({_brier(c)}), 6) as brier_{c}' for c in ('mean', 'median', 'odds'))} from each group by win""",
    "extremizing": SCORED + """, each as (
    select win, row_id, split, any_value(y) as y, avg(ln(p / (1 - p))) as o from (select * replace (least(greatest(p, 0.01::double), 0.99::double) as p) from scored) group by all
), tried as (
    select win, factor, avg((1 / (1 + exp(-o * factor / 100)) - y) ** 2) filter (split = 'calibration') as cal, avg((1 / (1 + exp(-o * factor / 100)) - y) ** 2) filter (split = 'test') as tst
    from each, (select unnest(range(50, 301, 5))::int as factor) group by all
), plain as (select win, tst as test_plain from tried where factor = 100)
select win, factor, round(cal, 6) as calibration, round(tst, 6) as test, round(test_plain, 6) as test_plain from tried join plain using (win)
qualify row_number() over (partition by win order by round(cal, 12), factor) = 1""",
    "no_skill_floors": MOMENTS + _CUTS + f""", guessed as (
    select *, unnest(list_concat([{{'s': 'always_yes', 'd': 0, 'p': 1.0::double}}, {{'s': 'always_no', 'd': 0, 'p': 0.0::double}},
        {{'s': 'cheaper_side', 'd': 0, 'p': case when ask is null or bid is null or ask <= 1 - bid then 1.0::double else 0.0::double end}},
        {{'s': 'market_favored', 'd': 0, 'p': case when q > 0.5 then 1.0::double when q < 0.5 then 0.0::double else 0.5::double end}}],
        list_transform(range(200), lambda k: {{'s': 'coin_flip', 'd': k::int, 'p': case when substr(md5('coin|' || (k // 32)::varchar || '|' || row_id::varchar), 1 + (k % 32)::int, 1) >= '8' then 1.0::double else 0.0::double end}}))) as g
    from (select *, {_BUCKET} from (select *, win as view from moments where "primary") t)
), played as (select * exclude (g), g.s as strategy, g.d as draw, g.p as p from guessed){_traded('played')}, means as (
    select win, bucket, strategy, draw, avg(ret) as m, count(*) as n from traded where reason = 'traded' group by all
) select win, bucket, strategy, sum(n)::bigint as n, round(avg(m), 6) as ret, round(min(m), 6) as least, round(max(m), 6) as greatest from means group by all""",
    "bootstrap_edge": SCORED + _weights("weights", "w") + f""", per as (
    select win, model, event_id, sum(brier_edge) as s, count(brier_edge) as c from scored group by all
), means as (select win, model, draw, sum(w * s) / nullif(sum(w * c), 0) as m from per join weights on cl = event_id::varchar group by all
), ends as (select win, model, {_ends('m')} from means group by all), points as (
    select win, model, sum(c)::bigint as n, count(*) as n_clusters, round(sum(s) / sum(c), 6) as mean from per group by all
) select p.*, case when n_clusters > 1 then low end as low, case when n_clusters > 1 then high end as high from points p join ends using (win, model)""",
    "bootstrap_news_difference": SCORED + _weights("wa", "a") + _weights("wb", "b") + f""", per as (
    select win, model, event_id::varchar as cl, news_available as side, sum(brier_edge) as s, count(*) as c from scored group by all
), a as (select win, model, draw, sum(w * s) / nullif(sum(w * c), 0) as m from per join wa using (cl) where side group by all
), b as (select win, model, draw, sum(w * s) / nullif(sum(w * c), 0) as m from per join wb using (cl) where not side group by all
), ends as (select win, model, {_ends('(a.m - b.m)')} from a join b using (win, model, draw) group by all), points as (
    select win, model, sum(c) filter (side)::bigint as n_a, sum(c) filter (not side)::bigint as n_b, round(sum(s) filter (side) / sum(c) filter (side) - sum(s) filter (not side) / sum(c) filter (not side), 6) as difference from per group by all
) select * from points join ends using (win, model)""",
    "bootstrap_depth_slope": SCORED + _weights("weights", "w") + f""", per as (
    select win, model, event_id::varchar as cl, count(*) as n, sum(log_depth) as sx, sum(brier_edge) as sy, sum(log_depth * log_depth) as sxx, sum(log_depth * brier_edge) as sxy from scored where log_depth is not null group by all
), drawn as (select win, model, draw, sum(w * n) as n, sum(w * sx) as sx, sum(w * sy) as sy, sum(w * sxx) as sxx, sum(w * sxy) as sxy from per join weights using (cl) group by all
), slopes as (select win, model, {_SLOPE} as v from drawn), ends as (select win, model, {_ends('v')} from slopes group by all
), whole as (select win, model, sum(n)::bigint as n, sum(sx) as sx, sum(sy) as sy, sum(sxx) as sxx, sum(sxy) as sxy from per group by all)
select win, model, n, round({_SLOPE}, 6) as slope, low, high from whole join ends using (win, model)""",
    "bootstrap_bands": _BUCKETED + _weights("weights", "w") + f""", per as (
    select win, model, band, event_id::varchar as cl, sum(brier_edge) filter (bucket = 1) as s1, count(*) filter (bucket = 1) as c1, sum(brier_edge) filter (bucket = 5) as s5, count(*) filter (bucket = 5) as c5
    from bucketed where bucket in (1, 5) and band is not null group by all
), totals as (select win, model, band, sum(s1) as s1, sum(c1) as c1, sum(s5) as s5, sum(c5) as c5 from per group by all having least(sum(c1), sum(c5)) >= 30
), drawn as (
    select win, model, band, draw, sum(w * s1) / nullif(sum(w * c1), 0) - sum(w * s5) / nullif(sum(w * c5), 0) as gap from per semi join totals using (win, model, band) join weights using (cl) group by all
), averaged as (select win, model, draw, avg(gap) as m from drawn group by all), ends as (select win, model, {_ends('m')} from averaged group by all
), points as (select win, model, count(*) as n_bands, round(avg(s1 / c1 - s5 / c5), 6) as difference from totals group by all)
select * from points join ends using (win, model)""",
    "bootstrap_pair_r": SCORED + _PAIRS + _weights("weights", "w") + f""", per as (
    select win, a, b, event_id::varchar as cl, count(*) as n, sum(x) as sx, sum(z) as sz, sum(x * x) as sxx, sum(z * z) as szz, sum(x * z) as sxz from pairs group by all
), whole as (select win, a, b, 0 as draw, sum(n) as n, sum(sx) as sx, sum(sz) as sz, sum(sxx) as sxx, sum(szz) as szz, sum(sxz) as sxz from per group by all
), drawn as (select win, a, b, draw, sum(w * n) as n, sum(w * sx) as sx, sum(w * sz) as sz, sum(w * sxx) as sxx, sum(w * szz) as szz, sum(w * sxz) as sxz from per join weights using (cl) group by all
), points as (
    select win, count(*) as n_pairs, round(avg(r), 6) as mean_r, round(min(r), 6) as min_r, round(max(r), 6) as max_r from (select win, (n * sxz - sx * sz) / sqrt((n * sxx - sx * sx) * (n * szz - sz * sz)) as r from whole
    where n >= 10 and n * sxx - sx * sx > 1e-12 and n * szz - sz * sz > 1e-12) group by all
), means as (
    select win, draw, avg((n * sxz - sx * sz) / sqrt((n * sxx - sx * sx) * (n * szz - sz * sz))) as m from drawn where n >= 10 and n * sxx - sx * sx > 1e-12 and n * szz - sz * sz > 1e-12 group by all
), ends as (select win, {_ends('m')} from means group by all) select * from points join ends using (win)""",
    "final_forecasts": _CALLS + " select win, model, mode, status, count(*) as n, round(avg(p), 6) as p from latest group by all",
    "record_resolution": _PLAIN_CALLS + f""", placed as (
    select *, {_u("'rk|' || call_id")} as u, case when {_u("'rw|' || call_id")} < 0.01 then 'A' else win end as said_win from calls where final = 1
), recs as (
    select run_id, mode, said_win, status, case when status = 'ok' then 1 end as p, case when u < 0.8 or (u >= 0.88 and u < 0.92) then 'k' || md5(row_id::varchar)[:12] when u >= 0.92 and u < 0.95 then 'gone' || row_id::varchar end as moment_key,
           case when u >= 0.88 and u < 0.92 then row_id + 1 when u >= 0.95 and u < 0.97 then -row_id when u >= 0.1 and u < 0.95 then row_id end as rid from placed
), keyed as (select *, 'k' || md5(row_id::varchar)[:12] as moment_key from moments), joined as (
    select r.*, coalesce(k.row_id, i.row_id) as found, coalesce(k.win, i.win) as m_win, coalesce(k.late_dateline, i.late_dateline) as late, coalesce(k.is_ladder, i.is_ladder) as ladder_, coalesce(k.news_available, i.news_available) as news
    from recs r left join keyed k on r.moment_key = k.moment_key left join moments i on r.moment_key is null and r.rid = i.row_id
), told as (
    select *, case when found is null then 'key_not_in_benchmark' when moment_key is not null and rid <> found then 'moment_key_mismatch' when status in {resolve.SKIPPED} then 'skipped' when said_win <> m_win then 'window_mismatch'
                   when p is null then 'failed_rows' when late then 'dateline_flagged' when not (news or mode = 'normal') then 'outside_arm' when ladder_ then 'ladder' else 'scored' end as reason from joined
) select run_id, mode, count(*) as final_records, count(*) filter (moment_key is null and rid is not null) as joined_by_row_id_only,
         {', '.join(f"count(*) filter (reason = '{c}') as {c}" for c in ('moment_key_mismatch', 'key_not_in_benchmark', 'skipped', 'window_mismatch', 'failed_rows', 'dateline_flagged', 'outside_arm', 'ladder', 'scored'))},
         round(count(*) filter (reason = 'failed_rows') / greatest(1, count(*) filter (reason in ('failed_rows', 'dateline_flagged', 'outside_arm', 'ladder', 'scored')))::double, 6) as failed_share from told group by all""",
    "probe_forecasts": _CALLS + " select win, model, source, count(*) as n, round(avg(p), 6) as p from probes group by all",
    "quarantine_flags": _CALLS + f""" select win, model, source, case when not abs(p - y) <= 0.1::double + 1e-9::double then 'not confidently right' when {_FLAGGED} then 'right where the market was not' else 'priced in' end as reason,
    count(*) as n, sum(({_FLAGGED})::int)::bigint as quarantined from probes where p is not null group by all""",
    "news_value": _CALLS + """, per as (
    select win, model, row_id, max((p - y) ** 2) filter (mode = 'memory_probe') as wo, max((p - y) ** 2) filter (mode = 'normal') as wi from latest where news_available and p is not null group by all
) select win, model, count(*) as n, round(avg(wo), 6) as brier_without, round(avg(wi), 6) as brier_with, round(avg(wo - wi), 6) as delta, round(avg((wi < wo)::int), 6) as helped, round(avg((wi > wo)::int), 6) as hurt
from per where wo is not null and wi is not null group by all""",
    "calibration_gate": _BUCKETED + _ECE + " select model, win, bucket, n, round(e, 6) as ece, bins, verdict, round(s, 6) as ece_sports, round(o, 6) as ece_other from gate",
    "gated_convergence": _BUCKETED + _ECE + _PATHS + """
select win, direction, count(*) as n_disagreements, count(*) filter (last_price is null) as n_dropped, count(*) filter (abs(last_price - p) <= abs(p - q) - 0.02) as n_drifted,
       round(count(*) filter (abs(last_price - p) <= abs(p - q) - 0.02)::double / nullif(count(last_price), 0), 6) as rate
from (select * from bucketed semi join (select * from gate where verdict = 'pass') using (model, win, bucket)) left join points using (row_id) where abs(p - q) >= 0.1 group by all""",
    "path_coverage": SCORED + _PATHS + """ select win, count(*) as n, count(*) filter (coalesce(n_points, 0) > 0) as n_any, count(*) filter (coalesce(n_inside, 0) > 0) as n_inside,
    count(*) filter (coalesce(n_inside, 0) = 0) as n_dropped, round(avg(coalesce(n_points, 0)), 6) as points from moments left join points using (row_id) where "primary" group by all""",
    "disagreement_moves": SCORED + _PATHS + f""" select win, model, settled, count(*) as n, count(distinct event_id) as n_events, {', '.join(f'round(avg({c}), 6) as {c}' for c in MOVES)} from disagreeing group by all""",
    "bootstrap_moves": SCORED + _PATHS + _weights("weights", "w") + f""", each as (
    select win, settled, event_id::varchar as cl, unnest([{', '.join(f"{{'measure': '{c}', 'v': {c}::double}}" for c in MEASURES)}], recursive := true) from disagreeing
), per as (select win, settled, measure, cl, sum(v) as s, count(*)::double as c from each group by all
), point as (select win, settled, measure, sum(c)::bigint as n, count(*) as n_clusters, round(sum(s) / sum(c), 6) as mean from per group by all
), drawn as (select win, settled, measure, draw, sum(w * s) / nullif(sum(w * c), 0) as v from per join weights using (cl) group by all
), bounds as (select win, settled, measure, {_ends('v')} from drawn where v is not null group by all)
select win, settled, measure, n, n_clusters, mean, case when n_clusters > 1 then low end as low, case when n_clusters > 1 then high end as high from point join bounds using (win, settled, measure)""",
    "window_inventory": MOMENTS + """, sizes as (select win, event_id, count(*) as n from moments group by all)
select win, count(*) as n, count(*) filter ("primary") as n_primary, count(*) filter (news_available) as n_news, count(*) filter (sports) as n_sports, count(*) filter (live_book) as n_live,
       count(*) filter (book = 'one_sided_book') as n_one_sided, count(*) filter (book = 'degenerate_book') as n_degenerate, (select count(*) from sizes s where s.win = m.win) as n_events,
       (select max(n) from sizes s where s.win = m.win) as largest_event from moments m group by all""",
    "stratified_split": MOMENTS + _CUTS + f""", celled as (select *, {_BUCKET} from (select *, win as view from moments where "primary") t
), placed as (
    select win, bucket, sports, row_number() over (partition by win, bucket, sports order by {_hash("'split|' || row_id::varchar", 12)}, row_id) <= greatest(1, round_even(count(*) over (partition by win, bucket, sports) * 0.2::double, 0)) as drawn from celled
) select win, bucket, sports, count(*) as n, count(*) filter (drawn) as n_drawn from placed group by all""",
    "event_grouped_split": _GROUPED + """ select win, bucket, sports, target, sum(size)::bigint as n, count(*) as n_events, coalesce(sum(size) filter (drawn), 0)::bigint as n_drawn, count(*) filter (drawn) as events_drawn from decided group by all""",
    "split_leakage": _GROUPED + """, both_kinds as (
    select win, event_id, 'rows' as kind, split = 'test' as test from play union all select p.win, p.event_id, 'events', not drawn from play p join decided using (event_id)
), per as (select kind, win, event_id, count(*) as n, count(*) filter (test) as t from both_kinds group by all)
select kind, win, sum(n)::bigint as n, count(*) as n_events, sum(t)::bigint as n_test, count(*) filter (t > 0) as test_events, count(*) filter (t > 0 and t < n) as straddling, coalesce(sum(t) filter (t > 0 and t < n), 0)::bigint as test_inside from per group by all""",
    "validation_sample": MOMENTS + _CUTS + _PLAY + f""", drawn as (select * from play order by {_hash("'sample|' || row_id::varchar", 12)}, row_id limit 500)
select win, bucket, sports, count(*) as n, min(row_id) as least, max(row_id) as greatest from drawn group by all""",
    "event_folds": MOMENTS + f""" select win, ({_hash("'fold|' || event_id::varchar")} % 5)::int as fold, count(*) as n, count(distinct event_id) as n_events from moments where "primary" group by all""",
    "price_strata": SCORED + """ select win, case when q < 1 / 3 then 'lo' when q < 2 / 3 then 'mid' else 'hi' end as price_class,
    case when horizon_days <= 1 then '<=1' when horizon_days <= 3 then '<=3' when horizon_days <= 7 then '<=7' when horizon_days <= 30 then '<=30' else '>30' end as horizon,
    case when abs(p - q) >= 0.5 then '0.5+' when abs(p - q) >= 0.4 then '.4' when abs(p - q) >= 0.3 then '.3' when abs(p - q) >= 0.2 then '.2' when abs(p - q) >= 0.1 then '.1' when abs(p - q) >= 0.05 then '.05' end as gap,
    count(*) as n, round(avg(brier_edge), 6) as brier_edge from scored group by all""",
    "loss_shares": SCORED + """, by_ as (select win, model, direction, count(*) as n, sum(least(brier_edge, 0)) as l, sum(brier_edge) as e from scored group by all)
select win, model, direction, n, round(l, 6) + 0.0::double as losses, round(e, 6) as net, round(l / sum(l) over (partition by win, model), 6) + 0.0::double as share from by_""",
    "imputed_scores": SCORED + """ select win, model, count(*) as n, count(*) filter (p is null) as n_failed, round(avg((p - y) ** 2), 6) as brier_dropped,
    round(avg((coalesce(p, 0.5) - y) ** 2), 6) as brier_half, round(avg(coalesce((p - y) ** 2, 1)), 6) as brier_worst from attempts group by all""",
    "conditional_failures": SCORED + """, f as (select win, row_id, model, (p is null)::int::double as f from attempts)
select a.win, a.model as a, b.model as b, count(*) as n, round(avg(b.f) filter (a.f = 1), 6) as given_failed, round(avg(b.f) filter (a.f = 0), 6) as given_ok
from f a join f b on a.row_id = b.row_id and a.model < b.model group by all""",
    "depth_rank_correlation": MOMENTS + """, r as (
    select win, rank() over (partition by win order by depth_usd) + (count(*) over (partition by win, depth_usd) - 1) / 2 as rx, rank() over (partition by win order by q) + (count(*) over (partition by win, q) - 1) / 2 as ry, depth_usd, q
    from moments where "primary"
) select win, count(*) as n, round(corr(depth_usd, q), 6) as pearson, round(corr(rx, ry), 6) as spearman from r group by all""",
    "within_event_slope": SCORED + """, d as (select win, model, p - avg(p) over w as dp, q - avg(q) over w as dq from scored window w as (partition by win, model, event_id))
select win, model, count(*) as n, round(sum(dp * dq) / nullif(sum(dq * dq), 0), 6) as slope from d group by all""",
    "tag_counts": MOMENTS + """, t as (select win, unnest(tags) as tag from moments) select * from (select win, lower(trim(tag)) as tag, count(*) as n from t where tag is not null group by all)
qualify row_number() over (partition by win order by n desc, tag) <= 5""",
    "rounded_concentration": SCORED + """, c as (select model, round_even(p, 2) as v, count(*) as n from scored group by all), k as (
    select *, row_number() over (partition by model order by n desc, v) as place from c
) select model, sum(n)::bigint as n, round(sum(n) filter (place <= 10) / sum(n), 6) as share, max(v) filter (place = 1) as commonest from k group by all""",
    "reply_forms": _REPLIES + """, readings as (
    select win, 'strict' as reading, stated[1] as num, stated[2] as pct, stated[3] as follow from parsed union all
    select win, 'lenient', coalesce(stated, alone)[1], coalesce(stated, alone)[2], coalesce(stated[3], '') from parsed
), valued as (
    select *, coalesce(pct, '') = '' and coalesce(regexp_matches(follow, '[,/eE0-9]'), false) and num is not null as spoiled, pct <> '' or num::double > 1 as hundred,
           case when pct <> '' or num::double > 1 then num::double / 100 else num::double end as v from readings
), judged as (
    select *, not spoiled and v between 0 and 1 as good, coalesce(not spoiled and v between 0 and 1 and coalesce(pct, '') = '' and num in ('0', '1'), false) as whole from valued
), said as (select *, case when good and (reading = 'lenient' or not whole) then v end as p from judged)
select win, reading, count(*) as n, count(p) as n_parsed, round(avg(p), 6) as p, count(*) filter (whole) as n_bare, count(*) filter (spoiled) as n_rejected_number_form, count(*) filter (hundred and not spoiled) as n_percent_form,
       count(*) filter (whole and reading = 'lenient') as n_bare_integer, count(*) filter (p < 0.01::double or p > 0.99::double) as n_extreme from said group by all""",
    "reply_classes": _REPLIES + f""" select win, news_available, count(*) as n, {', '.join(f'sum({c})::bigint as {c}' for c in (*replies.CLASSES, 'bare'))},
    round(avg(body_chars), 6) as body_chars, round(avg(body_words), 6) as body_words from classed group by all""",
    "reply_effects": _REPLIES + _weights("weights", "w") + """, sides as (
    select 'hedge' as class, win, model, event_id, brier_edge as v, hedge = 1 as side from classed where reply is not null union all
    select 'cites_news', win, model, event_id, brier_edge, cites_news = 1 from classed where reply is not null and news_available
), per as (
    select class, win, model, event_id::varchar as cl, coalesce(sum(v) filter (side), 0) as s1, count(*) filter (side) as c1, coalesce(sum(v) filter (not side), 0) as s0, count(*) filter (not side) as c0 from sides group by all
), point as (
    select class, win, sum(c1)::bigint as n_with, sum(c0)::bigint as n_without, count(*) filter (least(c1, c0) >= 30) as n_groups, round(avg(s1 / c1 - s0 / c0) filter (least(c1, c0) >= 30), 6) as difference
    from (select class, win, model, sum(s1) as s1, sum(c1) as c1, sum(s0) as s0, sum(c0) as c0 from per group by all) group by all
), drawn as (
    select class, win, draw, avg(s1 / c1 - s0 / c0) filter (least(c1, c0) >= 30) as gap from (
        select class, win, model, draw, sum(w * s1) as s1, sum(w * c1) as c1, sum(w * s0) as s0, sum(w * c0) as c0 from per join weights using (cl) group by all) group by all
), bounds as (select class, win, """ + _ends("gap") + """ from drawn where gap is not null group by all)
select class, win, n_with, n_without, n_groups, difference, low, high from point left join bounds using (class, win)""",
    "latest_records": "select user_id, event_type, event_id, ts, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
    "hourly_errors": "select date_trunc('hour', ts) as hour, count(*) filter (where event_type = 'error') as errors, count(*) filter (where event_type <> 'error') as successes from events group by all",
    "sliding_errors": "select event_id, ts, count(*) over (order by ts range between interval 3599999999 microseconds preceding and current row) as errors from events where event_type = 'error'",
    "saturation_states": """with hours as (
    select date_trunc('hour', ts) as hour, (count(*) filter (event_type = 'error') > count(*) filter (event_type = 'view'))::int as hot from events group by all
), every as (
    select g.hour, coalesce(h.hot, 0) as hot from (select unnest(generate_series(min(hour), max(hour), interval 1 hour)) as hour from hours) g left join hours h on g.hour = h.hour
), told as (select hour, case when count(*) over w < 3 then null when sum(hot) over w = 3 then 'saturated' when sum(hot) over w = 0 then 'clear' end as s from every window w as (order by hour rows 2 preceding)
), states as (select hour, coalesce(last_value(s ignore nulls) over (order by hour rows between unbounded preceding and current row), 'clear') as state from told)
select hour, state from states qualify state <> lag(state, 1, 'clear') over (order by hour)""",
    "rate_multipliers": """with h as (select 'host' || (user_id % 4)::varchar as host, count(*) over (partition by user_id % 4 order by ts range between interval 1800 second preceding and current row) as hits from events where event_type = 'error')
select host, case when hits > 20 then 4 when hits > 10 then 2 else 1 end as multiplier, count(*) as n, max(hits)::int as most from h group by all""",
    "resume_plan": _PLAIN_CALLS + """, ends_ as (
    select run_id, model, mode, row_id, arg_max(status, (called_at, call_id)) filter (final = 1) as status from calls group by all
) select run_id, model, count(*) as n, count(*) filter (status is null or status = 'failed') as n_left, count(*) filter (status = 'failed') as n_failed from ends_ group by all""",
    "merged_pauses": """with p as (select user_id, epoch_us(ts) as a, epoch_us(ts) + floor(coalesce(value, 0) / 60.0::double * 3600000000)::bigint as b from events where event_type = 'error'
), m as (select *, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) as u from p
), g as (select *, sum((u is null or a > u)::int) over (partition by user_id order by a, b rows unbounded preceding) as island from m
), i as (select user_id, island, max(b) - min(a) as len from g group by all)
select user_id, count(*) as n_pauses, floor(sum(len) / 1000000)::bigint as seconds from i group by all""",
    "run_summary": _RECORDS + """, per as (
    select run_id, model, mode, row_id, arg_max(status, (called_at, call_id)) filter (final = 1) as last, arg_max(p, (called_at, call_id)) filter (final = 1) as p, arg_max(cut, (called_at, call_id)) filter (final = 1) as last_cut,
           arg_max(warned, (called_at, call_id)) filter (final = 1) as last_warned, bool_or(cut) as any_cut, count(*) filter (status <> 'excluded_by_benchmark_flag') as calls,
           count(*) filter (status <> 'excluded_by_benchmark_flag' and transport_try > 1) as retries, count(*) filter (status <> 'excluded_by_benchmark_flag' and transport_try = 1 and attempt = 2) as strict,
           sum(tin) as tin, sum(tout) as tout, sum(reasoning) as reasoning, sum((tin * (num * 1.0::double) + tout * (num * 4.0::double)) / 1e6) as cost, bool_or(other_host) as other, bool_and(other_host) as only_other from records group by all
) select run_id, model, mode, count(last) as rows_done, count(*) filter (last = 'ok') as rows_ok, count(*) filter (last = 'failed') as rows_failed, count(*) filter (last = 'excluded_by_benchmark_flag') as rows_skipped,
         count(*) filter (last <> 'excluded_by_benchmark_flag' and last_cut) as final_cut, count(*) filter (any_cut) as any_cut, count(*) filter (last_warned) as rows_with_warning,
         sum(calls)::bigint as model_calls, sum(retries)::bigint as retries, sum(strict)::bigint as strict, sum(tin)::bigint as input_tokens, sum(tout)::bigint as output_tokens, sum(reasoning)::bigint as reasoning_tokens,
         round(sum(cost), 6) as cost_usd, not bool_or(other) or bool_and(only_other) as host_pin_ok, round(avg(p), 6) as p_mean, round(min(p), 6) as p_min, round(max(p), 6) as p_max,
         round(count(*) filter (last = 'failed') / greatest(1, count(*) filter (last <> 'excluded_by_benchmark_flag'))::double, 6) as failed_share from per group by all""",
    "call_errors": _RECORDS + f""", told(err, error_type, status_, message) as (values {', '.join(f"({i}, {_literal(t)}, {_literal(c)}, {_literal(m)})" for i, (t, c, m) in enumerate(ERRORS))})
select run_id, error_type, case when regexp_matches(message, '{calls.RATE_LIMITED}') then 'transient' when error_type in {tuple(calls.TRANSIENT_TYPES)} then 'transient' when error_type in {tuple(calls.PERMANENT_TYPES)} then 'permanent'
       when status_ in {tuple(calls.TRANSIENT_STATUS)} then 'transient' when status_ in {tuple(calls.PERMANENT_STATUS)} then 'permanent' when regexp_matches(message, '{calls.PERMANENT_WORDS}') then 'permanent' else 'transient' end as kind,
       regexp_matches(message, '{calls.OUTPUT_LIMIT}') as output_limit, not coalesce(status_ between 400 and 499, false) and regexp_matches(message, '{calls.CONNECTION}') as connection, count(*) as n
from records join told using (err) group by all""",
    "parse_warnings": _RECORDS + """select run_id, model, warning, count(*) as n from (
    select run_id, model, unnest([case when pw < 0.03::double then 'extreme' end, case when pw between 0.02::double and 0.06::double then 'percent_form' end]) as warning from records where final = 1) where warning is not null group by all""",
    "run_guard": _RECORDS + f""", manifests(run_id, void, template, temperature, db, done) as (values {_MANIFESTS}), fed as (select distinct model, mode, win, run_id, template, temperature, db from records join manifests using (run_id) where void = 0)
select model, mode, win, count(*) as n_runs, count(distinct template) > 1 as template_hash, count(distinct db) > 1 as db_sha256, count(distinct temperature) > 1 as settings from fed
group by model, mode, win having count(distinct template) > 1 or count(distinct db) > 1 or count(distinct temperature) > 1""",
    "run_recount": _RECORDS + f""", manifests(run_id, void, template, temperature, db, done) as (values {_MANIFESTS}), l as (select run_id, count(*) as n from (select distinct run_id, model, mode, row_id from records where final = 1) group by all)
select run_id, done::bigint as n_manifest, coalesce(n, 0) as n_log from manifests left join l using (run_id) where done <> coalesce(n, 0)""",
    "news_placebo": _CALLS + """, both_modes as (
    select win, model, row_id, max(p) filter (mode = 'memory_probe') as p0, max(p) filter (mode = 'normal') as p1, first(q) as q, first(y) as y from latest where news_available group by win, model, row_id
), moved as (select *, abs(p1 - p0) as d from both_modes where abs(p1 - p0) >= 0.02::double
), blocks as materialized (select *, b, md5('coin|' || b::varchar || '|' || model || '|' || row_id::varchar) as h from moved, (select unnest([0, 1]) as b)
), drawn as (
    select win, y, q, p0, draw, case when draw < 0 then p1 else least(1.0::double, greatest(0.0::double, p0 + case when (('0x' || substr(h, 1 + (draw % 128) // 4, 1))::int >> (3 - draw % 4)::int) & 1 = 1 then d else -d end)) end as p
    from blocks, (select unnest(range(-1, 200)) as draw) where greatest(draw, 0) // 128 = b
), diffs as (
    select win, draw, count(*) filter (t) as nt, count(*) filter (not t) as na, avg(gain) filter (t) - avg(gain) filter (not t) as diff from (
        select win, draw, abs(p - q) < abs(p0 - q) as t, (p0 - y) * (p0 - y) - (p - y) * (p - y) as gain from drawn) group by all
) select win, max(nt) filter (draw < 0) as n_toward, max(na) filter (draw < 0) as n_away, round(max(diff) filter (draw < 0), 6) as difference, round(avg(diff) filter (draw >= 0), 6) as placebo,
         round(list_sort(list(diff) filter (draw >= 0))[1 + floor(count(diff) filter (draw >= 0) * 0.025::double)::int], 6) as low,
         round(list_sort(list(diff) filter (draw >= 0))[1 + floor(count(diff) filter (draw >= 0) * 0.975::double)::int], 6) as high from diffs group by win""",
    "news_coin_flip": _DUO + _weights("weights", "w") + """, parted as materialized (
    select *, unnest(case when abs_move > 0.25::double then ['all', 'large'] when abs_move < 0.1::double then ['all', 'small'] else ['all'] end) as part from duo)""" + _mean_ends("parted", "win, part", ["d_brier"]) + f""", plain as (
    select win, part, count(distinct row_id) as n_markets, round(avg(helped), 6) as helped, round(avg(hurt), 6) as hurt, round(median(d_brier), 6) as median, round(avg(d_brier) filter (d_brier > 0), 6) as gain_when_helped,
           round(avg(d_brier) filter (d_brier < 0), 6) as loss_when_hurt, sum(d_brier) as total, count(*) as k from parted group by all
) select win, part, n_markets, helped, hurt, median, gain_when_helped, loss_when_hurt, round(k / (select w.k from plain w where w.win = plain.win and w.part = 'all')::double, 6) as share_of_rows,
         round(total / nullif((select w.total from plain w where w.win = plain.win and w.part = 'all'), 0), 6) as share_of_gain, {_told(['d_brier'])} from plain join point using (win, part) join bounds using (win, part)""",
    "news_by_band": _DUO + _weights("weights", "w") + _mean_ends("(select * from duo where band is not null)", "win, band", ["move", "toward_market", "toward_outcome", "d_brier"]) + f""", plain as (
    select win, band, count(distinct row_id) as n_markets, {', '.join(f'round(avg({c}), 6) as mean_{c}' for c in ('p_without', 'p_with', 'q', 'y', 'brier_without', 'brier_with', 'brier_market'))},
           round((avg(brier_without) - avg(brier_with)) / nullif(avg(brier_without) - avg(brier_market), 0), 6) as gap_closed from duo where band is not null group by win, band
) select plain.*, {_told(['move', 'toward_market', 'toward_outcome', 'd_brier'])} from plain join point using (win, band) join bounds using (win, band)""",
    "news_sports_moves": _DUO + _weights("weights", "w") + _mean_ends("duo", "win, sports", ["abs_move", "d_brier"]) + _apart("duo", "win", "abs_move", "not sports") + f"""
select win, sports, {_told(['abs_move', 'd_brier'])}, difference, low as difference_low, high as difference_high from point join bounds using (win, sports) left join whole_ using (win) left join apart using (win)""",
    "news_toward_market": _DUO + _weights("weights", "w") + """, parted as (select *, unnest(case when split = 'test' then [model, 'pooled', 'pooled, test'] else [model, 'pooled'] end) as part from duo)""" + _mean_ends("parted", "win, part, kind", ["d_brier", "helped"]) + f"""
select win, part, kind, {_told(['d_brier', 'helped'])} from point join bounds using (win, part, kind)""",
    "news_toward_difference": _DUO + ", moved as (select * replace (m as model) from (select *, unnest([model, 'pooled']) as m from duo where kind <> 'no move'))" + _apart("moved", "win, model", "d_brier", "kind = 'toward'") + """
select win, model, n_a, n_b, difference, low, high from whole_ join apart using (win, model)""",
    "news_tails": _news("not is_ladder and not late_dateline and not end_date_revised") + _weights("weights", "w") + """, parted as (
    select * replace (m as model), case when q < 0.05::double then 'low' when q > 0.95::double then 'high' else 'middle' end as tail from (select *, unnest([model, 'pooled']) as m from duo))""" + _mean_ends("parted", "win, tail, model", ["d_brier", "move", "p_with", "p_without"]) + f"""
select win, tail, model, {_told(['d_brier', 'move', 'p_with', 'p_without'])} from point join bounds using (win, tail, model)""",
    "gated_counts": _GATED + f""" select view, model, count(*) as n_test_rows, count(*) filter (quarantined) as n_quarantined, count(*) filter (not quarantined) as n_after_quarantine, count(*) filter (admitted) as n_admitted,
    count(*) filter (not quarantined and not admitted) as n_shut, count(*) filter ({_GATED_APART}) as n_disagreements, count(*) filter ({_GATED_APART} and direction = 'with') as n_with,
    count(*) filter ({_GATED_APART} and direction = 'against') as n_against, count(*) filter ({_GATED_APART} and last_price is null) as n_dropped, count(*) filter ({_GATED_APART} and last_price is not null) as n_rated,
    count(*) filter ({_GATED_APART} and abs(last_price - p) <= abs(q - p) - 0.02::double) as n_drifted,
    (select count(*) from gate g where g.verdict = 'pass' and g.model = gated.model and g.win = gated.win) as regions_pass, round(n_drifted::double / nullif(n_rated, 0), 6) as rate from gated group by view, win, model""",
    "gated_regions": _GATED + """, places as (select distinct view, win, model, unnest([1, 2, 3, 4, 5]) as bucket from gated
), filled as (select view, model, bucket, count(*) as n_rows, count(*) filter (admitted) as n_admitted from gated where not quarantined group by all)
select view, model, bucket, coalesce(verdict, 'missing') as verdict, n as gate_n, round(e, 6) as gate_ece, coalesce(n_rows, 0) as n_rows, coalesce(n_admitted, 0) as n_admitted, coalesce(n_rows, 0) - coalesce(n_admitted, 0) as n_shut
from places left join filled using (view, model, bucket) left join gate using (model, win, bucket)""",
    "gated_directions": _GATED + f", left_ as materialized (select * from gated where {_GATED_APART})" + _intervals("left_", "view, model, direction"),
    "reporting_line": _RECORDS + _LATEST + f""", kept as (
    select r.*, template from records r join (values {', '.join(f"('{r}', '{t}', {v})" for (r, _, v), (_, t, *_) in zip(RUNS, MANIFESTS, strict=True))}) m(run_id, template, void) using (run_id) where final = 1 and mode = 'normal' and void = 0
), ends_ as (select run_id, model, win, template, row_id, arg_max(status, (called_at, call_id)) as status, arg_max(p, (called_at, call_id)) as p from kept group by all
), rows_ as (
    select run_id, model, win, template, count(*) as rows_logged, count(*) filter (status = 'excluded_by_benchmark_flag') as rows_skipped, count(*) filter (status <> 'excluded_by_benchmark_flag') as rows_in_play,
           count(*) filter (status = 'failed') as rows_failed, count(*) filter (status = 'ok' and p is not null) as rows_scored from ends_ group by all
), thought as (select run_id, model, win, floor(median(reasoning))::bigint as thinking_median, count(*) as thinking_n from kept where status = 'ok' group by all
), served_ as (select run_id, model, win, served as served_model from (select run_id, model, win, served, count(*) as k from kept group by all) qualify row_number() over (partition by run_id, model, win order by k desc, served) = 1
), held as (select model, win, count(*) as k from probes where p is not null and {_FLAGGED} group by all)
select run_id, model, win, rows_logged, rows_skipped, rows_in_play, rows_failed, rows_scored, thinking_median, coalesce(thinking_n, 0) as thinking_n, served_model, coalesce(k, 0) as rows_quarantined, false as release_check_off,
       round(rows_failed / greatest(1, rows_in_play)::double, 6) as failed_share, rows_failed / greatest(1, rows_in_play)::double > 0.05 as incomplete, model || '@' || template as forecaster
from rows_ left join thought using (run_id, model, win) left join served_ using (run_id, model, win) left join held using (model, win)""",
}
