"""DuckDB SQL that the queries of this subpackage are compared with. It spells its patterns and rules itself."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op5_mixing"] = f"""
with d as (select doc_id, source, len({_WORDS})::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 12))::bigint >> 18 as h from documents),
  s as (select source, sum(size)::bigint as source_size from d group by 1),
  w as (select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w, 3 * source_size as cap from s),
  l as (select *, sum(source_size) over () - coalesce(sum(cap) over before, 0) as rest, sum(w) over () - coalesce(sum(w) over before, 0) as ws from w
    window before as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
  m as (select *, max(case when cap > rest / ws * w then rest / ws end) over () as level from l),
  t as (select source, source_size, least(cap::double, coalesce(level * w, cap::double))::double as target from m),
  k as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as times from t),
  b as (select *, target - times * source_size as budget from k),
  c as (select source, h, sum(size) as words, sum(sum(size)) over (partition by source order by h) as run from d group by 1, 2),
  e as (select c.source, c.h, case when run <= budget or (run - words <= budget and words < 2 * (budget - (run - words))) then 1 else 0 end as more
    from c join b on c.source is not distinct from b.source)
select d.doc_id, d.size, b.source_size, b.target, (d.size * (b.times + e.more))::bigint as taken
from d join b on d.source is not distinct from b.source join e on d.source is not distinct from e.source and d.h = e.h"""

ORACLES["op6_quality_rules"] = rf"""
with d as (select doc_id, row_number() over () as r, coalesce(text, '') as t, {_WORDS} as ws from documents),
  g as (select r, i, array_to_string(ws[i:i+4], ' ') as g from (select r, ws, unnest(range(1, len(ws) - 3)) as i from d where len(ws) >= 5)),
  p as (select r, i from (select r, i, count(*) over (partition by r, g) as n from g) where n > 1),
  c as (select r, count(distinct i + j) as n from p, range(0, 5) as x(j) group by 1),
  y as (select r, unnest(string_split(t, chr(10))) as y from d),
  n as (select r, count(*) as n_lines, count(*) - count(distinct y) as dup from y where regexp_matches(y, '[^\x20\x09-\x0D]') group by 1),
  m as (select d.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
      coalesce(n.dup, 0)::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(n.n_lines, 0) as n_lines,
      len(list_filter(ws, lambda w: regexp_matches(w, '^(?i:the|of|and|to|in|de|la|le|et|les|der|die|und|das|el|los|que|en|y)(?:[.,;:!?]|$)'))) as n_stop
    from d left join c on c.r = d.r left join n on n.r = d.r),
  v as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
      case when n_words > 0 then word_chars / n_words else 0e0 end as mean_word_chars, case when n_words > 0 then n_symbols / n_words else 0e0 end as symbol_ratio,
      case when n_lines > 0 then n_dup_lines / n_lines else 0e0 end as dup_line_ratio, case when n_words > 0 then (n_stop + 1) / n_words else 0e0 end as stop_word_ratio from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and mean_word_chars between 2 and 14 and symbol_ratio <= 0.3 and dup_line_ratio <= 0.5 and stop_word_ratio >= 0.005 as kept,
  mean_word_chars, symbol_ratio, dup_line_ratio, stop_word_ratio from v"""

ORACLES["op7_substring_dedup"] = rf"""
with d as (select doc_id, {_WORDS} as ws from documents),
  g as (select doc_id, i, array_to_string(ws[i:i+19], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from d where len(ws) >= 20)),
  l as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as n from g) where n > 1),
  c as (select distinct doc_id, i + j as i from l, range(0, 20) as x(j)),
  b as (select doc_id, list(i) as gone, count(*) as n, count(*) filter (before is null or before < i - 1) as n_spans
    from (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from c) group by 1),
  w as (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from d),
  k as (select w.doc_id, string_agg(w.w, ' ' order by w.i) as kept from w left join c on c.doc_id = w.doc_id and c.i = w.i where c.i is null group by 1)
select d.doc_id, len(ws)::bigint as n_words, coalesce(b.n, 0)::bigint as n_removed, coalesce(b.n_spans, 0)::bigint as n_spans, sha256(coalesce(k.kept, '')) as kept_sha256
from d left join b on b.doc_id = d.doc_id left join k on k.doc_id = d.doc_id"""

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = (
    ("assign", _ASSIGN, "len(regexp_extract(m, '" + _ASSIGN + "', 2)) >= 8"),
    ("access", "AKIA[A-Z0-9]+", "len(m) >= 16"),
    ("hex", "[0-9a-f]+", "len(m) >= 32"),
    ("weak_id", r"""(?i:user(?:name)?|login|client_?id|account_?id|key_?id)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@._-]{3,}""", "true"),
    ("weak_endpoint", r"""(?:https?|wss?|ftp|s3|amqps?|rediss?|jdbc:[a-z]+|mysql|postgres(?:ql)?|mongodb)://[^\x20\x09-\x0D"''<>]+""", "true"),
    ("weak_secret", r"[A-Za-z0-9+/_-]{20,}", "regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]')"),
)
_PLACES = " union all ".join(
    f"select r, {n} as k, '{name}' as kind, e - len(m) as s, e from (select r, m, sum(len(g) + len(m)) over (partition by r order by i) as e, i from "
    f"(select r, unnest(regexp_extract_all(t, '{p}')) as m, unnest(regexp_split_to_array(t, '{p}')[:len(regexp_extract_all(t, '{p}'))]) as g, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) as i from d)) where {ok}"
    for n, (name, p, ok) in enumerate(_KINDS))

ORACLES["op4_secret_scans"] = f"""
with d as (select doc_id, row_number() over () as r, coalesce(text, '') as t from documents),
  p as materialized ({_PLACES}),
  x as (select a.r, a.k, a.kind, a.s, a.e,
      coalesce(bool_or(b.k in (1, 3) and b.s - a.e <= 300 and a.s - b.e <= 300), false) as with_id, coalesce(bool_or(b.k in (0, 2, 5) and b.s - a.e <= 300 and a.s - b.e <= 300), false) as with_secret,
      coalesce(bool_or(b.s < a.e and a.s < b.e and b.k < greatest(3, a.k)), false) as hit
    from p a left join p b on a.r = b.r and (a.k, a.s) <> (b.k, b.s) group by 1, 2, 3, 4, 5),
  y as (select * from x where k < 3 or (not hit and case k when 3 then with_secret when 4 then with_id and with_secret else with_id end)),
  z as (select r, count(*) filter (k = 0) as a, count(*) filter (k = 1) as b, count(*) filter (k = 2) as c, count(*) filter (k > 2) as w,
      string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as spans, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (k < 3) as base from y group by 1)
select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(w, 0)::bigint as n_weak from d left join z on z.r = d.r"""


def _crc_table() -> list[int]:
    """The table of the reflected polynomial 0xEDB88320."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


ORACLES["op2_sharding"] = f"""
with d as (select doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::bigint as size, string_split(hex(encode(coalesce(text, ''))), '') as x from documents),
  b as (select doc_id, size, list_transform(range(0, size - 1), lambda i: (instr('0123456789ABCDEF', x[2*i+1]) - 1) * 16 + instr('0123456789ABCDEF', x[2*i+2]) - 1) as bs from d),
  c as (select doc_id, size, xor(list_reduce(list_prepend(4294967295::bigint, bs::bigint[]), lambda c, v: xor(c >> 8, ({_crc_table()}::bigint[])[(xor(c, v) & 255) + 1])), 4294967295::bigint) as text_crc32 from b),
  p as (select *, sum(size) over (order by doc_id) - size as before, sum(size) over () as total from c),
  s as (select *, least(15, (2 * before + size) * 16 // (2 * total))::int as shard from p)
select doc_id, size, text_crc32, 'bytes' as law, shard, (row_number() over (partition by shard order by doc_id) - 1)::bigint as slot, null::int as grown_shard from s"""

_TURN = "('<|' || coalesce({x}.role, 'unknown') || '|>' || chr(10))"
_BODY = "(coalesce({x}.text, '') || '<|end|>' || chr(10))"


def _rendered(turns: str) -> str:
    return f"coalesce(array_to_string(list_transform({turns}, lambda x: {_TURN.format(x='x')} || {_BODY.format(x='x')}), ''), '')"


def _mask(turns: str) -> str:
    size = f"length({_TURN.format(x='y')} || {_BODY.format(x='y')})"
    at = f"coalesce(list_sum(list_transform({turns}[:i-1], lambda y: {size})), 0)::bigint + length({_TURN.format(x='x')})"
    span = f"({at}) || ':' || ({at} + length({_BODY.format(x='x')}))"
    return f"coalesce(array_to_string(list_filter(list_transform({turns}, lambda x, i: case when x.role = 'assistant' then {span} end), lambda s: s is not null), ','), '')"


ORACLES["op9_chat_formatting"] = f"""
with t as (select conv_id // 2 as pair_id, conv_id % 2 = 1 as rejected, {{'role': role, 'text': text}} as said, turn as place from conversations where conv_id is not null),
  p as (select pair_id, coalesce(list(said order by place, said) filter (not rejected), list(said)[:0]) as a, coalesce(list(said order by place, said) filter (rejected), list(said)[:0]) as b from t group by 1),
  l as (select *, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false) - 1, least(len(a), len(b)))::bigint as n from p),
  r as (select pair_id, n, a[:n] as common, a[n+1:] as kept, b[n+1:] as lost, a = b as identical from l)
select pair_id, n as n_prompt_turns, {_rendered('common')} as prompt, {_rendered('kept')} as chosen, {_mask('kept')} as chosen_mask, {_rendered('lost')} as rejected, {_mask('lost')} as rejected_mask, identical from r"""


def _urls_sql(depth: int = 4) -> str:
    """Rules and templates of op1, level by level."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rest = "substr(url, instr(url, '://') + 3)"
    ts = [f"t{d}" for d in range(1, depth + 1)]
    fits = lambda h: f"(host = '{h}' or ends_with(host, '.{h}'))"  # noqa: E731
    rules = (("example.org", "/en/1", "block"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("org", "/", "allow"))
    pick = lambda f: "case " + " ".join(f"when {fits(h)} and starts_with(path, '{p}') then '{f(h, p, v)}'" for h, p, v in rules) + " end"  # noqa: E731
    parts = [
        f"h as (select page_id, row_number() over () as r, case when instr(url, '://') > 0 then translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{upper}', '{upper.lower()}') else '' end as host, "
        f"case when instr(url, '://') > 0 then regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) else '' end as path from pages)",
        f"s as (select *, {pick(lambda h, p, v: h + p)} as rule, {pick(lambda h, p, v: v)} as fixed, string_split(regexp_replace(path, '^/', ''), '/') as raw from h)",
        f"g as (select *, list_transform(raw[:{depth}], lambda x: case when regexp_full_match(x, '[0-9a-fA-F-]{{16,}}') then '<hex>' else regexp_replace(x, '[0-9]+', '<num>', 'g') end) as general from s)",
        f"r0 as (select page_id, r, host, path, rule, fixed, case when len(raw) > {depth} then list_concat(general[:{depth - 1}], ['**']) else general end as segs, '' as p from g)",
    ]
    for d in range(1, depth + 1):
        parts += [
            f"c{d} as (select host, p, coalesce(segs[{d}], '') as seg, count(*) as n from r{d - 1} group by all)",
            f"l{d} as (select host, p, seg from (select *, sum(n) over (partition by host, p) as total from c{d}) where n >= 10 and n >= 0.01e0 * total)",
            f"x{d} as (select r{d - 1}.*, case when l{d}.seg is not null or coalesce(segs[{d}], '') = '' or regexp_full_match(segs[{d}], '<[a-z]+>(\\.[a-z]+)?') then coalesce(segs[{d}], '') else '*' end as t{d} "
            f"from r{d - 1} left join l{d} on l{d}.host = r{d - 1}.host and l{d}.p = r{d - 1}.p and l{d}.seg = coalesce(segs[{d}], ''))",
            f"r{d} as materialized (select * replace (p || '/' || t{d} as p) from x{d})",
        ]
    keys = ", ".join(ts)
    parts.append(f"m{depth} as (select host, {', '.join(f'{t} as o{t[1:]}' for t in ts)}, {keys}, count(*) as n, count(*) filter (fixed = 'allow') as good, count(*) filter (fixed = 'block') as bad from r{depth} group by host, {keys})")
    critical = lambda dof: f"(case when {dof} > 0 then {dof} * pow(1e0 - 2e0 / (9e0 * {dof}) + 2.326e0 * sqrt(2e0 / (9e0 * {dof})), 3) else 0e0 end)"  # noqa: E731
    term = lambda n, m: f"(case when {n} > 0 then {n} * ln({n} * (goods + bads)::double / ((good + bad) * {m})) else 0e0 end)"  # noqa: E731
    for d in range(depth, 0, -1):
        up = ", ".join(["host", *ts[: d - 1]])
        below = "concat_ws('/', '', " + ", ".join(ts[d:]) + ")" if ts[d:] else "''"
        g, gl = "(gg + own * ln(owns::double / own))", f"({term('good', 'goods')} + {term('bad', 'bads')})"
        parts += [
            f"k{d} as (select *, sum(n) over (partition by {up}, below) as m from (select {up}, t{d}, {below} as below, sum(n) as n, sum(good) as good, sum(bad) as bad from m{d} group by all))",
            f"b{d} as (select {up}, t{d}, sum(n) as own, sum(good) as good, sum(bad) as bad, sum(n * ln(n / m::double)) as gg from k{d} group by all)",
            f"f{d} as (select {up}, count(distinct below) - 1 as dof from k{d} group by all)",
            f"w{d} as (select b{d}.*, dof, sum(own) over q as owns, sum(good) over q as goods, sum(bad) over q as bads, count(*) over q as kids from b{d} join f{d} using ({up}) window q as (partition by {up}))",
            f"a{d} as (select {up}, t{d} from w{d} where kids > 1 and t{d} <> '' and (2 * {g} <= {critical('dof')} + 1e-9 or {g} <= 0.02e0 * own) "
            f"and (good + bad = 0 or 2 * {gl} <= {critical('1e0')} + 1e-9 or {gl} <= 0.02e0 * (good + bad)))",
            f"m{d - 1} as (select m{d}.* replace (case when a{d}.t{d} is not null then '*' else m{d}.t{d} end as t{d}) from m{d} left join a{d} using ({up}, t{d}))",
        ]
    join = ", ".join(["host", *ts])
    parts += [
        "al as (select coalesce(sum(bad)::double / nullif(sum(good) + sum(bad), 0), 0e0) as p from m0)",
        "ho as (select host, (sum(bad) + 5e0 * max(p)) / (sum(bad) + sum(good) + 5e0) as ph from m0, al group by 1)",
        f"te as (select {join}, round((sum(bad) + 5e0 * max(ph)) / (sum(bad) + sum(good) + 5e0), 9) as purity from m0 join ho using (host) group by all)",
        f"sc as (select m0.host, {', '.join(f'o{d}' for d in range(1, depth + 1))}, rtrim(concat_ws('/', '', {keys}), '/') as template, purity from m0 join te using ({join}))",
    ]
    on = " and ".join(f"sc.o{d} = r{depth}.t{d}" for d in range(1, depth + 1))
    return "with " + ",\n ".join(parts) + f"\nselect page_id, r{depth}.host, path, rule, coalesce(fixed, case when purity > 0.8e0 then 'block' else 'allow' end) as verdict, template, purity from r{depth} join sc on sc.host = r{depth}.host and {on}"


ORACLES["op1_url_filters"] = _urls_sql()


_INS = "case when {b} is not null then {{'c': {b}.c + 2, 'a': {b}.a || 'I', 'o': list_append({b}.o, '{r}:')}} end"
_DEL = "case when {b} is not null then {{'c': {b}.c + 3, 'a': {b}.a || 'D', 'o': {b}.o}} end"
_ROLE = "case when {b} is not null and r.fault < 2 then {{'c': {b}.c + 2 + r.fault, 'a': {b}.a || 'R', 'o': list_append({b}.o, '{r}:' || r.text)}} end"
_KEEP = "case when {b} is not null and r.fault < 2 and r.role[1] = '{i}' then {{'c': {b}.c + r.fault, 'a': {b}.a || 'K', 'o': list_append({b}.o, r.role || ':' || r.text)}} end"


def _to(state: int, sources: list[int], role: str) -> str:
    """The best way into a state by one turn: it is deleted there, kept or given a role."""
    ways = [_DEL.format(b=f"w.b{state}")] + [x.format(b=f"w.b{s}", r=role, i=role[0]) for s in sources for x in (_ROLE, _KEEP)]
    return f"list_min([{', '.join(ways)}])"


_INTO_2 = "list_min([b[3], " + ", ".join(_INS.format(b=f"b[{k}]", r="user") for k in (1, 2, 4)) + "])"

ORACLES["op11_conversation_repair"] = rf"""
with recursive k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
  f as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda x: ord(x)::bigint)),
    lambda c, v: xor(c >> 8, ({_crc_table()}::bigint[])[(xor(c, v) & 255) + 1])), 4294967295::bigint) % 20 as fate from k),
  d as (select conv_id, turn, case when fate = 4 then 'user' else role end as role,
    case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when fate = 3 then [1, 2] else [1] end) as twice from f where fate <> 0),
  i as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from d),
  p as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again from i),
  r as (select *, case when not regexp_matches(text, '[^ 	-]') then 3 when again then 2 when not regexp_matches(text, '[.!?][ 	-]*$') then 1 else 0 end as fault from p),
  s as (select *, role[1] || lead(role[1]) over (partition by conv_id order by i) as two from r),
  t as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 3) as blank, count(*) filter (fault = 2) as duplicate,
    count(*) filter (fault = 1) as truncated, count(*) filter (two not in ('su', 'ua', 'au')) as illegal, max(i) as n from s group by 1),
  v as (
    select conv_id, 0::bigint as i, [{{'c': 0::bigint, 'a': '', 'o': []::varchar[]}}, null, null, null] as b from t
    union all
    select w.conv_id, w.i + 1, [{_DEL.format(b="w.b0")}, list_min([{_DEL.format(b="w.b1")}, {_KEEP.format(b="w.b0", i="s")}]), {_to(2, [0, 1, 3], "user")}, {_to(3, [2], "assistant")}]
    from (select conv_id, i, b[1] as b0, b[2] as b1, {_INTO_2} as b2, list_min([b[4], {_INS.format(b=_INTO_2, r="assistant")}]) as b3 from v) w
    join r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1),
  e as (select v.conv_id, list_min([b[1], b[4], {_INS.format(b="b[3]", r="assistant")},
    case when b[2] is not null then {{'c': b[2].c + 4, 'a': b[2].a || 'II', 'o': list_concat(b[2].o, ['user:', 'assistant:'])}} end]) as e
    from v join t on t.conv_id is not distinct from v.conv_id and t.n = v.i)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(e.c, 0) as cost, coalesce(e.a, '') as audit, sha256(coalesce(array_to_string(e.o, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join t on t.conv_id is not distinct from o.conv_id left join e on e.conv_id is not distinct from o.conv_id"""
