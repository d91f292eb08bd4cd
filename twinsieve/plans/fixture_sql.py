"""The derived frames of ``sources.tables`` once more, as SQL for the comparison engine."""

from __future__ import annotations

SCORED = """scored as (select event_id as row_id,
  case when event_type='error' then 1 else 0 end::bigint as label,
  case when event_type<>'error' then null when event_id%3=0 then 'document'
       when event_id%3=1 then 'tool' else 'direct' end as channel,
  concat('src', cast(user_id%5 as varchar)) as source,
  (3e0*((((event_id*7919)%10007)+0.5e0)/10008e0) + case when event_type='error' then 0 else 1 end)/4e0 as p1,
  (2e0*((((event_id*104729)%10007)+0.5e0)/10008e0) + case when event_type='error' then 0 else 1 end)/3e0 as p2,
  60 + (event_id*31)%2100 as n_tokens, value as ms,
  case when user_id%3=0 then 'cal' when user_id%3=1 then 'val' else 'eval' end as split
  from events)"""

CORPUS = """corpus as (select d.doc_id as row_id, d.text, l.toxic::bigint as label, d.lang, d.source
  from documents d join labels l on d.doc_id=l.doc_id)"""

_SLOT = "((event_id//6)%6)"
_MODEL = "((event_id//2)%3)"
_TARGET = f"(case {_SLOT} when 0 then 64 when 1 then 128 when 2 then 256 when 3 then 512 when 4 then 1024 else 2048 end)"

SAMPLES = f"""samples as (select case when event_id%2=0 then 'nf4' else 'bf16' end as regime,
  case when user_id%4=0 then 'extra' else 'base' end as session,
  case {_MODEL} when 0 then 'small-a' when 1 then 'small-b' else 'large' end as model,
  case when {_MODEL}=2 then 'stage2' else 'stage1' end as role,
  {_TARGET}::bigint as target_tokens,
  (case when {_TARGET}=64 and {_MODEL}=2 then 83 when {_TARGET}=64 then 86 else {_TARGET} end)::bigint as actual_tokens,
  20e0 + (case {_MODEL} when 0 then 0.25e0 when 1 then 0.5e0 else 2e0 end)*{_TARGET} + value/17e0 as ms,
  case when event_type='error' then 1 else 0 end::bigint as label,
  event_id as idx, user_id%64 as rep_group
  from events)"""


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def hashed(seed: int, *exprs: str) -> str:
    body = " || ':' || ".join(f"({e})::varchar" for e in exprs)
    return f"md5('{seed}:' || {body})"


def u32(seed: int, *exprs: str) -> str:
    return f"('0x' || substr({hashed(seed, *exprs)}, 1, 8))::bigint"


def fraction(seed: int, *exprs: str) -> str:
    return f"(({u32(seed, *exprs)} + 0.5e0) / 4294967296e0)"


def dr_ctes(src: str, label: str, score: str, t: str, key: str | None = None, tag: str = "d") -> str:
    """CTE ``{tag}_res``: threshold at a false-positive rate by the 'higher' quantile, strict flag rule."""
    k = key or "1"
    return f"""{tag}_b as (select {k} as k, {score} as s,
    row_number() over (partition by {k} order by {score}) rn, count(*) over (partition by {k}) nb
    from {src} where {label}=0 and {score} is not null),
  {tag}_t as (select k, max(s) as thr from {tag}_b where rn = ceil((nb-1)*(1e0-{t}))+1 group by k),
  {tag}_res as (select {k} as k, max({tag}_t.thr) as threshold,
    sum(case when {label}=1 and {score}>{tag}_t.thr then 1 else 0 end)*1e0/nullif(sum({label}),0) as dr,
    sum(case when {label}=0 and {score}>{tag}_t.thr then 1 else 0 end)*1e0/nullif(sum(1-{label}),0) as achieved_fpr,
    sum(1-{label})::bigint as n_benign, sum({label})::bigint as n_injection
    from {src} left join {tag}_t on {tag}_t.k = {k} where {score} is not null group by 1)"""


def auroc_sql(src: str, label: str, score: str, key: str | None = None, tag: str = "a") -> str:
    """CTE ``{tag}_res(k, auroc)`` with average ranks."""
    k = key or "1"
    return f"""{tag}_r as (select {k} as k, {label} as y,
    rank() over (partition by {k} order by {score}) + (count(*) over (partition by {k}, {score}) - 1)/2e0 as rk
    from {src} where {score} is not null),
  {tag}_res as (select k, (sum(case when y=1 then rk else 0 end) - sum(y)*(sum(y)+1e0)/2e0)
    /nullif(sum(y)*1e0*sum(1-y),0) as auroc from {tag}_r group by k)"""
