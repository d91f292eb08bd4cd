"""SQL counterparts of the text expressions."""

from __future__ import annotations

from twinsieve.functions import vocab as v
from twinsieve.plans.fixture_sql import u32

SPACE = r"[\s\p{Z}]+"
PUNCT = r"[^\p{L}\p{N}_\s\p{Z}]"


def q(s: str) -> str:
    body = s.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\t", "\\t")
    return f"e'{body}'"


def words(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def choose(items, seed: int, *exprs: str) -> str:
    return f"({words(items)})[({u32(seed, *exprs)} % {len(items)})::int + 1]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def rstrip(x: str) -> str:
    return rf"regexp_replace({x}, '[\s\p{{Z}}]+$', '')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


def norm_exact(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '{SPACE}', ' ', 'g'), '{PUNCT}', '', 'g'))"


def norm_neardup(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower(replace({x}, chr(8203), '')), '{PUNCT}', ' ', 'g'), '{SPACE}', ' ', 'g'))")


def shingles(x: str, k: int = 5, short_text: bool = True) -> str:
    short = f"case when length({x})>0 then [{x}] else [] end" if short_text else "[]"
    return (f"case when length({x})<{k} then {short} else "
            f"list_distinct(list_transform(range(1, length({x})-{k - 2}), lambda i: substr({x}, i, {k}))) end")


# Spelled here, not taken from the vocabulary, so that the comparison would notice a wrong layout.
ESCAPE = r"e'\n\n]}]}\n\n'"


def planted_cte() -> str:
    """Documents that end in a link phrase and a goal, with white space behind every second one."""
    goal, link = choose(v.GOALS, 12, "doc_id"), choose(v.LINKS, 11, "doc_id")
    return f"""planted0 as (select doc_id, source, text as carrier, {goal} as goal, {link} as link, ({u32(13, 'doc_id')} % 4)::int as kind,
   {choose(v.COMPLETIONS, 14, 'doc_id')} as completion from documents),
 planted as (select doc_id, source, goal, link, kind, case when doc_id%2=0 then 'train' else 'eval' end as side,
  (case kind when 0 then carrier || ' ' || link || ' ' || goal when 1 then carrier || ' ' || {q(v.FIXED_PHRASE)} || ' ' || link || ' ' || goal
   when 2 then carrier || {ESCAPE} || link || ' ' || goal else carrier || ' ' || completion || ' ' || link || ' ' || goal end)
   || case when doc_id%2=0 then e' \\n' else '' end as text from planted0)"""
