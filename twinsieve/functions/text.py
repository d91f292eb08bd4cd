"""Text expressions. All but ``homoglyph`` are built-in column functions that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsieve.functions import vocab as v
from twinsieve.functions.hashing import U32

SPACE = r"[\s\p{Z}]+"
PUNCT = r"[^\p{L}\p{N}_\s\p{Z}]"
NO_WORD = r"[^a-z\p{L}\p{N}_]+"  # a run of what PUNCT or SPACE match
ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
TAIL_SPACE = r"[\s\p{Z}]+$"
ZERO_WIDTH = "​"


def strip(t: Column) -> Column:
    return F.regexp_replace(t, ENDS, "")


def norm_exact(t: Column) -> Column:
    """Lower-case, squeeze spaces, delete punctuation, trim. Double spaces may remain."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), SPACE, " "), PUNCT, ""))


def norm_neardup(t: Column) -> Column:
    """Drop zero-width spaces, lower-case, punctuation to spaces, squeeze, trim."""
    t = F.lower(F.replace(t, F.lit(ZERO_WIDTH), F.lit("")))
    return F.trim(F.regexp_replace(t, NO_WORD, " "))


def squeeze(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, SPACE, " "))


def norm_lines(t: Column) -> Column:
    """Squeeze inside each line and keep the line breaks."""
    return strip(F.array_join(F.transform(F.split(t, "\n"), squeeze), "\n"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it inside ``body``.

    A lambda of a higher-order function evaluates everything it mentions again for every element; a
    value bound this way is a lambda variable and is computed once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def grams(t: Column, k: int) -> Column:
    """All k-grams of a text that has at least k characters: one match at every code point looks k ahead."""
    return F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))


def shingle_set(norm: Column, k: int = 5, short_text: bool = True) -> Column:
    """Distinct k-grams. A shorter text is its own shingle, or gives none with ``short_text=False``."""
    none = F.array().cast("array<string>")
    short = F.when(F.lit(short_text) & (F.length(norm) > 0), F.array(norm)).otherwise(none)
    return F.when(F.length(norm) < k, short).otherwise(F.array_distinct(grams(norm, k)))


def tail_shingles(t: Column, tail: int = 80, k: int = 5) -> Column:
    """k-grams of the squeezed last characters; none if the tail is shorter than k."""
    return shingle_set(squeeze(F.right(t, F.lit(tail))), k, short_text=False)


def tokens(t: Column) -> Column:
    """Whitespace tokens; an empty array for blank text."""
    s = strip(t)
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, SPACE))


def token_budget(t: Column, limit: int) -> Column:
    """The text, or its first ``limit`` tokens joined by one space when there are more."""
    tok = tokens(t)
    return F.when(F.size(tok) > limit, F.array_join(F.slice(tok, 1, limit), " ")).otherwise(t)


def compose(instruction: Column, extra: Column) -> Column:
    """Instruction, or instruction and input separated by an empty line; either may be blank."""
    a, b = strip(F.coalesce(instruction, F.lit(""))), strip(F.coalesce(extra, F.lit("")))
    return F.concat_ws("\n\n", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def first_text(*cols: Column) -> Column:
    """First non-empty text of several columns."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def base64_text(t: Column) -> Column:
    """Standard base64 of the UTF-8 bytes on one line."""
    return F.regexp_replace(F.base64(F.encode(t, "UTF-8")), "[\r\n]", "")


def rot13(t: Column) -> Column:
    low = "abcdefghijklmnopqrstuvwxyz"
    src, dst = low + low.upper(), low[13:] + low[:13] + (low[13:] + low[:13]).upper()
    return F.translate(t, src, dst)


def text_seed(t: Column) -> Column:
    return F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long")


def homoglyph(t: Column, share: float = 0.3) -> Column:
    """Swap a share of look-alike letters, chosen by position and by the digest of the text.

    A built-in form looks at every character in an interpreted lambda; on Arrow batches a text is one array.
    """
    alike = np.zeros(128, np.uint32)
    for plain, other in zip(v.LATIN, v.CYRILLIC):
        alike[[ord(plain), ord(plain.upper())]] = ord(other)
    below = np.uint64(int(share * U32))

    def swapped(text: str | None, seed: float) -> str | None:
        if text is None:
            return None
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        at = np.flatnonzero((codes < 128) & (alike[np.minimum(codes, 127)] > 0))
        drawn = (np.uint64(seed) + at.astype(np.uint64) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)
        at = at[drawn < below]
        codes[at] = alike[codes[at]]
        return codes.tobytes().decode("utf-32-le", "surrogatepass")

    @F.pandas_udf("string")
    def run(texts: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([swapped(x, s) for x, s in zip(texts, seeds)], dtype=object)

    return run(t, text_seed(t))


def one_of(words: Sequence[str], index: Column) -> Column:
    """Pick from a small vocabulary by 0-based index."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index + F.lit(1)).cast("int"))


def render(
    kind: Column, carrier: Column, link: Column, payload: Column, completion: Column,
    phrase: str = v.FIXED_PHRASE, escape: str = v.ESCAPE,
) -> Column:
    """Four carrier/link/payload layouts: plain, fixed phrase, escape characters, made-up completion."""
    end = F.concat_ws(" ", link, payload)
    return (
        F.when(kind == 0, F.concat_ws(" ", carrier, end))
        .when(kind == 1, F.concat_ws(" ", carrier, F.lit(phrase), end))
        .when(kind == 2, F.concat(carrier, F.lit(escape), end))
        .otherwise(F.concat_ws(" ", carrier, completion, end))
    )


def plant(context: Column, payload: Column, position: Column) -> Column:
    """Insert the payload at the start, in the middle or at the end, set off by line breaks."""
    half = F.floor(F.length(context) / 2).cast("int")
    nl = F.lit("\n")
    return (
        F.when(position == "end", F.concat(context, nl, payload))
        .when(position == "start", F.concat(payload, nl, context))
        .otherwise(F.concat(F.substring(context, F.lit(1), half), nl, payload, nl,
                            F.substring(context, half + 1, F.length(context))))
    )


# How the input format writes its slots.
SLOT = r"\{([A-Za-z0-9_]*injection[A-Za-z0-9_]*)\}"
ANY_SLOT = r"\{([A-Za-z0-9_]+)\}"


def fill_tokens(t: Column, fillers: dict[str, str] | None = None) -> Column:
    """Replace every ``{token}`` by its filler, or by ``<token>`` when none is known."""
    fillers = v.FILLERS if fillers is None else fillers
    for key, value in fillers.items():
        t = F.regexp_replace(t, r"(?i)\{_*" + key + r"_*\}", value)
    angled = lambda acc, k: F.replace(acc, F.concat(F.lit("{"), k, F.lit("}")), F.concat(F.lit("<"), F.trim(F.lower(k), F.lit("_")), F.lit(">")))
    # the text is read for its tokens and rewritten, but made only once
    return let(t, lambda x: F.aggregate(F.array_distinct(F.regexp_extract_all(x, F.lit(ANY_SLOT), F.lit(1))), x, angled))


def fill_slots(carrier: Column, payload: Column) -> Column:
    """First injection slot takes the payload, other tokens their fillers; escapes are undone."""
    def filled(c: Column, slot: Column, at: Column) -> Column:
        head, tail = F.substring(c, F.lit(1), at - 1), F.substring(c, at + F.length(slot), F.length(c))
        return F.when(slot == "", c).otherwise(F.concat(head, payload, tail))

    out = let(carrier, lambda c: let(F.regexp_extract(c, SLOT, 0), lambda slot: filled(c, slot, F.instr(c, slot))))
    return strip(unescape(fill_tokens(out)))


def without_slots(t: Column) -> Column:
    """Braces and backslashes mapped away, as three replacements of whole texts; a translation looks at every character."""
    for old, new in ("{(", "})", "\\/"):
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def around_slot(carrier: Column) -> tuple[Column, Column]:
    """What stands before and after the first injection slot, other tokens filled and escapes undone; all before if there is none."""
    slot = F.regexp_extract(carrier, SLOT, 0)
    at = F.instr(carrier, slot)
    head = F.when(slot == "", carrier).otherwise(F.substring(carrier, F.lit(1), at - 1))
    tail = F.when(slot == "", "").otherwise(F.substring(carrier, at + F.length(slot), F.length(carrier)))
    return unescape(fill_tokens(head)), unescape(fill_tokens(tail))


def unescape(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))


def find_suffix(t: Column, phrases: Sequence[str]) -> Column:
    """Longest phrase the right-trimmed text ends with, else NULL."""
    longest_first = sorted(phrases, key=lambda p: (-len(p), p))
    return let(F.regexp_replace(t, TAIL_SPACE, ""), lambda body: F.coalesce(*[F.when(F.endswith(body, F.lit(p)), F.lit(p)) for p in longest_first]))


def swap_suffix(t: Column, old: Column, new: Column) -> Column:
    """Replace the trailing phrase and keep the white space behind it."""
    body = F.regexp_replace(t, TAIL_SPACE, "")
    kept = F.substring(body, F.lit(1), F.length(body) - F.length(old))
    return F.concat(kept, new, F.substring(t, F.length(body) + 1, F.length(t)))


def marker_of(t: Column, markers: Sequence[str] = tuple(v.MARKERS)) -> Column:
    """First listed marker the text holds."""
    out = F.when(F.contains(t, F.lit(markers[0])), F.lit(markers[0]))
    for mk in markers[1:]:
        out = out.when(F.contains(t, F.lit(mk)), F.lit(mk))
    return out.otherwise(F.lit("none/other"))


def carrier_of(t: Column, markers: Sequence[str] = tuple(v.MARKERS)) -> Column:
    """Text before the first listed marker that is not at the very start."""
    cases = [F.when(F.instr(t, F.lit(mk)) > 1, strip(F.substring(t, F.lit(1), F.instr(t, F.lit(mk)) - 1))) for mk in markers]
    return F.coalesce(*cases)


def payload_of(t: Column, links: Sequence[str] = tuple(v.LINKS)) -> Column:
    """Text behind the first link phrase, trimmed; NULL when there is none."""
    pattern = r"(?s)(?:" + "|".join(rf"\Q{x}\E" for x in links) + r")\s*(.+)$"
    got = strip(F.regexp_extract(t, pattern, 1))
    return F.nullif(got, F.lit(""))


def occurrences(t: Column, phrase: Column) -> Column:
    """Non-overlapping occurrences of a phrase."""
    return ((F.length(t) - F.length(F.replace(t, phrase, F.lit("")))) / F.length(phrase)).cast("long")


def prompt(template: Sequence[str], t: Column, system: str = v.SYSTEM_PROMPT) -> Column:
    """Serialised conversation up to the place where the label word is scored."""
    so, sc, uo, uc, ao, _ = template
    return F.concat(F.lit(so + system + sc + uo + "Text:\n"), t, F.lit("\n\nLabel:" + uc + ao))
