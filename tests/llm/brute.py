"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def quality(text):
    ws = words(text)
    grams = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = len(ws)
    return {
        "n_words": n, "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": n < 10 or 100 * len(covered) > 20 * n,
    }


def shards(rows, n):
    """(doc_id, text) rows to {doc_id: (size, crc, shard, slot)}; ids are distinct."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    total, before, slots, out = sum(sizes), 0, Counter(), {}
    for (i, t), s in zip(rows, sizes):
        k = min(n - 1, (2 * before + s) * n // (2 * total))
        out[i] = (s, zlib.crc32((t or "").encode()), k, slots[k])
        slots[k] += 1
        before += s
    return out


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Words wanted per source by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(w[s] for s in free)
        share = {s: left * w[s] / total for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
            free.discard(s)
    return target


def repeats(rows, k, cut, join):
    """[(doc_id, symbols)] in order to [(n, removed, spans, kept)] by a set of all windows seen so far."""
    seen, out = set(), []
    for _, s in rows:
        gone = [False] * len(s)
        for i in range(len(s) - k + 1):
            g = cut(s[i:i + k])
            if g in seen:
                gone[i:i + k] = [True] * k
            seen.add(g)
        n_spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(s), sum(gone), n_spans, join([x for x, g in zip(s, gone) if not g])))
    return out


def simhash(text):
    import xxhash

    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i:i + 4]), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def smallest_reachable(ids, linked):
    """{id: smallest id of its component}; linked(i, j) says whether two are neighbours."""
    todo, out = set(ids), {}
    while todo:
        group, front = set(), {todo.pop()}
        while front:
            group |= front
            near = {j for j in todo if any(linked(i, j) for i in front)}
            todo -= near
            front = near
        known = [i for i in group if i is not None]
        out |= dict.fromkeys(group, min(known, default=None))
    return out


def url_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    cut = rest.find("/") if "/" in rest else len(rest)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]


def url_rule(host, path, rules):
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
    return (None, None) if best is None else (best[1] + best[2], "allow" if best[0] else "block")


def secrets(text):
    """Base spans and, by all pairs, the weak spans next to their complements."""
    t = text or ""
    val = r"[A-Za-z0-9+/_.=-]+"
    assign = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?(" + val + ")")
    spans = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    ids = re.compile(r"(?i:user(?:name)?|login|client_?id|account_?id|key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}")
    ends = re.compile(r"(?:https?|wss?|ftp|s3|amqps?|rediss?|jdbc:[a-z]+|mysql|postgres(?:ql)?|mongodb)://[^\x20\x09-\x0D\"'<>]+")
    weak = [("weak_id", m.start(), m.end()) for m in ids.finditer(t)] + [("weak_endpoint", m.start(), m.end()) for m in ends.finditer(t)]
    weak += [("weak_secret", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", t) if all(re.search(p, m[0]) for p in ("[0-9]", "[A-Z]", "[a-z]"))]
    roles = {"id": ("access", "weak_id"), "secret": ("assign", "hex", "weak_secret")}
    everything, order = spans + weak, ["assign", "access", "hex", "weak_id", "weak_endpoint", "weak_secret"]

    def near(s, role):
        return any(o is not s and o[0] in roles[role] and o[1] - s[2] <= 300 and s[1] - o[2] <= 300 for o in everything)

    def blocked(s):
        return any(o[1] < s[2] and s[1] < o[2] and order.index(o[0]) < max(3, order.index(s[0])) for o in everything if o is not s)

    needs = {"weak_id": ("secret",), "weak_endpoint": ("id", "secret"), "weak_secret": ("id",)}
    kept = [s for s in weak if all(near(s, r) for r in needs[s[0]]) and not blocked(s)]
    text_of = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(xs, key=lambda s: (s[1], order.index(s[0]))))
    return text_of(spans), text_of(spans + kept), Counter(s[0] for s in spans)
