"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPLIT.findall(text) if text else []


def components(rows, num=80, den=100):
    """rows: (doc_id, text) -> list of (doc_id, n_shingles, component_id)."""
    sets = []
    for _, t in rows:
        w = words(t.translate(LOWER)) if t else []
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    where = defaultdict(list)
    for i, s in enumerate(sets):
        near = {j for x in s for j in where[x]}
        for j in near:
            if den * len(s & sets[j]) >= num * len(s | sets[j]):
                parent[find(i)] = find(j)
        for x in s:
            where[x].append(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            r = find(i)
            low[r] = min(low.get(r, d), d)
    return [(d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER)) if text else []


def contamination(rows, items, window=13):
    """-> list of (doc_id, n_words, n_hit, n_items, sha, contaminated)."""
    wins = defaultdict(set)
    for item, t in items:
        w = bench_words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[i:i + n])].update([] if item is None else [str(item)])
    sizes = {len(x) for x in wins}
    out = []
    for d, t in rows:
        w = bench_words(t)
        hit, ids = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[i:i + n]))) is not None:
                    ids |= found
                    hit.update(range(i, i + n))
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def without_windows(text, items, window=13):
    """The text without its hit runs of ``window`` words or more, by marking words."""
    wins = {tuple(w[i:i + window]) for _, t in items for w in [bench_words(t)] for i in range(len(w) - window + 1)}
    short = {tuple(w) for _, t in items if 0 < len(w := bench_words(t)) < window}
    spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    w, hit = bench_words(text), set()
    for n in {window, *map(len, short)}:
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in wins or tuple(w[i:i + n]) in short:
                hit.update(range(i, i + n))
    out, i, at = "", 0, 0
    while i < len(w):
        j = i
        while j < len(w) and j in hit:
            j += 1
        if j - i >= window:
            out += text[at:spans[i][0]]
            at = spans[j - 1][1]
        i = max(j, i + 1)
    return out + text[at:] if text else text


def quality_base(text):
    w = words(text)
    t = text or ""
    lines = [x for x in t.split("\n") if SPLIT.search(x)]
    wins = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    rep = {j for i in range(len(w) - 7) if wins[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep),
            len(w) < 20 or 100 * len(rep) > 30 * len(w))


def secrets_base(text):
    t = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(
        r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|"""
        r"""(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t)
             if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    found.sort()
    text = ",".join(f"{k}:{a}:{e}" for a, _, k, e in found)
    n = Counter(k for _, _, k, _ in found)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(text.encode()).hexdigest(), text


def crc(x):
    return zlib.crc32(str(x).encode())
