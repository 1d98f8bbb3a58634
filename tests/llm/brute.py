"""Plain Python versions of what the operators compute."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(text or "")


def shingles(text, width):
    w = words(lower(text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(rows, width, percent=80):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def without_repeats(rows, width=13):
    """[(doc_id, n_words, n_removed, kept text)]"""
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[j : j + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - width + 1):
            if i is not None and first[tuple(w[j : j + width])] < i:
                gone |= set(range(j, j + width))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def kneser_ney(texts, order, discounts):
    """(probability of an n-gram tuple, raw counts of words)."""
    raw = Counter(w for t in texts for w in t)
    levels = {order: Counter()}
    for t in texts:
        z = ["<s>"] * (order - 1) + t
        for i in range(order - 1, len(z)):
            levels[order][tuple(z[i - order + 1 : i + 1])] += 1
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    cut, seen = {}, {}
    for n, grams in levels.items():
        cut[n] = [0, *discounts([sum(c == k for c in grams.values()) for k in (1, 2, 3, 4)])]
        seen[n] = defaultdict(lambda: [0, 0, 0, 0])
        for g, c in grams.items():
            seen[n][g[:-1]][0] += c
            seen[n][g[:-1]][min(c, 3)] += 1

    def p(g):
        n = len(g)
        if not n:
            return 1 / (len(raw) + 1)
        if g[:-1] not in seen[n]:
            return p(g[1:])
        total, *kinds = seen[n][g[:-1]]
        c = levels[n].get(g, 0)
        return (max(c - cut[n][min(c, 3)], 0) + sum(a * b for a, b in zip(cut[n][1:], kinds, strict=True)) * p(g[1:])) / total

    return p, raw
