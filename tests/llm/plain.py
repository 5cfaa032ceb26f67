"""Brute-force versions, in plain Python over collected rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern):  # noqa: ANN001, ANN201
    return re.findall(pattern, (text or "").translate(LOW))


def alnum(text):  # noqa: ANN001, ANN201
    return words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spaced(text):  # noqa: ANN001, ANN201
    return words(text, r"[^\x20\x09-\x0D]+")


def contamination(docs, items, width=10):  # noqa: ANN001, ANN201
    """{row number: (words, hit words, items)}"""
    windows = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].update(() if i is None else (str(i),))
    sizes = {len(w) for w in windows}
    out = []
    for t in docs:
        w, hit, found = alnum(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k : k + n]))
                if got is not None:
                    found |= got
                    hit.update(range(k, k + n))
        out.append((len(w), len(hit), sorted(found)))
    return out


def jaccard_components(rows, width=3, percent=90):  # noqa: ANN001, ANN201
    """[(doc_id, shingles, component)] of rows (doc_id, text)."""
    sets = []
    for _, t in rows:
        w = spaced(t)
        sets.append(frozenset(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):  # noqa: ANN001, ANN202
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    for k, s in enumerate(sets):
        shared = Counter(j for g in s for j in where[g] if j < k)
        for j, n in shared.items():
            a, b = rows[k][0], rows[j][0]
            if a is not None and b is not None and 100 * n >= percent * (len(s) + len(sets[j]) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), root(i) if i is not None else None) for (i, _), s in zip(rows, sets, strict=True)]
