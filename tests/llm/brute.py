"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def repeats(rows, length=50):
    """doc_id -> (n_words, n_removed, sha256 of what is left) for rows (doc_id, text) with distinct doc_ids."""
    first = {}
    split = {d: words(t) for d, t in rows}
    for d, w in split.items():
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(left).encode()).hexdigest())
    return out


def shingles(text, n=5):
    w = words((text or "").translate(UP))
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def near_components(rows, percent=80):
    """doc_id -> (size of its set, smallest doc_id reachable by links)."""
    sets = {d: shingles(t) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    for d, s in sets.items():
        both = defaultdict(int)
        for x in s:
            for e in holders[x]:
                if e < d:
                    both[e] += 1
        for e, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}
