"""Fuzzy similarity of strings, 0 to 100, by public definitions, in Arrow batches.

``ratio`` is 200 times the longest common subsequence over the summed lengths (insertions and deletions only).
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        hit = v & where.get(c, 0)
        v = ((v + hit) | (v - hit)) & full
    return len(a) - v.bit_count()


def ratio_of(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * lcs(a, b) / n


def partial_ratio_of(a: str, b: str) -> float:
    """The best ratio of the shorter string with any stretch of the longer of its length, ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    m = len(a)
    spots = {b[max(0, i) : min(len(b), i + m)] for i in range(1 - m, len(b))}
    return max(ratio_of(a, s) for s in spots)


def token_set_ratio_of(a: str, b: str) -> float:
    """Best ratio among the shared words and these with either side's own words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(p for p in (both, " ".join(sorted(d))) if p) for d in (x - y, y - x))
    if both and (not x - y or not y - x):
        return 100.0
    tries = [ratio_of(left, right)]
    if both:
        tries += [ratio_of(both, left), ratio_of(both, right)]
    return max(tries)


def token_sort_ratio_of(a: str, b: str) -> float:
    return ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def weighted_ratio_of(a: str, b: str) -> float:
    """Plain and word-wise ratios, the partial ones where lengths are far apart, each with its weight."""
    if not a or not b:
        return 0.0
    far = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio_of(a, b)
    if far < 1.5:
        return max(best, 0.95 * token_sort_ratio_of(a, b), 0.95 * token_set_ratio_of(a, b))
    scale = 0.9 if far < 8 else 0.6
    words = partial_ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    shared = 100.0 if set(a.split()) & set(b.split()) else words
    return max(best, scale * partial_ratio_of(a, b), 0.95 * scale * max(words, shared))


def sequence_ratio_of(a: str, b: str) -> float:
    """Matching blocks by the public gestalt method, 0 to 1."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def _udf(score):
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if None in pair:
                out.append(None)
                continue
            if pair not in known:
                known[pair] = score(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(f, "double")


def ratio(a, b):
    return _udf(ratio_of)(a, b)


def partial_ratio(a, b):
    return _udf(partial_ratio_of)(a, b)


def token_set_ratio(a, b):
    return _udf(token_set_ratio_of)(a, b)


def token_sort_ratio(a, b):
    return _udf(token_sort_ratio_of)(a, b)


def weighted_ratio(a, b):
    return _udf(weighted_ratio_of)(a, b)


def sequence_ratio(a, b):
    return _udf(sequence_ratio_of)(a, b)


def secondary(score, query, name):
    """A score weighed by the part of the query's words that the name has, by how much of the name these are, and by how
    much longer the name is; capped at 100. ``query`` and ``name`` are texts of words."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    q, n = F.array_distinct(words(query)), words(name)
    shared = F.size(F.array_intersect(q, n))
    longer = F.size(n) / F.greatest(F.size(q), F.lit(1))
    penalty = F.least(F.lit(0.10), 0.05 * F.greatest(F.lit(0.0), longer - 1.2))
    weighed = score * (0.8 + 0.2 * shared / F.size(q)) * (1 + 0.1 * shared / F.greatest(F.size(n), F.lit(1)) - penalty)
    return F.when((F.size(q) == 0) | (F.size(n) == 0), score).otherwise(F.least(F.lit(100.0), weighed))


def register(spark) -> None:
    """Makes the scorers callable from SQL."""
    for name, f in (("fuzzy_ratio", ratio_of), ("fuzzy_partial_ratio", partial_ratio_of), ("fuzzy_token_set_ratio", token_set_ratio_of), ("fuzzy_weighted_ratio", weighted_ratio_of), ("sequence_ratio", sequence_ratio_of)):
        spark.udf.register(name, _udf(f))
