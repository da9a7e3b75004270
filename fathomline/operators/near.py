"""Pairs of texts that are alike by their longest common subsequence, without scoring all pairs.

Texts of one length lie in a tree of their letters, level by level in arrays. All searched texts go down it together, each
with the bit vector of its subsequences (as in ``fuzzy.lcs``), and leave a branch as soon as the letters to come cannot
bring the ratio to the threshold: those that every text of the branch has and the searched one lacks count as lost. The
tree begins at that end of the texts where they differ less, so that most are left while few branches are there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Texts of each side that meet in one task, and places in the tree that are held at once.
SEARCHED, HELD, FRONT = 25_000, 100_000, 1 << 19
#: Letters are told apart in these many sorts when lost ones are counted.
SORTS = 32


class Tree:
    """Texts of one length, as an array of their code points (rows sorted), by their first letters."""

    def __init__(self, codes: np.ndarray):
        n, size = codes.shape
        order = np.lexsort(codes.T[::-1])
        self.rows, codes = order, codes[order]
        fresh = np.zeros(n, bool)
        fresh[:1] = True
        starts = [np.zeros(1, np.int64)]
        self.letter, self.first, self.sorts = [np.zeros(1, np.int64)], [], []
        for d in range(size):
            fresh[1:] |= codes[1:, d] != codes[:-1, d]
            at = np.flatnonzero(fresh)
            self.first.append(np.append(np.searchsorted(at, starts[-1]), len(at)))
            starts.append(at)
            self.letter.append(codes[at, d])
        # how often each sort of letter comes at least in what is left of the texts of a branch
        left = np.zeros((n, SORTS), np.int16)
        for d in range(size, -1, -1):
            self.sorts.append(np.minimum.reduceat(left, starts[d], axis=0))
            if d:
                left[np.arange(n), codes[:, d - 1] % SORTS] += 1
        self.sorts.reverse()
        # equal texts end in one leaf
        self.ends, self.size = np.append(starts[-1], n), size


def codes_of(texts: list[str]) -> np.ndarray:
    """Code points of texts of one length."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").reshape(len(texts), -1).astype(np.int64)


def search(tree: Tree, codes: np.ndarray, threshold: float, same: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of ``codes``, row of the tree's texts) of pairs whose ratio (0 to 1) is ``threshold`` or more and whose first
    ``same`` letters are equal."""
    n, length = codes.shape
    need = threshold * (length + tree.size) / 2 - 1e-9
    if min(length, tree.size) < need or same > min(length, tree.size):
        return
    letters, flat = np.unique(np.concatenate([codes.ravel(), *tree.letter[1:]]), return_inverse=True)
    kind = np.uint64 if length < 64 else object
    bit = np.array([1 << i for i in range(length)], kind)
    has = np.zeros((n, len(letters)), kind)
    for i in range(length):
        has[np.arange(n), flat[i : n * length : length]] |= bit[i]
    steps = np.split(flat[n * length :], np.cumsum([len(x) for x in tree.letter[1:]])[:-1])
    have = np.zeros((n, SORTS), np.int16)
    np.add.at(have, (np.repeat(np.arange(n), length), (codes % SORTS).ravel()), 1)
    full = kind((1 << length) - 1) if kind is np.uint64 else (1 << length) - 1
    ones = np.bitwise_count if kind is np.uint64 else np.frompyfunc(int.bit_count, 1, 1)
    held = [(0, np.arange(n), np.zeros(n, np.int64), np.full(n, full, kind))]
    while held:
        d, x, node, v = held.pop()
        if d == tree.size:
            count = tree.ends[node + 1] - tree.ends[node]
            yield np.repeat(x, count), tree.rows[np.repeat(tree.ends[node] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            continue
        first = tree.first[d]
        count = first[node + 1] - first[node]
        if len(x) > 1 and count.sum() > FRONT:
            half = len(x) // 2
            held += [(d, x[half:], node[half:], v[half:]), (d, x[:half], node[:half], v[:half])]
            continue
        node = np.repeat(first[node] - np.cumsum(count) + count, count) + np.arange(count.sum())
        x, v = np.repeat(x, count), np.repeat(v, count)
        if d < same:
            keep = np.flatnonzero(tree.letter[d + 1][node] == codes[x, d])
            x, node, v = x[keep], node[keep], v[keep]
        hit = v & has[x, steps[d][node]]
        v = ((v + hit) | (v - hit)) & full
        most = (length - ones(v)).astype(np.int64) + (tree.size - d - 1)
        keep = np.flatnonzero(most >= need)
        if len(keep):
            lost = np.maximum(tree.sorts[d + 1][node[keep]] - have[x[keep]], 0).sum(axis=1)
            keep = keep[most[keep] - lost >= need]
        if len(keep):
            held.append((d + 1, x[keep], node[keep], v[keep]))


def branches(codes: np.ndarray) -> int:
    """How many branches the tree of the texts has on all its levels."""
    codes = codes[np.lexsort(codes.T[::-1])]
    return int(np.maximum.accumulate(codes[1:] != codes[:-1], axis=1).sum())


def by_length(texts: list[str]) -> dict[int, np.ndarray]:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return {int(k): np.flatnonzero(size == k) for k in np.unique(size) if k}


def alike(left: list[str], right: list[str], threshold: float, same: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of ``left``, row of ``right``) of pairs with a ratio of ``threshold`` (0 to 1) or more; empty texts have none."""
    mine = by_length(left)
    for size, rows in by_length(right).items():
        near = [k for k in mine if 2 * min(k, size) >= threshold * (k + size) - 1e-9]
        if near:
            codes = codes_of([right[i] for i in rows])
            way = -1 if not same and branches(codes[:, ::-1]) < branches(codes) else 1
            tree = Tree(codes[:, ::way])
            for k in near:
                for i in range(0, len(mine[k]), 2000):
                    own = mine[k][i : i + 2000]
                    for x, y in search(tree, codes_of([left[j] for j in own])[:, ::way], threshold, same):
                        yield own[x], rows[y]


def pairs(left: DataFrame, right: DataFrame, threshold: float, same: int = 0, searched: int = SEARCHED, held: int = HELD) -> DataFrame:
    """Pairs (x, y) of the distinct texts x of ``left`` and y of ``right`` whose ratio is ``threshold`` (0 to 1) or more and
    whose first ``same`` letters are equal; all such pairs. Parts of both sides meet, each in one task."""
    a, b = (df.select(c).filter(F.col(c) != "").distinct() for df, c in ((left, "x"), (right, "y")))
    n, m = (max(1, -(-df.count() // most)) for df, most in ((a, searched), (b, held)))
    part = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = a.select("x", part("x", n).alias("i"), every(m).alias("j")).repartition(n * m, "i", "j")
    b = b.select("y", every(n).alias("i"), part("y", m).alias("j")).repartition(n * m, "i", "j")

    def meet(mine: pa.Table, other: pa.Table) -> pa.Table:
        found = list(alike(mine["x"].to_pylist(), other["y"].to_pylist(), threshold, same)) if len(mine) and len(other) else []
        x, y = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (list(zip(*found, strict=True)) or ((), ())))
        return pa.table({"x": mine["x"].take(pa.array(x)), "y": other["y"].take(pa.array(y))})

    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(meet, "x string, y string")
