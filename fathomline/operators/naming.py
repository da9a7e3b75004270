"""The best names for questions, without scoring every name for every question.

Names that share a rare word with a question, or have one like a word of it, are scored one by one. The others fall into
classes by their frequent words and their number of words; a class whose words are in the question has one score, so its
first names stand for it, and a class that cannot come within the band of the best name is left out as a whole. Names of
the classes that remain are scored as texts.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa

from fathomline.functions.fuzzy import partial_ratio_of, ratio_of, token_set_ratio_of
from fathomline.operators import near

#: Words in more names than this are frequent.
OFTEN = 64


def pieces_of(text: str, n: int = 3) -> set[str]:
    v = f" {text} "
    return {v[i : i + n] for i in range(max(1, len(v) - n + 1))}


def weight(shared: int, asked: int, words: int) -> float:
    """What ``fuzzy.secondary`` multiplies a score by."""
    if not asked or not words:
        return 1.0
    penalty = min(0.10, 0.05 * max(0.0, words / max(asked, 1) - 1.2))
    return (0.8 + 0.2 * shared / asked) * (1 + 0.1 * shared / max(words, 1) - penalty)


class Names:
    """Names (name_id, name, text, tokens) of one kind, indexed by words and pieces."""

    def __init__(self, ids: list, names: list[str], texts: list[str], tokens: list[list[str]]):
        order = sorted(range(len(ids)), key=lambda i: (ids[i], names[i] or ""))
        self.ids, self.names, self.texts, self.tokens = ([c[i] for i in order] for c in (ids, names, texts, tokens))
        listed = [[w for w in t.split(" ") if w] for t in self.texts]
        self.size, self.words = [len(w) for w in listed], [set(w) for w in listed]
        self.named, self.spoken = defaultdict(list), defaultdict(list)
        for into, rows in ((self.named, self.words), (self.spoken, map(set, self.tokens))):
            for i, words in enumerate(rows):
                for w in words:
                    into[w].append(i)
        self.often = {w for into in (self.named, self.spoken) for w, rows in into.items() if len(rows) > OFTEN}
        classes = defaultdict(list)
        for i, (words, tokens) in enumerate(zip(self.words, self.tokens, strict=True)):
            classes[frozenset(words & self.often), frozenset(self.often.intersection(tokens)), self.size[i]].append(i)
        self.classes = list(classes.items())
        self.index = None

    def sharing(self, text: str, share: float) -> np.ndarray:
        """Whether each name shares the part ``share`` of its or the text's pieces, whichever has fewer."""
        if self.index is None:
            rows = defaultdict(list)
            for i, t in enumerate(self.texts):
                for p in pieces_of(t) if t else ():
                    rows[p].append(i)
            self.index = {p: np.array(r) for p, r in rows.items()}
            self.pieces = np.array([len(pieces_of(t)) for t in self.texts])
        mine = pieces_of(text)
        found = [self.index[p] for p in mine if p in self.index]
        shared = np.bincount(np.concatenate(found) if found else np.zeros(0, np.int64), minlength=len(self.ids))
        return (shared > 0) & (shared >= np.ceil(np.minimum(self.pieces, len(mine)) * share)) & (text != "")

    def best(self, text: str, like: dict[str, float], cutoff: float, keep: int, band: float, gain: float, share: float) -> list[tuple[int, float]]:
        """(row, score) of the ``keep`` best names, of those that can be within ``band`` of the best one of all. ``like`` has
        the words of names that are like one of the question's, with their ratios."""
        asked = {w for w in text.split(" ") if w}
        frequent, scores, near_enough = asked & self.often, {}, None

        def judge(i: int) -> None:
            nonlocal near_enough
            if i in scores:
                return
            s = max((like.get(t, 0.0) for t in self.tokens[i]), default=0.0)
            if s < 100:
                near_enough = self.sharing(text, share) if near_enough is None else near_enough
                if near_enough[i]:
                    s = max(s, token_set_ratio_of(text, self.texts[i]), min(100.0, gain * partial_ratio_of(text, self.texts[i])))
                elif not s:
                    return
            some = asked and self.size[i]
            scores[i] = min(100.0, s * weight(len(asked & self.words[i]), len(asked), self.size[i])) if some else s

        for into, words in ((self.named, asked), (self.spoken, like)):
            for w in words:
                if w not in self.often:
                    for i in into.get(w, ()):
                        judge(i)
        open_ = []
        for (words, tokens, size), rows in self.classes:
            if max((like.get(t, 0.0) for t in tokens), default=0.0) >= 100:
                # one score for all but those with more words in common, whose own is not less
                for i in rows[:keep]:
                    judge(i)
            else:
                most = weight(len(words & frequent), len(asked), size)
                open_.append((min(100.0, 100.0 * most) if asked and size else 100.0, rows))
        top = max(scores.values(), default=0.0)
        for most, rows in sorted(open_, key=lambda c: -c[0]):
            if most < max(top, cutoff) - band - 1e-9:
                break
            for i in rows:
                judge(i)
            top = max([top, *(scores[i] for i in rows if i in scores)])
        rows = sorted(scores, key=lambda i: (-scores[i], self.ids[i]))[:keep]
        return [(i, scores[i]) for i in rows if scores[i] >= max(top, cutoff) - band]


def best_names(queries: pa.Table, names: pa.Table, least: float, band: float, gain: float, share: float) -> pa.Table:
    """(query_id, kind, name_id, name, score) for queries (query_id, kind, text, tokens, cutoff, keep) and names (name_id,
    name, text, tokens) of one kind; words are alike from the ratio ``least``."""
    out = []
    if len(queries) and len(names):
        index = Names(*(names[c].to_pylist() for c in ("name_id", "name", "text", "tokens")))
        mine = sorted({w for row in queries["tokens"].to_pylist() for w in row})
        other = sorted(index.spoken)
        alike = defaultdict(dict)
        for x, y in near.alike(mine, other, least / 100):
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                s = ratio_of(mine[i], other[j])
                if s >= least:
                    alike[mine[i]][other[j]] = s
        for row in queries.to_pylist():
            like: dict[str, float] = {}
            for w in row["tokens"]:
                for t, s in alike[w].items() if w in alike else ():
                    like[t] = max(s, like.get(t, 0.0))
            for i, s in index.best(row["text"], like, row["cutoff"], row["keep"], band, gain, share):
                out.append((row["query_id"], row["kind"], index.ids[i], index.names[i], s))
    columns = list(zip(*out, strict=True)) or [()] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, (queries["query_id"].type, pa.string(), names["name_id"].type, pa.string(), pa.float64()), strict=True)], names=["query_id", "kind", "name_id", "name", "score"])
