"""Substring dedup by recompression.

Every text is a string of word symbols. Rounds shorten it: a round for runs names each maximal run of one symbol, a
round for pairs names neighbouring symbols of which the first has coin 0 and the second coin 1. A name is a
fingerprint of what it stands for, so all tasks give equal content equal names without a name table. For each symbol
the rounds keep the words that decided it: its own and those of the neighbours that the decision looked at. A symbol
whose deciding words lie in a window appears in the same place of every other occurrence of that window.

A last round names each symbol together with both its neighbours, so that a short phrase in common is no shared name.
A window of ``length`` words is stood for by one of the symbols of the highest level that it decides: that whose name
hashes lowest, then the first. Neighbouring windows mostly agree, so about one symbol in fifteen words stands for all;
the few windows that decide no symbol of the two highest levels stand for themselves. Spark then compares: a symbol
whose name occurs in one text only clears all windows it stands for. For a shared name, occurrences whose whole stretch
of windows is equal form a class, and all but the class's smallest text repeat an earlier one. Only where classes of a
name differ are the single windows compared, one occurrence a class. A name only brings stretches together: what is
removed is decided by 128 bits of BLAKE2b over the stretch's or the window's words themselves.

Scale: rows shuffled are one for each standing symbol, a fraction of the words; grouping combines before shuffling, and
names, stretches and windows that hold more than a thousandth of all rows are joined by broadcast, so a passage in a
third of all texts is spread over all tasks. Texts are shuffled by doc_id, never gathered by content, and not even that
where the ranges that come back to them are few enough bytes to be broadcast.

Cases: a null text has no words; a text shorter than ``length`` words loses nothing; a window repeated within one text
alone stays; ties between equal windows of one text do not matter, all of them go or stay; rows that share a doc_id are
each judged against smaller doc_ids, not against each other; rows without a doc_id lose nothing and take nothing from
others; very long texts are read whole, in arrays of some 60 bytes a word; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathomline.llm.common import U64, chunks, cut, digests, frugal, if_small, join_spread, joined, mix, owner, spans_hash, word_hashes, words

LENGTH = 50
ROUNDS = (*("pair",) * 3, "run", "triple")
#: Levels, from the highest down, whose symbols stand for windows; windows that decide none of them stand alone.
STANDING = 2
#: Bits of the number of windows in a range; windows may be so long at most.
SPAN_BITS = 8


def shorten(kind: str, level: int, name, start, left, right, text):
    """One round over the symbols of many texts; ``left`` and ``right`` bound the words that decided each symbol."""
    n = len(name)
    joined = np.zeros(n, bool)  # with the next symbol
    same_text = text[1:] == text[:-1]
    far = np.int64(1) << 40
    if kind == "run":
        equal = same_text & (name[1:] == name[:-1])
        joined[:-1] = equal
        heads = np.flatnonzero(~np.concatenate([[False], equal]))
        tails = np.concatenate([heads[1:], [n]]) - 1
        size = tails - heads + 1
        named = np.where(size > 1, mix(name[heads] ^ (size.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(level))), name[heads])
        lo, hi = left[heads].copy(), right[tails].copy()
        # a run ends where its neighbours differ, so they decide too
        before, after = heads - 1, tails + 1
        inside = (before >= 0) & (text[np.maximum(before, 0)] == text[heads])
        lo = np.where(inside, np.minimum(lo, left[np.maximum(before, 0)]), -far)
        inside = (after < n) & (text[np.minimum(after, n - 1)] == text[heads])
        hi = np.where(inside, np.maximum(hi, right[np.minimum(after, n - 1)]), far)
        return named, start[heads], lo, hi, text[heads]
    if kind == "triple":
        # names of a symbol with both its neighbours: longer content, as many symbols
        mid = np.flatnonzero(same_text[:-1] & same_text[1:]) + 1 if n > 2 else np.zeros(0, np.int64)
        named = mix(mix(name[mid - 1] * U64(0x9FB21C651E98DF25) + name[mid]) + name[mid + 1] * U64(0xD6E8FEB86659FD93))
        return named, start[mid], left[mid - 1], right[mid + 1], text[mid]
    coin = (mix(name + U64(level * 0x9E3779B9)) >> U64(63)).astype(bool)
    pair = same_text & ~coin[:-1] & coin[1:]
    joined[:-1] = pair
    heads = np.flatnonzero(~np.concatenate([[False], pair]))
    double = joined[heads]
    mate = np.minimum(heads + 1, n - 1)
    named = np.where(double, mix(name[heads] * U64(0xA0761D6478BD642F) + mix(name[mate] + U64(level))), name[heads])
    # a single symbol looked at the neighbour it might have joined: the next one if its coin is 0, else the one before
    looks_on, looks_back = ~coin[heads], coin[heads]
    has_next = np.zeros(n, bool)
    has_next[:-1] = same_text
    has_before = np.zeros(n, bool)
    has_before[1:] = same_text
    before = np.maximum(heads - 1, 0)
    lo = np.where(looks_back, np.where(has_before[heads], np.minimum(left[heads], left[before]), -far), left[heads])
    hi = np.where(double | looks_on, np.where(has_next[heads], np.maximum(right[heads], right[mate]), far), right[heads])
    lo = np.where(double | looks_on, np.where(has_next[heads], np.minimum(lo, left[mate]), lo), lo)
    hi = np.where(looks_back, np.where(has_before[heads], np.maximum(hi, right[before]), hi), hi)
    return named, start[heads], lo, hi, text[heads]


def standing(hashes: np.ndarray, first: np.ndarray, length: int):
    """Names of the symbols that stand for windows, the first and last window of each (by first word), and its text."""
    n, text = len(hashes), owner(first)
    whole = np.zeros(n, bool)
    if n >= length:
        whole[: n - length + 1] = text[length - 1 :] == text[: n - length + 1]
    open_windows = whole.copy()
    levels = []
    place = np.arange(n, dtype=np.int64)
    state = (hashes, place, place, place + 1, text)
    levels.append(state)
    for level, kind in enumerate(ROUNDS, 1):
        if len(state[0]) < 2:
            break
        state = shorten(kind, level, *state)
        levels.append(state)
    found = []
    for level in range(len(levels) - 1, max(-1, len(ROUNDS) - STANDING), -1):
        name, _, left, right, own = levels[level]
        begin, end = first[own], first[own + 1]
        use = (right - left <= length) & (left >= begin) & (right <= end)
        name, left, right, begin, end, own = name[use], left[use], right[use], begin[use], end[use], own[use]
        if not len(name) or not open_windows.any():
            continue
        rank = mix(name ^ U64(0x5851F42D4C957F2D))
        low = np.maximum(right - length, begin)
        high = np.minimum(left, end - length)
        # windows that also decide a symbol of lower rank, or an earlier one of the same, are that one's
        gap = 1
        while gap < len(name):
            here, there = slice(gap, None), slice(None, -gap)
            near = (own[here] == own[there]) & (left[there] >= low[here])
            after = (own[here] == own[there]) & (right[here] - length <= high[there])
            if not (near.any() or after.any()):
                break
            np.maximum(low[here], left[there] + 1, out=low[here], where=near & (rank[there] <= rank[here]))
            np.minimum(high[there], right[here] - length - 1, out=high[there], where=after & (rank[here] < rank[there]))
            gap += 1
        free = np.concatenate([[0], np.cumsum(open_windows)])
        ok = low <= high
        low, high, name = low[ok], high[ok], name[ok]
        some = free[high + 1] > free[low]
        low, high, name = low[some], high[some], name[some]
        found.append((name + U64(level), low, high))
        marks = np.bincount(low, minlength=n + 1) - np.bincount(high + 1, minlength=n + 1)
        open_windows &= np.cumsum(marks)[:n] == 0
    alone = np.flatnonzero(open_windows)
    if len(alone):
        found.append((spans_hash(hashes, alone, alone + length) + U64(len(ROUNDS) + 1), alone, alone))
    if not found:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), text
    return (*(np.concatenate(x) for x in zip(*found, strict=True)), text)


def packed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A range of windows of a row as one number: first window, number of windows after it."""
    return low << SPAN_BITS | (high - low)


def unpacked():
    """Columns low and high of a packed range."""
    p = F.col("place")
    low = F.shiftright(p, SPAN_BITS)
    return low.alias("low"), (low + p.bitwiseAND(F.lit((1 << SPAN_BITS) - 1))).alias("high")


def symbols(docs: DataFrame, length: int) -> DataFrame:
    """A row for each standing symbol: its name, a digest of its stretch of windows, and where that lies."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(2)):
                starts, ends, first = words(data, offsets)
                name, low, high, text = standing(word_hashes(data, starts, ends), first, length)
                if not len(name):
                    continue
                raw, begin, end = joined(data, starts, ends)
                one, two = digests(raw, begin[low], end[high + length - 1])
                own = text[low]
                rows = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b].take(rows), batch.column(1)[a:b].take(rows), pa.array(name.view(np.int64)), pa.array(one), pa.array(two), pa.array(packed(low - first[own], high - first[own]))],
                    names=["doc_id", "tag", "name", "one", "two", "place"],
                )

    return docs.mapInArrow(run, "doc_id long, tag long, name long, one long, two long, place long")


def windows_of(ranges: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words (counted over all texts) of the distinct windows in each text's list of ranges, and their text."""
    own = np.repeat(np.arange(len(ranges)), np.diff(ranges.offsets.to_numpy()))
    low, high = (ranges.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
    n = int(first[-1]) + 1
    marks = np.bincount(low + first[own], minlength=n + 1) - np.bincount(high + 1 + first[own], minlength=n + 1)
    at = np.flatnonzero(np.cumsum(marks)[: n - 1] > 0)
    return at, np.searchsorted(first, at, side="right") - 1


def merged(ranges: DataFrame) -> DataFrame:
    """(doc_id, tag, ranges) of ranges (doc_id, tag, low, high); those that touch become one. Written, so as to be counted."""
    rows = ranges.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            own = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
            low, high = (column.flatten().field(k).to_numpy() for k in (0, 1))
            order = np.lexsort((low, own))
            own, low, high = own[order], low[order], high[order]
            if not len(own):
                continue
            # the furthest end so far, within each text
            base = own * (np.int64(1) << 36)
            reach = np.maximum.accumulate(high + base)
            fresh = np.concatenate([[True], low[1:] + base[1:] > reach[:-1] + 1])
            head = np.flatnonzero(fresh)
            tail = np.concatenate([head[1:], [len(own)]]) - 1
            first = np.concatenate([[0], np.cumsum(np.bincount(own[head], minlength=len(column)))])
            spans = pa.StructArray.from_arrays([pa.array(low[head]), pa.array(reach[tail] - base[tail])], names=["low", "high"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), spans)], names=["doc_id", "tag", "ranges"])

    return cut(rows.mapInArrow(run, "doc_id long, tag long, ranges array<struct<low:long,high:long>>"))


def bytes_of_ranges():
    return F.lit(48) + 16 * F.size("ranges")


def window_prints(docs: DataFrame, ranges: DataFrame, length: int) -> DataFrame:
    """Digests of the single windows in ``ranges`` (doc_id, tag, ranges) of the texts."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(2)):
                starts, ends, first = words(data, offsets)
                at, own = windows_of(batch.column(3)[a:b], first)
                raw, begin, end = joined(data, starts, ends)
                one, two = digests(raw, begin[at], end[at + length - 1])
                spot, rows = at - first[own], pa.array(own)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(rows), batch.column(1)[a:b].take(rows), pa.array(one), pa.array(two), pa.array(packed(spot, spot))], names=["doc_id", "tag", "one", "two", "place"])

    rows = docs.join(if_small(ranges, bytes_of_ranges()), ["doc_id", "tag"])
    return rows.select("doc_id", "tag", "text", "ranges").mapInArrow(run, "doc_id long, tag long, one long, two long, place long")


def repeated_ranges(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, tag, ranges) of windows, by first word, that also start in a smaller doc_id's text."""
    found = cut(symbols(docs, length))
    total, least, many = found.count(), F.min("doc_id").alias("least"), F.count("*").alias("rows_of_key")
    in_two = F.min("doc_id") < F.max("doc_id")
    names = found.groupBy("name").agg(in_two.alias("in_two"), (F.min("one") == F.max("one")).alias("alone"), many)
    shared = cut(join_spread(found, cut(names.filter("in_two").drop("in_two")), ["name"], total))
    classes = cut(shared.groupBy("name", "one", "two").agg(least, many))
    later = F.col("doc_id") > F.col("least")
    judged = join_spread(shared, classes, ["name", "one", "two"], total)
    judged = cut(judged.filter(later | ~F.col("alone")).select("doc_id", "tag", *unpacked(), later.alias("later")))
    prints = cut(window_prints(docs, merged(judged.filter("NOT later")), length))
    firsts = cut(prints.groupBy("one", "two").agg(in_two.alias("in_two"), least, many).filter("in_two").drop("in_two"))
    single = join_spread(prints, firsts, ["one", "two"], prints.count()).filter(later).select("doc_id", "tag", *unpacked())
    return merged(judged.filter("later").drop("later").unionByName(single))


def remove_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by one space; null unless ``texts``)."""
    if not 1 <= length <= 1 << SPAN_BITS:
        raise ValueError(f"windows have 1 to {1 << SPAN_BITS} words")
    tagged = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tag"), "text")
    rows = tagged.join(if_small(repeated_ranges(tagged, length), bytes_of_ranges()), ["doc_id", "tag"], "left").select("doc_id", "text", "ranges")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest, left = [], [], [], []
            for text, ranges in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                parts = (text.as_py() or b"").split()
                n.append(len(parts))
                for r in reversed(ranges.as_py() or []):  # in order and apart, but their words may touch
                    parts[r["low"] : r["high"] + length] = [None] * (min(r["high"] + length, n[-1]) - r["low"])
                parts = [w for w in parts if w is not None]
                gone.append(n[-1] - len(parts))
                rest = b" ".join(parts)
                digest.append(hashlib.sha256(rest).hexdigest())
                left.append(rest.decode() if texts else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest), pa.array(left, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
