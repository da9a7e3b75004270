"""Quality rules: counts that rule a text out, then a classifier with fixed thresholds.

The classifier is a logistic regression over hashed words and hashed 4-byte character n-grams, trained on labelled
rows, its scores turned into probabilities on rows that it was not trained on. It scores Arrow batches; a text's
features are summed over its whole length.

Scale: one pass over the texts, no shuffle of them. Training takes a bounded sample of labelled rows (``SAMPLE``), the
same rows on every run; executors turn their whole texts into slots (``2 << BITS`` at most a row), and only these reach
the driver. The weights, whose number is fixed, go to the executors.

Cases: a null or empty text has no words and fails the rules; very long texts are read whole, in arrays of some 60 bytes
a word; repeated labels of a document count once (the highest), of rows that share a sampled doc_id the first by text
counts; with labels of two kinds the classifier is always fitted, however few they are, and every fifth row of each kind
calibrates it (fewer than five of both kinds leave every probability at one half); without labelled rows of both kinds
the rules alone decide; ties at the threshold are kept; repeated rows are judged each; an empty table gives an empty
result; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fathomline.llm.common import LOWER, U64, WS, chunks, give_back, mix, owner, spans_hash, word_hashes, words

BITS = 16
#: Labelled rows that the classifier is trained on at most.
SAMPLE = 3000
#: A text is kept if it is good with at least this probability.
KEEP_FROM = 0.25
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WORD_SEED, GRAM_SEED = 1, 2
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of words and of character n-grams, each with the first index of every text."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets)
    slots = (mix(word_hashes(low, starts, ends) + U64(WORD_SEED)) >> U64(64 - BITS)).astype(np.int64)
    n = max(0, len(low) - 3)
    wide = low.astype(np.uint32)
    gram = wide[:n] | wide[1 : n + 1] << 8 | wide[2 : n + 2] << 16 | wide[3 : n + 3] << 24
    grams = ((gram * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    # n-grams that reach into the next text do not count: each text has its own part
    begin = np.minimum(offsets[:-1], n)
    end = np.maximum(begin, np.minimum(offsets[1:] - 3, n))
    return slots, first, grams, np.stack([begin, np.maximum(begin, end)])


def sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[end] - total[begin]


def margins(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Mean weight of a text's words plus mean weight of its n-grams."""
    slots, first, grams, (begin, end) = features(data, offsets)
    by_word = sums(weights[0][slots], first[:-1], first[1:]) / np.maximum(np.diff(first), 1)
    by_gram = sums(weights[1][grams], begin, end) / np.maximum(end - begin, 1)
    return by_word + by_gram + bias


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """COUNTS of each text, a row each."""
    starts, ends, first = words(data, offsets)
    n = np.diff(first)
    # a code point begins at every byte that is not a continuation
    point = ((data & 0xC0) != 0x80) & ~WS[data]
    chars = np.diff(np.concatenate([[0], np.cumsum(point)])[offsets])
    symbols = np.diff(np.concatenate([[0], np.cumsum(SYMBOLS[data])])[offsets])
    out = np.stack([n, chars, symbols, duplicate_lines(data, offsets), repeated(word_hashes(data, starts, ends), first)])
    return out.astype(np.int64)


def repeated(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window of three words found twice or more in it."""
    n, text = len(hashes), owner(first)
    if n < 3:
        return np.zeros(len(first) - 1, np.int64)
    windows = np.flatnonzero(text[2:] == text[:-2])
    marks = mix(spans_hash(hashes, windows, windows + 3) + text[windows].astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(marks, kind="stable")
    same = marks[order][1:] == marks[order][:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    found = np.zeros(n, bool)
    for k in range(3):
        found[windows[twice] + k] = True
    return np.diff(np.concatenate([[0], np.cumsum(found)])[first])


def duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    raw, out = data.tobytes(), np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        lines = raw[a:b].split(b"\n")
        if len(lines) > 1:
            lines = [x for x in lines if x and x.split(None, 1)]
            out[i] = len(lines) - len(set(lines))
    return out


def sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(doc_id, quality, slots, shares) of at most ``size`` labelled rows, those of the smallest hash of their doc_id."""
    marked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(size)
    # at most ``size`` rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(2)):
                slots, first, grams, (begin, end) = features(data, offsets)
                at, share = [], []
                for i in range(b - a):
                    both = [np.unique(part, return_counts=True) for part in (slots[first[i] : first[i + 1]], grams[begin[i] : end[i]])]
                    at.append(np.concatenate([both[0][0], both[1][0] + (1 << BITS)]).astype(np.int32))
                    share.append(np.concatenate([n / max(1, n.sum()) for _, n in both]).astype(np.float32))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], names=["doc_id", "quality", "slots", "shares"])

    types = [labels.schema["quality"].dataType, T.ArrayType(T.IntegerType()), T.ArrayType(T.FloatType())]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in zip(("quality", "slots", "shares"), types, strict=True))])
    return rows.select("doc_id", "quality", "text").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, steps: int = 150) -> tuple[np.ndarray, float] | None:
    """Weights of words and n-grams and the bias, calibrated; None if the labels are not of two kinds.

    The driver, which outlives this too, gives the memory of the sample back.
    """
    try:
        return fitted(sample(docs, labels, size).toArrow().sort_by("doc_id").combine_chunks(), steps)
    finally:
        give_back()


def fitted(rows: pa.Table, steps: int) -> tuple[np.ndarray, float] | None:
    y = (rows["quality"].to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return None
    slots, shares = (rows[c].chunk(0) for c in ("slots", "shares"))
    columns, values = (x.flatten().to_numpy(zero_copy_only=False) for x in (slots, shares))
    index = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(slots.offsets.to_numpy()))
    # every fifth row of each kind calibrates
    held = np.where(y > 0, np.cumsum(y > 0), np.cumsum(y == 0)) % 5 == 0
    weights, bias = fit(columns, values, index, y, ~held, steps)
    margin = np.bincount(index, values * weights[columns], len(y)) + bias
    slope, shift = platt(margin[held], y[held])
    return (weights * slope).reshape(2, -1), float(bias * slope + shift)


def fit(columns, values, index, y, use, steps, rate=0.5, decay=1e-5) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the logistic loss, both classes weighing alike."""
    n, d = len(y), 2 << BITS
    weigh = use * np.where(y > 0, 0.5 / max(1, (y * use).sum()), 0.5 / max(1, ((1 - y) * use).sum()))
    w, b = np.zeros(d), 0.0
    m, v, mb, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(index, values * w[columns], n) + b, -40, 40)))
        g = (p - y) * weigh
        grad = np.bincount(columns, values * g[index], d) + decay * w
        gb = g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w = w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b = b - rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, float(b)


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift that turn held-out margins into probabilities, by Newton's method with smoothed targets."""
    scale = max(1e-9, float(np.abs(margin).max()) if len(margin) else 1.0)
    up, down = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margin / scale, np.ones(len(margin))], axis=1)
    a = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(hessian, x.T @ (p - goal) + 1e-3 * a)
        a = a - move
        if np.abs(move).max() < 1e-9:
            break
    return float(a[0] / scale), float(a[1])


def judge(docs: DataFrame, labels: DataFrame | None = None, *, model: tuple[np.ndarray, float] | None = None, keep_from: float = KEEP_FROM, sample_rows: int = SAMPLE, carry: bool = False) -> DataFrame:
    """doc_id, COUNTS, base_failed, probability and kept of every document; with ``carry`` only those kept, as they came."""
    spark = docs.sparkSession
    if model is None and labels is not None:
        model = train(docs, labels, sample_rows)
    shared = spark.sparkContext.broadcast(None if model is None else (model[0].astype(np.float64), model[1]))
    fields = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("probability", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    source = docs if carry else docs.select("doc_id", "text")
    schema = docs.schema if carry else T.StructType([docs.schema["doc_id"], *fields])
    column = source.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(column)):
                c = counts(data, offsets)
                failed = (c[0] < MIN_WORDS) | (100 * c[4] > MAX_REPEATED * c[0])
                p = np.ones(last - first) if model is None else 1 / (1 + np.exp(-np.clip(margins(data, offsets, *model), -40, 40)))
                kept = ~failed & (p >= keep_from)
                rows = batch.slice(first, last - first)
                if carry:
                    yield rows.filter(pa.array(kept))
                else:
                    yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x) for x in (*c, failed, p, kept))], names=schema.fieldNames())

    return source.mapInArrow(run, schema)
