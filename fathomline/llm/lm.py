"""Scores of whole texts by language models that are learned from the training part of the table.

The base is a model of single words with counts plus one. The model is causal self-attention over subword symbols, in
numpy: overlapping windows of context, of which each scores its last places only, so every symbol is scored once. A
symbol is a subword id together with whether its word ends there, so that ends of words are predicted too; a text's end
is a word of its own. The model predicts the class of a word's first symbol from what came before. Then the word is
either recalled, as often as training texts have it among words of that class, or spelled symbol by symbol, each by its
class from the attention and its share of the class from counts. How often words are spelled is the share of words of
the class that training texts have once (Good and Turing), so all words together have probability one at most.

All of it is learned from all training texts: words and symbols are counted over whole texts, and the attention weights
are trained on windows that cover every training text from its first symbol to its end. Training goes by rounds, each on
a part of the windows: each task trains a copy on its own, and the copies are averaged.

Scale: words are counted in each task and then over all tasks, by fingerprint, and each distinct word is tokenised
once. A score needs the counts and symbols of a text's words, and their table grows with the corpus; so texts are dealt
into blocks of bounded size, each block asks for its distinct words once, and the answers meet the block's texts in one
task; both steps share one shuffle of the texts. To the driver come counts of the symbols (bounded by the tokenizer),
two totals and the averaged weights of ``SLOTS`` groups of tasks a round.

Cases: a null text is like an empty one: its end alone is scored; texts are scored whole, very long ones in arrays of
some 200 bytes a word; without training texts every count is 0 and the weights stay as drawn; ties do not arise;
repeated rows are scored each, also rows without a doc_id; an empty table gives an empty result; other columns are
ignored, whatever their names. Words without any subword id count as one symbol of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathomline.llm import attention
from fathomline.llm.common import LOWER, chunks, cut, frugal, give_back, keep_at_hand, texts, word_hashes, words
from fathomline.llm.subwords import Subwords, default_tokenizer

#: Bytes of text in a block, and of text whose words are counted together in a task.
BLOCK_BYTES, STRETCH_BYTES = 20 << 20, 24 << 20
#: Training windows cover one word in DRAW, that is every word, and RUN symbols each; bytes of text made into windows together.
DRAW, RUN, WINDOW_BYTES = 1, attention.CONTEXT, 1 << 21
#: Distinct words tokenised together, at least if there are so many.
WORDS_TOGETHER = 1 << 16
#: Windows of a row of the table that training reads, and rows whose windows are permuted together.
TOGETHER, AT_ONCE = 100, 25
#: Rounds of training, steps of a task in a round at least, and groups of tasks whose weights are averaged apart.
ROUNDS, STEPS, SLOTS, RATE = 4, 200, 64, 0.02
#: The end of a text among the words.
END = np.int64(-1)


def words_in(data: np.ndarray, offsets: np.ndarray):
    low = LOWER[data]
    starts, ends, first = words(low, offsets)
    return low, starts, ends, first, word_hashes(low, starts, ends).view(np.int64)


def distinct_keys(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in the order that they come in, a place of each, and which of them stands at every place."""
    found = pa.array(key).dictionary_encode()
    which = found.indices.to_numpy()
    fresh, at = found.dictionary.to_numpy(), np.empty(len(found.dictionary), np.int64)
    at[which] = np.arange(len(key))
    return fresh, at, which


def count_words(docs: DataFrame) -> DataFrame:
    """(key, word, n) of distinct words of the stretches of each task; the end of texts has the key END and no word.

    Words of held-out texts are listed but not counted.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ended, any_text = [], 0, 0, False

        def flush() -> pa.RecordBatch:
            key, word = np.concatenate([h for h, _ in held]), pa.concat_arrays([w for _, w in held])
            fresh, at, which = distinct_keys(key)
            n = np.bincount(which, np.concatenate([c for *_, c in counts]), len(fresh)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(fresh), word.take(pa.array(at)), pa.array(n)], names=["key", "word", "n"])

        counts: list[tuple] = []
        for batch in batches:
            held_out = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in chunks(batch.column(0)):
                low, starts, ends, first, key = words_in(data, offsets)
                any_text = True
                ended += int((~held_out[a:b]).sum())
                if len(key):
                    fresh, at, which = distinct_keys(key)
                    n = np.bincount(which, np.repeat(~held_out[a:b], np.diff(first)), len(fresh))
                    length = (ends - starts)[at]
                    into = np.concatenate([[0], np.cumsum(length)])
                    spot = np.arange(into[-1]) + np.repeat(starts[at] - into[:-1], length)
                    word = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(into.astype(np.int32)), pa.py_buffer(low[spot])])
                    held.append((fresh, word))
                    counts.append((n.astype(np.int64),))
                size += len(data)
                if size >= STRETCH_BYTES and held:
                    yield flush()
                    held, counts, size = [], [], 0
        if held:
            yield flush()
        if any_text:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([b""], pa.binary()), pa.array([ended], pa.int64())], names=["key", "word", "n"])

    return docs.select("text", "held_out").mapInArrow(run, "key long, word binary, n long")


def id_type(size: int) -> str:
    """For the tokenizer's ids, that of a text's end (``size``) and that of words without ids (``size`` + 1)."""
    return "<u2" if size + 2 < 1 << 16 else "<u4"


def codes_of(subwords: Subwords, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words laid end to end, and the first one's index of each word and the end of all."""
    ids, size = subwords.ids_of_spans(data, starts, ends)
    empty = np.flatnonzero(size == 0)
    if len(empty):
        ids, size = np.insert(ids, np.cumsum(size)[empty], subwords.size + 1), np.maximum(size, 1)
    return ids.astype(id_type(subwords.size)), np.concatenate([[0], np.cumsum(size)])


def tokenised(counts: DataFrame, path: str) -> DataFrame:
    """(key, n, ids) of counted words."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, held = Subwords.of(path), []

        def flush() -> pa.RecordBatch:
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            data, offsets = texts(batch.column("word"))
            flat, into = codes_of(subwords, data, offsets[:-1], offsets[1:])
            # the end of texts has no word, so it came as one without ids
            flat[into[:-1][batch.column("key").to_numpy() == END]] = subwords.size
            ids = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((into * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])
            return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), ids], names=["key", "n", "ids"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= WORDS_TOGETHER:
                yield flush()
        if held:
            yield flush()
        subwords.forget()

    return counts.mapInArrow(run, "key long, n long, ids binary")


def symbols_of(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the id, and one more at the last id of a word."""
    out = 2 * ids.astype(np.int64)
    out[first[1:] - 1] += 1
    return out


def ragged(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows of a binary column, and the first one's index of each row."""
    data, offsets = texts(column)
    width = np.dtype(kind).itemsize
    return np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), kind), (offsets - offsets[0]) // width


def count_symbols(words_and_ids: DataFrame, size: int) -> DataFrame:
    """(symbol, n, heads, singles): how often training texts have a symbol, words that begin with it, and how many such
    words they have once."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, first = ragged(batch.column("ids"), id_type(size))
            n, symbol = batch.column("n").to_numpy(), symbols_of(flat, first)
            codes, at = np.unique(symbol, return_inverse=True)
            head = at[first[:-1]]
            totals = [np.bincount(i, x, len(codes)).astype(np.int64) for i, x in ((at, np.repeat(n, np.diff(first))), (head, n), (head, n == 1))]
            yield pa.RecordBatch.from_arrays([pa.array(codes), *map(pa.array, totals)], names=["symbol", "n", "heads", "singles"])

    rows = words_and_ids.filter("n > 0").select("n", "ids").mapInArrow(run, "symbol long, n long, heads long, singles long")
    return rows.groupBy("symbol").agg(*(F.sum(c).alias(c) for c in ("n", "heads", "singles")))


def fine_kinds(counts: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kind of each symbol, and the class of each kind: frequent ones are kinds of their own, the rest of a class share
    one."""
    own = min(attention.OWN_KINDS, len(counts))
    order = np.argsort(-counts, kind="stable")[:own]
    fine = own + kind
    fine[order] = np.arange(own)
    return fine, np.concatenate([kind[order], np.arange(attention.KINDS - own)[: attention.CLASSES]])


def packed_rows(windows: np.ndarray, together: int, k: int | None) -> pa.RecordBatch:
    """Rows (inputs, and round before them if there is one) of so many windows each; the last may have fewer."""
    n = -(-len(windows) // together)
    where = np.minimum(np.arange(n + 1) * together, len(windows)) * windows.shape[1] * windows.itemsize
    inputs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(where.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(windows))])
    if k is None:
        return pa.RecordBatch.from_arrays([inputs], names=["inputs"])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), inputs], names=["round", "inputs"])


def draw_windows(docs: DataFrame, model, path: str, together: int = 0) -> DataFrame:
    """Windows (inputs) over all symbols of all texts, ends included: the kinds that the model reads and, last, the one
    that follows them. Every symbol follows once; places before a text and after its end have the kind of a start.

    With ``together`` the windows are dealt out to the rounds of training (round), and a row has so many of one round.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_at_hand()
        m, subwords = model.value, Subwords.of(path)
        start, seen = len(m["class_of"]), 0
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0), WINDOW_BYTES):
                low, starts, ends, first, key = words_in(data, offsets)
                fresh, at, which = distinct_keys(key)
                flat, into = codes_of(subwords, low, starts[at], ends[at])
                flat, into = np.append(flat, flat.dtype.type(subwords.size)), np.append(into, into[-1] + 1)  # the end
                kinds = m["fine"][symbols_of(flat, into)].astype("<u2")
                # a text's end follows its words, also where there are none
                word = np.insert(which, first[1:], len(fresh))
                size = np.diff(into)[word]
                spot = np.arange(size.sum()) + np.repeat(into[word] - np.cumsum(size) + size, size)
                total = np.concatenate([[0], np.cumsum(size)])[first + np.arange(len(first))]
                rows = attention.runs_of(kinds[spot], np.diff(total), RUN, start)
                if not together:
                    yield packed_rows(rows, 1, None)
                else:
                    for k in range(ROUNDS):
                        yield packed_rows(rows[(k - seen) % ROUNDS :: ROUNDS], together, k)
                    seen += len(rows)
        subwords.forget()

    return docs.select("text").mapInArrow(run, "round int, inputs binary" if together else "inputs binary")


def trained(windows: DataFrame, weights: dict, class_of: np.ndarray) -> dict:
    """Weights after ROUNDS rounds: each task trains a copy on its windows of the round, and the copies are averaged."""
    spark = windows.sparkSession
    # a start follows nothing
    goal = np.append(class_of, -1)

    def average(table: pa.Table) -> pa.Table:
        n = table["n"].to_numpy()
        total = sum(k * np.frombuffer(w, "<f4").astype(float) for k, w in zip(n.tolist(), table["weights"].to_pylist(), strict=True))
        return pa.table({"slot": table["slot"][:1], "n": [int(n.sum())], "weights": pa.array([(total / n.sum()).astype("<f4").tobytes()], pa.binary())})

    for k in range(ROUNDS):
        sent = spark.sparkContext.broadcast(attention.packed(weights))
        rate = RATE * (1 - 0.9 * k / max(1, ROUNDS - 1))

        @frugal
        def run(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate) -> Iterator[pa.RecordBatch]:
            keep_at_hand()

            def parts():
                for batch in batches:
                    for i in range(0, batch.num_rows, AT_ONCE):
                        kinds = ragged(batch.column(0).slice(i, AT_ONCE), "<u2")[0].reshape(-1, RUN + 1).astype(np.int64)
                        yield kinds[:, :-1], goal[kinds[:, 1:]]

            w, n = attention.train(attention.unpacked(sent.value, weights), parts(), rate, STEPS)
            if n:
                from pyspark import TaskContext

                slot = TaskContext.get().partitionId() % SLOTS
                yield pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([n]), pa.array([attention.packed(w)], pa.binary())], names=["slot", "n", "weights"])

        kind = "slot long, n long, weights binary"
        # at most SLOTS rows of the model's size
        rows = windows.filter(F.col("round") == k).select("inputs").mapInArrow(run, kind).groupBy("slot").applyInArrow(average, kind).toArrow().sort_by("slot")
        if len(rows):
            weights = attention.unpacked(average(rows)["weights"][0].as_py(), weights)
    return weights


def learn(docs: DataFrame, counts: DataFrame, path: str) -> dict:
    """The model from training texts and counted words: weights, each symbol's class, kind and log share of its class,
    and for each class of first symbols how many words have it and how many of these are recalled."""
    spark, size = docs.sparkSession, Subwords.of(path).size
    total, heads, singles = np.zeros((3, 2 * size + 4))
    rows = count_symbols(counts, size).toArrow()  # bounded by the tokenizer
    for into, name in ((total, "n"), (heads, "heads"), (singles, "singles")):
        into[rows["symbol"].to_numpy()] = rows[name].to_numpy()
    kind, inner = attention.classes_of(total)
    fine, class_of = fine_kinds(total, kind)
    words, once = (np.bincount(kind, x, attention.CLASSES) for x in (heads, singles))
    model = {"kind": kind.astype(np.int16), "fine": fine.astype(np.int16), "class_of": class_of, "inner": inner, "words": words, "recall": np.where(words > 0, (words - once + 0.5) / (words + 1), 0.0), "size": size, "ids": id_type(size)}
    windows = cut(draw_windows(docs, spark.sparkContext.broadcast(model), path, TOGETHER))
    weights = attention.initial(classes=attention.CLASSES, kinds=len(class_of))
    return model | {"weights": trained(windows, weights, class_of)}


def predicted(words_and_ids: DataFrame, model) -> DataFrame:
    """(key, n, inner, kinds): of each word the kinds of its symbols, and the summed log of their shares of their
    classes."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            flat, first = ragged(batch.column("ids"), m["ids"])
            symbol = symbols_of(flat, first)
            inner = np.add.reduceat(m["inner"][symbol], first[:-1]) if len(symbol) else np.zeros(0)
            kinds = pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((2 * first).astype(np.int32)), pa.py_buffer(m["fine"][symbol].astype("<u2"))])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(inner), kinds], names=["key", "n", "inner", "kinds"])

    return words_and_ids.mapInArrow(run, "key long, n long, inner double, kinds binary")


def word_scores(m: dict, kinds: np.ndarray, into: np.ndarray, log_n: np.ndarray, inner: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each word, given all before it: its first symbol's class, times what it is
    recalled or spelled with."""
    place = attention.log_probabilities(m["weights"], kinds, size, m["class_of"])
    if not len(place):
        return np.zeros(0)
    head = place[into[:-1]]
    kind = m["class_of"][kinds[into[:-1]]]
    with np.errstate(divide="ignore"):
        recalled = np.log(m["recall"] / np.maximum(m["words"], 1))[kind] + log_n
        spelled = np.log1p(-m["recall"])[kind] + inner + np.add.reduceat(place, into[:-1]) - head
    return head + np.logaddexp(recalled, spelled)


def score(docs: DataFrame, held_out, tokenizer: str | None = None, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; ``held_out`` is a column."""
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = docs.filter(~F.col("held_out"))
    counts = cut(tokenised(count_words(docs).groupBy("key").agg(F.first("word").alias("word"), F.sum("n").alias("n")), path))
    whole = counts.agg(F.count_if(F.col("n") > 0).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    model = spark.sparkContext.broadcast(model or learn(training, counts, path))
    distinct, tokens = int(whole["v"]), int(whole["n"])

    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-size // BLOCK_BYTES))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int"))

    def ask(table: pa.Table) -> pa.Table:
        try:
            return ask_all(table)
        finally:
            give_back()

    def ask_all(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        keys = [np.array([END])]
        for part in table["text"].chunks:
            keys += [pa.array(words_in(data, offsets)[4]).unique().to_numpy() for *_, data, offsets in chunks(part)]
        key = pa.array(np.concatenate(keys)).unique().to_numpy()
        return pa.table({"block": pa.array(np.full(len(key), block, np.int32)), "key": pa.array(key)})

    # all columns, so that the shuffle of the texts is made once for both steps
    asked = dealt.groupBy("block").applyInArrow(ask, "block int, key long")
    answers = asked.join(predicted(counts, model), "key").select("block", "key", "n", "inner", "kinds")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def judge(there: pa.Table, known: pa.Table) -> pa.Table:
        try:
            return judge_all(there, known)
        finally:
            give_back()

    def judge_all(there: pa.Table, known: pa.Table) -> pa.Table:
        keep_at_hand()
        m = model.value
        known = known.sort_by("key").combine_chunks()
        key, n = known["key"].to_numpy(), known["n"].to_numpy()
        flat, at = ragged(known["kinds"].chunk(0), "<u2")
        within = known["inner"].to_numpy()
        length, logs = np.diff(at), np.log10((n + 1.0) / (tokens + distinct + 1.0))
        with np.errstate(divide="ignore"):
            log_n = np.log(n)
        end = int(np.searchsorted(key, END))
        out = []
        for batch in there.to_batches():
            for a, b, data, offsets in chunks(batch.column("text"), 1 << 19):
                _, _, _, first, word = words_in(data, offsets)
                # every word of the block was asked for; a text's end follows its words
                fresh, _, which = distinct_keys(word)
                row = np.insert(np.searchsorted(key, fresh)[which], first[1:], end)
                first = first + np.arange(len(first))
                size = length[row]
                into = np.concatenate([[0], np.cumsum(size)])
                kinds = flat[np.arange(into[-1]) + np.repeat(at[row] - into[:-1], size)]
                own = word_scores(m, kinds, into, log_n[row], within[row], np.diff(into[first]))
                own, base = (np.array([float(np.sum(x[i:j])) for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]) for x in (own, logs[row]))
                seen = np.diff(np.concatenate([[0], np.cumsum(n[row] > 0)])[first])
                out.append((batch.column("doc_id")[a:b], batch.column("held_out")[a:b], np.diff(first), seen, base, own / np.log(10)))
        if not out:
            return pa.table({k: pa.array([], t) for k, t in zip(names, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})
        columns = list(zip(*out, strict=True))
        docs, held = (pa.concat_arrays(x) for x in columns[:2])
        n_tokens, n_known, base, own = map(np.concatenate, columns[2:])
        return pa.table([docs, held, pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(docs), tokens)), pa.array(base), pa.array(own)], names=names)

    met = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return met.select(*names)
