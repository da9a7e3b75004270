"""Near copies and repeated passages against brute force."""

import random

import brute
import pytest
from hypothesis import given, settings, strategies as st

from fathomline.llm import common, graph, jaccard, substring
from fathomline.sources.tables import table

import numpy as np
import pyarrow as pa


def corpus(seed: int, n: int = 120) -> list[tuple[int, str | None]]:
    """Texts with copies, near copies, shared passages, repeated words, nulls and blanks."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(1, 3)))
    passage, line = [word() + "é" for _ in range(70)], [word() for _ in range(12)]
    base = [word() for _ in range(160)]
    rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \t\n"), (3, "A b"), (4, "a B"), (5, " ".join(["x"] * 300)), (6, " ".join(["x"] * 130))]
    for i in range(7, n):
        kind = rng.randint(0, 6)
        if kind == 0:
            w = list(base)
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(len(w))] = word() + "q"
        elif kind == 1:
            w = [word() for _ in range(rng.randint(0, 40))] + passage[rng.randint(0, 25) :] + [word() for _ in range(rng.randint(0, 40))]
        elif kind == 2:
            w = line * rng.randint(3, 9) + [word()]
        elif kind == 3:
            w = list(base)
        else:
            w = line + [word() + word() for _ in range(rng.randint(0, 220))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, ranges string").repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed):
    rows = corpus(seed, 120 // seed)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(frame(spark, rows)).collect()}
    want = brute.repeats(rows)
    assert got == want and sum(w[1] for w in want.values()) > 0


def test_repeats_when_texts_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL_BYTES", 0)
    rows = corpus(3, 60)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute.repeats(rows)


def test_repeated_rows_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (2, "other " + text)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in substring.remove_repeats(df).collect())
    assert got == [(1, 0), (1, 0), (2, 60), (2, 60)]
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_standing_symbols_are_the_same_in_every_place():
    rng = np.random.default_rng(5)
    passage = rng.integers(1, 50, 120).astype(np.uint64)
    found = []
    for _ in range(6):
        left, right = (rng.integers(1, 50, rng.integers(0, 80)).astype(np.uint64) for _ in range(2))
        w = common.mix(np.concatenate([left, passage, right]))
        name, low, high, _ = substring.standing(w, np.array([0, len(w)]), 50)
        stood = {}
        for x, a, b in zip(name.tolist(), low.tolist(), high.tolist(), strict=True):
            for at in range(a, b + 1):
                stood.setdefault(at, set()).add(x)
        found.append([stood[len(left) + i] for i in range(71)])
    for other in found[1:]:
        assert all(a & b for a, b in zip(found[0], other, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    monkeypatch.setattr(jaccard, "SMALL_GROUP", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "SPOKES", 2)
    rows = corpus(seed, 120 // seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(frame(spark, rows)).collect()}
    want = brute.near_components(rows)
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_near_copies_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL_BYTES", 0)
    rows = corpus(4, 60)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(frame(spark, rows)).collect()}
    assert got == brute.near_components(rows)


def test_near_copies_of_nothing(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.components(df).collect())) == [(3, 0, 3), (5, 2, 5), (5, 2, 5)]
    assert jaccard.components(df.limit(0)).count() == 0


def test_fixture_tables(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r[0]: tuple(r)[1:] for r in jaccard.components(docs).collect()} == brute.near_components(rows)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(docs, texts=False).collect()}
    assert got == brute.repeats(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=0, max_size=30), min_size=2, max_size=8), st.integers(0, 2**32))
def test_prefixes_meet(texts, seed):
    """Any two sets of similarity 0.8 share an index key, whichever tokens count as frequent."""
    rng = random.Random(seed)  # and near copies of longer texts, around a size where groups double
    base = [str(rng.randrange(10**9)) for _ in range(rng.choice([36, 68, 132, 260]))]
    for _ in range(4):
        spots = rng.sample(range(len(base)), rng.randint(0, 1 + len(base) // 40))
        texts = [*texts, [f"x{rng.random()}" if i in spots else w for i, w in enumerate(base[: len(base) - rng.randint(0, 4)])]]
    column = pa.array([" ".join(t) for t in texts])
    data, offsets = common.texts(column)
    token, first = jaccard.shingles(data, offsets)
    for frequent in (np.zeros(0, np.uint64), np.unique(token)[::2], np.unique(token)):
        key, text = jaccard.keys_of(token, first, frequent, 80)
        keys = [set(key[text == i].tolist()) for i in range(len(texts))]
        sets = [set(token[first[i] : first[i + 1]].tolist()) for i in range(len(texts))]
        for i in range(len(texts)):
            for j in range(i):
                if len(sets[i]) > 1 and sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    assert keys[i] & keys[j]


def test_connected(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, 101), (101, 102), (7, 7)]
    got = dict(graph.connected(spark.createDataFrame(edges, "u long, v long")).collect())
    assert all(got[i] == 0 for i in range(31)) and got[102] == 100 and got[101] == 100


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_that_collide_in_polynomials_are_told_apart(spark):
    """A 1024-letter Thue-Morse word and its complement have equal polynomials modulo 2**64, whatever the base."""
    one = thue_morse(1024)
    two = one.translate({97: 98, 98: 97})
    rest = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, " ".join([one] * 60)), (4, " ".join([two] * 60)), (5, f"{one[:32]} {one[:33]} {rest}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in jaccard.components(df).collect()} == brute.near_components(rows)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(df).collect()}
    assert got == brute.repeats(rows) and got[4][1] == 0


def test_word_hashes_and_spans():
    rng = random.Random(3)
    plain = ["".join(rng.choices("ab", k=rng.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200]))) for _ in range(4000)]
    raw = np.frombuffer(" ".join(plain).encode(), np.uint8)
    starts, ends, _ = common.words(raw, np.array([0, len(raw)]))
    hashes = common.word_hashes(raw, starts, ends)
    assert len(set(hashes.tolist())) == len(set(plain))
    assert len({(w, h) for w, h in zip(plain, hashes.tolist(), strict=True)}) == len(set(plain))
    values = np.array([1, 2, 1, 2, 1, 2, 0, 0, 0], np.uint64)
    h = common.spans_hash(values, np.array([0, 2, 0, 6, 6, 6]), np.array([2, 4, 4, 7, 8, 6]))
    assert h[0] == h[1] and len(set(h.tolist())) == 5
    text, begin, end = common.joined(raw, starts, ends)
    assert text.decode() == " ".join(plain) and [text[a:b].decode() for a, b in zip(begin, end, strict=True)] == plain


def test_planted_collisions_of_names_are_told_apart(spark, monkeypatch):
    """Names of stretches and short names of sets fall together; results stay those of brute force."""
    standing, signatures = substring.standing, jaccard.signatures
    monkeypatch.setattr(substring, "standing", lambda *x: (standing(*x)[0] % np.uint64(3), *standing(*x)[1:]))
    monkeypatch.setattr(jaccard, "signatures", lambda *x: (signatures(*x)[0] % np.uint64(5) << np.uint64(8) | np.uint64(256), signatures(*x)[1]))
    from pyspark import cloudpickle

    from fathomline.llm import common as shared

    for module in (substring, jaccard, shared):
        cloudpickle.register_pickle_by_value(module)
    try:
        rows = corpus(6, 60)
        df = frame(spark, rows)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(df).collect()}
        assert got == brute.repeats(rows)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(df).collect()}
        assert got == brute.near_components(rows)
    finally:
        for module in (substring, jaccard, shared):
            cloudpickle.unregister_pickle_by_value(module)


def test_long_texts_and_clashing_columns(spark):
    rng = random.Random(8)
    long = " ".join(f"{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " tail"), (3, "x" * 400_000), (4, "x" * 400_000 + " y"), (5, None)]
    names = "doc_id long, text string, tag string, one int, two int, name string, sig string, n int, key string, rows_of_key int, place int"
    df = spark.createDataFrame([(d, t, "t", 1, 2, "n", "s", 3, "k", 4, 5) for d, t in rows], names)
    assert {r["doc_id"]: tuple(r)[1:] for r in jaccard.components(df).collect()} == brute.near_components(rows)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(df).collect()}
    assert got == brute.repeats(rows)
    with pytest.raises(ValueError):
        substring.remove_repeats(df, 300)


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 0.01)
    rows = corpus(9, 60) + [(1000 + i, corpus(9, 60)[-1][1]) for i in range(40)]
    df = frame(spark, rows)
    assert {r["doc_id"]: tuple(r)[1:] for r in jaccard.components(df).collect()} == brute.near_components(rows)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(df).collect()}
    assert got == brute.repeats(rows)


def test_free_memory_goes_back_at_the_end_of_a_task(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(True))
    steps = common.frugal(lambda batches: (2 * x for x in batches))
    assert list(steps(iter([1, 2]))) == [2, 4] and len(given) == 1
    early = steps(iter([1, 2]))
    next(early)
    early.close()
    assert len(given) == 2
