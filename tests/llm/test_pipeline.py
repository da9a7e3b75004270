"""Each stage of the pipeline against a plain version of what it shall do."""

import math
import random
import re
import weakref
import zlib
from collections import Counter
from types import SimpleNamespace

import brute
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as pipeline
from fathomline.llm import common, mixing, quality
from fathomline.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, FOLDER, "documents"), []
    for name, stage in pipeline.STAGES:
        docs = common.cut(stage(spark, docs, FOLDER))
        out.append((name, docs))
    return out


def test_names(stages):
    assert [n for n, _ in stages] == ["quality rules", "n-gram Jaccard join", "secret scans", "mixing sources", "packing"]
    for _, df in stages[:-1]:
        assert tuple(df.columns) == pipeline.COLUMNS


def test_quality(spark, stages):
    """The base rules by hand, and the classifier by its weights on Counters of slots."""
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    (by_word, by_gram), bias = quality.train(docs, labels)
    want = set()
    for r in docs.collect():
        w = brute.words(r["text"])
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        if len(w) < 50 or 100 * len(again) > 50 * len(w):
            continue
        raw = (r["text"] or "").translate(brute.UP).encode()
        grams = [(int.from_bytes(raw[i : i + 4], "little") * 2654435761 % 2**32) >> (32 - quality.BITS) for i in range(len(raw) - 3)]
        slots = [int(quality.mix(word_hash(x) + np.uint64(quality.WORD_SEED))[0] >> np.uint64(64 - quality.BITS)) for x in raw.split()]
        margin = sum(by_word[x] for x in slots) / len(slots) + sum(by_gram[x] for x in grams) / len(grams) + bias
        if 1 / (1 + math.exp(-margin)) >= quality.KEEP_FROM:
            want.add(r["doc_id"])
    kept = {r["doc_id"] for r in stages[0][1].collect()}
    assert kept == want and 0 < len(kept) < docs.count()
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert sum(good.get(d, 1) for d in kept) > 0.95 * len(kept)


def word_hash(word):
    return common.word_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))


def test_one_of_each_group(stages):
    before = [(r["doc_id"], r["text"]) for r in stages[0][1].collect()]
    want = {d for d, (_, c) in brute.near_components(before).items() if c == d}
    assert {r["doc_id"] for r in stages[1][1].collect()} == want and len(want) < len(before)


def test_secrets_redacted(stages):
    before, after = ({r["doc_id"]: r for r in stages[i][1].collect()} for i in (1, 2))
    assert set(before) == set(after)
    planted = re.compile(r'token = "([0-9a-f]{40})"')
    for d, r in after.items():
        assert r["n_chars"] == len(r["text"]) and not planted.search(r["text"])
        assert r["text"] == before[d]["text"] or "[SECRET]" in r["text"]


def test_planted_secrets_redacted(spark):
    rng = random.Random(1)
    tokens = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(30)]
    docs = spark.createDataFrame([(i, f'one two é token = "{t}" three', "en", "s", 0) for i, t in enumerate(tokens)] + [(99, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in pipeline.redact_secrets(spark, docs, FOLDER).collect()}
    assert all(out[i]["text"] == 'one two é token = "[SECRET]" three' and out[i]["n_chars"] == 34 for i in range(30)) and out[99]["text"] is None


def test_mix(stages):
    """Each source's whole documents in its seeded order, taken again and again until the target is reached."""
    docs = stages[2][1].collect()
    got = Counter(r["doc_id"] for r in stages[3][1].collect())
    size = {r["doc_id"]: len(brute.words(r["text"])) for r in docs}
    sources = sorted({r["source"] for r in docs}, key=lambda s: (s is None, (s or "").encode()))
    sums = [sum(size[r["doc_id"]] for r in docs if r["source"] == s) for s in sources]
    for s, goal in zip(sources, mixing.targets(sums, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sources))]), strict=True):
        own = [r["doc_id"] for r in docs if r["source"] == s]
        words = sum(got[d] * size[d] for d in own)
        assert abs(words - goal) <= max(size[d] for d in own)
        assert max(got[d] for d in own) - min(got[d] for d in own if size[d]) <= 1  # every document as often as the others


def test_packed(stages):
    from tokenizers import Tokenizer

    from fathomline.llm.subwords import default_tokenizer

    whole = Tokenizer.from_file(default_tokenizer())
    texts = [(r["doc_id"], r["text"]) for r in stages[3][1].collect()]
    want = Counter()
    for d, t in texts:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            piece = ids[at : at + 2048]
            want[d, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)] += 1
    rows = stages[4][1].collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_run(spark, stages):
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(pipeline.run(spark, FOLDER)) == key(stages[4][1])


def test_extra_columns(spark):
    docs = table(spark, FOLDER, "documents").selectExpr("*", "'x' AS target", "1 AS ranges", "2 AS sig")
    for _, stage in pipeline.STAGES[:4]:
        assert tuple(stage(spark, docs, FOLDER).columns) == pipeline.COLUMNS


def test_copies_with_one_id_or_none(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, text), (1, other), (2, other), (None, text), (None, "alone " + text[::-1]), (3, text), (3, text), (4, None), (5, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = pipeline.keep_one_of_near_copies(spark, docs, FOLDER)
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, text), (1, other), (None, "alone " + text[::-1]), (4, None), (5, "")])


def test_empty(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.count() == 0


def test_intermediate_folders_have_an_end(spark, monkeypatch):
    gone = []
    monkeypatch.setattr(pipeline, "remove_at_exit", lambda s, path: gone.append(path))
    monkeypatch.setattr(pipeline, "STAGES", [("all", lambda s, d, f: d)])
    assert pipeline.run(spark, FOLDER).count() == table(spark, FOLDER, "documents").count() and len(gone) == 1


def test_rows_keep_their_numbers(spark):
    docs = table(spark, FOLDER, "documents")
    assert common.from_files(docs.select("doc_id", "text").filter("doc_id > 3")) and not common.from_files(docs.repartition(3)) and not common.from_files(docs.distinct())
    for df in (docs, docs.repartition(3)):
        rows = common.numbered(df, ("doc_id", "text"))
        wide, narrow = (dict(x.collect()) for x in (rows.select("row", "record.text"), rows.select("row", "record.doc_id")))
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert len(wide) == len(texts) and all(wide[k] == texts[d] for k, d in narrow.items())


def test_the_driver_gives_back_what_training_took(monkeypatch):
    """Free memory returns to the system once the classifier's sample is gone, whatever the labels, before other stages."""
    table_of = lambda kinds: pa.table({"doc_id": range(20), "quality": kinds, "slots": [[i, 40] for i in range(20)], "shares": [[0.5, 0.5]] * 20})
    for kinds in ([0, 1] * 10, [1] * 20):
        made, done = [table_of(kinds)], []
        alive = weakref.ref(made[0])
        monkeypatch.setattr(quality, "sample", lambda *a, made=made: SimpleNamespace(toArrow=made.pop))
        monkeypatch.setattr(quality, "give_back", lambda alive=alive, done=done: done.append(alive() is None))
        found = quality.train(None, None)
        assert done == [True] and (found is None) == (len(set(kinds)) == 1)
