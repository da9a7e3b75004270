"""The other operators against plain versions, round trips and held-out accuracy."""

import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fathomline.llm import attention, forest, lm, mixing, packing, quality, queries, secrets, shards, subwords, topk, urls
from fathomline.sources.tables import table

ODD = [(1, None, "a"), (2, "", None), (3, "One two\tthree\nfour five six", "b"), (4, "é 中文 " * 40, "a"), (4, "é 中文 " * 40, "a"), (5, "word " * 30000, "b"), (6, "x", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, s, "n", 1) for d, t, s in ODD], "doc_id long, text string, source string, target string, size long")


# mixing


def test_targets():
    got = mixing.targets([100, 10, 50], [5.0, 2.0, 1.0])
    assert got[1] == 30 and sum(got) == pytest.approx(160)
    assert got[0] == pytest.approx(130 * 5 / 6)
    assert mixing.targets([0, 0], [1.0, 1.0]) == [0.0, 0.0]
    assert mixing.targets([], []) == []


def test_mix(spark, sf):
    docs = table(spark, sf, "documents")
    rows = queries.op2_mixing(spark, sf).collect()
    texts = {r["doc_id"]: r for r in docs.collect()}
    assert len(rows) == len(texts)
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert r["size"] == len(brute.words(texts[r["doc_id"]]["text"])) and 0 <= r["taken"] <= 3 * r["size"]
        one = by[texts[r["doc_id"]]["source"]]
        one[0] += r["size"]
        one[1] += r["taken"]
        one[2] = r["target"]
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    want = mixing.targets([by[s][0] for s in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))])
    for s, t in zip(names, want, strict=True):
        assert by[s][2] == pytest.approx(t) and abs(by[s][1] - t) < 1.01
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op2_mixing(spark, sf).collect()))


def test_mix_odd(odd):
    rows = mixing.mix(odd.drop("size", "target")).collect()
    assert len(rows) == len(ODD) and {r["doc_id"] for r in rows if r["size"] == 0} == {1, 2}
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(odd.drop("size", "target").limit(0)).count() == 0


def test_curriculum(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    plan = {"a": [(0.0, 1.0), (1.0, 0.0)], "b": [(0.0, 0.0), (1.0, 1.0)]}
    mixed = mixing.mix(docs, lambda i, s: plan[s], boundary="round")
    at = {s: np.mean([p for r in mixed.filter(F.col("source") == s).collect() for p in r["positions"]]) for s in "ab"}
    assert at["a"] < 0.4 < 0.6 < at["b"]  # means of the shares 1 - t and t are 1/3 and 2/3
    out = mixing.stream(docs, schedule=lambda i, s: plan[s], boundary="round")
    first = {s: i for i, s in reversed(list(enumerate(r["source"] for r in out.collect())))}
    assert first["a"] == 0
    assert out.count() == mixed.agg(F.sum("copies")).first()[0] and out.columns == docs.columns


def plain_targets(sizes, weights, cap=3.0):
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        mass = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / mass > cap * sizes[i]]
        for i in over or free:
            out[i] = cap * sizes[i] if over else left * weights[i] / mass
        if not over:
            break
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=12))
def test_targets_and_curriculum(sizes):
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    assert mixing.targets(sizes, weights) == pytest.approx(plain_targets(sizes, weights))
    if sizes:
        times, area = mixing.demand(mixing.curriculum(len(sizes)))
        assert area[:, -1] == pytest.approx(np.array(weights) / sum(weights))
        assert (np.diff(area, axis=1) > 0).all() and (len(sizes) < 2 or area[0, 32] > 0.5 * area[0, 64] and area[-1, 32] < 0.5 * area[-1, 64])


def test_mix_is_sorted_by_training_position(spark, sf):
    rows = queries.op2_mixing(spark, sf).collect()
    first = [r["positions"][0] if r["positions"] else 2.0 for r in rows]
    assert first == sorted(first) and min(first) < 0.01 and all(len(r["positions"]) == r["copies"] for r in rows)
    source = {r["doc_id"]: r["source"] for r in table(spark, sf, "documents").collect()}
    names = sorted(set(source.values()))
    words = defaultdict(lambda: [0, 0])
    for r in rows:
        for p in r["positions"]:
            words[source[r["doc_id"]] in names[: len(names) - len(names) // 2]][p > 0.5] += r["size"]
    assert words[True][0] > words[True][1] and words[False][0] < words[False][1]  # the curriculum moves on


def test_stream_keeps_rows_apart_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 0.5), (1, "c d", "x", 0.5), (None, "e f", "x", 0.5), (None, "e f", "x", 0.5)], "doc_id long, text string, source string, at double")
    out = mixing.stream(docs, boundary="round")
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, docs.collect())) and out.columns == docs.columns


# sharding


def test_shards(spark, sf, odd, tmp_path):
    for df in (table(spark, sf, "documents"), odd):
        rows = shards.assign(df, bucket_rows=40).collect()
        assert len(rows) == df.count()
        per = defaultdict(list)
        for r in rows:
            per[r["shard"]].append(r["slot"])
        counts = [len(per[s]) for s in range(16)] if len(rows) >= 16 else [len(v) for v in per.values()]
        assert max(counts) - min(counts) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in per.values())
        assert sorted(map(tuple, rows)) == sorted(map(tuple, shards.assign(df.repartition(3), bucket_rows=40).collect()))
    texts = {(d, t) for d, t, _ in ODD}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in shards.assign(odd).collect()} == {(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts}
    assert shards.assign(odd.limit(0)).count() == 0
    docs = table(spark, sf, "documents")
    shards.write(docs, str(tmp_path / "s"), bucket_rows=50)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.select(shards.SHARD).distinct().count() == 16


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(shards.fisher_yates(3, 1, b)) for b in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400


# URL rules


def judged(url, rules=urls.RULES, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end].translate(brute.UP), rest[end:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = [None, "", "nothing", "http://", "http://COM/", "https://www.Example.com/en/1?x#y", "http://example.com/en", "http://a.example.com/en/", "http://xexample.com/en/", "http://com", "ftp://a.net/fr/x", "http://net/es/", "http://b.net?/fr/", "http://a..com/", "http://.com/x", "http://com./x", "http://a.com\U0001f600/x", "x://y://z.com/q", "http://😀.net/es/1", "http://user@www.example.com:80/en/"]


def test_urls(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit(3)).withColumn("key", F.lit("k"))
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(df, parts=3).collect()}
    assert got == {i: judged(u) for i, u in enumerate(URLS)}
    assert urls.judge(df.limit(0)).count() == 0


def test_nested_rules(spark):
    rng = random.Random(4)
    host = lambda: ".".join(rng.choice(["a", "b", "ab", "c"]) for _ in range(rng.randint(1, 4)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(), rng.choice(["/", "/x", "/x/y", ""])) for _ in range(60))}.values())
    asked = [f"http://{host()}{rng.choice(['', '/', '/x', '/x/y/z'])}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    table_ = spark.createDataFrame(rules + rules[:5], "verdict string, host string, path string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(df, table_, default="block", parts=4).collect()}
    assert got == {i: judged(u, rules, "block") for i, u in enumerate(asked)}


# packing


def test_subwords_match_whole_texts():
    from tokenizers import Tokenizer

    path = subwords.default_tokenizer()
    whole, ours = Tokenizer.from_file(path), subwords.Subwords(path)
    texts = ["Hello  World's\n\tday", "<|endoftext|>x<|startoftext|>", "é\x85 ½x²\u2003y", "\x1c\x1d a\x1fb", "한국어 ﷽", "", "   "]
    got = ours.ids_of([t.encode() for t in texts])
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids and ours.ids(t.encode()) == g


def check_packing(rows, ids, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for d, parts in by_doc.items():
        seen = Counter()
        for r in parts:
            piece = ids[d][r["start"] : r["start"] + r["length"]]
            assert r["doc_tokens"] == len(ids[d]) and zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
            seen[(r["start"], r["length"])] += 1
        assert len(set(seen.values())) == 1
        assert sum(n for _, n in seen) == len(ids[d])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return len(by_sequence)


def whole_ids(rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(subwords.default_tokenizer())
    return {r["doc_id"]: [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in rows}


def test_packing(spark, sf, odd):
    for df in (table(spark, sf, "documents"), odd):
        ids = whole_ids(df.collect())
        rows = packing.pack(df).collect()
        assert {r["doc_id"] for r in rows} == set(ids)
        n = check_packing(rows, ids, 2048)
        assert sum(r["length"] for r in rows) > 0.97 * 2048 * (n - 1)
    assert packing.pack(odd.limit(0)).count() == 0


def test_sequences(spark, sf):
    docs = table(spark, sf, "documents").limit(40)
    ids = whole_ids(docs.collect())
    packed = packing.pack(docs, window=128, keep_ids=True)
    rows = packing.sequences(packed, window=128).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        n = len(r["ids"]) // 4
        assert n == (r["length"] if bin(r["length"]).count("1") == 1 else 128)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=8))
def test_fill_is_the_closest(counts):
    window = 40
    chosen = packing.fill(counts, window)
    longest = max(counts)
    assert chosen[longest] >= 1 and all(chosen[k] <= counts[k] for k in chosen)
    sums = {longest}
    for k, n in counts.items():
        for _ in range(n - (k == longest)):
            sums |= {s + k for s in sums if s + k <= window}
    assert sum(k * n for k, n in chosen.items()) == max(sums)
    rows = packing.patterns(counts, window)
    placed = Counter()
    for length, _, each, times, _, _ in rows.tolist():
        placed[length] += each * times
    assert placed == Counter(counts)


# quality


def plain_counts(text):
    w = brute.words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def test_quality_counts(spark, sf, odd):
    for df in (table(spark, sf, "documents"), odd):
        got = Counter((r["doc_id"], *tuple(r)[1:6], r["base_failed"]) for r in quality.judge(df).collect())
        want = Counter()
        for r in df.collect():
            c = plain_counts(r["text"])
            want[(r["doc_id"], *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
        assert got == want
    assert quality.judge(odd.limit(0)).count() == 0


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.train(docs, labels.filter("doc_id % 3 <> 0"))
    rows = quality.judge(docs, model=model).join(labels.filter("doc_id % 3 = 0"), "doc_id").filter("NOT base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and len(good) > 50
    assert not bad or np.mean(bad) < 0.5
    kept = quality.judge(docs, model=model, carry=True)
    assert kept.schema == docs.schema and kept.count() == quality.judge(docs, model=model).filter("kept").count()


# search


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.choice([0.01, 1, 5])]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(30)] + [(500, None), (550, [1.0, None] + [0.0] * 6), (600, [float("nan")] * 8), (650, [0.0] * 8), (700, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = topk.quantise(df)
    got = defaultdict(list)
    for r in topk.search(vectors.filter("vec_id % 50 = 0"), vectors).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    sound = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    for q in (i for i in sound if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(sound[q], sound[i], strict=True)), i) for i in sound if i != q)[:5]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert set(got) == {i for i in sound if i % 50 == 0}


def test_topk_over_many_buckets(spark, monkeypatch):
    """Global buckets by length, equal lengths dealt apart, queries sent only where their scores may be beaten."""
    monkeypatch.setattr(topk, "VECTORS_A_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES_A_BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [float(round(x)) for x in rng.normal(size=4) * 20 * 1.02**-i]) for i in range(300)]
    rows += [(300 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(150)] + [(500 + i, [float(i % 3), 2.0]) for i in range(60)] + [(600, [0.0] * 4), (602, [-90.0, 0.0, 0.0, 0.0]), (604, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumn("size", F.lit("x")).withColumn("bucket", F.lit(3))
    got = defaultdict(list)
    for r in topk.search(df.filter("vec_id % 7 = 0 OR vec_id > 599"), df, k=4).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q, x in rows:
        if q % 7 == 0 or q > 599:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q and len(x) == len(y))[:4]
            assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)], q
    assert topk.search(df.limit(0), df).count() == 0 and topk.search(df, df.limit(0)).count() == 0


def test_topk_large_values(spark):
    df = spark.createDataFrame([(0, [1e15, -3.0]), (1, [1e15, 1.0]), (2, [1e15, 2.0])], "vec_id long, vector array<double>")
    got = [(r["vec_id"], r["rank"]) for r in topk.search(df.filter("vec_id = 0"), df).collect()]
    assert sorted(got) == [(1, 1), (2, 2)]


def test_topk_sql(spark, sf):
    from compare import connect, differences

    for name, sql in queries.SQL.items():
        ours, theirs = differences(queries.QUERIES[name](spark, sf), connect(sf), sql)
        assert not ours and not theirs, (name, list(ours)[:2], list(theirs)[:2])


# secrets


def test_forest_on_held_out_findings():
    rows = secrets.labelled_findings(1200, seed=11)
    model = secrets.train(rows[:800])
    x = np.array([secrets.traits(t[a:b], t[max(0, a - 80) : a], t[b : b + 40]) for t, a, b, _ in rows[800:]])
    y = np.array([s for *_, s in rows[800:]])
    assert ((forest.predict(model, x) >= 0.5) == y).mean() > 0.93


def test_secrets(spark):
    texts = [None, "", 'the token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" is', "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff fixed it", "é password=9f8a7b6c5d4e3f2a1b0c9d8e, é", "card 4785380592391139 and mail that.92@mail2.example.com", "see /usr/lib/python3/config2.txt"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, findings int")
    rows = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    assert [len(rows[i]["findings"]) for i in range(7)] == [0, 0, 1, 0, 1, 0, 0]
    f = rows[2]["findings"][0]
    assert texts[2][f["start"] : f["end"]] == "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and rows[2]["redacted"] == 'the token = "[SECRET]" is'
    f = rows[4]["findings"][0]
    assert texts[4][f["start"] : f["end"]] == "9f8a7b6c5d4e3f2a1b0c9d8e"
    carried = {r["doc_id"]: r["text"] for r in secrets.scan(df, carry=True).collect()}
    assert carried[0] is None and carried[2] == rows[2]["redacted"]
    assert secrets.scan(df.limit(0)).count() == 0
    assert queries.secrets.digest(secrets.scan(df)).count() == 7


# scores


def test_scores(spark, odd):
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    rows = queries.op4_lm_scoring(spark, folder).collect()
    texts = {r["doc_id"]: [w.translate(brute.UP) for w in brute.words(r["text"])] + [None] for r in docs.collect()}
    held = {d for d in texts if zlib.crc32(str(d).encode()) % 7 == 2}
    count = Counter(w for d, t in texts.items() if d not in held for w in t)
    n, v = sum(count.values()), len(count)
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["held_out"] == (r["doc_id"] in held) and r["train_tokens"] == n and r["n_tokens"] == len(t)
        assert r["n_known"] == sum(count[w] > 0 for w in t)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] < 0 and math.isfinite(r["score"])
    got = {r["doc_id"]: r for r in lm.score(odd, F.col("doc_id") == 3).collect()}
    assert got[1]["n_tokens"] == 1 and got[2]["n_tokens"] == 1 and len(got) == 6
    assert lm.score(odd, F.lit(True)).filter("n_known = 0 AND train_tokens = 0").count() == len(ODD)
    assert lm.score(odd.limit(0), F.lit(False)).count() == 0


def test_windows_score_each_place_once_as_whole_texts_would():
    rng = np.random.default_rng(0)
    w = attention.initial(context=40, kinds=50)
    class_of = rng.integers(0, attention.CLASSES, 50)
    size = np.array([0, 5, 33, 1, 17])
    flat = rng.integers(0, 50, size.sum())
    got = attention.log_probabilities(w, flat, size, class_of, context=40, stride=8)
    assert len(got) == len(flat)
    at = 0
    for n in size.tolist():
        text = flat[at : at + n]
        for i in range(n):
            lo = i - i % 8 + 8 - 40
            row = np.array([[text[j - 1] if j > 0 and j - 1 < n else 50 for j in range(lo, lo + 40)]])
            logits = attention.forward(w, row, 8)[0][0, i % 8].astype(float)
            assert got[at + i] == pytest.approx(logits[class_of[text[i]]] - np.log(np.exp(logits).sum()), abs=1e-3)
        at += n


def test_attention_gradient_and_learning():
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in attention.initial(classes=6, width=4, context=5, kinds=6).items()}
    x, y = rng.integers(0, 7, (3, 5)), rng.integers(0, 6, (3, 5))
    _, grad = attention.step(w, x, y)
    for name in w:
        at = tuple(rng.integers(0, s) for s in w[name].shape)
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert grad[name][at] == pytest.approx((attention.step(up, x, y)[0] - attention.step(down, x, y)[0]) / 2e-5, rel=1e-2, abs=1e-6)
    windows, target = attention.windows_of(np.arange(300) % 6, np.array([300]), 8, 8, 6)
    learned, n = attention.train(attention.initial(classes=6, context=8, kinds=6), [(windows, target)], 0.02, steps=200)
    assert n == len(windows) and attention.step(learned, windows[1:-1], target[1:-1])[0] < 0.5 < math.log(6)
    x, y = windows[1:2], np.full((1, 8), -1)
    assert attention.step(learned, x, y)[0] == 0  # places without a target teach nothing
    assert all(np.allclose(attention.unpacked(attention.packed(w), w)[k], w[k], atol=1e-6) for k in w)


def prepared(docs, held):
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out"))


def fitted(docs):
    from fathomline.llm.common import cut

    path = subwords.default_tokenizer()
    counts = cut(lm.tokenised(lm.count_words(docs).groupBy("key").agg(F.first("word").alias("word"), F.sum("n").alias("n")), path))
    return lm.learn(docs.filter(~F.col("held_out")), counts, path)


def test_scores_against_a_plain_version(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(lm, "STEPS", 30)
    rng = random.Random(2)
    vocabulary = ["the", "of", "Über", "don't", "quixotic", "42", "\x85", "a1b2", "naïveté", "\u2003", "x" * 90]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(40)] + [(40, None), (41, "unseen wordforms only"), (42, "the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") % 5 == 1
    m = fitted(prepared(docs, held))
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, held, model=m).collect()}

    whole, size = Tokenizer.from_file(subwords.default_tokenizer()), m["size"]

    def symbols(word):
        if word is None:
            return [2 * size + 1]
        ids = whole.encode(word, add_special_tokens=False).ids or [size + 1]
        return [2 * i for i in ids[:-1]] + [2 * ids[-1] + 1]

    split = {d: [*((w.translate(brute.UP)) for w in brute.words(t)), None] for d, t in rows}
    count = Counter(w for d, t in split.items() if d % 5 != 1 for w in t)
    total = np.ones(2 * size + 4)
    for w, n in count.items():
        for x in symbols(w):
            total[x] += n
    kind = m["kind"].astype(int)
    share = total / np.bincount(kind, total, attention.CLASSES)[kind]
    words, once = Counter(), Counter()
    for w, n in count.items():
        words[kind[symbols(w)[0]]] += n
        once[kind[symbols(w)[0]]] += n == 1
    for d, text in split.items():
        kinds = [int(m["fine"][x]) for w in text for x in symbols(w)]
        start, at, want = len(m["class_of"]), 0, 0.0
        for w in text:
            parts = []
            for x in symbols(w):
                lo = at - at % attention.STRIDE + attention.STRIDE - attention.CONTEXT
                row = [[kinds[j - 1] if 0 < j <= len(kinds) else start for j in range(lo, lo + attention.CONTEXT)]]
                logits = attention.forward(m["weights"], np.array(row), attention.STRIDE)[0][0, at % attention.STRIDE].astype(float)
                p = np.exp(logits - logits.max())
                parts.append((p / p.sum())[kind[x]])
                at += 1
            c = kind[symbols(w)[0]]
            recall = (words[c] - once[c] + 0.5) / (words[c] + 1) if words[c] else 0.0
            spelled = math.prod(parts[1:]) * math.prod(share[x] for x in symbols(w))
            want += math.log10(parts[0] * (recall * count[w] / max(words[c], 1) + (1 - recall) * spelled))
        assert got[d] == pytest.approx(want, rel=1e-4), d
    sums = np.bincount(kind, np.exp(m["inner"]), attention.CLASSES)
    assert np.allclose(sums[np.unique(kind)], 1) and (m["recall"] < 1).all()


def test_training_windows_grow_with_the_corpus_and_reach_the_ends_of_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 1)
    early, late = (" ".join(f"{p}{i % 50}" for i in range(30000)) for p in ("m", "zq"))
    docs = spark.createDataFrame([(i, f"{early} {late}") for i in range(3)], "doc_id long, text string")
    m = fitted(prepared(docs, F.lit(False)))
    shared = spark.sparkContext.broadcast(m)
    drawn = [lm.draw_windows(df, shared, subwords.default_tokenizer()) for df in (docs.limit(1), docs)]
    one, three = (df.count() for df in drawn)
    assert three == 3 * one > 60000 / lm.DRAW / lm.RUN
    kinds = set(np.frombuffer(b"".join(r["inputs"] for r in drawn[0].collect()), "<u2").tolist())
    ids = subwords.Subwords.of(subwords.default_tokenizer()).ids(b"zq")
    assert int(m["fine"][2 * int(np.frombuffer(ids, "<u4")[0])]) in kinds


def test_rows_without_an_id(spark):
    from fathomline.llm import jaccard, substring

    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(None, text, None), (None, None, None), (1, text, "a"), (2, text + " x", None)], "doc_id long, text string, source string")
    got = Counter((r["doc_id"], r["n_removed"]) for r in substring.remove_repeats(df).collect())
    assert got == Counter([(None, 0), (None, 0), (1, 0), (2, 80)])
    rows = jaccard.components(df).collect()
    assert len(rows) == 4 and {r["component_id"] for r in rows if r["doc_id"]} == {1}
    mixed = mixing.mix(df, boundary="round")
    assert mixed.count() == 4 and mixing.stream(df, boundary="round").count() == mixed.agg(F.sum("copies")).first()[0]
    for count in (packing.pack(df).filter("start = 0").count(), shards.assign(df).count(), quality.judge(df).count(), secrets.scan(df).count(), lm.score(df, F.col("doc_id") == 2).count(), urls.judge(df.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"))).count()):
        assert count == 4
    vectors = spark.createDataFrame([(None, [1.0]), (0, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    assert topk.search(topk.quantise(vectors), topk.quantise(vectors)).count() == 2


def test_secrets_with_few_digits_or_characters_are_judged(spark):
    rng = random.Random(5)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    letters = [c for c in alnum if not c.isdigit()]
    draw = lambda k, a: "".join(rng.choices(a, k=k))
    texts = [f'the password = "{draw(16, letters)}" here' for _ in range(20)] + [f"AKIA{draw(16, alnum[:26])} is the access key" for _ in range(20)]
    texts += [f"api_key: ghp_{draw(32, letters)} here" for _ in range(20)] + [f'password="{draw(9, alnum)}" here' for _ in range(20)]
    plain = ["the password policy changed yesterday", "their secret recommendation was straightforward", "internationalisation of the token economy"]
    df = spark.createDataFrame(list(enumerate(texts + plain)), "doc_id long, text string")
    got = {r["doc_id"]: len(r["findings"]) for r in secrets.scan(df).collect()}
    judged = ['password = "correcthorsebattery"', "password=hunter2", "api_key: Zq8!xkP0$vR2#mN7"]
    found = secrets.scan(spark.createDataFrame(list(enumerate(judged)), "doc_id long, text string")).collect()
    assert all(r["n_candidates"] == 1 and len(r["findings"]) == 1 for r in found)
    for k in range(0, 80, 20):
        assert sum(got[i] > 0 for i in range(k, k + 20)) >= 18, (k, got)
    assert all(got[80 + i] == 0 for i in range(len(plain)))
    assert any(s and sum(c in b"0123456789" for c in t[a:b]) < 2 for t, a, b, s in secrets.labelled_findings())
    assert any(s and b - a < 12 for t, a, b, s in secrets.labelled_findings())
    assert secrets.traits(b"abcdEF12", b"", b" is the password") != secrets.traits(b"abcdEF12", b"", b" is the colour")


def test_shards_hold_every_row_once_without_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a", 1), (None, None, 2), (5, "b", 3), (5, "c", 4), (5, "c", 5)], "doc_id long, text string, extra int")
    shards.write(docs, str(tmp_path / "s"), shards=2)
    back = spark.read.parquet(str(tmp_path / "s")).select(*docs.columns)
    assert Counter(map(tuple, back.collect())) == Counter(map(tuple, docs.collect()))


def test_alike_records_spread_over_buckets(spark):
    docs = spark.createDataFrame([(None, "same", 1)] * 900 + [(i, f"t{i}", 2) for i in range(100)], "doc_id long, text string, bucket int").repartition(4)
    rows = shards.shuffled(docs, bucket_rows=100).collect()
    assert max(Counter(r["bucket"] for r in rows).values()) < 200
    placed = shards.assign(docs, bucket_rows=100).collect()
    per = defaultdict(list)
    for r in placed:
        per[r["shard"]].append(r["slot"])
    assert {len(v) for v in per.values()} <= {62, 63} and all(sorted(v) == list(range(len(v))) for v in per.values())


def test_long_texts_make_smaller_buckets(spark):
    docs = spark.createDataFrame([(i, "x " * 100_000, "c", 1) for i in range(12)], "doc_id long, text string, shard string, slot int")
    rows = shards.shuffled(docs, bucket_bytes=400_000).collect()
    assert len({r["bucket"] for r in rows}) > 2 and shards.assign(docs, bucket_bytes=400_000).count() == 12


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(3)
    long = " ".join(f"{rng.randrange(10**5):05d}w" for _ in range(60_000))
    texts = [long + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', "y" * 300_000, None, "short"]
    names = "doc_id long, text string, source string, target string, taken int, positions int, bucket int, record string, block int, kept int, held_out int, length int, findings int, row int"
    df = spark.createDataFrame([(i, t, "s", *["x" if k == 3 else "r" if k == 7 else k for k in range(3, 14)]) for i, t in enumerate(texts)], names)
    scanned = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    assert len(scanned[0]["findings"]) == 1 and scanned[0]["findings"][0]["start"] == len(long) + 10 and "24be" not in scanned[0]["redacted"]
    assert {r["doc_id"]: r["size"] for r in mixing.mix(df).collect()} == {0: 60_004, 1: 1, 2: 0, 3: 1}
    assert mixing.stream(df, boundary="round").columns == df.columns
    ids = whole_ids(df.collect())
    check_packing(packing.pack(df).collect(), ids, 2048)
    judged = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert tuple(judged[0])[1:6] == plain_counts(texts[0]) and judged[1]["base_failed"]
    placed = shards.assign(df).collect()
    assert {(r["doc_id"], r["size"]) for r in placed} == {(i, len((t or "").encode()) + 1) for i, t in enumerate(texts)}
    scored = {r["doc_id"]: r for r in lm.score(df, F.col("doc_id") == 3).collect()}
    assert scored[0]["n_tokens"] == 60_005 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in scored.values())
    far = "http://example.com/en/" + "a" * 300_000
    pages = spark.createDataFrame([(1, far, "h", "p"), (1, far, "h", "p"), (None, None, "h", "p")], "page_id long, url string, host string, part string")
    assert Counter(tuple(r)[0:1] + tuple(r)[3:] for r in urls.judge(pages).collect()) == Counter([(1, "example.com/en/", "block")] * 2 + [(None, None, "allow")])
    wide = spark.createDataFrame([(i, [float(i + k) for k in range(5000)], 1) for i in range(4)], "vec_id long, embedding array<double>, rank int")
    assert topk.search(topk.quantise(wide).filter("vec_id = 0"), topk.quantise(wide)).count() == 3


def test_quality_with_few_labels(spark):
    """No switch by the number of labels: two kinds of labels fit a classifier, one kind leaves the rules alone."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    bad, good = (labels.filter(f"quality = {k}").orderBy("doc_id").limit(9) for k in (0, 1))
    assert quality.train(docs, bad.unionByName(good)) is not None and quality.train(docs, good) is None
    one = bad.limit(1).unionByName(good.limit(1))
    assert quality.train(docs, one) is not None
    assert quality.train(docs, labels.limit(0)) is None


def test_secrets_in_documents(spark):
    """On the documents: every planted token is found, and hardly anything else is."""
    import re

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    planted = re.compile(r'token = "([0-9a-f]{40})"')
    others = hits = 0
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in secrets.scan(docs).collect():
        want = {m.span(1) for m in planted.finditer(texts[r["doc_id"]])}
        got = {(f["start"], f["end"]) for f in r["findings"]}
        assert want <= got
        hits += len(want)
        others += len(got - want)
    assert hits > 10 and others <= 0.002 * len(texts)


def plain_candidates(text):
    """Spans, in bytes, that the scan must judge, by patterns alone."""
    import re

    near = [m.span() for m in secrets.FOR.finditer(text)]
    given, last = [], 0
    for m in secrets.GIVEN.finditer(text) if near else ():
        a, b = m.span(m.lastindex)
        if m.lastindex == 3:
            while b > a and text[b - 1] in b".,;:!?)]}>":
                b -= 1
        if last <= a < b:
            given.append((a, b))
            last = b
    out = list(given)
    for m in re.finditer(rb"[A-Za-z0-9+/_.\-]+", text):
        a, b = m.span()
        run, n = m.group(), b - a
        mixed = re.search(rb"[0-9]", run) and re.search(rb"[A-Za-z]", run)
        close = any(a - secrets.NEAR <= x and y <= a or b <= x and y <= b + secrets.NEAR for x, y in near)
        if (n >= 12 or mixed and n >= 6 or n >= 4 and close) and not any(x < b and y > a for x, y in given):
            out.append((a, b))
    return sorted(out)


def walk(tree, row):
    at = 0
    while tree["feature"][at] >= 0:
        at = tree["left"][at] if row[tree["feature"][at]] <= tree["cut"][at] else tree["right"][at]
    return tree["share"][at]


def test_secrets_against_a_plain_version(spark):
    rng = random.Random(12)
    texts = [t.decode() for t, *_ in secrets.labelled_findings(120, seed=5)]
    texts = [" ".join(rng.sample(texts, 3)) + rng.choice(["", " é password: 'ü?x9'.", ' token="', " pwd=(abc)."]) for _ in range(60)] + ["", None, "pass", "word=x1"]
    model = secrets.train()
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        spans = plain_candidates(raw)
        assert got[i]["n_candidates"] == len(spans), (i, t)
        want, redacted, at = [], [], 0
        for a, b in spans:
            row = secrets.traits(raw[a:b], raw[max(0, a - 2 * secrets.NEAR) : a], raw[b : b + secrets.NEAR])
            score = sum(walk(tree, row) for tree in model) / len(model)
            if score >= secrets.SECRET_FROM - 1e-12:
                want.append((len(raw[:a].decode()), len(raw[:b].decode())))
                redacted += [raw[at:a], b"[SECRET]"]
                at = b
        assert [(f["start"], f["end"]) for f in got[i]["findings"]] == want
        assert got[i]["redacted"] == b"".join([*redacted, raw[at:]]).decode()


def test_training_windows_hold_every_symbol_once(spark):
    """What the windows' places are followed by is each training text as a whole, in order, with its end."""
    path = subwords.default_tokenizer()
    rows = ["b a", "one", " \n", "", "x y " * 40 + "unseen-wörter 12345", " ".join(f"w{i % 9}" for i in range(997))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").coalesce(1)
    cutter = subwords.Subwords.of(path)
    end, start = 2 * cutter.size + 1, 2 * cutter.size + 4
    # kinds are symbols, so that nothing is told apart less
    model = {"class_of": np.arange(start), "fine": np.arange(start), "ids": lm.id_type(cutter.size)}
    if start >= 1 << 16:
        model["fine"] = np.arange(start) % 60000
        model["class_of"] = np.arange(60000)
    start = len(model["class_of"])
    got = [np.frombuffer(r["inputs"], "<u2").tolist() for r in lm.draw_windows(docs, spark.sparkContext.broadcast(model), path).collect()]
    want = []
    for text in rows:
        flat = []
        for word in text.lower().encode().split():
            ids = np.frombuffer(cutter.ids(word), "<u4")
            flat += [2 * int(i) for i in ids[:-1]] + [2 * int(ids[-1]) + 1]
        flat = [start, *(int(model["fine"][k]) for k in [*flat, end])]
        for i in range(0, len(flat) - 1, lm.RUN):
            part = flat[i : i + lm.RUN + 1]
            want.append(part + [start] * (lm.RUN + 1 - len(part)))
    assert sorted(got) == sorted(want)


def test_attention_reuses_memory():
    """A step of training takes next to no new pages from the system, large scores come out as with the shift of their
    rows, and words are tokenised as texts are."""
    import resource

    from fathomline.llm.common import keep_at_hand
    from fathomline.llm.subwords import Subwords, default_tokenizer

    rng = np.random.default_rng(3)
    w, x, y = attention.initial(), rng.integers(0, attention.KINDS, (96, 24)), rng.integers(0, attention.CLASSES, (96, 24))
    keep_at_hand()
    faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    for _ in range(20):
        attention.step(w, x, y)
    before = faults()
    for _ in range(20):
        attention.step(w, x, y)
    assert faults() - before < 20 * 100
    logits = rng.standard_normal((7, 5, 9)) * np.array([1, 20, 300, 1, 1, 1, 3000])[:, None, None]
    target = rng.integers(0, 9, (7, 5))
    want = np.take_along_axis(logits, target[..., None], 2)[..., 0] - np.logaddexp.reduce(logits, axis=2)
    for part in (slice(0, 1), slice(0, 7)):
        assert np.allclose(attention.log_chosen(logits[part].copy(), target[part]), want[part])
    big = {k: v * np.float32(30 if k in "qk" else 1) for k, v in w.items()}
    a, v = attention.forward(big, x, 16)[5], attention.forward(big, x, 16)[4]
    assert np.isfinite(v).all() and np.allclose(a.sum(axis=2), 1, atol=1e-5)
    assert (a[:, np.arange(24)[None, :] > np.arange(8, 24)[:, None]] == 0).all()
    words = ["", "the", "The", "don't", "naïve", "7up", "x" * 70, "东京", "<|endoftext|>", "the,", "Ǆ", "ſ", "a\u0301"]
    ids, size = Subwords(default_tokenizer()).ids_of_words([x.encode() for x in words])
    plain = Subwords(default_tokenizer()).tokenizer
    assert [part.tolist() for part in np.split(ids, np.cumsum(size)[:-1])] == [plain.encode(x, add_special_tokens=False).ids for x in words]


def test_words_are_merged_together_as_the_tokenizer_merges_them():
    """Ids of many words at once are those of each word's own encoding, also where words are not plain or empty."""
    rng = random.Random(5)
    signs = ["a", "s", "t", "re", "v", "ll", "'", "'s", "'re", "7", "!", "-", "<", "|", "é", "À", "ß", "×", "÷", "ÿ", "Ÿ", "東", "é", "x" * 30, "-" * 40, "the", "ing"]
    words = ["", "the", "don't", "it's,", "'''s", "naïve", "<|endoftext|>", "'l", "x'r", *("".join(rng.choices(signs, k=rng.randint(1, 7))).lower() for _ in range(4000))]
    cutter = subwords.Subwords(subwords.default_tokenizer())
    assert cutter.merges is not None
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    ids, size = cutter.ids_of_spans(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)
    want = [cutter.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert [part.tolist() for part in np.split(ids, np.cumsum(size)[:-1])] == want
    key = np.array([7, -1, 7, 3, -1])
    fresh, at, which = lm.distinct_keys(key)
    assert fresh.tolist() == [7, -1, 3] and (key[at] == fresh).all() and (fresh[which] == key).all()


def test_each_round_reads_only_windows_of_its_own(spark):
    """Windows laid together are those laid one a row, each in one round, and a text of n words reads few rows."""
    path = subwords.default_tokenizer()
    docs = spark.createDataFrame([(i, " ".join(f"w{j % 7}" for j in range(i * 37))) for i in range(60)], "doc_id long, text string").coalesce(1)
    cutter = subwords.Subwords.of(path)
    start = 50000
    model = spark.sparkContext.broadcast({"class_of": np.arange(start), "fine": np.arange(2 * cutter.size + 4) % start, "ids": lm.id_type(cutter.size)})
    one = sorted(bytes(r["inputs"]) for r in lm.draw_windows(docs, model, path).collect())
    rows = lm.draw_windows(docs, model, path, lm.TOGETHER).collect()
    width = 2 * (lm.RUN + 1)
    many = [[bytes(r["inputs"])[i : i + width] for i in range(0, len(r["inputs"]), width)] for r in rows]
    assert sorted(w for ws in many for w in ws) == one
    assert max(map(len, many)) == lm.TOGETHER and len(rows) < len(one) / lm.TOGETHER + 2 * lm.ROUNDS
    of = [sum(len(ws) for r, ws in zip(rows, many, strict=True) if r["round"] == k) for k in range(lm.ROUNDS)]
    assert max(of) - min(of) <= 1 and sum(of) == len(one)
