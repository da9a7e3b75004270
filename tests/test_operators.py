"""Operators that SQL does not cover: matching, upserts, streams, evaluation, what follows a result."""

import pytest
from pyspark.sql import functions as F

from fathomline.operators import evaluate, match, post, retrieve, upsert
from fathomline.sources import tables
from fathomline.streaming import events


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, name string, v double")
    new = spark.createDataFrame([(2, None, 5.0), (3, "c", 3.0), (3, "c", 3.0)], "k int, name string, v double")
    once = upsert.merge(old, new, ["k"])
    want = [(1, "a", 1.0), (2, "b", 5.0), (3, "c", 3.0)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, upsert.merge(once, new, ["k"]).collect())) == want
    assert upsert.duplicates(once, ["k"]).isEmpty()
    assert dict(upsert.merge(old, new, ["k"], keep=("v",)).select("k", "v").collect())[2] == 2.0


def test_keeps_old_embedding(spark):
    old = spark.createDataFrame([("c1", [1.0])], "id string, e array<double>")
    new = spark.createDataFrame([("c1", []), ("c2", [2.0])], "id string, e array<double>")
    assert dict(upsert.keep_old_if_empty(old, new, "id", "e").collect()) == {"c1": [1.0], "c2": [2.0]}


def test_holdings(spark):
    raw = spark.createDataFrame([("S1", 1, "Apple", "AAPL", None, "US1", None, "EC", 1.0, 10.0, 0.1), ("S1", 2, "Apple Inc", "AAPL", None, "US1", None, "EC", 2.0, 20.0, 0.2), ("S1", 3, "Bond", "nan", "123", "", None, "DBT", 1.0, 5.0, 0.1)], "series_id string, row int, name string, ticker string, cusip string, isin string, lei string, asset_category string, shares double, market_value double, weight double")
    cats = spark.createDataFrame([("EC", "Equity"), ("DBT", "Debt")], "code string, category string")
    out = upsert.ingest_holdings(raw, cats)
    assert {r["node_id"]: r["shares"] for r in out["HAS_HOLDING"].collect()} == {"US1": 3.0, "cusip_123": 1.0}
    assert {r["node_id"]: r["name"] for r in out["Holding"].collect()}["US1"] == "Apple"
    assert out["Company"].count() == 1


def test_first_of_tied_lines(spark, tmp_path):
    """Of lines with the same numbers the first in the files that has a value counts, as in the SQL on one thread."""
    import duckdb

    from fathomline import queries

    c = duckdb.connect()
    c.execute("SET threads = 1")
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for n in range(2):
        flag = "CASE WHEN i % 5 < 2 THEN NULL ELSE ['R', 'N', 'A'][1 + (i * 7 + i // 40) % 3] END"
        c.execute(f"COPY (SELECT i % 40 AS l_partkey, CASE WHEN i % 11 > 0 THEN i // 160 END AS l_orderkey, CAST(1 AS INTEGER) AS l_linenumber, 1.0::DOUBLE AS l_quantity, 2.0::DOUBLE AS l_extendedprice, {flag} AS l_returnflag FROM (SELECT range + {n} * 300 AS i FROM range(300))) TO '{folder}/part-{n}.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/*.parquet'")
    got = queries.QUERIES["holdings_dedup"](spark, str(tmp_path))
    want = c.sql(queries.SQL["holdings_dedup"])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_cascade(spark):
    left = spark.createDataFrame([(1, "Apple Inc"), (2, "Microsoft Corprtion"), (3, "Zzz")], "left_id long, name string")
    right = spark.createDataFrame([(10, "Apple"), (11, "Microsoft Corporatio"), (12, "Amazon")], "right_id long, name string")
    got = {r["left_id"]: (r["right_id"], r["stage"]) for r in match.cascade(left, right, 0.74).collect()}
    assert got[1] == (10, "exact") and got[2][0] == 11 and 3 not in got


def test_resolver(spark):
    funds = spark.createDataFrame([(1, "Vanguard 500 Index Fund", "VFIAX"), (2, "Vanguard Extended Market Index Fund", "VEXAX")], "name_id long, name string, ticker string")
    firms = spark.createDataFrame([(5, "Amazon", "AMZN"), (6, "Apple", "AAPL")], "name_id long, name string, ticker string")
    houses = spark.createDataFrame([(9, "Vanguard")], "name_id long, name string")
    trusts = spark.createDataFrame([(11, "Vanguard Index Funds Trust")], "name_id long, name string")
    asked = spark.createDataFrame([(1, "price of VFIAX"), (2, "vanguard 500 index fund"), (3, "annual revenue of amazoon"), (4, "who leads amazoon"), (5, "which provider is vangard"), (6, "what does the vanguard index funds trust hold"), (7, "list the highest fees")], "query_id long, query string")
    got = {}
    for r in match.resolve(asked, funds, firms, houses, trusts).collect():
        got.setdefault((r["query_id"], r["kind"]), {})[r["name"]] = r["score"]
    assert got[1, "fund"] == {"Vanguard 500 Index Fund": 100.0} and got[2, "fund"]["Vanguard 500 Index Fund"] == 100.0
    assert list(got[3, "company"]) == ["Amazon"] and (4, "company") not in got  # no word there asks about companies
    assert list(got[5, "provider"]) == ["Vanguard"] and list(got[6, "trust"]) == ["Vanguard Index Funds Trust"] and (7, "fund") not in got
    flags = {r["query_id"]: r["m"] for r in asked.select("query_id", match.is_aggregate().alias("m")).collect()}
    assert [k for k, m in flags.items() if m] == [7]


def test_many_beside_other_letters(spark):
    """Capitals end before a letter that is not ASCII, as in the SQL of aggregate_questions; a null asks nothing."""
    import duckdb

    from fathomline import queries

    asked = ["bestlich SSäich", "best äSS", "best SSä", "best Straße SS", "best SS_", "best SS1", "best ABCDEF", "best ÄÖ", "best É", "BEST", "Best of all", "rest", "", None]
    rows = [(1, i, text) for i, text in enumerate(asked)]
    got = spark.createDataFrame(rows, "conv_id long, turn long, text string").select("conv_id", "turn", match.is_aggregate("text").alias("many")).collect()
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?)", rows)
    assert sorted(map(tuple, got)) == sorted(c.sql(queries.SQL["aggregate_questions"]).fetchall())


def test_best_names_against_all_names(monkeypatch):
    """The names within the band of the best are those of scoring every name, whichever words count as frequent."""
    import random

    from fathomline.functions import fuzzy
    from fathomline.operators import naming

    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(1, 7)))
    stock = ["global", "vanguard", "trust", "apple", "widgets", *(word() for _ in range(12))]
    text = lambda: " ".join(rng.choice(stock) if rng.random() < 0.7 else word() for _ in range(rng.randint(0, 5)))
    texts, asked = [text() for _ in range(200)], [text() for _ in range(60)]
    tokens = [[w for w in dict.fromkeys(t.split()) if len(w) > 3] for t in texts]
    for often in (2, 20, 1000):
        monkeypatch.setattr(naming, "OFTEN", often)
        names = naming.Names(list(range(200)), texts, texts, tokens)
        for q in asked:
            words = set(q.split())
            like = {}
            for t in names.spoken:
                s = max((fuzzy.ratio_of(w, t) for w in words if len(w) >= 3), default=0)
                if s >= 80:
                    like[t] = s
            scores = {}
            for i, t in enumerate(texts):
                s = max((like.get(w, 0) for w in tokens[i]), default=0)
                a, b = naming.pieces_of(q), naming.pieces_of(t)
                if q and t and len(a & b) >= 0.4 * min(len(a), len(b)):
                    s = max(s, fuzzy.token_set_ratio_of(q, t), min(100, 1.1 * fuzzy.partial_ratio_of(q, t)))
                elif not s:
                    continue
                scores[i] = min(100, s * naming.weight(len(words & set(t.split())), len(words), len(t.split()))) if words and t else s
            for cutoff, keep in ((70, 3), (82, 5)):
                top = max(scores.values(), default=0)
                want = sorted(((-s, i) for i, s in scores.items() if top >= cutoff and s >= top - 5))[:keep]
                got = [(-s, i) for i, s in names.best(q, like, cutoff, keep, 5, 1.1, 0.4) if top >= cutoff]
                assert [i for _, i in got] == [i for _, i in want] and [s for s, _ in got] == pytest.approx([s for s, _ in want])


def test_names_of_the_same_words_are_not_all_scored(spark, monkeypatch):
    """Names that differ by a number only: each question finds its own, and few texts are compared."""
    from fathomline.operators import naming

    texts = [f"acme {i} widgets" for i in range(1, 3001)]
    calls = []
    monkeypatch.setattr(naming, "partial_ratio_of", lambda a, b: calls.append(1) or 0.0)
    names = naming.Names(list(range(1, 3001)), texts, texts, [t.split()[::2] for t in texts])
    for i in (1, 17, 2999):
        assert names.best(f"revenue of acme {i} wigets", {"acme": 100.0, "widgets": 92.3}, 70, 3, 5, 1.1, 0.4)[0][0] == i - 1
    assert not calls
    firms = spark.createDataFrame([(i, f"Acme {i} Widgets Inc", "NONE") for i in range(1, 3001)], "name_id long, name string, ticker string")
    asked = spark.createDataFrame([(i, f"annual revenue of Acme {i} Wigets") for i in range(1, 3001)], "query_id long, query string")
    none = firms.limit(0)
    got = match.resolve(asked, none, firms, none.select("name_id", "name")).select("query_id", "kind", "name_id").collect()
    assert {tuple(r) for r in got} == {(i, "company", i) for i in range(1, 3001)}


def test_candidates_against_all_pairs(spark):
    """Every pair that shares the part of its pieces is found, and hot pieces alone bring no others together."""
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(1, 6)))
    texts = [" ".join(["common", *(word() for _ in range(rng.randint(0, 3)))]) for _ in range(60)]
    left, right = (spark.createDataFrame([(t,) for t in part], f"{c} string") for part, c in ((texts[:30], "x"), (texts[30:], "y")))
    cut = lambda t: {f" {t} "[i : i + 3] for i in range(len(t))}
    for share in (0.3, 0.6, 1.0):
        want = {(a, b) for a in texts[:30] for b in texts[30:] if len(cut(a) & cut(b)) >= -(-min(len(cut(a)), len(cut(b))) * share // 1)}
        assert {tuple(r) for r in match.candidates(left, right, share).collect()} == want


def test_near_pairs_against_all_pairs(spark):
    """Every pair with the ratio is found, whatever the lengths (also beyond a machine word), letters and parts."""
    import random

    from fathomline.functions import fuzzy
    from fathomline.operators import near

    rng = random.Random(3)
    for letters, most, threshold, same in (("ab", 6, 0.7, 0), ("abcd\u00e9 ", 14, 0.5, 0), ("0123", 12, 0.8, 2), ("abc", 90, 0.7, 0), ("ab", 5, 1.0, 0)):
        left, right = (["".join(rng.choices(letters, k=rng.randint(0, most))) for _ in range(50)] for _ in range(2))
        right += left[:5]
        got = sorted((int(i), int(j)) for x, y in near.alike(left, right, threshold, same) for i, j in zip(x, y, strict=True))
        fits = lambda a, b: a and b and fuzzy.ratio_of(a, b) >= 100 * threshold - 1e-7 and (not same or len(a) >= same and a[:same] == b[:same])  # noqa: B023, E731
        assert got == [(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if fits(a, b)]
    x, y = (spark.createDataFrame([(t,) for t in part], f"{c} string") for c, part in (("x", left), ("y", right)))
    want = {(left[i], right[j]) for i, j in got}
    assert {tuple(r) for r in near.pairs(x, y, 1.0, searched=7, held=9).collect()} == want


def test_near_pairs_leave_far_branches():
    """Numbered names that share most of their letters meet those with their own number, not all the others."""
    import time

    from fathomline.operators import near

    left, right = ([f"{name} {i:09d}" if first else f"{i:09d} {name}" for i in range(0, 20_000, step) for first in (True, False)] for name, step in (("customer", 7), ("supplier", 1)))
    began = time.process_time()
    # a number after a word is not near one before it
    assert sorted((left[i], right[j][-4:] if right[j][0] == "s" else right[j][:9]) for x, y in near.alike(left, right, 0.7) for i, j in zip(x, y, strict=True)) == sorted((t, t[-4:] if t[0] == "c" else t[:9]) for t in left)
    assert time.process_time() - began < 30


def test_cascade_against_all_pairs(spark):
    import random

    from fathomline.functions import fuzzy

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(2, 7)))
    stock = [word() for _ in range(12)]
    name = lambda: " ".join(rng.choice(stock) if rng.random() < 0.6 else word() for _ in range(rng.randint(1, 4)))
    left, right = ([name() for _ in range(n)] for n in (80, 70))
    left += ["qxrsty one", "qxrsty", "zb yd xf"]
    right += ["qxrsty two", "qxrst", "bz dy fx"]
    want = {}
    for i, x in enumerate(left):
        tries = [("exact", max(((1.0, -j) for j, y in enumerate(right) if x == y), default=None))]
        tries.append(("prefix", max(((fuzzy.sequence_ratio_of(x, y), -j) for j, y in enumerate(right) if x[:6] == y[:6] and len(x) >= 6), default=None)))
        tries.append(("wide", max((fuzzy.token_set_ratio_of(x, y) / 100, -j) for j, y in enumerate(right))))
        found = [(-j[1], round(j[0], 9), stage) for stage, j in tries if j and j[0] >= 0.6]
        if found:
            want[i] = found[0]
    a, b = (spark.createDataFrame(list(enumerate(part)), f"{c}_id long, name string") for c, part in (("left", left), ("right", right)))
    assert {r["left_id"]: (r["right_id"], round(r["score"], 9), r["stage"]) for r in match.cascade(a, b, 0.6).collect()} == want


def test_cascade_finds_words_in_other_orders(spark):
    left = spark.createDataFrame([(1, "The Acme Trading Corp."), (2, "Trading Acme"), (3, "Xcme Trading"), (4, "Old Acme Trading House"), (5, "unrelated")], "left_id long, name string")
    right = spark.createDataFrame([(10, "Acme Trading"), (11, "Zenith Mills")], "right_id long, name string")
    got = {r["left_id"]: (r["right_id"], r["stage"]) for r in match.cascade(left, right).collect()}
    assert got == {1: (10, "exact"), 2: (10, "wide"), 3: (10, "wide"), 4: (10, "wide")}


def test_collections_and_examples(spark, tmp_path):
    from fathomline.models.embed import embed
    from fathomline.sources.vectors import Collection, example_index

    kept = Collection(spark, str(tmp_path / "c"))
    assert not kept.exists()
    kept.upsert(spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b")], "id long, vector array<double>, tag string"))
    kept.upsert(spark.createDataFrame([(2, [0.5, 0.5], None), (3, [1.0, 1.0], "c")], "id long, vector array<double>, tag string"))
    assert {r["id"]: (r["vector"], r["tag"]) for r in kept.read().collect()} == {1: ([1.0, 0.0], "a"), 2: ([0.5, 0.5], "b"), 3: ([1.0, 1.0], "c")}
    kept.delete(F.col("tag") == "a")
    assert tuple(kept.info().first()) == (2, 2)
    kept.drop()
    assert not kept.exists()
    examples = spark.createDataFrame([("risks of VTI", "q1"), ("holdings of Growth Index Fund", "q2")], "question string, answer string")
    first, made = example_index(spark, str(tmp_path / "e"), examples, embed)
    assert made and first.read().count() == 2
    assert not example_index(spark, str(tmp_path / "e"), examples, embed)[1]
    assert example_index(spark, str(tmp_path / "e"), examples.limit(1), embed)[1]


def test_cached_tables(spark, tmp_path):
    from fathomline.sources.filings import cached

    path, calls = str(tmp_path / "t"), []

    def make():
        calls.append(1)
        return spark.range(3)

    assert cached(spark, path, make).count() == 3 and cached(spark, path, make).count() == 3 and len(calls) == 1
    assert cached(spark, path, make, fresh=True).count() == 3 and len(calls) == 2
    for f in (tmp_path / "t").glob("*.parquet"):
        f.write_bytes(b"broken")
    assert cached(spark, path, make).count() == 3 and len(calls) == 3


def test_comparisons(spark):
    from fathomline.operators import evaluate

    cases = [
        ([["a", "1"]], [["1", "a"]], "exact", "YES", True), ([], [["a"]], "mismatch", "NO", False), ([["a"]], [["a"], ["b"]], "partial", None, True), ([["x", "1"]], [["y", "1"]], "mismatch", None, False),
        ([["x", "N/A", "7"]], [["x", "q", "8"]], "partial", None, False), ([["p", "q", "r", "z"]], [["p", "q", "r", "s"]], "mismatch", None, True), ([], [], "exact", None, False),
    ]
    df = spark.createDataFrame([(i, g, e) for i, (g, e, *_) in enumerate(cases)], "i int, g array<array<string>>, e array<array<string>>")
    rows = df.select("i", evaluate.comparison("g", "e").alias("c"), evaluate.verdict("g", "e").alias("v"), evaluate.few_contained("g", "e").alias("f")).orderBy("i").collect()
    assert [(r["c"], r["v"], r["f"]) for r in rows] == [tuple(c[2:]) for c in cases]


def test_measures(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], ["x", "a"]), (2, ["a"], []), (3, [], ["a"])], "query_id int, expected array<string>, returned array<string>")
    got = {r["query_id"]: r for r in evaluate.chunk_measures(rows).collect()}
    assert got[1]["mrr"] == 0.5 and got[1]["precision"] == 0.5 and got[2]["mrr"] == 0.0 and got[3]["ndcg"] == 0.0
    flags = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "t boolean, g boolean")
    r = evaluate.binary_report(flags, "t", "g").first()
    assert (r["tp"], r["fp"], r["precision"], r["fp_rate"]) == (1, 1, 0.5, 0.5)
    a, b = spark.createDataFrame([(1, "x")], "p int, q string"), spark.createDataFrame([("x", 1)], "u string, v int")
    assert evaluate.same_values(a, b) and evaluate.contained(a.select("p"), b)
    scored = spark.createDataFrame([(1, 1, 2, 0.9), (1, 2, 2, 0.5), (2, 3, 3, 0.7)], "query_id int, item_id int, gold_id int, similarity double")
    assert {r["query_id"]: r["rank"] for r in evaluate.ranks_of_gold(scored).collect()} == {1: 2, 2: 1}


def test_results(spark):
    assert post.kind_of(["f.name", "svg"]) == "chart" and post.kind_of(["name", "weight"]) == "holdings" and post.kind_of(["a"], "company_people") == "people" and post.kind_of(["a"]) == "generic"
    df = spark.range(60).selectExpr("id", "id * 1.0 AS weight", "2000 + id AS year")
    rows, more = post.shown(df)
    assert more and rows.count() == 50 and post.note(df).first()["year_max"] == 2059
    assert post.enrichments("fund_basic", {"fund"}) == ["fund_overview", "fund_returns"]


def test_fusion(spark):
    a, b = spark.createDataFrame([(1, 0.5), (2, 0.4)], "id int, score double"), spark.createDataFrame([(2, 1.0)], "id int, score double")
    got = {r["id"]: r["score"] for r in retrieve.weighted({"vector": a, "keyword": b}, "id").collect()}
    assert got[2] == pytest.approx(0.4 * 0.4 + 0.25)


def test_streams(spark, sf, tmp_path):
    batch = events.tumbling(tables.table(spark, sf, "events"))
    stream = events.tumbling(events.read(spark, sf))
    got = events.to_memory(stream, "tumbling_out", "complete")
    key = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(got) == key(batch)
    seen = []
    events.drain(events.once(events.read(spark, sf), ["event_id"]), str(tmp_path / "cp"), lambda df, _: seen.append(df.count()))
    assert sum(seen) == tables.table(spark, sf, "events").count()


def test_sources(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"text": "a", "labels": ["x"]}, {"text": "b", "label": "y"}]')
    assert sorted(map(tuple, tables.labelled_questions(spark, str(tmp_path / "q.json")).collect())) == [("a", ["x"]), ("b", ["y"])]
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    tables.write_snapshot(df, str(tmp_path / "t"))
    again = spark.read.parquet(str(tmp_path / "t"))
    assert tables.content_digest(df) == tables.content_digest(again)


def test_similarity_counts_terms_of_many_texts(spark):
    from pyspark.sql import functions as F

    from fathomline.models import embed

    common = spark.range(1001).select(F.col("id").alias("k"), F.lit("all").alias("term"), F.lit(0.6).alias("weight"))
    rare = spark.createDataFrame([(1, "rare", 0.8), (2, "rare", 0.8)], "k long, term string, weight double")
    got = {(r["a"], r["b"]): r["similarity"] for r in embed.alike(common.unionByName(rare), "k").filter("b <= 4 AND a > 0").collect()}
    assert len(got) == 6 and abs(got[1, 2] - 1.0) < 1e-9 and abs(got[3, 4] - 0.36) < 1e-9


def test_query_cache_embeds_once():
    from fathomline.models.embed import QueryCache

    cache = QueryCache(most=2)
    assert cache("a  b") == cache("a b") and cache.asked == 1
    cache("c"), cache("a b"), cache("d")  # c is the one longest unused
    assert cache.asked == 3 and cache("a b") and cache.asked == 3
    cache("c")
    assert cache.asked == 4


def test_enrichment_runs_what_the_parameters_allow(spark):
    plans = {"fund_overview": lambda p: spark.createDataFrame([(p["fund"], 1, "x")], "ticker string, n int, svg string"), "company_overview": lambda p: 1 / 0}
    rows = post.enriched("fund_basic", {"fund": "VTI", "company": ""}, plans)
    assert post.context(rows) == '## fund_overview\n- {"ticker":"VTI","n":1}'
    assert post.enriched("fund_basic", {"fund": None}, plans) is None
