"""Retrieval: nearest vectors, BM25, fusion, diversity and reranking.

Score of vectors: ``cosine`` is the plain cosine, ``unit`` maps it to 0..1 as (1 + cosine) / 2; order is the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def as_score(c: Column, mode: str) -> Column:
    return (1 + c) / 2 if mode == "unit" else c


def knn(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding", mode: str = "cosine") -> DataFrame:
    """The ``k`` nearest rows of one query vector, best first. One pass and a top-k; null vectors take no part."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.filter(F.col(column).isNotNull()).withColumn("score", as_score(cosine(F.col(column), q), mode))
    return scored.orderBy(F.desc("score"), key).limit(k)


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", block: int = 256, rows: int = 8192) -> DataFrame:
    """query_id, rank, key and score of the ``k`` nearest vectors of every query (query_id, query).

    Queries are dealt into blocks of ``block`` and vectors into blocks of ``rows``, whose numbers grow with the tables;
    a task multiplies one block with another and passes on its best k. Null vectors take no part.
    """
    asked = queries.filter(F.col("query").isNotNull())
    there = vectors.filter(F.col(column).isNotNull()).select(F.col(key).alias("item"), F.transform(column, lambda x: x.cast("double")).alias("vector"))
    n_queries, n_vectors = max(1, -(-asked.count() // block)), max(1, -(-there.count() // rows))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("query_id", F.transform("query", lambda x: x.cast("double")).alias("vector"), deal("query_id", n_queries).alias("q"), every(n_vectors).alias("v"))
    right = there.select("item", "vector", every(n_queries).alias("q"), deal("item", n_vectors).alias("v"))
    types = {"query_id": queries.schema["query_id"].dataType, key: vectors.schema[key].dataType}

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        asked_ids, items, scores = [], [], []
        if len(one) and len(two):
            matrix = lambda t: t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
            unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            two = two.sort_by("item")  # ties go to the smaller key
            ids, keys, score = one["query_id"].to_pylist(), two["item"].to_pylist(), unit(matrix(one)) @ unit(matrix(two)).T
            for i, q in enumerate(ids):
                best = np.argsort(-score[i], kind="stable")[:k]
                asked_ids += [q] * len(best)
                items += [keys[j] for j in best]
                scores += score[i][best].tolist()
        return pa.table({"query_id": pa.array(asked_ids, one.schema.field("query_id").type), key: pa.array(items, two.schema.field("item").type), "score": pa.array(scores, pa.float64())})

    schema = T.StructType([*(T.StructField(n, t) for n, t in types.items()), T.StructField("score", T.DoubleType())])
    met = left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInArrow(meet, schema)
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
    return ranked.filter(F.col("rank") <= k)


def with_fallback(filtered: DataFrame, unfiltered: DataFrame) -> DataFrame:
    """The filtered hits, or the unfiltered ones where the filter leaves none; decided in the plan."""
    some = filtered.limit(1).select(F.lit(1).alias("__some"))
    rest = unfiltered.join(some, F.lit(True), "left_anti")
    return filtered.unionByName(rest)


def terms(text="text") -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([a-z0-9]+)"), F.lit(1))


def bm25(docs: DataFrame, query: str, k: int, k1: float = 1.2, b: float = 0.75, key: str = "__id") -> DataFrame:
    """The ``k`` best texts (key, text) for the query's words by BM25, with their score."""
    import re

    words = sorted(set(re.findall(r"[a-z0-9]+", query.lower())))
    tokens = docs.select(key, terms().alias("__t")).withColumn("__n", F.size("__t"))
    counts = [F.size(F.filter("__t", lambda x: x == F.lit(w))) for w in words]  # noqa: B023
    rows = tokens.select(key, "__n", *[c.alias(f"__c{i}") for i, c in enumerate(counts)])
    stats = rows.agg(F.count("*").alias("__docs"), F.avg("__n").alias("__avg"), *[F.count_if(F.col(f"__c{i}") > 0).alias(f"__d{i}") for i in range(len(words))])
    hits = rows.filter(" OR ".join(f"__c{i} > 0" for i in range(len(words))) or "false").join(F.broadcast(stats))  # stats is one row
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log(1 + (F.col("__docs") - F.col(f"__d{i}") + 0.5) / (F.col(f"__d{i}") + 0.5))
        tf = F.col(f"__c{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("__n") / F.col("__avg")))
    return hits.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


# Weights and constant of the fused search.
WEIGHTS = {"vector": 0.40, "keyword": 0.25, "structured": 0.35}
RRF_K = 60


def rrf(*rankings: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings (key, rank)."""
    parts = [r.select(key, (F.lit(1.0) / (k + F.col("rank"))).alias("score")) for r in rankings]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("score").alias("score"))


def weighted(rankings: dict[str, DataFrame], key: str, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Sum of weighted scores of rankings (key, score); what a ranking lacks counts 0 there."""
    parts = [r.select(key, (F.lit(weights[name]) * F.col("score")).alias("score")) for name, r in rankings.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("score").alias("score"))


def hybrid(searches: list[DataFrame], group: str) -> DataFrame:
    """Union of searches (group, score): the best score of each group."""
    out = searches[0].select(group, "score")
    for s in searches[1:]:
        out = out.unionByName(s.select(group, "score"))
    return out.distinct().groupBy(group).agg(F.max("score").alias("score"))


def mmr(candidates: DataFrame, k: int, key: str = "vec_id", balance: float = 0.5) -> DataFrame:
    """Of each query's few candidates (query_id, key, score, embedding) the ``k`` that are near it and unlike each other."""

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", key], ascending=[False, True], ignore_index=True)
        m = np.stack(frame["embedding"].map(lambda v: np.asarray(v, float)))
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        alike, left, chosen = m @ m.T, list(range(len(frame))), []
        while left and len(chosen) < k:
            worth = [balance * frame["score"][i] - (1 - balance) * max((alike[i, j] for j in chosen), default=0.0) for i in left]
            chosen.append(left.pop(int(np.argmax(worth))))
        out = frame.loc[chosen, ["query_id", key]].assign(rank=range(1, len(chosen) + 1))
        return out

    q, i = (candidates.schema[c].dataType.simpleString() for c in ("query_id", key))
    return candidates.groupBy("query_id").applyInPandas(pick, f"query_id {q}, {key} {i}, rank long")


def rerank(hits: DataFrame, scorer, keep: int = 5, key: str = "vec_id") -> DataFrame:
    """The ``keep`` best hits of each query by another scorer (a column of query and text); without one, as they were."""
    by = scorer("query", "text") if scorer else F.col("score")
    ranked = hits.withColumn("rerank_score", by).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("score"), key)))
    return ranked.filter(F.col("rank") <= keep)


#: Length of a name from which it is trusted as an exact filter.
TRUSTED_NAME = 7


def answer_chunks(vectors: DataFrame, query: list[float], name: str | None, scorer=None, metadata: str = "name", fetched: int = 15, keep: int = 5, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The ``keep`` best chunks for a question: those near it of the entity that it names, if that name is long enough
    to be trusted and has chunks, else near ones of all; reranked by ``scorer`` where there is one."""
    near = knn(vectors, query, fetched, key, column)
    if name and len(name) > TRUSTED_NAME:
        near = with_fallback(knn(vectors.filter(F.col(metadata) == name), query, fetched, key, column), near)
    return rerank(near.withColumn("query_id", F.lit(0)), scorer, keep, key)
