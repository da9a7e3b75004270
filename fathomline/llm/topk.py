"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets, longest first, over the whole table. Every query meets the longest bucket
first; its k-th best score there, over its own length and that of a bucket's longest vector, is its cosine threshold for
the bucket: above 1, the bucket and all after it are passed over, so the query is not sent there. Queries that reach
equally far go in blocks to the buckets they reach. Within a bucket the threshold rises as better vectors are found. A
high one prunes by coordinate: a unit vector that close to the query has its value at the query's largest coordinate
within an interval. A low one prunes by length: only vectors long enough for the score are multiplied at all. What is
left is verified by products.

Scale: a task holds one block of each side; the numbers of buckets and blocks grow with the tables, no side is broadcast.
Buckets with more vectors than a block, such as copies of one vector, are dealt over several. The driver holds the
bounds and counts of buckets, one row for VECTORS_A_BLOCK vectors. Each task returns k rows a query, of which the best k
are ranked.

Cases: vectors that are null, empty, without an id or hold null or non-finite values take no part, neither as queries; a
query meets only vectors of its own dimension, of any length; ties go to the smaller vec_id; fewer candidates than k give
fewer rows; repeated vec_ids are rows of their own, and a query never meets its own vec_id; empty tables give an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fathomline.llm.common import cut

VECTORS_A_BLOCK, QUERIES_A_BLOCK = 8192, 2048
BUCKET = 512
#: From this cosine on, coordinates are looked at; below, lengths.
BY_COORDINATE = 0.6
SLACK = 1e-9


def quantise(df: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and the floor of ``scale`` times each component, for the vectors that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(v * scale).cast("double"))
    return df.filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).select("vec_id", whole.alias("vector"))


def bucketed(ids, vectors, queries_ids, queries, k, known=None):
    """(scores, vec_ids) of the k best of one block for each query; what is below its ``known`` score may be left out."""
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    order = np.lexsort((ids, -norm))
    ids, vectors, norm = ids[order], vectors[order], norm[order]
    unit = vectors / np.maximum(norm, 1e-300)[:, None]
    q_norm = np.sqrt((queries * queries).sum(axis=1))
    q_unit = queries / np.maximum(q_norm, 1e-300)[:, None]
    axis = np.abs(q_unit).argmax(axis=1)
    exact = float(norm.max(initial=0)) * float(q_norm.max(initial=0)) < 2**52
    best = [(np.zeros(0), np.zeros(0, np.int64))] * len(queries)
    floor = np.full(len(queries), -np.inf) if known is None else known
    least = floor.copy()
    for at in range(0, len(ids), BUCKET):
        rows = slice(at, min(at + BUCKET, len(ids)))
        longest = norm[at]
        reach = q_norm * longest
        threshold = np.where(reach > 0, least / np.where(reach > 0, reach, 1), np.where(least > 0, np.inf, -np.inf))
        active = np.flatnonzero(threshold <= 1 + SLACK)
        if not len(active):
            break
        loose = active[threshold[active] < BY_COORDINATE]
        # by length: vectors too short for a query's score are not multiplied with it
        need = np.where((q_norm[loose] > 0) & (least[loose] > 0), least[loose] / np.maximum(q_norm[loose], 1e-300), 0.0)
        long = np.searchsorted(-norm[rows] * (1 + SLACK), -need, side="right")
        products = vectors[at : at + long.max(initial=0)] @ queries[loose].T if len(loose) and exact else None
        columns = {q: i for i, q in enumerate(loose.tolist())}
        for q in active.tolist():
            if q in columns:
                use = np.arange(at, at + long[columns[q]])
                found = products[: len(use), columns[q]] if exact else None
            else:
                # by coordinate: within the interval that the cosine threshold leaves to the query's largest one
                c, t = q_unit[q, axis[q]], min(1.0, threshold[q])
                width = np.sqrt(max(0.0, (1 - t * t) * (1 - c * c))) + 1e-7
                value = unit[rows, axis[q]]
                use = np.flatnonzero((value >= c * t - width) if c > 0 else (value <= c * t + width)) + at
                found = vectors[use] @ queries[q] if exact else None
            if not exact:
                whole = [sum(int(a) * int(b) for a, b in zip(vectors[i], queries[q], strict=True)) for i in use]
                found = np.array([max(-(2**63), min(2**63 - 1, s)) for s in whole], dtype=object)
            own = ids[use] != queries_ids[q]
            score, vec = np.concatenate([best[q][0], found[own]]), np.concatenate([best[q][1], ids[use][own]])
            top = np.lexsort((vec, -score))[:k] if exact else np.array(sorted(range(len(score)), key=lambda i: (-score[i], vec[i]))[:k], dtype=int)  # noqa: B023
            best[q] = (score[top], vec[top])
            least[q] = max(floor[q], float(score[top[-1]])) if len(top) == k else floor[q]
    return best


def met(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and score of the k best of each block of vectors for each query dealt to it.

    ``left`` has vec_id, vector, size, known, q and v; ``right`` vec_id, vector, size, q and v.
    """

    def meet(asked: pa.Table, there: pa.Table) -> pa.Table:
        query, vec, score = [], [], []
        if len(asked) and len(there):
            matrix = lambda t: t["vector"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
            ids = asked["vec_id"].to_numpy()
            for i, (s, v) in enumerate(bucketed(there["vec_id"].to_numpy(), matrix(there), ids, matrix(asked), k, asked["known"].to_numpy())):
                query += [ids[i]] * len(v)
                vec += v.tolist()
                score += [int(x) for x in s]
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.int64())})

    return left.groupBy("size", "q", "v").cogroup(right.groupBy("size", "q", "v")).applyInArrow(meet, "query_id long, vec_id long, score long")


def with_bucket(vectors: DataFrame, bounds: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, vector, size, norm and bucket (0 has the longest); ``bounds`` has the lengths between buckets, falling."""
    shared = vectors.sparkSession.sparkContext.broadcast(bounds)

    def run(batches):
        for batch in batches:
            size, norm = batch.column("size").to_numpy(), batch.column("norm").to_numpy()
            bucket = np.zeros(len(size), np.int32)
            for n in np.unique(size).tolist():
                rows = size == n
                bucket[rows] = np.searchsorted(-shared.value[n], -norm[rows], side="left")
            yield batch.append_column("bucket", pa.array(bucket))

    return vectors.mapInArrow(run, "vec_id long, vector array<double>, size int, norm double, bucket int")


def search(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best vectors of each query; both hold vec_id and vector."""
    spark = vectors.sparkSession
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    wide = lambda df: df.select(F.col("vec_id").cast("long"), "vector", F.size("vector").alias("size"), norm.alias("norm"))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    vectors = cut(wide(vectors))
    counts = {r["size"]: r["n"] for r in vectors.groupBy("size").agg(F.count("*").alias("n")).collect()}
    bounds = {}
    for size, n in counts.items():
        parts = -(-n // VECTORS_A_BLOCK)
        cuts = [1 - i / parts for i in range(1, parts)]
        found = vectors.filter(F.col("size") == size).agg(F.percentile_approx("norm", cuts, 100 * parts)).first()[0] if cuts else []
        bounds[size] = np.unique(np.array(found, float))[::-1]
    bucketed_rows = with_bucket(vectors, bounds)
    # a row for each bucket: VECTORS_A_BLOCK vectors or more, but for bounds that come close together
    buckets = sorted(bucketed_rows.groupBy("size", "bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect())
    queries = wide(queries).join(F.broadcast(spark.createDataFrame([(s,) for s in counts], "size int")), "size", "left_semi")
    waiting = cut(queries)
    asked = {r["size"]: r["n"] for r in waiting.groupBy("size").agg(F.count("*").alias("n")).collect()}
    first_blocks = {s: -(-n // QUERIES_A_BLOCK) for s, n in asked.items()}

    def table(rows: list[tuple], schema: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(rows, schema))  # a row for each bucket or less

    every = lambda low, high: F.explode(F.sequence(F.col(low), F.col(high) - 1))
    # pass one: all queries and the longest bucket
    parts_of = {(r["size"], r["bucket"]): -(-r["n"] // VECTORS_A_BLOCK) for r in buckets}
    longest = table([(s, n, parts_of[s, 0], 0) for s, n in first_blocks.items()], "size int, blocks int, parts int, none int")
    left = waiting.join(longest, "size").select("vec_id", "vector", "size", F.lit(float("-inf")).alias("known"), deal(F.col("blocks")).alias("q"), every("none", "parts").alias("v"))
    right = bucketed_rows.filter("bucket = 0").join(longest, "size").select("vec_id", "vector", "size", every("none", "blocks").alias("q"), deal(F.col("parts")).alias("v"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    found = cut(best(met(left, right, k)).drop("rank"))

    # pass two: each query and the buckets that its k-th best score lets it reach
    if any(r["bucket"] for r in buckets):
        known = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).filter(F.col("n") >= k)
        reach = F.when((F.col("norm") > 0) & (F.col("least") > 0), F.col("least") / F.col("norm") / (1 + SLACK)).otherwise(0.0)
        further = waiting.join(known.select(F.col("query_id").alias("vec_id"), "least"), "vec_id", "left").select("vec_id", "vector", "size", F.coalesce("least", F.lit(float("-inf"))).alias("known"), F.coalesce(reach, F.lit(0.0)).alias("norm"))
        tops = {s: np.array([r["longest"] for r in buckets if r["size"] == s]) for s in counts}
        far = cut(with_reach(further, tops).filter("bucket > 0"))
        reached = sorted(far.groupBy("size", "bucket").agg(F.count("*").alias("n")).collect(), key=lambda r: (r["size"], -r["bucket"]))
        blocks, groups, upto = dict.fromkeys(counts, 0), [], {}
        for r in reached:  # blocks of queries, those that reach furthest first
            n = -(-r["n"] // QUERIES_A_BLOCK)
            groups.append((r["size"], r["bucket"], blocks[r["size"]], n))
            blocks[r["size"]] += n
        spots, at = [], dict.fromkeys(counts, 0)
        for r in buckets:
            s, b = r["size"], r["bucket"]
            if b:
                spots.append((s, b, at[s], parts_of[s, b], sum(n for z, reach_, _, n in groups if z == s and reach_ >= b), 0))
                at[s] += parts_of[s, b]
                upto[s, b] = at[s]
        of_queries = table([(s, b, q, n, upto[s, b], 0) for s, b, q, n in groups], "size int, bucket int, first int, blocks int, upto int, none int")
        of_vectors = table(spots, "size int, bucket int, first int, parts int, blocks int, none int")
        left = far.join(of_queries, ["size", "bucket"]).select("vec_id", "vector", "size", "known", (F.col("first") + deal(F.col("blocks"))).alias("q"), every("none", "upto").alias("v"))
        right = bucketed_rows.join(of_vectors.filter("blocks > 0"), ["size", "bucket"]).select("vec_id", "vector", "size", every("none", "blocks").alias("q"), (F.col("first") + deal(F.col("parts"))).alias("v"))
        found = best(found.unionByName(met(left, right, k)))
    else:
        found = best(found)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def with_reach(queries: DataFrame, tops: dict[int, np.ndarray]) -> DataFrame:
    """``queries``, whose ``norm`` is the length a vector must have, with the last bucket that has such vectors."""
    shared = queries.sparkSession.sparkContext.broadcast(tops)

    def run(batches):
        for batch in batches:
            size, need = batch.column("size").to_numpy(), batch.column("norm").to_numpy()
            bucket = np.zeros(len(size), np.int32)
            for n in np.unique(size).tolist():
                rows = size == n
                bucket[rows] = np.searchsorted(-shared.value[n], -need[rows], side="right") - 1
            yield batch.append_column("bucket", pa.array(bucket))

    return queries.mapInArrow(run, "vec_id long, vector array<double>, size int, known double, norm double, bucket int")
