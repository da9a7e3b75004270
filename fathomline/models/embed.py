"""Embeddings and TF-IDF: an offline hashing embedder with the shape a real one has, and similarity of term vectors."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

WIDTH = 64
BATCH = 64


def hashing_embedder(texts: list[str]) -> list[np.ndarray]:
    """A text's words hashed into WIDTH signed places, normalised."""
    import re
    import zlib

    out = []
    for t in texts:
        v = np.zeros(WIDTH)
        for w in re.findall(r"[a-z0-9]+", t.lower()):
            h = zlib.crc32(w.encode())
            v[h % WIDTH] += 1 if h >> 16 & 1 else -1
        out.append(v / max(1e-12, float(np.linalg.norm(v))))
    return out


class QueryCache:
    """Embeds questions one by one, the same question once; the one longest unused goes when there are ``most``."""

    def __init__(self, model: Callable[[list[str]], list[np.ndarray]] = hashing_embedder, most: int = 1000):
        self.model, self.most, self.kept, self.asked = model, most, OrderedDict(), 0

    def __call__(self, question: str) -> list[float]:
        key = " ".join(question.split())
        if key not in self.kept:
            self.asked += 1
            self.kept[key] = [float(x) for x in self.model([key])[0]]
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        self.kept.move_to_end(key)
        return self.kept[key]


def embed(df: DataFrame, text: str, model: Callable[[list[str]], list[np.ndarray]] = hashing_embedder, prefix: str | None = None, batch: int = BATCH) -> DataFrame:
    """``df`` with an ``embedding``; texts go to the model in batches, and a batch that fails gives nulls."""
    source = df.withColumn("__t", F.concat_ws(" ", F.lit(prefix), F.col(text)) if prefix else F.coalesce(F.col(text), F.lit("")))
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list = []
            for i in range(0, len(frame), batch):
                part = frame["__t"].iloc[i : i + batch].tolist()
                try:
                    out += [list(map(float, v)) for v in model(part)]
                except Exception:  # noqa: BLE001  a model may fail on some batches
                    out += [None] * len(part)
            yield frame.drop(columns=["__t"]).assign(embedding=out)

    return source.mapInPandas(run, schema)


def tf_idf(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight) of terms of one and two words, weighed by ln((1 + n) / (1 + df)) + 1 and normalised."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([a-z]{2,})"), F.lit(1))
    pairs = F.transform(F.sequence(F.lit(1), F.size("__w") - 1), lambda i: F.concat_ws(" ", F.get("__w", i - 1), F.get("__w", i)))
    both = docs.select(key, words.alias("__w")).withColumn("__t", F.when(F.size("__w") > 1, F.concat("__w", pairs)).otherwise(F.col("__w")))
    tf = both.select(key, F.explode("__t").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    raw = tf.join(df, "term").join(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))  # n is one row
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    return raw.join(length, key).select(key, "term", (F.col("w") / F.col("l")).alias("weight"))


def alike(weights: DataFrame, key: str) -> DataFrame:
    """(a, b, similarity) of all texts that share a term, over all terms of both.

    A term that k texts have makes k * k rows, as all its pairs are asked for.
    """
    a = weights.select(F.col(key).alias("a"), "term", F.col("weight").alias("x"))
    b = weights.select(F.col(key).alias("b"), "term", F.col("weight").alias("y"))
    return a.join(b, "term").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("similarity"))
