"""Collections of vectors with payloads, kept as Parquet, and the index of examples.

A collection is a folder of snapshots; the newest complete one is the collection, so readers never see half a write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathomline.functions import clean
from fathomline.operators import upsert
from fathomline.operators.retrieve import knn_join, mmr
from fathomline.sources.tables import content_digest

# Similarity from which an example is marked, and how examples are asked for.
VERY_SIMILAR, EXAMPLES, FETCHED = 85.0, 3, 10


class Collection:
    """Points (id, vector and payload columns) under a path."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", vector: str = "vector"):
        self.spark, self.path, self.key, self.vector = spark, path, key, vector

    def _versions(self) -> list[str]:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(place):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(place)]
        done = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(place, f"{n}/_SUCCESS"))
        return sorted(n for n in names if n.startswith("v") and done(n))

    def exists(self) -> bool:
        return bool(self._versions())

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._versions()[-1]}")

    def write(self, points: DataFrame) -> None:
        """The collection's next state, beside the one that readers have."""
        number = int(self._versions()[-1][1:]) + 1 if self.exists() else 0
        points.write.parquet(f"{self.path}/v{number:08d}")

    def upsert(self, points: DataFrame) -> None:
        """Points with a known id take the new values, others are added."""
        self.write(upsert.merge(self.read(), points, [self.key]) if self.exists() else points)

    def delete(self, condition: Column) -> None:
        """Removes the points whose payload fits."""
        self.write(self.read().filter(~F.coalesce(condition, F.lit(False))))

    def drop(self) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def info(self) -> DataFrame:
        """points and size of the vectors."""
        return self.read().agg(F.count("*").alias("points"), F.max(F.size(self.vector)).alias("size"))


def example_index(spark: SparkSession, path: str, examples: DataFrame, embed, question: str = "question") -> tuple[Collection, bool]:
    """The index of examples, embedded anew only if their content's digest is not that of the one kept; and whether it was.

    Questions are embedded with their funds, companies and tickers as placeholders.
    """
    index = Collection(spark, f"{path}/{content_digest(examples).replace(':', '-')}", key=question)
    if index.exists():
        return index, False
    index.write(embed(examples.withColumn("intent", clean.intent(question)), "intent").withColumnRenamed("embedding", "vector"))
    return index, True


def nearest_examples(queries: DataFrame, examples: DataFrame, k: int = EXAMPLES, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, key, percent and heading of the ``k`` nearest examples; very similar ones are marked."""
    near = knn_join(queries, examples, k, key=key, column=column)
    percent = F.greatest(F.lit(0.0), F.col("score")) * 100
    shown = F.format_string("%.1f%% match", percent)
    heading = F.when(percent >= VERY_SIMILAR, F.concat(F.lit("Example "), F.col("rank").cast("string"), F.lit(" [★ VERY SIMILAR — "), shown, F.lit(" — follow this pattern closely]:")))
    heading = heading.otherwise(F.concat(F.lit("Example "), F.col("rank").cast("string"), F.lit(" ["), shown, F.lit("]:")))
    return near.select("query_id", "rank", key, percent.alias("percent"), heading.alias("heading"))


def diverse_examples(queries: DataFrame, examples: DataFrame, k: int = EXAMPLES, fetched: int = FETCHED, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Of the ``fetched`` nearest examples of each query ``k`` that are near it and unlike each other."""
    near = knn_join(queries, examples, fetched, key=key, column=column).join(examples.select(key, F.col(column).alias("embedding")), key)
    return mmr(near.select("query_id", key, "score", "embedding"), k, key=key)
