"""Sharding: a two-pass external shuffle.

Whole records go through both passes. Pass one scatters them uniformly into buckets that fit in memory, by a seeded hash
of the record. Pass two brings each bucket into a fixed order, shuffles it by Fisher-Yates with a generator seeded by
the bucket, and writes it. The n-th record of all buckets one after the other goes to shard n mod the number of shards,
so counts are at most one apart (law ``rows``).

Scale: a bucket holds about ``bucket_rows`` records however many there are; the number of buckets grows instead. Records
that are alike in every column are told apart by their number among the input's rows, so that copies of one record
spread over as many buckets as they need. Buckets' counts are summed up by stretches of buckets, and only the sums of
stretches meet in one place. A task that is run again gives the same rows.

Cases: a null text has size 1 and checksum 0, like an empty one; ties within a bucket go by doc_id, checksum, size and a
hash of all columns; repeated rows, and rows without a doc_id, have a slot of their own each; very long texts are
records like others, and a bucket holds fewer of them (``bucket_bytes``); an empty table gives no rows; other columns
come along, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from fathomline.llm.common import cut, if_small

SHARDS = 16
SEED = 29
#: Columns that ``write`` adds.
SHARD, SLOT = "shard_number", "slot_in_shard"
#: Records in a bucket, and bytes of their texts, on average.
BUCKET_ROWS, BUCKET_BYTES = 20_000, 32 << 20
#: Buckets whose counts are summed up together.
STRETCH = 1000
#: Kinds of alike records that are named one by one; if there are more, every record counts as one of them.
MOST_ALIKE = 1000


def digest(at: str = "") -> list[Column]:
    """doc_id, size and text_crc32 of a record whose columns are under ``at``."""
    text = F.coalesce(F.col(f"{at}text"), F.lit("")).cast("binary")
    return [F.col(f"{at}doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")]


def scatter(docs: DataFrame, seed: int, bucket_rows: int, bucket_bytes: int) -> DataFrame:
    """record (all columns of a row), its digest, a hash of all columns (``print``) and its bucket."""
    measured = docs.select(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    buckets = max(1, -(-measured["n"] // bucket_rows), -(-measured["b"] // bucket_bytes))
    records = docs.select(F.struct("*").alias("record"), *digest(), F.xxhash64(*docs.columns).alias("print"))
    key = [F.col("doc_id"), F.col("text_crc32"), F.lit(seed)]
    prints = docs.select(*digest(), F.xxhash64(*docs.columns).alias("print")).groupBy("print").count().filter(F.col("count") > bucket_rows // 4)
    # records that are alike: a bounded number, as each has a quarter of a bucket's rows at least
    alike = [r["print"] for r in prints.select("print").limit(MOST_ALIKE + 1).collect()]
    if alike and len(alike) <= MOST_ALIKE:
        key.append(F.when(F.col("print").isin(alike), F.monotonically_increasing_id()).otherwise(F.lit(0)))
    elif alike:
        key.append(F.monotonically_increasing_id())
    return records.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform order of n records: from the last place down, each is exchanged with one of those not yet placed."""
    rng = np.random.Generator(np.random.PCG64([seed, bucket]))
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist() if n > 1 else [], strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def shuffled(docs: DataFrame, *, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """record, bucket and the place in it (``at``) of every row, as the buckets were written."""
    records = scatter(docs, seed, bucket_rows, bucket_bytes)

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text_crc32", "ascending"), ("size", "ascending"), ("print", "ascending")])
        order = fisher_yates(len(table), seed, table["bucket"][0].as_py())
        rows = table.select(["record", "bucket"]).take(pa.array(order))
        return rows.append_column("at", pa.array(np.arange(len(order))))

    schema = T.StructType([records.schema["record"], records.schema["bucket"], T.StructField("at", T.LongType())])
    return cut(records.groupBy("bucket").applyInArrow(place, schema))


def placed(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """record, shard and slot of every row."""
    rows = shuffled(docs, **options)
    counts = rows.groupBy("bucket").count().withColumn("stretch", F.floor(F.col("bucket") / STRETCH))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = counts.groupBy("stretch").agg(F.sum("count").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = Window.partitionBy("stretch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("own", F.coalesce(F.sum("count").over(inner), F.lit(0))).join(stretches, "stretch")
    first = cut(first.select("bucket", (F.col("base") + F.col("own")).alias("first")))
    n = F.col("first") + F.col("at")
    return rows.join(if_small(first), "bucket").select("record", F.pmod(n, F.lit(shards)).cast("int").alias("shard"), F.floor(n / shards).cast("long").alias("slot"))


def assign(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every record, from the shuffled records as they were written."""
    return placed(docs, shards, **options).select(*digest("record."), "shard", "slot")


def write(docs: DataFrame, path: str, shards: int = SHARDS, **options) -> None:
    """Writes the records as Parquet, a folder for each shard, from the buckets as they lie.

    Each task gives its records of a shard in the order of their slots; no record is shuffled a third time.
    """
    rows = placed(docs, shards, **options).select("record.*", F.col("shard").alias(SHARD), F.col("slot").alias(SLOT))
    rows.sortWithinPartitions(SHARD, SLOT).write.partitionBy(SHARD).parquet(path)
