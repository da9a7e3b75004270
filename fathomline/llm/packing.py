"""Packing token ids into windows of a fixed length by minimum bin slack.

A document's ids, with an end id, are cut into whole windows and one remainder. Remainders go by their length alone: a
histogram of lengths, at most one count a length whatever the input is, decides everything. For the longest remaining
length a subset-sum dynamic programme over bitsets finds which multiset of the other remaining lengths fills the window
closest to its capacity; backtracking through the bitsets gives how many of each length. The pattern found is repeated
as often as the counts allow, so the number of patterns depends on the window, not on the input. Documents then take
the places of their length in turn.

Scale: one pass over the texts gives the pieces with their checksums. Ranks within a length come from buckets of
documents and the sums of buckets before them, so a length that a third of all documents share is spread over all
tasks. To the driver comes the histogram (one count for each length up to the window), and to the executors goes the
table of places, whose size the window bounds.

Cases: a null or empty text is its end id alone; very long texts are tokenised whole and give as many windows as they
need; ties of a length's order go by doc_id, start and checksum; repeated rows are packed each, also rows without a
doc_id; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from fathomline.llm.common import chunks, cut, partitions
from fathomline.llm.subwords import Subwords, default_tokenizer

WINDOW = 2048
END_ID = 1
PIECES = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens"))])


def pieces(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` ids of every document, with the ids themselves if ``keep_ids``."""
    path = tokenizer or default_tokenizer()
    schema = T.StructType([*PIECES.fields, T.StructField("ids", T.BinaryType())]) if keep_ids else PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, end, step = Subwords.of(path), int(end_id).to_bytes(4, "little"), 4 * window
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            for first, last, data, offsets in chunks(column):
                raw, cuts = data.tobytes(), offsets.tolist()
                out: list[tuple] = []
                for doc, ids in zip(keys[first:last].to_pylist(), subwords.ids_of([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    out += [(doc, at // 4, len(x) // 4, zlib.crc32(x), n, x) for at in range(0, len(ids), step) for x in (ids[at : at + step],)]
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:5]] + ([pa.array(columns[5], pa.binary())] if keep_ids else []), names=schema.fieldNames())
        subwords.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)


def fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """How many of each length to put together: with one of the longest, the multiset closest to the window."""
    longest = max(counts)
    target = window - longest
    chosen = {longest: 1}
    reach, trail = 1, []
    mask = (1 << (target + 1)) - 1
    for length in sorted((k for k in counts if k <= target), reverse=True):
        most = min(counts[length] - (length == longest), target // length)
        part = 1
        while most > 0 and not reach >> target & 1:
            part = min(part, most)
            grown = (reach | reach << part * length) & mask
            if grown != reach:
                trail.append((length, part, reach))
                reach = grown
            most -= part
            part *= 2
        if reach >> target & 1:
            break
    at = reach.bit_length() - 1
    for length, part, before in reversed(trail):
        if not before >> at & 1:
            at -= part * length
            chosen[length] = chosen.get(length, 0) + part
    return chosen


def patterns(histogram: dict[int, int], window: int) -> np.ndarray:
    """Rows (length, first rank, in one window, windows, first sequence, first offset): where ranks of a length go."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    used = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    while counts:
        chosen = fill(counts, window)
        times = min(counts[k] // n for k, n in chosen.items())
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            rows.append((length, used[length], n, times, sequence, offset))
            used[length] += n * times
            offset += n * length
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    cuts = cut(pieces(docs, window, tokenizer, end_id, keep_ids))
    buckets = 4 * max(8, partitions(spark))
    ranked = cuts.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    sums = ranked.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    places = patterns(histogram, window)
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = Window.partitionBy("length", "__bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = ranked.withColumn("__own", F.row_number().over(own) - 1).join(offsets, ["length", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__own")).select(*cuts.columns, "__rank")
    shared = spark.sparkContext.broadcast(places)
    schema = T.StructType([*cuts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        starts = np.searchsorted(table[:, 0], np.arange(window + 2))
        top = int(table[:, 1].max()) + 1 if len(table) else 1
        flat = table[:, 0] * top + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            row = table[np.minimum(np.searchsorted(flat, length * top + np.minimum(rank, top - 1), side="right") - 1, starts[length + 1] - 1)]
            copy, slot = np.divmod(rank - row[:, 1], row[:, 2])
            out = [batch.column(c) for c in schema.fieldNames()[:-2]]
            yield pa.RecordBatch.from_arrays([*out, pa.array(row[:, 4] + copy), pa.array(row[:, 5] + slot * length)], names=schema.fieldNames())

    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Sequences with their ids (little-endian unsigned 32-bit) from a packing with ``keep_ids``.

    A sequence is padded to the window unless its length is a power of two.
    """
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"), F.sum("length").alias("length"))
    full = F.expr(f"CASE WHEN bit_count(length) = 1 THEN length ELSE {int(window)} END")
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (full - F.col("length")).cast("int")))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", "length", F.concat(joined, pad).alias("ids"), F.transform("parts", lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id"))).alias("parts"))
