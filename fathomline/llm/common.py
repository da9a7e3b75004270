"""Shared by the operators: where lineage is cut, and words and fingerprints in numpy over Arrow buffers.

A *word* is a run of bytes outside ``[\\x20\\x09-\\x0D]``; texts are UTF-8, so such runs are whole code points.
A fingerprint takes in one block of eight bytes, or one word, after the other and mixes all bits at each step, so it is
linear in nothing; words longer than ``LONG_WORD`` bytes go through BLAKE2b.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

CHUNK_BYTES = 1 << 19
WS = np.zeros(256, dtype=bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U64 = np.uint64
STEP, TURN = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
#: Bytes of a word beyond which it is hashed by itself, and words hashed together (this bounds temporary arrays).
LONG_WORD, WORDS_AT_ONCE = 64, 1 << 16
#: Bytes up to which a table is broadcast.
SMALL_BYTES = 48 << 20
#: A key with more than this part of all rows is broadcast; there can be at most 1 / HEAVY of them.
HEAVY = 1e-3


def give_back() -> None:
    """Returns the process's free memory to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def keep_at_hand() -> None:
    """Lets the process use the memory of freed arrays again, up to some 32 MB, until ``give_back``.

    glibc else takes arrays of 128 KB and more from the system and returns them each time, and numpy spends as long on
    the pages of its temporary arrays as on the numbers in them.
    """
    option = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc only
    if option:
        option(-3, 4 << 20)  # M_MMAP_THRESHOLD
        option(-1, 32 << 20)  # M_TRIM_THRESHOLD


def frugal(run: Callable) -> Callable:
    """``run`` over batches, and at its end free memory goes back: workers outlive their tasks, beside all that follows."""

    @functools.wraps(run)
    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return steps


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it from there, so that no lineage is left.

    The table is compressed and columnar, other than what ``checkpoint()`` writes; it goes when the session ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def from_files(df: DataFrame) -> bool:
    """Whether ``df`` is no more than columns and rows of files, so that its rows have the same order in every pass."""

    def plain(node) -> bool:
        below = node.children()
        if not below.size():
            return node.nodeName().startswith("LogicalRelation")
        return node.nodeName() in ("Project", "Filter") and all(plain(below.apply(i)) for i in range(below.size()))

    return plain(df._jdf.queryExecution().optimizedPlan())


def numbered(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(record, row): ``columns`` of each row as a struct, and a number of its own that is the same in every pass.

    Rows that come straight from files are numbered as they are read, others are written first.
    """
    rows = df.select(F.struct(*columns).alias("record"), F.monotonically_increasing_id().alias("row"))
    return rows if from_files(df) else cut(rows)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Takes the cluster's ``spark.checkpoint.dir``; a temporary folder only where none is named in a local session."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="fathomline-"))


def remove_at_exit(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def if_small(df: DataFrame, size=None, limit: int | None = None) -> DataFrame:
    """A table marked for broadcast if its rows take at most ``limit`` bytes; beyond that, joins with it shuffle.

    ``size`` is a column with the bytes of a row (16 a column unless given). ``df`` must be cheap to read, such as a
    table that ``cut`` wrote.
    """
    total = df.agg(F.sum(F.lit(16 * len(df.columns)) if size is None else size).alias("n")).first()["n"] or 0
    return F.broadcast(df) if total <= (SMALL_BYTES if limit is None else limit) else df


def join_spread(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (one row a key, ``rows_of_key`` of which are in ``rows``), hot keys apart.

    Keys with more than HEAVY of the ``total`` rows, 1 / HEAVY of them at most, are broadcast, so that no key's rows
    meet in one task; all others shuffle. ``keyed`` must be cheap to read, such as a table that ``cut`` wrote.
    """
    hot = F.col("rows_of_key") > max(1.0, HEAVY * total)
    heavy, light = (F.broadcast(keyed.filter(hot).drop("rows_of_key")), keyed.filter(~hot).drop("rows_of_key"))
    return rows.join(heavy, keys).unionByName(rows.join(F.broadcast(keyed.filter(hot).select(*keys)), keys, "left_anti").join(light, keys))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all of them."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A fingerprint of each ``values[start:end]``, by one mixing step a value; for short spans."""
    length = ends - starts
    out = mix(length.astype(U64) * TURN + STEP)
    for k in range(int(length.max(initial=0))):
        live = np.flatnonzero(length > k)
        if len(live) == len(out):
            out = mix((out ^ values[starts + k]) * STEP + TURN)
        else:
            out[live] = mix((out[live] ^ values[starts[live] + k]) * STEP + TURN)
    return out


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without copying them; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of pieces of about ``size`` bytes; a text is never split."""
    if not len(column):
        return
    data, offsets = texts(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        end = min(end, len(column), row + 20000)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, in bytes, and the first word's index of each text (one more entry than texts)."""
    n = len(data)
    inside = ~WS[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A fingerprint of the bytes of each word."""
    out = np.empty(len(starts), U64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    kept = np.concatenate([(U64(1) << (U64(8) * np.arange(8, dtype=U64))) - U64(1), [~U64(0)]])
    for at in range(0, len(starts), WORDS_AT_ONCE):
        begin, end = starts[at : at + WORDS_AT_ONCE], ends[at : at + WORDS_AT_ONCE]
        length = end - begin
        part = mix(length.astype(U64) * TURN + STEP)
        live = np.flatnonzero(length <= LONG_WORD)
        done = 0
        while len(live):
            block = blocks[begin[live] + done] & kept[np.minimum(length[live] - done, 8)]
            part[live] = mix((part[live] ^ block) * STEP + TURN)
            done += 8
            live = live[length[live] > done]
        for i in np.flatnonzero(length > LONG_WORD).tolist():
            part[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
        out[at : at + WORDS_AT_ONCE] = part
    return out


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space between them, and the start and end of each; neighbouring texts may touch."""
    keep = ~WS[data]
    out = np.where(keep, data, np.uint8(32))
    keep[starts[starts > 0] - 1] = True
    place = np.cumsum(keep)
    return out[keep].tobytes(), place[starts] - 1, place[ends - 1]


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b of each ``raw[start:end]``, as two arrays."""
    blake = hashlib.blake2b
    both = b"".join([blake(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    pair = np.frombuffer(both, np.int64).reshape(-1, 2)
    return pair[:, 0].copy(), pair[:, 1].copy()


def owner(first: np.ndarray) -> np.ndarray:
    """For offsets of groups, the group of each member."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
