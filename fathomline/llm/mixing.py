"""Mixing sources to target weights: a curriculum whose weights vary over training.

Each source has a weight schedule, piecewise linear over training time 0..1. Integrating a source's share of all
weights over time gives the share of the token budget it shall have, and the cumulative demand D(t) of the source.
Its documents, in a seeded order, cover its stream of words again and again; a copy of a document that begins at word
c of the stream gets the training position t with D(t) = c. Sorting by position gives the training order.

By default the curriculum moves from the sources that come first to those that come last, while each source's integral
stays its constant weight, so the shares of the whole training are those of the weights 5, 2, 1, repeating.

Scale: cumulative sizes come from buckets of the seeded order, first within each bucket, then over the few sums of the
buckets, so a source that holds a third of all rows is spread over all tasks. Only per-source totals reach the driver
(one row a source).

Cases: a null text has no words (size 0); a null source is a source of its own, last in order; documents of size 0
take nothing but keep a row; ties of the seeded order go by doc_id and size; repeated rows count each by itself, and so
do rows without a doc_id; very long texts only count by their size; an empty table gives an empty result; other columns
come along, also ones named like the results', which these replace.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from fathomline.llm.common import cut, numbered, partitions

#: Seeded buckets of each source's order.
BUCKETS_PER_PARTITION = 4
CYCLE = (5.0, 2.0, 1.0)
CAP = 3.0
SEED = 17
GRID = 64
#: How much the default curriculum moves: 0 leaves weights constant, at 1 a source's weight may begin or end at none.
TILT = 0.8
#: Sources whose plan (some GRID numbers each) may be broadcast.
MOST_BROADCAST = 4096


def n_words(text="text"):
    """Words of a text as a column."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Shares of the total by weight; what is above ``cap`` times a size is shared anew among the rest, by weight."""
    out, left = [0.0] * len(sizes), float(sum(sizes))
    # those with the least room for their weight are the first to be above it
    order = sorted((i for i in range(len(sizes)) if weights[i] > 0), key=lambda i: sizes[i] / weights[i])
    masses = list(accumulate(weights[i] for i in reversed(order)))[::-1]
    for k, (i, mass) in enumerate(zip(order, masses, strict=True)):
        if left * weights[i] / mass <= cap * sizes[i]:
            for j in order[k:]:
                out[j] = left * weights[j] / mass
            break
        out[i] = cap * sizes[i]
        left -= out[i]
    return out


def curriculum(n: int) -> list[list[tuple[float, float]]]:
    """Schedules of n sources with integrals in the proportions of CYCLE: the later half rises, the earlier one falls.

    The weights' sum is the same at all times, so a source's share of the time is its weight's share of the sum.
    """
    whole = [CYCLE[i % len(CYCLE)] for i in range(n)]
    early, late = sum(whole[: n - n // 2]), sum(whole[n - n // 2 :])
    rise = TILT * min(1.0, early / late) if late else 0.0
    fall = rise * late / early if early else 0.0
    tilt = [-fall] * (n - n // 2) + [rise] * (n // 2)
    return [[(0.0, c * (1 - a)), (1.0, c * (1 + a))] for c, a in zip(whole, tilt, strict=True)]


def demand(schedules: list[list[tuple[float, float]]], grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Times, and for each source the integral of its share of all weights up to each time, as a part of its whole."""
    t = np.linspace(0.0, 1.0, grid + 1)
    w = np.array([np.interp(t, *zip(*sorted(s), strict=True)) for s in schedules]).reshape(len(schedules), -1)
    share = w / np.maximum(w.sum(axis=0), 1e-300)
    area = np.concatenate([np.zeros((len(schedules), 1)), np.cumsum((share[:, 1:] + share[:, :-1]) / 2 * np.diff(t), axis=1)], axis=1)
    return t, area


def mix(docs: DataFrame, schedule: Callable[[int, str | None], list[tuple[float, float]]] | None = None, *, cap: float = CAP, seed: int = SEED, size=None, boundary: str = "cut", carry: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, source, and a text or ``size`` column) with size, source_size, target, taken, copies and positions.

    ``schedule(i, source)`` gives the (time, weight) points of the i-th source in code-point order, null last; by
    default ``curriculum``. ``copies`` counts whole or begun copies, ``taken`` their words.
    ``boundary``: "cut" ends the last document of a source at the target's word, "round" takes it whole if more than
    half of it lies before the target. ``positions`` are the training times of the copies. Of other columns those in
    ``carry`` come along.
    """
    spark = docs.sparkSession
    sized = docs.withColumn("size", n_words() if size is None else size)
    n = BUCKETS_PER_PARTITION * max(8, partitions(spark))
    # rows that share a doc_id, or have none, are told apart by their text or by what is carried
    rest = [F.xxhash64("text")] if size is None else [F.col(c) for c in carry]
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id"), F.col("size"), F.lit(seed))).otherwise(F.xxhash64(*rest, F.col("size"), F.lit(seed)))
    narrow = sized.withColumn("__key", key).select("doc_id", "source", "size", *carry, "__key")
    narrow = narrow.withColumn("__bucket", F.floor((F.col("__key").cast("double") / F.lit(2.0**64) + 0.5) * n).cast("int"))
    sums = narrow.groupBy("source", "__bucket").agg(F.sum("size").alias("__sum"))
    rows = sums.groupBy("source").agg(F.sum("__sum").alias("s")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    points = [schedule(i, r["source"]) for i, r in enumerate(rows)] if schedule else curriculum(len(rows))
    times, area = demand(points) if rows else (np.zeros(1), np.zeros((0, 1)))
    goal = targets([r["s"] for r in rows], [float(a[-1]) for a in area], cap)
    curve = [[float(x) for x in (a / a[-1] * g if a[-1] else a)] for a, g in zip(area, goal, strict=True)]
    plan = spark.createDataFrame([(r["source"], int(r["s"]), float(g), c) for r, g, c in zip(rows, goal, curve, strict=True)], "source string, source_size long, target double, __curve array<double>")
    whole = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(whole), F.lit(0))).drop("__sum")
    inner = Window.partitionBy("source", "__bucket").orderBy("__key", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("__own", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    joined = placed.alias("d").join(offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.__bucket") == F.col("o.__bucket"))).select("d.*", (F.col("__before") + F.col("__own")).alias("__at"))
    # one row a source; beyond a few thousand of them the join is left to the planner
    joined = joined.alias("j").join((F.broadcast(plan) if len(rows) <= MOST_BROADCAST else plan).alias("p"), F.col("j.source").eqNullSafe(F.col("p.source"))).select("j.*", "source_size", "target", "__curve")
    words = F.floor(F.col("target") + 1e-6).cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    rest = words - full * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("__at"))).cast("long")
    if boundary == "round":
        part = F.when(2 * part > F.col("size"), F.col("size")).otherwise(0)
    joined = joined.withColumn("taken", full * F.col("size") + part).withColumn("copies", (full + (part > 0).cast("long")).cast("int"))
    begin = F.transform(F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0))), lambda k: position((F.col("__at") + k * F.col("source_size")).cast("double"), F.col("__curve"), len(times) - 1))
    joined = joined.withColumn("positions", F.when(F.col("copies") > 0, begin).otherwise(F.array().cast("array<double>")))
    return joined.drop("__key", "__bucket", "__own", "__curve").withColumnRenamed("__at", "starts_at")


def position(c, curve, grid: int):
    """The time at which a demand, given at ``grid`` + 1 equal steps of time, reaches ``c``."""
    i = F.greatest(F.lit(1), F.least(F.lit(grid), F.size(F.filter(curve, lambda x: x <= c))))
    low, high = F.element_at(curve, i), F.element_at(curve, i + 1)
    return F.least(F.lit(1.0), (i - 1 + F.when(high > low, (c - low) / (high - low)).otherwise(0.0)) / grid)


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows of a mix, written and range-sorted by their first training position; rows without one come last."""
    at = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    return cut(mixed.withColumn("__at", at)).repartitionByRange("__at", "doc_id").sortWithinPartitions("__at", "doc_id").drop("__at")


def stream(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, as often as the mix takes them, range-sorted by training position."""
    rows = numbered(docs, docs.columns)
    narrow = rows.select("record.doc_id", "record.source", n_words("record.text").alias("size"), "row")
    taken = mix(narrow, size=F.col("size"), carry=("row",), **options).filter(F.col("copies") > 0)
    out = rows.join(taken.select("row", F.col("doc_id").alias("id"), "positions"), "row").withColumn("at", F.explode("positions"))
    return out.repartitionByRange("at", "id", "row").sortWithinPartitions("at", "id", "row").select("record.*")
