"""Cutting texts into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T


def word_windows(df: DataFrame, text: str, size: int, step: int) -> DataFrame:
    """A row for each window of ``size`` words, ``step`` apart; the last one reaches the end. Built-in functions only."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")), " ")
    n = F.size("__w")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step))).cast("int") * step), F.lit(step))
    out = df.withColumn("__w", words).withColumn("__s", F.explode(starts))
    chunk = F.array_join(F.slice("__w", F.col("__s") + 1, F.lit(size)), " ")
    return out.withColumn("chunk", chunk).withColumn("chunkIndex", (F.col("__s") / step).cast("int")).drop("__w", "__s", text)


def sentences(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """Chunks of whole sentences of at most ``size`` words (a longer sentence stands alone), each after the first
    beginning with the sentences that end the one before, up to ``overlap`` words."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name != text], T.StructField("chunk", T.StringType()), T.StructField("chunkIndex", T.IntegerType())])

    def split(value: str) -> list[str]:
        parts = pd.Series([value or ""]).str.split(r"(?<=[.!?])\s+", regex=True)[0]
        out, held, n = [], [], 0
        for s in (p for p in parts if p.strip()):
            k = len(s.split())
            if held and n + k > size:
                out.append(" ".join(held))
                tail, m = [], 0
                for x in reversed(held):
                    if m + len(x.split()) > overlap:
                        break
                    tail.insert(0, x)
                    m += len(x.split())
                held, n = tail, m
            held.append(s)
            n += k
        return [*out, " ".join(held)] if held else out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.assign(chunk=frame[text].map(split)).drop(columns=[text])
            frame["chunkIndex"] = frame["chunk"].map(lambda c: list(range(len(c))))
            frame = frame[frame["chunk"].map(len) > 0].explode(["chunk", "chunkIndex"])
            yield frame.astype({"chunkIndex": "int32"})[[f.name for f in schema.fields]]

    return df.mapInPandas(run, schema)


def split_recursive(text: str, size: int = 512, overlap: int = 64, separators=("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that does; neighbours share ``overlap``."""
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next((s for s in separators if s in text), "")
    rest = separators[separators.index(sep) + 1 :] or ("",)
    parts = list(text) if not sep else [p + sep for p in text.split(sep)[:-1]] + [text.split(sep)[-1]]
    out, held = [], ""
    for p in parts:
        if len(p) > size:
            if held.strip():
                out.append(held)
            out += split_recursive(p, size, overlap, rest)
            held = ""
        elif len(held) + len(p) > size:
            out.append(held)
            held = (held[-overlap:] if overlap else "") + p
            held = held if len(held) <= size else p
        else:
            held += p
    return [*out, held] if held.strip() else out


def recursive_chunks(c):
    """``split_recursive`` of a text column, as an array."""

    def f(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursive(t or ""))

    return F.pandas_udf(f, "array<string>")(c)
