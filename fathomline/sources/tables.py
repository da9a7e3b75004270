"""Reading and writing tables: Parquet first, JSON and text for reference data, atomic replacement for snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; time stamps without zone become time stamps in UTC."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows (path, text), for filings kept as files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def labelled_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question sets in JSON: ``labels`` as a list, or one ``label`` in older files."""
    df = spark.read.schema("text string, labels array<string>, label string").json(path, multiLine=True)
    return df.select("text", F.coalesce("labels", F.when(F.col("label").isNotNull(), F.array("label")), F.array().cast("array<string>")).alias("labels"))


def reference_names(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of companies (ticker, title, cik)."""
    return spark.read.schema("cik_str long, ticker string, title string").json(path, multiLine=True)


def ticker_from_path(path="path"):
    """The ticker that a chart's file name begins with."""
    return F.upper(F.regexp_extract(F.col(path), r"([A-Za-z]{1,6})[_-][^/]*\.svg$", 1))


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replaces a table; Spark's committer makes the new files visible at the end only."""
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def content_digest(df: DataFrame) -> str:
    """A fingerprint of a table's rows whatever their order, to tell whether an index must be built anew."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)])
    found = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("h")).first()
    return f"{found['n']}:{found['h']}"
