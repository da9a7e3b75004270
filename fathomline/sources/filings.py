"""Filings kept as a table: which to read, and what becomes of each.

A filing is a row with accession, cik, ticker, form, filing_date, report_date (dates) and text. Listing reads only the
columns it needs, so filters and pruning reach the files; parsing is one pass over those chosen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

# What may become of a filing.
SUCCESS, ABORTED, NO_TICKER, NO_EXTRACTION, ERROR = "success", "aborted", "failed_no_ticker", "failed_extraction", "error"


def listed(filings: DataFrame, *, ticker: str | None = None, cik: str | None = None, accession: str | None = None, form: str | None = None, year: str | int | None = None, most: int | None = None) -> DataFrame:
    """Filings of a ticker, a CIK (with or without leading zeros) or an accession, of a form, whose report date begins
    with ``year``; newest first, ``most`` at most."""
    df = filings
    if ticker is not None:
        df = df.filter(F.upper("ticker") == ticker.upper())
    if cik is not None:
        df = df.filter(F.regexp_replace(F.col("cik").cast("string"), "^0+", "") == str(cik).lstrip("0"))
    if accession is not None:
        df = df.filter(F.regexp_replace("accession", "-", "") == accession.replace("-", ""))
    if form is not None:
        df = df.filter(F.col("form") == form)  # amendments are forms of their own
    if year is not None:
        df = df.filter(F.startswith(F.col("report_date").cast("string"), F.lit(str(year))))
    df = df.orderBy(F.desc("report_date"), "accession")
    return df if most is None else df.limit(most)


def newest(filings: DataFrame, forms: tuple[str, ...] = ("10-K",), by: str = "ticker") -> DataFrame:
    """Of each ticker and form the newest filing; amendments are left out, as their form's name differs."""
    own = Window.partitionBy(by, "form").orderBy(F.desc("filing_date"), "accession")
    return filings.filter(F.col("form").isin(*forms)).withColumn("__n", F.row_number().over(own)).filter("__n = 1").drop("__n")


def company_filings(filings: DataFrame, until: str | None = None) -> DataFrame:
    """Of each company its newest annual report and proxy statement and all insider reports, up to a date."""
    insider = filings.filter("form = '4'")
    if until is not None:
        insider = insider.filter(F.col("filing_date") <= F.lit(until).cast("date"))
    return newest(filings, ("10-K", "DEF 14A")).unionByName(insider)


def parsed(filings: DataFrame, ticker: Column, record: Column) -> DataFrame:
    """accession, ticker, record and status of every filing, each accession once.

    ``ticker`` and ``record`` (a struct) are taken from the text; null tells that there is none. A filing without text is
    an error. Newer filings come first: one whose ticker a newer one has is ``aborted`` and its record dropped.
    """
    once = filings.withColumn("__n", F.row_number().over(Window.partitionBy("accession").orderBy(F.desc("report_date")))).filter("__n = 1")
    rows = once.select("accession", "report_date", "text", ticker.alias("found"), record.alias("record"))
    bad = F.when(F.col("text").isNull() | (F.length("text") == 0), ERROR).when(F.col("found").isNull(), NO_TICKER).when(F.col("record").isNull(), NO_EXTRACTION)
    order = Window.partitionBy("found", F.col("bad").isNull()).orderBy(F.desc("report_date"), "accession")
    ranked = rows.withColumn("bad", bad).withColumn("__n", F.row_number().over(order))
    status = F.coalesce("bad", F.when(F.col("__n") == 1, SUCCESS).otherwise(ABORTED))
    return ranked.select("accession", F.col("found").alias("ticker"), F.when(status == SUCCESS, F.col("record")).alias("record"), status.alias("status"))


def without_seen(parts: DataFrame, key: str = "accession", by: str = "ticker", date: str = "report_date") -> DataFrame:
    """Filings of several funds (a row for each fund), without those that name a fund which a newer filing names."""
    newer = Window.partitionBy(by).orderBy(F.desc(date), key)
    marked = parts.withColumn("__first", F.first(key).over(newer))
    return marked.withColumn("__new", F.min((F.col("__first") == F.col(key)).cast("int")).over(Window.partitionBy(key))).filter("__new = 1").drop("__first", "__new")


def in_batches(filings: DataFrame, size: int, grace: int) -> DataFrame:
    """Filings newest first in batches of ``size`` up to ``grace`` batches after the first that repeats a ticker."""
    order = Window.partitionBy("cik").orderBy(F.desc("report_date"), "accession")
    rows = filings.dropDuplicates(["accession"]).withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))
    again = rows.withColumn("__n", F.row_number().over(Window.partitionBy("cik", "ticker").orderBy(F.desc("report_date"), "accession")))
    stop = F.min(F.when(F.col("__n") > 1, F.col("batch"))).over(Window.partitionBy("cik"))
    return again.withColumn("__stop", stop).filter(F.col("__stop").isNull() | (F.col("batch") <= F.col("__stop") + grace)).drop("__n", "__stop")


def write_texts(filings: DataFrame, path: str) -> None:
    """Each filing's text as a line of JSON with its accession, for tools outside; Spark commits the files as a whole."""
    filings.select("accession", "text").write.mode("overwrite").json(path)


def cached(spark, path: str, make: Callable[[], DataFrame], fresh: bool = False) -> DataFrame:
    """The table kept at ``path``; made and written where there is none, it cannot be read or ``fresh`` is asked for."""
    if not fresh:
        try:
            kept = spark.read.parquet(path)
            kept.limit(1).collect()
            return kept
        except Exception as e:  # noqa: BLE001  whatever Spark says of a missing or broken table
            if not any(word in str(e) for word in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ", "FAILED_READ_FILE", "not a Parquet file")):
                raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
