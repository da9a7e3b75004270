"""Upserts on snapshots: keyed full joins that give the new state of a table; writing it swaps it in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fathomline.functions import clean


def merge(existing: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), latest: str | None = None) -> DataFrame:
    """``existing`` with the rows of ``new``: values of ``new`` hold where they are not null, but columns in ``keep``
    stay once set. Rows of ``new`` with the same key count as one, the last by ``latest`` or any but the same each time.
    """
    order = F.desc(latest) if latest else F.asc(F.xxhash64(*[F.col(c).cast("string") for c in new.columns]))
    one = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("__n = 1").drop("__n")
    values = [c for c in dict.fromkeys([*existing.columns, *new.columns]) if c not in keys]
    a = existing.select(*keys, *[F.col(c).alias(f"__a_{c}") for c in existing.columns if c not in keys])
    b = one.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in new.columns if c not in keys])
    joined = a.join(b, keys, "full")

    def value(c: str):
        sides = [f"__b_{c}", f"__a_{c}"] if c not in keep else [f"__a_{c}", f"__b_{c}"]
        return F.coalesce(*[F.col(s) for s in sides if s in joined.columns]).alias(c)

    return joined.select(*keys, *[value(c) for c in values])


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are not unique, for checks after an upsert."""
    return df.groupBy(*keys).count().filter("count > 1")


def delete(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti")


def collapse_holdings(rows: DataFrame, key: str, sums: list[str], *order: str) -> DataFrame:
    """One row a holding: sums of its amounts, and of everything else the first value that is not null.

    Rows come by the columns of ``order``, later ones for those alike in all before; rows without the first count in
    the sums alone.
    """
    rest = [c for c in rows.columns if c not in (key, *order, *sums)]
    by = F.when(F.col(order[0]).isNotNull(), F.struct(*order))
    return rows.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums], *[F.min_by(c, F.when(F.col(c).isNotNull(), by)).alias(c) for c in rest])


def ingest_holdings(raw: DataFrame, categories: DataFrame) -> dict[str, DataFrame]:
    """Vertex and edge tables from a holdings table (series_id, row, name, ticker, cusip, isin, lei, asset_category,
    shares, market_value, weight): portfolios, holdings, HAS_HOLDING, categories, companies and REPRESENTS."""
    rows = raw.withColumns({c: clean.blank_to_null(c) for c in ("ticker", "cusip", "isin", "lei")})
    rows = rows.withColumn("node_id", clean.holding_id("isin", "cusip", "name", "ticker", "lei"))
    first = lambda c: F.min_by(c, "row").alias(c)
    edges = rows.groupBy("series_id", "node_id").agg(*[F.sum(c).alias(c) for c in ("shares", "market_value", "weight")])
    holdings = rows.groupBy("node_id").agg(*[first(c) for c in ("name", "ticker", "cusip", "isin", "lei", "asset_category")])
    holdings = holdings.join(categories, holdings.asset_category == categories.code, "left").drop("code")
    companies = holdings.filter("ticker IS NOT NULL").groupBy("ticker").agg(F.min("name").alias("name"))
    return {
        "Portfolio": edges.groupBy("series_id").agg(F.count("*").alias("count")),
        "Holding": holdings,
        "HAS_HOLDING": edges,
        "Company": companies,
        "REPRESENTS": holdings.filter("ticker IS NOT NULL").select("node_id", "ticker"),
    }


def keep_old_if_empty(existing: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Chunks upserted so that an empty new embedding does not replace an old one."""
    filled = new.withColumn(column, F.when(F.size(column) > 0, F.col(column)))
    return merge(existing, filled, [key])


def fill_years(table: DataFrame, stubs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Yearly rows of either side; values of ``table`` hold, then those of ``stubs``, then 0.0."""
    a = table.select(*keys, *[F.col(c).alias(f"__t_{c}") for c in values])
    b = stubs.select(*keys, *[F.col(c).alias(f"__s_{c}") for c in values])
    return a.join(b, keys, "full").select(*keys, *[F.coalesce(f"__t_{c}", f"__s_{c}", F.lit(0.0)).alias(c) for c in values])


def first_per_ticker(filings: DataFrame, by: str = "ticker", date: str = "report_date", accession: str = "accession") -> DataFrame:
    """Filings without repeated accessions, of each fund the newest."""
    once = filings.dropDuplicates([accession])
    return once.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(date), accession))).filter("__n = 1").drop("__n")


def write(df: DataFrame, path: str) -> None:
    """The new snapshot goes beside the old one's readers: to a path of its own, which Spark commits as a whole."""
    df.write.mode("overwrite").parquet(path)
