"""Ingestion: staging tables to vertex and edge tables, each by one declared upsert."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fathomline.functions import clean
from fathomline.operators import upsert


@dataclass(frozen=True)
class Target:
    """A vertex or edge table: the columns that make its key and those it takes, as expressions over the staging row."""

    name: str
    key: dict[str, Column | str]
    values: dict[str, Column | str]
    explode: str | None = None
    when: str | None = None
    keep: tuple[str, ...] = ()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rows_for(staging: DataFrame, target: Target) -> DataFrame:
    df = staging.filter(target.when) if target.when else staging
    if target.explode:
        df = df.withColumn(target.explode, F.explode(target.explode))
    out = df.select(*[col(c).alias(k) for k, c in (target.key | target.values).items()])
    return out.dropna(subset=list(target.key))


def ingest(staging: DataFrame, targets: list[Target], existing: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The new state of every target table. Running it again with its own result changes nothing."""
    out = {}
    for t in targets:
        rows = rows_for(staging, t)
        have = (existing or {}).get(t.name)
        out[t.name] = upsert.merge(have if have is not None else rows.limit(0), rows, list(t.key), t.keep)
    return out


def fund_targets() -> list[Target]:
    """From rows of funds: provider, trust, fund, share_class, profile, document, sections, managers, highlights, returns."""
    name = lambda c: clean.blank_to_null(c)
    trust_id = F.concat_ws("_", "provider", "trust")
    section = lambda s: Target("Section", {"fund_ticker": "ticker", "label": F.lit(s)}, {"text": s.lower()}, when=f"{s.lower()} IS NOT NULL")
    return [
        Target("Provider", {"name": name("provider")}, {}),
        Target("Trust", {"id": trust_id}, {"name": "trust", "provider": "provider"}),
        Target("Fund", {"ticker": name("ticker")}, {"name": "name", "cik": "cik", "exchange": "exchange", "trust_id": trust_id}),
        Target("ShareClass", {"name": clean.share_class("share_class")}, {"description": "share_class"}, keep=("description",)),
        Target("HAS_SHARE_CLASS", {"ticker": name("ticker")}, {"share_class": clean.share_class("share_class")}),
        Target("Profile", {"fund_ticker": "ticker"}, {"summary": "summary"}, when="summary IS NOT NULL"),
        Target("Document", {"accession": name("accession")}, {"url": "url", "type": "form", "filing_date": "filing_date"}),
        Target("EXTRACTED_FROM", {"ticker": "ticker", "accession": name("accession")}, {}),
        *map(section, ("Objective", "Strategy", "Risk")),
        Target("Person", {"name": clean.person_name("managers")}, {}, explode="managers"),
        Target("MANAGED_BY", {"ticker": "ticker", "person": clean.person_name("managers"), "year": F.year("filing_date")}, {}, explode="managers"),
        Target("FinancialHighlight", {"ticker": "ticker", "year": F.year("filing_date")}, {"net_assets": "net_assets", "expense_ratio": "expense_ratio", "turnover": "turnover"}),
        Target("AverageReturns", {"ticker": "ticker", "year": F.year("filing_date")}, {c: c for c in ("return_1y", "return_5y", "return_10y", "return_inception")}),
    ]


def allocation_target(kind: str) -> Target:
    """Allocations keyed by year, so that a later year does not replace an earlier one; ``latest`` gives the newest."""
    return Target(f"HAS_{kind.upper()}_ALLOCATION", {"ticker": "ticker", "name": "name", "year": "year"}, {"weight": "weight"}, when="name IS NOT NULL AND weight IS NOT NULL")


def latest(edges: DataFrame, keys: list[str], value: str, by: str = "year") -> DataFrame:
    return edges.groupBy(*keys).agg(F.max_by(value, by).alias(value), F.max(by).alias(by))


def company_targets() -> list[Target]:
    """From rows of annual reports: company, filing, its document and the five narrative sections."""
    year = F.year(F.coalesce("report_period_end", "filing_date"))
    filing = {"ticker": "ticker", "year": year}
    sections = {"RiskFactor": "risk_factors", "BusinessInformation": "business", "LegalProceeding": "legal", "ManagementDiscussion": "discussion", "Properties": "properties"}
    return [
        Target("Company", {"ticker": clean.blank_to_null("ticker")}, {"name": "name", "cik": "cik"}),
        Target("Filing10K", filing, {"accession": "accession"}),
        Target("Document", {"accession": clean.blank_to_null("accession")}, {"url": "url", "type": F.lit("10-K"), "filing_date": "filing_date"}),
        *[Target(label, filing, {"text": c}, when=f"{c} IS NOT NULL") for label, c in sections.items()],
        Target("Person", {"name": clean.person_name("ceo")}, {}, when="ceo IS NOT NULL"),
        Target("HAS_CEO", {"ticker": "ticker"}, {"person": clean.person_name("ceo"), "compensation": "ceo_compensation"}, when="ceo IS NOT NULL"),
        Target("CompensationPackage", {"person": clean.person_name("ceo")}, {"total": "ceo_compensation"}, when="ceo IS NOT NULL"),
    ]


def metrics(facts: DataFrame) -> dict[str, DataFrame]:
    """Metrics and their segments with percentages: ``facts`` has ticker, year, label, value, segments (label, value)."""
    metric = facts.groupBy("ticker", "year", "label").agg(F.max("value").alias("value"))
    parts = facts.select("ticker", "year", F.col("label").alias("metric"), F.col("value").alias("whole"), F.explode("segments").alias("s"))
    segment = parts.groupBy("ticker", "year", "metric", F.col("s.label").alias("label")).agg(F.max("s.value").alias("value"), F.max("whole").alias("whole"))
    return {"FinancialMetric": metric, "Segment": segment.withColumn("percentage", clean.percent_of("value", "whole")).drop("whole")}


def counters(tables: dict[str, DataFrame]) -> DataFrame:
    """How many rows each table has."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def backfill_categories(holdings: DataFrame, categories: DataFrame, code: str = "asset_category", column: str = "category") -> DataFrame:
    """Holdings without a category take that of their code (categories: code, and ``column``); others keep theirs, so
    doing it again changes nothing. The join is left to the planner: the table of codes is small as a rule."""
    known = categories.select(F.col("code").alias("__code"), F.col(column).alias("__new"))
    joined = holdings.join(known, F.col(code) == F.col("__code"), "left")
    return joined.withColumn(column, F.coalesce(F.col(column), F.col("__new"))).drop("__code", "__new")


def add_charts(charts: DataFrame, new: DataFrame) -> DataFrame:
    """Charts (ticker, title, svg) with new ones; one of the same ticker and title is replaced."""
    return upsert.merge(charts, new, ["ticker", "title"])


def charts_of(charts: DataFrame, ticker: str, title: str | None = None) -> DataFrame:
    rows = charts.filter(F.upper("ticker") == ticker.upper())
    return rows if title is None else rows.filter(F.contains(F.lower("title"), F.lit(title.lower())))


FUND_TABLES = ("Fund", "HAS_SHARE_CLASS", "Profile", "Objective", "Strategy", "Risk", "MANAGED_BY", "FinancialHighlight", "AverageReturns", "EXTRACTED_FROM")


def emptied(tables: dict[str, DataFrame], only: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """The tables without their rows: all of them, or ``only`` those named, such as FUND_TABLES."""
    return {name: df.limit(0) if only is None or name in only else df for name, df in tables.items()}


def with_prospectus(funds: DataFrame, prospectuses: DataFrame, key: str = "ticker") -> DataFrame:
    """Funds with what their prospectus says where they have one; what both have, the fund's own row tells."""
    more = [c for c in prospectuses.columns if c != key]
    one = prospectuses.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(f"__{c}") for c in more])
    joined = funds.join(one, key, "left")
    return joined.select(*funds.columns, *[F.col(f"__{c}").alias(c) for c in more if c not in funds.columns])
