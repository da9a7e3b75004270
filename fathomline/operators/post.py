"""What happens to a result: its kind, its size, where it comes from."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

MOST_ROWS = 50
PAYLOAD = ("embedding", "svg")

# Column words that tell a result's kind, in order of precedence.
KINDS = (
    ("chart", ("svg",)),
    ("holdings", ("weight", "shares", "marketvalue", "market_value", "holding")),
    ("text", ("text", "chunk", "strategy", "objective", "risk", "section")),
    ("people", ("manager", "person", "ceo", "compensation")),
    ("company_financials", ("revenue", "net_income", "netincome", "operating", "metric", "segment")),
    ("financials", ("netassets", "net_assets", "expenseratio", "expense_ratio", "turnover", "totalreturn", "return")),
    ("allocation", ("sector", "region", "allocation")),
)


def kind_of(columns: list[str], category: str | None = None) -> str:
    """The kind of a result by its columns, else by the question's category."""
    low = [c.lower().split(".")[-1] for c in columns]
    for kind, words in KINDS:
        if any(w in c for c in low for w in words):
            return kind
    return {"fund_portfolio": "holdings", "company_people": "people", "fund_profile": "text", "company_filing": "text", "fund_basic": "financials"}.get(category or "", "generic")


def without_payload(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.split(".")[-1].lower() in PAYLOAD])


def shown(df: DataFrame, most: int = MOST_ROWS) -> tuple[DataFrame, bool]:
    """The first rows of a result, and whether there are more; one look at one row more decides."""
    more = df.limit(most + 1).count() > most
    return df.limit(most), more


def note(df: DataFrame) -> DataFrame:
    """Over all rows: their number, and ranges of weight, year and the sum of market values where there are such."""
    low = {c.lower(): c for c in df.columns}
    out = [F.count("*").alias("rows")]
    if "weight" in low:
        out += [F.min(low["weight"]).alias("weight_min"), F.max(low["weight"]).alias("weight_max")]
    if "marketvalue" in low:
        out.append(F.sum(low["marketvalue"]).alias("market_value"))
    if "year" in low:
        out += [F.min(low["year"]).alias("year_min"), F.max(low["year"]).alias("year_max")]
    return df.agg(*out)


def with_total(df: DataFrame, label: str, values: list[str]) -> DataFrame:
    """A result and a last row of its sums."""
    total = df.agg(*[F.sum(v).alias(v) for v in values]).withColumn(label, F.lit("Total"))
    return df.unionByName(total, allowMissingColumns=True)


def provenance(paths: dict[str, DataFrame], key: str, date: str = "filing_date") -> DataFrame:
    """Of the documents that each kind of path leads to, the latest for every kind and key."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("path", F.lit(k)) for k, df in sorted(paths.items())])
    last = Window.partitionBy("path", key).orderBy(F.desc_nulls_last(date), "accession")
    return rows.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


# Which follow-up queries a category of question gets, by priority, and the parameters they need.
ENRICHMENT = (
    ("fund_overview", {"fund_basic", "fund_portfolio", "fund_profile"}, "fund", 10),
    ("fund_returns", {"fund_basic"}, "fund", 8),
    ("company_overview", {"company_filing", "company_people"}, "company", 10),
)


def enrichments(category: str, have: set[str]) -> list[str]:
    """Names of the follow-up queries for a category whose parameters are there, the most important first."""
    return [name for name, kinds, need, _ in sorted(ENRICHMENT, key=lambda r: -r[3]) if category in kinds and need in have]


def enriched(category: str, params: dict[str, str], plans: dict[str, Callable[[dict[str, str]], DataFrame]], most: int = MOST_ROWS) -> DataFrame:
    """(name, place, line) of the follow-up queries of a category: each named plan is run with the parameters, and every
    row, without payload and up to ``most`` a plan, comes as a line of JSON. Plans that are not there are passed over."""
    names = [n for n in enrichments(category, {k for k, v in params.items() if v}) if n in plans]
    parts = []
    for place, name in enumerate(names, 1):
        rows = without_payload(plans[name](params)).limit(most)
        parts.append(rows.select(F.lit(name).alias("name"), F.lit(place).alias("place"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("line")))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def context(rows: DataFrame) -> str:
    """The lines of ``enriched`` as text, a heading for each plan; they are few."""
    out, last = [], None
    for r in rows.orderBy("place", "line").collect():
        if r["name"] != last:
            last = r["name"]
            out.append(f"## {last}")
        out.append(f"- {r['line']}")
    return "\n".join(out)
