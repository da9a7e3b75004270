"""Pulling fields out of filings: column expressions for running text, a parser in Arrow batches for HTML."""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def squeeze(c) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"\s+", " "))


def between(c, start: str, end: str) -> Column:
    """The text between two anchors (regular expressions), single-spaced; null where an anchor is missing."""
    c = F.col(c) if isinstance(c, str) else c
    found = F.regexp_extract(c, f"(?is){start}\\s*(.*?)\\s*{end}", 1)
    return F.when(F.length(found) > 0, squeeze(found))


def first_section(c, header: str) -> Column:
    """The part of a text before the second time its header comes."""
    parts = F.split(F.col(c), header)
    return F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))


# Capital words that are no tickers.
NOT_TICKERS = (
    "SEC", "CFA", "USA", "BID", "LLC", "INC", "IRA", "NAV", "ETF", "NYSE", "ARCA", "CBOE", "BZX", "NASDAQ", "USD", "EUR", "GBP",
    "SUM", "PRO", "S&P", "MSCI", "FTSE", "RUSSELL", "ICE", "FAX", "TEL",
)
TICKER_PATTERNS = (r"(?i:ticker(?: symbol)?)\s*:?\s*\(?([A-Z]{2,6})\b", r"\(([A-Z]{3,5})\)", r"(?i:exchange)\s*:\s*([A-Z]{3,5})\b", r"\b([A-Z]{4,5}X)\b", r"\b([A-Z]{3,5})\b")


def ticker(c) -> Column:
    """The first candidate of the first pattern that has one; capital words that are none are passed over."""
    c = F.coalesce(F.col(c), F.lit(""))
    return F.coalesce(*[F.get(F.filter(F.regexp_extract_all(c, F.lit(p), F.lit(1)), lambda t: ~t.isin(*NOT_TICKERS)), F.lit(0)) for p in TICKER_PATTERNS])


BENCHMARK_PATTERNS = (r"((?:S&P|MSCI|FTSE|CRSP|Bloomberg|Russell|Dow Jones|NASDAQ)[A-Za-z0-9&.\- ]{2,60}? Index)",)


def benchmark_index(c) -> Column:
    """Of all index names in a text the shortest, then the first in order."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(p), F.lit(1)) for p in BENCHMARK_PATTERNS]))
    return F.coalesce(F.array_min(F.transform(found, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"], F.lit("Unknown Benchmark"))


ROLES = r"(?i)(,? ?(Portfolio Manager|Principal|Managing Director|Head of|Senior|Vice President|Co-).*)$"


def managers(c) -> Column:
    """Names of two to five words before a role, one a line, each once in order."""
    lines = F.split(F.coalesce(F.col(c), F.lit("")), r"\n+")
    named = F.transform(F.filter(lines, lambda x: x.rlike(ROLES)), lambda x: F.trim(F.regexp_replace(x, ROLES, "")))
    return F.array_distinct(F.filter(named, lambda x: F.size(F.split(x, " ")).between(2, 5)))


def expense_ratio(c) -> Column:
    return F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"(?is)total annual (?:fund )?operating expenses\D{0,40}?([0-9]+\.[0-9]+)\s*%", 1).try_cast("double")


def minimum_investment(c) -> Column:
    text = F.coalesce(F.col(c), F.lit(""))
    pattern = r"(?is)minimum (?:initial )?investment\D{0,60}\$\s*([0-9][0-9,]*\.?[0-9]*)\s*(million|billion)?"
    number = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("double")
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    return number * F.when(unit == "million", 1e6).when(unit == "billion", 1e9).otherwise(1.0)


def section_header(c) -> Column:
    """Item and title of an annual report's section."""
    c = F.coalesce(F.col(c), F.lit(""))
    pattern = r"(?im)^\s*item\s+([0-9]{1,2}[A-C]?)\.?\s*[-–—:.]?\s*(.{3,80})$"
    return F.struct(F.regexp_extract(c, pattern, 1).alias("item"), F.trim(F.regexp_extract(c, pattern, 2)).alias("title"))


# Ordered rules that name a table by words of its header.
TABLE_KINDS = (("average annual", "average_returns"), ("annual total return", "average_returns"), ("growth of", "performance"), ("hypothetical", "performance"), ("sector", "sector_allocation"), ("industry", "sector_allocation"), ("country", "geographic_allocation"), ("region", "geographic_allocation"), ("geographic", "geographic_allocation"), ("top ten", "top_holdings"), ("top 10", "top_holdings"), ("holdings", "top_holdings"), ("credit", "credit_quality"), ("maturity", "maturity"), ("cost of", "expenses"), ("expense", "expenses"), ("net assets", "statistics"), ("turnover", "statistics"))


def table_kind(header) -> Column:
    """What a table holds, by the first rule that its header fits."""
    h = F.lower(F.coalesce(F.col(header) if isinstance(header, str) else header, F.lit("")))
    out = F.when(F.contains(h, F.lit(TABLE_KINDS[0][0])), TABLE_KINDS[0][1])
    for words, kind in TABLE_KINDS[1:]:
        out = out.when(F.contains(h, F.lit(words)), kind)
    return out.otherwise("other")


def income_statement(facts: DataFrame, noise=("srt:ConsolidationItemsAxis",)) -> DataFrame:
    """One row a concept and period: the first undimensioned value, and the dimensioned ones as segments.

    ``facts``: concept, period, row, dimension (boolean), axis, member, value.
    """
    whole = F.min_by("value", F.when(~F.col("dimension"), F.col("row"))).alias("value")
    own = F.col("dimension") & ~F.coalesce(F.col("axis"), F.lit("")).isin(*noise)
    segment = F.when(own, F.struct(F.col("row"), F.col("axis"), F.col("member"), F.col("value")))
    return facts.groupBy("concept", "period").agg(whole, F.sort_array(F.collect_list(segment)).alias("segments"))


def mapped_metrics(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Concepts to properties, the concept of highest priority winning; gross profit from its parts where it is missing.

    ``facts``: period, concept, value. ``mapping``: concept, property, priority (the planner broadcasts it if it is small).
    """
    best = facts.join(mapping, "concept").groupBy("period", "property").agg(F.max_by("value", F.struct("priority", "concept")).alias("value"))
    wide = best.groupBy("period").pivot("property", ["revenue", "cost", "gross_profit", "operating_income", "net_income"]).agg(F.first("value"))
    return wide.withColumn("gross_profit", F.coalesce("gross_profit", F.col("revenue") - F.col("cost")))


class _Page(HTMLParser):
    """Title, links, visible text, tables and inline XBRL facts of a page."""

    HIDDEN = {"script", "style", "noscript", "ix:header"}
    BLOCK = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "table", "ul", "ol", "section", "article"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.text, self.tables, self.facts = "", [], [], [], []
        self.hidden, self.in_title, self.row, self.cell, self.open_facts = 0, False, None, None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []
        elif tag in ("ix:nonfraction", "ix:nonnumeric", "ix:continuation"):
            self.open_facts.append({"name": a.get("name", ""), "context": a.get("contextref", ""), "id": a.get("id", ""), "next": a.get("continuedat", ""), "scale": a.get("scale", ""), "sign": a.get("sign", ""), "parts": []})
        if tag in self.BLOCK:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in ("td", "th") and self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row is not None and self.tables:
            self.tables[-1].append(self.row)
            self.row = None
        elif tag in ("ix:nonfraction", "ix:nonnumeric", "ix:continuation") and self.open_facts:
            self.facts.append(self.open_facts.pop())
        if tag in self.BLOCK:
            self.text.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.text.append(data)
            for f in self.open_facts:
                f["parts"].append(data)
            if self.cell is not None:
                self.cell.append(data)


MOST_HOPS = 50


def parse_page(source: str | None) -> dict:
    page = _Page()
    page.feed(source or "")
    page.close()
    lines = (" ".join(x.split()) for x in "".join(page.text).split("\n"))
    more = {f["id"]: f for f in page.facts if f["id"]}
    facts = []
    for f in page.facts:
        if not f["name"]:
            continue
        value, at, hops = "".join(f["parts"]), f["next"], 0
        while at in more and hops < MOST_HOPS:  # a value may go on elsewhere
            value += "".join(more[at]["parts"])
            at, hops = more[at]["next"], hops + 1
        facts.append({"name": f["name"], "context": f["context"], "value": " ".join(value.split()), "scale": f["scale"], "sign": f["sign"]})
    return {"title": " ".join(html.unescape(page.title).split()), "links": page.links, "text": "\n".join(x for x in lines if x), "tables": page.tables, "facts": facts}


PARSED = "title string, links array<string>, text string, tables array<array<array<string>>>, facts array<struct<name:string,context:string,value:string,scale:string,sign:string>>"


def parse_pages(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """Title, links, text, tables and inline facts of each page; HTML needs a parser, so this runs in Python batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [parse_page(s) for s in frame[column]]
            yield pd.DataFrame({key: frame[key], **{k: [r[k] for r in rows] for k in ("title", "links", "text", "tables", "facts")}})

    return pages.select(key, column).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, {PARSED}")


def table_rows(parsed: DataFrame, key: str) -> DataFrame:
    """Tables as rows: the table's number, the row's number, its first cell as label and the rest as values; rows whose
    values are all zero or blank are left out."""
    rows = parsed.select(key, F.posexplode("tables").alias("table_no", "t")).select(key, "table_no", F.posexplode("t").alias("row_no", "cells"))
    out = rows.select(key, "table_no", "row_no", F.get("cells", F.lit(0)).alias("label"), F.slice("cells", 2, 1000).alias("values"))
    return out.filter(F.exists("values", lambda v: ~F.regexp_replace(v, r"[$%,.\s0()—–-]", "").isin("")))
