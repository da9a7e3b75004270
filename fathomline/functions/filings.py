"""Records from filings: prospectuses, shareholder reports, insider reports and proxy statements.

All are column expressions or plans over parsed tables and facts; see ``extract.parse_pages`` for the parsing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathomline.functions import clean, extract

# The anchors between which each provider's prospectus keeps its parts.
ANCHORS = {
    "Vanguard": {"objective": (r"Investment Objective", r"Fees and Expenses"), "strategy": (r"Principal Investment Strategies", r"Principal Risks"), "risks": (r"Principal Risks", r"Annual Total Returns")},
    "BlackRock": {"objective": (r"Investment Objective", r"Fees and Expenses"), "strategy": (r"Principal Investment Strategies", r"Summary of Principal Risks"), "risks": (r"Summary of Principal Risks", r"Performance Information")},
    "Fidelity": {"objective": (r"Investment Objective", r"Fee Table"), "strategy": (r"Principal Investment Strategies", r"Principal Investment Risks"), "risks": (r"Principal Investment Risks", r"Performance")},
}
PAGE_MARK = r"(?im)^\s*(?:page\s+)?\d{1,3}\s*$"
PROVIDER_LOOK = 3000


def text_provider(c: str) -> Column:
    """The provider that the first characters of a prospectus name."""
    return clean.provider(F.substring(F.col(c), 1, PROVIDER_LOOK))


def part(c: str, name: str, provider: Column) -> Column:
    """Objective, strategy or risks of a prospectus by its provider's anchors, without page marks."""
    text = F.regexp_replace(F.coalesce(F.col(c), F.lit("")), PAGE_MARK, "")
    choices = [(p, extract.between(text, *a[name])) for p, a in ANCHORS.items()]
    return reduce(lambda out, x: out.when(provider == x[0], x[1]), choices[1:], F.when(provider == choices[0][0], choices[0][1]))


def fund_name(c: str) -> Column:
    """The line that names the fund: after a summary header, or the first that ends in Fund, ETF or Portfolio."""
    text = F.coalesce(F.col(c), F.lit(""))
    after = F.trim(F.regexp_extract(text, r"(?im)^\s*(?:summary prospectus|fund summary)\s*$\s*^(.{3,120})$", 1))
    named = F.trim(F.regexp_extract(text, r"(?m)^\s*([A-Z][^\n]{2,100}(?:Fund|ETF|Portfolio))\s*$", 1))
    return F.coalesce(F.when(F.length(after) > 0, after), F.when(F.length(named) > 0, named))


def advisor(c: str) -> Column:
    found = F.trim(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"(?i)investment advis[eo]r\s*[:\n]?\s*([A-Z][A-Za-z.,& ]{3,80}?(?:LLC|Inc\.?|Company|Group|Advisors))", 1))
    return F.when(F.length(found) > 0, found)


MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def report_date(c: str) -> Column:
    """The date of a revision if there is one, else the first date."""
    text = F.coalesce(F.col(c), F.lit(""))
    day = f"((?:{MONTHS}) [0-9]{{1,2}}, [0-9]{{4}})"
    revised = F.regexp_extract(text, f"(?i)(?:as revised|as supplemented|revised)\\s+{day}", 1)
    first = F.regexp_extract(text, day, 1)
    return clean.any_date(F.when(F.length(revised) > 0, revised).otherwise(first))


def prospectus(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One record a prospectus, with a status that says what is missing."""
    p = text_provider(text)
    rows = docs.select(
        key,
        p.alias("provider"),
        extract.ticker(text).alias("ticker"),
        fund_name(text).alias("name"),
        *[part(text, n, p).alias(n) for n in ("objective", "strategy", "risks")],
        extract.benchmark_index(text).alias("benchmark"),
        extract.managers(text).alias("managers"),
        extract.expense_ratio(text).alias("expense_ratio"),
        extract.minimum_investment(text).alias("minimum_investment"),
        advisor(text).alias("advisor"),
        report_date(text).alias("report_date"),
    )
    status = F.when(F.col("ticker").isNull(), "failed_no_ticker").when(F.coalesce("objective", "strategy", "risks").isNull(), "failed_extraction").otherwise("success")
    return rows.withColumn("status", status)


def markdown(title: str, parts: list[tuple[str, str]]) -> Column:
    """A record as markdown; parts that are null are left out."""
    return F.concat_ws("\n\n", F.concat(F.lit("# "), F.col(title)), *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"## {name}\n"), F.col(c))) for name, c in parts])


def manager_lines(c: str) -> Column:
    return F.array_join(F.transform(F.col(c), lambda x: F.concat(F.lit("- "), x)), "\n")


# shareholder reports


def funds_of(parsed: DataFrame, key: str, tags: dict[str, str]) -> DataFrame:
    """One row for each context of a report's facts; ``tags``: fact name -> column. The first value of a name holds."""
    facts = parsed.select(key, F.posexplode("facts").alias("n", "f")).select(key, "n", F.col("f.*"))
    named = facts.filter(F.col("name").isin(list(tags)))
    value = lambda tag: F.min_by("value", F.when(F.col("name") == tag, F.col("n")))
    return named.groupBy(key, "context").agg(*[value(t).alias(c) for t, c in tags.items()])


def class_id(context: str) -> Column:
    found = F.regexp_extract(F.col(context), r"(C[0-9]{9})", 1)
    return F.when(F.length(found) > 0, found)


def years_in_header(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Tables whose header holds years: (keys, label, year, value), the years of the row above the values.

    ``rows``: keys, row_no, cells.
    """
    year = F.transform(F.col("cells"), lambda x: F.regexp_extract(x, r"\b((?:19|20)[0-9]{2})\b", 1).try_cast("int"))
    some = rows.withColumn("years", F.when(F.size(F.filter(year, lambda y: y.isNotNull())) >= 1, year))
    head = F.last("years", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1))
    below = some.withColumn("head", head).filter("years IS NULL AND head IS NOT NULL")
    cells = below.select(*keys, F.get("cells", F.lit(0)).alias("label"), F.explode(F.arrays_zip("head", "cells")).alias("z"))
    return cells.filter("z.head IS NOT NULL").select(*keys, "label", F.col("z.head").alias("year"), clean.table_number(F.col("z.cells")).alias("value"))


def years_in_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Tables whose rows begin with a year: (keys, label, year, value), labels from the header row."""
    year = F.regexp_extract(F.get("cells", F.lit(0)), r"^\s*((?:19|20)[0-9]{2})\b", 1).try_cast("int")
    some = rows.withColumn("year", year)
    by = Window.partitionBy(*keys).orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    head = F.last(F.when(F.col("year").isNull(), F.col("cells")), ignorenulls=True).over(by)
    cells = some.withColumn("head", head).filter("year IS NOT NULL").select(*keys, "year", F.posexplode(F.arrays_zip("head", "cells")).alias("n", "z"))
    return cells.filter("n > 0 AND z.head <> ''").select(*keys, F.col("z.head").alias("label"), "year", clean.table_number(F.col("z.cells")).alias("value"))


def zipped(df: DataFrame, keys: list[str], lists: list[str]) -> DataFrame:
    """Ragged lists as rows, shorter ones padded with null; rows of nothing but zeros and blanks are left out."""
    rows = df.select(*keys, F.explode(F.arrays_zip(*lists)).alias("z")).select(*keys, *[F.col(f"z.{c}").alias(c) for c in lists])
    blank = reduce(lambda a, b: a & b, [F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0", "0.0", "0.00") for c in lists])
    return rows.filter(~blank)


def facts_as_table(parsed: DataFrame, key: str) -> DataFrame:
    """Facts as (category, name, value), each once, the largest first: for reports without tables."""
    facts = parsed.select(key, F.explode("facts").alias("f"))
    name = F.regexp_replace(F.regexp_extract("f.name", r"([^:]+)$", 1), r"(?<!^)(?=[A-Z])", " ")
    rows = facts.select(key, F.regexp_extract("f.name", r"^([^:]+):", 1).alias("category"), name.alias("name"), clean.financial_number(F.col("f.value")).alias("value")).dropDuplicates()
    return rows.orderBy(key, F.desc("value"), "name")


def average_returns(rows: DataFrame, keys: list[str], look: int = 8) -> DataFrame:
    """1, 5, 10 year and since-inception returns: the first row of numbers below the first header that names years."""
    header = F.exists("cells", lambda x: x.rlike(r"(?i)\b(one|1)[ -]?year")) & (F.col("row_no") < look)
    by = Window.partitionBy(*keys)
    at = rows.withColumn("head_no", F.min(F.when(header, F.col("row_no"))).over(by))
    at = at.withColumn("head", F.max(F.when(F.col("row_no") == F.col("head_no"), F.col("cells"))).over(by)).filter("row_no > head_no")
    values = F.transform("cells", lambda x: clean.performance(x))
    sound = at.withColumn("values", values).filter(F.exists("values", lambda v: v.isNotNull()))
    first = sound.groupBy(*keys).agg(F.min_by(F.struct("head", "values"), "row_no").alias("m"))

    def pick(pattern: str) -> Column:
        hit = F.filter(F.arrays_zip(F.col("m.head").alias("h"), F.col("m.values").alias("v")), lambda z: z["h"].rlike(pattern))
        return F.get(hit, F.lit(0))["v"]

    return first.select(*keys, pick(r"(?i)\b(one|1)[ -]?year").alias("return_1y"), pick(r"(?i)\b(five|5)[ -]?year").alias("return_5y"), pick(r"(?i)\b(ten|10)[ -]?year").alias("return_10y"), pick(r"(?i)inception").alias("return_inception"))


def sectors(df: DataFrame, column: str) -> DataFrame:
    """Sector names made alike: of the spellings that agree without case and signs, the shortest."""
    key = F.trim(F.regexp_replace(F.lower(F.col(column)), "[^a-z]+", " "))
    rows = df.withColumn("__key", key)
    best = rows.groupBy("__key").agg(F.min_by(column, F.struct(F.length(column), F.col(column))).alias("__best"))
    return rows.join(best, "__key").withColumn(column, F.col("__best")).drop("__key", "__best")


def allocations(df: DataFrame, name: str, weight: str, headers: tuple[str, ...] = ("country", "region", "total", "sector")) -> DataFrame:
    """Allocation rows with a sound weight (-100 to 150), invisible spaces and header rows taken out."""
    bare = F.trim(F.regexp_replace(F.col(name), "[​ ]+", " "))
    rows = df.withColumn(name, bare).withColumn(weight, F.regexp_replace(F.col(weight).cast("string"), r"[%\s]", "").try_cast("double"))
    return rows.filter(F.col(weight).between(-100, 150) & ~F.lower(F.col(name)).isin(*headers) & (F.length(name) > 0))


def moved_allocations(df: DataFrame, countries: DataFrame) -> DataFrame:
    """Sector rows that name a country are region rows: (kind, name, …). The planner broadcasts ``countries`` (name) if it is small."""
    known = countries.select(F.lower("name").alias("__c")).distinct()
    joined = df.join(known, F.lower(F.col("name")) == F.col("__c"), "left")
    return joined.withColumn("kind", F.when(F.col("__c").isNotNull(), "region").otherwise(F.col("kind"))).drop("__c")


def shared_managers(funds: DataFrame) -> DataFrame:
    """Share classes without managers take those of other classes of the same fund (name, managers)."""
    every = F.flatten(F.collect_list("managers").over(Window.partitionBy("name")))
    return funds.withColumn("managers", F.when(F.size("managers") > 0, F.col("managers")).otherwise(F.array_sort(F.array_distinct(every))))


# insider reports and proxy statements


def insider_transactions(rows: DataFrame) -> DataFrame:
    """Transactions in shares proper, with their kind, value and a key of their own.

    ``rows``: ticker, insider, position, date, code, security, shares, price, remaining.
    """
    held = rows.filter(~F.lower(F.coalesce("security", F.lit(""))).rlike("option|warrant|derivative|unit"))
    out = held.withColumn("type", clean.transaction_kind("code")).withColumn("insider", clean.person_name("insider")).withColumn("value", F.col("shares") * F.col("price"))
    return out.withColumn("id", F.concat_ws("_", "ticker", F.replace("insider", F.lit(" "), F.lit("")), "date", "type", "shares"))


def chief_executive(rows: DataFrame, key: str) -> DataFrame:
    """The chief executive of each proxy statement: by role, else by the pay table's name, else from the text; and the
    last fiscal year's end. ``rows``: key, people (name, role), pay_name, text, fiscal_year_end."""
    by_role = F.get(F.filter("people", lambda p: p["role"].rlike(r"(?i)chief executive|\bCEO\b")), F.lit(0))["name"]
    in_text = F.regexp_extract(F.coalesce("text", F.lit("")), r"([A-Z][a-z]+(?: [A-Z]\.)? [A-Z][a-z]+),?\s+(?:our |the )?(?:President and )?(?:Chief Executive Officer|CEO)", 1)
    name = F.coalesce(by_role, clean.blank_to_null("pay_name"), F.when(F.length(in_text) > 0, in_text))
    return rows.groupBy(key).agg(F.max_by(clean.person_name(name), F.when(name.isNotNull(), F.coalesce("fiscal_year_end", F.lit("")))).alias("name"), F.max("fiscal_year_end").alias("fiscal_year_end"))


def holdings_table(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Holdings as the eighteen columns of the portfolio table; codes get their descriptions from a small fixed table."""
    c = F.col
    joined = rows.join(categories.withColumnsRenamed({"code": "asset_category", "name": "asset_category_desc"}), "asset_category", "left")
    return joined.select(
        "name", *[clean.blank_to_null(x).alias(x) for x in ("ticker",)], F.when(clean.cusip_valid("cusip"), c("cusip")).alias("cusip"), *[clean.blank_to_null(x).alias(x) for x in ("isin", "lei")],
        *[c(x).cast("decimal(38,6)").alias(x) for x in ("shares", "market_value", "weight_pct")], "currency", "asset_category", "asset_category_desc", "issuer_category", "issuer_category_desc", "country", "payoff_profile",
        (F.upper("is_restricted") == "Y").alias("is_restricted"), "fair_value_level", "sector",
    )


def markdown_table(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Rows of each key as one markdown table."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("l")))), lambda x: x["l"]), "\n")
    return rows.groupBy(*keys).agg(F.concat(F.lit(head + "\n"), body).alias("content"))


def chunk_title(c: str) -> Column:
    """The first line of a chunk without page marks such as S-12."""
    line = F.get(F.split(F.regexp_replace(F.col(c), r"\bS-\d+\b", ""), "\n"), F.lit(0))
    return F.trim(F.substring(line, 1, 80))


def corpus_sample(chunks: DataFrame, per_label: int = 30, least: int = 200, most: int = 1500) -> DataFrame:
    """Of each label the first chunks that are long enough, cut to ``most`` characters. ``chunks``: id, label, text."""
    rows = chunks.filter(F.length("text") > least)
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy("label").orderBy("id"))).filter(F.col("__n") <= per_label)
    return ranked.select("id", "label", F.substring("text", 1, most).alias("text"))


def named_chunk(name: str, text: str) -> Column:
    """A chunk's text with its fund's name in front, unless it names it."""
    return F.when(F.contains(F.col(text), F.col(name)), F.col(text)).otherwise(F.concat(F.lit("Fund: "), F.col(name), F.lit("\n"), F.col(text)))
