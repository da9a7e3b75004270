"""All queries of the library by name, with the SQL each must agree with.

Queries of the graph language are text over the graph of ``plans.fixture``; the others are plans by the DataFrame API.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fathomline.functions import clean, extract, filings, fuzzy
from fathomline.functions.chunk import word_windows
from fathomline.models import classify, embed
from fathomline.operators import evaluate, ingest, match, post, retrieve, upsert
from fathomline.plans.fixture import FundGraph
from fathomline.plans.language.compile import Compiler
from fathomline.plans.language.parse import parse
from fathomline.plans.rules import rewrite
from fathomline.sources import filings as source_filings, vectors
from fathomline.sources.tables import table
from fathomline.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def graph_query(name: str, text: str, sql: str, casts: dict[str, str] | None = None, rewrites: bool = False, **params) -> None:
    """Registers a query of the graph language; ``casts`` fixes column types that engines count differently."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph, tree = FundGraph(spark, sf_dir).graph(), parse(text)
        if rewrites:
            tree, _ = rewrite(tree, params=params)
        df = Compiler(graph, dict(params)).run(tree)
        return df.withColumns({c: F.col(c).cast(t) for c, t in (casts or {}).items()})

    QUERIES[name], SQL[name] = run, sql


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


def frame_query(sql: str | None = None):
    """Registers a function of the tables as a query."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


HIGHLIGHT = "SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, round_even(sum(o_totalprice), 2) AS net, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2"

# scans, predicates, projections

graph_query(
    "fund_overview",
    "MATCH (p:Provider)-[:MANAGES]->(t:Trust)-[:ISSUES]->(f:Fund) OPTIONAL MATCH (f)-[r:HAS_FINANCIAL_HIGHLIGHT]->(h:FinancialHighlight) WHERE r.year = 1997 RETURN f.ticker AS ticker, f.name AS fund, t.name AS trust, p.name AS provider, r.year AS year, h.numberHoldings AS holdings",
    f"WITH h AS ({HIGHLIGHT}) SELECT c_custkey AS ticker, c_name AS fund, n_name AS trust, r_name AS provider, h.year, h.n AS holdings FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN h ON h.o_custkey = c_custkey AND h.year = 1997",
    {"year": "int"},
)
graph_query("label_scan", "MATCH (n:Company) RETURN n.ticker AS ticker, n.name AS name", "SELECT s_suppkey AS ticker, s_name AS name FROM supplier")
graph_query("inline_eq", "MATCH (f:Fund {shareClass: 'BUILDING'}) RETURN f.ticker AS ticker", "SELECT c_custkey AS ticker FROM customer WHERE c_mktsegment = 'BUILDING'")
graph_query("in_list", "MATCH (f:Fund) WHERE f.shareClass IN ['BUILDING', 'MACHINERY'] AND f.balance >= 100 RETURN f.ticker AS ticker, f.shareClass AS cls", "SELECT c_custkey AS ticker, c_mktsegment AS cls FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 100")
graph_query("contains_ci", "MATCH (h:Holding) WHERE toLower(h.category) CONTAINS 'omo' RETURN h.nodeId AS id", "SELECT p_partkey AS id FROM part WHERE contains(lower(p_type), 'omo')")
graph_query("starts_ends", "MATCH (h:Holding) WHERE h.category STARTS WITH 'S' OR h.category ENDS WITH 'R' RETURN h.nodeId AS id", "SELECT p_partkey AS id FROM part WHERE starts_with(p_type, 'S') OR ends_with(p_type, 'R')")
graph_query("null_guard_sort", "MATCH (f:Fund) OPTIONAL MATCH (f)-[r:HAS_FINANCIAL_HIGHLIGHT]->(h:FinancialHighlight) WHERE r.year = 1995 WITH f, h WHERE h.netAssets IS NOT NULL RETURN f.ticker AS ticker, h.netAssets AS net ORDER BY net DESC, ticker LIMIT 20", f"WITH h AS ({HIGHLIGHT}) SELECT o_custkey AS ticker, net FROM h WHERE year = 1995 AND net IS NOT NULL ORDER BY net DESC, ticker LIMIT 20")
graph_query("nulls_largest", "MATCH (f:Fund) OPTIONAL MATCH (f)-[r:HAS_FINANCIAL_HIGHLIGHT]->(h:FinancialHighlight) WHERE r.year = 1996 RETURN f.ticker AS ticker, h.netAssets AS net ORDER BY net DESC, ticker LIMIT 30", f"WITH h AS ({HIGHLIGHT}) SELECT c_custkey AS ticker, net FROM customer LEFT JOIN h ON o_custkey = c_custkey AND year = 1996 ORDER BY net DESC NULLS FIRST, ticker LIMIT 30")
graph_query("exists_semi", "MATCH (f:Fund) WHERE EXISTS { MATCH (f)-[:HAS_PORTFOLIO]->(p:Portfolio) WHERE p.status = 'P' } RETURN f.ticker AS ticker", "SELECT c_custkey AS ticker FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
graph_query("not_exists_anti", "MATCH (f:Fund) WHERE NOT EXISTS { MATCH (f)-[r:HAS_FINANCIAL_HIGHLIGHT]->(h:FinancialHighlight) WHERE r.year = 1998 } RETURN f.ticker AS ticker", "SELECT c_custkey AS ticker FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1998)")
graph_query("pattern_predicate", "MATCH (c:Company) WHERE NOT (c)<-[:REPRESENTS]-(:Holding {nodeId: 3}) RETURN c.ticker AS ticker", "SELECT s_suppkey AS ticker FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey = 3)")
graph_query("multi_label", "MATCH (s:Section:RiskFactor) WHERE size(s.text) > 200 RETURN s.id AS id, s.sectionType AS source", "SELECT CAST(doc_id AS VARCHAR) AS id, source FROM documents WHERE lang = 'en' AND length(text) > 200")
graph_query("label_predicate", "MATCH (s:Section) WHERE 'Strategy' IN labels(s) RETURN s.title AS lang, count(*) AS n", "SELECT lang, count(*) AS n FROM documents WHERE lang <> 'en' OR lang IS NULL GROUP BY lang", {"n": "long"})
graph_query("case_div_guard", "MATCH (h:Holding) RETURN h.nodeId AS id, CASE WHEN h.size > 0 THEN h.price / h.size ELSE null END AS unit, CASE WHEN h.size > 25 THEN 'large' WHEN h.size > 10 THEN 'middle' ELSE 'small' END AS band", "SELECT p_partkey AS id, CASE WHEN p_size > 0 THEN p_retailprice / p_size END AS unit, CASE WHEN p_size > 25 THEN 'large' WHEN p_size > 10 THEN 'middle' ELSE 'small' END AS band FROM part")
graph_query("coalesce_parent", "MATCH (f:Fund) OPTIONAL MATCH (f)-[r:HAS_FINANCIAL_HIGHLIGHT]->(h:FinancialHighlight) WHERE r.year = 1994 RETURN f.ticker AS ticker, coalesce(h.numberHoldings, 0) AS n", f"WITH h AS ({HIGHLIGHT}) SELECT c_custkey AS ticker, coalesce(n, 0) AS n FROM customer LEFT JOIN h ON o_custkey = c_custkey AND year = 1994", {"n": "long"})
graph_query("date_parts", "MATCH (p:Portfolio) WHERE date(p.date).year = 1996 AND p.date >= date('1996-06-01') RETURN p.seriesId AS id, date(p.date).month AS month", "SELECT o_orderkey AS id, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders WHERE year(o_orderdate) = 1996 AND o_orderdate >= DATE '1996-06-01'", {"month": "int"})
graph_query("params", "MATCH (f:Fund)-[:HAS_PORTFOLIO]->(p:Portfolio) WHERE f.shareClass = $cls AND p.total > $least RETURN f.ticker AS ticker, p.seriesId AS id", "SELECT c_custkey AS ticker, o_orderkey AS id FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'AUTOMOBILE' AND o_totalprice > 200000", cls="AUTOMOBILE", least=200000)
graph_query("structured_filter", "MATCH (f:Fund)-[r:HAS_FINANCIAL_HIGHLIGHT]->(h:FinancialHighlight) WHERE h.netAssets >= 300000 AND h.numberHoldings <= 4 RETURN f.ticker AS ticker, r.year AS year, h.netAssets AS net ORDER BY net DESC, ticker, year LIMIT 10", f"WITH h AS ({HIGHLIGHT}) SELECT o_custkey AS ticker, year, net FROM h WHERE net >= 300000 AND n <= 4 ORDER BY net DESC, ticker, year LIMIT 10", {"year": "int"})

# traversals

graph_query("multi_hop_join", "MATCH (f:Fund)-[:HAS_PORTFOLIO]->(p:Portfolio)-[w:HAS_HOLDING]->(h:Holding)-[:OF_CATEGORY]->(a:AssetCategory) WHERE h.size = 7 RETURN f.ticker AS ticker, p.seriesId AS portfolio, h.nodeId AS holding, a.code AS category, w.shares AS shares", "SELECT o_custkey AS ticker, o_orderkey AS portfolio, p_partkey AS holding, p_type AS category, l_quantity AS shares FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size = 7")
graph_query("incoming_hop", "MATCH (t:Trust)<-[:MANAGES]-(p:Provider) RETURN t.name AS trust, p.name AS provider", "SELECT n_name AS trust, r_name AS provider FROM nation JOIN region ON n_regionkey = r_regionkey")
graph_query("undirected_hop", "MATCH (t:Trust)-[:MANAGES]-(p:Provider {name: 'ASIA'}) RETURN t.name AS trust", "SELECT n_name AS trust FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
graph_query("edge_types", "MATCH (f:Fund)-[r:HAS_PORTFOLIO|HAS_SHARE_CLASS]->(x) RETURN type(r) AS kind, count(*) AS n", "SELECT 'HAS_PORTFOLIO' AS kind, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'HAS_SHARE_CLASS', count(*) FROM customer", {"n": "long"})
graph_query("untyped_hop", "MATCH (f:Fund {shareClass: 'FURNITURE'})-[r]->(x) RETURN type(r) AS kind, count(*) AS n", "WITH f AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE') SELECT 'HAS_PORTFOLIO' AS kind, count(*) AS n FROM orders JOIN f ON o_custkey = c_custkey UNION ALL SELECT 'HAS_SHARE_CLASS', count(*) FROM f UNION ALL SELECT 'HAS_FINANCIAL_HIGHLIGHT', count(*) FROM (SELECT DISTINCT o_custkey, year(o_orderdate) FROM orders JOIN f ON o_custkey = c_custkey)", {"n": "long"})
graph_query("cross_domain", "MATCH (pr:Provider)-[:MANAGES]->(t:Trust)-[:ISSUES]->(f:Fund)-[:HAS_PORTFOLIO]->(p:Portfolio)-[w:HAS_HOLDING]->(h:Holding)-[:REPRESENTS]->(c:Company) WHERE h.size < 3 RETURN pr.name AS provider, count(DISTINCT c) AS companies, sum(w.shares) AS shares", "WITH rep AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT r_name AS provider, count(DISTINCT rep.l_suppkey) AS companies, sum(l.l_quantity) AS shares FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem l ON l.l_orderkey = o_orderkey JOIN part ON p_partkey = l.l_partkey JOIN rep ON rep.l_partkey = p_partkey JOIN supplier ON s_suppkey = rep.l_suppkey WHERE p_size < 3 GROUP BY 1", {"companies": "long"})
graph_query("same_edge_once", "MATCH (a:Trust)<-[:MANAGES]-(p:Provider)-[:MANAGES]->(b:Trust) RETURN a.name AS a, b.name AS b", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
graph_query("optional_pattern", "MATCH (t:Trust) OPTIONAL MATCH (t)-[:ISSUES]->(f:Fund)-[:HAS_PORTFOLIO]->(p:Portfolio) WHERE p.total > 440000 RETURN t.name AS trust, f.ticker AS ticker, p.seriesId AS portfolio", "WITH m AS (SELECT c_nationkey, c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 440000) SELECT n_name AS trust, c_custkey AS ticker, o_orderkey AS portfolio FROM nation LEFT JOIN m ON c_nationkey = n_nationkey")

# aggregates, sets, order

graph_query("provider_funds", "MATCH (p:Provider)-[:MANAGES]->(t:Trust) OPTIONAL MATCH (t)-[:ISSUES]->(f:Fund) RETURN p.name AS provider, count(DISTINCT t) AS trusts, count(DISTINCT f) AS funds", "SELECT r_name AS provider, count(DISTINCT n_nationkey) AS trusts, count(DISTINCT c_custkey) AS funds FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1", {"trusts": "long", "funds": "long"})
graph_query("collect_tickers", "MATCH (s:ShareClass)<-[:HAS_SHARE_CLASS]-(f:Fund) RETURN s.name AS cls, collect(DISTINCT f.ticker) AS tickers", "SELECT c_mktsegment AS cls, list_sort(list(DISTINCT c_custkey)) AS tickers FROM customer GROUP BY 1")
graph_query("list_size", "MATCH (s:ShareClass)<-[:HAS_SHARE_CLASS]-(f:Fund) WITH s, collect(f.ticker) AS tickers RETURN s.name AS cls, size(tickers) AS n", "SELECT c_mktsegment AS cls, count(*) AS n FROM customer GROUP BY 1", {"n": "long"})
graph_query("holding_lookup", "CALL db.index.fulltext.queryNodes('holding_name', 'widgat~') YIELD node, score RETURN node.nodeId AS id, score", "SELECT p_partkey AS id, 1.0 / (1 + min(levenshtein(w, 'widgat'))) AS score FROM part, unnest(string_split(lower(p_name), ' ')) AS u(w) GROUP BY 1 HAVING min(levenshtein(w, 'widgat')) <= 2", {"score": "double"})
graph_query("agg_measures", "MATCH (p:Portfolio)-[w:HAS_HOLDING]->(h:Holding) RETURN h.sector AS sector, count(*) AS n, min(w.shares) AS least, max(w.shares) AS most, sum(w.shares) AS total, avg(w.shares) AS mean", "SELECT p_brand AS sector, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most, sum(l_quantity) AS total, avg(l_quantity) AS mean FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1", {"n": "long"})
graph_query("with_having", "MATCH (f:Fund)-[:HAS_PORTFOLIO]->(p:Portfolio) WITH f, count(p) AS n WHERE n > 15 RETURN f.ticker AS ticker, f.name AS name, n AS portfolios", "SELECT c_custkey AS ticker, c_name AS name, count(*) AS portfolios FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 HAVING count(*) > 15", {"portfolios": "long"})
graph_query("list_average", "MATCH (h:Holding) WHERE h.size < 5 RETURN h.nodeId AS id, avg([h.size, h.price]) AS mean", "SELECT p_partkey AS id, (p_size + p_retailprice) / 2 AS mean FROM part WHERE p_size < 5")
graph_query("distinct_return", "MATCH (f:Fund)-[:HAS_PORTFOLIO]->(p:Portfolio) RETURN DISTINCT f.shareClass AS cls, p.status AS status", "SELECT DISTINCT c_mktsegment AS cls, o_orderstatus AS status FROM customer JOIN orders ON o_custkey = c_custkey")
graph_query("top_holdings", "MATCH (p:Portfolio)-[w:HAS_HOLDING]->(h:Holding) RETURN p.seriesId AS portfolio, h.nodeId AS holding, w.marketValue AS value ORDER BY value DESC, portfolio, holding LIMIT 10", "SELECT o_orderkey AS portfolio, p_partkey AS holding, l_extendedprice AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey ORDER BY value DESC, portfolio, holding LIMIT 10")
graph_query("skip_limit", "MATCH (f:Fund) RETURN f.ticker AS ticker, f.balance AS balance ORDER BY balance, ticker SKIP 40 LIMIT 25", "SELECT c_custkey AS ticker, c_acctbal AS balance FROM customer ORDER BY balance, ticker LIMIT 25 OFFSET 40")
graph_query("union_distinct", "MATCH (t:Trust) RETURN t.name AS name UNION MATCH (p:Provider) RETURN p.name AS name", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
graph_query("unwind_in", "UNWIND ['BUILDING', 'HOUSEHOLD', 'NONE'] AS cls MATCH (f:Fund) WHERE f.shareClass = cls RETURN cls AS cls, count(f) AS n", "SELECT c_mktsegment AS cls, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD') GROUP BY 1", {"n": "long"})
graph_query("rewritten_direction", "MATCH (f:Fund)<-[:HAS_PORTFOLIO]-(p:Portfolio) WHERE toFloat(p.total) > 350000 RETURN f.ticker AS ticker, p.seriesId AS id", "SELECT c_custkey AS ticker, o_orderkey AS id FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 350000", rewrites=True)
graph_query("rewritten_provider", "MATCH (f:Fund {ticker: 7}) RETURN f.name AS name", "SELECT c_name AS name, r_name AS provider, n_name AS trust FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey = 7", rewrites=True)
graph_query("rewritten_distinct", "MATCH (t:Trust)-[:ISSUES]->(f:Fund)-[:HAS_SHARE_CLASS]->(s:ShareClass) RETURN t.name AS trust, s.name AS cls", "SELECT DISTINCT n_name AS trust, c_mktsegment AS cls FROM customer JOIN nation ON c_nationkey = n_nationkey", rewrites=True)


@frame_query("SELECT 'customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders")
def label_counts(t):
    parts = [t(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("label"), "n") for n in ("customer", "supplier", "part", "orders")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# windows


@frame_query("WITH y AS (SELECT o_custkey AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY 1, 2), g AS (SELECT ticker, year, round_even((v / lag(v) OVER (PARTITION BY ticker ORDER BY year) - 1) * 100, 2) AS pct FROM y) SELECT * FROM g WHERE pct IS NOT NULL")
def annual_returns(t):
    by = Window.partitionBy("ticker").orderBy("year")
    last = F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("v")
    y = t("orders").groupBy(F.col("o_custkey").alias("ticker"), F.year("o_orderdate").alias("year")).agg(last)
    return y.select("ticker", "year", F.bround((F.col("v") / F.lag("v").over(by) - 1) * 100, 2).alias("pct")).filter("pct IS NOT NULL")


@frame_query("SELECT o_custkey AS ticker, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1")
def latest_per_key(t):
    return t("orders").groupBy(F.col("o_custkey").alias("ticker")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@frame_query("SELECT text_key, doc_id FROM (SELECT md5(text) AS text_key, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def first_per_key(t):
    return t("documents").groupBy(F.md5("text").alias("text_key")).agg(F.min("doc_id").alias("doc_id"))


@frame_query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS top, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) WHERE n <= 5 AND l_extendedprice >= top - 5000 AND top >= 30000")
def topk_band(t):
    by = Window.partitionBy("l_orderkey")
    rows = t("lineitem").withColumn("top", F.max("l_extendedprice").over(by)).withColumn("n", F.row_number().over(by.orderBy(F.desc("l_extendedprice"), "l_linenumber")))
    return rows.filter("n <= 5 AND l_extendedprice >= top - 5000 AND top >= 30000").select("l_orderkey", "l_linenumber", "l_extendedprice")


@frame_query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def last_n_messages(t):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return t("conversations").withColumn("n", n).filter("n <= 3").select("conv_id", "turn", "role")


@frame_query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, avg(length(text)) AS mean_length FROM conversations GROUP BY 1")
def session_stats(t):
    return t("conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"), F.avg(F.length("text")).alias("mean_length"))


CHUNKS = "SELECT doc_id, CAST(s / 48 AS INTEGER) AS chunk_index, md5(array_to_string(list_slice(w, CAST(s AS INTEGER) + 1, CAST(s AS INTEGER) + 64), ' ')) AS digest FROM (SELECT doc_id, w, unnest(generate_series(0, greatest(0, CAST(ceil((len(w) - 64) / 48.0) AS BIGINT)) * 48, 48)) AS s FROM (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents))"


@frame_query(CHUNKS)
def chunk_windows(t):
    rows = word_windows(t("documents").select("doc_id", "text"), "text", 64, 48)
    return rows.select("doc_id", F.col("chunkIndex").alias("chunk_index"), F.md5("chunk").alias("digest"))


@frame_query("SELECT lang, avg(length(text)) AS mean, min(length(text)) AS least, max(length(text)) AS most, quantile_cont(length(text), 0.25) AS p25, quantile_cont(length(text), 0.75) AS p75 FROM documents GROUP BY 1")
def chunk_length_stats(t):
    n = F.length("text").cast("long")
    return t("documents").groupBy("lang").agg(F.avg(n).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"), F.percentile(n, 0.25).alias("p25"), F.percentile(n, 0.75).alias("p75"))


# cleaning and extraction

NUMBERS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '(' || c_acctbal || '%)' WHEN c_custkey % 3 = 1 THEN '$' || c_acctbal ELSE 'n/a' END AS raw FROM customer"


@frame_query(f"SELECT id, coalesce(CASE WHEN starts_with(raw, '(') OR starts_with(raw, '-') THEN -1.0 ELSE 1.0 END * TRY_CAST(nullif(regexp_extract(raw, '([0-9][0-9,]*\\.?[0-9]*|\\.[0-9]+)', 1), '') AS DOUBLE), 0.0) AS value FROM ({NUMBERS})")
def clean_number(t):
    k, v = F.col("c_custkey"), F.col("c_acctbal").cast("string")
    raw = F.when(k % 3 == 0, F.concat(F.lit("("), v, F.lit("%)"))).when(k % 3 == 1, F.concat(F.lit("$"), v)).otherwise("n/a")
    return t("customer").select(F.col("c_custkey").alias("id"), clean.financial_number(raw).alias("value"))


@frame_query("SELECT s_suppkey AS id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(s_name || ' & Co, Holdings Inc.'), '[^a-z0-9 ]+', ' ', 'g'), '\\b(the|and)\\b', ' ', 'g'), '\\b(inc|incorporated|corp|corporation|co|company|ltd|limited|plc|llc|lp|sa|nv|ag|group|holdings|holding|class a|class b|class c)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM supplier")
def norm_company(t):
    return t("supplier").select(F.col("s_suppkey").alias("id"), clean.company_name(F.concat("s_name", F.lit(" & Co, Holdings Inc."))).alias("name"))


@frame_query("SELECT c_custkey AS id, regexp_replace(trim(regexp_replace('Mary  J. ' || c_name || ' Jr.', '\\s+', ' ', 'g')), '\\b([A-Z])\\. ', '\\1 ', 'g') AS name FROM customer")
def norm_person(t):
    return t("customer").select(F.col("c_custkey").alias("id"), clean.person_name(F.concat(F.lit("Mary  J. "), "c_name", F.lit(" Jr."))).alias("name"))


@frame_query("SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title>\\s*(.*?)\\s*</title>', 1), '\\s+', ' ', 'g')), '') AS title FROM pages")
def extract_between(t):
    return t("pages").select("page_id", extract.between("html", "<title>", "</title>").alias("title"))


@frame_query("SELECT s_suppkey AS id, TRY_CAST(d AS DATE) AS day FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '1997-0' || (1 + s_suppkey % 9) || '-15' ELSE '2020-13-01' END AS d FROM supplier)")
def date_ladder(t):
    k = F.col("s_suppkey")
    iso = F.concat(F.lit("1997-0"), (1 + k % 9).cast("string"), F.lit("-15"))
    us = F.concat(F.lit("0"), (1 + k % 9).cast("string"), F.lit("/15/1997"))
    raw = F.when(k % 4 == 0, iso).when(k % 4 == 2, us).otherwise("2020-13-01")
    return t("supplier").select(k.alias("id"), clean.any_date(raw).alias("day"))


@frame_query("SELECT p_brand, round_even(100.0 * sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part), 2) AS pct FROM part GROUP BY 1")
def segment_pct(t):
    total = Window.partitionBy(F.lit(1))
    by = t("part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("v"))
    return by.select("p_brand", clean.percent_of(F.col("v"), F.sum("v").over(total)).alias("pct"))


@frame_query("SELECT l_orderkey, round_even(CASE WHEN sum(l_extendedprice) <> 0 THEN sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice) END, 4) AS margin, round_even(CASE WHEN sum(l_quantity * l_tax) <> 0 THEN sum(l_tax) / sum(l_quantity * l_tax) END, 4) AS rate FROM lineitem GROUP BY 1")
def margins(t):
    by = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.expr("l_extendedprice * (1 - l_discount)")).alias("net"), F.sum("l_extendedprice").alias("gross"), F.sum("l_tax").alias("tax"), F.sum(F.expr("l_quantity * l_tax")).alias("base"))
    return by.select("l_orderkey", clean.ratio("net", "gross").alias("margin"), clean.ratio("tax", "base").alias("rate"))


@frame_query("SELECT conv_id, turn, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '… [' || (length(text) - 40) || ' more chars]' ELSE text END AS shown FROM conversations")
def capped_text(t):
    return t("conversations").select("conv_id", "turn", clean.capped("text", 40).alias("shown"))


@frame_query("SELECT count(*) AS n, count_if(NOT regexp_matches(c_name, '^[A-Z]{1,6}$'))::BIGINT AS no_ticker, count_if(length(c_name) < 5)::BIGINT AS short_name, count_if(c_acctbal < 0)::BIGINT AS negative, count_if(c_mktsegment IS NULL OR trim(c_mktsegment) = '')::BIGINT AS no_class FROM customer")
def dq_report(t):
    c = F.col
    return t("customer").agg(F.count("*").alias("n"), F.count_if(~c("c_name").rlike("^[A-Z]{1,6}$")).alias("no_ticker"), F.count_if(F.length("c_name") < 5).alias("short_name"), F.count_if(c("c_acctbal") < 0).alias("negative"), F.count_if(c("c_mktsegment").isNull() | (F.trim("c_mktsegment") == "")).alias("no_class"))


@frame_query("SELECT c_custkey AS id, list_filter([CASE WHEN c_acctbal < 0 THEN 'balance below zero' END, CASE WHEN c_acctbal > 9000 THEN 'balance very high' END, CASE WHEN c_nationkey IN (1, 2) THEN 'check trust' END], lambda x: x IS NOT NULL) AS warnings FROM customer")
def sanity_warnings(t):
    c = F.col
    rules = F.array(F.when(c("c_acctbal") < 0, "balance below zero"), F.when(c("c_acctbal") > 9000, "balance very high"), F.when(c("c_nationkey").isin(1, 2), "check trust"))
    return t("customer").select(c("c_custkey").alias("id"), F.filter(rules, lambda x: x.isNotNull()).alias("warnings"))


@frame_query("SELECT page_id, len(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)) AS links FROM pages")
def html_links(t):
    return extract.parse_pages(t("pages")).select("page_id", F.size("links").cast("long").alias("links"))


@frame_query()
def html_text(t):
    parsed = extract.parse_pages(t("pages"))
    return parsed.select("page_id", "title", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@frame_query("SELECT sector_key, min(name) AS shortest FROM (SELECT p_brand AS sector_key, p_type AS name, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_type), p_type) AS n FROM part) WHERE n = 1 GROUP BY 1")
def shortest_name(t):
    return t("part").groupBy(F.col("p_brand").alias("sector_key")).agg(F.min_by("p_type", F.struct(F.length("p_type"), "p_type")).alias("shortest"))


@frame_query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'US' || p_partkey WHEN p_partkey % 3 = 1 THEN 'cusip_' || (100000000 + p_partkey) ELSE 'gen_' || substr(md5(p_name || '|' || p_brand), 1, 16) END AS node_id FROM part")
def holding_ids(t):
    k = F.col("p_partkey")
    rows = t("part").withColumn("isin", F.when(k % 3 == 0, F.concat(F.lit("US"), k.cast("string"))).otherwise("nan")).withColumn("cusip", F.when(k % 3 == 1, (100000000 + k).cast("string")).otherwise(" "))
    return rows.select(k.alias("id"), clean.holding_id("isin", "cusip", "p_name", "p_brand").alias("node_id"))


# upserts


@frame_query("SELECT c_custkey, coalesce(n.name, c.c_name) AS c_name, coalesce(n.bal, c.c_acctbal) AS c_acctbal FROM (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 5 <> 0) c FULL JOIN (SELECT s_suppkey AS c_custkey, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS bal FROM supplier) n USING (c_custkey)")
def merge_upsert(t):
    old = t("customer").filter("c_custkey % 5 <> 0").select("c_custkey", "c_name", "c_acctbal")
    new = t("supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("c_acctbal"))
    return upsert.merge(old, new, ["c_custkey"])


@frame_query("SELECT l_partkey, sum(l_quantity) AS l_quantity, sum(l_extendedprice) AS l_extendedprice, arg_min(l_returnflag, l_orderkey * 100 + l_linenumber) AS l_returnflag FROM lineitem GROUP BY 1")
def holdings_dedup(t):
    # lines with the same numbers come as they lie in the files
    at = F.struct("_metadata.file_path", "_metadata.row_index").alias("at")
    rows = t("lineitem").select("l_partkey", F.expr("l_orderkey * 100 + l_linenumber").alias("row"), at, "l_quantity", "l_extendedprice", "l_returnflag")
    return upsert.collapse_holdings(rows, "l_partkey", ["l_quantity", "l_extendedprice"], "row", "at")


@frame_query("SELECT l_orderkey, l_linenumber, round_even(100 * l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 4) AS weight FROM lineitem")
def portfolio_weight(t):
    total = F.sum("l_extendedprice").over(Window.partitionBy("l_orderkey"))
    return t("lineitem").select("l_orderkey", "l_linenumber", F.bround(100 * F.col("l_extendedprice") / total, 4).alias("weight"))


@frame_query(f"WITH h AS ({HIGHLIGHT}), s AS (SELECT c_custkey, unnest([1995, 1996]) AS year, c_acctbal AS net FROM customer) SELECT coalesce(h.o_custkey, s.c_custkey) AS ticker, CAST(coalesce(h.year, s.year) AS INTEGER) AS year, coalesce(h.net, s.net, 0.0) AS net FROM h FULL JOIN s ON h.o_custkey = s.c_custkey AND h.year = s.year")
def highlights_fill(t):
    rows = t("orders").groupBy(F.col("o_custkey").alias("ticker"), F.year("o_orderdate").alias("year")).agg(F.bround(F.sum("o_totalprice"), 2).alias("net"))
    stubs = t("customer").select(F.col("c_custkey").alias("ticker"), F.explode(F.array(F.lit(1995), F.lit(1996))).alias("year"), F.col("c_acctbal").alias("net"))
    return upsert.fill_years(rows, stubs, ["ticker", "year"], ["net"])


@frame_query("SELECT c_custkey AS ticker, c_name AS name FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def delete_keys(t):
    gone = t("customer").join(t("nation").filter("n_regionkey = 0"), F.col("c_nationkey") == F.col("n_nationkey"))
    return upsert.delete(t("customer").select(F.col("c_custkey").alias("ticker"), F.col("c_name").alias("name")), gone.select(F.col("c_custkey").alias("ticker")), ["ticker"])


@frame_query("SELECT o_custkey AS ticker, o_orderkey AS accession, o_orderdate AS report_date FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def newest_filing(t):
    rows = t("orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderkey").alias("accession"), F.col("o_orderdate").alias("report_date"))
    return upsert.first_per_ticker(rows)


# retrieval

QUERY_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def query_vector(t) -> list[float]:
    return [float(x) for x in t("embeddings").filter("vec_id = 0").first()["embedding"]]


@frame_query(f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({QUERY_VECTOR} AS DOUBLE[])), 5) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding, {QUERY_VECTOR}) DESC, vec_id LIMIT 10")
def knn_cosine(t):
    return retrieve.knn(t("embeddings"), query_vector(t), 10).select("vec_id", F.round("score", 5).alias("score"))


@frame_query(f"SELECT vec_id, label FROM (SELECT vec_id, label FROM embeddings ORDER BY list_cosine_similarity(embedding, {QUERY_VECTOR}) DESC, vec_id LIMIT 50) WHERE label IN (1, 2, 3)")
def knn_postfilter(t):
    return retrieve.knn(t("embeddings"), query_vector(t), 50).filter("label IN (1, 2, 3)").select("vec_id", "label")


@frame_query(f"SELECT vec_id FROM embeddings ORDER BY list_cosine_similarity(embedding, {QUERY_VECTOR}) DESC, vec_id LIMIT 5")
def knn_filter_fallback(t):
    q = query_vector(t)
    none = retrieve.knn(t("embeddings").filter("label = -1"), q, 5)
    return retrieve.with_fallback(none, retrieve.knn(t("embeddings"), q, 5)).select("vec_id")


@frame_query(f"SELECT label, round(max(s), 5) AS score FROM (SELECT label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({QUERY_VECTOR} AS DOUBLE[])) AS s, row_number() OVER (PARTITION BY label % 3 ORDER BY list_cosine_similarity(embedding, {QUERY_VECTOR}) DESC, vec_id) AS n FROM embeddings) WHERE n <= 20 GROUP BY 1")
def hybrid_max(t):
    q = query_vector(t)
    searches = [retrieve.knn(t("embeddings").filter(F.col("label") % 3 == i), q, 20) for i in range(3)]
    return retrieve.hybrid(searches, "label").select("label", F.round("score", 5).alias("score"))


@frame_query(f"WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY list_cosine_similarity(embedding, {QUERY_VECTOR}) DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 20), b AS (SELECT vec_id, row_number() OVER (ORDER BY list_dot_product(embedding, {QUERY_VECTOR}) DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 20) SELECT vec_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1")
def rrf_fusion(t):
    v = t("embeddings")
    q = F.array(*[F.lit(x) for x in query_vector(t)])
    top = lambda c: v.withColumn("s", c).orderBy(F.desc("s"), "vec_id").limit(20).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "vec_id")))
    fused = retrieve.rrf(top(retrieve.cosine("embedding", q)), top(retrieve.dot("embedding", q)), key="vec_id")
    return fused.select("vec_id", F.round("score", 9).alias("score"))


@frame_query("WITH q AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding, e.embedding) AS score FROM q JOIN embeddings e ON true), r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def knn_queries(t):
    v = t("embeddings")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieve.knn_join(q, v, 5).select("query_id", "vec_id", "rank")


@frame_query("WITH q AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, q.label AS want, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding, e.embedding) DESC, e.vec_id) AS rank FROM q JOIN embeddings e ON e.vec_id <> q.vec_id), f AS (SELECT query_id, min(rank) FILTER (WHERE label = want) AS rank FROM s GROUP BY 1) SELECT avg(CAST(rank <= 1 AS DOUBLE)) AS hit_1, avg(CAST(rank <= 3 AS DOUBLE)) AS hit_3, avg(CAST(rank <= 5 AS DOUBLE)) AS hit_5, avg(CAST(rank <= 10 AS DOUBLE)) AS hit_10, avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0.0 END) AS mrr FROM f")
def hit_mrr_at_k(t):
    v = t("embeddings").select("vec_id", "embedding", "label")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("want"))
    near = retrieve.knn_join(q, v, 11).filter("query_id <> vec_id").join(v.select("vec_id", "label"), "vec_id")  # itself and ten others
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    hit = near.withColumn("place", place).filter("place <= 10").join(q.select("query_id", "want"), "query_id").filter("label = want").groupBy("query_id").agg(F.min("place").alias("rank"))
    return evaluate.hits(q.select("query_id").join(hit, "query_id", "left").select("query_id", F.coalesce("rank", F.lit(11)).alias("rank")))


@frame_query(f"SELECT round(avg(s), 5) AS mean, round(stddev_pop(s), 5) AS sd, round(quantile_cont(s, 0.05), 5) AS p5, round(quantile_cont(s, 0.95), 5) AS p95 FROM (SELECT list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({QUERY_VECTOR} AS DOUBLE[])) AS s FROM embeddings)")
def similarity_stats(t):
    q = F.array(*[F.lit(x) for x in query_vector(t)])
    s = t("embeddings").select(retrieve.cosine("embedding", q).alias("s"))
    return s.agg(F.round(F.avg("s"), 5).alias("mean"), F.round(F.stddev_pop("s"), 5).alias("sd"), F.round(F.percentile("s", 0.05), 5).alias("p5"), F.round(F.percentile("s", 0.95), 5).alias("p95"))


@frame_query("WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS t FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM w a JOIN w b ON a.item_id < b.item_id AND len(list_intersect(a.t, b.t)) > 0")
def jaccard_overlap(t):
    w = t("benchmark").select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))).alias("t"))
    one = w.select("item_id", F.size("t").alias("n"), F.explode("t").alias("word"))
    a, b = one.select(F.col("item_id").alias("a"), F.col("n").alias("x"), "word"), one.select(F.col("item_id").alias("b"), F.col("n").alias("y"), "word")
    shared = a.join(b, "word").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("k"), F.first("x").alias("x"), F.first("y").alias("y"))
    return shared.select("a", "b", F.round(F.col("k") / (F.col("x") + F.col("y") - F.col("k")), 6).alias("jaccard"))


BM25 = "WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS a, count_if(list_contains(t, 'the')) AS d0, count_if(list_contains(t, 'token')) AS d1 FROM d), c AS (SELECT doc_id, len(t) AS l, len(list_filter(t, lambda x: x = 'the')) AS c0, len(list_filter(t, lambda x: x = 'token')) AS c1 FROM d) SELECT doc_id, round(ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * c0 * 2.2 / (c0 + 1.2 * (0.25 + 0.75 * l / a)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * c1 * 2.2 / (c1 + 1.2 * (0.25 + 0.75 * l / a)), 6) AS score FROM c, s WHERE c0 > 0 OR c1 > 0 ORDER BY score DESC, doc_id LIMIT 15"


@frame_query(BM25)
def bm25_topk(t):
    docs = t("documents").select(F.col("doc_id").alias("__id"), "text")
    return retrieve.bm25(docs, "the token", 15).select(F.col("__id").alias("doc_id"), F.round("score", 6).alias("score"))


@frame_query("WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS w FROM documents), f AS (SELECT w, count(*) AS n FROM d GROUP BY 1) SELECT doc_id, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) AS uniqueness FROM d JOIN f USING (w) GROUP BY 1")
def lexical_uniqueness(t):
    d = t("documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1)))).alias("w"))
    f = d.groupBy("w").agg(F.count("*").alias("n"))
    return d.join(f, "w").groupBy("doc_id").agg(F.round(F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0)), 6).alias("uniqueness"))


@frame_query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def corpus_dedup(t):
    return t("documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("text")


@frame_query()
def mmr_diverse(t):
    v = t("embeddings")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = retrieve.knn_join(q, v, 10).join(v.select("vec_id", "embedding"), "vec_id").select("query_id", "vec_id", "score", "embedding")
    return retrieve.mmr(near, 4)


# fuzzy joins


@frame_query()
def fuzzy_ratio_topk(t):
    names = t("supplier").select(F.col("s_suppkey").alias("name_id"), F.col("s_name").alias("name"))
    queries = t("nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("Supplier "), "n_name").alias("query"))
    return match.top_matches(queries, names, 40.0, 5).select("query_id", "name_id", F.round("score", 4).alias("score"), "rank")


@frame_query("SELECT c_custkey AS left_id, s_suppkey AS right_id, CAST(13.0 / 18 AS DOUBLE) AS score, 'wide' AS stage FROM customer JOIN supplier ON regexp_extract(c_name, '[0-9]+') = regexp_extract(s_name, '[0-9]+')")
def blocked_match(t):
    left = t("customer").select(F.col("c_custkey").alias("left_id"), F.col("c_name").alias("name"))
    right = t("supplier").select(F.col("s_suppkey").alias("right_id"), F.col("s_name").alias("name"))
    return match.cascade(left, right, 0.7)


@frame_query()
def token_set(t):
    w = t("part").select("p_partkey", "p_name", "p_type")
    return w.select("p_partkey", F.round(fuzzy.token_set_ratio(F.lower("p_name"), F.lower("p_type")), 4).alias("token_set"), F.round(fuzzy.partial_ratio(F.lower("p_name"), F.lower("p_type")), 4).alias("partial"))


@frame_query("SELECT c.c_custkey AS id, min(s.s_suppkey) AS match FROM customer c JOIN supplier s ON regexp_extract(c.c_name, '[0-9]+') = regexp_extract(s.s_name, '[0-9]+') GROUP BY 1")
def equal_match(t):
    digits = lambda c: F.regexp_extract(c, "[0-9]+", 0)
    left = t("customer").select(F.col("c_custkey").alias("left_id"), digits("c_name").alias("name"))
    right = t("supplier").select(F.col("s_suppkey").alias("right_id"), digits("s_name").alias("name"))
    return match.equal_then_contained(left, right).filter("stage = 'equal'").select(F.col("left_id").alias("id"), F.col("right_id").alias("match"))


# evaluation and what follows a result

GUESS = "SELECT doc_id, list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS truth, list_filter([CASE WHEN n_chars > 500 THEN 'good' END, CASE WHEN contains(lower(text), 'stupid') OR contains(lower(text), 'idiot') THEN 'toxic' END], lambda x: x IS NOT NULL) AS guess FROM labels JOIN documents USING (doc_id)"


def guesses(t) -> DataFrame:
    rows = t("labels").join(t("documents"), "doc_id")
    some = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    rude = F.contains(F.lower("text"), F.lit("stupid")) | F.contains(F.lower("text"), F.lit("idiot"))
    return rows.select("doc_id", some(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")).alias("truth"), some(F.when(F.col("n_chars") > 500, "good"), F.when(rude, "toxic")).alias("guess"))


@frame_query(f"WITH g AS ({GUESS}), l AS (SELECT unnest(['good', 'toxic']) AS label), c AS (SELECT label, count_if(list_contains(truth, label))::BIGINT AS s, count_if(list_contains(guess, label))::BIGINT AS p, count_if(list_contains(truth, label) AND list_contains(guess, label))::BIGINT AS h FROM l, g GROUP BY 1) SELECT label, h / p AS precision, h / s AS recall, 2 * (h / p) * (h / s) / (h / p + h / s) AS f1, s AS support FROM c")
def clf_report(t):
    return evaluate.label_report(guesses(t))


@frame_query(f"WITH g AS ({GUESS}) SELECT x AS truth_label, y AS guess_label, count(*) AS n FROM (SELECT unnest(truth) AS x, guess FROM g), unnest(guess) AS u(y) GROUP BY 1, 2")
def confusion(t):
    return evaluate.overlap_matrix(guesses(t))


@frame_query(f"WITH g AS ({GUESS}) SELECT avg(CAST(len(list_filter(truth, lambda x: NOT list_contains(guess, x))) + len(list_filter(guess, lambda x: NOT list_contains(truth, x))) = 0 AS DOUBLE)) AS exact_match, avg(CAST(len(list_filter(truth, lambda x: NOT list_contains(guess, x))) = 0 AS DOUBLE)) AS superset, sum(len(list_filter(truth, lambda x: NOT list_contains(guess, x))) + len(list_filter(guess, lambda x: NOT list_contains(truth, x)))) / (count(*) * 2.0) AS hamming FROM g")
def label_summary(t):
    return evaluate.label_summary(guesses(t), 2)


@frame_query("WITH r AS (SELECT event_type <> 'error' AS ok, user_id % 3 AS retries, value FROM events) SELECT count(*) AS n, avg(CAST(ok AS DOUBLE)) AS accuracy, avg(CAST(ok AND retries = 0 AS DOUBLE)) AS first_attempt, avg(CAST(retries > 0 AS DOUBLE)) AS retry_rate, quantile_cont(value, 0.5) AS p50_ms, quantile_cont(value, 0.95) AS p95_ms FROM r")
def benchmark_summary(t):
    runs = t("events").select((F.col("event_type") != "error").alias("success"), (F.col("user_id") % 3).alias("retry_attempts"), F.lit(1.0).alias("count_ratio"), F.lit(True).alias("schema_adherent"), F.col("value").alias("execution_time_ms"))
    return evaluate.run_summary(runs).drop("count_ratio", "schema_rate")


@frame_query("SELECT 'purchase' AS path, user_id, arg_max(event_id, (ts, -event_id)) AS accession FROM events WHERE event_type = 'purchase' GROUP BY user_id UNION ALL SELECT 'signup', user_id, arg_max(event_id, (ts, -event_id)) FROM events WHERE event_type = 'signup' GROUP BY user_id")
def provenance_latest(t):
    part = lambda k: t("events").filter(F.col("event_type") == k).select("user_id", F.col("event_id").alias("accession"), F.col("ts").alias("filing_date"))
    return post.provenance({"purchase": part("purchase"), "signup": part("signup")}, "user_id").select("path", "user_id", "accession")


@frame_query("SELECT count(*) AS rows, min(l_discount) AS weight_min, max(l_discount) AS weight_max, sum(l_extendedprice) AS market_value, CAST(min(year(l_shipdate)) AS INTEGER) AS year_min, CAST(max(year(l_shipdate)) AS INTEGER) AS year_max FROM lineitem")
def truncate_stats(t):
    return post.note(t("lineitem").select(F.col("l_discount").alias("weight"), F.col("l_extendedprice").alias("marketValue"), F.year("l_shipdate").alias("year")))


@frame_query("WITH t AS (SELECT p_name AS name, p_retailprice AS price FROM part ORDER BY price DESC, name LIMIT 10) SELECT name, price FROM t UNION ALL SELECT 'Total', sum(price) FROM t")
def totals_row(t):
    top = t("part").select(F.col("p_name").alias("name"), F.col("p_retailprice").alias("price")).orderBy(F.desc("price"), "name").limit(10)
    return post.with_total(top, "name", ["price"])


# filings, ingestion, models


@frame_query("SELECT id, lang AS label, substr(text, 1, 1500) AS text FROM (SELECT doc_id AS id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents WHERE length(text) > 200) WHERE n <= 30")
def corpus_sample(t):
    return filings.corpus_sample(t("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "text"))


@frame_query("SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'ETF' WHEN c_mktsegment = 'MACHINERY' THEN 'INSTITUTIONAL' ELSE 'OTHER' END AS cls, count(*) AS n FROM customer GROUP BY 1")
def share_classes(t):
    label = F.when(F.col("c_mktsegment") == "BUILDING", "Some ETF Shares").when(F.col("c_mktsegment") == "MACHINERY", "Institutional Shares").otherwise(F.col("c_mktsegment"))
    return t("customer").groupBy(clean.share_class(label).alias("cls")).agg(F.count("*").alias("n"))


@frame_query("SELECT user_id || '_' || event_type || '_' || event_id AS id, CASE WHEN event_type = 'purchase' THEN 'Purchase' WHEN event_type = 'signup' THEN 'Award' ELSE 'Other' END AS type, value * 2 AS value FROM events WHERE event_type <> 'error'")
def insider_values(t):
    code = F.when(F.col("event_type") == "purchase", "P").when(F.col("event_type") == "signup", "a").otherwise("?")
    security = F.when(F.col("event_type") == "error", "Stock Option").otherwise("Common Stock")
    rows = t("events").select(F.lit("X").alias("ticker"), F.lit("A B").alias("insider"), "event_id", "event_type", "user_id", code.alias("code"), security.alias("security"), F.lit("d").alias("date"), F.col("value").alias("shares"), F.lit(2.0).alias("price"))
    return filings.insider_transactions(rows).select(F.concat_ws("_", "user_id", "event_type", "event_id").alias("id"), "type", "value")


@frame_query("SELECT p_brand, '| p_name | p_size |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || p_name || ' | ' || p_size || ' |', chr(10) ORDER BY p_partkey) AS content FROM part GROUP BY 1")
def markdown_tables(t):
    return filings.markdown_table(t("part"), ["p_brand"], "p_partkey", ["p_name", "p_size"])


@frame_query("SELECT c_nationkey, CASE WHEN len(m) > 0 THEN m ELSE a END AS managers, c_custkey FROM (SELECT c_custkey, c_nationkey, m, list_sort(list_distinct(flatten(list(m) OVER (PARTITION BY c_nationkey)))) AS a FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN [c_mktsegment] ELSE [] END AS m FROM customer))")
def shared_managers(t):
    m = F.when(F.col("c_custkey") % 4 == 0, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>"))
    rows = t("customer").select("c_custkey", F.col("c_nationkey").alias("name"), m.alias("managers"))
    return filings.shared_managers(rows).withColumnRenamed("name", "c_nationkey")


@frame_query("SELECT o_custkey AS ticker, o_orderpriority AS name, CAST(year(o_orderdate) AS INTEGER) AS year, arg_max(o_totalprice, o_orderkey) AS weight FROM orders GROUP BY 1, 2, 3")
def allocation_upsert(t):
    rows = t("orders").groupBy(F.col("o_custkey").alias("ticker"), F.col("o_orderpriority").alias("name"), F.year("o_orderdate").alias("year")).agg(F.max_by("o_totalprice", "o_orderkey").alias("weight"))
    target = ingest.allocation_target("sector")
    once = ingest.ingest(rows, [target])
    return ingest.ingest(rows, [target], once)[target.name]


@frame_query("WITH w AS (SELECT o_custkey AS ticker, o_orderpriority AS name, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3) SELECT ticker, name, arg_max(v, y) AS weight, CAST(max(y) AS INTEGER) AS year FROM w GROUP BY 1, 2")
def allocation_latest(t):
    rows = t("orders").groupBy(F.col("o_custkey").alias("ticker"), F.col("o_orderpriority").alias("name"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("weight"))
    return ingest.latest(rows, ["ticker", "name"], "weight")


@frame_query("WITH f AS (SELECT o_custkey AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS whole FROM orders GROUP BY 1, 2), s AS (SELECT o_custkey AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS label, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3) SELECT ticker, year, label, value, CASE WHEN whole > 0 THEN round_even(100.0 * value / whole, 2) END AS percentage FROM s JOIN f USING (ticker, year)")
def metric_segments(t):
    by = t("orders").groupBy(F.col("o_custkey").alias("ticker"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("label")).agg(F.sum("o_totalprice").alias("value"))
    whole = t("orders").groupBy(F.col("o_custkey").alias("ticker"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("value"))
    facts = by.groupBy("ticker", "year").agg(F.collect_list(F.struct("label", "value")).alias("segments")).join(whole, ["ticker", "year"]).withColumn("label", F.lit("Revenue"))
    return ingest.metrics(facts)["Segment"].select("ticker", "year", "label", "value", "percentage")


@frame_query("WITH d AS (SELECT item_id, regexp_extract_all(lower(text), '([a-z]{2,})', 1) AS w FROM benchmark), b AS (SELECT item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM d), tf AS (SELECT item_id, term, count(*) AS tf FROM b GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), r AS (SELECT item_id, term, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)) SELECT item_id, count(*) AS terms, round(max(w) / sqrt(sum(w * w)), 6) AS top FROM r GROUP BY 1")
def tf_idf_terms(t):
    w = embed.tf_idf(t("benchmark"), "item_id", "text")
    return w.groupBy("item_id").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 6).alias("top"))


@frame_query()
def tf_idf_pairs(t):
    w = embed.tf_idf(t("benchmark"), "item_id", "text")
    return embed.alike(w, "item_id").select("a", "b", F.round("similarity", 6).alias("similarity"))


@frame_query("SELECT conv_id, turn, list_filter([CASE WHEN regexp_matches(lower(text), 'holding|portfolio|sector|allocation|weight|region|invests? in|exposure') THEN 'fund_portfolio' END, CASE WHEN regexp_matches(lower(text), '\\bceo\\b|compensation|insider|executive|chief') THEN 'company_people' END], lambda x: x IS NOT NULL) AS labels FROM conversations")
def rule_labels(t):
    rows = t("conversations").select("conv_id", "turn", classify.rule_labels("text").alias("l"))
    return rows.select("conv_id", "turn", F.filter("l", lambda x: x.isin("fund_portfolio", "company_people")).alias("labels"))


@frame_query()
def classifier_guess(t):
    rows = t("documents").select("doc_id", F.col("text"), F.array("lang").alias("labels"))
    model = classify.Classifier.train(rows, ("en", "de", "fr", "es"))
    return model.predict(rows.select("doc_id", "text")).select("doc_id", "guess")


@frame_query()
def embedded_chunks(t):
    return embed.embed(t("benchmark"), "text", prefix="Question:").select("item_id", "embedding")


LETTERS = "upper(translate(substr(md5(c_name), 1, 4), '0123456789', 'ghijklmnop'))"


@frame_query(f"SELECT c_custkey AS id, {LETTERS} AS ticker FROM customer WHERE {LETTERS} NOT IN ('NYSE', 'ARCA', 'CBOE', 'MSCI', 'FTSE')")
def ticker_pattern(t):
    word = F.upper(F.translate(F.substring(F.md5("c_name"), 1, 4), "0123456789", "ghijklmnop"))
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("THE FUND for INC. Ticker Symbol: "), word, F.lit(" (NYSE)")).alias("text"), word.alias("w"))
    return rows.filter(~F.col("w").isin("NYSE", "ARCA", "CBOE", "MSCI", "FTSE")).select("id", extract.ticker("text").alias("ticker"))


@frame_query("SELECT s_suppkey AS id, 'compare [fund] with [ticker] in ' || s_nationkey AS intent FROM supplier")
def intent_norm(t):
    text = F.concat(F.lit("compare Growth Index Fund with VTI in "), F.col("s_nationkey").cast("string"))
    return t("supplier").select(F.col("s_suppkey").alias("id"), clean.intent(text).alias("intent"))


@frame_query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'Vanguard' WHEN n_nationkey % 3 = 1 THEN 'BlackRock' ELSE 'Other' END AS provider, CAST(n_nationkey AS DOUBLE) * CASE WHEN n_nationkey % 3 = 0 THEN 1e6 ELSE 1 END AS assets FROM nation")
def provider_units(t):
    k = F.col("n_nationkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("VANGUARD "), "n_name")).when(k % 3 == 1, F.concat("n_name", F.lit(" iShares Trust"))).otherwise(F.col("n_name"))
    rows = t("nation").select(k.alias("id"), clean.provider(name).alias("provider"))
    return rows.select("id", "provider", clean.in_units(F.col("id").cast("double"), F.col("provider")).alias("assets"))


@frame_query("SELECT p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN 'sector_allocation' WHEN p_type = 'SMALL' THEN 'top_holdings' ELSE 'other' END AS kind FROM part")
def table_kinds(t):
    header = F.when(F.col("p_type") == "PROMO", "Sector Diversification").when(F.col("p_type") == "SMALL", "Top Ten Holdings").otherwise("Notes")
    return t("part").select(F.col("p_partkey").alias("id"), extract.table_kind(header).alias("kind"))


@frame_query("SELECT s_suppkey AS query_id, 'company' AS kind, s_suppkey AS name_id, CAST(100 AS DOUBLE) AS score FROM supplier")
def entity_tickers(t):
    firms = t("supplier").select(F.col("s_suppkey").alias("name_id"), F.col("s_name").alias("name"), F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"))
    asked = firms.select(F.col("name_id").alias("query_id"), F.concat(F.lit("what is "), F.col("ticker"), F.lit("'s turnover?")).alias("query"))
    none = firms.limit(0)
    return match.resolve(asked, none, firms, none.select("name_id", "name")).select("query_id", "kind", "name_id", "score")


@frame_query()
def entity_resolve(t):
    firms = t("supplier").select(F.col("s_suppkey").alias("name_id"), F.concat(F.lit("Acme "), F.regexp_extract("s_name", "[1-9][0-9]*$", 0), F.lit(" Widgets Inc")).alias("name"), F.lit("NONE").alias("ticker"))
    funds = t("nation").select(F.col("n_nationkey").cast("long").alias("name_id"), F.concat("n_name", F.lit(" Index Fund")).alias("name"), F.lit("NONE").alias("ticker"))
    houses = t("region").select(F.col("r_regionkey").cast("long").alias("name_id"), F.initcap("r_name").alias("name"))
    trusts = t("nation").select(F.col("n_nationkey").cast("long").alias("name_id"), F.concat(F.initcap("n_name"), F.lit(" Trust")).alias("name"))
    asked = firms.select(F.col("name_id").alias("query_id"), F.concat(F.lit("annual revenue of "), F.regexp_replace("name", "Widgets Inc", "Wigets")).alias("query"))
    asked = asked.unionByName(t("region").select((F.col("r_regionkey") - 100).cast("long").alias("query_id"), F.concat(F.lit("funds managed by "), F.lower("r_name")).alias("query")))
    return match.resolve(asked, funds, firms, houses, trusts).select("query_id", "kind", "name_id", F.round("score", 4).alias("score"))


# filings


def filing_table(t) -> DataFrame:
    """Orders as filings: customers are registrants, the priority tells the form."""
    form = F.when(F.col("o_orderpriority") == "1-URGENT", "10-K").when(F.col("o_orderpriority") == "2-HIGH", "10-K/A").when(F.col("o_orderpriority") == "3-MEDIUM", "DEF 14A").otherwise("4")
    day = F.to_date("o_orderdate")
    return t("orders").select(F.col("o_orderkey").cast("string").alias("accession"), F.col("o_custkey").alias("cik"), F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("ticker"), form.alias("form"), day.alias("filing_date"), day.alias("report_date"))


FILED = "SELECT CAST(o_orderkey AS VARCHAR) AS accession, o_custkey AS cik, 'T' || o_custkey AS ticker, CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '10-K/A' WHEN '3-MEDIUM' THEN 'DEF 14A' ELSE '4' END AS form, CAST(o_orderdate AS DATE) AS filed FROM orders"


@frame_query(f"SELECT accession, form, filed FROM ({FILED}) WHERE ticker = 'T7' AND CAST(filed AS VARCHAR) LIKE '199%'")
def filings_by_ticker(t):
    return source_filings.listed(filing_table(t), ticker="t7", year="199").select("accession", "form", F.col("filing_date").alias("filed"))


@frame_query(f"SELECT accession, ticker FROM ({FILED}) WHERE cik = 12 AND form = '10-K'")
def filings_by_cik(t):
    return source_filings.listed(filing_table(t), cik="0000000012", form="10-K").select("accession", "ticker")


@frame_query(f"SELECT ticker, form, filed FROM ({FILED}) WHERE accession = '42'")
def filing_by_accession(t):
    return source_filings.listed(filing_table(t), accession="4-2").select("ticker", "form", F.col("filing_date").alias("filed"))


@frame_query(f"WITH f AS ({FILED}), n AS (SELECT *, row_number() OVER (PARTITION BY ticker, form ORDER BY filed DESC, accession) AS k FROM f WHERE form IN ('10-K', 'DEF 14A')) SELECT accession, ticker, form FROM n WHERE k = 1 UNION ALL SELECT accession, ticker, form FROM f WHERE form = '4' AND filed <= DATE '1997-06-30'")
def company_filings(t):
    return source_filings.company_filings(filing_table(t), "1997-06-30").select("accession", "ticker", "form")


@frame_query("WITH f AS (SELECT doc_id, text, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE source END AS found, CASE WHEN length(text) > 400 THEN left(text, 20) END AS rec FROM documents), b AS (SELECT *, CASE WHEN text IS NULL OR length(text) = 0 THEN 'error' WHEN found IS NULL THEN 'failed_no_ticker' WHEN rec IS NULL THEN 'failed_extraction' END AS bad FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY found, bad IS NULL ORDER BY doc_id DESC) AS k FROM b) SELECT doc_id AS accession, found AS ticker, CASE WHEN bad IS NULL AND k = 1 THEN rec END AS record, coalesce(bad, CASE WHEN k = 1 THEN 'success' ELSE 'aborted' END) AS status FROM r")
def filing_status(t):
    rows = t("documents").select(F.col("doc_id").alias("accession"), F.col("doc_id").alias("report_date"), "text", "source")
    # the text carries the registrant, as a filing's header does
    rows = rows.withColumn("text", F.when(F.length("text") > 0, F.concat("source", F.lit("|"), "text")).otherwise(F.col("text")))
    head, body = F.substring_index("text", "|", 1), F.expr("substring(text, locate('|', text) + 1)")
    parsed = source_filings.parsed(rows, F.when(F.col("accession") % 10 != 0, head), F.when(F.length(body) > 400, F.struct(F.substring(body, 1, 20).alias("r"))))
    return parsed.select("accession", "ticker", F.col("record.r").alias("record"), "status")


@frame_query("WITH p AS (SELECT DISTINCT l_orderkey AS accession, l_suppkey AS ticker FROM lineitem), f AS (SELECT *, first_value(accession) OVER (PARTITION BY ticker ORDER BY accession DESC) AS newest FROM p), b AS (SELECT *, min(CASE WHEN newest = accession THEN 1 ELSE 0 END) OVER (PARTITION BY accession) AS fresh FROM f) SELECT accession, ticker FROM b WHERE fresh = 1")
def filings_unseen(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("accession"), F.col("l_suppkey").alias("ticker"), F.col("l_orderkey").alias("report_date")).distinct()
    return source_filings.without_seen(rows).select("accession", "ticker")


@frame_query("WITH f AS (SELECT o_orderkey AS accession, o_custkey AS cik, o_orderpriority AS ticker, o_orderdate AS d FROM orders), n AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY cik ORDER BY d DESC, accession) - 1) / 2) AS INTEGER) AS batch, row_number() OVER (PARTITION BY cik, ticker ORDER BY d DESC, accession) AS again FROM f), s AS (SELECT *, min(CASE WHEN again > 1 THEN batch END) OVER (PARTITION BY cik) AS stop FROM n) SELECT accession, cik, batch FROM s WHERE stop IS NULL OR batch <= stop + 1")
def filings_in_batches(t):
    rows = t("orders").select(F.col("o_orderkey").alias("accession"), F.col("o_custkey").alias("cik"), F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").alias("report_date"))
    return source_filings.in_batches(rows, 2, 1).select("accession", "cik", "batch")


# names and entities


@frame_query("SELECT a.p_partkey AS id, max(b.p_brand) AS series_id FROM part a JOIN (SELECT p_brand, split_part(p_name, ' ', 1) AS w FROM part) b ON contains(lower(a.p_name), b.w) GROUP BY 1")
def series_by_name(t):
    reports = t("part").select(F.split("p_name", " ")[0].alias("fund_name"), F.col("p_brand").alias("series_id"), F.col("p_brand").alias("row"))
    return match.with_series(t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), reports).select("id", "series_id").filter("series_id IS NOT NULL")


@frame_query("WITH r AS (SELECT p_partkey AS id, p_brand AS k, CASE WHEN p_partkey % 7 = 0 THEN 'nan' ELSE lower(p_type) END AS h, CASE WHEN p_brand LIKE '%1' THEN 'promo' WHEN p_brand LIKE '%2' THEN 'unknown' ELSE 'absent' END AS w FROM part), f AS (SELECT *, CASE WHEN CASE WHEN w = 'unknown' THEN h = 'nan' ELSE contains(h, w) OR contains(w, h) END THEN 1 WHEN h = 'nan' THEN 2 ELSE 3 END AS fit FROM r) SELECT id, fit FROM (SELECT *, min(fit) OVER (PARTITION BY k) AS least FROM f) WHERE fit = least")
def share_class_match(t):
    brand = F.col("p_brand")
    wanted = F.when(F.endswith(brand, F.lit("1")), "Promo").when(F.endswith(brand, F.lit("2")), "unknown").otherwise("absent")
    rows = t("part").select(F.col("p_partkey").alias("id"), brand.alias("k"), wanted.alias("w"), F.when(F.col("p_partkey") % 7 == 0, "nan").otherwise(F.col("p_type")).alias("h"))
    return match.share_class_rows(rows, "k", "w", "h").select("id", "fit")


@frame_query("SELECT p_partkey AS id, CAST(min(levenshtein(w, 'blue')) AS INTEGER) AS distance FROM part, unnest(string_split(lower(p_name), ' ')) AS u(w) GROUP BY 1 HAVING min(levenshtein(w, 'blue')) <= 2")
def name_lookup(t):
    names = t("part").select(F.col("p_partkey").alias("name_id"), F.col("p_name").alias("name"))
    return match.name_lookup(names, "blue~").select(F.col("name_id").alias("id"), "distance")


@frame_query("SELECT conv_id, turn, (NOT regexp_matches(text, '\\b[A-Z]{2,5}\\b') AND len(list_filter(['highest', 'lowest', 'best', 'worst', 'most', 'least', 'greatest', 'average', 'across all', 'among all', 'every fund', 'all funds', 'compare all', 'rank all', 'top fund', 'bottom fund'], lambda w: contains(lower(text), w))) > 0) AS many FROM conversations")
def aggregate_questions(t):
    return t("conversations").select("conv_id", "turn", match.is_aggregate("text").alias("many"))


# examples and vector search


@frame_query("WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id, greatest(0, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * 100 AS pct FROM q JOIN embeddings e ON true), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pct DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, CASE WHEN pct >= 85 THEN 'Example ' || rank || ' [★ VERY SIMILAR — ' || printf('%.1f', pct) || '% match — follow this pattern closely]:' ELSE 'Example ' || rank || ' [' || printf('%.1f', pct) || '% match]:' END AS heading FROM r WHERE rank <= 3")
def example_headings(t):
    v = t("embeddings")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.nearest_examples(q, v).select("query_id", "vec_id", "heading")


@frame_query()
def diverse_examples(t):
    v = t("embeddings")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.diverse_examples(q, v)


@frame_query("SELECT vec_id, round(greatest(0.0, 1 - d * d / 2) * 100, 4) AS percent FROM (SELECT vec_id, list_distance(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / n), [1.0] || list_transform(range(1, len(embedding)), lambda i: 0.0)) AS d FROM (SELECT *, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings))")
def distance_percent(t):
    x = F.transform("embedding", lambda v: v.cast("double"))
    n = retrieve.norm("embedding")
    first = F.transform(x, lambda v, i: v / n - F.when(i == 0, 1.0).otherwise(0.0))
    return t("embeddings").select("vec_id", F.round(clean.similarity_percent(retrieve.norm(first)), 4).alias("percent"))


@frame_query(f"WITH near AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({QUERY_VECTOR} AS DOUBLE[])) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20) SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(CASE WHEN lang = 'en' THEN lang END, source) AS parent, round(score, 5) AS score FROM near JOIN documents ON doc_id = vec_id WHERE lang <> 'de'")
def section_search(t):
    text = "CALL db.index.vector.queryNodes('section_vector', 20, $q) YIELD node, score WITH node, score WHERE node.title <> 'de' RETURN node.id AS id, coalesce(CASE WHEN node.title = 'en' THEN node.title END, node.sectionType) AS parent, score"
    graph = FundGraph(t.spark, t.folder).graph()
    return Compiler(graph, {"q": query_vector(t)}).run(parse(text)).withColumn("score", F.round("score", 5))


@frame_query(f"WITH s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({QUERY_VECTOR} AS DOUBLE[])) AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 15) SELECT vec_id, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5")
def answer_chunks(t):
    v = t("embeddings").withColumn("name", F.concat(F.lit("Label no "), F.col("label").cast("string")))
    return retrieve.answer_chunks(v, query_vector(t), "Label no 3").select("vec_id", "rank")


# ingestion


def fund_rows(t) -> DataFrame:
    """Customers as funds, in the shape of parsed prospectuses."""
    c = F.col
    funds = t("customer").join(t("nation"), c("c_nationkey") == c("n_nationkey")).join(t("region"), c("n_regionkey") == c("r_regionkey"))
    key = c("c_custkey").cast("string")
    some = lambda k, text: F.when(c("c_custkey") % k == 0, F.concat(F.lit(text), key))
    return funds.select(
        key.alias("ticker"), c("c_name").alias("name"), c("r_name").alias("provider"), c("n_name").alias("trust"), key.alias("cik"), F.lit("NYSE").alias("exchange"),
        F.when(c("c_mktsegment") == "BUILDING", "ETF Shares").otherwise(c("c_mktsegment")).alias("share_class"), some(2, "summary ").alias("summary"), F.concat(F.lit("A"), key).alias("accession"),
        F.concat(F.lit("u/"), key).alias("url"), F.lit("497K").alias("form"), F.lit("1998-05-01").cast("date").alias("filing_date"), some(3, "objective ").alias("objective"), some(4, "strategy ").alias("strategy"),
        some(5, "risk ").alias("risk"), F.array(F.lit("Ann B. Case"), c("c_mktsegment")).alias("managers"), c("c_acctbal").alias("net_assets"), F.lit(0.1).alias("expense_ratio"), F.lit(3.0).alias("turnover"),
        *[F.lit(float(i)).alias(n) for i, n in enumerate(("return_1y", "return_5y", "return_10y", "return_inception"))],
    )


@frame_query("WITH c AS (SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN 'ETF' ELSE 'OTHER' END AS cls FROM customer) SELECT 'Provider' AS name, count(DISTINCT n_regionkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'Trust', count(DISTINCT c_nationkey) FROM c UNION ALL SELECT x, count(*) FROM c, unnest(['Fund', 'HAS_SHARE_CLASS', 'Document', 'EXTRACTED_FROM', 'FinancialHighlight', 'AverageReturns']) AS u(x) GROUP BY x UNION ALL SELECT 'ShareClass', count(DISTINCT cls) FROM c UNION ALL SELECT 'Profile', count(*) FROM c WHERE c_custkey % 2 = 0 UNION ALL SELECT 'Section', count(*) FROM c, unnest([3, 4, 5]) AS u(k) WHERE c_custkey % k = 0 UNION ALL SELECT 'Person', count(DISTINCT c_mktsegment) + 1 FROM c UNION ALL SELECT 'MANAGED_BY', 2 * count(*) FROM c")
def ingest_funds(t):
    rows, total = fund_rows(t), []
    for target in ingest.fund_targets():  # three of them fill the table of sections
        total.append((target.name, ingest.ingest(rows, [target])[target.name]))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in total]
    return functools.reduce(DataFrame.unionByName, parts).groupBy("name").agg(F.sum("n").alias("n"))


@frame_query("SELECT CAST(c_custkey AS VARCHAR) AS fund_ticker, x AS label, lower(x) || ' ' || c_custkey AS text FROM customer, (VALUES ('Objective', 3), ('Strategy', 4), ('Risk', 5)) AS v(x, k) WHERE c_custkey % k = 0")
def ingest_sections(t):
    rows = fund_rows(t)
    parts = [ingest.ingest(rows, [x])[x.name] for x in ingest.fund_targets() if x.name == "Section"]
    return functools.reduce(DataFrame.unionByName, parts).select("fund_ticker", "label", "text")


@frame_query("WITH s AS (SELECT s_suppkey, 1990 + s_suppkey % 7 AS y FROM supplier) SELECT CAST(s_suppkey AS VARCHAR) AS ticker, CAST(y AS INTEGER) AS year, 'risk ' || s_suppkey AS risk, 'Eve ' || s_suppkey AS person, CAST(s_suppkey * 10 AS DOUBLE) AS total FROM s")
def ingest_companies(t):
    k = F.col("s_suppkey").cast("string")
    text = lambda w: F.concat(F.lit(w), k)
    year = F.concat((1990 + F.col("s_suppkey") % 7).cast("string"), F.lit("-12-31")).cast("date")
    rows = t("supplier").select(k.alias("ticker"), F.col("s_name").alias("name"), k.alias("cik"), text("A").alias("accession"), text("u/").alias("url"), F.lit("2001-02-03").cast("date").alias("filing_date"), year.alias("report_period_end"), *[text(f"{w} ").alias(c) for w, c in (("risk", "risk_factors"), ("business", "business"), ("legal", "legal"), ("md", "discussion"), ("place", "properties"))], text("Eve ").alias("ceo"), (F.col("s_suppkey") * 10.0).alias("ceo_compensation"))
    made = ingest.ingest(rows, ingest.company_targets())
    again = ingest.ingest(rows, ingest.company_targets(), made)  # changes nothing
    risks = again["Filing10K"].join(again["RiskFactor"], ["ticker", "year"]).withColumnRenamed("text", "risk")
    people = again["HAS_CEO"].join(again["CompensationPackage"], "person")
    return risks.join(people, "ticker").select("ticker", "year", "risk", "person", "total")


@frame_query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'kept' WHEN p_type = 'PROMO' THEN 'Bonds' WHEN p_type = 'SMALL' THEN 'Equities' END AS category, coalesce(p_partkey % 3 <> 0 AND p_type = 'PROMO', false) AS bond, coalesce(p_partkey % 3 <> 0 AND p_type = 'SMALL', false) AS equity FROM part")
def category_backfill(t):
    codes = t.spark.createDataFrame([("PROMO", "Bonds"), ("SMALL", "Equities")], "code string, category string")
    rows = t("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("asset_category"), F.when(F.col("p_partkey") % 3 == 0, "kept").alias("category"))
    twice = ingest.backfill_categories(ingest.backfill_categories(rows, codes), codes)
    return twice.select("id", "category", clean.is_bond("category").alias("bond"), clean.is_equity("category").alias("equity"))


@frame_query("SELECT title, svg FROM (SELECT p_name AS title, max(p_partkey) AS svg FROM part WHERE p_brand = 'Brand#7' GROUP BY 1) WHERE contains(title, 'ring')")
def charts(t):
    rows = t("part").select(F.col("p_brand").alias("ticker"), F.col("p_name").alias("title"), F.col("p_partkey").alias("svg"))
    old, new = (rows.filter(c).groupBy("ticker", "title").agg(F.max("svg").alias("svg")) for c in ("svg % 2 = 0", "svg % 2 = 1"))
    every = ingest.add_charts(old, new.join(old.withColumnRenamed("svg", "had"), ["ticker", "title"], "left").filter("had IS NULL OR svg > had").drop("had"))
    return ingest.charts_of(every, "brand#7", "RING").select("title", "svg")


@frame_query("SELECT 'Company' AS name, count(*) AS n FROM supplier UNION ALL SELECT 'Fund', 0 UNION ALL SELECT 'Profile', 0 UNION ALL SELECT 'Provider', count(*) FROM region")
def delete_funds(t):
    tables = {"Fund": t("customer"), "Profile": t("customer"), "Company": t("supplier"), "Provider": t("region")}
    return ingest.counters(ingest.emptied(tables, ingest.FUND_TABLES))


@frame_query("SELECT c_custkey AS ticker, c_name AS name, max(o_totalprice) AS most FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey GROUP BY 1, 2")
def prospectus_merge(t):
    found = t("orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("ticker")).agg(F.max("o_totalprice").alias("most"))
    return ingest.with_prospectus(t("customer").select(F.col("c_custkey").alias("ticker"), F.col("c_name").alias("name")), found)


@frame_query("SELECT c_custkey AS ticker, c_acctbal AS net FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def conditional_upsert(t):
    rows = t("customer").select(F.col("c_custkey").alias("ticker"), F.col("c_acctbal").alias("net"), "c_mktsegment")
    target = ingest.Target("Net", {"ticker": "ticker"}, {"net": "net"}, when="net > 0 AND c_mktsegment = 'BUILDING'")
    return ingest.ingest(rows, [target])["Net"]


# windows over years


@frame_query("WITH m AS (SELECT DISTINCT year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders) SELECT CAST(y AS INTEGER) AS year, CAST(q AS INTEGER) AS quarter, CAST(row_number() OVER (PARTITION BY y ORDER BY q) AS INTEGER) AS tick FROM m")
def quarter_ticks(t):
    rows = t("orders").select(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).distinct()
    return rows.withColumn("tick", F.row_number().over(Window.partitionBy("year").orderBy("quarter")))


@frame_query("WITH y AS (SELECT o_custkey AS ticker, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT ticker, CAST(min(y) AS INTEGER) AS from_year, CAST(max(y) AS INTEGER) AS to_year, round((arg_max(v, y) / arg_min(v, y) - 1) * 100, 4) AS growth FROM y GROUP BY 1 HAVING count(*) > 1")
def growth(t):
    y = t("orders").groupBy(F.col("o_custkey").alias("ticker"), F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    rows = y.groupBy("ticker").agg(F.min("y").alias("from_year"), F.max("y").alias("to_year"), F.round((F.max_by("v", "y") / F.min_by("v", "y") - 1) * 100, 4).alias("growth"), F.count("*").alias("n"))
    return rows.filter("n > 1").drop("n")


# comparing results


def compared(t) -> DataFrame:
    """Results of customers' orders, some rows of which are missing, and what is expected."""
    row = F.array(F.col("o_orderpriority"), F.col("o_orderstatus"))
    kept = F.when(F.col("o_custkey") % 4 == 0, True).when(F.col("o_custkey") % 4 == 1, F.col("o_orderkey") % 2 == 0).when(F.col("o_custkey") % 4 == 2, False).otherwise(F.col("o_orderstatus") == "F")
    return t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.when(kept, row)).alias("generated"), F.collect_list(row).alias("expected"))


COMPARED = "WITH o AS (SELECT o_custkey AS id, [o_orderpriority, o_orderstatus] AS r, CASE o_custkey % 4 WHEN 0 THEN true WHEN 1 THEN o_orderkey % 2 = 0 WHEN 2 THEN false ELSE o_orderstatus = 'F' END AS kept FROM orders), c AS (SELECT id, coalesce(list(r) FILTER (WHERE kept), []) AS g, list(r) AS e FROM o GROUP BY 1), v AS (SELECT *, list_distinct(flatten(g)) AS gv, list_distinct(flatten(e)) AS ev FROM c)"


@frame_query(f"{COMPARED} SELECT id, CASE WHEN len(g) = 0 THEN 'mismatch' WHEN len(gv) = len(ev) THEN 'exact' ELSE 'partial' END AS outcome, len(g) BETWEEN 1 AND 10 AS few, CASE WHEN len(g) = 0 THEN 'NO' WHEN len(g) = len(e) THEN 'YES' END AS verdict FROM v")
def result_comparison(t):
    return compared(t).select("id", evaluate.comparison("generated", "expected").alias("outcome"), evaluate.few_contained("generated", "expected").alias("few"), evaluate.verdict("generated", "expected").alias("verdict"))


@frame_query("SELECT event_type, count(*) AS n, avg(CAST(value > 50 AS DOUBLE)) AS rate FROM events WHERE user_id % 2 = 0 OR value > 10 GROUP BY 1")
def rate_by_type(t):
    return evaluate.rate_by(t("events").withColumn("flag", F.col("value") > 50), "event_type", "flag", "user_id % 2 = 0 OR value > 10")


# cells, names and texts of filings


@frame_query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN -abs(c_acctbal) WHEN 3 THEN 0.0 ELSE abs(c_acctbal) END AS cell, CASE c_custkey % 4 WHEN 0 THEN -abs(c_acctbal) WHEN 3 THEN NULL ELSE abs(c_acctbal) END AS performance FROM customer")
def cell_numbers(t):
    k, v = F.col("c_custkey") % 4, F.abs("c_acctbal").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("("), v, F.lit(")"))).when(k == 1, F.concat(F.lit("$ "), v)).when(k == 2, F.concat(v, F.lit("%"))).otherwise("--")
    return t("customer").select(F.col("c_custkey").alias("id"), clean.table_number(raw).alias("cell"), clean.performance(raw).alias("performance"))


@frame_query("SELECT p_partkey AS id, lower(p_name) || ' fund ' || p_size AS name, CASE WHEN p_partkey % 3 = 0 THEN 'Unknown' ELSE p_brand END AS first FROM part")
def plain_names(t):
    label = F.concat(F.lit("Vanguard  "), F.initcap("p_name"), F.lit(" (Fund) - "), F.col("p_size").cast("string"))
    several = F.array(F.lit(" "), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_brand")))
    return t("part").select(F.col("p_partkey").alias("id"), clean.finance_name(label).alias("name"), clean.first_name(several).alias("first"))


@frame_query("SELECT p_partkey AS id, p_size / 100.0::DOUBLE AS expense, p_size * CASE p_partkey % 3 WHEN 0 THEN 1e6 WHEN 1 THEN 1e9 ELSE 1.0 END AS least FROM part")
def fees_and_minimums(t):
    size = F.col("p_size").cast("string")
    fee = F.concat(F.lit("Fees. Total Annual Fund Operating Expenses ......... 0."), F.lpad(size, 2, "0"), F.lit(" % of assets. "))
    unit = F.when(F.col("p_partkey") % 3 == 0, " million").when(F.col("p_partkey") % 3 == 1, " Billion").otherwise("")
    text = F.concat(fee, F.lit("The minimum initial investment for the class is $"), size, unit, F.lit(". Later purchases: $1."))
    rows = t("part").select(F.col("p_partkey").alias("id"), text.alias("text"))
    return rows.select("id", extract.expense_ratio("text").alias("expense"), extract.minimum_investment("text").alias("least"))


@frame_query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'FTSE ' || s_suppkey || ' Index' ELSE 'Unknown Benchmark' END AS benchmark, CASE WHEN s_suppkey % 2 = 0 THEN ['Ann ' || 'Case'] ELSE ['Ann Case', 'Bo de Vries'] END AS managers FROM supplier")
def benchmarks_and_managers(t):
    k = F.col("s_suppkey")
    index = F.when(k % 2 == 0, F.concat(F.lit("against the S&P Total Market "), k.cast("string"), F.lit(" Index and the FTSE "), k.cast("string"), F.lit(" Index")))
    people = F.when(k % 2 == 0, "Ann Case, Portfolio Manager since 2001\nno one here\nAnn Case, Principal").otherwise("Ann Case, Principal of the adviser\nBo de Vries Managing Director\nX, Head of Bonds")
    rows = t("supplier").select(k.alias("id"), F.coalesce(index, F.lit("no index")).alias("index"), people.alias("people"))
    return rows.select("id", extract.benchmark_index("index").alias("benchmark"), extract.managers("people").alias("managers"))


@frame_query("SELECT p_partkey AS id, p_size || CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE '' END AS item, 'Notes on ' || p_name AS title, 'Item ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE '' END || '. Notes on ' || p_name AS head FROM part")
def section_headers(t):
    mark = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "A").otherwise(""))
    rows = t("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("S-12Item "), mark, F.lit(". Notes on "), F.col("p_name"), F.lit("\nmore text")).alias("raw"))
    rows = rows.select("id", F.regexp_replace("raw", "^S-12", "S-12 ").alias("chunk"), F.regexp_replace("raw", "^S-12", "").alias("text"))
    found = rows.withColumn("h", extract.section_header("text"))
    return found.select("id", "h.item", "h.title", filings.chunk_title("chunk").alias("head"))


@frame_query("SELECT p_partkey AS id, p_size * pow(10, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 2 ELSE 0 END) AS value, CASE WHEN p_partkey % 2 = 0 THEN 'C' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS class FROM part")
def scaled_facts(t):
    k = F.col("p_partkey")
    scale = F.when(k % 4 == 0, "3").when(k % 4 == 1, "Millions").when(k % 4 == 2, "hundreds").otherwise("")
    context = F.when(k % 2 == 0, F.concat(F.lit("ctx_C"), F.lpad(k.cast("string"), 9, "0"), F.lit("Member"))).otherwise("ctx")
    rows = t("part").select(k.alias("id"), F.concat(F.col("p_size").cast("string"), F.lit(" ")).alias("v"), scale.alias("s"), context.alias("c"))
    return rows.select("id", clean.scaled("v", "s").alias("value"), filings.class_id("c").alias("class"))


@frame_query("SELECT c_custkey AS id, s_suppkey AS other FROM customer LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey")
def first_of_name(t):
    left = t("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("name"))
    right = t("supplier").select(F.concat(F.lit("NATION "), F.col("s_nationkey").cast("string")).alias("name"), F.col("s_suppkey").alias("other"))
    return match.first_equal(left, right, "name", "other").select("id", "other")


@frame_query("SELECT doc_id AS id, md5(CASE WHEN contains(text, source) THEN text ELSE 'Fund: ' || source || chr(10) || text END) AS digest FROM documents")
def named_chunks(t):
    return t("documents").select(F.col("doc_id").alias("id"), F.md5(filings.named_chunk("source", "text")).alias("digest"))


@frame_query("SELECT o_orderkey AS id, upper(o_orderpriority) AS name, o_totalprice / 5000 AS weight FROM orders WHERE o_totalprice / 5000 BETWEEN -100 AND 150 AND o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE false")
def allocation_rows(t):
    name = F.when(F.col("o_orderstatus") == "P", "Total").otherwise(F.concat(F.lit("​ "), F.upper("o_orderpriority"), F.lit(" ")))
    rows = t("orders").select(F.col("o_orderkey").alias("id"), name.alias("name"), F.concat((F.col("o_totalprice") / 5000).cast("string"), F.lit(" %")).alias("weight"))
    return filings.allocations(rows, "name", "weight").select("id", "name", "weight")


@frame_query("SELECT c_custkey AS id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'region' ELSE 'sector' END AS kind FROM customer")
def moved_allocations(t):
    places = t("customer").filter("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(F.initcap("c_mktsegment").alias("name")).distinct()
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.lit("sector").alias("kind"))
    return filings.moved_allocations(rows, places).select("id", "kind")


# measures and upserts


@frame_query("WITH c AS (SELECT count_if(quality = 1 AND n_chars > 500)::BIGINT AS tp, count_if(quality = 0 AND n_chars <= 500)::BIGINT AS tn, count_if(quality = 0 AND n_chars > 500)::BIGINT AS fp, count_if(quality = 1 AND n_chars <= 500)::BIGINT AS fn FROM labels JOIN documents USING (doc_id)) SELECT tp, tn, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, fp / (fp + tn) AS fp_rate FROM c")
def binary_report(t):
    rows = t("labels").join(t("documents"), "doc_id").select((F.col("quality") == 1).alias("good"), (F.col("n_chars") > 500).alias("long"))
    return evaluate.binary_report(rows, "good", "long")


@frame_query("WITH l AS (SELECT l_orderkey AS q, list_distinct(list(l_partkey ORDER BY l_linenumber, l_partkey)) AS r0, list(l_partkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem GROUP BY 1), e AS (SELECT q, r, list_sort(list_distinct(list_filter(r, lambda x: x % 2 = 0))) AS e FROM l), m AS (SELECT q, e, r, list_filter(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN list_contains(e, r[i]) THEN i END), lambda x: x IS NOT NULL) AS hits, least(10, len(e)) AS n FROM e) SELECT q AS query_id, CASE WHEN len(hits) > 0 THEN 1.0 / hits[1] ELSE 0.0 END AS mrr FROM m")
def chunk_ranks(t):
    rows = t("lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("returned"))
    rows = rows.withColumn("expected", F.array_sort(F.array_distinct(F.filter("returned", lambda x: x % 2 == 0))))
    return evaluate.chunk_measures(rows).select("query_id", "mrr")


@frame_query("SELECT 'Portfolio' AS name, count(DISTINCT l_orderkey) AS n FROM lineitem UNION ALL SELECT 'HAS_HOLDING', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) UNION ALL SELECT 'Holding', count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'Company', count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey % 2 = 0 UNION ALL SELECT 'REPRESENTS', count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey % 2 = 0")
def holdings_ingest(t):
    k = F.col("l_partkey").cast("string")
    raw = t("lineitem").select(F.col("l_orderkey").alias("series_id"), F.expr("l_orderkey * 100 + l_linenumber").alias("row"), F.concat(F.lit("N"), k).alias("name"), F.when(F.col("l_partkey") % 2 == 0, k).otherwise("nan").alias("ticker"), F.lit(" ").alias("cusip"), F.concat(F.lit("IS"), k).alias("isin"), F.lit("None").alias("lei"), F.col("l_returnflag").alias("asset_category"), F.col("l_quantity").alias("shares"), F.col("l_extendedprice").alias("market_value"), F.col("l_tax").alias("weight"))
    codes = t.spark.createDataFrame([("A", "Equities"), ("N", "Bonds")], "code string, category string")
    return ingest.counters(upsert.ingest_holdings(raw, codes))


@frame_query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN embedding[1] ELSE 2 * embedding[1] END AS first FROM embeddings")
def kept_embeddings(t):
    old = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    new = old.select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.array().cast("array<double>")).otherwise(F.transform("embedding", lambda x: 2 * x)).alias("embedding"))
    return upsert.keep_old_if_empty(old, new, "vec_id", "embedding").select("vec_id", F.get("embedding", F.lit(0)).alias("first"))


@frame_query("WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) DESC, e.vec_id) AS near FROM q JOIN embeddings e ON true), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY label DESC, near) AS rank FROM s WHERE near <= 15) SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def reranked(t):
    v = t("embeddings")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = retrieve.knn_join(q, v, 15).drop("rank").join(v.select("vec_id", "label"), "vec_id")
    near = near.withColumn("query", F.lit("")).withColumn("text", F.col("label").cast("string"))
    return retrieve.rerank(near, lambda query, text: F.col(text).cast("double")).select("query_id", "vec_id", "rank")


graph_query("element_ids", "MATCH (f:Fund) RETURN elementId(f) AS id, head(labels(f)) AS label", "SELECT CAST(c_custkey AS VARCHAR) AS id, 'Fund' AS label FROM customer")


# extensions: not part of the compared engine, offered because Spark has them


@frame_query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_tumbling(t):
    return streams.tumbling(t("events")).withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@frame_query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def ext_sessions(t):
    return streams.sessions(t("events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@frame_query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_cube(t):
    return t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@frame_query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def ext_intersect(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select(F.col("s_nationkey").alias("k")))


@frame_query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def ext_except(t):
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("k")))


@frame_query("SELECT e.event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def ext_asof(t):
    e = t("events").filter("event_type IN ('error', 'purchase')").select("event_id", "ts", "user_id", "event_type")
    before = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "error", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(before)
    return e.withColumn("purchase_id", last).filter("event_type = 'error'").select("event_id", "purchase_id")
