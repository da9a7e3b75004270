"""The fund and company graph laid over the star-schema tables.

region, nation and customer stand for providers, trusts and funds; orders for portfolios, lineitem for holdings of
them, part for what is held, supplier for companies; orders by year for yearly highlights; events for insider
transactions; documents, cut into word windows, for sections and chunks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fathomline.functions.chunk import word_windows
from fathomline.operators.match import name_lookup
from fathomline.operators.retrieve import bm25, knn
from fathomline.plans.language.compile import ID, Graph
from fathomline.sources.tables import table


class Vertices(dict):
    """Tables that are planned when first asked for."""

    def __init__(self, makers: dict):
        super().__init__({k: None for k in makers})
        self.makers = makers

    def __getitem__(self, key) -> DataFrame:
        if super().__getitem__(key) is None:
            self[key] = self.makers[key]()
        return super().__getitem__(key)

    def values(self):
        return (self[k] for k in self)


class FundGraph:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def highlights(self) -> DataFrame:
        by = self.t("orders").groupBy("o_custkey", F.year("o_orderdate").alias("year"))
        rows = by.agg(F.bround(F.sum("o_totalprice"), 2).alias("netAssets"), F.count("*").alias("numberHoldings"), F.bround(F.max("o_totalprice"), 2).alias("netAssetsValueEnd"))
        return rows.withColumn("id", F.concat_ws("_", "o_custkey", "year"))

    @cached_property
    def chunks(self) -> DataFrame:
        docs = self.t("documents").select(F.col("doc_id").cast("string").alias("sectionId"), "lang", "source", "text")
        return word_windows(docs, "text", 64, 48).withColumn("id", F.concat_ws("_", "sectionId", "chunkIndex"))

    def graph(self) -> Graph:
        t = self.t
        line = lambda: t("lineitem").withColumn("weight", F.col("l_extendedprice") / F.sum("l_extendedprice").over(Window.partitionBy("l_orderkey")))
        vertices = Vertices({
            "Provider": lambda: t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")),
            "Trust": lambda: t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
            "Fund": lambda: t("customer").select(F.col("c_custkey").alias("ticker"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("shareClass")),
            "ShareClass": lambda: t("customer").select(F.col("c_mktsegment").alias("name")).distinct(),
            "Portfolio": lambda: t("orders").select(F.col("o_orderkey").alias("seriesId"), F.col("o_orderdate").alias("date"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total")),
            "Holding": lambda: t("part").select(F.col("p_partkey").alias("nodeId"), F.col("p_name").alias("name"), F.col("p_brand").alias("sector"), F.col("p_type").alias("category"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")),
            "AssetCategory": lambda: t("part").select(F.col("p_type").alias("code")).distinct(),
            "Company": lambda: t("supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
            "FinancialHighlight": lambda: self.highlights.select("id", "netAssets", "numberHoldings", "netAssetsValueEnd"),
            "InsiderTransaction": lambda: t("events").select(F.col("event_id").alias("id"), F.col("ts").alias("transactionDate"), F.col("event_type").alias("transactionType"), F.col("value")),
            "Person": lambda: t("events").select(F.col("user_id").alias("name")).distinct(),
            "Section": lambda: t("documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text"), F.col("lang").alias("title"), F.col("source").alias("sectionType"), F.array(F.lit("Section"), F.when(F.col("lang") == "en", "RiskFactor").otherwise("Strategy")).alias("labels")),
            "Chunk": lambda: self.chunks.select("id", F.col("chunk").alias("text"), "chunkIndex"),
            "Document": lambda: t("documents").select(F.col("doc_id").cast("string").alias("accessionNumber"), F.col("source").alias("type"), F.col("lang")),
        })
        edges = Vertices({
            "MANAGES": lambda: t("nation").select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst")),
            "ISSUES": lambda: t("customer").select(F.col("c_nationkey").alias("src"), F.col("c_custkey").alias("dst")),
            "HAS_SHARE_CLASS": lambda: t("customer").select(F.col("c_custkey").alias("src"), F.col("c_mktsegment").alias("dst")),
            "HAS_PORTFOLIO": lambda: t("orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")),
            "HAS_HOLDING": lambda: line().select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("shares"), F.col("l_extendedprice").alias("marketValue"), "weight"),
            "OF_CATEGORY": lambda: t("part").select(F.col("p_partkey").alias("src"), F.col("p_type").alias("dst")),
            "REPRESENTS": lambda: t("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct(),
            "HAS_FINANCIAL_HIGHLIGHT": lambda: self.highlights.select(F.col("o_custkey").alias("src"), F.col("id").alias("dst"), "year"),
            "MADE_BY": lambda: t("events").select(F.col("event_id").alias("src"), F.col("user_id").alias("dst")),
            "HAS_CHUNK": lambda: self.chunks.select(F.col("sectionId").alias("src"), F.col("id").alias("dst")),
        })
        indexes = {"section_text": lambda g, args: bm25(g.vertex("Section").select(F.col("id").alias(ID), "text"), args[0], int(args[1]) if len(args) > 1 else 10)}
        by_vector = lambda g, args: knn(self.vectors(), args[1], int(args[0])).select(F.col("vec_id").cast("string").alias(ID), "score")
        by_name = lambda g, args: name_lookup(g.vertex("Holding").select(F.col("nodeId").alias("name_id"), "name"), args[0]).select(F.col("name_id").alias(ID), (1.0 / (1 + F.col("distance"))).alias("score"))
        indexes |= {"section_vector": by_vector, "holding_name": by_name}
        labels = {"section_text": "Section", "section_vector": "Section", "holding_name": "Holding"}
        return Graph(vertices, edges, indexes=indexes, index_labels=labels, keys={"Provider": "id", "Trust": "id"})

    def vectors(self) -> DataFrame:
        return self.t("embeddings")

    def nearest(self, query: list[float], k: int) -> DataFrame:
        return knn(self.vectors(), query, k)
