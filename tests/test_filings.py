"""Filings, ingestion and models on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from fathomline.functions import filings
from fathomline.models import classify, embed
from fathomline.operators import ingest

PROSPECTUS = """Vanguard Index Funds
Summary Prospectus
Vanguard 500 Index Fund
Ticker Symbol: VFIAX
January 2, 2023, as revised April 28, 2023
Investment Objective The Fund seeks to track an index.
12
Fees and Expenses Total Annual Fund Operating Expenses 0.04%
Principal Investment Strategies The Fund tracks the S&P 500 Index or the CRSP US Total Market Index.
Principal Risks Stocks may fall.
Annual Total Returns 1%
Minimum initial investment $3,000
Investment Advisor: The Vanguard Group
Jane Q. Doe, Portfolio Manager"""


def test_prospectus(spark):
    rows = filings.prospectus(spark.createDataFrame([(1, PROSPECTUS), (2, "nothing here"), (3, None)], "id int, text string"), "id").orderBy("id").collect()
    r = rows[0]
    assert (r["provider"], r["ticker"], r["name"], r["status"]) == ("Vanguard", "VFIAX", "Vanguard 500 Index Fund", "success")
    assert r["objective"] == "The Fund seeks to track an index." and r["risks"] == "Stocks may fall."
    assert r["benchmark"] in ("S&P 500 Index", "CRSP US Total Market Index") and r["expense_ratio"] == 0.04 and r["minimum_investment"] == 3000.0
    assert str(r["report_date"]) == "2023-04-28" and r["managers"] == ["Jane Q. Doe"]
    assert rows[1]["status"] != "success" and rows[2]["status"] == "failed_no_ticker"
    text = spark.createDataFrame([("T", None, "b")], "t string, a string, b string").select(filings.markdown("t", [("A", "a"), ("B", "b")]).alias("m")).first()["m"]
    assert text == "# T\n\n## B\nb"


def test_tables(spark):
    wide = spark.createDataFrame([(1, 0, ["Item", "2022", "2023"]), (1, 1, ["Net assets", "$5", "(7)"])], "t int, row_no int, cells array<string>")
    assert sorted(map(tuple, filings.years_in_header(wide, ["t"]).collect())) == [(1, "Net assets", 2022, 5.0), (1, "Net assets", 2023, -7.0)]
    tall = spark.createDataFrame([(1, 0, ["Year", "NAV", "Ratio"]), (1, 1, ["2022", "10.5", "0.1%"]), (1, 2, ["2023", "11", ""])], "t int, row_no int, cells array<string>")
    got = {(r["label"], r["year"]): r["value"] for r in filings.years_in_rows(tall, ["t"]).collect()}
    assert got[("NAV", 2022)] == 10.5 and got[("Ratio", 2022)] == 0.1 and got[("Ratio", 2023)] == 0.0
    ret = spark.createDataFrame([(1, 0, ["Fund", "1 Year", "5 Years", "Since Inception"]), (1, 1, ["Notes", "x", "y", "z"]), (1, 2, ["A", "(1.5)", "7.0%", "--"])], "t int, row_no int, cells array<string>")
    r = filings.average_returns(ret, ["t"]).first()
    assert (r["return_1y"], r["return_5y"], r["return_10y"], r["return_inception"]) == (-1.5, 7.0, None, None)
    z = filings.zipped(spark.createDataFrame([(1, ["a", "0"], ["x"])], "k int, p array<string>, q array<string>"), ["k"], ["p", "q"])
    assert [tuple(r) for r in z.collect()] == [(1, "a", "x")]


def test_facts(spark):
    facts = [{"name": "oef:Fund", "context": "C000000001", "value": "A Fund", "scale": "", "sign": ""}, {"name": "oef:Fund", "context": "C000000001", "value": "again", "scale": "", "sign": ""}, {"name": "us-gaap:NetAssets", "context": "C000000001", "value": "1,000", "scale": "3", "sign": ""}]
    df = spark.createDataFrame([(1, facts)], "id int, facts array<struct<name:string,context:string,value:string,scale:string,sign:string>>")
    r = filings.funds_of(df, "id", {"oef:Fund": "fund", "us-gaap:NetAssets": "assets"}).withColumn("cls", filings.class_id("context")).first()
    assert (r["fund"], r["assets"], r["cls"]) == ("A Fund", "1,000", "C000000001")
    assert filings.facts_as_table(df, "id").first()["name"] == "Net Assets"


def test_people(spark):
    rows = spark.createDataFrame([("A", "Mary J. Doe", "Director", "2023-01-02", "P", "Common Stock", 10, 2.0, 100), ("A", "X", "CEO", "2023-01-02", "M", "Stock Option", 1, 1.0, 1)], "ticker string, insider string, position string, date string, code string, security string, shares int, price double, remaining int")
    r = filings.insider_transactions(rows).collect()
    assert len(r) == 1 and r[0]["value"] == 20.0 and r[0]["id"] == "A_MaryJDoe_2023-01-02_Purchase_10"
    proxy = spark.createDataFrame([("A", [("Tim Cook", "Chief Executive Officer")], None, None, "2023-09-30"), ("B", [("X", "Director")], "", "Jane A. Roe, our Chief Executive Officer", None)], "t string, people array<struct<name:string,role:string>>, pay_name string, text string, fiscal_year_end string")
    assert dict(filings.chief_executive(proxy, "t").select("t", "name").collect()) == {"A": "Tim Cook", "B": "Jane A Roe"}


def test_cleaning_of_tables(spark):
    s = spark.createDataFrame([("Health Care",), ("Health-Care",), ("HEALTH CARE ",)], "sector string")
    assert {r[0] for r in filings.sectors(s, "sector").collect()} == {"Health Care"} or len({r[0] for r in filings.sectors(s, "sector").collect()}) == 1
    a = spark.createDataFrame([("Japan​", "5.5%"), ("Total", "100"), ("X", "900"), ("Y", "n/a")], "name string, w string")
    assert [tuple(r) for r in filings.allocations(a, "name", "w").collect()] == [("Japan", 5.5)]
    m = spark.createDataFrame([("F", ["P"]), ("F", []), ("G", [])], "name string, managers array<string>")
    assert sorted((r["name"], tuple(r["managers"])) for r in filings.shared_managers(m).collect()) == [("F", ("P",)), ("F", ("P",)), ("G", ())]
    t = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, n int, v string")
    assert filings.markdown_table(t, ["k"], "n", ["v"]).first()["content"] == "| v |\n|---|\n| a |\n| b |"


def test_ingest(spark):
    staging = spark.createDataFrame(
        [("Vanguard", "T1", "VFIAX", "500", "1", "NYSE", "Admiral Shares", None, "acc1", "u", "N-CSR", "obj", None, "rsk", ["Mary J. Doe", "Bob Roe"], 5.0, 0.04, 3.0, 1.0, 2.0, None, None)],
        "provider string, trust string, ticker string, name string, cik string, exchange string, share_class string, summary string, accession string, url string, form string, objective string, strategy string, risk string, managers array<string>, net_assets double, expense_ratio double, turnover double, return_1y double, return_5y double, return_10y double, return_inception double",
    ).withColumn("filing_date", F.to_date(F.lit("2023-05-01")))
    targets = [t for i, t in enumerate(ingest.fund_targets())]
    once = ingest.ingest(staging, targets)
    again = ingest.ingest(staging, targets, once)
    for name in ("Fund", "Person", "MANAGED_BY", "FinancialHighlight"):
        assert sorted(map(tuple, once[name].collect())) == sorted(map(tuple, again[name].collect()))
    assert sorted(r["name"] for r in once["Person"].collect()) == ["Bob Roe", "Mary J Doe"]
    assert dict(ingest.counters({k: once[k] for k in ("Fund", "Person", "Profile")}).collect()) == {"Fund": 1, "Person": 2, "Profile": 0}
    years = spark.createDataFrame([("A", "Tech", 2022, 1.0), ("A", "Tech", 2023, 2.0), ("A", None, 2023, 1.0)], "ticker string, name string, year int, weight double")
    edges = ingest.ingest(years, [ingest.allocation_target("sector")])["HAS_SECTOR_ALLOCATION"]
    assert edges.count() == 2 and ingest.latest(edges, ["ticker", "name"], "weight").first()["weight"] == 2.0
    facts = spark.createDataFrame([("A", 2023, "Revenue", 200.0, [("EU", 50.0)])], "ticker string, year int, label string, value double, segments array<struct<label:string,value:double>>")
    assert ingest.metrics(facts)["Segment"].first()["percentage"] == 25.0


def test_classifier(spark):
    rows = [("expense ratio of the fund", ["fund_basic"]), ("net assets of this fund", ["fund_basic"]), ("top holdings by weight", ["fund_portfolio"]), ("sector allocation of holdings", ["fund_portfolio"]), ("weather tomorrow", ["not_related"]), ("a good recipe", ["not_related"])] * 5
    df = spark.createDataFrame(rows, "text string, labels array<string>")
    model = classify.Classifier.train(df, ("fund_basic", "fund_portfolio", "not_related"))
    got = {r["text"]: r["guess"] for r in model.predict(df.dropDuplicates(["text"])).collect()}
    assert got["top holdings by weight"][0] == "fund_portfolio" and got["weather tomorrow"] == ["not_related"]
    rules = {r["text"]: r["l"] for r in df.dropDuplicates(["text"]).select("text", classify.rule_labels("text").alias("l")).collect()}
    assert rules["expense ratio of the fund"] == ["fund_basic"] and rules["a good recipe"] == ["not_related"]
    p = spark.createDataFrame([([0.2, 0.35, 0.1],), ([0.2, 0.1, 0.15],)], "p array<double>").select(classify.decide(F.col("p"), ("fund_basic", "fund_portfolio", "not_related")).alias("d")).collect()
    assert [r["d"] for r in p] == [["fund_portfolio"], ["fund_basic"]]


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "id int, text string")
    got = {r["id"]: r["embedding"] for r in embed.embed(df, "text", prefix="SEC Filing:").collect()}
    assert got[1] == got[3] and len(got[2]) == embed.WIDTH

    def broken(texts):
        raise RuntimeError

    assert all(r["embedding"] is None for r in embed.embed(df, "text", broken).collect())


def test_tf_idf(spark):
    df = spark.createDataFrame([(1, "red apple pie"), (2, "red apple tart"), (3, "blue sky"), (4, None)], "id int, text string")
    w = embed.tf_idf(df, "id", "text")
    assert w.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).filter("abs(s - 1) > 1e-9").isEmpty()
    best = embed.alike(w, "id").orderBy(F.desc("similarity")).first()
    assert (best["a"], best["b"]) == (1, 2) and best["similarity"] == pytest.approx(0.54, abs=0.15)
