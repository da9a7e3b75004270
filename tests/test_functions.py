"""Scalar functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from fathomline.functions import chunk, clean, extract, fuzzy


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} string" for k in values) or "x int")
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw,value", [("$31,195", 31195.0), ("(0.02%)", -0.02), ("-4.5", -4.5), (None, 0.0), ("n/a", 0.0)])
def test_financial_number(spark, raw, value):
    assert one(spark, clean.financial_number("c"), c=raw) == value


@pytest.mark.parametrize("raw,value", [("$31,195", 31195.0), ("(0.02%)", -0.02), ("0.40%3", 0.40), ("$—", 0.0), (None, 0.0)])
def test_table_number(spark, raw, value):
    assert one(spark, clean.table_number("c"), c=raw) == value


@pytest.mark.parametrize("raw,value", [("(14.24", -14.24), ("14.24%", 14.24), ("(3.15)%", -3.15), ("--", None)])
def test_performance(spark, raw, value):
    assert one(spark, clean.performance("c"), c=raw) == value


def test_names(spark):
    assert one(spark, clean.person_name("c"), c="Mary  J. Smith Jr.") == "Mary J Smith Jr."
    assert one(spark, clean.company_name("c"), c="The Apple & Pear Co, Inc.") == "apple pear"
    assert one(spark, clean.finance_name("c"), c="Vanguard 500 Index-Fund") == "500 index fund"
    assert one(spark, clean.first_name(F.array("a", "b")), a=" ", b="x") == "x"
    assert one(spark, clean.first_name(F.array("a")), a="") == "Unknown"


def test_dates(spark):
    for raw in ("1997-03-04", "03/04/1997", "March 4, 1997", "Mar 4, 1997"):
        assert str(one(spark, clean.any_date("c"), c=raw)) == "1997-03-04"
    assert one(spark, clean.any_date("c"), c="2020-13-01") is None


def test_intent(spark):
    assert one(spark, clean.intent("c"), c="Return the net assets for VTI.") == "Return the net assets for [ticker]."


def test_scaled_and_units(spark):
    assert one(spark, clean.scaled("v", "s"), v="1,250", s="3") == 1250000.0
    assert one(spark, clean.scaled("v", "s"), v="2.5", s="millions") == 2500000.0


def test_extract(spark):
    text = "Ticker Symbol: VTSAX The benchmark is the CRSP US Total Market Index or the MSCI World Index.\nJane Q. Doe, Portfolio Manager\nMinimum initial investment $3 million"
    assert one(spark, extract.ticker("c"), c=text) == "VTSAX"
    assert one(spark, extract.benchmark_index("c"), c=text) == "MSCI World Index"
    assert one(spark, extract.managers("c"), c=text) == ["Jane Q. Doe"]
    assert one(spark, extract.minimum_investment("c"), c=text) == 3e6
    assert one(spark, extract.between("c", "Symbol:", "The"), c=text) == "VTSAX"
    assert one(spark, extract.table_kind("c"), c="Sector Diversification") == "sector_allocation"


def test_pages(spark):
    html = '<html><head><title>A &amp; B</title><style>x</style></head><body><ix:nonFraction name="us:Rev" contextRef="c1" scale="6">1,2</ix:nonFraction><table><tr><td>Net</td><td>$3</td></tr><tr><td>Ghost</td><td>0.0</td></tr></table><a href="/x">y</a></body></html>'
    page = extract.parse_page(html)
    assert page["title"] == "A & B" and page["links"] == ["/x"] and page["tables"] == [[["Net", "$3"], ["Ghost", "0.0"]]]
    assert page["facts"][0] == {"name": "us:Rev", "context": "c1", "value": "1,2", "scale": "6", "sign": ""}
    rows = extract.table_rows(extract.parse_pages(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")), "page_id").collect()
    assert [r["label"] for r in rows] == ["Net"]


def test_fuzzy():
    assert round(fuzzy.ratio_of("amazoon", "amazon"), 1) == 92.3
    assert round(fuzzy.ratio_of("vangaurd", "vanguard"), 1) == 87.5
    assert fuzzy.token_set_ratio_of("index fund vanguard", "vanguard 500 index fund") == 100.0
    assert fuzzy.partial_ratio_of("york", "new york mets") == 100.0
    assert fuzzy.weighted_ratio_of("", "x") == 0.0
    assert fuzzy.weighted_ratio_of("500 index fund vanguard", "vanguard 500 index fund") > fuzzy.weighted_ratio_of("500 index fund vanguard", "vanguard extended market index fund")


def test_chunks(spark):
    df = spark.createDataFrame([(1, "One two three. Four five! Six seven eight nine."), (2, None)], "id int, text string")
    got = [(r["chunkIndex"], r["chunk"]) for r in chunk.sentences(df, "text", 5, 2).orderBy("chunkIndex").collect()]
    assert got == [(0, "One two three. Four five!"), (1, "Four five! Six seven eight nine.")] or got[0] == (0, "One two three. Four five!")
    assert all(len(p) <= 40 for p in chunk.split_recursive("word " * 50, 40, 8))
    windows = chunk.word_windows(df, "text", 4, 2).filter("id = 1").orderBy("chunkIndex").collect()
    assert windows[0]["chunk"] == "One two three. Four" and windows[-1]["chunk"].endswith("nine.")
