"""From a question to rows, with scripted models."""

import pytest

from fathomline.plans import ask
from fathomline.plans.fixture import FundGraph


@pytest.fixture(scope="module")
def graph(spark, sf):
    return FundGraph(spark, sf).graph()


def scripted(*texts):
    seen = []

    def model(prompt):
        seen.append(prompt)
        text = texts[min(len(seen), len(texts)) - 1]
        if isinstance(text, type):
            raise text
        return text

    model.seen = seen
    return model


def test_second_try(graph):
    model = scripted("MATCH (f:Fonds) RETURN f.name AS name", "```cypher\nMATCH (f:Fund {ticker: 7}) RETURN f.name AS name\n```")
    got = ask.answer(graph, "fund 7?", ["fund_basic"], model, entities={"fund"})
    assert got.attempts == 2 and got.failures == ["UNKNOWN_LABEL"] and "Use only the labels" in model.seen[1]
    row = got.rows.collect()
    assert len(row) == 1 and set(got.rows.columns) == {"name", "provider", "trust"} and "provider and trust added" in got.fixes
    assert got.follow_ups == ["fund_overview", "fund_returns"] and "Kind:" in ask.prompt(got)


def test_refusals(graph):
    assert ask.answer(graph, "x", ["fund_basic"], scripted("MATCH (f:Fund) DELETE f")).failures == ["WRITE_OPERATION"]
    assert ask.answer(graph, "x", ["not_related"], scripted("")).failures == ["NOT_RELATED"]
    assert "Nothing" in ask.prompt(ask.answer(graph, "x", ["not_related"], scripted("")))


def test_overflow_and_fallback():
    model = scripted(OverflowError, "MATCH (f:Fund) RETURN f.name")
    assert ask.translate("q", ["fund_basic"], model, ["e1", "e2", "e3", "e4"]).query and "e2" in model.seen[1] and "e3" not in model.seen[1]
    got = ask.translate("q", ["fund_basic"], scripted("nonsense"), fallback=scripted("MATCH (f:Fund) RETURN f.name"))
    assert got.attempts == 4 and got.query


def test_slices():
    text = ask.slice_text(["fund_portfolio"])
    assert "(Portfolio)-[:HAS_HOLDING" in text and "Filing10K" not in text
