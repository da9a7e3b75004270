"""From a question to rows: translation by a caller's model, checks, rewrites, the run, and what follows it.

The model is a function from a prompt to text. It gets the part of the catalog that the question's labels need, the
nearest examples, and, after a failure, the rule that was broken with a hint.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from fathomline.operators import post
from fathomline.plans import rules
from fathomline.plans.catalog import STANDARD, Catalog
from fathomline.plans.language.compile import Compiler, Graph
from fathomline.plans.language.parse import QueryError

ATTEMPTS = 3
Translator = Callable[[str], str]

# Labels of the catalog that each category of question needs.
SLICES = {
    "fund_basic": ("Provider", "Trust", "Fund", "ShareClass", "FinancialHighlight", "AverageReturns"),
    "fund_portfolio": ("Fund", "Portfolio", "Holding", "AssetCategory", "Sector", "Region", "Company"),
    "fund_profile": ("Fund", "Profile", "Section", "Objective", "Strategy", "Risk", "PerformanceCommentary", "Chunk", "Person"),
    "company_people": ("Company", "Person", "CompensationPackage", "InsiderTransaction"),
    "company_filing": ("Company", "Filing10K", "Section", "RiskFactor", "BusinessInformation", "LegalProceeding", "ManagementDiscussion", "Properties", "Financials", "FinancialMetric", "Segment", "Chunk"),
}

HINTS = {
    "UNKNOWN_LABEL": "Use only the labels listed.",
    "UNKNOWN_REL_TYPE": "Use only the edges listed.",
    "UNDEFINED_REL_VAR": "Name the edge in its brackets before reading its properties.",
    "FH_PROPERTY_ON_FUND": "Yearly measures belong to FinancialHighlight; the year to the edge that leads to it.",
    "AGGREGATE_IN_WHERE": "Aggregate in WITH, then filter.",
    "WHERE_AFTER_RETURN": "WHERE stands before RETURN.",
    "INVALID_DATE_FUNCTION": "Take parts of dates as date(x).year.",
    "SCORE_NOT_YIELDED": "YIELD the score to use it.",
}


@dataclass
class Answer:
    question: str
    query: str | None = None
    fixes: list[str] = field(default_factory=list)
    failures: list[str] = field(default_factory=list)
    attempts: int = 0
    rows: DataFrame | None = None
    kind: str = "none"
    follow_ups: list[str] = field(default_factory=list)


def slice_text(labels: list[str], catalog: Catalog = STANDARD) -> str:
    """Labels with their properties and the edges between them, for the categories of a question."""
    wanted = {x for name in labels for x in SLICES.get(name, ())}
    nodes = [f"({v}: {', '.join(sorted(catalog.vertices[v].properties - {'embedding'}))})" for v in sorted(wanted)]
    edges = [f"({s})-[:{e.name}{' ' + str(sorted(e.properties)) if e.properties else ''}]->({d})" for e in catalog.edges.values() for s in e.source for d in e.target if s in wanted and d in wanted]
    return "\n".join([*nodes, *sorted(edges)])


def translate(question: str, labels: list[str], model: Translator, examples: list[str] = (), fallback: Translator | None = None, catalog: Catalog = STANDARD, attempts: int = ATTEMPTS) -> Answer:
    """A query for a question, in at most ``attempts`` tries and one by ``fallback``.

    A model that raises OverflowError (too long a prompt) is asked again with half the examples, then with none.
    Queries that would write are refused at once.
    """
    out, hint, shown = Answer(question), "", list(examples)
    for n in range(attempts + (fallback is not None)):
        ask = model if n < attempts else fallback
        out.attempts = n + 1
        while True:
            try:
                text = ask("\n\n".join(x for x in (slice_text(labels, catalog), "\n".join(shown), hint, f"Question: {question}") if x))
                break
            except OverflowError:
                if not shown:
                    raise
                shown = shown[: len(shown) // 2]
        verdict = rules.check(text, catalog)
        if verdict.valid:
            out.query, out.fixes = text, list(verdict.fixes)
            return out
        out.failures.append(verdict.rule or "")
        if verdict.rule == "WRITE_OPERATION":
            return out
        hint = f"The last query broke {verdict.rule}: {verdict.errors[0]}. {HINTS.get(verdict.rule or '', '')}"
    return out


def answer(graph: Graph, question: str, labels: list[str], model: Translator, params: dict | None = None, funds: dict | None = None, entities: set[str] = frozenset(), **options) -> Answer:
    """Rows for a question. A result whose expense ratios are all zero is asked again with those left out."""
    if labels == ["not_related"]:
        return Answer(question, failures=["NOT_RELATED"])
    out = translate(question, labels, model, **options)
    if out.query is None:
        return out
    values = dict(params or {})
    tree, fixes = rules.rewrite(rules.check(out.query).tree, funds, values)
    out.fixes += fixes
    try:
        out.rows = Compiler(graph, values).run(tree)
        if any("expense" in c.lower() for c in out.rows.columns) and rules.needs_guard([r.asDict() for r in out.rows.limit(post.MOST_ROWS).collect()]):
            out.fixes.append(rules.positive_ratio(tree) or "")
            out.rows = Compiler(graph, values).run(tree)
    except QueryError as e:
        out.failures.append(e.rule)
        return out
    out.rows = post.without_payload(out.rows)
    out.kind = post.kind_of(out.rows.columns, labels[0] if labels else None)
    out.follow_ups = [name for label in labels for name in post.enrichments(label, set(entities))]
    return out


def prompt(found: Answer, most: int = post.MOST_ROWS, width: int = 4000) -> str:
    """What a model is told so that it words the answer: kind, rows (cut to ``width`` characters each) and their number."""
    if found.rows is None:
        return f"Question: {found.question}\nNothing was found."
    rows, more = post.shown(found.rows, most)
    lines = [", ".join(f"{k}: {v}" for k, v in r.asDict().items())[:width] for r in rows.collect()]
    tail = [f"(the first {most} rows of more)"] if more else []
    return "\n".join([f"Question: {found.question}", f"Kind: {found.kind}", *(lines or ["No rows."]), *tail])
