"""Syntax trees of queries."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    pass


@dataclass
class Literal(Expr):
    value: object


@dataclass
class Param(Expr):
    name: str


@dataclass
class Var(Expr):
    name: str


@dataclass
class Prop(Expr):
    var: str
    name: str


@dataclass
class Call(Expr):
    name: str
    args: list[Expr]
    distinct: bool = False
    star: bool = False


@dataclass
class Unary(Expr):
    op: str
    arg: Expr


@dataclass
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass
class ListOf(Expr):
    items: list[Expr]


@dataclass
class Index(Expr):
    of: Expr
    at: Expr


@dataclass
class Case(Expr):
    whens: list[tuple[Expr, Expr]]
    default: Expr | None
    subject: Expr | None = None


@dataclass
class HasLabel(Expr):
    var: str
    labels: list[str]


@dataclass
class Exists(Expr):
    paths: list[Path]
    where: Expr | None = None


@dataclass
class Node:
    var: str | None
    labels: list[str] = field(default_factory=list)
    props: dict[str, Expr] = field(default_factory=dict)


@dataclass
class Rel:
    var: str | None
    types: list[str] = field(default_factory=list)
    props: dict[str, Expr] = field(default_factory=dict)
    direction: str = ">"  # ">", "<" or "-"


@dataclass
class Path:
    nodes: list[Node]
    rels: list[Rel]


@dataclass
class Match:
    paths: list[Path]
    where: Expr | None = None
    optional: bool = False


@dataclass
class Item:
    expr: Expr
    alias: str


@dataclass
class Order:
    expr: Expr
    descending: bool = False


@dataclass
class Projection:
    """WITH or RETURN."""

    items: list[Item]
    distinct: bool = False
    order: list[Order] = field(default_factory=list)
    skip: Expr | None = None
    limit: Expr | None = None
    where: Expr | None = None
    final: bool = False


@dataclass
class Unwind:
    expr: Expr
    alias: str


@dataclass
class Procedure:
    """CALL of a vector or full-text index."""

    name: str
    args: list[Expr]
    yields: list[tuple[str, str]]


@dataclass
class Query:
    clauses: list
    union: Query | None = None
    union_all: bool = False


AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}


def walk(x):
    """A tree's parts, itself first."""
    if isinstance(x, (list, tuple)):
        for y in x:
            yield from walk(y)
    elif isinstance(x, dict):
        yield from walk(list(x.values()))
    elif hasattr(x, "__dataclass_fields__"):
        yield x
        for name in x.__dataclass_fields__:
            yield from walk(getattr(x, name))


def aggregates(x: Call) -> bool:
    """A mean over a list is arithmetic, not an aggregate."""
    return x.name in AGGREGATES and not (x.name == "avg" and len(x.args) == 1 and isinstance(x.args[0], ListOf))


def has_aggregate(x) -> bool:
    return any(isinstance(y, Call) and aggregates(y) for y in walk(x))
