"""Syntax tree to DataFrame plan.

A node variable ``f`` stands for columns ``f$<property>`` of its vertex table (``f$__id`` is the key), an edge variable
for the columns of its edge table; Catalyst prunes what a query does not read. Clauses follow the usual rules: a
pattern is a chain of equi-joins, an optional pattern is joined as a whole or yields nulls as a whole, predicates on
patterns are semi and anti joins, results group by their items without aggregates, nulls sort as the largest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from fathomline.plans.catalog import STANDARD, Catalog
from fathomline.plans.language import tree as t
from fathomline.plans.language.parse import QueryError, parse

ID = "__id"


@dataclass
class Graph:
    """Vertex tables by label and edge tables by type; an edge table has src, dst and its properties."""

    vertices: dict[str, DataFrame]
    edges: dict[str, DataFrame]
    catalog: Catalog = STANDARD
    #: Vector and full-text search: name -> function(graph, args) giving rows (__id, score).
    indexes: dict[str, Callable] = field(default_factory=dict)
    #: Labels of the vertices that an index's rows are.
    index_labels: dict[str, str] = field(default_factory=dict)
    #: Key columns of labels whose edges do not use the catalog's key.
    keys: dict[str, str] = field(default_factory=dict)

    def vertex(self, label: str) -> DataFrame:
        if label in self.vertices:
            return self.vertices[label]
        parents = self.catalog.vertices[label].parents if label in self.catalog.vertices else ()
        for p in parents:
            if p in self.vertices and "labels" in self.vertices[p].columns:
                return self.vertices[p].filter(F.array_contains("labels", label))
        raise QueryError(f"no vertices {label}", "UNKNOWN_LABEL")

    def key(self, label: str) -> str:
        known = self.catalog.vertices.get(label)
        return self.keys.get(label) or (known.key if known else "id")


@dataclass
class Frame:
    """Rows so far, with what each name stands for: ('node', labels), ('edge', type) or ('value',)."""

    df: DataFrame | None = None
    scope: dict[str, tuple] = field(default_factory=dict)


class Compiler:
    def __init__(self, graph: Graph, params: dict | None = None):
        self.graph, self.params, self.fresh = graph, params or {}, count()

    def run(self, query: t.Query) -> DataFrame:
        frame = Frame()
        for clause in query.clauses:
            frame = getattr(self, f"do_{type(clause).__name__.lower()}")(frame, clause)
        df = frame.df
        if query.union:
            df = df.unionByName(self.run(query.union))
            df = df if query.union_all else df.distinct()
        return df

    # patterns

    def node_rows(self, node: t.Node, var: str) -> DataFrame:
        if not node.labels:
            raise QueryError(f"({var}) needs a label where it first appears", "UNKNOWN_LABEL")
        main = max(node.labels, key=lambda x: x in self.graph.vertices)
        df = self.graph.vertex(main)
        for label in node.labels:
            if label != main and "labels" in df.columns:
                df = df.filter(F.array_contains("labels", label))
        df = df.select(F.col(self.graph.key(main)).alias(f"{var}${ID}"), *[F.col(c).alias(f"{var}${c}") for c in df.columns])
        return self.with_props(df, var, node.props)

    def with_props(self, df: DataFrame, var: str, props: dict[str, t.Expr]) -> DataFrame:
        for name, value in props.items():
            if f"{var}${name}" not in df.columns:
                raise QueryError(f"{var} has no property {name}", "UNKNOWN_PROPERTY")
            df = df.filter(F.col(f"{var}${name}") == self.expr(value, Frame()))
        return df

    def joins(self, name: str, source: str | None, target: str | None) -> bool:
        return name not in self.graph.catalog.edges or self.graph.catalog.joins(name, source, target)

    def edge_rows(self, rel: t.Rel, var: str, left: str | None, right: str | None) -> DataFrame:
        """Edges of a step between nodes of two labels (None: any); ends of other kinds share no keys with them."""
        for name in rel.types:
            if name not in self.graph.edges:
                raise QueryError(f"no edges {name}", "UNKNOWN_REL_TYPE")
        parts = []
        for name in rel.types or sorted(self.graph.edges):
            ways = [(">", left, right)] if rel.direction == ">" else [("<", right, left)] if rel.direction == "<" else [(">", left, right), ("<", right, left)]
            for way, source, target in ways:
                if not self.joins(name, source, target) and (rel.direction == "-" or not rel.types):
                    continue
                e = self.graph.edges[name]
                if len(rel.types) != 1:  # keys of different tables meet as text
                    e = e.withColumns({c: F.col(c).cast("string") for c in ("src", "dst")})
                ends = {"src": "dst", "dst": "src"} if rel.direction == "-" and way == "<" else {}
                parts.append(e.select(*[F.col(ends.get(c, c)).alias(f"{var}${c}") for c in e.columns], F.lit(name).alias(f"{var}$__type")))
        if not parts:
            raise QueryError(f"no edges between {left} and {right}", "UNKNOWN_REL_TYPE")
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return self.with_props(df, var, rel.props)

    def same(self, left: Column, right: Column, mixed: bool) -> Column:
        return left.cast("string") == right.cast("string") if mixed else left == right

    def free_end(self, paths: list[t.Path], where: t.Expr | None, shared: list[str]) -> str | None:
        """The one bound variable of a path that begins or ends with it and reads nothing but its key.

        Such a path needs no rows so far: its first edge has the keys.
        """
        if len(shared) != 1 or len(paths) != 1 or not paths[0].rels:
            return None
        at = [n for n in paths[0].nodes if n.var == shared[0]]
        reads = any(isinstance(x, (t.Prop, t.HasLabel)) and x.var == shared[0] or isinstance(x, t.Var) and x.name == shared[0] or isinstance(x, t.Exists) for x in t.walk(where))
        path = paths[0]
        edge = path.rels[0] if at[0] is path.nodes[0] else path.rels[-1] if at[0] is path.nodes[-1] else None
        plain = edge is not None and len(edge.types) == 1 and not at[0].labels and not at[0].props
        return shared[0] if len(at) == 1 and plain and not reads else None

    def join_paths(self, frame: Frame, paths: list[t.Path]) -> Frame:
        """Inner join of a pattern onto the rows so far; without rows, a bound variable stands for the edges' keys."""
        df, scope = frame.df, dict(frame.scope)
        used: dict[str, list[str]] = {}
        for path in paths:
            names = [n.var or f"_n{next(self.fresh)}" for n in path.nodes]
            rels = [r.var or f"_r{next(self.fresh)}" for r in path.rels]
            order = self.start(path, names, scope)
            seen: set[int] = set()
            for i in order:
                node, var = path.nodes[i], names[i]
                bound = var in scope
                if not bound and (node.labels or not seen):
                    right = self.node_rows(node, var)
                else:
                    right = None
                if not seen:
                    if right is not None:
                        df = right if df is None else df.join(right)
                        scope[var] = ("node", node.labels)
                    elif node.props and df is not None:
                        df = self.with_props(df, var, node.props)
                    seen.add(i)
                    continue
                other = i - 1 if i - 1 in seen else i + 1
                k = min(i, other)
                rel, edge = path.rels[k], rels[k]
                kinds = [next(iter(path.nodes[j].labels or scope.get(names[j], ("", []))[1]), None) for j in (k, k + 1)]
                rows, mixed = self.edge_rows(rel, edge, *kinds), len(rel.types) != 1
                forward = (rel.direction != "<") == (k == other)
                near, far = ("src", "dst") if forward else ("dst", "src")
                if df is None:
                    df = rows.withColumn(f"{names[other]}${ID}", F.col(f"{edge}${near}"))
                else:
                    df = df.join(rows, self.same(F.col(f"{names[other]}${ID}"), F.col(f"{edge}${near}"), mixed))
                there = F.col(f"{edge}${far}")
                if bound:
                    df = df.filter(self.same(F.col(f"{var}${ID}"), there, mixed))
                elif right is not None:
                    df = df.join(right, self.same(there, F.col(f"{var}${ID}"), mixed))
                    scope[var] = ("node", node.labels)
                else:
                    df = df.withColumn(f"{var}${ID}", there)
                    scope[var] = ("node", [])
                for before in used.get("|".join(rel.types), []):
                    df = df.filter(~((F.col(f"{before}$src") == F.col(f"{edge}$src")) & (F.col(f"{before}$dst") == F.col(f"{edge}$dst"))))
                used.setdefault("|".join(rel.types), []).append(edge)
                scope[edge] = ("edge", rel.types)
                seen.add(i)
        return Frame(df, scope)

    def start(self, path: t.Path, names: list[str], scope: dict) -> list[int]:
        """An order of the nodes that begins at a bound one, or else at the first that has a label, and stays connected."""
        bound = [i for i, n in enumerate(names) if n in scope]
        first = bound[0] if bound else next((i for i, n in enumerate(path.nodes) if n.props), 0)
        if not bound and not path.nodes[first].labels:
            first = next((i for i, n in enumerate(path.nodes) if n.labels), 0)
        return [first, *range(first + 1, len(names)), *range(first - 1, -1, -1)]

    def do_match(self, frame: Frame, clause: t.Match) -> Frame:
        if not clause.optional:
            out = self.join_paths(frame, clause.paths)
            return self.filtered(out, clause.where)
        if frame.df is None:
            raise QueryError("OPTIONAL MATCH needs rows before it")
        shared = sorted({n.var for p in clause.paths for n in p.nodes if n.var in frame.scope})
        keys = [f"{v}${ID}" for v in shared]
        base = frame.df.select(*keys).distinct() if keys and not self.free_end(clause.paths, clause.where, shared) else None
        inner = self.filtered(self.join_paths(Frame(base, {v: frame.scope[v] for v in shared}), clause.paths), clause.where)
        new = {k: v for k, v in inner.scope.items() if k not in frame.scope}
        columns = [c for c in inner.df.columns if c.split("$")[0] in new]
        right = inner.df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *columns)
        on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)], F.lit(True))
        df = frame.df.join(right, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])
        return Frame(df, {**frame.scope, **new})

    # predicates

    def conjuncts(self, e: t.Expr | None) -> list[t.Expr]:
        if e is None:
            return []
        if isinstance(e, t.Binary) and e.op == "AND":
            return [*self.conjuncts(e.left), *self.conjuncts(e.right)]
        return [e]

    def filtered(self, frame: Frame, where: t.Expr | None) -> Frame:
        if t.has_aggregate(where):
            raise QueryError("no aggregates in WHERE", "AGGREGATE_IN_WHERE")
        for e in self.conjuncts(where):
            inner, how = (e.arg, "left_anti") if isinstance(e, t.Unary) and e.op == "NOT" else (e, "left_semi")
            if isinstance(inner, t.Exists):
                frame = self.semi(frame, inner, how)
            else:
                frame = Frame(frame.df.filter(self.expr(e, frame)), frame.scope)
        return frame

    def semi(self, frame: Frame, e: t.Exists, how: str) -> Frame:
        shared = sorted({n.var for p in e.paths for n in p.nodes if n.var in frame.scope})
        if not shared:
            raise QueryError("a pattern predicate needs a bound variable")
        base = None if self.free_end(e.paths, e.where, shared) else frame.df.select(*[f"{v}${ID}" for v in shared]).distinct()
        inner = self.filtered(self.join_paths(Frame(base, {v: frame.scope[v] for v in shared}), e.paths), e.where).df
        right = inner.select(*[F.col(f"{v}${ID}").alias(f"_k{i}") for i, v in enumerate(shared)])
        on = reduce(lambda a, b: a & b, [F.col(f"{v}${ID}") == F.col(f"_k{i}") for i, v in enumerate(shared)])
        return Frame(frame.df.join(right, on, how), frame.scope)

    # rows

    def do_unwind(self, frame: Frame, clause: t.Unwind) -> Frame:
        if frame.df is None:
            spark = next(iter(self.graph.vertices.values())).sparkSession
            frame = Frame(spark.range(1).select(F.lit(1).alias("_one")), {})
        df = frame.df.withColumn(clause.alias, F.explode(self.expr(clause.expr, frame)))
        return Frame(df, {**frame.scope, clause.alias: ("value",)})

    def do_procedure(self, frame: Frame, clause: t.Procedure) -> Frame:
        args = [a.value if isinstance(a, t.Literal) else self.params[a.name] if isinstance(a, t.Param) else None for a in clause.args]
        name = args[0]
        if name not in self.graph.indexes:
            raise QueryError(f"no index {name!r}", "UNKNOWN_INDEX")
        names = dict(clause.yields)
        if "node" not in names:
            raise QueryError("an index search yields node", "SCORE_NOT_YIELDED")
        var, label = names["node"], self.graph.index_labels[name]
        hits = self.graph.indexes[name](self.graph, args[1:]).select(F.col(ID).alias("_hit"), F.col("score").alias(names.get("score", f"_s{next(self.fresh)}")))
        rows = self.node_rows(t.Node(var, [label]), var)
        df = rows.join(hits, F.col(f"{var}${ID}") == F.col("_hit")).drop("_hit")
        scope = {var: ("node", [label]), **({names["score"]: ("value",)} if "score" in names else {})}
        return Frame(df if frame.df is None else frame.df.join(df), {**frame.scope, **scope})

    def do_projection(self, frame: Frame, clause: t.Projection) -> Frame:
        items = clause.items
        if len(items) == 1 and isinstance(items[0].expr, t.Var) and items[0].expr.name == "*":
            raise QueryError("name what to return")
        scope: dict[str, tuple] = {}
        columns: list[Column] = []
        extra = [x for o in clause.order for x in t.walk(o.expr) if isinstance(x, (t.Prop, t.Var))]
        if any(t.has_aggregate(i.expr) for i in items):
            keys = [i for i in items if not t.has_aggregate(i.expr)]
            groups, back = [], []
            for i in keys:
                if isinstance(i.expr, t.Var) and frame.scope.get(i.expr.name, ("value",))[0] != "value":
                    own = [c for c in frame.df.columns if c.startswith(f"{i.expr.name}$")]
                    groups += [F.col(c) for c in own]
                    back += [F.col(c).alias(i.alias + c[len(i.expr.name) :]) for c in own]
                    scope[i.alias] = frame.scope[i.expr.name]
                else:
                    groups.append(self.expr(i.expr, frame).alias(i.alias))
                    back.append(F.col(f"`{i.alias}`"))
                    scope[i.alias] = ("value",)
            aggs = [self.expr(i.expr, frame).alias(i.alias) for i in items if t.has_aggregate(i.expr)]
            scope.update({i.alias: ("value",) for i in items if t.has_aggregate(i.expr)})
            df = frame.df.groupBy(*groups).agg(*aggs)
            df = df.select(*back, *[F.col(f"`{i.alias}`") for i in items if t.has_aggregate(i.expr)])
            if clause.final:
                df = self.final(df, items, scope)
            out = Frame(df, scope)
        else:
            for i in items:
                kind = frame.scope.get(i.expr.name, ("value",)) if isinstance(i.expr, t.Var) else ("value",)
                if kind[0] != "value" and not clause.final:
                    columns += [F.col(c).alias(i.alias + c[len(i.expr.name) :]) for c in frame.df.columns if c.startswith(f"{i.expr.name}$")]
                elif kind[0] != "value":
                    own = [c for c in frame.df.columns if c.startswith(f"{i.expr.name}$") and "$__" not in c]
                    columns.append(F.struct(*[F.col(c).alias(c.split("$", 1)[1]) for c in own]).alias(i.alias))
                else:
                    columns.append(self.expr(i.expr, frame).alias(i.alias))
                scope[i.alias] = kind
            hidden = {}
            if clause.order and not clause.distinct:
                # what is sorted by need not be returned
                for n, x in enumerate(extra):
                    if isinstance(x, t.Prop) and x.var in frame.scope:
                        hidden[f"_o{n}"] = self.expr(x, frame)
            df = frame.df.select(*columns, *[c.alias(k) for k, c in hidden.items()])
            if clause.distinct:
                df = df.distinct()
            out = Frame(df, scope)
        if clause.order:
            out = Frame(self.sorted(out, clause), scope)
        if clause.skip is not None:
            out = Frame(out.df.offset(int(self.constant(clause.skip))), scope)
        if clause.limit is not None:
            out = Frame(out.df.limit(int(self.constant(clause.limit))), scope)
        out = Frame(out.df.select(*[c for c in (f"`{x}`" for x in out.df.columns) if not c.startswith("`_o")]), scope)
        return self.filtered(out, clause.where) if clause.where is not None else out

    def final(self, df: DataFrame, items: list[t.Item], scope: dict) -> DataFrame:
        out = []
        for i in items:
            if scope[i.alias][0] == "value":
                out.append(F.col(f"`{i.alias}`"))
            else:
                out.append(F.struct(*[F.col(c).alias(c.split("$", 1)[1]) for c in df.columns if c.startswith(f"{i.alias}$") and "$__" not in c]).alias(i.alias))
        return df.select(*out)

    def sorted(self, out: Frame, clause: t.Projection) -> DataFrame:
        """Nulls are the largest values."""
        keys = []
        texts = {repr(i.expr): i.alias for i in clause.items}
        for o in clause.order:
            if repr(o.expr) in texts:
                c = F.col(f"`{texts[repr(o.expr)]}`")
            elif isinstance(o.expr, t.Var) and o.expr.name in out.df.columns:
                c = F.col(f"`{o.expr.name}`")
            else:
                c = self.order_expr(o.expr, out, clause)
            keys.append(c.desc_nulls_first() if o.descending else c.asc_nulls_last())
        return out.df.orderBy(*keys)

    def order_expr(self, e: t.Expr, out: Frame, clause: t.Projection) -> Column:
        hidden = [c for c in out.df.columns if c.startswith("_o")]
        extra = [x for o in clause.order for x in t.walk(o.expr) if isinstance(x, (t.Prop, t.Var))]
        if isinstance(e, t.Prop):
            for n, x in enumerate(extra):
                if x == e and f"_o{n}" in hidden:
                    return F.col(f"_o{n}")
        return self.expr(e, out)

    def constant(self, e: t.Expr):
        if isinstance(e, t.Literal):
            return e.value
        if isinstance(e, t.Param):
            return self.params[e.name]
        raise QueryError("a number is needed here")

    # expressions

    def expr(self, e: t.Expr, frame: Frame) -> Column:
        one = lambda x: self.expr(x, frame)
        if isinstance(e, t.Literal):
            return F.lit(e.value)
        if isinstance(e, t.Param):
            if e.name not in self.params:
                raise QueryError(f"no value for ${e.name}")
            value = self.params[e.name]
            return F.array(*map(F.lit, value)) if isinstance(value, (list, tuple)) else F.lit(value)
        if isinstance(e, t.Var):
            kind = frame.scope.get(e.name)
            if kind is None:
                raise QueryError(f"{e.name} is not defined", "UNDEFINED_VARIABLE")
            return F.col(f"`{e.name}`") if kind[0] == "value" else F.col(f"`{e.name}${ID}`") if kind[0] == "node" else F.col(f"`{e.name}$src`")
        if isinstance(e, t.Prop):
            if e.var not in frame.scope:
                raise QueryError(f"{e.var} is not defined", "UNDEFINED_REL_VAR")
            if frame.scope[e.var][0] == "value":
                return F.col(f"`{e.var}`")[e.name]
            if frame.df is not None and f"{e.var}${e.name}" not in frame.df.columns:
                raise QueryError(f"{e.var} has no property {e.name}", "UNKNOWN_PROPERTY")
            return F.col(f"`{e.var}${e.name}`")
        if isinstance(e, t.ListOf):
            return F.array(*map(one, e.items))
        if isinstance(e, t.Index):
            return F.get(one(e.of), one(e.at).cast("int"))
        if isinstance(e, t.HasLabel):
            known = frame.scope.get(e.var, ("", []))[1]
            return reduce(lambda a, b: a & b, [F.lit(True) if x in known else F.array_contains(F.col(f"`{e.var}$labels`"), x) for x in e.labels])
        if isinstance(e, t.Case):
            out = None
            for test, value in e.whens:
                c = one(test) if e.subject is None else one(e.subject) == one(test)
                out = F.when(c, one(value)) if out is None else out.when(c, one(value))
            return out if e.default is None else out.otherwise(one(e.default))
        if isinstance(e, t.Unary):
            a = one(e.arg)
            return {"NOT": lambda: ~a, "-": lambda: -a, "IS NULL": a.isNull, "IS NOT NULL": a.isNotNull}[e.op]()
        if isinstance(e, t.Binary):
            return self.binary(e, one)
        if isinstance(e, t.Call):
            return self.call(e, frame, one)
        if isinstance(e, t.Exists):
            raise QueryError("patterns stand alone or under NOT, joined by AND")
        raise QueryError(f"cannot read {e}")

    def binary(self, e: t.Binary, one) -> Column:
        if e.op == "IN" and isinstance(e.right, t.ListOf) and all(isinstance(x, t.Literal) for x in e.right.items):
            return one(e.left).isin([x.value for x in e.right.items])
        a, b = one(e.left), one(e.right)
        ops = {
            "AND": lambda: a & b, "OR": lambda: a | b, "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b,
            "+": lambda: F.concat(a, b) if self.text(e.left) or self.text(e.right) else a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b,
            "CONTAINS": lambda: F.contains(a, b), "STARTS": lambda: F.startswith(a, b), "ENDS": lambda: F.endswith(a, b), "IN": lambda: F.array_contains(b, a), "=~": lambda: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))),
        }
        return ops[e.op]()

    def text(self, e: t.Expr) -> bool:
        return isinstance(e, t.Literal) and isinstance(e.value, str) or isinstance(e, t.Binary) and e.op == "+" and (self.text(e.left) or self.text(e.right))

    def call(self, e: t.Call, frame: Frame, one) -> Column:
        if e.name == "avg" and len(e.args) == 1 and isinstance(e.args[0], t.ListOf):
            items = e.args[0].items
            return reduce(lambda a, b: a + b, map(one, items)) / len(items)
        if e.star:
            return F.count(F.lit(1))
        a = [one(x) for x in e.args]
        if e.name in t.AGGREGATES:
            if e.distinct:
                return {"count": F.countDistinct, "sum": F.sum_distinct, "collect": lambda x: F.sort_array(F.collect_set(x)), "avg": lambda x: F.avg(x), "min": F.min, "max": F.max}[e.name](*a)
            return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": lambda x: F.sort_array(F.collect_list(x))}[e.name](*a)
        if e.name == "labels":
            var = e.args[0].name
            known = frame.scope[var][1]
            return F.col(f"`{var}$labels`") if f"{var}$labels" in frame.df.columns else F.array(*map(F.lit, known))
        if e.name == "type":
            return F.col(f"`{e.args[0].name}$__type`")
        if e.name not in FUNCTIONS:
            raise QueryError(f"no function {e.name}", "UNKNOWN_FUNCTION")
        if e.name == "size" and frame.df is not None and frame.df.select(a[0]).schema[0].dataType.typeName() in ("array", "map"):
            return F.size(a[0])
        return FUNCTIONS[e.name](*a)


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "tolower": F.lower, "toupper": F.upper, "trim": F.trim, "size": lambda x: F.length(x), "length": F.length, "coalesce": F.coalesce, "abs": F.abs,
    "round": lambda x, d=None: F.round(x, 0) if d is None else F.bround(x, d), "tofloat": lambda x: x.cast("double"), "tointeger": lambda x: x.cast("long"), "tostring": lambda x: x.cast("string"),
    "date": lambda x: F.to_date(x), "year": F.year, "month": F.month, "day": F.dayofmonth, "elementid": lambda x: x.cast("string"), "id": lambda x: x, "head": lambda x: F.get(x, F.lit(0)),
    "substring": lambda x, a, n=None: F.substring(x, a + 1, F.length(x) if n is None else n), "replace": F.replace, "split": lambda x, s: F.split(x, s), "sqrt": F.sqrt, "floor": F.floor, "ceil": F.ceil,
    "timestamp": lambda: F.current_timestamp(),
}


def run(graph: Graph, text: str, **params) -> DataFrame:
    """The plan of a query text."""
    return Compiler(graph, params).run(parse(text))
