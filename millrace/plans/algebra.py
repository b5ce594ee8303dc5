"""The graph query language: AST, parser, rewrites, lowering to DataFrames.

    deps(x)  rdeps(x)  allpaths(a, b)  somepath(a, b)  filter("text", x)  union(a, b)  intersect(a, b)  //...  //name  name
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import graph


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class All(Expr):
    pass


@dataclass(frozen=True)
class Target(Expr):
    name: str


@dataclass(frozen=True)
class Deps(Expr):
    of: Expr


@dataclass(frozen=True)
class RDeps(Expr):
    of: Expr


@dataclass(frozen=True)
class AllPaths(Expr):
    start: Expr
    end: Expr


@dataclass(frozen=True)
class SomePath(Expr):
    start: Expr
    end: Expr


@dataclass(frozen=True)
class Filter(Expr):
    text: str
    of: Expr


@dataclass(frozen=True)
class Union(Expr):
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Intersect(Expr):
    left: Expr
    right: Expr


_TOKEN = re.compile(r"\s*(?:(?P<punct>[(),])|(?P<quoted>\"[^\"]*\"|'[^']*')|(?P<word>[^\s(),\"']+))")
_UNARY = {"deps": Deps, "rdeps": RDeps}
_BINARY = {"allpaths": AllPaths, "somepath": SomePath, "union": Union, "intersect": Intersect}


class QueryError(ValueError):
    """A query text that is not well formed."""


def parse(text: str) -> Expr:
    """Parses a query; malformed text raises QueryError instead of becoming a target of that name."""
    tokens, at = [], 0
    stripped = text.rstrip()
    while at < len(stripped):
        m = _TOKEN.match(stripped, at)
        if not m:
            raise QueryError(f"unexpected text at {at}: {stripped[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    expr, rest = _expression(tokens, 0)
    if rest != len(tokens):
        raise QueryError(f"unexpected {tokens[rest][1]!r}")
    return expr


def _expect(tokens: list[tuple[str, str]], at: int, what: str) -> int:
    if at >= len(tokens) or tokens[at] != ("punct", what):
        raise QueryError(f"expected {what!r}")
    return at + 1


def _expression(tokens: list[tuple[str, str]], at: int) -> tuple[Expr, int]:
    if at >= len(tokens) or tokens[at][0] == "punct":
        raise QueryError("expected a target or a function")
    kind, value = tokens[at]
    at += 1
    if kind == "word" and at < len(tokens) and tokens[at] == ("punct", "("):
        at += 1
        if value in _UNARY:
            of, at = _expression(tokens, at)
            return _UNARY[value](of), _expect(tokens, at, ")")
        if value in _BINARY:
            left, at = _expression(tokens, at)
            right, at = _expression(tokens, _expect(tokens, at, ","))
            return _BINARY[value](left, right), _expect(tokens, at, ")")
        if value == "filter":
            if at >= len(tokens) or tokens[at][0] == "punct":
                raise QueryError("filter needs a text")
            pattern = tokens[at][1].strip("\"'") if tokens[at][0] == "quoted" else tokens[at][1]
            of, at = _expression(tokens, _expect(tokens, at + 1, ","))
            return Filter(pattern, of), _expect(tokens, at, ")")
        raise QueryError(f"unknown function {value!r}")
    name = value[1:-1] if kind == "quoted" else value
    if name in ("//...", "*"):
        return All(), at
    return Target(name.removeprefix("//")), at


def optimise(e: Expr) -> Expr:
    """Rewrites before any DataFrame exists: closures are idempotent and spread over unions, equal sides meet in themselves, filters run in one pass."""
    match e:
        case Deps(of) | RDeps(of):
            kind, inner = type(e), optimise(of)
            if isinstance(inner, (kind, All)):
                return inner
            return kind(inner)
        case Union(a, b):
            a, b = optimise(a), optimise(b)
            if a == b or isinstance(a, All):
                return a
            if isinstance(b, All):
                return b
            if type(a) is type(b) and isinstance(a, (Deps, RDeps)):
                return type(a)(Union(a.of, b.of))
            return Union(a, b)
        case Intersect(a, b):
            a, b = optimise(a), optimise(b)
            if a == b or isinstance(b, All):
                return a
            return b if isinstance(a, All) else Intersect(a, b)
        case AllPaths(a, b):
            return Intersect(optimise(Deps(a)), optimise(RDeps(b)))
        case SomePath(a, b):
            return SomePath(optimise(a), optimise(b))
        case Filter(t, of):
            return Filter(t, optimise(of))
    return e


def evaluate(e: Expr | str, nodes: DataFrame, edges: DataFrame, name: Column | None = None) -> DataFrame:
    """Ids that the query selects. name resolves the name of a node, by default its column name."""
    names = nodes.select("id", (name if name is not None else F.col("name")).alias("name"))

    def lower(e: Expr) -> DataFrame:
        match e:
            case All():
                return names.select("id")
            case Target(n):
                return names.where(F.col("name") == n).select("id")
            case Deps(of):
                return graph.closure(edges, lower(of))
            case RDeps(of):
                return graph.closure(edges, lower(of), reverse=True)
            case SomePath(a, b):
                return graph.some_path(edges, lower(a), lower(b)).select("id")
            case Filter(t, of):
                return names.where(F.col("name").contains(t)).join(lower(of), "id", "left_semi").select("id")
            case Union(a, b):
                return lower(a).union(lower(b)).distinct()
            case Intersect(a, b):
                return lower(a).intersect(lower(b))
        raise TypeError(e)

    return lower(optimise(parse(e) if isinstance(e, str) else e))
