"""Syntax trees: labels, expressions, patterns, statements."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields, is_dataclass

# ---- labels: nested tuples ("name", x) ("any",) ("and", a, b) ("or", a, b) ("not", a)


def label_holds(expr: tuple | None, labels: frozenset[str]) -> bool:
    if expr is None:
        return True
    match expr:
        case ("name", name):
            return name in labels
        case ("any",):
            return bool(labels)
        case ("and", a, b):
            return label_holds(a, labels) and label_holds(b, labels)
        case ("or", a, b):
            return label_holds(a, labels) or label_holds(b, labels)
        case ("not", a):
            return not label_holds(a, labels)
    raise ValueError(expr)


def label_names(expr: tuple | None) -> list[str]:
    if expr is None:
        return []
    return [expr[1]] if expr[0] == "name" else [n for x in expr[1:] for n in label_names(x)]


# ---- expressions


@dataclass(eq=False)
class Expr:
    pass


@dataclass(eq=False)
class Lit(Expr):
    value: object


@dataclass(eq=False)
class ListLit(Expr):
    items: list


@dataclass(eq=False)
class Rec(Expr):
    fields: dict[str, Expr]


@dataclass(eq=False)
class Var(Expr):
    name: str


@dataclass(eq=False)
class Attr(Expr):
    base: Expr
    name: str


@dataclass(eq=False)
class Bin(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(eq=False)
class Un(Expr):
    op: str  # "-" or "NOT"
    arg: Expr


@dataclass(eq=False)
class IsNull(Expr):
    arg: Expr
    negated: bool


@dataclass(eq=False)
class IsType(Expr):
    arg: Expr
    type: tuple


@dataclass(eq=False)
class AsType(Expr):
    arg: Expr
    type: tuple


@dataclass(eq=False)
class Case(Expr):
    arms: list[tuple[Expr, Expr]]
    other: Expr | None


@dataclass(eq=False)
class Call(Expr):
    name: str
    args: list[Expr]


@dataclass(eq=False)
class Cast(Expr):
    arg: Expr
    type: str  # INTEGER or FLOAT


@dataclass(eq=False)
class Comprehension(Expr):
    var: str
    source: Expr
    where: Expr | None
    body: Expr


@dataclass(eq=False)
class Agg(Expr):
    kind: str  # COUNT SUM AVG MIN MAX COLLECT_LIST
    distinct: bool
    arg: Expr | None  # None: COUNT(*)


@dataclass(eq=False)
class Exists(Expr):
    query: Query
    negated: bool


@dataclass(eq=False)
class Value(Expr):
    query: Query


# ---- patterns


@dataclass(eq=False)
class Pattern:
    pass


@dataclass(eq=False)
class NodeP(Pattern):
    var: str | None = None
    label: tuple | None = None
    values: list[tuple[str, Expr]] = field(default_factory=list)
    types: list[tuple[str, tuple]] = field(default_factory=list)
    where: Expr | None = None
    closed: bool = False


@dataclass(eq=False)
class EdgeP(Pattern):
    dir: str = "->"  # -> <- ~ -
    var: str | None = None
    label: tuple | None = None
    values: list[tuple[str, Expr]] = field(default_factory=list)
    types: list[tuple[str, tuple]] = field(default_factory=list)
    where: Expr | None = None
    closed: bool = False


@dataclass(eq=False)
class Concat(Pattern):
    items: list[Pattern]


@dataclass(eq=False)
class UnionP(Pattern):
    arms: list[Pattern]


@dataclass(eq=False)
class FilterP(Pattern):
    inner: Pattern
    where: Expr


@dataclass(eq=False)
class Repeat(Pattern):
    inner: Pattern
    low: int
    high: int | None


@dataclass(eq=False)
class Maybe(Pattern):
    inner: Pattern


@dataclass(eq=False)
class Join(Pattern):
    operands: list[Pattern]


@dataclass(frozen=True)
class Prefix:
    mode: str = "WALK"  # WALK TRAIL SIMPLE ACYCLIC
    search: str = "ALL"  # ALL ANY SHORTEST GROUPS
    count: int = 1


@dataclass(eq=False)
class Selected(Pattern):
    prefix: Prefix
    inner: Pattern


@dataclass(eq=False)
class Named(Pattern):
    var: str
    inner: Pattern


# ---- statements


@dataclass(eq=False)
class Match:
    pattern: Pattern
    where: Expr | None
    optional: bool = False


@dataclass(eq=False)
class Nearest:
    k: int
    rows: bool
    var: str
    attr: str
    target: Expr
    alias: str | None


@dataclass(eq=False)
class SortKey:
    expr: Expr
    descending: bool = False
    nulls_first: bool = False


@dataclass(eq=False)
class Item:
    expr: Expr
    alias: str | None


@dataclass(eq=False)
class Query:
    matches: list[Match]
    nearest: Nearest | None = None
    returns: list[Item] | None = None
    distinct: bool = False
    group_by: list[Expr] | None = None
    order_by: list[SortKey] = field(default_factory=list)
    limit: int | None = None


@dataclass(eq=False)
class Change:
    """A data-modifying statement: ``kind`` is INSERT, SET, REMOVE or DELETE."""

    kind: str
    matches: list[Match]
    patterns: list[Pattern] = field(default_factory=list)  # INSERT
    items: list[tuple] = field(default_factory=list)  # SET: (var, attr|None, labels|None, expr); REMOVE: (var, attr, labels)
    targets: list[Expr] = field(default_factory=list)  # DELETE
    detach: bool = False
    returns: list[Item] | None = None
    order_by: list[SortKey] = field(default_factory=list)
    limit: int | None = None


@dataclass(eq=False)
class Ddl:
    kind: str
    name: str | None = None
    body: object = None


def walk(node: object, into_subqueries: bool = True) -> Iterator[object]:
    """The node and everything below it."""
    if isinstance(node, (list, tuple)):
        for x in node:
            yield from walk(x, into_subqueries)
    elif isinstance(node, dict):
        for x in node.values():
            yield from walk(x, into_subqueries)
    elif is_dataclass(node) and not isinstance(node, type):
        yield node
        if not into_subqueries and isinstance(node, (Exists, Value)):
            return
        for f in fields(node):
            yield from walk(getattr(node, f.name), into_subqueries)
