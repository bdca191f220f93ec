"""Patterns to rows of bindings.

Chains of nodes and edges, and joins of them, are planned together: label expressions and the ends of
edge tables narrow each variable to the tables it can be in, nodes that add nothing to an edge are
never scanned, and the joins start where a value is fixed. Catalyst does the rest: filters move into
the scans and only the properties that the query reads are selected.
"""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import DST, EID, ID, SRC, EdgeTable, NodeTable, PropertyGraph, as_type, unified
from ..lang.lexer import GqlError
from ..lang.tree import (
    Attr, Bin, Call, Comprehension, Concat, EdgeP, Expr, FilterP, IsType, Join, Lit, Maybe, Named, NodeP, Pattern, Prefix, Repeat, Selected, UnionP, Var, label_holds, walk,
)
from .scope import Compiler, Rel, VarInfo, col, free_vars


#: The property that stands for the whole element: what a returned node or edge shows.
SELF = "__self"
SELF_TYPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("id", T.LongType()), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("props", T.StringType())])


def whole(kind: str, ident: Column, labels: frozenset[str], props: Iterable[str]) -> Column:
    names = sorted(props)
    text = F.to_json(F.struct(*[col(n) for n in names])) if names else F.lit("{}")
    marks = F.array(*[F.lit(x) for x in sorted(labels)]).cast("array<string>")
    return F.struct(F.lit(kind).alias("kind"), ident.alias("id"), marks.alias("labels"), text.alias("props")).cast(SELF_TYPE)


def attribute(t: NodeTable | EdgeTable, name: str, want: T.DataType) -> Column:
    """A property of the table's rows as a column; null where they lack it."""
    if name == SELF:
        kind = "node" if isinstance(t, NodeTable) else "edge"
        return whole(kind, F.col(ID if kind == "node" else EID), t.labels, t.props)
    return as_type(col(name), t.props[name], want) if name in t.props else F.lit(None).cast(want)


@dataclass
class _Node:
    var: str
    labels: list = field(default_factory=list)
    tables: list[NodeTable] = field(default_factory=list)


@dataclass
class _Edge:
    var: str
    dir: str
    label: tuple | None
    left: str
    right: str
    tables: list[EdgeTable] = field(default_factory=list)


@dataclass
class Hop:
    """One edge of a chain. ``rel`` has no path; ``once``: no two of its rows lead to the same node."""

    rel: Rel
    near: str
    edge: str
    far: str
    once: bool


class PatternPlanner:
    """Plans patterns over one graph; ``needs`` has the properties of each variable that are read."""

    def __init__(self, graph: PropertyGraph, statement: object):
        self.graph = graph
        self.spark = graph.spark
        self.needs: dict[str, set[str]] = {}
        self.path_attrs: set[str] = set()
        self.names = 0
        self.warnings: list[str] = []
        #: variables whose properties are at hand already: they are not read again
        self.bound: frozenset[str] = frozenset()
        elements = {x.var for x in walk(statement) if isinstance(x, Comprehension) and isinstance(x.source, Call) and x.source.name in ("NODES", "EDGES", "ELEMENTS")}
        for x in walk(statement):
            if isinstance(x, Attr) and isinstance(x.base, Var):
                self.needs.setdefault(x.base.name, set()).add(x.name)
                if x.base.name in elements:
                    self.path_attrs.add(x.name)

    def fresh(self, what: str) -> str:
        self.names += 1
        return f"__{what}{self.names}"

    # -- types

    def types_of(self, tables: list) -> dict[str, T.DataType]:
        names = sorted({p for t in tables for p in t.props})
        return {n: unified([t.props[n] for t in tables if n in t.props]) for n in names} | {SELF: SELF_TYPE}

    def path_type(self) -> T.StructType:
        types = self.types_of([*self.graph.nodes, *self.graph.edges])
        extra = [T.StructField(a, types[a]) for a in sorted(self.path_attrs) if a in types]
        return T.StructType([T.StructField("__kind", T.StringType()), T.StructField("__id", T.LongType()), *extra])

    # -- entry

    def plan(self, p: Pattern, want_path: bool = False, seeds: Rel | None = None) -> Rel:
        """``want_path``: first, last and path columns are asked for. ``seeds`` has rows that are joined
        to the result later; path searches start from its nodes only."""
        if isinstance(p, Join):
            flat = [x for x in p.operands if is_flat(x)]
            rest = [x for x in p.operands if not is_flat(x)]
            out = self.flat(flat) if flat else None
            for x in rest:
                known = out if seeds is None else seeds if out is None else natural_join(seeds, out) if set(seeds.vars) & set(out.vars) else out
                r = self.plan(x, seeds=known)
                out = r if out is None else natural_join(out, r)
            return plain(out)
        if is_flat(p):
            return self.flat([p], want_path=want_path)
        if isinstance(p, Named):
            r = self.plan(p.inner, want_path=True, seeds=seeds)
            df = r.df.withColumn(p.var, col(r.path))
            return Rel(df, {**r.vars, p.var: VarInfo("path", type=self.path_type())}, r.first, r.last, r.path)
        if isinstance(p, Selected):
            return self.selected(p, seeds)
        if isinstance(p, FilterP):
            r = self.plan(p.inner, want_path, seeds)
            return self.filtered(r, p.where)
        if isinstance(p, UnionP):
            return union([self.plan(a, True, seeds) for a in p.arms], self)
        if isinstance(p, Maybe):
            nodes = self.flat([NodeP(self.fresh("n"))], want_path=True)
            return union([Rel(nodes.df, {}, nodes.first, nodes.last, nodes.path), self.plan(p.inner, True, seeds)], self)
        return self.chain(p.items if isinstance(p, Concat) else [p], seeds, Prefix())

    @contextmanager
    def knowing(self, names: Iterable[str]):
        """While a pattern is planned that is joined to rows with these variables and their properties."""
        before, self.bound = self.bound, self.bound | frozenset(names)
        try:
            yield
        finally:
            self.bound = before

    def filtered(self, r: Rel, where: Expr) -> Rel:
        from .query import attach_subqueries  # subqueries hold whole queries

        r, subqueries = attach_subqueries(self, r, where)
        return Rel(r.df.filter(Compiler(r.vars, subqueries).condition(where)), r.vars, r.first, r.last, r.path)

    # -- nodes and edges

    def _elements(self, operands: list[Pattern], want_path: bool) -> tuple[dict[str, _Node], list[_Edge], list[Expr], list[str]]:
        """Nodes and edges with the tables they can be in, conditions, and the elements of the last operand in order."""
        nodes: dict[str, _Node] = {}
        edges: list[_Edge] = []
        wheres: list[Expr] = []
        same: list[tuple[str, str]] = []
        order: list[str] = []

        def node(p: NodeP | None) -> str:
            p = p or NodeP()
            var = p.var or self.fresh("n")
            n = nodes.setdefault(var, _Node(var))
            if p.label is not None:
                n.labels.append(p.label)
            self.element_conditions(p, var, wheres)
            return var

        for operand in operands:
            items, conditions = flat_items(operand)
            wheres += conditions
            before: str | None = None
            waiting: EdgeP | None = None
            elements: list[str] = []
            for x in items:
                if isinstance(x, EdgeP):
                    if before is None:
                        before = node(None)
                        elements.append(before)
                    if waiting is not None:
                        before = self._edge(waiting, before, node(None), edges, wheres, same, elements)
                    waiting = x
                else:
                    v = node(x)
                    if waiting is not None:
                        before, waiting = self._edge(waiting, before, v, edges, wheres, same, elements), None
                    elif before is not None:
                        wheres.append(Bin("=", Var(before), Var(v)))
                        before = v
                    else:
                        before = v
                        elements.append(v)
            if waiting is not None:
                before = self._edge(waiting, before, node(None), edges, wheres, same, elements)
            order = elements
        for a, b in same:
            wheres.append(Bin("=", Var(a), Var(b)))
        if want_path:
            for v in [x for x in order if x in nodes]:
                self.needs.setdefault(v, set()).update(self.path_attrs)
            for e in edges:
                self.needs.setdefault(e.var, set()).update(self.path_attrs)
        self._narrow(nodes, edges)
        return nodes, edges, wheres, order

    def flat(self, operands: list[Pattern], want_path: bool = False) -> Rel:
        nodes, edges, wheres, order = self._elements(operands, want_path)
        read = {x.base.name for x in walk(wheres) if isinstance(x, Attr) and isinstance(x.base, Var)}
        rel = self._join(nodes, edges, wheres, frozenset() if want_path else self.bound - read)
        conditions = [Compiler(rel.vars).condition(w) for w in wheres if not has_subquery(w)]
        if conditions:
            rel.df = rel.df.filter(reduce(lambda a, b: a & b, conditions))
        if want_path:
            rel = self._with_path(rel, order, nodes)
        for w in wheres:
            if has_subquery(w):
                rel = self.filtered(rel, w)
        return rel

    def hops(self, p: Pattern, back: bool) -> list[Hop] | None:
        """A chain edge by edge, for a search that goes on from its start (``back``: from its end)
        and needs no more of it than what it reaches. A hop has the properties and conditions of its edge and of
        the node that it leads to, the first one also those of the node before. None where a condition is on
        several elements, or the pattern is no such chain."""
        if not is_flat(p):
            return None
        nodes, edges, wheres, order = self._elements([p], True)
        if len(set(order)) < len(order) or any(has_subquery(w) or len(free_vars(w)) > 1 for w in wheres):
            return None
        out: list[Hop] = []
        warned = len(self.warnings)  # the whole chain was planned before and has warned
        for e in reversed(edges) if back else edges:
            near, far = (e.right, e.left) if back else (e.left, e.right)
            own = {e.var, far} if out else {e.var, far, near}
            tests = [w for w in wheres if free_vars(w) <= own and (free_vars(w) or not out)]
            rel = self._join({x: nodes[x] for x in (e.left, e.right)}, [e], tests, frozenset({near} - own))
            for w in tests:
                rel.df = rel.df.filter(Compiler(rel.vars).condition(w))
            rel.vars = {v: x for v, x in rel.vars.items() if v in own}
            inline = e.tables[0].inline if len(e.tables) == 1 and e.dir in ("->", "<-") else None
            at_right = inline is not None and (inline[0] == "dst") == (e.dir == "->")
            out.append(Hop(rel, near, e.var, far, inline is not None and at_right != back))
        del self.warnings[warned:]
        return out

    def element_conditions(self, p: NodeP | EdgeP, var: str, wheres: list[Expr]) -> None:
        for key, e in p.values:
            self.needs.setdefault(var, set()).add(key)
            wheres.append(Bin("=", Attr(Var(var), key), e))
        for key, t in p.types:
            self.needs.setdefault(var, set()).add(key)
            wheres.append(IsType(Attr(Var(var), key), t))
        if p.where is not None:
            wheres.append(p.where)

    def _edge(self, p: EdgeP, left: str, right: str, edges: list[_Edge], wheres: list, same: list, elements: list[str]) -> str:
        var = p.var or self.fresh("e")
        if any(e.var == var for e in edges):
            again = self.fresh("e")
            same.append((var, again))
            var = again
        self.element_conditions(p, var, wheres)
        edges.append(_Edge(var, p.dir, p.label, left, right))
        elements += [var, right]
        return right

    def _narrow(self, nodes: dict[str, _Node], edges: list[_Edge]) -> None:
        """The tables that each variable can be in, given labels and the ends of edge tables."""
        for n in nodes.values():
            n.tables = [t for t in self.graph.nodes if all(label_holds(x, t.labels) for x in n.labels)]
        for e in edges:
            e.tables = [t for t in self.graph.edges if label_holds(e.label, t.labels) and (e.dir == "-" or t.directed == (e.dir != "~"))]
        every = frozenset(t.name for t in self.graph.nodes)
        changed = True
        while changed:
            changed = False
            for e in edges:
                left, right = ({t.name for t in nodes[x].tables} for x in (e.left, e.right))
                fits, at_left, at_right = [], set(), set()
                for t in e.tables:
                    ways = [(t.src or every, t.dst or every)] if e.dir == "->" else [(t.dst or every, t.src or every)] if e.dir == "<-" else [(t.src or every, t.dst or every), (t.dst or every, t.src or every)]
                    ways = [(a, b) for a, b in ways if a & left and b & right]
                    if ways:
                        fits.append(t)
                        for a, b in ways:
                            at_left |= a
                            at_right |= b
                for x, at in ((e.left, at_left), (e.right, at_right)):
                    kept = [t for t in nodes[x].tables if t.name in at]
                    changed |= len(kept) != len(nodes[x].tables)
                    nodes[x].tables = kept
                changed |= len(fits) != len(e.tables)
                e.tables = fits

    def _join(self, nodes: dict[str, _Node], edges: list[_Edge], wheres: list[Expr], bare: frozenset[str]) -> Rel:
        """``bare`` variables come without properties."""
        variables: dict[str, VarInfo] = {}

        def info(kind: str, var: str, tables: list) -> VarInfo:
            types = self.types_of(tables)
            got = [(a, types[a]) for a in sorted(self.needs.get(var, ())) if a in types and var not in bare]
            return VarInfo(kind, attrs=tuple(got), known=tuple(types.items()))

        for n in nodes.values():
            variables[n.var] = info("node", n.var, n.tables)
        for e in edges:
            variables[e.var] = info("edge", e.var, e.tables)
        if any(not x.tables for x in [*nodes.values(), *edges]):
            self.warnings.append("the pattern can't match: no table has its labels")
            return Rel(self.empty(variables), variables)

        pieces: list[tuple[str, set[str], DataFrame]] = []  # (what, variables it has, rows)
        given: set[str] = set()  # nodes whose properties and tables come along with an edge
        for e in edges:
            inline = None
            if len(e.tables) == 1 and e.tables[0].inline and e.dir in ("->", "<-"):
                end, table = e.tables[0].inline
                var = e.right if (end == "dst") == (e.dir == "->") else e.left
                if var not in given and e.left != e.right and [t.name for t in nodes[var].tables] == [table]:
                    inline = var
                    given.add(var)
            pieces.append(("edge", {e.left, e.right}, self._edge_rows(e, variables, inline)))
        covered = {}
        for e in edges:
            for var, ends in ((e.left, self._ends(e, "left")), (e.right, self._ends(e, "right"))):
                covered[var] = ends if var not in covered else covered[var] & ends if ends is not None and covered[var] is not None else ends if covered[var] is None else covered[var]
        fixed = {w.left.base.name for w in wheres if isinstance(w, Bin) and w.op == "=" and isinstance(w.left, Attr) and isinstance(w.left.base, Var) and isinstance(w.right, Lit)}
        for n in nodes.values():
            if n.var in given:
                continue
            implied = n.var in covered and covered[n.var] is not None and covered[n.var] <= {t.name for t in n.tables}
            if not variables[n.var].attrs and implied:
                continue
            pieces.append(("node", {n.var}, self._node_rows(n, variables)))
        # start where a value is fixed, then take nodes before edges
        first = next((k for k, x in enumerate(pieces) if x[1] & fixed), 0)
        _, bound, df = pieces.pop(first)
        bound = set(bound)
        while pieces:
            near = [k for k, x in enumerate(pieces) if x[1] & bound]
            k = min(near, key=lambda k: (not pieces[k][1] <= bound, not pieces[k][1] & fixed, k)) if near else 0
            _, more, rows = pieces.pop(k)
            on = sorted(more & bound)
            df = df.join(rows, on) if on else df.crossJoin(rows)
            bound |= more
        return Rel(df, variables)

    def _ends(self, e: _Edge, side: str) -> frozenset[str] | None:
        """The node tables that the edge's rows have at this end; None if unknown."""
        out: frozenset[str] = frozenset()
        for t in e.tables:
            at = (t.src, t.dst) if e.dir == "->" else (t.dst, t.src)
            if e.dir in ("->", "<-"):
                got = at[0] if side == "left" else at[1]
            else:
                got = None if t.src is None or t.dst is None else t.src | t.dst
            if got is None:
                return None
            out |= got
        return out

    def _node_rows(self, n: _Node, variables: dict[str, VarInfo]) -> DataFrame:
        def one(t: NodeTable) -> DataFrame:
            attrs = [attribute(t, a, x).alias(f"{n.var}${a}") for a, x in variables[n.var].attrs]
            return t.df.select(F.col(ID).alias(n.var), *attrs)

        return reduce(DataFrame.unionByName, [one(t) for t in n.tables])

    def _edge_rows(self, e: _Edge, variables: dict[str, VarInfo], inline: str | None) -> DataFrame:
        def one(t: EdgeTable, src: str, dst: str) -> DataFrame:
            source = t.wide if inline else t.df
            attrs = [attribute(t, a, x).alias(f"{e.var}${a}") for a, x in variables[e.var].attrs]
            if inline:
                holder = self.graph.node_table(t.inline[1])
                have = {f.name: f.dataType for f in source.schema}
                itself = lambda: whole("node", F.col(DST if t.inline[0] == "dst" else SRC), holder.labels, holder.props)
                attrs += [(itself() if a == SELF else as_type(col(a), have[a], x)).alias(f"{inline}${a}") for a, x in variables[inline].attrs]
            rows = source
            if src == dst:
                rows = rows.filter(F.col(SRC) == F.col(DST))
            ends = {src: F.col(SRC), dst: F.col(DST)}
            return rows.select(F.col(EID).alias(e.var), *[c.alias(k) for k, c in ends.items()], *attrs)

        parts = []
        for t in e.tables:
            if e.dir == "->" or (e.dir == "-" and t.directed):
                parts.append(one(t, e.left, e.right))
            if e.dir == "<-" or (e.dir == "-" and t.directed):
                parts.append(one(t, e.right, e.left))
            if e.dir == "~" or (e.dir == "-" and not t.directed):
                parts += [one(t, e.left, e.right), one(t, e.right, e.left)]
        return reduce(DataFrame.unionByName, parts)

    def empty(self, variables: dict[str, VarInfo]) -> DataFrame:
        fields = []
        for v, x in variables.items():
            fields.append(T.StructField(v, T.LongType()))
            fields += [T.StructField(f"{v}${a}", t) for a, t in x.attrs]
        return self.spark.createDataFrame([], T.StructType(fields))

    def path_element(self, kind: str, v: str, info: VarInfo, before: str = "") -> Column:
        """A variable, whose columns have names that begin with ``before``, as an element of a path."""
        have = dict(info.attrs)
        extra = [(as_type(col(f"{before}{v}${f.name}"), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in self.path_type().fields[2:]]
        return F.struct(F.lit(kind).alias("__kind"), col(f"{before}{v}").alias("__id"), *extra)

    def _with_path(self, rel: Rel, order: list[str], nodes: dict[str, _Node]) -> Rel:
        first, last, path = self.fresh("f"), self.fresh("l"), self.fresh("p")
        elements = [self.path_element("n" if v in nodes else "e", v, rel.vars[v]) for v in order]
        df = rel.df.withColumns({first: col(order[0]), last: col(order[-1]), path: F.array(*elements)})
        return Rel(df, rel.vars, first, last, path)

    # -- chains with quantifiers, unions and the like

    def chain(self, items: list[Pattern], seeds: Rel | None, prefix: Prefix) -> Rel:
        """Juxtaposed items; each part goes on where the one before it ends."""
        from ..operators.paths import repeated

        parts: list[Pattern | list[Pattern]] = []
        for x in items:
            if isinstance(x, (NodeP, EdgeP)):
                if parts and isinstance(parts[-1], list):
                    parts[-1].append(x)
                else:
                    parts.append([x])
            else:
                parts.append(x)
        out: Rel | None = None
        fixed = False  # does a condition or an earlier clause narrow the rows so far?
        ready: dict[int, Rel] = {}

        def piece(k: int) -> Rel:
            if k not in ready:
                x = parts[k]
                ready[k] = self.flat([Concat(x)], want_path=True) if isinstance(x, list) else self.plan(x, True, seeds if out is None else None)
            return ready[k]

        for k, x in enumerate(parts):
            if isinstance(x, Repeat):
                if out is None:
                    out = self.flat([NodeP(self.fresh("n"))], want_path=True)
                ends = None
                if k + 1 < len(parts) and isinstance(parts[k + 1], list) and narrows(parts[k + 1]):
                    after = piece(k + 1)
                    ends = after.df.select(col(after.first).alias("__end"))
                out = repeated(self, out, x, prefix, ends, fixed)
                continue
            r = piece(k)
            fixed |= narrows(x) if isinstance(x, list) else True
            if out is None:
                fixed |= seeds is not None and bool(set(r.vars) & set(seeds.vars))
                out = seeded(r, seeds)
            else:
                out = joined_paths(out, r, self)
        return out

    def selected(self, p: Selected, seeds: Rel | None) -> Rel:
        from ..operators.paths import keep_mode, keep_search

        inner = p.inner
        conditions: list[Expr] = []
        while isinstance(inner, FilterP):
            conditions.append(inner.where)
            inner = inner.inner
        r = self.chain(inner.items if isinstance(inner, Concat) else [inner], seeds, p.prefix) if not is_flat(inner) and isinstance(inner, (Concat, Repeat)) else self.plan(inner, True, seeds)
        for w in conditions:
            r = self.filtered(r, w)
        return keep_search(keep_mode(r, p.prefix.mode), p.prefix)


def narrows(items: list[Pattern]) -> bool:
    """Whether nodes or edges have conditions on values."""
    return any(isinstance(x, (NodeP, EdgeP)) and (x.values or x.where is not None) for x in items)


def with_end_conditions(p: Pattern, tests: list[Expr]) -> Pattern:
    """The pattern with conditions on one end of a searched or repeated path put at that node. They only
    tell pairs of ends apart, for which paths are selected each by itself; conditions on what lies
    between stay outside."""
    if isinstance(p, Join):
        return replace(p, operands=[with_end_conditions(x, tests) for x in p.operands])
    if isinstance(p, (Named, Selected, FilterP)):
        return replace(p, inner=with_end_conditions(p.inner, tests))
    if not isinstance(p, Concat) or is_flat(p):
        return p
    items = list(p.items)
    for at in {0, len(items) - 1}:
        node = items[at]
        if isinstance(node, NodeP) and node.var:
            for e in tests:
                if free_vars(e) == {node.var} and not has_subquery(e):
                    node = replace(node, where=e if node.where is None else Bin("AND", node.where, e))
            items[at] = node
    return replace(p, items=items)


def is_flat(p: Pattern) -> bool:
    if isinstance(p, (NodeP, EdgeP)):
        return True
    if isinstance(p, Concat):
        return all(is_flat(x) for x in p.items)
    return isinstance(p, FilterP) and is_flat(p.inner)


def flat_items(p: Pattern) -> tuple[list[Pattern], list[Expr]]:
    if isinstance(p, (NodeP, EdgeP)):
        return [p], []
    if isinstance(p, FilterP):
        items, wheres = flat_items(p.inner)
        return items, [*wheres, p.where]
    items, wheres = [], []
    for x in p.items:
        a, b = flat_items(x)
        # two edges in a row, or a filtered part next to another, meet in an unnamed node
        items += a
        wheres += b
    return items, wheres


def has_subquery(e: object) -> bool:
    from ..lang.tree import Exists, Value

    return any(isinstance(x, (Exists, Value)) or isinstance(x, Call) and x.name == "VECTOR" for x in walk(e))


def plain(r: Rel) -> Rel:
    return Rel(r.df, r.vars)


def natural_join(a: Rel, b: Rel, how: str = "inner") -> Rel:
    """Rows that agree on all shared variables; nulls agree with nothing."""
    shared = sorted(set(a.vars) & set(b.vars))
    drop = [c for v in shared for c in b.columns_of(v)[1:] if c in a.df.columns]
    right = b.df.drop(*drop)
    kept = {**b.vars, **a.vars}
    for v in shared:  # properties that only the right side has come along
        more = tuple(x for x in b.vars[v].attrs if x not in a.vars[v].attrs)
        kept[v] = VarInfo(a.vars[v].kind, a.vars[v].of, a.vars[v].attrs + more, a.vars[v].known, a.vars[v].type)
    df = a.df.join(right, shared, how) if shared else a.df.crossJoin(right)
    return Rel(df, kept, a.first or b.first, a.last or b.last, a.path or b.path)


def seeded(r: Rel, seeds: Rel | None) -> Rel:
    """The rows whose variables are bound alike in the seeds: a search starts from these only."""
    if seeds is None:
        return r
    shared = sorted(set(r.vars) & set(seeds.vars))
    if not shared:
        return r
    keys = seeds.df.select(*[col(v) for v in shared]).distinct()
    return Rel(r.df.join(keys, shared, "left_semi"), r.vars, r.first, r.last, r.path)


def joined_paths(a: Rel, b: Rel, planner: PatternPlanner) -> Rel:
    """Paths of ``a`` that go on as paths of ``b``."""
    shared = sorted(set(a.vars) & set(b.vars))
    key = planner.fresh("k")
    right = b.df.withColumnRenamed(b.first, key)
    drop = [c for v in shared for c in b.columns_of(v)[1:] if c in a.df.columns]
    left = a.df.withColumn(key, col(a.last))
    df = left.join(right.drop(*drop), [key, *shared])
    path = planner.fresh("p")
    df = df.withColumn(path, F.concat(col(a.path), F.slice(col(b.path), 2, F.greatest(F.size(col(b.path)) - 1, F.lit(0)))))
    df = df.drop(key, a.path, b.path, a.last)
    return Rel(df, {**b.vars, **a.vars}, a.first, b.last, path)


def union(rels: list[Rel], planner: PatternPlanner) -> Rel:
    """All rows of all arms, repeated rows included; variables that an arm lacks are null there."""
    first, last, path = planner.fresh("f"), planner.fresh("l"), planner.fresh("p")
    variables: dict[str, VarInfo] = {}
    for r in rels:
        for v, x in r.vars.items():
            have = variables.get(v)
            if have is None:
                variables[v] = x
            else:
                types = {n: unified([t for y in (have, x) for m, t in y.attrs if m == n]) for n in sorted({n for y in (have, x) for n, _ in y.attrs})}
                if have.kind != x.kind:
                    raise GqlError(f"variable {v} is bound as {have.kind} and as {x.kind}")
                variables[v] = VarInfo(have.kind, have.of, tuple(types.items()), tuple(dict([*have.known, *x.known]).items()), have.type)
    parts = []
    for r in rels:
        cols = [col(r.first).alias(first), col(r.last).alias(last), col(r.path).alias(path)]
        for v, x in variables.items():
            if v in r.vars:
                cols.append(col(v))
            else:
                kind = "array<bigint>" if x.kind == "group" else "bigint" if x.kind in ("node", "edge") else T.ArrayType(x.type) if x.kind == "path" else x.type
                cols.append(F.lit(None).cast(kind).alias(v))
            have = dict(r.vars[v].attrs) if v in r.vars else {}
            for a, t in x.attrs:
                want = T.ArrayType(t) if x.kind == "group" else t
                c = col(f"{v}${a}") if a in have else F.lit(None).cast(want)
                cols.append((as_type(c, have[a], t) if a in have and x.kind != "group" else c).alias(f"{v}${a}"))
        parts.append(r.df.select(*cols))
    return Rel(reduce(DataFrame.unionByName, parts), variables, first, last, path)


__all__ = ["Hop", "PatternPlanner", "free_vars", "has_subquery", "is_flat", "joined_paths", "natural_join", "plain", "seeded", "union", "with_end_conditions"]
