"""Whole queries: match clauses, subqueries, grouping, sorting, limits."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.values import Val
from ..graph import ID, PropertyGraph
from ..lang.lexer import GqlError
from ..lang.tree import Agg, Attr, Bin, Call, Cast, EdgeP, Exists, Expr, Item, Lit, Match, Named, NodeP, Query, Repeat, SortKey, Value, Var, walk
from ..operators.nearest import nearest
from ..storage import written
from .pattern import SELF, PatternPlanner, free_vars, has_subquery, natural_join, plain, with_end_conditions
from .scope import Compiler, Rel, VarInfo, col, is_elementwise, spark_type


@dataclass
class Planned:
    df: DataFrame
    columns: list[str]
    warnings: list[str] = field(default_factory=list)


def conjuncts(e: Expr | None) -> list[Expr]:
    """The parts of a chain of ANDs (of one level with OR, from the left)."""
    if e is None:
        return []
    if isinstance(e, Bin) and e.op == "AND":
        return [*conjuncts(e.left), *conjuncts(e.right)]
    return [e]


# ---- match clauses


def run_matches(planner: PatternPlanner, matches: list[Match]) -> Rel:
    out: Rel | None = None
    k = 0
    while k < len(matches):
        m = matches[k]
        if out is None or not m.optional:
            # clauses that follow one another without OPTIONAL and search are one join
            out = matched(planner, out, m)
        else:
            out = optional(planner, out, m)
        k += 1
    return out


def matched(planner: PatternPlanner, left: Rel | None, m: Match) -> Rel:
    tests = conjuncts(m.where)
    with planner.knowing(_complete(planner, left)):
        r = plain(planner.plan(with_end_conditions(m.pattern, tests), seeds=left))
    if left is not None:
        r = natural_join(left, r)
    for e in tests:
        r = plain(filtered(planner, r, e))
    return r


def _complete(planner: PatternPlanner, left: Rel | None) -> set[str]:
    """The nodes and edges that ``left`` has with every property that is read and that they can have."""
    if left is None:
        return set()
    return {v for v, x in left.vars.items() if x.kind in ("node", "edge") and {a for a, _ in x.attrs} >= planner.needs.get(v, set()) & {a for a, _ in x.known}}


def filtered(planner: PatternPlanner, r: Rel, e: Expr) -> Rel:
    """One conjunct; EXISTS as a semi join, NOT EXISTS as an anti join."""
    if isinstance(e, Exists):
        return exists_join(planner, r, e)
    return planner.filtered(r, e)


def optional(planner: PatternPlanner, left: Rel, m: Match) -> Rel:
    """A left join; the clause's condition is part of the join and may read what is bound before."""
    own = {x.var for x in walk(m.pattern) if getattr(x, "var", None)}
    inner, outer = [], []
    for e in conjuncts(m.where):
        (inner if free_vars(e) <= own else outer).append(e)
    read = {x.base.name for x in walk(inner) if isinstance(x, Attr) and isinstance(x.base, Var)}
    with planner.knowing(_complete(planner, left) - read):
        r = plain(planner.plan(with_end_conditions(m.pattern, inner), seeds=left))
    for e in inner:
        r = plain(filtered(planner, r, e))
    shared = sorted(set(left.vars) & set(r.vars))
    if any(has_subquery(e) for e in outer):
        return _optional_by_rows(planner, left, r, outer)
    drop = [c for v in shared for c in r.columns_of(v)[1:] if c in left.df.columns]
    right = r.df.drop(*drop)
    keys = {v: planner.fresh("k") for v in shared}
    for v, k in keys.items():
        right = right.withColumnRenamed(v, k)
    scope = {**r.vars, **left.vars}
    tests = [col(v) == col(k) for v, k in keys.items()] + [Compiler(scope).condition(e) for e in outer]
    on = reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
    df = left.df.join(right, on, "left").drop(*keys.values())
    more = {}
    for v in shared:
        gained = tuple(x for x in r.vars[v].attrs if x not in left.vars[v].attrs)
        more[v] = replace(left.vars[v], attrs=left.vars[v].attrs + gained)
    return Rel(df, {**r.vars, **left.vars, **more})


def _optional_by_rows(planner: PatternPlanner, left: Rel, r: Rel, outer: list[Expr]) -> Rel:
    """The left join where a condition's subquery reads what is bound before: the rows that match are
    found by an inner join, with a number for each row on the left, and joined back by it."""
    row = planner.fresh("row")
    numbered = replace(left, df=written(left.df.withColumn(row, F.monotonically_increasing_id()), "optional"))
    found = natural_join(numbered, r)
    for e in outer:
        found = plain(filtered(planner, found, e))
    gained = [c for c in found.df.columns if c not in left.df.columns and c != row]
    df = numbered.df.join(found.df.select(row, *[col(c) for c in gained]), row, "left").drop(row)
    return Rel(df, found.vars)


# ---- subqueries


def correlation(planner: PatternPlanner, outer: Rel, q: Query) -> tuple[Rel, list[str], list[str]]:
    """The subquery's rows joined to the distinct outer bindings that it depends on; the outer columns
    that tell them apart; and the variables among them."""
    bound = {x.var for m in q.matches for x in walk(m.pattern) if getattr(x, "var", None)}
    reads = free_vars(q)
    names = sorted((bound | reads) & set(outer.vars))
    # nodes and edges are told by their ids; their properties come along only if the subquery reads them
    read = {x.base.name for x in walk(q) if isinstance(x, Attr) and isinstance(x.base, Var)}
    infos = {v: outer.vars[v] if v in read or outer.vars[v].kind not in ("node", "edge") else replace(outer.vars[v], attrs=(), known=()) for v in names}
    keys = [c for v in names for c in ([v] if infos[v].kind in ("node", "edge") else outer.columns_of(v))]
    columns = [c for v in names for c in [v, *(f"{v}${a}" for a, _ in infos[v].attrs)]]
    given = Rel(outer.df.select(*[col(c) for c in columns]).distinct(), infos)
    out: Rel | None = given if names else None
    for k, m in enumerate(q.matches):
        out = matched(planner, out, m) if k == 0 or not m.optional else optional(planner, out, m)
    return out, keys, names


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on columns that may be null on both sides."""
    renamed = {k: f"__o {k}" for k in keys}
    right = b
    for k, n in renamed.items():
        right = right.withColumnRenamed(k, n)
    on = reduce(lambda x, y: x & y, [col(k).eqNullSafe(col(n)) for k, n in renamed.items()]) if keys else F.lit(True)
    out = a.join(right, on, how)
    return out.drop(*renamed.values()) if how == "left" else out


def _simple_keys(outer: Rel, q: Query, planner: PatternPlanner) -> tuple[Rel, list[str]] | None:
    """If the subquery only shares pattern variables, its own rows and these: no outer rows are needed."""
    bound = {x.var for m in q.matches for x in walk(m.pattern) if getattr(x, "var", None)}
    if (free_vars(q) & set(outer.vars)) - bound or any(m.optional for m in q.matches):
        return None
    names = sorted(bound & set(outer.vars))
    if not names or any(outer.vars[v].kind not in ("node", "edge") for v in names):
        return None
    read = {x.base.name for x in walk(q) if isinstance(x, Attr) and isinstance(x.base, Var)}
    out: Rel | None = None
    with planner.knowing(set(names) - read):
        for m in q.matches:
            out = matched(planner, out, m)
    return out, names


def exists_join(planner: PatternPlanner, r: Rel, e: Exists) -> Rel:
    how = "left_anti" if e.negated else "left_semi"
    simple = _simple_keys(r, e.query, planner)
    if simple:
        rows, names = simple
        return Rel(r.df.join(rows.df.select(*[col(v) for v in names]), names, how), r.vars, r.first, r.last, r.path)
    rows, keys, _ = correlation(planner, r, e.query)
    found = rows.df.select(*[col(k) for k in keys]).distinct() if keys else rows.df.select(F.lit(1).alias("__one")).limit(1)
    return Rel(_null_safe(r.df, found, keys, how), r.vars, r.first, r.last, r.path)


def attach_subqueries(planner: PatternPlanner, r: Rel, *parts: object) -> tuple[Rel, dict[int, Val]]:
    """The rows with a column for each EXISTS, VALUE and VECTOR in the parts."""
    found: dict[int, Val] = {}
    for x in _outermost(parts):
        name = planner.fresh("q")
        if isinstance(x, Exists):
            rows, keys, _ = correlation(planner, r, x.query)
            flags = rows.df.select(*[col(k) for k in keys]).distinct() if keys else rows.df.select(F.lit(1).alias("__one")).limit(1).drop("__one")
            r = replace(r, df=_null_safe(r.df, flags.withColumn(name, F.lit(True)), keys, "left"))
            flag = F.coalesce(col(name), F.lit(False))
            found[id(x)] = Val(~flag if x.negated else flag, "bool")
        elif isinstance(x, Value):
            rows, keys, _ = correlation(planner, r, x.query)
            values, got = _value_of(planner, rows, keys, x.query, name)
            r = replace(r, df=_null_safe(r.df, values, keys, "left"))
            found[id(x)] = got
        else:
            node, attr = x.args
            if not isinstance(node, Var) or not isinstance(attr, Lit):
                raise GqlError("VECTOR takes a node variable and the name of an attribute")
            stored = planner.graph.vectors.get(attr.value)
            if stored is None:
                found[id(x)] = V.null()
                continue
            vectors = stored[0].select(F.col(ID).alias(node.name), F.col("vector").alias(name))
            r = replace(r, df=r.df.join(vectors, node.name, "left"))
            found[id(x)] = Val(col(name), "list", dict((f.name, f.dataType) for f in vectors.schema)[name])
    return r, found


def _outermost(parts: object) -> list:
    out = []

    def visit(x: object) -> None:
        for y in walk(x, into_subqueries=False):
            if isinstance(y, (Exists, Value)) or isinstance(y, Call) and y.name == "VECTOR":
                out.append(y)

    for p in parts:
        visit(p)
    return list({id(x): x for x in out}.values())


def _value_of(planner: PatternPlanner, rows: Rel, keys: list[str], q: Query, name: str) -> tuple[DataFrame, Val]:
    item = q.returns[0]
    rows, inner = attach_subqueries(planner, rows, item.expr, [k.expr for k in q.order_by], q.group_by)
    aggregated = _aggregates(item.expr, rows.vars)
    by = [col(k) for k in keys]
    if aggregated and not q.group_by:
        v = Compiler(rows.vars, inner, grouped=True)(item.expr)
        values = rows.df.groupBy(*by).agg(v.col.alias(name)) if by else rows.df.agg(v.col.alias(name))
        empty = _empty_value(item.expr)
        c = col(name) if empty is None else F.coalesce(col(name), empty)
        return values, replace(v, col=c, fail=None)
    if aggregated:
        raise GqlError("VALUE with GROUP BY is not supported")
    v = Compiler(rows.vars, inner)(item.expr)
    df = rows.df.withColumn(name, v.col)
    scope = dict(rows.vars)
    if item.alias:
        df = df.withColumn(f"__alias {item.alias}", v.col)
    order = [_sorted_by(_alias_value(k.expr, item, name, v, Compiler(scope, inner)), k) for k in q.order_by]
    from pyspark.sql import Window

    each = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    first = F.row_number().over(each.orderBy(*(order or [F.lit(1)])))
    if q.limit == 0:
        df = df.filter(F.lit(False))
    values = df.withColumn("__first", first).filter(F.col("__first") == 1).select(*by, col(name))
    return values, replace(v, col=col(name), fail=None)


def _alias_value(e: Expr, item: Item, name: str, v: Val, compiler: Compiler) -> Val:
    """A sort key that reads the item by its alias, a field of it or a cast of it."""
    if isinstance(e, Var) and e.name == item.alias:
        return replace(v, col=col(name))
    if isinstance(e, Attr):
        base = e.base
        while isinstance(base, Attr):
            base = base.base
        if isinstance(base, Var) and base.name == item.alias and base.name not in compiler.scope:
            inner = _alias_value(e.base, item, name, v, compiler)
            compiler.local["__item"] = inner
            return compiler(Attr(Var("__item"), e.name))
    if isinstance(e, Cast):
        return V.cast_to(_alias_value(e.arg, item, name, v, compiler), e.type)
    return compiler(e)


def _empty_value(e: Expr):
    """What an aggregate over no rows gives, where that isn't null."""
    if isinstance(e, Agg):
        return F.lit(0).cast("long") if e.kind == "COUNT" else F.array() if e.kind == "COLLECT_LIST" else None
    if isinstance(e, Bin) and e.op in ("+", "-", "*", "/"):
        a, b = (_empty_value(x) if not isinstance(x, Lit) else F.lit(x.value) for x in (e.left, e.right))
        if a is not None and b is not None:
            return a * b if e.op == "*" else a + b if e.op == "+" else a - b if e.op == "-" else a / b
    return None


def _aggregates(e: object, scope: dict[str, VarInfo]) -> bool:
    return any(isinstance(x, Agg) and not (x.arg is not None and is_elementwise(x, scope)) for x in walk(e, into_subqueries=False))


# ---- results


def _sorted_by(v: Val, k: SortKey):
    if v.kind == "mixed":
        v = replace(v, col=v.col)
    c = v.col if v.fail is None else F.when(~v.fail, v.col)
    if k.descending:
        return c.desc_nulls_first() if k.nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if k.nulls_first else c.asc_nulls_last()


def _same(a: Expr, b: Expr) -> bool:
    if type(a) is not type(b):
        return False
    if isinstance(a, Var):
        return a.name == b.name
    if isinstance(a, Attr):
        return a.name == b.name and _same(a.base, b.base)
    if isinstance(a, Lit):
        return a.value == b.value and type(a.value) is type(b.value)
    if isinstance(a, (Exists, Value)):
        return a is b
    for f in a.__dataclass_fields__:
        x, y = getattr(a, f), getattr(b, f)
        if isinstance(x, Expr) and isinstance(y, Expr):
            if not _same(x, y):
                return False
        elif isinstance(x, list) and isinstance(y, list):
            if len(x) != len(y) or not all(_same(p, q) if isinstance(p, Expr) else p == q for p, q in zip(x, y, strict=True)):
                return False
        elif x != y:
            return False
    return True


def _names(returns: list[Item]) -> list[str]:
    return [i.alias or (i.expr.name if isinstance(i.expr, Var) else f"col{k}") for k, i in enumerate(returns)]


def _output(v: Val):
    c = v.col if v.fail is None else F.when(~v.fail, v.col)
    return c.cast("string") if v.kind == "null" and v.type is None else c


def plan_query(graph: PropertyGraph, q: Query, limit: int | None = None) -> Planned:
    """The query as a lazy DataFrame, with warnings about what can't match or never holds."""
    q = showing_elements(q, q.matches)
    notes: list[str] = []
    token = V.NOTES.set(notes)
    try:
        planned = _planned(graph, q, limit)
    finally:
        V.NOTES.reset(token)
    planned.warnings += notes
    return planned


def element_variables(patterns: object) -> set[str]:
    """Variables of nodes and edges outside repetitions."""
    repeated = {x.var for r in walk(patterns) if isinstance(r, Repeat) for x in walk(r.inner) if isinstance(x, (NodeP, EdgeP))}
    return {x.var for x in walk(patterns, into_subqueries=False) if isinstance(x, (NodeP, EdgeP)) and x.var} - repeated


def showing_elements(q, patterns: object):
    """Returned nodes and edges as (kind, id, labels, properties as JSON); without RETURN, all that are named."""
    elements = element_variables(patterns)
    shown = lambda v: Attr(Var(v), SELF)
    if q.returns is None:
        others = {x.var for x in walk(patterns, into_subqueries=False) if isinstance(x, (NodeP, EdgeP, Named)) and x.var} - elements
        if isinstance(q, Query) and q.nearest is not None and q.nearest.alias:
            others.add(q.nearest.alias)
        if not elements | others:
            return q
        return replace(q, returns=[Item(shown(v) if v in elements else Var(v), v) for v in sorted(elements | others)])
    items = [Item(shown(i.expr.name), i.alias or i.expr.name) if isinstance(i.expr, Var) and i.expr.name in elements else i for i in q.returns]
    return replace(q, returns=items)


def _planned(graph: PropertyGraph, q: Query, limit: int | None) -> Planned:
    planner = PatternPlanner(graph, q)
    r = run_matches(planner, q.matches)
    if q.nearest is not None:
        r = nearest(planner, r, q.nearest)
    if limit is not None:
        q = replace(q, limit=limit if q.limit is None else min(q.limit, limit))
    if q.returns is None:
        out = raw_rows(planner, r)
        return Planned(out if q.limit is None else out.limit(q.limit), out.columns, planner.warnings)
    out = project(planner, r, q)
    return Planned(out, out.columns, planner.warnings)


def raw_rows(planner: PatternPlanner, r: Rel) -> DataFrame:
    """Without RETURN: every variable that was named, sorted."""
    names = sorted(v for v in r.vars if not v.startswith("__"))
    return r.df.select(*[col(v) for v in names])


def project(planner: PatternPlanner, r: Rel, q: Query) -> DataFrame:
    names = _names(q.returns)
    if len(set(names)) != len(names):
        raise GqlError("two returned items have the same name")
    grouping = q.group_by is not None or any(_aggregates(i.expr, r.vars) for i in q.returns)
    sort_exprs = [k.expr for k in q.order_by]
    keys = [_resolve_alias(e, q.returns, r) for e in q.group_by or []]
    r, found = attach_subqueries(planner, r, [i.expr for i in q.returns], sort_exprs, keys)
    aliases = dict(zip(names, q.returns, strict=True))
    if grouping:
        check_grouping(q, keys, r)
        return _grouped(r, q, names, keys, found, aliases)
    compile_ = Compiler(r.vars, found)
    values = {n: compile_(i.expr) for n, i in zip(names, q.returns, strict=True)}
    order = [_sorted_by(_sort_value(k.expr, values, compile_, r), k) for k in q.order_by]
    out = [_output(v).alias(n) for n, v in values.items()]
    if q.distinct:
        df = r.df.select(*out).distinct()
        if order:
            again = {n: replace(v, col=col(n), fail=None) for n, v in values.items()}
            by = []
            for k in q.order_by:
                at = next((n for n, i in aliases.items() if _same(i.expr, k.expr)), None)
                by.append(_sorted_by(again[at] if at else _sort_value(k.expr, again, Compiler({}, {}), r), k))
            df = df.orderBy(*by)
    elif order:
        # sorted before projection, so that a key need not be returned; with LIMIT a top-k
        hidden = [f"__s{k}" for k in range(len(order))]
        vals = [_sort_value(k.expr, values, compile_, r) for k in q.order_by]
        df = r.df.select(*out, *[(v.col if v.fail is None else F.when(~v.fail, v.col)).alias(h) for v, h in zip(vals, hidden, strict=True)])
        df = df.orderBy(*[_sorted_by(Val(col(h), v.kind), k) for h, v, k in zip(hidden, vals, q.order_by, strict=True)])
        df = df if q.limit is None else df.limit(q.limit)
        return df.drop(*hidden)
    else:
        df = r.df.select(*out)
    return df if q.limit is None else df.limit(q.limit)


def _sort_value(e: Expr, values: dict[str, Val], compile_: Compiler, r: Rel) -> Val:
    if isinstance(e, Var) and e.name in values and e.name not in r.vars:
        return values[e.name]
    if isinstance(e, Cast):
        return V.cast_to(_sort_value(e.arg, values, compile_, r), e.type)
    if isinstance(e, Attr):
        base = e.base
        while isinstance(base, Attr):
            base = base.base
        if isinstance(base, Var) and base.name in values and base.name not in r.vars:
            compile_.local["__item"] = _sort_value(e.base, values, compile_, r)
            return compile_(Attr(Var("__item"), e.name))
    return compile_(e)


def _resolve_alias(e: Expr, returns: list[Item], r: Rel) -> Expr:
    """A grouping key that names a returned item stands for its expression."""
    if isinstance(e, Var) and e.name not in r.vars:
        for i in returns:
            if i.alias == e.name:
                return i.expr
        raise GqlError(f"variable {e.name} is not bound")
    return e


def check_grouping(q: Query, keys: list[Expr], r: Rel) -> None:
    key_vars = {k.name for k in keys if isinstance(k, Var)}
    for i in q.returns:
        if _aggregates(i.expr, r.vars) or any(_same(i.expr, k) for k in keys):
            continue
        if isinstance(i.expr, Lit) or has_subquery(i.expr):
            continue
        if q.group_by is None:
            raise GqlError("RETURN mixes aggregate and non-aggregate items: name the latter in GROUP BY")
        if not free_vars(i.expr) <= key_vars and not _made_of_keys(i.expr, keys):
            raise GqlError("a returned item is neither a grouping key nor depends on grouped variables only")


def _made_of_keys(e: Expr, keys: list[Expr]) -> bool:
    if any(_same(e, k) for k in keys):
        return True
    key_vars = {k.name for k in keys if isinstance(k, Var)}
    if isinstance(e, (Var, Attr)):
        return free_vars(e) <= key_vars
    children = [x for f in e.__dataclass_fields__ for x in (getattr(e, f) if isinstance(getattr(e, f), list) else [getattr(e, f)]) if isinstance(x, Expr)]
    return bool(children) and all(isinstance(x, Lit) or _made_of_keys(x, keys) for x in children) or isinstance(e, Lit)


def _grouped(r: Rel, q: Query, names: list[str], keys: list[Expr], found: dict[int, Val], aliases: dict[str, Item]) -> DataFrame:
    plain_ = Compiler(r.vars, found)
    key_values = [plain_(k) for k in keys]
    by = [_output(v).alias(f"__g{k}") for k, v in enumerate(key_values)]
    grouped = Compiler(r.vars, found, grouped=True)
    values: dict[str, Val] = {}
    aggregates = []
    for n, i in zip(names, q.returns, strict=True):
        at = next((k for k, e in enumerate(keys) if _same(i.expr, e)), None)
        if at is not None:
            values[n] = replace(key_values[at], col=col(f"__g{at}"), fail=None)
        elif not _aggregates(i.expr, r.vars) and ((free_vars(i.expr) & set(r.vars)) <= {k.name for k in keys if isinstance(k, Var)} or _made_of_keys(i.expr, keys)):
            # what depends on grouped variables is a key as good as they are
            v = plain_(i.expr)
            by.append(_output(v).alias(f"__d {n}"))
            values[n] = replace(v, col=col(f"__d {n}"), fail=None)
        else:
            v = grouped(i.expr)
            aggregates.append(_output(v).alias(f"__a {n}"))
            values[n] = replace(v, col=col(f"__a {n}"), fail=None)
    order: list[tuple[Val, SortKey]] = []
    for j, k in enumerate(q.order_by):
        at = next((i for i, e in enumerate(keys) if _same(k.expr, e)), None)
        same = next((n for n, i in aliases.items() if _same(i.expr, k.expr)), None)
        if same is not None:
            order.append((values[same], k))
        elif at is not None:
            order.append((replace(key_values[at], col=col(f"__g{at}"), fail=None), k))
        elif _names_alias(k.expr, values, r):
            order.append((_sort_value(k.expr, values, Compiler({}, {}), r), k))
        else:
            v = grouped(k.expr)
            aggregates.append(_output(v).alias(f"__s{j}"))
            order.append((replace(v, col=col(f"__s{j}"), fail=None), k))
    rows = r.df.groupBy(*by) if by else r.df
    df = rows.agg(*aggregates) if aggregates else rows.agg(F.count(F.lit(1)).alias("__n"))
    if q.distinct:
        df = df.select(*[values[n].col.alias(n) for n in names]).distinct()
        order = [(replace(v, col=col(next(n for n in names if values[n] is v))), k) for v, k in order if any(values[n] is v for n in names)]
        df = df.orderBy(*[_sorted_by(v, k) for v, k in order]) if order else df
        return df if q.limit is None else df.limit(q.limit)
    if order:
        df = df.orderBy(*[_sorted_by(v, k) for v, k in order])
    if q.limit is not None:
        df = df.limit(q.limit)
    return df.select(*[values[n].col.alias(n) for n in names])


def _names_alias(e: Expr, values: dict[str, Val], r: Rel) -> bool:
    if isinstance(e, Cast):
        return _names_alias(e.arg, values, r)
    while isinstance(e, Attr):
        e = e.base
    return isinstance(e, Var) and e.name in values and e.name not in r.vars


__all__ = ["Planned", "conjuncts", "plan_query", "run_matches", "spark_type", "T"]
