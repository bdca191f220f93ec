"""INSERT, SET, REMOVE and DELETE: new versions of a graph's tables.

A statement's matches are computed and written before anything changes, so a statement never sees its
own effects. Each gives a new graph; the old one stays what it was.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import CODE_BITS, DST, EID, ID, SRC, EdgeTable, NodeTable, PropertyGraph, as_type, unified
from .lang.lexer import GqlError
from .lang.tree import Attr, Change, Concat, EdgeP, Item, Lit, NodeP, Query, Rec, Var, label_names
from .plans.pattern import PatternPlanner, attribute
from .plans.query import attach_subqueries, project, run_matches, showing_elements
from .plans.scope import Compiler, Rel, VarInfo, col, spark_type
from .storage import written


def apply_change(g: PropertyGraph, c: Change) -> tuple[PropertyGraph, DataFrame | None]:
    """The graph after the statement, and the rows of its RETURN."""
    g = g.copy()
    if c.returns is not None:
        c = showing_elements(c, [c.matches, c.patterns])
    planner = PatternPlanner(g, c)
    if c.matches:
        r = run_matches(planner, c.matches)
        keep = [x for v in r.vars for x in r.columns_of(v)]
        df = r.df.select(*[col(x) for x in keep]) if keep else r.df.select(F.lit(1).alias("__one"))
        r = Rel(written(df, "bindings"), r.vars)
    else:
        r = Rel(g.spark.range(1).select(F.lit(1).alias("__one")), {})
    if c.kind == "INSERT":
        r = _insert(g, planner, r, c)
    elif c.kind in ("SET", "REMOVE"):
        for item in c.items:
            _update(g, planner, r, c.kind, item)
    else:
        _delete(g, r, c)
    if c.returns is None:
        return g, None
    return g, _returned(g, r, c)


# ---- INSERT


def _insert(g: PropertyGraph, planner: PatternPlanner, r: Rel, c: Change) -> Rel:
    created: dict[str, tuple[str, NodeP | EdgeP, str, str]] = {}  # var -> kind, pattern, ends
    code = g.next_code()
    for p in c.patterns:
        items = p.items if isinstance(p, Concat) else [p]
        names: list[str] = []
        for x in items:
            if isinstance(x, NodeP):
                var = x.var or planner.fresh("n")
                known = var in r.vars or var in created
                if known and (x.label is not None or x.values):
                    raise GqlError(f"{var} is bound already: an INSERT can't give it labels or properties")
                if not known:
                    created[var] = ("node", x, "", "")
                elif var in r.vars and r.vars[var].kind != "node":
                    raise GqlError(f"{var} is no node")
                names.append(var)
        k = 0
        for x in items:
            if isinstance(x, EdgeP):
                var = x.var or planner.fresh("e")
                if var in r.vars or var in created:
                    raise GqlError(f"{var} is bound already")
                a, b = names[k - 1], names[k]
                created[var] = ("edge", x, *((b, a) if x.dir == "<-" else (a, b)))
            else:
                k += 1
    r, found = attach_subqueries(planner, r, [e for _, x, _, _ in created.values() for _, e in x.values])
    compile_ = Compiler(r.vars, found)
    cols, props = [], {}
    for i, (var, (_, x, _, _)) in enumerate(created.items()):
        cols.append((F.lit((code << CODE_BITS) + i) + F.monotonically_increasing_id() * len(created)).alias(var))
        props[var] = {}
        for key, e in x.values:
            v = compile_(e)
            value = v.col if v.fail is None else F.when(~v.fail, v.col)
            t = spark_type(v)
            if v.kind in ("node", "edge", "path"):
                raise GqlError("nodes, edges and paths are no property values")
            if not isinstance(t, T.NullType):
                cols.append(value.cast(t).alias(f"__new {var} {key}"))
                props[var][key] = t
    df = written(r.df.select(*[col(x) for x in r.df.columns], *cols), "inserted")
    tables: dict[str, str] = {}
    for var, (kind, x, a, b) in created.items():
        labels = frozenset(label_names(x.label))
        values = [col(f"__new {var} {key}").alias(key) for key in props[var]]
        if kind == "node":
            rows = df.select(col(var).alias(ID), *values)
            tables[var] = _add_nodes(g, labels, rows)
        else:
            rows = df.select(col(var).alias(EID), col(a).alias(SRC), col(b).alias(DST), *values)
            if (a in r.vars or b in r.vars) and c.matches:
                rows = rows.filter(F.col(SRC).isNotNull() & F.col(DST).isNotNull())
            _add_edges(g, labels, rows, x.dir != "~", tables.get(a), tables.get(b))
    info = {var: VarInfo(kind) for var, (kind, _, _, _) in created.items()}
    return Rel(df, {**r.vars, **info})


def _appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows; a property whose types differ becomes a mixed one."""
    have, more = ({f.name: f.dataType for f in x.schema} for x in (old, new))
    names = [*have, *[n for n in more if n not in have]]

    def typed(df: DataFrame, own: dict) -> DataFrame:
        cols = []
        for n in names:
            t = unified([x[n] for x in (have, more) if n in x])
            cols.append((as_type(col(n), own[n], t) if n in own else F.lit(None).cast(t)).alias(n))
        return df.select(*cols)

    return typed(old, have).unionByName(typed(new, more))


def _add_nodes(g: PropertyGraph, labels: frozenset[str], rows: DataFrame) -> str:
    for k, t in enumerate(g.nodes):
        if t.labels == labels:
            g.nodes[k] = NodeTable(t.name, labels, _appended(t.df, rows))
            _forget_inline(g, t.name)
            return t.name
    name = "&".join(sorted(labels)) or "(none)"
    while any(t.name == name for t in g.nodes):
        name += "'"
    g.nodes.append(NodeTable(name, labels, rows))
    return name


def _add_edges(g: PropertyGraph, labels: frozenset[str], rows: DataFrame, directed: bool, src: str | None, dst: str | None) -> None:
    for k, t in enumerate(g.edges):
        if t.labels == labels and t.directed == directed and t.inline is None:
            both = lambda old, new: old | {new} if old is not None and new is not None else None
            g.edges[k] = EdgeTable(t.name, labels, _appended(t.df, rows), directed, both(t.src, src), both(t.dst, dst))
            return
    g.edges.append(EdgeTable("&".join(sorted(labels)) or "(none)", labels, rows, directed, frozenset((src,)) if src else None, frozenset((dst,)) if dst else None))


def _forget_inline(g: PropertyGraph, node_table: str) -> None:
    """Edges no longer answer for the properties of nodes that changed."""
    for k, e in enumerate(g.edges):
        if e.inline and e.inline[1] == node_table:
            g.edges[k] = EdgeTable(e.name, e.labels, e.df, e.directed, e.src, e.dst)


# ---- SET and REMOVE


def _update(g: PropertyGraph, planner: PatternPlanner, r: Rel, kind: str, item: tuple) -> None:
    var, attr, labels = item[0], item[1], item[2]
    info = r.vars.get(var)
    if info is None or info.kind not in ("node", "edge"):
        raise GqlError(f"{var} is no bound node or edge")
    key = ID if info.kind == "node" else EID
    tables = g.nodes if info.kind == "node" else g.edges
    ids = r.df.select(col(var).alias(key)).filter(F.col(key).isNotNull()).distinct()
    if labels is not None:
        _relabel(g, tables, key, ids, set(labels), kind == "SET")
        return
    if kind == "REMOVE":
        new: dict[str, tuple[T.DataType, object]] = {attr: (T.NullType(), None)}
        values = ids
    else:
        e = item[3]
        r, found = attach_subqueries(planner, r, e)
        compile_ = Compiler(r.vars, found)
        if attr is None:
            if not isinstance(e, Rec):
                raise GqlError("SET x = ... takes a record")
            compiled = {k: compile_(x) for k, x in e.fields.items()}
        else:
            compiled = {attr: compile_(e)}
        new, cols = {}, []
        for k, v in compiled.items():
            t = spark_type(v)
            new[k] = (t, None)
            if not isinstance(t, T.NullType):
                cols.append((v.col if v.fail is None else F.when(~v.fail, v.col)).cast(t).alias(f"__new {k}"))
        # one row for each element: of several values for one, any
        values = written(r.df.select(col(var).alias(key), *cols).filter(F.col(key).isNotNull()).dropDuplicates([key]), "updates")
    for k, t in enumerate(tables):
        replaced = set(t.props) if kind == "SET" and attr is None else set()
        touched = values.join(t.df.select(key), key, "left_semi")
        if touched.isEmpty():
            continue
        hit = F.col("__hit").isNotNull()
        j = t.df.join(touched.withColumn("__hit", F.lit(True)), key, "left")
        cols = [col(x) for x in t.df.columns if x.startswith("__")]
        for p in sorted(set(t.props) | set(new) | replaced):
            old_type = t.props.get(p)
            new_type = new[p][0] if p in new else T.NullType()
            want = unified([x for x in (old_type, new_type) if x is not None])
            if isinstance(want, T.NullType):
                continue
            old = as_type(col(p), old_type, want) if old_type is not None else F.lit(None).cast(want)
            if p in new or p in replaced:
                value = F.lit(None).cast(want) if isinstance(new_type, T.NullType) else as_type(col(f"__new {p}"), new_type, want)
                cols.append(F.when(hit, value).otherwise(old).alias(p))
            else:
                cols.append(old.alias(p))
        df = j.select(*cols)
        if key == ID:
            g.nodes[k] = NodeTable(t.name, t.labels, df)
            _forget_inline(g, t.name)
        else:
            g.edges[k] = EdgeTable(t.name, t.labels, df, t.directed, t.src, t.dst)


def _relabel(g: PropertyGraph, tables: list, key: str, ids: DataFrame, labels: set[str], add: bool) -> None:
    for t in list(tables):
        want = frozenset(t.labels | labels if add else t.labels - labels)
        if want == t.labels:
            continue
        moved = t.df.join(ids, key, "left_semi")
        if moved.isEmpty():
            continue
        stays = t.df.join(ids, key, "left_anti")
        k = next(i for i, x in enumerate(tables) if x is t)
        if key == ID:
            g.nodes[k] = NodeTable(t.name, t.labels, stays)
            _forget_inline(g, t.name)
            name = _add_nodes(g, want, moved)
            wider = lambda names: names | {name} if names is not None and t.name in names else names  # noqa: B023,E731
            g.edges[:] = [EdgeTable(e.name, e.labels, e.df, e.directed, wider(e.src), wider(e.dst), e.inline, e.wide) for e in g.edges]
        else:
            g.edges[k] = EdgeTable(t.name, t.labels, stays, t.directed, t.src, t.dst)
            g.edges.append(EdgeTable("&".join(sorted(want)), want, moved, t.directed, t.src, t.dst))


# ---- DELETE


def _delete(g: PropertyGraph, r: Rel, c: Change) -> None:
    nodes, edges = [], []
    for e in c.targets:
        v = Compiler(r.vars)(e)
        if v.kind not in ("node", "edge"):
            raise GqlError("DELETE takes nodes and edges")
        (nodes if v.kind == "node" else edges).append(r.df.select(v.col.alias("__x")).filter("__x is not null"))
    if edges:
        gone = written(reduce(DataFrame.unionByName, edges).distinct().withColumnRenamed("__x", EID), "deleted")
        g.edges[:] = [EdgeTable(t.name, t.labels, t.df.join(gone, EID, "left_anti"), t.directed, t.src, t.dst) for t in g.edges]
    if nodes:
        gone = written(reduce(DataFrame.unionByName, nodes).distinct(), "deleted")
        for k, t in enumerate(g.edges):
            at = [t.df.join(gone.withColumnRenamed("__x", end), end, "left_semi").select(EID) for end in (SRC, DST)]
            incident = at[0].unionByName(at[1]).distinct()
            if incident.isEmpty():
                continue
            if not c.detach:
                raise GqlError("G1001 a node that still has edges can't be deleted: use DETACH DELETE")
            g.edges[k] = EdgeTable(t.name, t.labels, t.df.join(incident, EID, "left_anti"), t.directed, t.src, t.dst)
        g.nodes[:] = [NodeTable(t.name, t.labels, t.df.join(gone.withColumnRenamed("__x", ID), ID, "left_anti")) for t in g.nodes]
        g.edges[:] = [EdgeTable(t.name, t.labels, t.df, t.directed, t.src, t.dst) for t in g.edges]


# ---- RETURN


def _returned(g: PropertyGraph, r: Rel, c: Change) -> DataFrame:
    """The items over the state after the statement: properties are read again."""
    planner = PatternPlanner(g, c)
    df = r.df.select(*[col(v) for v in r.vars]) if r.vars else r.df
    variables: dict[str, VarInfo] = {}
    for v, info in r.vars.items():
        if info.kind not in ("node", "edge"):
            variables[v] = info
            continue
        tables = g.nodes if info.kind == "node" else g.edges
        types = planner.types_of(tables)
        attrs = [(a, types[a]) for a in sorted(planner.needs.get(v, ())) if a in types]
        variables[v] = VarInfo(info.kind, attrs=tuple(attrs))
        if attrs:
            key = ID if info.kind == "node" else EID
            parts = [t.df.select(F.col(key).alias(v), *[attribute(t, a, x).alias(f"{v}${a}") for a, x in attrs]) for t in tables]
            df = df.join(reduce(DataFrame.unionByName, parts), v, "left")
    q = Query([], returns=c.returns, order_by=c.order_by, limit=c.limit)
    return project(planner, Rel(df, variables), q)


__all__ = ["Attr", "Item", "Lit", "Var", "apply_change"]
