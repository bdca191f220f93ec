"""Quantified paths, path modes and path searches.

A bounded quantifier is so many joins. An unbounded one is a loop on the driver that joins a frontier
with the repeated part, one job a step: under a mode it ends when pruning leaves no path, under a
search when every pair of ends has its quota. Paths that can't be in the result are never extended.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import ID
from ..lang.lexer import GqlError
from ..lang.tree import Concat, EdgeP, FilterP, Join, Maybe, Named, NodeP, Pattern, Prefix, Repeat, Selected, UnionP
from ..plans.pattern import Hop
from ..plans.scope import Rel, VarInfo, col
from ..storage import remove, written

MODES = ("TRAIL", "SIMPLE", "ACYCLIC")
#: Levels whose used quotas are summed when they are asked for; after so many, the sum is written.
SEEN_PARTS = 6
#: Reached nodes that are sent to all workers to pick their edges, instead of a shuffle of the edge table.
SENT_NODES = 1 << 20


def least_edges(p: Pattern) -> int:
    if isinstance(p, NodeP):
        return 0
    if isinstance(p, EdgeP):
        return 1
    if isinstance(p, (Concat, Join)):
        return sum(least_edges(x) for x in (p.items if isinstance(p, Concat) else p.operands))
    if isinstance(p, UnionP):
        return min(least_edges(x) for x in p.arms)
    if isinstance(p, Repeat):
        return p.low * least_edges(p.inner)
    if isinstance(p, Maybe):
        return 0
    return least_edges(p.inner)


def check_repeat(p: Repeat, prefix: Prefix) -> None:
    if p.high is None and prefix.mode not in MODES and prefix.search == "ALL":
        raise GqlError("unbounded repetition needs a path prefix: TRAIL, SIMPLE, ACYCLIC, ANY, SHORTEST, ANY SHORTEST or ALL SHORTEST")
    if (p.high is None or p.low >= 1) and least_edges(p.inner) == 0:
        raise GqlError("what is repeated must traverse an edge")


def _ids(path: Column, kind: str) -> Column:
    return F.transform(F.filter(path, lambda x: x["__kind"] == kind), lambda x: x["__id"])


def mode_holds(path: Column, mode: str) -> Column:
    if mode == "WALK":
        return F.lit(True)
    if mode == "TRAIL":
        ids = _ids(path, "e")
        return F.size(F.array_distinct(ids)) == F.size(ids)
    ids = _ids(path, "n")
    if mode == "ACYCLIC":
        return F.size(F.array_distinct(ids)) == F.size(ids)
    inner = F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(1)))
    closes = F.element_at(ids, -1) == F.element_at(ids, 1)
    return (F.size(F.array_distinct(ids)) == F.size(ids)) | (closes & (F.size(F.array_distinct(inner)) == F.size(inner)) & (F.size(ids) > 1))


def keep_mode(r: Rel, mode: str) -> Rel:
    return r if mode == "WALK" else Rel(r.df.filter(mode_holds(col(r.path), mode)), r.vars, r.first, r.last, r.path)


def keep_search(r: Rel, prefix: Prefix) -> Rel:
    """The quota of each pair of ends; ties go by the edges' ids."""
    if prefix.search == "ALL":
        return r
    length, edges = F.size(col(r.path)), _ids(col(r.path), "e")
    pair = Window.partitionBy(col(r.first), col(r.last))
    if prefix.search == "GROUPS":
        rank = F.dense_rank().over(pair.orderBy(length))
    else:
        rank = F.row_number().over(pair.orderBy(length, edges))
    df = r.df.withColumn("__rank", rank).filter(F.col("__rank") <= prefix.count).drop("__rank")
    return Rel(df, r.vars, r.first, r.last, r.path)


def _as_groups(planner, inner: Rel) -> tuple[DataFrame, dict[str, VarInfo]]:
    """The repeated part's rows, its variables turned into lists of one."""
    cols = [col(inner.first).alias("__from"), col(inner.last).alias("__to"), col(inner.path).alias("__step")]
    groups: dict[str, VarInfo] = {}
    for v, x in inner.vars.items():
        if v.startswith("__"):
            continue
        listed = x.kind == "group"
        groups[v] = VarInfo("group", x.of if listed else x.kind, x.attrs, x.known, x.type)
        for name in inner.columns_of(v):
            cols.append((col(name) if listed else F.array(col(name))).alias(name))
    return inner.df.select(*cols), groups


def repeated(planner, left: Rel, p: Repeat, prefix: Prefix, ends: DataFrame | None = None, fixed: bool = True) -> Rel:
    """Rows of ``left`` that go on with ``low`` to ``high`` laps of the repeated part. ``ends`` has the
    nodes (column ``__end``) at which rows that matter end, if they are known; ``fixed`` tells whether a
    condition narrows ``left``."""
    check_repeat(p, prefix)
    inner = planner.plan(p.inner, True)
    laps, groups = _as_groups(planner, inner)
    known = set(left.vars) & set(groups)
    if known:
        raise GqlError(f"variable {sorted(known)[0]} is bound outside and inside a repetition")
    if p.high is not None and p.low > p.high:
        return _no_rows(planner, left, groups)
    # with a search only the ends matter to the laps, whichever they are: search from each end once
    searching = prefix.search != "ALL" and prefix.mode == "WALK"
    if searching and (p.high is None or p.high > 1):
        back = ends is not None and not fixed
        hops = planner.hops(p.inner, back) if least_edges(p.inner) > 1 else None
        return _searched(planner, left, laps, groups, p, prefix, ends, back, hops)
    if p.high is None:
        return _pruned(planner, left, laps, groups, p, prefix.mode)
    return _bounded(planner, left, laps, groups, p, prefix.mode)


def _started(left: Rel, groups: dict[str, VarInfo], inner: DataFrame) -> DataFrame:
    """``left`` with empty lists for the group variables."""
    types = dict((f.name, f.dataType) for f in inner.schema)
    return left.df.withColumns({n: F.array().cast(types[n]) for v, x in groups.items() for n in [v, *(f"{v}${a}" for a, _ in x.attrs)]}) if groups else left.df


def _extended(df: DataFrame, last: str, path: str, laps: DataFrame, names: list[str], back: bool = False) -> DataFrame:
    """One lap more: behind the path, or before it on the way back from its end."""
    keep = [c for c in df.columns if c not in {last, path, *names}]
    step = laps.select(*[F.col(c).alias(c) if c.startswith("__") else col(c).alias(f"__lap {c}") for c in laps.columns])
    at, to = ("__to", "__from") if back else ("__from", "__to")
    j = df.join(step, col(last) == F.col(at))
    cols = [col(c) for c in keep]
    cols += [(F.concat(col(f"__lap {n}"), col(n)) if back else F.concat(col(n), col(f"__lap {n}"))).alias(n) for n in names]
    whole, step_ = col(path), F.col("__step")
    grown = F.concat(F.slice(step_, 1, F.size(step_) - 1), whole) if back else F.concat(whole, F.slice(step_, 2, F.size(step_) - 1))
    return j.select(*cols, F.col(to).alias(last), grown.alias(path))


def _along(planner, df: DataFrame, hop: Hop, back: bool, bare: bool) -> DataFrame:
    """The frontier one edge further; elements of paths (``bare``: ids) are made behind the join. Reached nodes pick
    their edges first, where they are few enough to be sent to all workers."""
    own = [n for v in hop.rel.vars if not v.startswith("__") for n in hop.rel.columns_of(v)]
    used = dict.fromkeys([hop.near, hop.edge, hop.far, *(n for v in hop.rel.vars for n in hop.rel.columns_of(v))])
    step = hop.rel.df.select(*[col(n).alias(f"__hop {n}") for n in used])
    near = f"__hop {hop.near}"
    nodes = df.select(F.col("__b").alias(near)).distinct()
    if df.count() <= SENT_NODES or nodes.count() <= SENT_NODES:
        step = step.join(F.broadcast(nodes), near, "left_semi")
    parts = [col(f"__hop {v}") if bare else planner.path_element(kind, v, hop.rel.vars[v], "__hop ") for kind, v in (("e", hop.edge), ("n", hop.far))]
    way = F.concat(F.array(*reversed(parts)), F.col("__way")) if back else F.concat(F.col("__way"), F.array(*parts))
    lists = {n: F.concat(F.array(col(f"__hop {n}")), col(n)) if back else F.concat(col(n), F.array(col(f"__hop {n}"))) for n in own}
    kept = [lists[c].alias(c) if c in lists else col(c) for c in df.columns if c not in ("__b", "__way")]
    return df.join(step, F.col("__b") == col(near)).select(*kept, col(f"__hop {hop.far}").alias("__b"), way.alias("__way"))


def _names(groups: dict[str, VarInfo]) -> list[str]:
    return [n for v, x in groups.items() for n in [v, *(f"{v}${a}" for a, _ in x.attrs)]]


def _no_rows(planner, left: Rel, groups: dict[str, VarInfo]) -> Rel:
    df = left.df.filter(F.lit(False))
    for v, x in groups.items():
        df = df.withColumn(v, F.array().cast("array<bigint>"))
        df = df.withColumns({f"{v}${a}": F.array().cast(T.ArrayType(t)) for a, t in x.attrs})
    return Rel(df, {**left.vars, **groups}, left.first, left.last, left.path)


def _bounded(planner, left: Rel, laps: DataFrame, groups: dict[str, VarInfo], p: Repeat, mode: str) -> Rel:
    names = _names(groups)
    now = _started(left, groups, laps)
    out = now if p.low == 0 else None
    for k in range(1, p.high + 1):
        now = _extended(now, left.last, left.path, laps, names)
        if mode != "WALK":
            now = now.filter(mode_holds(col(left.path), mode))
        if k >= p.low:
            out = now if out is None else out.unionByName(now)
    return Rel(out, {**left.vars, **groups}, left.first, left.last, left.path)


def _pruned(planner, left: Rel, laps: DataFrame, groups: dict[str, VarInfo], p: Repeat, mode: str) -> Rel:
    """All laps under a mode: a path that breaks it is dropped, one that closes a SIMPLE path ends."""
    names = _names(groups)
    laps = written(laps, "laps")
    now = written(_started(left, groups, laps), "frontier")
    levels = [now] if p.low == 0 else []
    k = 0
    while True:
        k += 1
        grown = now
        if mode == "SIMPLE":
            ids = _ids(col(left.path), "n")
            grown = grown.filter((F.size(ids) == 1) | (F.element_at(ids, 1) != F.element_at(ids, -1)))
        now = written(_extended(grown, left.last, left.path, laps, names).filter(mode_holds(col(left.path), mode)), "frontier")
        if now.isEmpty():
            break
        if k >= p.low:
            levels.append(now)
    if not levels:
        return _no_rows(planner, left, groups)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return Rel(out, {**left.vars, **groups}, left.first, left.last, left.path)


def _searched(planner, left: Rel, laps: DataFrame, groups: dict[str, VarInfo], p: Repeat, prefix: Prefix, ends: DataFrame | None, back: bool, hops: list[Hop] | None) -> Rel:
    """Laps step by step from each distinct start, or ``back`` from each end where only ends are fixed.

    A pair of start and reached node that has its quota is not extended: the quota is of paths (ANY,
    SHORTEST) or of different lengths (GROUPS), and since a part of a shortest path is one itself, what
    is dropped could not have led to a kept path. Steps below the lower bound keep a quota of their own
    each. With known ends, a start whose pairs with all of them have their quota is done. Ties go by
    the edges' ids in the path's own direction, whichever way the search goes.

    A single edge is read from its table at each level. A chain of edges is gone along edge by edge
    (``hops``), so that only edges at reached nodes are moved and its laps, which are many more than the
    edges, are never all made; the quota holds at each node in between, as all laps are equally long and
    nothing behind a node depends on how it was reached. Other laps are written once.
    """
    names = _names(groups)
    if hops is None and least_edges(p.inner) > 1:
        laps = written(laps, "laps")
    left_df = written(left.df, "starts")
    ends = None if ends is None else written(ends.filter(F.col("__end").isNotNull()).distinct(), "ends")
    kept_type = planner.path_type()
    firsts = left_df.select(col(left.last).alias("__a")).distinct().filter(F.col("__a").isNotNull())
    start = ends.select(F.col("__end").alias("__a")) if back else firsts
    wanted = 0 if ends is None or back else ends.count()
    bare = hops is not None and len(kept_type.fields) == 2  # ways are ids, of nodes and edges in turn
    empty_path = F.array(F.col("__a")) if bare else F.array(F.struct(F.lit("n").alias("__kind"), F.col("__a").alias("__id"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in kept_type.fields[2:]]))
    now = start.withColumns({"__b": F.col("__a"), "__way": empty_path})
    types = dict((f.name, f.dataType) for f in laps.schema)
    now = now.withColumns({n: F.array().cast(types[n]) for n in names})
    groups_wanted = prefix.search == "GROUPS"
    seen: list[DataFrame] = []  # parts of the quota that pairs have used
    levels: list[DataFrame] = []

    def quota(df: DataFrame, counted: bool) -> DataFrame:
        if counted and seen and prefix.count == 1:  # a pair that was seen at all has its quota
            df = df.join(joined(seen).select("__a", "__b"), ["__a", "__b"], "left_anti").withColumn("__used", F.lit(0))
        elif counted and seen:
            used = total().withColumnRenamed("__n", "__used")
            df = df.join(used, ["__a", "__b"], "left").withColumn("__used", F.coalesce("__used", F.lit(0)))
        else:
            df = df.withColumn("__used", F.lit(0))
        if groups_wanted:
            return df.filter(F.col("__used") < prefix.count)
        return best(df, F.col("__used"))

    def best(df: DataFrame, used: Column) -> DataFrame:
        edges = F.filter("__way", lambda _, i: i % 2 == 1) if bare else _ids(F.col("__way"), "e")
        rank = F.row_number().over(Window.partitionBy("__a", "__b").orderBy(edges))
        return df.withColumn("__rank", rank).filter(F.col("__rank") + used <= prefix.count).drop("__rank")

    def lap(df: DataFrame) -> DataFrame:
        if hops is None:
            return _extended(df, "__b", "__way", laps, names, back)
        for i, hop in enumerate(hops):
            if i:
                df = written(df if groups_wanted or hops[i - 1].once else best(df, F.lit(0)), "hop", passing)
            df = _along(planner, df, hop, back, bare)
        return df

    def joined(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    def total() -> DataFrame:
        return joined(seen).groupBy("__a", "__b").agg(F.sum("__n").cast("int").alias("__n"))

    def use(level: DataFrame) -> None:
        pairs = level.select("__a", "__b", F.lit(1).alias("__n"))
        if prefix.count > 1:
            pairs = level.groupBy("__a", "__b").agg((F.lit(1) if groups_wanted else F.count(F.lit(1)).cast("int")).alias("__n"))
        seen.append(pairs)
        if len(seen) == SEEN_PARTS:
            seen[:] = [written(total(), "seen")]

    def undone(level: DataFrame) -> DataFrame:
        """Of the frontier the rows whose start has not reached all ends as often as asked."""
        if not wanted or not seen:
            return level
        reached = total().filter(F.col("__n") >= prefix.count).join(ends, F.col("__b") == F.col("__end"), "left_semi")
        done = reached.groupBy("__a").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == wanted)
        return level.join(done.select("__a"), "__a", "left_anti")

    k = 0
    passing: list[str] = []  # what is needed until a level is written
    if p.low == 0:
        levels.append(written(now, "level"))
        use(levels[-1])
    while p.high is None or k < p.high:
        k += 1
        now = undone(now)
        if hops is not None and wanted and seen:
            now = written(now, "frontier", passing)
            if now.isEmpty():
                break
        now = written(quota(lap(now), k >= p.low).drop("__used"), "level")
        while passing:
            remove(now.sparkSession, passing.pop())
        if now.isEmpty():
            break
        if k >= p.low:
            levels.append(now)
            use(now)
    if not levels:
        return _no_rows(planner, left, groups)
    found = joined(levels)
    if back:
        found = found.select(F.col("__b").alias("__a"), F.col("__a").alias("__b"), "__way", *[col(n) for n in names])
    elif ends is not None:
        found = found.join(ends, F.col("__b") == F.col("__end"), "left_semi")
    if bare:
        found = found.withColumn("__way", F.transform("__way", lambda x, i: F.struct(F.when(i % 2 == 0, "n").otherwise("e").alias("__kind"), x.alias("__id"))))
    j = left_df.join(found.withColumnRenamed("__a", left.last), left.last)
    path = F.concat(col(left.path), F.slice(F.col("__way"), 2, F.greatest(F.size("__way") - 1, F.lit(0))))
    df = j.withColumn(left.path, path).drop(left.last, "__way").withColumnRenamed("__b", left.last)
    return Rel(df, {**left.vars, **groups}, left.first, left.last, left.path)


def all_nodes(planner) -> DataFrame:
    out = None
    for t in planner.graph.nodes:
        part = t.df.select(F.col(ID))
        out = part if out is None else out.unionByName(part)
    return out


__all__ = ["FilterP", "Named", "Selected", "check_repeat", "keep_mode", "keep_search", "repeated"]
