"""Nearest neighbours of the matched rows, over all rows or for each anchor."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..graph import ID
from ..lang.lexer import GqlError
from ..lang.tree import Call, ListLit, Lit, Nearest, Var
from ..plans.scope import Rel, VarInfo, col
from pyspark.sql import types as T


def distance(a: Column, b: Column, metric: str) -> Column:
    """L2Sq, Cosine (1 for a zero vector) or Ip, in doubles."""
    products = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    if metric == "L2Sq":
        gaps = F.zip_with(a, b, lambda p, q: p.cast("double") - q.cast("double"))
        return F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v * v)
    if metric == "Ip":
        return -products(a, b)
    norms = F.sqrt(products(a, a)) * F.sqrt(products(b, b))
    return F.when(norms == 0, F.lit(1.0)).otherwise(F.lit(1.0) - products(a, b) / F.when(norms != 0, norms))


def nearest(planner, r: Rel, n: Nearest) -> Rel:
    """The rows of the k nearest bindings of the variable (ROWS: the k nearest rows), nearest first.

    Each distinct binding is measured once. A target that reads another variable's vector ranks once
    for each binding of it. An attribute with an approximate index is searched in the cells near a target
    list or near the vector of the only anchor. Ties go by id. An attribute without vectors, other dimensions and k = 0
    give no rows.
    """
    info = r.vars.get(n.var)
    if info is None or info.kind != "node":
        raise GqlError(f"NEAREST needs a node variable, {n.var} is none")
    if n.alias and n.alias in r.vars:
        raise GqlError(f"{n.alias} is bound already")
    alias = n.alias or planner.fresh("d")
    out = {**r.vars, alias: VarInfo("scalar", type=T.DoubleType())}

    def nothing() -> Rel:
        return Rel(r.df.withColumn(alias, F.lit(None).cast("double")).filter(F.lit(False)), out)

    stored = planner.graph.vectors.get(n.attr)
    if stored is None or n.k == 0:
        return nothing()
    vectors, dim, metric = stored
    whole = vectors.filter(F.size("vector") == dim)
    own = whole.select(F.col(ID).alias(n.var), F.col("vector").alias("__v"))
    index = planner.graph.cells.get(n.attr)

    def close(target: list[float]):
        """``own``, or of an approximate index the rows of the cells near the target."""
        if index is None:
            return own
        found = index.near(target, n.k, r.df.select(col(n.var).alias(ID)).distinct())
        return found.select(F.col(ID).alias(n.var), F.col("vector").alias("__v"))

    if isinstance(n.target, ListLit):
        values = [x.value for x in n.target.items if isinstance(x, Lit) and type(x.value) in (int, float)]
        if len(values) != len(n.target.items):
            raise GqlError("the target of NEAREST is a list of numbers")
        if len(values) != dim:
            return nothing()
        target = F.array(*[F.lit(float(x)) for x in values])
        found = r.df.select(col(n.var)).distinct().join(close([float(x) for x in values]), n.var).withColumn(alias, distance(F.col("__v"), target, metric)).drop("__v")
        if n.rows:
            df = r.df.join(found, n.var).orderBy(col(alias), col(n.var)).limit(n.k)
        else:
            df = r.df.join(found.orderBy(col(alias), col(n.var)).limit(n.k), n.var).orderBy(col(alias), col(n.var))
        return Rel(df, out)
    if not (isinstance(n.target, Call) and n.target.name == "VECTOR" and isinstance(n.target.args[0], Var) and isinstance(n.target.args[1], Lit)):
        raise GqlError("the target of NEAREST is a list of numbers or VECTOR(node, 'attr')")
    anchor, attr = n.target.args[0].name, n.target.args[1].value
    other = planner.graph.vectors.get(attr)
    if anchor not in r.vars:
        raise GqlError(f"variable {anchor} is not bound")
    if other is None or other[1] != dim:
        return nothing()
    theirs = other[0].filter(F.size("vector") == dim).select(F.col(ID).alias(anchor), F.col("vector").alias("__w"))
    if index is not None and anchor != n.var:
        fixed = r.df.select(col(anchor)).distinct().join(theirs, anchor).limit(2).collect()
        if len(fixed) == 1:  # one anchor: the cells near it; several are ranked exactly
            own = close(fixed[0]["__w"])
    pairs = r.df.select(col(anchor), col(n.var)).distinct() if anchor != n.var else r.df.select(col(anchor)).distinct()
    found = pairs.join(own, n.var).join(theirs, anchor).withColumn(alias, distance(F.col("__v"), F.col("__w"), metric)).drop("__v", "__w")
    keys = sorted({anchor, n.var})
    each = Window.partitionBy(col(anchor)).orderBy(col(alias), col(n.var))
    if n.rows:
        df = r.df.join(found, keys).withColumn("__rank", F.row_number().over(each)).filter(F.col("__rank") <= n.k).drop("__rank")
    else:
        top = found.withColumn("__rank", F.row_number().over(each)).filter(F.col("__rank") <= n.k).drop("__rank")
        df = r.df.join(top, keys)
    return Rel(df.orderBy(col(anchor), col(alias), col(n.var)), out)
