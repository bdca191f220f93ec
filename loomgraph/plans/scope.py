"""What a planned pattern binds, and expressions over it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.values import Val
from ..graph import MIXED, as_type, kind_of, unified
from ..lang.lexer import GqlError
from ..lang.tree import (
    Agg, AsType, Attr, Bin, Call, Case, Cast, Comprehension, Exists, Expr, IsNull, IsType, ListLit, Lit, Rec, Un, Value, Var, walk,
)

ELEMENT = ("kind", "id")


@dataclass(frozen=True)
class VarInfo:
    """``kind``: node, edge, group (a list of nodes or edges), path or scalar."""

    kind: str
    of: str = ""  # of a group: node or edge
    attrs: tuple[tuple[str, T.DataType], ...] = ()  # those at hand, as columns ``var$attr``
    known: tuple[tuple[str, T.DataType], ...] = ()  # those that the variable's tables have
    type: T.DataType | None = None  # of a scalar

    def attr(self, name: str) -> T.DataType | None:
        return dict(self.attrs).get(name)


@dataclass
class Rel:
    """Rows of bindings. Columns: one for each variable, ``var$attr`` for the properties that the
    query reads; ``first``, ``last`` and ``path`` where a path is built."""

    df: DataFrame
    vars: dict[str, VarInfo] = field(default_factory=dict)
    first: str | None = None
    last: str | None = None
    path: str | None = None

    def columns_of(self, name: str) -> list[str]:
        return [name, *(f"{name}${a}" for a, _ in self.vars[name].attrs)]


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def literal(value: object) -> Val:
    if value is None:
        return V.null()
    if isinstance(value, bool):
        return Val(F.lit(value), "bool")
    if isinstance(value, int):
        return Val(F.lit(value).cast("long"), "int")
    if isinstance(value, float):
        return Val(F.lit(value), "float")
    return Val(F.lit(value), "str")


SPARK_OF = {"int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "bool": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampNTZType(), "node": T.LongType(), "edge": T.LongType(), "null": T.NullType()}


def spark_type(v: Val) -> T.DataType:
    return v.type if v.type is not None else SPARK_OF.get(v.kind, T.NullType())


def common(values: list[Val]) -> tuple[list[Column], T.DataType]:
    """The values as columns of one type."""
    t = unified([spark_type(v) for v in values])
    if isinstance(t, T.NullType):
        return [F.lit(None) for _ in values], t
    out = []
    for v in values:
        have = spark_type(v)
        out.append(F.lit(None).cast(t) if isinstance(have, T.NullType) else as_type(v.col, have, t))
    return out, t


def merged(values: list[Val]) -> tuple[list[Column], Val]:
    """For CASE and COALESCE: the branches as one type, numbers widened."""
    kinds = {v.kind for v in values if v.kind != "null"}
    if kinds == {"int", "float"}:
        return [v.number() if v.kind != "null" else F.lit(None).cast("double") for v in values], Val(F.lit(None), "float")
    if len(kinds) == 1 and (kinds <= {"node", "edge", "path"}):
        return [v.col for v in values], next(v for v in values if v.kind != "null")
    cols, t = common(values)
    model = V.of_type(F.lit(None), t) if not isinstance(t, T.NullType) else V.null()
    model.elements = next((v.elements for v in values if v.elements), None)
    return cols, model


class Compiler:
    """Expressions over the variables of a Rel.

    ``subqueries`` has the column of each EXISTS and VALUE that was attached to the rows. With
    ``grouped``, aggregates become Spark aggregates, and what stands outside them is taken from one row
    of the group.
    """

    def __init__(self, scope: dict[str, VarInfo], subqueries: dict[int, Val] | None = None, grouped: bool = False):
        self.scope, self.subqueries, self.grouped = scope, subqueries or {}, grouped
        self.local: dict[str, Val] = {}

    def __call__(self, e: Expr) -> Val:
        return getattr(self, f"_{type(e).__name__.lower()}")(e)

    def condition(self, e: Expr) -> Column:
        return V.condition(self(e))

    def _outside(self, v: Val) -> Val:
        return replace(v, col=F.first(v.col), fail=None if v.fail is None else F.first(v.fail)) if self.grouped else v

    def _lit(self, e: Lit) -> Val:
        return literal(e.value)

    def _listlit(self, e: ListLit) -> Val:
        if not e.items:
            return Val(F.array().cast("array<bigint>"), "list", T.ArrayType(T.LongType()))
        cols, t = common([self(x) for x in e.items])
        return Val(F.array(*cols), "list", T.ArrayType(t))

    def _rec(self, e: Rec) -> Val:
        values = {k: self(x) for k, x in sorted(e.fields.items())}
        fields = [T.StructField(k, spark_type(v) if spark_type(v) != T.NullType() else T.StringType()) for k, v in values.items()]
        cols = [(v.col if spark_type(v) != T.NullType() else F.lit(None).cast("string")).alias(k) for k, v in values.items()]
        return Val(F.struct(*cols), "record", T.StructType(fields))

    def _var(self, e: Var) -> Val:
        if e.name in self.local:
            return self.local[e.name]
        info = self.scope.get(e.name)
        if info is None:
            raise GqlError(f"variable {e.name} is not bound")
        if info.kind == "group":
            return self._outside(Val(col(e.name), "list", T.ArrayType(T.LongType()), elements=info.of))
        if info.kind == "scalar":
            return self._outside(V.of_type(col(e.name), info.type))
        return self._outside(Val(col(e.name), info.kind))

    def _attr(self, e: Attr) -> Val:
        if isinstance(e.base, Var) and e.base.name not in self.local:
            info = self.scope.get(e.base.name)
            if info is None:
                raise GqlError(f"variable {e.base.name} is not bound")
            if info.kind in ("node", "edge", "group"):
                t = info.attr(e.name)
                if t is None:
                    if info.kind == "group":
                        empty = F.transform(col(e.base.name), lambda x: F.lit(None).cast("bigint"))
                        return self._outside(Val(empty, "list", T.ArrayType(T.LongType())))
                    return V.null()
                if info.kind == "group":
                    return self._outside(Val(col(f"{e.base.name}${e.name}"), "list", T.ArrayType(t)))
                return self._outside(V.of_type(col(f"{e.base.name}${e.name}"), t))
        base = self(e.base)
        if base.kind == "null":
            return base
        if base.kind in ("record", "element") and base.type is not None:
            t = dict((f.name, f.dataType) for f in base.type).get(e.name)
            if t is None:
                return V.null(fail=base.fail)
            got = V.of_type(base.col[e.name], t)
            return replace(got, fail=base.fail)
        if base.kind == "mixed":
            return V.null(fail=base.fail)
        return V.failure()

    def _bin(self, e: Bin) -> Val:
        if e.op in ("AND", "OR"):
            a, b = self(e.left), self(e.right)
            if any(v.kind not in ("bool", "null", "mixed") for v in (a, b)):
                return V.failure()
            x, y = (v.col["b"] if v.kind == "mixed" else v.col.cast("boolean") for v in (a, b))
            return Val(x & y if e.op == "AND" else x | y, "bool", fail=V.either(a.fail, b.fail))
        if e.op == "IN":
            return self._in(e)
        a, b = self(e.left), self(e.right)
        if e.op in ("+", "-", "*", "/"):
            return V.arithmetic(e.op, a, b)
        return V.compare(e.op, a, b)

    def _in(self, e: Bin) -> Val:
        x = self(e.left)
        if isinstance(e.right, ListLit):
            tests = [V.equal(x, self(y)) for y in e.right.items]
            if not tests:
                return Val(F.when(x.col.isNotNull(), F.lit(False)), "bool", fail=x.fail)
            out, fail = F.lit(False), None
            for t in tests:
                out, fail = out | t.col, V.either(fail, t.fail)
            return Val(out, "bool", fail=None if fail is None else fail & ~F.coalesce(out, F.lit(False)))
        items = self(e.right)
        if items.kind == "null" or x.kind == "null":
            return Val(F.lit(None).cast("boolean"), "bool", fail=V.either(x.fail, items.fail))
        if items.kind != "list":
            return V.failure()
        if items.elements == "element" or x.kind in ("node", "edge"):
            kind, ids = self._ids(items)
            if kind is not None and kind != x.kind:
                return Val(F.lit(False), "bool", fail=x.fail)
            return Val(F.array_contains(ids, x.col), "bool", fail=x.fail)
        one = lambda y: V.equal(x, V.of_type(y, items.type.elementType)).col.cast("boolean")
        return Val(F.aggregate(F.transform(items.col, one), F.lit(False), lambda s, v: s | v), "bool", fail=V.either(x.fail, items.fail))

    @staticmethod
    def _ids(items: Val) -> tuple[str | None, Column]:
        inner = items.type.elementType if items.type is not None else None
        if isinstance(inner, T.StructType):
            return items.elements, F.transform(items.col, lambda y: y["__id"])
        return items.elements, items.col

    def _un(self, e: Un) -> Val:
        v = self(e.arg)
        if e.op == "NOT":
            if v.kind not in ("bool", "null", "mixed"):
                return V.failure()
            c = v.col["b"] if v.kind == "mixed" else v.col.cast("boolean")
            return Val(~c, "bool", fail=v.fail)
        v = V.unmixed(v, "float")
        if v.kind not in ("int", "float", "null"):
            return V.failure()
        return replace(v, col=-v.col) if v.kind != "null" else v

    def _isnull(self, e: IsNull) -> Val:
        v = self(e.arg)
        is_null = v.col.isNull() if v.fail is None else v.col.isNull() | v.fail
        return Val(~is_null if e.negated else is_null, "bool")

    def _istype(self, e: IsType) -> Val:
        v = self(e.arg)
        return Val(V.has_type(v, e.type), "bool", fail=v.fail)

    def _astype(self, e: AsType) -> Val:
        v = self(e.arg)
        fits = V.has_type(v, e.type)
        held = V.unmixed(v, e.type[0]) if v.kind == "mixed" and e.type[0] != "any" else v
        return replace(held, col=F.when(fits, held.col), fail=V.either(v.fail, V.fails_if(v.col.isNotNull() & ~fits)))

    def _case(self, e: Case) -> Val:
        values = [self(v) for _, v in e.arms] + [self(e.other) if e.other is not None else V.null()]
        cols, model = merged(values)
        out = None
        for (when, _), c in zip(e.arms, cols[:-1], strict=True):
            cond = self.condition(when)
            out = F.when(cond, c) if out is None else out.when(cond, c)
        return replace(model, col=out.otherwise(cols[-1]))

    def _cast(self, e: Cast) -> Val:
        return V.cast_to(self(e.arg), e.type)

    def _comprehension(self, e: Comprehension) -> Val:
        source = self(e.source)
        if source.kind == "null":
            return Val(F.array().cast("array<bigint>"), "list", T.ArrayType(T.LongType()))
        if source.kind != "list":
            return V.failure()
        inner = source.type.elementType

        def with_local(x: Column, body: Expr) -> Val:
            before = dict(self.local)
            grouped, self.grouped = self.grouped, False
            if isinstance(inner, T.StructType) and source.elements:
                self.local[e.var] = Val(x, "element", inner)
            elif source.elements:
                self.local[e.var] = Val(x, source.elements)
            else:
                self.local[e.var] = V.of_type(x, inner)
            out = self(body)
            self.local, self.grouped = before, grouped
            return out

        items = F.coalesce(source.col, F.array().cast(spark_array(source)))
        if e.where is not None:
            items = F.filter(items, lambda x: F.coalesce(V.condition(with_local(x, e.where)), F.lit(False)))
        model = with_local(F.lit(None), e.body)
        t = spark_type(model)
        body = F.transform(items, lambda x: with_local(x, e.body).col)
        return Val(body, "list", T.ArrayType(t), elements=model.kind if model.kind in ("node", "edge") else None)

    def _exists(self, e: Exists) -> Val:
        got = self.subqueries[id(e)]
        return self._outside(got)

    def _value(self, e: Value) -> Val:
        return self._outside(self.subqueries[id(e)])

    def _call(self, e: Call) -> Val:
        name = e.name
        if name == "COALESCE":
            values = [self(a) for a in e.args]
            cols, model = merged(values)
            cols = [c if v.fail is None else F.when(~v.fail, c) for c, v in zip(cols, values, strict=True)]
            return replace(model, col=F.coalesce(*cols))
        if name in ("PATH_LENGTH", "CARDINALITY", "ELEMENTS", "NODES", "EDGES"):
            v = self(e.args[0])
            if v.kind == "list" and name == "CARDINALITY":
                return Val(F.when(v.col.isNotNull(), F.size(v.col)).cast("long"), "int")
            if v.kind != "path":
                return V.null() if v.kind == "null" else V.failure()
            t = self._path_type(e.args[0])
            if name == "PATH_LENGTH":
                return Val(F.when(v.col.isNotNull(), F.floor((F.size(v.col) - 1) / 2)).cast("long"), "int")
            if name == "CARDINALITY":
                return Val(F.when(v.col.isNotNull(), F.size(v.col)).cast("long"), "int")
            if name == "ELEMENTS":
                return Val(v.col, "list", T.ArrayType(t), elements="element")
            want = "n" if name == "NODES" else "e"
            return Val(F.filter(v.col, lambda x: x["__kind"] == want), "list", T.ArrayType(t), elements="node" if want == "n" else "edge")
        if name in ("DATE", "LOCAL_DATETIME"):
            return self._temporal(name, e.args)
        if name == "VECTOR":
            got = self.subqueries.get(id(e))
            if got is None:
                raise GqlError("VECTOR is read in RETURN, WHERE and NEAREST only")
            return self._outside(got)
        args = [self(a) for a in e.args]
        wanted = 2 if name in ("MOD", "POW", "POWER", "LOG") else 1
        if len(args) != wanted:
            raise GqlError(f"{name} takes {wanted} argument(s)")
        return V.scalar_call(name, args)

    def _path_type(self, e: Expr) -> T.DataType:
        info = self.scope.get(e.name) if isinstance(e, Var) else None
        return info.type if info is not None and info.type is not None else T.StructType([T.StructField("__kind", T.StringType()), T.StructField("__id", T.LongType())])

    def _temporal(self, name: str, args: list[Expr]) -> Val:
        kind = "date" if name == "DATE" else "datetime"
        if not args:
            return Val(F.current_date() if kind == "date" else F.date_trunc("MILLISECOND", F.localtimestamp()).cast("timestamp_ntz"), kind)
        if isinstance(args[0], Rec):
            parts = {k: self(x).col.cast("int") for k, x in args[0].fields.items()}
            day = F.concat_ws("-", F.lpad(parts["year"].cast("string"), 4, "0"), F.lpad(parts.get("month", F.lit(1)).cast("string"), 2, "0"), F.lpad(parts.get("day", F.lit(1)).cast("string"), 2, "0"))
            if kind == "date":
                return Val(day.try_cast("date"), "date")
            clock = [F.lpad(parts.get(k, F.lit(0)).cast("string"), 2, "0") for k in ("hour", "minute", "second")]
            return Val(F.concat(day, F.lit(" "), F.concat_ws(":", *clock), F.lit("."), F.lpad(parts.get("millisecond", F.lit(0)).cast("string"), 3, "0")).try_cast("timestamp_ntz"), "datetime")
        v = self(args[0])
        if v.kind != "str":
            return V.null(kind) if v.kind == "null" else V.failure()
        pattern = r"^\d{4}-\d{2}-\d{2}$" if kind == "date" else r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,3})?)?$"
        got = F.when(v.col.rlike(pattern), v.col.try_cast("date" if kind == "date" else "timestamp_ntz"))
        return Val(got, kind, fail=V.either(v.fail, V.fails_if(v.col.isNotNull() & got.isNull())))

    # -- aggregates

    def _agg(self, e: Agg) -> Val:
        if e.arg is not None and is_elementwise(e, self.scope):
            inner = Compiler(self.scope, self.subqueries)
            return self._outside(reduce_list(e, inner(e.arg)))
        if not self.grouped:
            raise GqlError("an aggregate can only be returned or sorted by")
        if e.arg is None:
            return Val(F.count(F.lit(1)), "int")
        v = Compiler(self.scope, self.subqueries)(e.arg)
        x = v.col if v.fail is None else F.when(~v.fail, v.col)
        if e.kind == "COUNT":
            return Val(F.count_distinct(x) if e.distinct else F.count(x), "int")
        if e.kind == "COLLECT_LIST":
            if v.kind == "record" and v.type is not None:
                some = F.lit(False)
                for f in v.type:
                    some = some | x[f.name].isNotNull()
                x = F.when(some, x)
            t = spark_type(v)
            return Val(F.array_sort(F.collect_set(x)) if e.distinct else F.collect_list(x), "list", T.ArrayType(t), elements=v.kind if v.kind in ("node", "edge") else None)
        if v.kind == "null":
            return V.null()
        if e.kind in ("MIN", "MAX"):
            v = V.unmixed(v, "float")
            x = v.col if v.fail is None else F.when(~v.fail, v.col)
            return replace(v, col=(F.min if e.kind == "MIN" else F.max)(x), fail=None)
        v = V.unmixed(v, "float")
        if v.kind not in V.NUMBERS:
            return V.null()
        x = v.col if v.fail is None else F.when(~v.fail, v.col)
        if e.kind == "AVG":
            d = x.cast("double")
            return Val(F.avg(F.when(F.lit(True), d)) if not e.distinct else F.sum_distinct(d) / F.when(F.count_distinct(d) != 0, F.count_distinct(d)), "float")
        if e.distinct:
            return Val(F.sum_distinct(x), v.kind)
        return Val(F.try_sum(x) if v.kind == "int" else F.sum(x), v.kind)


def spark_array(v: Val) -> T.DataType:
    return v.type if v.type is not None else T.ArrayType(T.LongType())


def is_elementwise(e: Agg, scope: dict[str, VarInfo]) -> bool:
    """Does the aggregate reduce a group variable's list within one row?"""
    named = [x.name for x in walk(e.arg) if isinstance(x, Var)]
    return any(scope[n].kind == "group" for n in named if n in scope)


def reduce_list(e: Agg, v: Val) -> Val:
    if v.kind != "list" or v.type is None:
        raise GqlError("an aggregate over a group variable takes the variable or one of its properties")
    items = F.filter(v.col, lambda x: x.isNotNull())
    if e.distinct:
        items = F.array_distinct(items)
    kind = kind_of(v.type.elementType)
    if e.kind == "COUNT":
        return Val(F.size(items).cast("long"), "int")
    if e.kind == "COLLECT_LIST":
        return replace(v, col=items)
    if e.kind in ("MIN", "MAX"):
        return V.of_type((F.array_min if e.kind == "MIN" else F.array_max)(items), v.type.elementType)
    zero = F.lit(0).cast("long") if kind == "int" else F.lit(0.0)
    total = F.aggregate(items, zero, lambda s, x: s + x)
    some = F.when(F.size(items) > 0, total)
    return Val(some, kind) if e.kind == "SUM" else Val(some.cast("double") / F.when(F.size(items) > 0, F.size(items)), "float")


def free_vars(node: object) -> set[str]:
    """Variables that an expression or query reads, without those of its own comprehensions."""
    out = {x.name for x in walk(node) if isinstance(x, Var)}
    return out - {x.var for x in walk(node) if isinstance(x, Comprehension)}


__all__ = ["ELEMENT", "MIXED", "Compiler", "Rel", "VarInfo", "col", "common", "free_vars", "is_elementwise", "literal", "merged", "spark_type"]
