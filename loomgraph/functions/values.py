"""Typed columns: what an expression compiles to.

An expression's outcome is a value, null (unknown) or a failure, such as a comparison of a number
with a string. A failure is null wherever it is read, but a connective with a failed operand fails as
a whole; so a value carries, where it can fail at all, a column that says whether it did.
"""

from __future__ import annotations

from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import MIXED, MIXED_FIELD, kind_of

NUMBERS = ("int", "float")
#: What is known to fail before any row is read; a query's planning collects it.
NOTES: ContextVar[list[str] | None] = ContextVar("notes", default=None)


def note(text: str) -> None:
    found = NOTES.get()
    if found is not None and text not in found:
        found.append(text)

ORDERED = ("int", "float", "str", "bool", "date", "datetime")


@dataclass
class Val:
    col: Column
    kind: str  # int float str bool date datetime list record mixed node edge path null
    type: T.DataType | None = None  # of lists and records
    fail: Column | None = None
    elements: str | None = None  # of a list: "node", "edge" or "element" if it holds these

    def number(self) -> Column:
        return self.col.cast("double") if self.kind == "int" else self.col


def null(kind: str = "null", fail: Column | None = None) -> Val:
    return Val(F.lit(None), kind, fail=fail)


def failure() -> Val:
    return null(fail=F.lit(True))


def of_type(col: Column, t: T.DataType) -> Val:
    kind = kind_of(t)
    if kind == "int":
        return Val(col if isinstance(t, T.LongType) else col.cast("long"), "int")
    if kind == "float":
        return Val(col if isinstance(t, T.DoubleType) else col.cast("double"), "float")
    if kind == "datetime":
        return Val(col.cast("timestamp_ntz"), "datetime")
    return Val(col, kind, t if kind in ("list", "record", "mixed") else None)


def either(*fails: Column | None) -> Column | None:
    out = None
    for f in fails:
        if f is not None:
            out = f if out is None else out | f
    return out


def fails_if(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def arithmetic(op: str, a: Val, b: Val) -> Val:
    fail = either(a.fail, b.fail)
    if a.kind == "mixed" or b.kind == "mixed":
        a, b = unmixed(a, "float"), unmixed(b, "float")
    if "null" in (a.kind, b.kind):
        return null(fail=fail)
    if a.kind == "datetime" and b.kind == "int" and op in "+-":
        step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (b.col / F.lit(1000)).cast("decimal(18,6)"))
        return Val(a.col + step if op == "+" else a.col - step, "datetime", fail=fail)
    if a.kind not in NUMBERS or b.kind not in NUMBERS:
        note(f"{a.kind} {op} {b.kind} has no value")
        return failure()
    whole = a.kind == b.kind == "int"
    if op == "/":
        if whole:
            return Val(F.when(b.col != 0, F.expr("0").cast("long") + _div(a.col, b.col)), "int", fail=either(fail, fails_if(b.col == 0)))
        x, y = a.number(), b.number()
        zero = F.when(x == 0, F.lit(float("nan"))).when(F.isnan(x), x).when((x > 0), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        return Val(F.when(x.isNull() | y.isNull(), F.lit(None)).when(y == 0, zero).otherwise(x / F.when(y != 0, y)), "float", fail=fail)
    if whole:
        return Val({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a.col, b.col), "int", fail=fail)
    x, y = a.number(), b.number()
    return Val(x + y if op == "+" else x - y if op == "-" else x * y, "float", fail=fail)


def _div(a: Column, b: Column) -> Column:
    """Whole division that drops the fraction; null for a zero divisor."""
    q = F.try_divide(a.cast("decimal(38,0)"), b.cast("decimal(38,0)"))
    return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q)).cast("long")


def unmixed(v: Val, kind: str) -> Val:
    """The values of this kind of a MIXED value, null for others."""
    if v.kind != "mixed":
        return v
    if kind in NUMBERS:
        return Val(F.coalesce(v.col["d"], v.col["l"].cast("double")), "float", fail=v.fail)
    return Val(v.col[MIXED_FIELD.get(kind, "j")], kind, fail=v.fail)


def equal(a: Val, b: Val, nested: bool = False) -> Val:
    """``=``: unknown for nulls, a failure for values of different kinds (false inside lists)."""
    fail = either(a.fail, b.fail)
    if "null" in (a.kind, b.kind):
        return Val(F.lit(None).cast("boolean"), "bool", fail=fail)
    if "mixed" in (a.kind, b.kind):
        if a.kind == b.kind:
            same = F.when(a.col["kind"] == b.col["kind"], a.col == b.col)
            return Val(same, "bool", fail=either(fail, fails_if(a.col["kind"] != b.col["kind"])))
        m, o = (a, b) if a.kind == "mixed" else (b, a)
        fits = m.col["kind"].isin(list(NUMBERS)) if o.kind in NUMBERS else m.col["kind"] == o.kind
        got = unmixed(m, o.kind)
        test = got.number() == o.number() if o.kind in NUMBERS else got.col == o.col
        return Val(F.when(fits, test), "bool", fail=either(fail, fails_if(~fits)))
    if a.kind in NUMBERS and b.kind in NUMBERS:
        same = a.col == b.col if a.kind == b.kind else a.number() == b.number()
        return Val(same, "bool", fail=fail)
    if {a.kind, b.kind} == {"node", "edge"}:
        return Val(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False)), "bool", fail=fail)
    if a.kind != b.kind:
        if not nested:
            note(f"{a.kind} and {b.kind} are never equal or unequal")
        return Val(F.lit(False), "bool", fail=fail) if nested else Val(F.lit(None).cast("boolean"), "bool", fail=F.lit(True))
    if a.kind == "list" and a.type is not None and b.type is not None:
        return Val(_lists_equal(a, b), "bool", fail=fail)
    if a.kind == "record" and a.type is not None and b.type is not None:
        left, right = {f.name: f.dataType for f in a.type}, {f.name: f.dataType for f in b.type}
        if set(left) != set(right):
            return Val(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False)), "bool", fail=fail)
        out = F.lit(True)
        for k in sorted(left):
            out = out & equal(of_type(a.col[k], left[k]), of_type(b.col[k], right[k]), nested=True).col
        return Val(F.when(a.col.isNotNull() & b.col.isNotNull(), out), "bool", fail=fail)
    return Val(a.col == b.col, "bool", fail=fail)


def _lists_equal(a: Val, b: Val) -> Column:
    x, y = a.type.elementType, b.type.elementType
    one = lambda p, q: equal(of_type(p, x), of_type(q, y), nested=True).col
    each = F.zip_with(a.col, b.col, lambda p, q: one(p, q).cast("boolean"))
    all_of = F.aggregate(each, F.lit(True), lambda s, v: s & v)
    return F.when(a.col.isNotNull() & b.col.isNotNull(), F.when(F.size(a.col) != F.size(b.col), F.lit(False)).otherwise(all_of))


def compare(op: str, a: Val, b: Val) -> Val:
    fail = either(a.fail, b.fail)
    if op in ("=", "<>"):
        out = equal(a, b)
        return out if op == "=" else Val(~out.col, "bool", fail=out.fail)
    if "null" in (a.kind, b.kind):
        return Val(F.lit(None).cast("boolean"), "bool", fail=fail)
    if "mixed" in (a.kind, b.kind) and a.kind != b.kind:
        m, o = (a, b) if a.kind == "mixed" else (b, a)
        fits = m.col["kind"].isin(list(NUMBERS)) if o.kind in NUMBERS else m.col["kind"] == o.kind
        got = unmixed(m, o.kind)
        fail = either(fail, fails_if(~fits))
        a, b = (got, o) if m is a else (o, got)
    both = a.kind in NUMBERS and b.kind in NUMBERS
    if not both and (a.kind != b.kind or a.kind not in ORDERED):
        note(f"{a.kind} {op} {b.kind} is never true")
        return Val(F.lit(None).cast("boolean"), "bool", fail=F.lit(True))
    x, y = (a.number(), b.number()) if both and a.kind != b.kind else (a.col, b.col)
    return Val({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool", fail=fail)


def condition(v: Val) -> Column:
    """True exactly where the value is true."""
    if v.kind not in ("bool", "null", "mixed"):
        return F.lit(False)
    col = v.col["b"] if v.kind == "mixed" else v.col.cast("boolean")
    return col if v.fail is None else col & ~v.fail


def has_type(v: Val, t: tuple) -> Column:
    """Is the value of this type? Null is of the type of nulls and of any type."""
    kind = t[0]
    if kind == "any":
        return F.lit(True)
    if kind == "null":
        return v.col.isNull()
    if v.kind == "mixed":
        return F.coalesce(v.col["kind"] == kind, F.lit(False))
    if v.kind != kind:
        return F.lit(False)
    if kind == "list" and len(t) > 1 and v.type is not None:
        inner = of_type(F.lit(None), v.type.elementType).kind
        if t[1][0] not in ("any", inner):
            return F.lit(False)
    if kind == "record" and len(t) > 1 and v.type is not None:
        have = {f.name: f.dataType for f in v.type}
        out = v.col.isNotNull()
        for k, x in t[1].items():
            out = out & (has_type(of_type(v.col[k], have[k]), x) if k in have else F.lit(False))
        return out
    return v.col.isNotNull()


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def scalar_call(name: str, args: list[Val]) -> Val:
    """The math functions: null in, null out; a result outside the reals is null."""
    fail = either(*[a.fail for a in args])
    args = [unmixed(a, "float") for a in args]
    if any(a.kind == "null" for a in args):
        return null(fail=fail)
    if any(a.kind not in NUMBERS for a in args):
        return failure()
    x = args[0]
    d = x.number()
    if name == "MOD":
        y = args[1]
        if x.kind == y.kind == "int":
            return Val(F.try_mod(x.col, y.col), "int", fail=either(fail, fails_if(y.col == 0)))
        return Val(F.try_mod(d, y.number()), "float", fail=either(fail, fails_if(y.number() == 0)))
    if name == "ABS":
        return Val(F.abs(x.col), x.kind, fail=fail)
    if name == "SIGN":
        return Val(F.signum(x.col).cast("long"), "int", fail=fail) if x.kind == "int" else Val(F.signum(d) + F.lit(0.0), "float", fail=fail)
    one = {"FLOOR": F.floor, "CEIL": F.ceil, "CEILING": F.ceil, "EXP": F.exp, "LN": F.log, "SQRT": F.sqrt, "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "RADIANS": F.radians, "DEGREES": F.degrees}
    if name == "ROUND":
        out = F.when(d >= 0, F.floor(d + F.lit(0.5))).otherwise(F.ceil(d - F.lit(0.5))).cast("double")
        return Val(F.when(F.abs(d) >= F.lit(2.0**52), d).otherwise(out), "float", fail=fail)
    if name in ("FLOOR", "CEIL", "CEILING"):
        return Val(F.when(F.abs(d) >= F.lit(2.0**52), d).otherwise(one[name](d).cast("double")), "float", fail=fail)
    if name in ("POW", "POWER"):
        return Val(finite(F.pow(d, args[1].number())), "float", fail=fail)
    if name == "LOG":
        return Val(finite(F.log(args[1].number()) / F.when(F.log(d) != 0, F.log(d))), "float", fail=fail)
    return Val(finite(one[name](d)), "float", fail=fail)


def cast_to(v: Val, want: str) -> Val:
    fail = v.fail
    if v.kind == "mixed":
        number = F.coalesce(v.col["d"], v.col["l"].cast("double"), F.expr("0").cast("double") + v.col["s"].try_cast("double"))
        return Val(number if want == "FLOAT" else number.try_cast("long"), "float" if want == "FLOAT" else "int", fail=fail)
    if v.kind == "null":
        return null("int" if want == "INTEGER" else "float", fail)
    if want == "FLOAT":
        if v.kind in NUMBERS:
            return Val(v.number(), "float", fail=fail)
        if v.kind == "str":
            got = F.trim(v.col).try_cast("double")
            return Val(got, "float", fail=either(fail, fails_if(v.col.isNotNull() & got.isNull())))
        return failure()
    if v.kind == "int":
        return v
    if v.kind == "float":
        low, high = F.lit(-(2**63)).cast("long"), F.lit(2**63 - 1).cast("long")
        whole = F.when(F.isnan(v.col), F.lit(0).cast("long")).when(v.col >= F.lit(2.0**63), high).when(v.col <= F.lit(-(2.0**63)), low).otherwise(v.col.try_cast("long"))
        return Val(F.when(v.col.isNotNull(), whole), "int", fail=fail)
    if v.kind == "str":
        text = F.trim(v.col)
        got = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
        return Val(got, "int", fail=either(fail, fails_if(v.col.isNotNull() & got.isNull())))
    return failure()


def mixed_schema() -> T.StructType:
    return MIXED
