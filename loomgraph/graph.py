"""Property graphs as DataFrames.

Nodes and edges are kept in tables with one label set each, so that label expressions are settled
while a query is planned and a scan reads only the tables that can match. Nodes have ``__id``, edges
``__eid``, ``__src`` and ``__dst``; the other columns are properties. An edge table may know which
node tables its ends are in, and may hold, row by row, the properties of the node at one end (a
foreign key is an edge and a node in one row); then neither end needs a join.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID, EID, SRC, DST = "__id", "__eid", "__src", "__dst"
CODE_BITS = 48
#: A property whose values differ in kind is a struct with these fields.
MIXED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("l", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("b", T.BooleanType()), T.StructField("j", T.StringType())])
MIXED_FIELD = {"int": "l", "float": "d", "str": "s", "bool": "b", "list": "j", "record": "j"}


@dataclass
class NodeTable:
    name: str
    labels: frozenset[str]
    df: DataFrame

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema if not f.name.startswith("__")}


@dataclass
class EdgeTable:
    name: str
    labels: frozenset[str]
    df: DataFrame
    directed: bool = True
    src: frozenset[str] | None = None  # names of node tables; None: unknown
    dst: frozenset[str] | None = None
    inline: tuple[str, str] | None = None  # ("src" or "dst", node table): that node's properties are in `wide`
    wide: DataFrame | None = None  # __eid, __src, __dst and the node's properties

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema if not f.name.startswith("__")}


@dataclass
class PropertyGraph:
    spark: SparkSession
    nodes: list[NodeTable] = field(default_factory=list)
    edges: list[EdgeTable] = field(default_factory=list)
    vectors: dict[str, tuple[DataFrame, int, str]] = field(default_factory=dict)  # attr -> (df(__id, vector), dim, metric)
    codes: int = 0
    cells: dict[str, object] = field(default_factory=dict)  # attr -> its approximate index (operators/vector_index.py)

    def next_code(self) -> int:
        self.codes += 1
        return self.codes

    def node_table(self, name: str) -> NodeTable:
        return next(t for t in self.nodes if t.name == name)

    def copy(self) -> PropertyGraph:
        return PropertyGraph(self.spark, list(self.nodes), list(self.edges), dict(self.vectors), self.codes, dict(self.cells))

    def node_count(self) -> int:
        return sum(t.df.count() for t in self.nodes)

    def edge_count(self) -> int:
        return sum(t.df.count() for t in self.edges)

    def labels(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for t in [*self.nodes, *self.edges]:
            n = t.df.count()
            for label in t.labels:
                out[label] = out.get(label, 0) + n
        return out


def node_id(code: int, key):
    """The id of the node with an integer key in the table with this code."""
    return F.lit(code << CODE_BITS) + key.cast("long")


def is_mixed(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and t.names == MIXED.names


def normal(t: T.DataType) -> T.DataType:
    """The type without what says that values are never null, and numbers at their full width."""
    if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
        return T.LongType()
    if isinstance(t, T.FloatType):
        return T.DoubleType()
    if isinstance(t, T.TimestampType):
        return T.TimestampNTZType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(normal(t.elementType))
    if isinstance(t, T.StructType):
        return MIXED if is_mixed(t) else T.StructType([T.StructField(f.name, normal(f.dataType)) for f in t.fields])
    return t


def unified(types: Iterable[T.DataType]) -> T.DataType:
    """The type that holds all of these: the same, a wider number, or MIXED."""
    found: list[T.DataType] = []
    for t in types:
        t = normal(t)
        if not isinstance(t, T.NullType) and t not in found:
            found.append(t)
    return found[0] if len(found) == 1 else MIXED if found else T.NullType()


def as_type(column, have: T.DataType, want: T.DataType):
    """The column as ``want``: itself, or wrapped as a MIXED value with its kind."""
    if is_mixed(want) and not is_mixed(have):
        kind = kind_of(have)
        slot = MIXED_FIELD.get(kind, "j")
        value = column if slot != "j" else F.to_json(column)
        fields = [F.lit(kind).alias("kind"), *[(value.cast(f.dataType) if f.name == slot else F.lit(None).cast(f.dataType)).alias(f.name) for f in MIXED.fields[1:]]]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column if normal(have) == normal(want) and have == want else column.cast(want)


def kind_of(t: T.DataType) -> str:
    if is_mixed(t):
        return "mixed"
    match t:
        case T.LongType() | T.IntegerType() | T.ShortType() | T.ByteType():
            return "int"
        case T.DoubleType() | T.FloatType() | T.DecimalType():
            return "float"
        case T.StringType():
            return "str"
        case T.BooleanType():
            return "bool"
        case T.DateType():
            return "date"
        case T.TimestampType() | T.TimestampNTZType():
            return "datetime"
        case T.ArrayType():
            return "list"
        case T.StructType():
            return "record"
    return "null"
