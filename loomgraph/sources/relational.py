"""A property graph over relational tables: keys become ids, foreign keys become edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..graph import DST, EID, ID, SRC, EdgeTable, NodeTable, PropertyGraph, node_id


class RelationalGraph:
    """Builds a graph table by table. Ids are ``code << 48 | key``; nothing is read or copied yet."""

    def __init__(self, spark: SparkSession):
        self.graph = PropertyGraph(spark)
        self.codes: dict[str, int] = {}
        self.rows: dict[str, DataFrame] = {}
        self.props: dict[str, dict[str, Column]] = {}

    def id_of(self, table: str, key: Column) -> Column:
        return node_id(self.codes[table], key)

    def nodes(self, name: str, df: DataFrame, key: Column, props: dict[str, Column], labels: tuple[str, ...] = ()) -> None:
        self.codes[name] = self.graph.next_code()
        self.rows[name], self.props[name] = df.withColumn(ID, self.id_of(name, key)), props
        table = self.rows[name].select(F.col(ID), *[c.alias(p) for p, c in props.items()])
        self.graph.nodes.append(NodeTable(name, frozenset(labels or (name,)), table))

    def foreign_key(self, label: str, holder: str, key: Column, target: str, reverse: bool = False) -> None:
        """An edge for every row of ``holder`` to (``reverse``: from) the row of ``target`` with its key.
        The holder's properties come along in the same row."""
        code = self.graph.next_code()
        own, other = F.col(ID), self.id_of(target, key)
        src, dst = (other, own) if reverse else (own, other)
        ends = [F.col(ID).bitwiseAND(F.lit((1 << 48) - 1)).bitwiseOR(F.lit(code << 48)).alias(EID), src.alias(SRC), dst.alias(DST)]
        rows = self.rows[holder].filter(key.isNotNull())
        wide = rows.select(*ends, *[c.alias(p) for p, c in self.props[holder].items()])
        names = (target, holder) if reverse else (holder, target)
        self.graph.edges.append(EdgeTable(label, frozenset((label,)), rows.select(*ends), True, frozenset((names[0],)), frozenset((names[1],)), ("dst" if reverse else "src", holder), wide))

    def edges(self, label: str, df: DataFrame, src: tuple[str, Column], dst: tuple[str, Column], props: dict[str, Column] | None = None, directed: bool = True, key: Column | None = None) -> None:
        """An edge for every row, with its own properties. Without a key, ids are given in row order."""
        code = self.graph.next_code()
        number = F.monotonically_increasing_id() if key is None else key.cast("long")
        rows = df.select((F.lit(code << 48) + number).alias(EID), self.id_of(src[0], src[1]).alias(SRC), self.id_of(dst[0], dst[1]).alias(DST), *[c.alias(p) for p, c in (props or {}).items()])
        self.graph.edges.append(EdgeTable(label, frozenset((label,)), rows, directed, frozenset((src[0],)), frozenset((dst[0],))))


def row_number_in_file() -> Column:
    """A number for each row of a Parquet table, the same in every scan: its place in its file, with the
    file's checksum above bit 36 where a table has several files."""
    return F.shiftleft(F.crc32(F.col("_metadata.file_name")).bitwiseAND(F.lit(0xFFF)), 36) + F.col("_metadata.row_index")


#: Schemas of tables that were read before: a schema read again would be a job for every table.
_SCHEMAS: dict[str, StructType] = {}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def commerce_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts, orders, line items, events, documents, pages and
    vectors of a folder of Parquet tables as one graph."""
    read = lambda name: read_table(spark, f"{folder}/{name}.parquet")
    c = F.col
    b = RelationalGraph(spark)
    b.nodes("Region", read("region"), c("r_regionkey"), {"key": c("r_regionkey").cast("long"), "name": c("r_name")})
    b.nodes("Nation", read("nation"), c("n_nationkey"), {"key": c("n_nationkey").cast("long"), "name": c("n_name")})
    b.nodes("Customer", read("customer"), c("c_custkey"), {"key": c("c_custkey"), "name": c("c_name"), "acctbal": c("c_acctbal"), "mktsegment": c("c_mktsegment")}, ("Customer", "Party"))
    b.nodes("Supplier", read("supplier"), c("s_suppkey"), {"key": c("s_suppkey"), "name": c("s_name"), "acctbal": c("s_acctbal")}, ("Supplier", "Party"))
    b.nodes("Part", read("part"), c("p_partkey"), {"key": c("p_partkey"), "name": c("p_name"), "brand": c("p_brand"), "type": c("p_type"), "size": c("p_size").cast("long"), "retailprice": c("p_retailprice")})
    b.nodes("Order", read("orders"), c("o_orderkey"), {"key": c("o_orderkey"), "status": c("o_orderstatus"), "totalprice": c("o_totalprice"), "orderdate": c("o_orderdate").cast("timestamp_ntz"), "priority": c("o_orderpriority")})
    lines = read("lineitem").withColumn("__row", row_number_in_file())
    b.nodes(
        "LineItem",
        lines,
        c("__row"),
        {"orderkey": c("l_orderkey"), "linenumber": c("l_linenumber").cast("long"), "quantity": c("l_quantity"), "extendedprice": c("l_extendedprice"), "discount": c("l_discount"), "tax": c("l_tax"), "returnflag": c("l_returnflag"), "linestatus": c("l_linestatus"), "shipdate": c("l_shipdate").cast("timestamp_ntz")},
    )
    b.nodes("Event", read("events"), c("event_id"), {"key": c("event_id").cast("long"), "ts": c("ts").cast("timestamp_ntz"), "type": c("event_type"), "value": c("value")})
    b.nodes("Vec", read("embeddings"), c("vec_id"), {"key": c("vec_id").cast("long"), "label": c("label").cast("long")})
    b.foreign_key("IN_REGION", "Nation", c("n_regionkey"), "Region")
    b.foreign_key("IN_NATION", "Customer", c("c_nationkey"), "Nation")
    b.foreign_key("IN_NATION", "Supplier", c("s_nationkey"), "Nation")
    b.foreign_key("PLACED", "Order", c("o_custkey"), "Customer", reverse=True)
    b.foreign_key("HAS_ITEM", "LineItem", c("l_orderkey"), "Order", reverse=True)
    b.foreign_key("OF_PART", "LineItem", c("l_partkey"), "Part")
    b.foreign_key("FROM_SUPPLIER", "LineItem", c("l_suppkey"), "Supplier")
    b.foreign_key("DID", "Event", c("user_id"), "Customer", reverse=True)
    n = read("nation")
    pairs = n.select(c("n_nationkey").alias("a"), c("n_regionkey").alias("r")).join(n.select(c("n_nationkey").alias("b"), c("n_regionkey").alias("r")), "r").filter("a < b")
    b.edges("PEER", pairs, ("Nation", c("a")), ("Nation", c("b")), {"weight": (c("b") - c("a")).cast("long")}, directed=False, key=c("a") * 1000 + c("b"))
    # a small directed graph with cycles: every nation to the next two, by key
    steps = n.select(c("n_nationkey").alias("a"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    steps = steps.select("a", ((c("a") + c("k")) % 25).alias("b"), "k")
    b.edges("ROUTE", steps, ("Nation", c("a")), ("Nation", c("b")), {"km": (c("k") * 100).cast("long")}, key=c("a") * 10 + c("k"))
    vectors = read("embeddings").select(b.id_of("Vec", c("vec_id")).alias(ID), c("embedding").cast("array<float>").alias("vector"))
    for attr, metric in (("emb", "L2Sq"), ("emb_cos", "Cosine"), ("emb_ip", "Ip")):
        b.graph.vectors[attr] = (vectors, 64, metric)
    return b.graph
