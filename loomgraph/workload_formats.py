"""Queries over graphs that were written in a format, a store or a dump and read back, each with SQL.

The tables are written whole by Spark into the shared folder, in the layout that the source reads.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import PropertyGraph
from .lang.lexer import GqlError
from .session import GraphSession
from .sources import files
from .sources.relational import commerce_graph, read_table
from .sparql import Mapping
from .storage import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

#: name -> (query, SQL)
FORMATS: dict[str, tuple[Query, str]] = {}


def _add(name: str, sql: str) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        FORMATS[name] = (query, sql)
        return query

    return register


def _part_of_graph(spark: SparkSession, folder: str, nodes: set[str], edges: set[str]) -> PropertyGraph:
    """The commerce graph's tables of these names, edges only where both ends are among them."""
    whole = commerce_graph(spark, folder)
    inside = lambda t: t.name in edges and t.src <= nodes and t.dst <= nodes
    return PropertyGraph(spark, [t for t in whole.nodes if t.name in nodes], [t for t in whole.edges if inside(t)], {}, whole.codes)


def _map_of_nations(spark: SparkSession, folder: str) -> PropertyGraph:
    return _part_of_graph(spark, folder, {"Region", "Nation"}, {"IN_REGION", "PEER", "ROUTE"})


def _text_file(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def _numbered_files(df: DataFrame, folder: str, stem: str, **options: str) -> None:
    """``df`` as the files stem_0_0.csv, stem_1_0.csv ... with a header each."""
    spark, fresh = df.sparkSession, f"{folder}/_{stem}"
    df.write.options(header="true", **options).csv(fresh)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(fresh).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(x.getPath().getName() for x in fs.listStatus(path(fresh)))
    for k, part in enumerate(p for p in parts if p.startswith("part-")):
        fs.rename(path(f"{fresh}/{part}"), path(f"{folder}/{stem}_{k}_0.csv"))
    fs.delete(path(fresh), True)


@_add("json_reload", "SELECT a.n_name AS a, b.n_name AS b, (abs(b.n_nationkey - a.n_nationkey))::BIGINT AS w, r_name AS r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey JOIN region ON r_regionkey = a.n_regionkey")
def json_reload(spark: SparkSession, folder: str) -> DataFrame:
    """JSON dump to a file, read back."""
    path = shared_folder(spark, "json")
    _text_file(spark, GraphSession(spark, _map_of_nations(spark, folder)).to_json(), path)
    g = GraphSession.import_json(spark, path)
    return g.execute("MATCH (a:Nation)~[p:PEER]~(b:Nation), (a)-[:IN_REGION]->(r:Region) RETURN a.name AS a, b.name AS b, p.weight AS w, r.name AS r")


@_add("gql_dump_replay", "SELECT n_name AS n, r_name AS r, (n_nationkey * 10)::BIGINT AS k FROM nation JOIN region ON r_regionkey = n_regionkey")
def gql_dump_replay(spark: SparkSession, folder: str) -> DataFrame:
    """The INSERT statement of a dump, run on an empty graph."""
    g = GraphSession(spark)
    g.execute(GraphSession(spark, _map_of_nations(spark, folder)).to_gql())
    return g.execute("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.name AS n, r.name AS r, n.key * 10 AS k")


@_add("csv_import", "SELECT n_name AS n, c_mktsegment AS s, count(*) AS customers, sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS cents FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_nationkey, n_name, c_mktsegment")
def csv_import(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files with a configuration of their columns."""
    path = shared_folder(spark, "csv")
    customer, nation = read_table(spark, f"{folder}/customer.parquet"), read_table(spark, f"{folder}/nation.parquet")
    key = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    customer.select(key("c", "c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("acctbal")).write.csv(f"{path}/Customer.csv", header=True)
    nation.select(key("n", "n_nationkey").alias("vid"), F.col("n_name").alias("name")).write.csv(f"{path}/Nation.csv", header=True)
    customer.select(key("c", "c_custkey").alias("SRC_ID"), key("n", "c_nationkey").alias("DST_ID")).write.csv(f"{path}/customer_lives_in_nation.csv", header=True)
    columns = {"Customer.csv": {"customer_id": "STRING", "segment": "STRING", "acctbal": "FLOAT64"}, "Nation.csv": {"vid": "STRING", "name": "STRING"}, "customer_lives_in_nation.csv": {"SRC_ID": "STRING", "DST_ID": "STRING"}}
    _text_file(spark, json.dumps({"files": [{"path": p, "columns": c} for p, c in columns.items()]}), f"{path}/spanner_import_config.json")
    g = GraphSession.import_csv(spark, path)
    return g.execute("MATCH (c:Customer)-[:lives_in]->(n:Nation) RETURN n.name AS n, c.segment AS s, COUNT(*) AS customers, SUM(CAST(ROUND(c.acctbal * 100) AS INTEGER)) AS cents GROUP BY n, c.segment")


@_add(
    "benchmark_csv_import",
    """SELECT c_custkey AS id, n_name AS nation, r_name AS region, coalesce(n, 0) AS emails
       FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
       LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
)
def benchmark_csv_import(spark: SparkSession, folder: str) -> DataFrame:
    """Pipe-separated files: nodes, places with a second label by type, edges and lists of values."""
    path = shared_folder(spark, "pipes")
    read = lambda t: read_table(spark, f"{folder}/{t}.parquet")
    customer, nation, region, orders = map(read, ("customer", "nation", "region", "orders"))
    write = lambda df, stem: _numbered_files(df, path, stem, sep="|")
    write(customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("firstName")), "person")
    country = F.col("n_nationkey") + 100
    places = nation.select(country.alias("id"), F.col("n_name").alias("name"), F.lit("country").alias("type"))
    write(places.unionByName(region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("continent").alias("type"))), "place")
    write(customer.select(F.col("c_custkey").alias("Person.id"), (F.col("c_nationkey") + 100).alias("Place.id")), "person_isLocatedIn_place")
    write(nation.select(country.alias("A.id"), F.col("n_regionkey").alias("B.id")), "place_isPartOf_place")
    write(orders.select(F.col("o_custkey").alias("Person.id"), F.col("o_orderpriority").alias("email")).distinct(), "person_email_emailaddress")
    g = GraphSession(spark, files.graph_from_ldbc(spark, path))
    return g.execute("MATCH (p:Person)-[:isLocatedIn]->(c:Country)-[:isPartOf]->(x:Continent) RETURN p.id AS id, c.name AS nation, x.name AS region, COALESCE(CARDINALITY(p.email), 0) AS emails")


@_add("edge_list_import", "SELECT count(*) AS n FROM lineitem x JOIN lineitem y ON x.l_partkey = y.l_suppkey")
def edge_list_import(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of two numbers: suppliers and the parts they deliver, numbers read as one kind of node."""
    path = shared_folder(spark, "edges")
    lines = read_table(spark, f"{folder}/lineitem.parquet")
    lines.select(F.concat_ws("\t", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("value")).write.text(path)
    g = GraphSession(spark, files.graph_from_edge_list(spark, path))
    return g.execute("MATCH (a)-[:LINK]->(b)-[:LINK]->(c) RETURN COUNT(*) AS n")


@_add(
    "triples_import",
    "SELECT l_partkey AS p, count(*) AS n FROM (SELECT DISTINCT x.l_partkey, x.l_suppkey FROM lineitem x JOIN lineitem y USING (l_partkey, l_suppkey) WHERE x.l_returnflag = 'A' AND y.l_returnflag = 'R') GROUP BY l_partkey",
)
def triples_import(spark: SparkSession, folder: str) -> DataFrame:
    """N-Triples: part, return flag, supplier; pairs with both an A and an R line."""
    path = shared_folder(spark, "triples")
    lines = read_table(spark, f"{folder}/lineitem.parquet").select("l_partkey", "l_returnflag", "l_suppkey").distinct()
    iri = lambda x: F.concat(F.lit("<http://example.org/"), x, F.lit(">"))
    supplier = F.concat(F.lit("9000"), F.col("l_suppkey").cast("string"))
    lines.select(F.concat_ws(" ", iri(F.col("l_partkey").cast("string")), iri(F.col("l_returnflag")), iri(supplier), F.lit(".")).alias("value")).write.text(path)
    g = GraphSession(spark, files.graph_from_triples(spark, path))
    return g.query_sparql("PREFIX x: <http://example.org/> SELECT ?p (COUNT(*) AS ?n) WHERE { ?p x:A ?s . ?p x:R ?s } GROUP BY ?p", Mapping.of_triples())


@_add("vector_file_import", "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 5) SELECT vec_id::BIGINT AS k FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], (SELECT e FROM q)), vec_id LIMIT 10")
def vector_file_import(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of a CSV file, one row a node: its key and the numbers."""
    path = shared_folder(spark, "vectors")
    table = read_table(spark, f"{folder}/embeddings.parquet")
    dimensions = len(table.select("embedding").first()[0])
    table.select("vec_id", *[F.col("embedding")[k].cast("float").alias(f"v{k}") for k in range(dimensions)]).write.csv(path)
    graph = commerce_graph(spark, folder)
    files.vectors_from_csv(spark, graph, path, "Vec", "key", "loaded")
    return GraphSession(spark, graph).execute("MATCH (v:Vec), (w:Vec {key: 5}) NEAREST 10 v.loaded TO VECTOR(w, 'loaded') RETURN v.key AS k")


@_add(
    "store_reopen",
    "SELECT c_custkey AS c, n_name AS n, count(o_orderkey) AS orders FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey, n_name",
)
def store_reopen(spark: SparkSession, folder: str) -> DataFrame:
    """A graph saved with indexes, changed without a save, and opened anew."""
    path = shared_folder(spark, "store")
    g = GraphSession(spark, _part_of_graph(spark, folder, {"Nation", "Customer", "Order"}, {"IN_NATION", "PLACED"}), path)
    g.execute("CREATE BTREE INDEX segment ON :Customer(mktsegment)")
    g.execute("CREATE HASH INDEX status ON :Order(status)")
    g.save()
    g.execute("MATCH (c:Customer {mktsegment: 'BUILDING'}) DETACH DELETE c")
    again = GraphSession.open(spark, path)
    return again.execute("MATCH (c:Customer {mktsegment: 'BUILDING'})-[:IN_NATION]->(n:Nation) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {status: 'F'}) RETURN c.key AS c, n.name AS n, COUNT(o) AS orders GROUP BY c, n")


@_add("graph_type_rollback", "SELECT n_name AS text, true AS old FROM nation UNION ALL SELECT r_name, false FROM region")
def graph_type_rollback(spark: SparkSession, folder: str) -> DataFrame:
    """Notes under a graph type; one of a wrong kind undoes what came after the last save."""
    g = GraphSession(spark, _part_of_graph(spark, folder, {"Region", "Nation"}, set()), shared_folder(spark, "typed"))
    g.execute("CREATE GRAPH TYPE notes AS { (:Region {key INT, name STRING}), (:Nation {key INT, name STRING}), (:Note {text STRING, old BOOL}) }")
    g.execute("USE GRAPH TYPE notes")
    g.execute("MATCH (n:Nation) INSERT (:Note {text: n.name, old: true})")
    g.save()
    g.execute("MATCH (n:Nation) INSERT (:Note {text: 'undone', old: false})")
    try:
        g.execute("MATCH (r:Region) INSERT (:Note {text: r.key, old: false})")
    except GqlError as e:
        if "G2000" not in str(e):
            raise
    else:
        raise AssertionError("the graph type was not enforced")
    g.execute("MATCH (r:Region) INSERT (:Note {text: r.name, old: false})")
    return g.execute("MATCH (x:Note) RETURN x.text AS text, x.old AS old")


@_add("set_returning", "SELECT n_nationkey::BIGINT AS k, (n_nationkey * 3)::BIGINT AS s FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA'")
def set_returning(spark: SparkSession, folder: str) -> DataFrame:
    """A change that returns its rows as they are after it."""
    return GraphSession(spark, commerce_graph(spark, folder)).execute("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE r.name <> 'ASIA' SET n.triple = n.key * 3 RETURN n.key AS k, n.triple AS s")


@_add("insert_returning", "SELECT r_name AS t, (r_regionkey + 1)::BIGINT AS k FROM region")
def insert_returning(spark: SparkSession, folder: str) -> DataFrame:
    return GraphSession(spark, commerce_graph(spark, folder)).execute("MATCH (r:Region) INSERT (r)-[:HAS]->(x:Tag {of: r.name, k: r.key + 1}) RETURN x.of AS t, x.k AS k")


