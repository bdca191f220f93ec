"""Queries over the commerce graph, each with SQL that gives the same rows from the tables.

One at least for every operator family: scans, joins, label algebra, optional and existential
matches, subqueries, aggregates, sorting, quantified and searched paths, vectors, changes, SPARQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import GraphSession
from .sources.relational import commerce_graph
from .sparql import Mapping
from .workload_formats import FORMATS

#: name -> (GQL, SQL)
GQL: dict[str, tuple[str, str]] = {}


def _add(name: str, gql: str, sql: str) -> None:
    GQL[name] = (gql, sql)


_add(
    "cyclic_local_supplier",
    """MATCH (c:Customer)-[:PLACED]->(o:Order)-[:HAS_ITEM]->(l:LineItem)-[:FROM_SUPPLIER]->(s:Supplier),
             (c)-[:IN_NATION]->(n:Nation), (s)-[:IN_NATION]->(n), (n)-[:IN_REGION]->(r:Region {name: 'ASIA'})
       RETURN n.name AS nation, ROUND(SUM(l.extendedprice * (1 - l.discount))) AS revenue, COUNT(*) AS items
       GROUP BY n ORDER BY revenue DESC""",
    """SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount))) AS revenue, count(*) AS items
       FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
       JOIN nation ON n_nationkey = c_nationkey AND n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
       WHERE r_name = 'ASIA' GROUP BY n_nationkey, n_name""",
)
_add("node_scan_filter", "MATCH (o:Order) WHERE o.totalprice > 300000 AND o.status = 'F' RETURN o.key AS k, o.priority AS p", "SELECT o_orderkey AS k, o_orderpriority AS p FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
_add("prop_map_filter", "MATCH (c:Customer {mktsegment: 'BUILDING'}) RETURN c.key AS k, c.acctbal AS b", "SELECT c_custkey AS k, c_acctbal AS b FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("label_scan_count", "MATCH (l:LineItem) RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM lineitem")
_add("one_hop_count", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey")
_add("two_hop_count", "MATCH (c:Customer)-[:PLACED]->(o:Order)-[:HAS_ITEM]->(l:LineItem) RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey")
_add(
    "chain_2hop",
    "MATCH (c:Customer {mktsegment: 'BUILDING'})-[:PLACED]->(o:Order)-[:HAS_ITEM]->(l:LineItem) WHERE l.quantity > 45 RETURN c.key AS c, o.key AS o, l.linenumber AS l, l.quantity AS q",
    "SELECT c_custkey AS c, o_orderkey AS o, CAST(l_linenumber AS BIGINT) AS l, l_quantity AS q FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND l_quantity > 45",
)
_add(
    "chain_star_join",
    "MATCH (l:LineItem)-[:OF_PART]->(p:Part {brand: 'Brand#11'}), (l)-[:FROM_SUPPLIER]->(s:Supplier), (o:Order)-[:HAS_ITEM]->(l) RETURN s.key AS s, COUNT(DISTINCT o) AS orders, SUM(l.quantity) AS q GROUP BY s",
    "SELECT s_suppkey AS s, count(DISTINCT o_orderkey) AS orders, sum(l_quantity) AS q FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE p_brand = 'Brand#11' GROUP BY s_suppkey",
)
_add("left_edge", "MATCH (s:Supplier)<-[:FROM_SUPPLIER]-(l:LineItem) RETURN s.key AS s, COUNT(*) AS n GROUP BY s.key", "SELECT l_suppkey AS s, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey")
_PEER = "(SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey)"
_BOTH = f"(SELECT a, b, a * 1000 + b AS e FROM {_PEER} UNION ALL SELECT b, a, a * 1000 + b FROM {_PEER})"
_ROUTE = "(SELECT n_nationkey::BIGINT AS a, ((n_nationkey + k) % 25)::BIGINT AS b, k * 100 AS km, n_nationkey * 10 + k AS e FROM nation, (SELECT unnest([1, 2]) AS k))"
_add("undirected_hop", "MATCH (a:Nation)~[e:PEER]~(b:Nation) RETURN a.key AS a, b.key AS b, e.weight AS w", f"SELECT a::BIGINT AS a, b::BIGINT AS b, (abs(b - a))::BIGINT AS w FROM {_BOTH}")
_add("label_or", "MATCH (x:Customer|Supplier) WHERE x.acctbal > 9000 RETURN x.name AS name, x.mktsegment AS seg", "SELECT c_name AS name, c_mktsegment AS seg FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_name, NULL FROM supplier WHERE s_acctbal > 9000")
_add("label_and", "MATCH (x:Party&Supplier) WHERE x.acctbal < 0 RETURN x.name AS name", "SELECT s_name AS name FROM supplier WHERE s_acctbal < 0")
_add("label_not", "MATCH (x:Party&!Supplier) RETURN COUNT(x) AS n, MIN(x.acctbal) AS low", "SELECT count(*) AS n, min(c_acctbal) AS low FROM customer")
_add("edge_label_or", "MATCH (l:LineItem)-[:OF_PART|FROM_SUPPLIER]->(x) WHERE l.quantity = 50 RETURN x.name AS name, COUNT(*) AS n GROUP BY x.name", "SELECT name, count(*) AS n FROM (SELECT p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity = 50 UNION ALL SELECT s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity = 50) GROUP BY name")
_add("theta_pair", "MATCH (a:Supplier)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(b:Supplier) WHERE a.name < b.name RETURN n.key AS n, a.name AS a, b.name AS b", "SELECT a.s_nationkey::BIGINT AS n, a.s_name AS a, b.s_name AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_name < b.s_name")
_add("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {status: 'P'}) RETURN c.key AS c, COUNT(o) AS n GROUP BY c", "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
_add("exists_semi", "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 } RETURN c.key AS c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
_add("not_exists_anti", "MATCH (p:Part) WHERE NOT EXISTS { MATCH (p)<-[:OF_PART]-(l:LineItem) WHERE l.quantity > 40 } RETURN p.key AS p", "SELECT p_partkey AS p FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)")
_add(
    "exists_in_or",
    "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > c.acctbal * 50 } OR c.acctbal < 0 RETURN c.key AS c",
    "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 50) OR c_acctbal < 0",
)
_add(
    "value_count_zero",
    "MATCH (c:Customer) RETURN c.key AS c, VALUE { MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 450000 RETURN COUNT(o) } AS n",
    "SELECT c_custkey AS c, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) AS n FROM customer",
)
_add(
    "group_agg_all",
    "MATCH (o:Order) RETURN o.status AS s, COUNT(*) AS n, ROUND(SUM(o.totalprice)) AS total, ROUND(AVG(o.totalprice)) AS mean, MIN(o.key) AS low, MAX(o.priority) AS high GROUP BY o.status",
    "SELECT o_orderstatus AS s, count(*) AS n, round(sum(o_totalprice)) AS total, round(avg(o_totalprice)) AS mean, min(o_orderkey) AS low, max(o_orderpriority) AS high FROM orders GROUP BY o_orderstatus",
)
_add("distinct_aggs", "MATCH (l:LineItem) RETURN l.returnflag AS f, COUNT(DISTINCT l.quantity) AS nq, SUM(DISTINCT l.linenumber) AS sl, COUNT(l.tax) AS nt GROUP BY l.returnflag", "SELECT l_returnflag AS f, count(DISTINCT l_quantity) AS nq, sum(DISTINCT l_linenumber)::BIGINT AS sl, count(l_tax) AS nt FROM lineitem GROUP BY l_returnflag")
_add("collect_list_sorted", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.name AS r, CARDINALITY(COLLECT_LIST(n.name)) AS n, COLLECT_LIST(DISTINCT n.key) AS ks GROUP BY r", "SELECT r_name AS r, count(*) AS n, list(n_nationkey::BIGINT ORDER BY n_nationkey) AS ks FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
_add("agg_arith", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.mktsegment AS s, COUNT(o) + COUNT(DISTINCT c) AS n, FLOOR(MAX(o.totalprice) - MIN(o.totalprice)) AS gap GROUP BY c.mktsegment", "SELECT c_mktsegment AS s, count(*) + count(DISTINCT c_custkey) AS n, floor(max(o_totalprice) - min(o_totalprice)) AS gap FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment")
_add("group_by_var", "MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) RETURN n.name AS name, COUNT(*) AS n GROUP BY n", "SELECT n_name AS name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
_add("group_by_alias", "MATCH (c:Customer) RETURN CASE WHEN c.acctbal < 0 THEN 'debt' WHEN c.acctbal < 5000 THEN 'some' ELSE 'much' END AS class, COUNT(*) AS n GROUP BY class", "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS class, count(*) AS n FROM customer GROUP BY 1")
_add("empty_agg", "MATCH (c:Customer {mktsegment: 'NONE'}) RETURN COUNT(c) AS n, SUM(c.acctbal) AS s, MAX(c.name) AS m", "SELECT count(*) AS n, sum(c_acctbal) AS s, max(c_name) AS m FROM customer WHERE c_mktsegment = 'NONE'")
_add("order_nulls_topk", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 480000 RETURN c.key AS c, o.key AS o ORDER BY o.totalprice DESC NULLS LAST, c.key LIMIT 25", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 480000 ORDER BY o_totalprice DESC NULLS LAST, c_custkey LIMIT 25")
_add("distinct_rows", "MATCH (l:LineItem) RETURN DISTINCT l.returnflag AS f, l.linestatus AS s ORDER BY f, s", "SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem")
_add(
    "repeat_bounded",
    "MATCH (a:Nation)-[:ROUTE]->{1,3}(b:Nation) RETURN a.key AS a, b.key AS b, COUNT(*) AS n GROUP BY a.key, b.key",
    f"WITH r AS (SELECT a, b FROM {_ROUTE}) SELECT a, b, count(*) AS n FROM (SELECT a, b FROM r UNION ALL SELECT x.a, y.b FROM r x JOIN r y ON x.b = y.a UNION ALL SELECT x.a, z.b FROM r x JOIN r y ON x.b = y.a JOIN r z ON y.b = z.a) GROUP BY a, b",
)
_WALK = f"""WITH RECURSIVE e AS (SELECT a, b, e FROM {_BOTH}), w AS (
      SELECT a AS s, a AS t, [a] AS ns, []::BIGINT[] AS es, 0 AS len FROM (SELECT n_nationkey AS a FROM nation)
      UNION ALL SELECT s, e.b, list_append(ns, e.b), list_append(es, e.e::BIGINT), len + 1 FROM w JOIN e ON w.t = e.a WHERE %s)"""
_add("trail_paths", "MATCH TRAIL (a:Nation)~[:PEER]~{1,4}(b:Nation) RETURN a.key AS a, b.key AS b, COUNT(*) AS n GROUP BY a.key, b.key", _WALK % "len < 4 AND NOT list_contains(es, e.e)" + " SELECT s::BIGINT AS a, t::BIGINT AS b, count(*) AS n FROM w WHERE len > 0 GROUP BY s, t")
_add("acyclic_paths", "MATCH ACYCLIC (a:Nation)~[:PEER]~+(b:Nation) RETURN a.key AS a, COUNT(*) AS n GROUP BY a.key", _WALK % "NOT list_contains(ns, e.b)" + " SELECT s::BIGINT AS a, count(*) AS n FROM w WHERE len > 0 GROUP BY s")
_DIST = f"""WITH RECURSIVE e AS (SELECT a, b FROM {_ROUTE}), d AS (SELECT n_nationkey::BIGINT AS s, n_nationkey::BIGINT AS t, 0::BIGINT AS len, 1::BIGINT AS ways FROM nation
      UNION ALL SELECT s, t, len, sum(ways)::BIGINT FROM (SELECT s, e.b AS t, len + 1 AS len, ways FROM d JOIN e ON d.t = e.a WHERE len < 14) GROUP BY s, t, len)"""
_add("triangle_count", "MATCH (a:Nation)-[:ROUTE]->(b:Nation)-[:ROUTE]->(c:Nation), (a)-[:ROUTE]->(c) RETURN COUNT(*) AS n", f"WITH r AS (SELECT a, b FROM {_ROUTE}) SELECT count(*) AS n FROM r x JOIN r y ON x.b = y.a JOIN r z ON z.a = x.a AND z.b = y.b")
_add("four_clique_undirected", "MATCH (a:Nation)~[:PEER]~(b:Nation)~[:PEER]~(c:Nation)~[:PEER]~(d:Nation), (a)~[:PEER]~(c), (a)~[:PEER]~(d), (b)~[:PEER]~(d) RETURN COUNT(*) AS n", f"WITH r AS (SELECT a, b FROM {_BOTH}) SELECT count(*) AS n FROM r ab JOIN r bc ON ab.b = bc.a JOIN r cd ON bc.b = cd.a JOIN r ac ON ac.a = ab.a AND ac.b = bc.b JOIN r ad ON ad.a = ab.a AND ad.b = cd.b JOIN r bd ON bd.a = ab.b AND bd.b = cd.b")
_add(
    "scalar_math",
    "MATCH (c:Customer) RETURN c.key AS k, FLOOR(c.acctbal) AS f, CEIL(c.acctbal) AS ce, ROUND(SQRT(ABS(c.acctbal)) * 100) AS s, SIGN(c.acctbal) AS sg, ROUND(LN(ABS(c.acctbal) + 1) * 1000) AS l, ROUND(POW(c.acctbal / 1000, 2) * 100) AS p, SQRT(0 - c.key - 1) AS bad",
    "SELECT c_custkey AS k, floor(c_acctbal) AS f, ceil(c_acctbal) AS ce, round(sqrt(abs(c_acctbal)) * 100) AS s, sign(c_acctbal)::DOUBLE AS sg, round(ln(abs(c_acctbal) + 1) * 1000) AS l, round(pow(c_acctbal / 1000, 2) * 100) AS p, NULL::DOUBLE AS bad FROM customer",
)
_add("int_div_mod", "MATCH (p:Part) RETURN p.key AS k, p.size / 7 AS d, (0 - p.size) / 7 AS nd, MOD(p.size, 7) AS m, p.size / 0 AS z, p.size / 2.0 AS h", "SELECT p_partkey AS k, (p_size // 7)::BIGINT AS d, -(p_size // 7)::BIGINT AS nd, (p_size % 7)::BIGINT AS m, NULL::BIGINT AS z, p_size / 2.0::DOUBLE AS h FROM part")
_add("cast_case_coalesce", "MATCH (x:Party) RETURN x.name AS name, COALESCE(x.mktsegment, 'none') AS seg, CAST(x.acctbal AS INTEGER) AS i, CASE WHEN x.mktsegment IS NULL THEN 1 ELSE 0 END AS c, CAST('7' AS INTEGER) + 1 AS e", "SELECT c_name AS name, c_mktsegment AS seg, trunc(c_acctbal)::BIGINT AS i, 0::BIGINT AS c, 8::BIGINT AS e FROM customer UNION ALL SELECT s_name, 'none', trunc(s_acctbal)::BIGINT, 1, 8 FROM supplier")
_add("temporal_ms", "MATCH (o:Order) WHERE o.orderdate >= LOCAL_DATETIME('1995-01-01T00:00:00') AND o.orderdate < LOCAL_DATETIME('1995-01-01T00:00:00') + DURATION({days: 31}) RETURN o.key AS k", "SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-02-01'")
_add("in_list_3vl", "MATCH (x:Party) WHERE NOT (x.mktsegment IN ['BUILDING', 'MACHINERY']) RETURN x.name AS name", "SELECT c_name AS name FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
_add("type_test", "MATCH (x:Region|Nation|Vec) WHERE x.name IS STRING AND x.key IS INTEGER RETURN COUNT(*) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS n")
_VEC = "list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 5))"
_add("nearest_topk", "MATCH (v:Vec), (w:Vec {key: 5}) NEAREST 10 v.emb TO VECTOR(w, 'emb') AS d RETURN v.key AS k, ROUND(d * 10000) AS d", f"SELECT vec_id::BIGINT AS k, round(pow({_VEC}, 2) * 10000) AS d FROM embeddings ORDER BY {_VEC}, vec_id LIMIT 10")
_add("nearest_in_pattern", "MATCH (v:Vec {label: 3}), (w:Vec {key: 5}) NEAREST 7 v.emb TO VECTOR(w, 'emb') RETURN v.key AS k", f"SELECT vec_id::BIGINT AS k FROM embeddings WHERE label = 3 ORDER BY {_VEC}, vec_id LIMIT 7")
_add("nearest_per_anchor", "MATCH (w:Vec {label: 1}), (v:Vec {label: 2}) NEAREST 2 v.emb TO VECTOR(w, 'emb') RETURN w.key AS w, v.key AS v", "SELECT w, v FROM (SELECT a.vec_id::BIGINT AS w, b.vec_id::BIGINT AS v, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.label = 1 AND b.label = 2) WHERE r <= 2")
_add("events_per_customer", "MATCH (c:Customer)-[:DID]->(e:Event) RETURN c.mktsegment AS s, e.type AS t, COUNT(*) AS n, ROUND(SUM(e.value)) AS v GROUP BY c.mktsegment, e.type", "SELECT c_mktsegment AS s, event_type AS t, count(*) AS n, round(sum(value)) AS v FROM events JOIN customer ON c_custkey = user_id GROUP BY 1, 2")

_add("cartesian", "MATCH (r:Region), (n:Nation) RETURN r.name AS r, n.name AS n", "SELECT r_name AS r, n_name AS n FROM region, nation")
_add(
    "optional_correlated",
    "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > c.acctbal * 60 RETURN c.key AS c, o.key AS o",
    "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 60",
)
_add(
    "value_argmax",
    "MATCH (c:Customer) RETURN c.key AS c, VALUE { MATCH (c)-[:PLACED]->(o:Order) RETURN o.key ORDER BY o.totalprice DESC, o.key LIMIT 1 } AS best",
    """SELECT c_custkey AS c, o_orderkey AS best
       FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) ON o_custkey = c_custkey AND r = 1""",
)
_add("shortest_len", "MATCH p = ANY SHORTEST (a:Nation)-[:ROUTE]->+(b:Nation) RETURN a.key AS a, b.key AS b, PATH_LENGTH(p) AS len", _DIST + " SELECT s AS a, t AS b, min(len)::BIGINT AS len FROM d WHERE len > 0 GROUP BY s, t")
_add(
    "shortest_k_groups",
    "MATCH p = SHORTEST 2 GROUPS (a:Nation)-[:ROUTE]->*(b:Nation) RETURN a.key AS a, b.key AS b, PATH_LENGTH(p) AS len, COUNT(*) AS n GROUP BY a.key, b.key, len",
    _DIST + " SELECT s AS a, t AS b, len, ways AS n FROM (SELECT s, t, len, ways, dense_rank() OVER (PARTITION BY s, t ORDER BY len) AS r FROM d) WHERE r <= 2",
)
_add(
    "shortest_k_paths",
    "MATCH p = SHORTEST 3 (a:Nation)-[:ROUTE]->*(b:Nation) RETURN a.key AS a, b.key AS b, COUNT(*) AS n, MIN(PATH_LENGTH(p)) AS low GROUP BY a.key, b.key",
    _DIST + " SELECT s AS a, t AS b, least(3, sum(ways))::BIGINT AS n, min(len)::BIGINT AS low FROM d GROUP BY s, t",
)
_add(
    "any_direction_hop",
    "MATCH (a:Nation)-[]-(b) RETURN a.key AS a, b.name AS name",
    f"""SELECT n_nationkey::BIGINT AS a, r_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey
        UNION ALL SELECT c_nationkey, c_name FROM customer UNION ALL SELECT s_nationkey, s_name FROM supplier
        UNION ALL SELECT a, n_name FROM {_BOTH} JOIN nation ON n_nationkey = b
        UNION ALL SELECT a, n_name FROM {_ROUTE} JOIN nation ON n_nationkey = b
        UNION ALL SELECT b, n_name FROM {_ROUTE} JOIN nation ON n_nationkey = a""",
)
_add(
    "path_union_bag",
    "MATCH (n:Nation)<-[:IN_NATION]-(x:Customer) | (n:Nation)<-[:IN_NATION]-(x:Supplier) | (n:Nation)-[:IN_REGION]->(x:Region) RETURN n.key AS n, x.name AS name",
    "SELECT c_nationkey::BIGINT AS n, c_name AS name FROM customer UNION ALL SELECT s_nationkey, s_name FROM supplier UNION ALL SELECT n_nationkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey",
)
_add(
    "repeat_group_sum",
    "MATCH (a:Nation)-[e:ROUTE]->{2,3}(b:Nation) RETURN a.key AS a, b.key AS b, SUM(e.km) AS km, COUNT(e) AS n, MAX(e.km) AS longest",
    f"WITH r AS (SELECT a, b, km FROM {_ROUTE}) SELECT x.a AS a, y.b AS b, (x.km + y.km)::BIGINT AS km, 2::BIGINT AS n, greatest(x.km, y.km)::BIGINT AS longest FROM r x JOIN r y ON x.b = y.a UNION ALL SELECT x.a, z.b, (x.km + y.km + z.km)::BIGINT, 3, greatest(x.km, y.km, z.km)::BIGINT FROM r x JOIN r y ON x.b = y.a JOIN r z ON y.b = z.a",
)
_add("simple_cycles", "MATCH SIMPLE (a:Nation)~[:PEER]~*(a) RETURN a.key AS a, COUNT(*) AS n GROUP BY a.key", _WALK % "(len = 0 OR t <> s) AND (e.b = s OR NOT list_contains(ns, e.b))" + " SELECT s::BIGINT AS a, count(*) AS n FROM w WHERE s = t GROUP BY s")
_add("all_shortest_count", "MATCH p = ALL SHORTEST (a:Nation)-[:ROUTE]->*(b:Nation) RETURN a.key AS a, b.key AS b, PATH_LENGTH(p) AS len, COUNT(*) AS n GROUP BY a.key, b.key, len", _DIST + " SELECT s AS a, t AS b, min(len)::BIGINT AS len, arg_min(ways, len)::BIGINT AS n FROM d GROUP BY s, t")
_add("path_functions", "MATCH p = (a:Nation)-[e:ROUTE]->{2}(b:Nation) RETURN a.key AS a, b.key AS b, PATH_LENGTH(p) AS len, CARDINALITY(p) AS n, CARDINALITY(NODES(p)) AS nn, CARDINALITY(EDGES(p)) AS ne, CARDINALITY(ELEMENTS(p)) AS el, [x IN NODES(p) | x.key] AS ks", f"WITH r AS (SELECT a, b FROM {_ROUTE}) SELECT x.a AS a, y.b AS b, 2::BIGINT AS len, 5::BIGINT AS n, 3::BIGINT AS nn, 2::BIGINT AS ne, 5::BIGINT AS el, [x.a, x.b, y.b] AS ks FROM r x JOIN r y ON x.b = y.a")
_add("questioned", "MATCH (a:Nation)(-[:IN_REGION]->(x:Region))?(b) RETURN a.key AS a, b.name AS b, x.name AS x", "SELECT n_nationkey::BIGINT AS a, n_name AS b, NULL AS x FROM nation UNION ALL SELECT n_nationkey, r_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
_add("list_comprehension", "MATCH (a:Nation)-[e:ROUTE]->{3}(b:Nation) RETURN a.key AS a, b.key AS b, [k IN e.km WHERE k > 100 | k / 100] AS ks", f"WITH r AS (SELECT a, b, km FROM {_ROUTE}) SELECT x.a AS a, z.b AS b, list_transform(list_filter([x.km, y.km, z.km], lambda k: k > 100), lambda k: (k // 100)::BIGINT) AS ks FROM r x JOIN r y ON x.b = y.a JOIN r z ON y.b = z.a")
# a search with both ends fixed, over parts that are in an order together: the graph grows with the tables
_TOGETHER = "(SELECT DISTINCT l.l_partkey AS a, m.l_partkey AS b FROM lineitem l JOIN lineitem m ON m.l_orderkey = l.l_orderkey)"
_add(
    "shortest_pinned",
    "MATCH p = ANY SHORTEST (a:Part {key: 1})((:Part)<-[:OF_PART]-(:LineItem)<-[:HAS_ITEM]-(:Order)-[:HAS_ITEM]->(:LineItem)-[:OF_PART]->(:Part))+(b:Part) WHERE b.key = 2 RETURN a.key AS a, b.key AS b, PATH_LENGTH(p) AS len",
    f"""WITH RECURSIVE e AS (SELECT a, b FROM {_TOGETHER}), d AS (SELECT b AS t, 1 AS len FROM e WHERE a = 1 UNION SELECT e.b, len + 1 FROM d JOIN e ON d.t = e.a WHERE len < 4)
        SELECT 1::BIGINT AS a, t AS b, (4 * min(len))::BIGINT AS len FROM d WHERE t = 2 GROUP BY t""",
)
_add("any_two_paths", "MATCH ANY 2 (a:Nation)-[:ROUTE]->{1,3}(b:Nation) RETURN a.key AS a, b.key AS b, COUNT(*) AS n GROUP BY a.key, b.key", f"WITH r AS (SELECT a, b FROM {_ROUTE}) SELECT a, b, least(count(*), 2) AS n FROM (SELECT a, b FROM r UNION ALL SELECT x.a, y.b FROM r x JOIN r y ON x.b = y.a UNION ALL SELECT x.a, z.b FROM r x JOIN r y ON x.b = y.a JOIN r z ON y.b = z.a) GROUP BY a, b")
_add(
    "optional_exists_outer",
    "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE EXISTS { MATCH (o)-[:HAS_ITEM]->(l:LineItem) WHERE l.extendedprice > c.acctbal * 10 } RETURN c.key AS c, o.key AS o",
    "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN (SELECT DISTINCT o_orderkey, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_extendedprice > c_acctbal * 10) ON o_custkey = c_custkey",
)
_add(
    "scalar_angles",
    "MATCH (c:Customer) RETURN c.key AS k, ROUND(SIN(c.acctbal) * 1000000) AS s, ROUND(COS(c.acctbal) * 1000000) AS co, ROUND(TAN(c.acctbal / 10000) * 1000000) AS t, ROUND(RADIANS(c.key) * 1000000) AS r, ROUND(DEGREES(c.acctbal / 1000) * 1000) AS d, ROUND(EXP(c.acctbal / 10000) * 1000000) AS e, ROUND(LOG(2, c.key) * 1000000) AS l, -c.key AS neg",
    "SELECT c_custkey AS k, round(sin(c_acctbal) * 1000000) AS s, round(cos(c_acctbal) * 1000000) AS co, round(tan(c_acctbal / 10000) * 1000000) AS t, round(radians(c_custkey) * 1000000) AS r, round(degrees(c_acctbal / 1000) * 1000) AS d, round(exp(c_acctbal / 10000) * 1000000) AS e, CASE WHEN c_custkey > 0 THEN round(ln(c_custkey) / ln(2) * 1000000) END AS l, -c_custkey AS neg FROM customer",
)
_add("date_compare", "MATCH (o:Order) WHERE DATE('1996-02-29') > DATE('1996-02-28') AND o.orderdate < LOCAL_DATETIME('1992-03-01T00:00:00') RETURN o.key AS k", "SELECT o_orderkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1992-03-01'")
_add("cosine_topk", "MATCH (v:Vec), (w:Vec {key: 5}) NEAREST 10 v.emb_cos TO VECTOR(w, 'emb_cos') AS d RETURN v.key AS k, ROUND(d * 100000) AS d", "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 5), d AS (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)) AS d FROM embeddings) SELECT vec_id::BIGINT AS k, round(d * 100000) AS d FROM d ORDER BY d.d, vec_id LIMIT 10")
_add("inner_product_topk", "MATCH (v:Vec), (w:Vec {key: 5}) NEAREST 10 v.emb_ip TO VECTOR(w, 'emb_ip') AS d RETURN v.key AS k, ROUND(d * 100000) AS d", "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 5), d AS (SELECT vec_id, -list_inner_product(embedding::DOUBLE[], (SELECT e FROM q)) AS d FROM embeddings) SELECT vec_id::BIGINT AS k, round(d * 100000) AS d FROM d ORDER BY d.d, vec_id LIMIT 10")
_add("zero_laps", "MATCH (a:Nation)-[:ROUTE]->{0,1}(b:Nation) RETURN a.key AS a, b.key AS b", f"SELECT n_nationkey::BIGINT AS a, n_nationkey::BIGINT AS b FROM nation UNION ALL SELECT a, b FROM {_ROUTE}")
_add("exists_uncorrelated", "MATCH (r:Region) WHERE EXISTS { MATCH (o:Order) WHERE o.totalprice > 400000 } AND NOT EXISTS { MATCH (o:Order) WHERE o.totalprice < 0 } RETURN r.name AS r", "SELECT r_name AS r FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 400000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0)")
_add("record_fields", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.name AS r, CARDINALITY([x IN COLLECT_LIST(RECORD {k: n.key, s: n.name}) WHERE x.k > 10 | x.s]) AS big GROUP BY r", "SELECT r_name AS r, count(*) FILTER (n_nationkey > 10) AS big FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
_add("value_as_type", "MATCH (x:Region|Nation|Vec) RETURN x.key AS k, (x.name AS STRING) AS s, (x.key AS INTEGER) AS i, (x.name AS INTEGER) IS NULL AS no", "SELECT r_regionkey::BIGINT AS k, r_name AS s, r_regionkey::BIGINT AS i, true AS no FROM region UNION ALL SELECT n_nationkey, n_name, n_nationkey, true FROM nation UNION ALL SELECT vec_id, NULL, vec_id, true FROM embeddings")
_add("comments", "MATCH (c:Customer) /* every\n one */ WHERE c.acctbal > 9000 -- rich\n RETURN c.key AS c ORDER BY c LIMIT 40", "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 9000 ORDER BY c_custkey LIMIT 40")
_add("nearest_rows", "MATCH (v:Vec {label: 3}), (r:Region), (w:Vec {key: 5}) NEAREST 12 ROWS v.emb TO VECTOR(w, 'emb') RETURN v.key AS k, COUNT(*) AS n GROUP BY v", f"SELECT k, count(*) AS n FROM (SELECT vec_id::BIGINT AS k FROM embeddings, region WHERE label = 3 ORDER BY {_VEC}, vec_id LIMIT 12) GROUP BY k")
_add("nearest_then_limit", "MATCH (v:Vec), (w:Vec {key: 5}) NEAREST 10 v.emb TO VECTOR(w, 'emb') AS d RETURN v.key AS k ORDER BY d DESC, k LIMIT 3", f"SELECT k FROM (SELECT vec_id::BIGINT AS k, {_VEC} AS d FROM embeddings ORDER BY d, vec_id LIMIT 10) ORDER BY d DESC, k LIMIT 3")


#: name -> (statements, final query, SQL of the state after them)
CHANGES: dict[str, tuple[list[str], str, str]] = {
    "insert_then_match": (
        ["INSERT (:Note {text: 'new', size: 1})", "MATCH (n:Nation)-[:IN_REGION]->(r:Region {name: 'EUROPE'}) INSERT (n)-[:HAS_NOTE {at: n.key * 2}]->(:Note {text: n.name})"],
        "MATCH (x:Note) OPTIONAL MATCH (n:Nation)-[h:HAS_NOTE]->(x) RETURN x.text AS text, x.size AS size, n.key AS n, h.at AS at",
        "SELECT 'new' AS text, 1::BIGINT AS size, NULL::BIGINT AS n, NULL::BIGINT AS at UNION ALL SELECT n_name, NULL, n_nationkey, n_nationkey * 2 FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE'",
    ),
    "set_remove": (
        ["MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) WHERE s.acctbal < 5000 SET n.risk = 1, n:Risky", "MATCH (n:Nation) WHERE n.key > 20 REMOVE n.name"],
        "MATCH (n:Nation) RETURN n.key AS k, n.name AS name, n.risk AS risk, EXISTS { MATCH (n:Risky) } AS flag",
        """SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey <= 20 THEN n_name END AS name, CASE WHEN bad THEN 1::BIGINT END AS risk, bad AS flag
           FROM (SELECT *, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 5000) AS bad FROM nation)""",
    ),
    "detach_delete": (
        ["MATCH (n:Nation) WHERE MOD(n.key, 2) = 0 DETACH DELETE n"],
        "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN n.key AS k, COUNT(c) AS n GROUP BY n",
        "SELECT n_nationkey::BIGINT AS k, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 1 GROUP BY n_nationkey",
    ),
}

#: name -> (SPARQL, SQL)
SPARQL: dict[str, tuple[str, str]] = {
    "sparql_bgp": (
        "SELECT ?c ?n WHERE { ?c a <Customer> . ?c <IN_NATION> ?nat . ?nat <IN_REGION> ?r . ?c <acctbal> ?b . ?nat <name> ?n . ?r <name> 'ASIA' FILTER(?b > 9000) }",
        "SELECT c_custkey AS c, n_name AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' AND c_acctbal > 9000",
    ),
    "sparql_optional_filter": (
        "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?c a <Customer> OPTIONAL { ?c <PLACED> ?o . ?o <totalprice> ?t FILTER(?t > 450000 || ?t < 5000) } } GROUP BY ?c ORDER BY DESC(?n) ?c",
        "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND (o_totalprice > 450000 OR o_totalprice < 5000) GROUP BY c_custkey",
    ),
    "sparql_property_path": (
        "SELECT DISTINCT ?b WHERE { ?a <name> 'NATION_3' . ?a a <Nation> . ?a <ROUTE>/^<ROUTE> ?b }",
        f"SELECT DISTINCT y.a AS b FROM {_ROUTE} x JOIN {_ROUTE} y ON x.b = y.b WHERE x.a = 3",
    ),
    "sparql_closure": (
        "SELECT ?n (COUNT(*) AS ?reached) WHERE { ?a a <Nation> . ?a <ROUTE>+ ?b . ?a <name> ?n } GROUP BY ?n",
        f"WITH RECURSIVE r AS (SELECT a, b FROM {_ROUTE} UNION SELECT r.a, x.b FROM r JOIN {_ROUTE} x ON x.a = r.b) SELECT n_name AS n, count(*) AS reached FROM r JOIN nation ON n_nationkey = a GROUP BY n_name",
    ),
}


def _changed(statements: list[str], final: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        session = GraphSession(spark, commerce_graph(spark, folder))
        for s in statements:
            session.execute(s)
        return session.execute(final)

    return run


def _sparql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        properties = frozenset(("name", "acctbal", "totalprice", "mktsegment", "status"))
        return GraphSession(spark, commerce_graph(spark, folder)).query_sparql(text, Mapping(True, "key", True, None, properties))

    return run


def _query(gql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: GraphSession(spark, commerce_graph(spark, folder)).execute(gql)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(gql) for name, (gql, _) in GQL.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in GQL.items()}
QUERIES |= {name: _changed(statements, final) for name, (statements, final, _) in CHANGES.items()} | {name: _sparql(text) for name, (text, _) in SPARQL.items()}
ORACLE_SQL |= {name: sql for name, (_, _, sql) in CHANGES.items()} | {name: sql for name, (_, sql) in SPARQL.items()}
QUERIES |= {name: query for name, (query, _) in FORMATS.items()}
ORACLE_SQL |= {name: sql for name, (_, sql) in FORMATS.items()}


def nearest_approximate(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors by way of an approximate index; SQL gives the exact ones, so there is none."""
    session = GraphSession(spark, commerce_graph(spark, folder))
    session.index_vectors("emb")
    return session.execute("MATCH (v:Vec), (w:Vec {key: 5}) NEAREST 10 v.emb TO VECTOR(w, 'emb') AS d RETURN v.key AS k, d AS d")


QUERIES["nearest_approximate"] = nearest_approximate
