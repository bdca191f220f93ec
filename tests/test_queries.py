import pytest
from graphs import CHAIN, DIAMOND, FRAUD, MULTI, PEOPLE, ROUTES, SOCIAL, TRIANGLE, edge, node, ordered, rows, session

from loomgraph.lang.lexer import GqlError


@pytest.fixture(scope="module")
def g(spark):
    return {n: session(spark, *x) for n, x in {"fraud": FRAUD, "multi": MULTI, "routes": ROUTES, "diamond": DIAMOND, "triangle": TRIANGLE, "chain": CHAIN, "social": SOCIAL, "people": PEOPLE}.items()}


@pytest.mark.parametrize(
    ("graph", "text", "want"),
    [
        # bags, self-loops and directions
        ("multi", "MATCH (x)-[:R]->(y) RETURN x.id AS x, y.id AS y", [(0, 1), (0, 1), (1, 2), (2, 2)]),
        ("multi", "MATCH (x)-[:R]-(y) RETURN COUNT(*) AS n", [(8,)]),
        ("multi", "MATCH (x)-[]->(x) RETURN x.id AS x", [(2,)]),
        ("multi", "MATCH (x {id: 0})-[:R|S]->(y)-[:R]->(z) RETURN z.id AS z", [(2,), (2,), (2,)]),
        ("multi", "MATCH (x)-[e:R]->(y), (x)-[f:R]->(y) WHERE e <> f RETURN COUNT(*) AS n", [(2,)]),
        ("multi", "MATCH (x {id: 3}), (y:N) RETURN COUNT(*) AS n", [(4,)]),
        # labels
        ("social", "MATCH (x:Person&!Student) RETURN x.name AS n", [("Ada",)]),
        ("social", "MATCH (x:!Person) RETURN x.content AS c", [("hi",)]),
        ("social", "MATCH (a)~[:Knows]~(b) RETURN a.name AS a, b.name AS b", [("Ada", "Ben"), ("Ben", "Ada")]),
        ("social", "MATCH (x) WHERE x.status = 'active' RETURN x.name AS n", [("Ada",)]),
        ("social", "MATCH (x) WHERE x.status IS INTEGER RETURN x.name AS n", [("Ben",)]),
        ("social", "MATCH (x {status bool}) RETURN x.content AS c", [("hi",)]),
        ("social", "MATCH (x:Nothing) RETURN COUNT(*) AS n", [(0,)]),
        # named paths, modes and searches
        ("fraud", "MATCH p = TRAIL (x {owner: 'Jon'})-[t:Transfer]->+(x) RETURN PATH_LENGTH(p) AS l, SUM(t.amount) AS a", [(4, 11000000)]),
        ("triangle", "MATCH TRAIL (a {name: 'X'})-[:R]->*(b) RETURN b.name AS b", [("X",), ("X",), ("Y",), ("Z",)]),
        ("triangle", "MATCH SIMPLE (a {name: 'X'})-[:R]->*(b) RETURN b.name AS b", [("X",), ("X",), ("Y",), ("Z",)]),
        ("triangle", "MATCH ACYCLIC (a {name: 'X'})-[:R]->*(b) RETURN b.name AS b", [("X",), ("Y",), ("Z",)]),
        ("triangle", "MATCH WALK (a {name: 'X'})-[:R]->{4}(b) RETURN b.name AS b", [("Y",)]),
        ("routes", "MATCH p = ANY SHORTEST (a {name: 'A'})-[:R]->*(b {name: 'D'}) RETURN PATH_LENGTH(p) AS l", [(2,)]),
        ("routes", "MATCH p = SHORTEST 2 (a {name: 'A'})-[:R]->*(b {name: 'D'}) RETURN PATH_LENGTH(p) AS l", [(2,), (3,)]),
        ("diamond", "MATCH p = ALL SHORTEST (a {name: 'A'})-[:R]->*(b {name: 'D'}) RETURN PATH_LENGTH(p) AS l", [(2,), (2,)]),
        ("diamond", "MATCH p = SHORTEST 2 GROUPS (a {name: 'A'})-[:R]->*(b {name: 'D'}) RETURN PATH_LENGTH(p) AS l", [(2,), (2,), (3,)]),
        ("diamond", "MATCH p = ANY 2 (a {name: 'A'})-[:R]->{1,3}(b {name: 'D'}) RETURN COUNT(*) AS n", [(2,)]),
        ("diamond", "MATCH p = (a {name: 'A'})-[:R]->(x)-[:R]->(b {name: 'D'}) RETURN [n IN NODES(p) | n.name] AS ns", [(["A", "B", "D"],), (["A", "C", "D"],)]),
        ("triangle", "MATCH (a {name: 'X'})-[:R]->{3,2}(b) RETURN COUNT(*) AS n", [(0,)]),
        # group variables
        ("chain", "MATCH (a {name: 'a'})-[e:R]->{0,2}(b) RETURN b.name AS b, SUM(e.p) AS s, COUNT(e) AS n, e.p AS ps", [("a", None, 0, []), ("b", 1, 1, [1]), ("c", 3, 2, [1, 2])]),
        ("chain", "MATCH (a {name: 'a'})((x)-[:R]->(y)){2}(b) RETURN x.name AS xs, y.name AS ys", [(["a", "b"], ["b", "c"])]),
        ("chain", "MATCH (a {name: 'a'})(-[:R]->(x))?(b) RETURN b.name AS b, x.name AS x", [("a", None), ("b", "b")]),
        # optional and existential
        ("chain", "MATCH (a:N) OPTIONAL MATCH (a)-[e:R]->(b) RETURN a.name AS a, b.name AS b, e.p AS p", [("a", "b", 1), ("b", "c", 2), ("c", None, None)]),
        ("chain", "MATCH (a:N) OPTIONAL MATCH (a)-[:R]->(b) MATCH (b)-[:R]->(c) RETURN a.name AS a, c.name AS c", [("a", "c")]),
        ("chain", "MATCH (a:N) WHERE NOT EXISTS { MATCH (a)-[:R]->() } RETURN a.name AS a", [("c",)]),
        ("chain", "MATCH (a:N) WHERE EXISTS { MATCH (x)-[e:R]->(a) WHERE e.p > 1 } OR a.name = 'a' RETURN a.name AS a", [("a",), ("c",)]),
        ("chain", "MATCH (a:N) WHERE EXISTS { MATCH (x)-[e:R]->(y) WHERE y.name > a.name } RETURN a.name AS a", [("a",), ("b",)]),
        ("chain", "MATCH (a:N) RETURN a.name AS a, VALUE { MATCH (a)-[e:R]->(b) RETURN COUNT(e) } AS n, VALUE { MATCH (a)-[e:R]->(b) RETURN b.name LIMIT 1 } AS b", [("a", 1, "b"), ("b", 1, "c"), ("c", 0, None)]),
        ("chain", "MATCH p = ALL SHORTEST (a {name: 'a'})-[:R]->*(b {name: 'c'}) RETURN [x IN NODES(p) | x.name] AS ns, SUM(VALUE { MATCH (x)-[e:R]->(y) WHERE x IN NODES(p) AND y IN NODES(p) RETURN COUNT(e) * 1.5 }) AS w GROUP BY p", [(["a", "b", "c"], 3.0)]),
        ("chain", "MATCH (a {name: 'a'}) MATCH p = ANY SHORTEST (a)-[:R]->{1,3}(b) WHERE a <> b RETURN b.name AS b, PATH_LENGTH(p) AS l", [("b", 1), ("c", 2)]),
        ("chain", "MATCH (a:N) RETURN a.name AS a, VALUE { MATCH (a)-[e:R]->(b) RETURN RECORD {n: b.name, p: e.p} AS r ORDER BY r.p DESC LIMIT 1 } AS r ORDER BY r.p DESC, a LIMIT 2", [("a", ("b", 1)), ("b", ("c", 2))]),
        # three-valued logic and failures
        ("people", "MATCH (x) WHERE x.age > 26 RETURN x.name AS n", [("ann",), ("dan",)]),
        ("people", "MATCH (x) WHERE NOT (x.age > 26) RETURN x.name AS n", [("bob",)]),
        ("people", "MATCH (x) WHERE x.age = 'a' OR true RETURN x.name AS n", []),
        ("people", "MATCH (x) WHERE x.age > 26 OR true RETURN COUNT(*) AS n", [(4,)]),
        ("people", "MATCH (x {name: 'ann'}) RETURN x.age / 0 AS z, x.age / 4 AS q, x.score / 0 AS inf, (x.age / 0) IS NULL AS f, COALESCE(x.age / 0, 7) AS c", [(None, 7, float("inf"), True, 7)]),
        ("people", "MATCH (x {name: 'dan'}) RETURN ROUND(x.score) AS r, ABS(x.score) AS a, SIGN(x.score) AS s, FLOOR(x.score) AS f, CAST(x.score AS INTEGER) AS i, SQRT(x.score) AS bad", [(-3.0, 2.5, -1.0, -3.0, -2, None)]),
        ("people", "MATCH (x {name: 'ann'}) RETURN CASE WHEN x.none = 1 THEN 'a' WHEN x.age = 30 THEN 'b' ELSE 'c' END AS c", [("b",)]),
        ("people", "MATCH (x {name: 'ann'}) WHERE x.age IN [1, null, 30] RETURN x.name AS n", [("ann",)]),
        ("people", "MATCH (x {name: 'ann'}) WHERE NOT (x.age IN [1, null]) RETURN x.name AS n", []),
        ("people", "MATCH (x {name: 'ann'}) RETURN RECORD {b: x.age, a: x.none} AS r", [((None, 30),)]),
        ("people", "MATCH (x {name: 'ann'}) RETURN DATE('2024-02-30') AS d, DATE('2024-02-29') < DATE('2024-03-01') AS lt, DURATION({days: 1, hours: 2}) AS ms", [(None, True, 93600000)]),
        # aggregates
        ("people", "MATCH (x) RETURN COUNT(*) AS n, COUNT(x.age) AS a, COUNT(DISTINCT x.age) AS d, SUM(x.age) AS s, AVG(x.age) AS m, MIN(x.name) AS lo, COLLECT_LIST(DISTINCT x.age) AS l", [(4, 3, 2, 85, 85 / 3, "ann", [25, 30])]),
        ("people", "MATCH (x {name: 'zed'}) RETURN COUNT(x) AS n, SUM(x.age) AS s, COLLECT_LIST(x.age) AS l", [(0, None, [])]),
        ("people", "MATCH (x {name: 'zed'}) RETURN x.name AS n, COUNT(*) AS c GROUP BY x.name", []),
        ("people", "MATCH (x) RETURN x.age AS a, COUNT(*) + 1 AS c GROUP BY a", [(25, 2), (30, 3), (None, 2)]),
        ("people", "MATCH (x) RETURN DISTINCT x.age AS a", [(25,), (30,), (None,)]),
        ("fraud", "MATCH (x)-[t:Transfer]->(y) RETURN COLLECT_LIST(RECORD {o: y.nothing}) AS l", [([],)]),
    ],
)
def test_rows(g, graph, text, want):
    assert rows(g[graph], text) == sorted(want, key=repr)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MATCH (x) RETURN x.name AS n ORDER BY x.age, x.name", ["bob", "ann", "dan", "cat"]),
        ("MATCH (x) RETURN x.name AS n ORDER BY x.age DESC, x.name DESC", ["dan", "ann", "bob", "cat"]),
        ("MATCH (x) RETURN x.name AS n ORDER BY x.age NULLS FIRST, n LIMIT 2", ["cat", "bob"]),
        ("MATCH (x) RETURN x.name AS n ORDER BY n LIMIT 0", []),
        ("MATCH (x) RETURN DISTINCT x.name AS n ORDER BY n DESC LIMIT 1", ["dan"]),
    ],
)
def test_order(g, text, want):
    assert [r[0] for r in ordered(g["people"], text)] == want


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (a)-[]->*(b) RETURN a.name AS a",
        "MATCH TRAIL (a)((x))+(b) RETURN a.name AS a",
        "MATCH (x) RETURN x.name AS n, COUNT(*) AS c",
        "MATCH (x) RETURN x.name AS n, x.age AS a, COUNT(*) AS c GROUP BY x.name",
        "MATCH (x) RETURN y.name AS n",
        "MATCH (x) RETURN x.name AS n, x.age AS n",
        "MATCH (x) NEAREST 3 y.v TO [1.0] RETURN x.name AS n",
    ],
)
def test_errors(g, text):
    with pytest.raises(GqlError):
        g["people"].execute(text).collect()


def test_column_names_and_raw_rows(g):
    assert g["chain"].execute("MATCH (a)-[e]->(b) RETURN a.name, e.p AS p").columns == ["col0", "p"]
    assert g["chain"].execute("MATCH (b)-[e]->(a)").columns == ["a", "b", "e"]
    x = g["chain"].execute("MATCH (a {name: 'a'})-[e]->(b) RETURN a, e ORDER BY e.p").first()
    assert (x.a.kind, x.a.labels, x.a.props) == ("node", ["N"], '{"name":"a"}') and (x.e.kind, x.e.labels, x.e.props) == ("edge", ["R"], '{"p":1}')
    y = g["chain"].execute("MATCH (a)-[e]->(b) RETURN b, COUNT(*) AS n GROUP BY b").collect()
    assert sorted(r.b.props for r in y) == ['{"name":"b"}', '{"name":"c"}']
    z = g["chain"].execute("MATCH p = (a {name: 'a'})-[e]->{1,2}(b)").collect()
    assert g["chain"].execute("MATCH p = (a)-[e]->{1,2}(b)").columns == ["a", "b", "e", "p"] and sorted(len(r.e) for r in z) == [1, 2]
    assert g["chain"].execute("MATCH (a) RETURN a.name AS n", limit=2).count() == 2


def test_warning_for_unknown_label(g):
    assert g["chain"].check("MATCH (x:Nope) RETURN x.name AS n")


def test_warnings_for_what_never_holds(g):
    assert g["people"].check("MATCH (x) WHERE x.age = 'a' RETURN x.name AS n") == ["int and str are never equal or unequal"]
    assert g["people"].check("MATCH (x) WHERE x.name < 3 RETURN x.name + 1 AS n") == ["str < int is never true", "str + int has no value"]
    assert g["people"].check("MATCH (x) WHERE x.age = 1.5 RETURN x.name AS n") == []


def test_multi_label_edge_is_one_match(spark):
    s = session(spark, [node("a", "N"), node("b", "N")], [edge("1", "a", "A", "b"), edge("2", "a", "B", "b"), edge("3", "a", "A&B", "b")])
    for label, n in (("A", 2), ("A&B", 1), ("A|B", 3), ("!A", 1)):
        assert rows(s, f"MATCH ()-[:{label}]->() RETURN COUNT(*) AS n") == [(n,)]


def test_unlabelled_node(spark):
    s = session(spark, [node("a", "", k=1), node("b", "N", k=2)])
    assert rows(s, "MATCH (x:N) RETURN x.k AS k") == [(2,)]
    assert rows(s, "MATCH (x:!N) RETURN x.k AS k") == [(1,)]
