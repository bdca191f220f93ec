import json

import pyarrow.parquet as pq
import pytest
from graphs import CHAIN, FRAUD, node, rows, session
from pyspark.sql import functions as F

from loomgraph.cli import Shell
from loomgraph.graph import ID
from loomgraph.lang.lexer import GqlError
from loomgraph.session import GraphSession
from loomgraph.sources import files
from loomgraph.sparql import Mapping, translate


def test_insert_match_and_reuse(spark):
    s = GraphSession(spark)
    s.execute("INSERT (a:Person {name: 'Amy'})-[:ACTED_IN {roles: ['x', 'y']}]->(:Movie {title: 'Arrival'}), (a)-[:KNOWS]->(:Person {name: 'Bea'})")
    assert rows(s, "MATCH (p:Person)-[r:ACTED_IN]->(m) RETURN p.name AS p, r.roles AS r, m.title AS t") == [("Amy", ["x", "y"], "Arrival")]
    assert rows(s, "MATCH (p:Person) INSERT (p)-[:LIKES]->(:Thing {of: p.name}) RETURN p.name AS n") == [("Amy",), ("Bea",)]
    assert rows(s, "MATCH (p)-[:LIKES]->(t:Thing) RETURN p.name AS p, t.of AS o") == [("Amy", "Amy"), ("Bea", "Bea")]
    assert (s.node_count, s.edge_count) == (5, 4)
    with pytest.raises(GqlError):
        s.execute("MATCH (p:Person) INSERT (p:Other)")


def test_a_statement_does_not_see_its_own_inserts(spark):
    s = session(spark, [node("a", "N", k=1)])
    s.execute("MATCH (x:N) INSERT (:N {k: x.k + 1})")
    assert rows(s, "MATCH (x:N) RETURN x.k AS k") == [(1,), (2,)]


def test_set_remove_and_labels(spark):
    s = session(spark, *CHAIN)
    assert rows(s, "MATCH (x {name: 'a'}) SET x.k = 5, x.name = 'z' RETURN x.k AS k, x.name AS n") == [(5, "z")]
    s.execute("MATCH (x {name: 'b'}) SET x = {only: 'me'}")
    assert rows(s, "MATCH (x) RETURN x.name AS n, x.only AS o, x.k AS k") == [("c", None, None), ("z", None, 5), (None, "me", None)]
    s.execute("MATCH ()-[e {p: 1}]->() SET e.p = 'one'")
    assert rows(s, "MATCH (a)-[e]->(b) WHERE e.p = 'one' RETURN a.name AS a") == [("z",)]
    s.execute("MATCH (x {name: 'z'}) SET x:Extra")
    assert rows(s, "MATCH (x:N&Extra)-[]->(y) RETURN x.name AS x, y.only AS y") == [("z", "me")]
    s.execute("MATCH (x:Extra) REMOVE x:Extra")
    s.execute("MATCH (x {k: 5}) REMOVE x.k")
    assert rows(s, "MATCH (x:Extra) RETURN COUNT(*) AS n") == [(0,)]
    assert rows(s, "MATCH (x) WHERE x.k IS NOT NULL RETURN COUNT(*) AS n") == [(0,)]


def test_delete_and_rollback_to_the_last_save(spark, tmp_path):
    s = session(spark, *FRAUD)
    s.save(str(tmp_path / "g"))
    s.execute("INSERT (:Account {owner: 'New'})")
    with pytest.raises(GqlError, match="G1001"):
        s.execute("MATCH (x:Account {owner: 'Jon'}) DELETE x")
    assert rows(s, "MATCH (x:Account {owner: 'New'}) RETURN COUNT(*) AS n") == [(0,)]
    s.execute("MATCH (x:Account {owner: 'Jon'}) DETACH DELETE x")
    assert (s.node_count, s.edge_count) == (4, 3)
    s.execute("MATCH ()-[t:Foo]->() DELETE t")
    assert (s.node_count, s.edge_count) == (4, 2)
    assert GraphSession.open(spark, str(tmp_path / "g")).node_count == 5


def test_graph_types(spark, tmp_path):
    s = GraphSession(spark, path=str(tmp_path / "t"))
    s.execute("CREATE GRAPH TYPE cast AS { (:Actor {name STRING, born INT | NULL}), (:Loose {a INT, *}), (:Actor)-[:KNOWS]->(:Actor) }")
    s.execute("USE GRAPH TYPE cast")
    s.execute("INSERT (:Actor {name: 'Ada'})")
    s.save()
    s.execute("INSERT (:Loose {a: 1, b: 'x'})")
    with pytest.raises(GqlError, match="G2000"):
        s.execute("INSERT (:Actor {name: 42})")
    assert rows(s, "MATCH (x) RETURN COUNT(*) AS n") == [(1,)]
    for bad in ("INSERT (:Actor {born: 1})", "INSERT (:Actor {name: 'a', extra: 1})", "INSERT (:Other)", "INSERT (:Actor {name: 'a'})-[:HATES]->(:Actor {name: 'b'})"):
        with pytest.raises(GqlError, match="G2000"):
            s.execute(bad)
    again = GraphSession.open(spark, str(tmp_path / "t"))
    assert again.graph_types() == ["DEFAULT", "cast"] and again.catalog.active == "cast"
    assert rows(again, "SHOW GRAPH TYPE DEFAULT") == [("node", "(:Actor {name STRING})")]
    assert rows(again, "VALIDATE GRAPH TYPE cast") == []
    again.execute("DROP GRAPH TYPE cast")
    assert again.catalog.active == "DEFAULT"


def test_indexes(spark):
    s = session(spark, *FRAUD)
    s.execute("CREATE BTREE INDEX mine ON :Account(owner)")
    found = {(r["name"], r["kind"]) for r in s.execute("SHOW INDEXES").collect()}
    assert ("mine", "BTREE") in found and ("auto_Account_owner", "HASH") in found
    s.execute("DROP INDEX mine")
    with pytest.raises(GqlError):
        s.execute("DROP INDEX mine")


def test_saved_tables_follow_their_indexes(spark, tmp_path):
    s = session(spark, [node(f"n{k}", "N", k=k * 37 % 400, hot=7 if k % 3 else k, plain=k) for k in range(400)])
    for prop in ("k", "hot"):
        s.catalog.indexes.clear()
        s.execute(f"CREATE BTREE INDEX sorted ON :N({prop})")
        s.execute("CREATE HASH INDEX told ON :N(plain)")
        with_ranges = spark.conf.get("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        s.save(str(tmp_path / prop))
        spark.conf.set("spark.sql.adaptive.enabled", with_ranges)
        parts = [pq.read_table(f) for f in sorted((tmp_path / prop).glob("version-*/nodes/0/*.parquet"))]
        values = [p[prop].to_pylist() for p in parts if p.num_rows]
        assert len(values) == 2 and all(v == sorted(v) for v in values) and min(map(len, values)) > 100
        assert max(values[0]) <= min(values[1])
    assert rows(s, "MATCH (x:N {plain: 5}) RETURN x.k AS k") == [(5 * 37 % 400,)]


def test_dumps_round_trip(spark):
    s = session(spark, *FRAUD)
    again = GraphSession.import_json_str(spark, s.to_json())
    q = "MATCH (x)-[t]->(y) RETURN x.owner AS x, t.amount AS a, y.owner AS y"
    assert rows(again, q) == rows(s, q)
    third = GraphSession(spark)
    third.execute(s.to_gql())
    assert rows(third, q) == rows(s, q)
    bad = session(spark, [node("a", "N", t="it's")])
    with pytest.raises(GqlError):
        bad.to_gql()


def test_csv(spark, tmp_path):
    (tmp_path / "Person.csv").write_text("vid,name,age\n1,Ana,30\n2,Beto,\n,none,1\n")
    (tmp_path / "Movie.csv").write_text("vid,title\n9,Up\n1,Dup\n")
    (tmp_path / "acted_in.csv").write_text("SRC_ID,DST_ID,role\n1,9,lead\n2,9,\n7,9,lost\n")
    config = {"files": [{"path": "Person.csv", "columns": {"vid": "STRING", "name": "STRING", "age": "INT64"}}, {"path": "Movie.csv", "columns": {"vid": "STRING", "title": "STRING"}}, {"path": "acted_in.csv", "label": "ACTED_IN", "columns": {"SRC_ID": "STRING", "DST_ID": "STRING", "role": "STRING"}}]}
    (tmp_path / "spanner_import_config.json").write_text(json.dumps(config))
    s = GraphSession.import_csv(spark, str(tmp_path))
    assert rows(s, "MATCH (p:Person)-[r:ACTED_IN]->(m:Movie) RETURN p.name AS p, p.age AS a, r.role AS r, m.title AS t") == [("Ana", 30, "lead", "Up"), ("Beto", None, None, "Up")]
    assert rows(s, "MATCH (x:Person&Movie) RETURN x.name AS n, x.title AS t") == [("Ana", "Dup")]


def test_names_of_csv_files():
    assert files.id_column(["x", "Person_ID"], "Person") == "Person_ID"
    assert files.id_column(["x", "other_id"], "Person") == "other_id"
    assert files.edge_label("person_likes_movie", ["Person", "Movie"]) == "likes"


def test_ldbc(spark, tmp_path):
    (tmp_path / "person_0_0.csv").write_text("id|firstName|birthday\n1|Ann|5\n2|Ben|6\n")
    (tmp_path / "place_0_0.csv").write_text("id|name|type\n7|Oslo|city\n8|Norway|country\n")
    (tmp_path / "person_knows_person_0_0.csv").write_text("Person.id|Person.id|creationDate\n1|2|99\n")
    (tmp_path / "person_isLocatedIn_place_0_0.csv").write_text("Person.id|Place.id\n1|7\n")
    (tmp_path / "place_isPartOf_place_0_0.csv").write_text("Place.id|Place.id\n7|8\n")
    (tmp_path / "person_email_emailaddress_0_0.csv").write_text("Person.id|email\n1|b@x\n")
    (tmp_path / "person_email_emailaddress_1_0.csv").write_text("Person.id|email\n1|a@x\n")
    s = GraphSession(spark, files.graph_from_ldbc(spark, str(tmp_path)))
    assert rows(s, "MATCH (a:Person {id: 2})~[k:knows]~(b) RETURN b.firstName AS n, k.creationDate AS d, b.email AS e") == [("Ann", 99, ["a@x", "b@x"])]
    assert rows(s, "MATCH (p:Person)-[:isLocatedIn]->(c:City)-[:isPartOf]->(x:Country) RETURN p.birthday AS b, c.name AS c, x.name AS x") == [(5, "Oslo", "Norway")]


def test_edge_list_and_triples(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# c\n1\t2\n2\t3\n3 1\n")
    s = GraphSession(spark, files.graph_from_edge_list(spark, str(tmp_path / "e.txt")))
    assert rows(s, "MATCH (a)-[]->(b)-[]->(c)-[]->(a) RETURN COUNT(*) AS n") == [(3,)]
    (tmp_path / "t.nt").write_text("<http://x/1> <http://x/P1> <http://x/2> .\n<http://x/2> <http://x/P2> <http://x/3> .\n<http://x/1> <http://x/P3> \"text\" .\n")
    (tmp_path / "v.nt").write_text('<http://x/1> <http://x/hog> "[0.0, 1.0]"^^<http://x/t> .\n<http://x/2> <http://x/hog> "[1.0, 1.0]"^^<http://x/t> .\n')
    s = GraphSession(spark, files.graph_from_triples(spark, str(tmp_path / "t.nt"), vectors=str(tmp_path / "v.nt")))
    m = Mapping.of_triples()
    assert sorted(r[0] for r in s.query_sparql("PREFIX x: <http://x/> SELECT ?b WHERE { x:1 x:P1/x:P2 ?b }", m).collect()) == [3]
    assert sorted(r[0] for r in s.query_sparql("PREFIX x: <http://x/> SELECT ?b WHERE { x:1 (x:P1|x:P2)+ ?b }", m).collect()) == [2, 3]
    assert [tuple(r) for r in s.query_sparql("PREFIX x: <http://x/> SELECT ?a ?b WHERE { ?a x:P1 ?b OPTIONAL { ?b x:P9 ?c } FILTER(?a < ?b) } ORDER BY ?c", m).collect()] == [(1, 2)]
    assert [r[0] for r in s.execute("MATCH (x:img) NEAREST 1 x.hog TO [0.9, 1.0] RETURN x.id AS i").collect()] == [2]


@pytest.mark.parametrize("text", ["ASK { ?a ?b ?c }", "SELECT ?a WHERE { ?a <p> ?b } OFFSET 2", "SELECT ?a WHERE { ?a <p> ?b MINUS { ?a <q> ?b } }", "SELECT ?a WHERE { BIND(1 AS ?a) }", "SELECT (COUNT(DISTINCT *) AS ?n) WHERE { ?a <p> ?b }"])
def test_sparql_refusals(text):
    with pytest.raises(GqlError):
        translate(text)


def test_nearest(spark):
    s = session(spark, [node(f"i{k}", "Item", k=k) for k in range(6)] + [node("u", "User", k=100)])
    nodes = s.graph.nodes
    items = next(t for t in nodes if "Item" in t.labels).df
    s.graph.vectors["v"] = (items.select(ID, F.array(F.col("k").cast("float"), F.lit(0.0).cast("float")).alias("vector")), 2, "L2Sq")
    assert [tuple(r) for r in s.execute("MATCH (x:Item) NEAREST 3 x.v TO [2.2, 0.0] AS d RETURN x.k AS k ORDER BY d").collect()] == [(2,), (3,), (1,)]
    assert rows(s, "MATCH (x:Item), (u:User) NEAREST 2 x.v TO [0.0, 0.0] RETURN x.k AS k") == [(0,), (1,)]
    assert rows(s, "MATCH (a:Item), (b:Item) WHERE a.k < 2 AND a <> b NEAREST 1 b.v TO VECTOR(a, 'v') RETURN a.k AS a, b.k AS b") == [(0, 1), (1, 0)]
    for nothing in ("x.w TO [1.0, 0.0]", "x.v TO [1.0]"):
        assert rows(s, f"MATCH (x:Item) NEAREST 2 {nothing} RETURN x.k AS k") == []
    for metric, want in (("Cosine", 5), ("Ip", 5)):
        s.graph.vectors["v"] = (*s.graph.vectors["v"][:2], metric)
        assert [r[0] for r in s.execute("MATCH (x:Item) WHERE x.k > 3 NEAREST 2 x.v TO [1.0, 0.0] AS d RETURN x.k AS k ORDER BY d, x.k DESC LIMIT 1").collect()] == [want]


def test_shell(spark, tmp_path, capsys):
    shell = Shell(session(spark, *CHAIN))
    shell.run(["MATCH (x) RETURN x.name AS n ORDER BY n", ".schema", f".save {tmp_path / 'x'}", "MATCH (", ".nope", ".quit", "MATCH (x)"])
    text = capsys.readouterr().out
    assert "n\na\nb\nc\n" in text and "(:N {name STRING})" in text and "error:" in text and "unknown command" in text


def test_returned_elements_after_a_change_and_a_timeout(spark):
    s = session(spark, *CHAIN)
    assert [r.x.props for r in s.execute("MATCH (x {name: 'a'}) SET x.k = 1 RETURN x").collect()] == ['{"k":1,"name":"a"}']
    s.set_timeout(600)
    assert len(s.run_in_group("MATCH (x) RETURN x.name AS n")) == 3
