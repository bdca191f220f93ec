"""Searches over chains of several edges go edge by edge from the frontier."""

import random

import pytest
from graphs import edge, node, rows, session

from loomgraph.operators import paths
from loomgraph.plans.pattern import PatternPlanner


def test_laps_away_from_the_start_are_not_made(spark, monkeypatch):
    many = 40
    nodes = [node(f"p{k}", "P", k=k) for k in range(many + 2)] + [node("hub", "H"), node("h", "H")]
    edges = [edge(f"a{k}", f"p{k}", "A", "hub") for k in range(many)] + [edge(f"b{k}", "hub", "B", f"p{k}") for k in range(many)]
    edges += [edge("a", f"p{many}", "A", "h"), edge("b", "h", "B", f"p{many + 1}")]
    s = session(spark, nodes, edges)
    made = []

    def counted(df, *args):
        out = written(df, *args)
        made.append(out.count())
        return out

    written = paths.written
    monkeypatch.setattr(paths, "written", counted)
    text = f"MATCH p = ANY SHORTEST (a:P {{k: {many}}})((:P)-[:A]->(:H)-[:B]->(:P))+(b:P {{k: {many + 1}}}) RETURN a.k AS a, b.k AS b, PATH_LENGTH(p) AS l"
    assert rows(s, text) == [(many, many + 1, 2)]
    assert max(made) == 1  # 1601 laps


@pytest.mark.parametrize(
    "lap, limit",
    [("((x:N)-[e:R]->(y:N)-[f:S]->(z:N))", 0), ("((x WHERE x.w < 8)-[e:R]->(y WHERE y.w > 1)~[f:U]~(z:M))", 1 << 20), ("((x)<-[e:R]-()-[f:S WHERE f.w > 2]->(z)-[g]->())", 2)],
)
def test_hops_against_whole_laps(spark, monkeypatch, lap, limit):
    rnd = random.Random(7)
    n, m = 7, 28
    nodes = [node(f"n{k}", rnd.choice(["N", "N&M"]), k=k, w=rnd.randrange(10)) for k in range(n)]
    edges = [edge(f"e{k:02}", f"n{rnd.randrange(n)}", t, f"n{rnd.randrange(n)}", t != "U", w=rnd.randrange(10)) for k, t in enumerate(rnd.choices("RSU", k=m))]
    s = session(spark, nodes, edges)
    asked = []
    plan = PatternPlanner.hops
    monkeypatch.setattr(paths, "SENT_NODES", limit)
    monkeypatch.setattr(PatternPlanner, "hops", lambda self, p, back: asked.append(plan(self, p, back)) or asked[-1])
    bound = "PATH_LENGTH(p) AS l, [i IN x | i.w] AS xs, [i IN f | i.w] AS fs, [i IN z | i.k] AS zs"
    texts = [
        f"MATCH p = ANY 3 (a){lap}{{2,3}}(b) RETURN a.k AS a, b.k AS b, {bound}",
        f"MATCH p = ANY SHORTEST (a WHERE a.k < 3){lap}+(b WHERE b.k > 4) RETURN a.k AS a, b.k AS b, [i IN EDGES(p) | i.w] AS es, [i IN NODES(p) | i.k] AS ns",
        f"MATCH p = SHORTEST 2 GROUPS (a){lap}{{0,2}}(b WHERE b.k = 2) RETURN a.k AS a, b.k AS b, {bound}",
    ]
    got = [rows(s, t) for t in texts]
    assert asked and None not in asked and any(got)
    monkeypatch.setattr(PatternPlanner, "hops", lambda self, p, back: None)
    assert got == [rows(s, t) for t in texts]


@pytest.mark.parametrize("lap", ["((x)-[e:R]->(y)-[f:S]->(z) WHERE x.w < z.w)", "((x)-[:R]->(y)-[:S]->(x))", "((x)-[e:R]->(y WHERE y.w > x.w)-[:S]->(z))"])
def test_conditions_on_several_elements_keep_whole_laps(spark, lap):
    s = session(spark, [node(f"n{k}", "N", k=k, w=k) for k in range(4)], [edge("r", "n0", "R", "n1"), edge("s", "n1", "S", "n2"), edge("t", "n1", "S", "n0")])
    want = [(0, 0)] if "->(x)" in lap else [(0, 2)] if "z.w" in lap else [(0, 0), (0, 2)]
    assert rows(s, f"MATCH p = ANY SHORTEST (a){lap}+(b) RETURN a.k AS a, b.k AS b") == want
