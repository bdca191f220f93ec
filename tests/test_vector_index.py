"""The approximate vector index against exact searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.graph import ID
from loomgraph.lang.lexer import GqlError
from loomgraph.operators.vector_index import CELL, _by_nearness, _centres, _probes, _squared_gaps
from loomgraph.session import GraphSession
from loomgraph.sources.relational import commerce_graph

ATTRS = {"emb": "L2Sq", "emb_cos": "Cosine", "emb_ip": "Ip"}


@pytest.fixture(scope="module")
def big():
    return "/root/testdata/sf0.1"


def keys(s, text):
    return [r.k for r in s.execute(text).collect()]


@pytest.mark.parametrize("attr", sorted(ATTRS))
def test_recall_on_the_test_table(spark, big, attr):
    exact, near = (GraphSession(spark, commerce_graph(spark, big)) for _ in range(2))
    near.index_vectors(attr)
    cells = near.graph.cells[attr]
    n = exact.graph.vectors[attr][0].count()
    assert cells.rows.count() == n  # every row
    vectors = {r[0]: np.array(r[1], dtype=float) for r in exact.graph.vectors[attr][0].collect()}
    ids, all_rows = list(vectors), np.array(list(vectors.values()))
    opened, hits, wanted = 0, 0, 0
    place = {r[0]: r[1] for r in cells.rows.select(ID, CELL).collect()}
    for q in all_rows[:: n // 50]:
        if ATTRS[attr] == "L2Sq":
            d = ((all_rows - q) ** 2).sum(axis=1)
        else:
            norms = np.linalg.norm(all_rows, axis=1) * np.linalg.norm(q) if ATTRS[attr] == "Cosine" else 1.0
            d = -(all_rows @ q) / norms
        best = {ids[k] for k in d.argsort(kind="stable")[:10]}
        open_cells = set(cells.by_nearness(list(q))[: cells.probes])
        opened += sum(place[i] in open_cells for i in ids)
        hits += sum(place[i] in open_cells for i in best)
        wanted += 10
    print(attr, len(cells.centres), cells.probes, hits / wanted, opened / (n * (wanted // 10)))
    assert hits / wanted >= 0.9


def test_few_cells_of_clustered_vectors_are_opened():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(60, 32))[rng.integers(0, 60, 3000)] * 4 + rng.normal(size=(3000, 32))
    centres = _centres(points, 55, 1)
    probes = _probes(points, centres, "L2Sq")
    own = _squared_gaps(points, centres).argmin(axis=1)
    hits = 0
    for q in points[-100:]:
        best = ((points - q) ** 2).sum(axis=1).argsort()[:10]
        hits += np.isin(own[best], _by_nearness(q[None], centres, "L2Sq")[0][:probes]).sum()
    assert probes <= 6 and hits >= 900


def test_searches_use_the_cells_and_lose_nothing_for_want_of_rows(spark, sf, tmp_path):
    s = GraphSession(spark, commerce_graph(spark, sf))
    target = [float(x) for x in s.graph.vectors["emb"][0].orderBy(ID).first()["vector"]]
    texts = [
        f"MATCH (v:Vec) NEAREST 1 v.emb TO {target} RETURN v.key AS k",
        "MATCH (v:Vec), (w:Vec {key: 5}) NEAREST 1 v.emb TO VECTOR(w, 'emb') RETURN v.key AS k",
        "MATCH (v:Vec {label: 3}) NEAREST 100000 v.emb TO %s RETURN v.key AS k" % target,  # more than there are
        "MATCH (w:Vec {label: 1}), (v:Vec {label: 2}) NEAREST 1 v.emb TO VECTOR(w, 'emb') RETURN w.key AS k",  # several anchors
    ]
    want = [keys(s, t) for t in texts]
    s.index_vectors("emb", cells=20, probes=1)
    assert [keys(s, t) for t in texts] == want
    plan = s.execute(texts[0])._jdf.queryExecution().executedPlan().toString()
    assert CELL in plan and "PushedFilters" in plan
    s.graph = type(s.graph)(spark, [t for t in s.graph.nodes if t.name == "Vec"], [], s.graph.vectors, s.graph.codes, s.graph.cells)
    s.save(str(tmp_path / "v"))
    again = GraphSession.open(spark, str(tmp_path / "v"))
    assert "emb" in again.graph.cells and keys(again, texts[1]) == want[1]
    again.drop_vector_index("emb")
    assert "emb" not in again.graph.cells and keys(again, texts[1]) == want[1]


def test_edges_of_the_index(spark, sf):
    s = GraphSession(spark, commerce_graph(spark, sf))
    with pytest.raises(GqlError):
        s.index_vectors("nothing")
    rows, dim, metric = s.graph.vectors["emb"]
    s.graph.vectors["emb"] = (rows.filter("false"), dim, metric)
    s.index_vectors("emb")
    assert "emb" not in s.graph.cells
    one = rows.orderBy(ID).limit(3)
    same = one.withColumn("vector", F.array_repeat(F.lit(0.0).cast("float"), dim))
    odd = one.withColumn("vector", F.array(F.lit(1.0).cast("float")))
    s.graph.vectors["emb_cos"] = (same.unionByName(odd), dim, "Cosine")  # ties at zero, and another dimension
    s.index_vectors("emb_cos", cells=5)
    assert s.graph.cells["emb_cos"].rows.count() == 3
    assert len(keys(s, f"MATCH (v:Vec) NEAREST 2 v.emb_cos TO {[1.0] * dim} RETURN v.key AS k")) == 2
