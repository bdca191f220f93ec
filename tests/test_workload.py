"""Every query of the workload against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from loomgraph import workload
from loomgraph.operators import paths

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(workload.ORACLE_SQL))
def test_against_sql(spark, sf, db, name):
    df = workload.QUERIES[name](spark, sf)
    want = db.sql(workload.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_queries_without_sql():
    assert set(workload.QUERIES) - set(workload.ORACLE_SQL) == {"nearest_approximate"}


def test_the_approximate_search_finds_the_nearest(spark, sf, db):
    got = [r.k for r in workload.QUERIES["nearest_approximate"](spark, sf).collect()]
    exact = {r[0] for r in db.sql(workload.ORACLE_SQL["nearest_topk"]).project("k").fetchall()}
    assert got[0] == 5 and len(set(got)) == 10 and len(exact & set(got)) >= 8


def test_properties_are_read_late_and_filters_reach_the_scan(spark, sf):
    df = workload.QUERIES["prop_map_filter"](spark, sf)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)]" in text
    assert "c_name" not in text


def test_a_node_that_adds_nothing_is_not_scanned(spark, sf):
    df = workload.QUERIES["one_hop_count"](spark, sf)
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


@pytest.mark.parametrize(("name", "column", "table", "key"), [("value_argmax", "c", "customer", "c_custkey"), ("optional_correlated", "c", "customer", "c_custkey"), ("shortest_len", "a", "nation", "n_nationkey"), ("shortest_k_groups", "b", "nation", "n_nationkey"), ("shortest_k_paths", "b", "nation", "n_nationkey"), ("cartesian", "n", "nation", "n_name")])
def test_queries_go_over_all_keys(spark, sf, name, column, table, key):
    got = workload.QUERIES[name](spark, sf).select(column).distinct()
    assert {r[0] for r in got.collect()} == {r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect()}


@pytest.mark.parametrize(
    ("text", "starts", "levels"),
    [
        ("MATCH p = ANY SHORTEST (a:Nation {key: 0})-[:ROUTE]->+(b:Nation {key: 5}) RETURN PATH_LENGTH(p) AS n", 1, 3),
        ("MATCH p = ANY SHORTEST (a:Nation)-[:ROUTE]->+(b:Nation) WHERE a.key = 0 AND b.key = 5 RETURN PATH_LENGTH(p) AS n", 1, 3),
        ("MATCH p = ALL SHORTEST (a:Nation)-[:ROUTE]->+(b:Nation) WHERE a.key < 2 AND b.key = 3 RETURN PATH_LENGTH(p) AS n", 2, 2),
        ("MATCH p = ANY SHORTEST (a:Nation)-[:ROUTE]->{1,2}(b:Nation) WHERE b.key = 3 RETURN PATH_LENGTH(p) AS n", 25, 2),
    ],
)
def test_searches_start_from_fixed_ends_and_stop(spark, sf, monkeypatch, text, starts, levels):
    made = []
    keep = paths.written
    monkeypatch.setattr(paths, "written", lambda df, label="graph": made.append((label, out := keep(df, label))) or out)
    lengths = [r.n for r in workload._query(text)(spark, sf).collect()]
    assert lengths and max(lengths) <= levels
    sizes = {}
    for label, df in made:
        sizes.setdefault(label, []).append(df.count())
    assert sizes["starts"] == [starts]
    assert len([n for n in sizes["level"] if n]) <= levels
    if starts == 25:  # on the way back from the one end
        assert sizes["level"][0] == 2 and sum(sizes["level"]) <= 6
