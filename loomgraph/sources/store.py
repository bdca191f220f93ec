"""Graphs to Parquet folders and back; dumps as JSON and as INSERT statements."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import DST, EID, ID, SRC, EdgeTable, NodeTable, PropertyGraph, is_mixed
from ..lang.lexer import GqlError
from ..operators.vector_index import CELL, VectorCells

FORMAT = 2


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The versions in a graph's folder that were written whole, oldest first."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(target)]
    return sorted(int(n.removeprefix("whole-")) for n in names if n.startswith("whole-"))


def _indexed(t: NodeTable | EdgeTable, indexes: list[tuple[str, str, str]]):
    """The table's writer: by ranges of the first property with a sorted index, so that files and row
    groups hold few values of it (the id parts a value that many rows share); with Bloom filters for
    properties with a hash index. Conditions on them then skip what can't match."""
    mine = [(prop, kind) for label, prop, kind in indexes if label in t.labels and prop in t.props]
    df = t.df
    ranges = next((prop for prop, kind in mine if kind == "BTREE"), None)
    if ranges is not None:
        order = [F.col(f"`{ranges}`"), F.col(ID if ID in df.columns else EID)]
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    hashed = [prop for prop, kind in mine if kind == "HASH"]
    return df.write.options(**{f"parquet.bloom.filter.enabled#{prop}": "true" for prop in hashed})


def save_graph(g: PropertyGraph, path: str, catalog: dict | None = None) -> None:
    """Writes every table to a new version's folder and at last a file that says the version is whole, so
    that a graph is there whole at any time: a save that breaks off leaves the version before it."""
    spark, path = g.spark, path.rstrip("/")
    before = _versions(spark, path)
    version = max(before, default=0) + 1
    fresh = f"{path}/version-{version}"
    fs, folder = _fs(spark, fresh)
    fs.delete(folder, True)  # of a save that broke off
    meta: dict = {"format": FORMAT, "codes": g.codes, "nodes": [], "edges": [], "vectors": [], "catalog": catalog or {}}
    indexes = [tuple(x) for _, x in sorted((catalog or {}).get("indexes", {}).items())]
    for k, t in enumerate(g.nodes):
        _indexed(t, indexes).parquet(f"{fresh}/nodes/{k}")
        meta["nodes"].append({"name": t.name, "labels": sorted(t.labels)})
    for k, t in enumerate(g.edges):
        _indexed(t, indexes).parquet(f"{fresh}/edges/{k}")
        meta["edges"].append({"name": t.name, "labels": sorted(t.labels), "directed": t.directed, "src": sorted(t.src) if t.src else None, "dst": sorted(t.dst) if t.dst else None})
    for k, (attr, (df, dim, metric)) in enumerate(sorted(g.vectors.items())):
        df.write.parquet(f"{fresh}/vectors/{k}")
        meta["vectors"].append({"attr": attr, "dim": dim, "metric": metric})
        if attr in g.cells:
            cells = g.cells[attr]
            order = [F.col(CELL), F.col(ID)]
            cells.rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{fresh}/cells/{k}")
            meta["vectors"][-1]["cells"] = {"centres": cells.centres.tolist(), "probes": cells.probes}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{fresh}/meta")
    fs.create(_fs(spark, f"{path}/whole-{version}")[1]).close()
    for old in before:
        fs.delete(_fs(spark, f"{path}/whole-{old}")[1], False)
        fs.delete(_fs(spark, f"{path}/version-{old}")[1], True)


def open_graph(spark: SparkSession, path: str) -> tuple[PropertyGraph, dict]:
    path = path.rstrip("/")
    versions = _versions(spark, path)
    if not versions:
        raise GqlError(f"there is no whole graph at {path}")
    path = f"{path}/version-{versions[-1]}"
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta["format"] != FORMAT:
        raise GqlError(f"unknown graph format {meta['format']}")
    g = PropertyGraph(spark, codes=meta["codes"])
    names = lambda x: frozenset(x) if x else None
    for k, t in enumerate(meta["nodes"]):
        g.nodes.append(NodeTable(t["name"], frozenset(t["labels"]), spark.read.parquet(f"{path}/nodes/{k}")))
    for k, t in enumerate(meta["edges"]):
        g.edges.append(EdgeTable(t["name"], frozenset(t["labels"]), spark.read.parquet(f"{path}/edges/{k}"), t["directed"], names(t["src"]), names(t["dst"])))
    for k, v in enumerate(meta["vectors"]):
        g.vectors[v["attr"]] = (spark.read.parquet(f"{path}/vectors/{k}"), v["dim"], v["metric"])
        if "cells" in v:
            g.cells[v["attr"]] = VectorCells(spark.read.parquet(f"{path}/cells/{k}"), np.array(v["cells"]["centres"]), v["metric"], v["cells"]["probes"])
    return g, meta["catalog"]


def _json_value(name: str, t: T.DataType):
    c = F.col(f"`{name}`")
    if not is_mixed(t):
        return c.alias(name)
    text = F.when(c["kind"] == "int", c["l"].cast("string")).when(c["kind"] == "float", c["d"].cast("string")).when(c["kind"] == "bool", c["b"].cast("string")).when(c["kind"] == "str", F.to_json(F.array(c["s"]))).otherwise(c["j"])
    return F.try_parse_json(F.when(c["kind"] == "str", F.regexp_replace(text, r"^\[|\]$", "")).otherwise(text)).alias(name)


def _elements(tables: list, ids: list[str], extra) -> DataFrame | None:
    parts = []
    for t in tables:
        props = F.to_json(F.struct(*[_json_value(n, x) for n, x in sorted(t.props.items())])) if t.props else F.lit("{}")
        parts.append(t.df.select(*ids, F.array(*[F.lit(x) for x in sorted(t.labels)]).cast("array<string>").alias("labels"), props.alias("props"), *extra(t)))
    return reduce(DataFrame.unionByName, parts) if parts else None


def dump_json(g: PropertyGraph) -> str:
    """The graph as JSON text that the JSON source reads back. Small graphs only: it comes to the driver."""
    nodes, edges = _elements(g.nodes, [ID], lambda t: []), _elements(g.edges, [EID, SRC, DST], lambda t: [F.lit("->" if t.directed else "~~").alias("dir")])
    out: dict = {"nodes": [], "edges": []}
    for r in sorted(nodes.collect(), key=lambda r: r[ID]) if nodes is not None else []:
        out["nodes"].append({"id": f"n{r[ID]}", "labels": r["labels"], "props": json.loads(r["props"])})
    for r in sorted(edges.collect(), key=lambda r: r[EID]) if edges is not None else []:
        out["edges"].append({"id": f"e{r[EID]}", "labels": r["labels"], "props": json.loads(r["props"]), "endpoints": [f"n{r[SRC]}", f"n{r[DST]}"], "directionality": r["dir"]})
    return json.dumps(out, ensure_ascii=False)


def _gql_value(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, list):
        return "[" + ", ".join(map(_gql_value, v)) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{k}: {_gql_value(x)}" for k, x in sorted(v.items())) + "}"
    if "'" in str(v):
        raise GqlError("a string with a single quote can't be written as GQL")
    return f"'{v}'"


def dump_gql(g: PropertyGraph) -> str:
    """One INSERT statement that makes the graph again."""
    data = json.loads(dump_json(g))
    parts = []
    body = lambda x: (":" + "&".join(x["labels"]) if x["labels"] else "") + (" {" + ", ".join(f"{k}: {_gql_value(v)}" for k, v in sorted(x["props"].items())) + "}" if x["props"] else "")
    for n in data["nodes"]:
        parts.append(f"({n['id']}{body(n)})")
    for e in data["edges"]:
        a, b = e["endpoints"]
        parts.append(f"({a})-[{body(e)}]->({b})" if e["directionality"] == "->" else f"({a})~[{body(e)}]~({b})")
    return "INSERT " + ", ".join(parts) if parts else ""
