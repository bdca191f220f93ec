"""Graphs from JSON, CSV with a configuration, pipe-separated benchmark files, edge lists and triples."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import DST, EID, ID, MIXED, SRC, EdgeTable, NodeTable, PropertyGraph
from ..lang.lexer import GqlError
from ..storage import written

NAME = "__name"
_ELEMENT = "id string, labels array<string>, props string"
GRAPH_SCHEMA = f"nodes array<struct<{_ELEMENT}>>, edges array<struct<{_ELEMENT}, endpoints array<string>, directionality string>>"


def _numbered(df: DataFrame, code: int, column: str) -> DataFrame:
    """With ids; written, so that they are given once."""
    return written(df.withColumn(column, F.lit(code << 48) + F.monotonically_increasing_id()), "ids")


# ---- properties in JSON text


def _schema_fields(text: str | None) -> dict[str, str]:
    """Keys and types of 'OBJECT<a: BIGINT, b: ARRAY<STRING>>'."""
    inner = re.fullmatch(r"OBJECT<(.*)>", text or "", re.DOTALL)
    out: dict[str, str] = {}
    if not inner or not inner[1]:
        return out
    depth, parts, now = 0, [], ""
    for ch in inner[1]:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            parts.append(now)
            now = ""
        else:
            now += ch
    for p in [*parts, now]:
        key, _, t = p.strip().partition(": ")
        out[key.strip("`")] = t
    return out


def _spark_type(t: str) -> str | None:
    if t in ("BIGINT", "BOOLEAN", "STRING", "DOUBLE"):
        return t.lower()
    if t.startswith("DECIMAL") or t == "FLOAT":
        return "double"
    inner = re.fullmatch(r"ARRAY<(.*)>", t)
    if inner:
        item = _spark_type(inner[1]) if inner[1] != "VOID" else "bigint"
        return f"array<{item}>" if item else None
    fields = _schema_fields(t)
    if fields:
        typed = {k: _spark_type(x) for k, x in sorted(fields.items())}
        return "struct<" + ",".join(f"`{k}`:{x}" for k, x in typed.items()) + ">" if all(typed.values()) else None
    return None


def _typed_props(df: DataFrame, schema: str | None) -> DataFrame:
    """Columns for the keys of ``__v``; keys whose values differ in kind become MIXED structs."""
    cols = []
    for key, t in sorted(_schema_fields(schema).items()):
        if t == "VOID":
            continue
        got = F.try_variant_get("__v", f"$['{key}']", "variant")
        kind_text = F.schema_of_variant(got)
        want = _spark_type(t)
        if want:
            cols.append(F.try_variant_get("__v", f"$['{key}']", want).alias(key))
            continue
        kind = F.when(kind_text == "BIGINT", "int").when(kind_text == "BOOLEAN", "bool").when(kind_text == "STRING", "str").when(kind_text.startswith("ARRAY"), "list").when(kind_text.startswith("OBJECT"), "record").when(got.isNotNull(), "float")
        pick = lambda k, x: F.when(kind == k, F.try_variant_get("__v", f"$['{key}']", x))  # noqa: B023,E731
        whole = F.struct(kind.alias("kind"), pick("int", "bigint").alias("l"), pick("float", "double").alias("d"), pick("str", "string").alias("s"), pick("bool", "boolean").alias("b"), F.when(kind.isin("list", "record"), F.to_json(got)).alias("j"))
        cols.append(F.when(kind.isNotNull() & (kind_text != "VOID"), whole).cast(MIXED).alias(key))
    keep = [c for c in df.columns if c.startswith("__") and c not in ("__v", "__labels")]
    return df.select(*keep, *cols)


def _by_labels(df: DataFrame) -> list[tuple[frozenset[str], str | None, DataFrame]]:
    """Rows split by label set; the sets are few, they are the schema."""
    sets = df.groupBy("__labels").agg(F.expr("schema_of_variant_agg(__v)").alias("s")).collect()
    return [(frozenset(r["__labels"]), r["s"], df.filter(F.col("__labels") == F.array(*[F.lit(x) for x in r["__labels"]]).cast("array<string>"))) for r in sorted(sets, key=lambda r: r["__labels"])]


def graph_from_elements(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
    """From nodes(id, labels, props JSON) and edges(id, labels, props, endpoints, directionality)."""
    g = PropertyGraph(spark)
    parsed = lambda df: df.withColumn("__labels", F.array_sort(F.coalesce("labels", F.array().cast("array<string>")))).withColumn("__v", F.expr("parse_json(coalesce(props, '{}'))"))
    nodes = _numbered(nodes.select(F.col("id").alias(NAME), "labels", "props"), g.next_code(), ID)
    for k, (labels, schema, rows) in enumerate(_by_labels(parsed(nodes).select(ID, NAME, "__labels", "__v"))):
        g.nodes.append(NodeTable(f"n{k}:{'&'.join(sorted(labels))}", labels, written(_typed_props(rows, schema), "nodes")))
    names = nodes.select(NAME, ID)
    ends = edges.select(F.col("id").alias(NAME), "labels", "props", F.get("endpoints", F.lit(0)).alias("__a"), F.get("endpoints", F.lit(1)).alias("__b"), (F.col("directionality") != "~~").alias("__directed"))
    ends = ends.join(names.select(F.col(NAME).alias("__a"), F.col(ID).alias(SRC)), "__a").join(names.select(F.col(NAME).alias("__b"), F.col(ID).alias(DST)), "__b").drop("__a", "__b")
    ends = _numbered(ends, g.next_code(), EID)
    rows = parsed(ends).select(EID, SRC, DST, NAME, "__labels", "__v", "__directed")
    for directed in (True, False):
        for k, (labels, schema, part) in enumerate(_by_labels(rows.filter(F.col("__directed") == directed).drop("__directed"))):
            g.edges.append(EdgeTable(f"e{k}{'>' if directed else '~'}:{'&'.join(sorted(labels))}", labels, written(_typed_props(part, schema), "edges"), directed))
    return g


def graph_from_json(spark: SparkSession, path: str) -> PropertyGraph:
    """A file of {"nodes": [...], "edges": [...]}."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", GRAPH_SCHEMA).alias("g"))
    return graph_from_elements(spark, whole.select(F.explode("g.nodes").alias("x")).select("x.*"), whole.select(F.explode("g.edges").alias("x")).select("x.*"))


def graph_from_json_text(spark: SparkSession, text: str) -> PropertyGraph:
    whole = spark.createDataFrame([(text,)], "value string").select(F.from_json("value", GRAPH_SCHEMA).alias("g"))
    return graph_from_elements(spark, whole.select(F.explode("g.nodes").alias("x")).select("x.*"), whole.select(F.explode("g.edges").alias("x")).select("x.*"))


# ---- tables of named nodes


def _graph_from_tables(spark: SparkSession, nodes: list[tuple[str, str, DataFrame]], edges: list[tuple[str, DataFrame, bool]]) -> PropertyGraph:
    """nodes: (type, label, df(__name, props)); a name in several of them has all their labels.
    edges: (label, df(__a, __b, props), directed); rows with an unknown end are dropped."""
    g = PropertyGraph(spark)
    named = reduce(DataFrame.unionByName, [df.select(NAME, F.lit(label).alias("l")) for _, label, df in nodes])
    sets = named.groupBy(NAME).agg(F.array_sort(F.collect_set("l")).alias("__labels"))
    ids = _numbered(sets, g.next_code(), ID)
    for r in sorted(ids.select("__labels").distinct().collect(), key=lambda r: r["__labels"]):
        labels = r["__labels"]
        own = ids.filter(F.col("__labels") == F.array(*[F.lit(x) for x in labels])).drop("__labels")
        for _, label, df in nodes:
            if label in labels:
                props = df.dropDuplicates([NAME])
                clash = [c for c in props.columns if c in own.columns and c != NAME]
                joined = own.join(props.select(NAME, *[F.col(c).alias(f"__new {c}") if c in clash else F.col(c) for c in props.columns if c != NAME]), NAME, "left")
                own = joined.withColumns({c: F.coalesce(c, F.col(f"`__new {c}`")) for c in clash}).drop(*[f"__new {c}" for c in clash]) if clash else joined
        g.nodes.append(NodeTable("&".join(labels), frozenset(labels), own))
    for label, df, directed in edges:
        ends = df.join(ids.select(F.col(NAME).alias("__a"), F.col(ID).alias(SRC)), "__a").join(ids.select(F.col(NAME).alias("__b"), F.col(ID).alias(DST)), "__b")
        g.edges.append(EdgeTable(label, frozenset((label,)), _numbered(ends.drop("__a", "__b"), g.next_code(), EID), directed))
    return g


# ---- CSV files and a configuration of their columns


def id_column(columns: Iterable[str], label: str) -> str:
    columns = list(columns)
    lower = {c.lower(): c for c in columns}
    for want in ("vid", f"{label.lower()}_id"):
        if want in lower:
            return lower[want]
    return next((c for c in columns if c.lower().endswith("_id")), columns[0])


def edge_label(stem: str, node_types: list[str]) -> str:
    """The file's stem without a node type at its beginning and one at its end."""
    for side in ("left", "right"):
        for t in sorted(node_types, key=len, reverse=True):
            low, cut = stem.lower(), f"{t.lower()}_" if side == "left" else f"_{t.lower()}"
            if side == "left" and low.startswith(cut) and len(low) > len(cut):
                stem = stem[len(cut) :]
                break
            if side == "right" and low.endswith(cut) and len(low) > len(cut):
                stem = stem[: -len(cut)]
                break
    return stem


def _typed(name: str, kind: str):
    text = F.nullif(F.col(f"`{name}`"), F.lit(""))
    kind = kind.upper()
    if kind.startswith("INT"):
        return text.try_cast("bigint").alias(name)
    if kind.startswith("FLOAT") or kind == "DOUBLE":
        return text.try_cast("double").alias(name)
    if kind.startswith("BOOL"):
        return text.try_cast("boolean").alias(name)
    return text.alias(name)


def graph_from_csv(spark: SparkSession, folder: str) -> PropertyGraph:
    """The CSV files that ``spanner_import_config.json`` in the folder lists, with a header each."""
    config = json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/spanner_import_config.json").collect()))
    nodes, edges, types = [], [], []
    read = lambda path: spark.read.csv(f"{folder}/{path}", header=True, multiLine=True, escape='"')
    plain = [f for f in config["files"] if not {"src_id", "dst_id"} <= {c.lower() for c in f["columns"]}]
    for f in plain:
        stem = PurePosixPath(f["path"]).stem
        label = f.get("label") or stem
        types.append(label)
        key = id_column(f["columns"], label)
        rows = read(f["path"]).filter(F.coalesce(F.col(f"`{key}`"), F.lit("")) != "")
        nodes.append((label, label, rows.select(F.col(f"`{key}`").alias(NAME), *[_typed(c, t) for c, t in f["columns"].items() if c != key])))
    for f in config["files"]:
        if f in plain:
            continue
        lower = {c.lower(): c for c in f["columns"]}
        a, b = lower["src_id"], lower["dst_id"]
        label = f.get("label") or edge_label(PurePosixPath(f["path"]).stem, types)
        props = [_typed(c, t) for c, t in f["columns"].items() if c not in (a, b)]
        edges.append((label, read(f["path"]).select(F.col(f"`{a}`").alias("__a"), F.col(f"`{b}`").alias("__b"), *props), True))
    return _graph_from_tables(spark, nodes, edges)


# ---- pipe-separated files, one for each node type, edge type and multi-valued property


def _inferred(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns as whole numbers, numbers or booleans where all their values are; else text."""
    tests = {}
    for c in names:
        text = F.nullif(F.col(f"`{c}`"), F.lit(""))
        tests[f"i {c}"] = F.bool_and(text.isNull() | text.try_cast("bigint").isNotNull())
        tests[f"d {c}"] = F.bool_and(text.isNull() | text.try_cast("double").isNotNull())
        tests[f"b {c}"] = F.bool_and(text.isNull() | text.isin("true", "false"))
    got = df.agg(*[t.alias(n) for n, t in tests.items()]).first() if tests else {}
    kind = lambda c: "INT64" if got[f"i {c}"] else "FLOAT64" if got[f"d {c}"] else "BOOL" if got[f"b {c}"] else "STRING"
    return df.withColumns({c: _typed(c, kind(c)) for c in names})


def graph_from_ldbc(spark: SparkSession, folder: str) -> PropertyGraph:
    """Files such as person_0_0.csv (nodes), person_knows_person_0_0.csv (edges; knows is undirected)
    and person_email_emailaddress_0_0.csv (lists of values); a ``type`` column gives a second label."""
    files = [r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(folder).select("path").collect()]
    read = lambda path: spark.read.csv(path, header=True, sep="|")
    stems: dict[tuple[str, ...], list[str]] = {}  # the files that hold one kind of rows, read together
    for f in sorted(files):
        stems.setdefault(tuple(re.sub(r"(_\d+)+$", "", PurePosixPath(f).stem).split("_")), []).append(f)
    types = {s[0] for s in stems if len(s) == 1}
    nodes: list[tuple[str, str, DataFrame]] = []
    edges: list[tuple[str, DataFrame, bool]] = []
    key = lambda t, c: F.concat(F.lit(f"{t}:"), c)
    capital = lambda t: t[:1].upper() + t[1:]
    lists: dict[str, list[tuple[str, DataFrame]]] = {}
    for s, f in stems.items():
        if len(s) == 3 and s[2] not in types:
            df = read(f)
            a, b = df.columns[:2]
            values = df.select(key(s[0], F.col(f"`{a}`")).alias(NAME), F.col(f"`{b}`").alias("v")).groupBy(NAME).agg(F.array_sort(F.collect_list("v")).alias(s[1]))
            lists.setdefault(s[0], []).append((s[1], values))
    for s, f in sorted(stems.items()):
        if len(s) == 1:
            df = read(f)
            names = [c for c in df.columns if c != "type"]
            typed = _inferred(df, names).withColumn(NAME, key(s[0], F.col("id").cast("string")))
            for _, values in lists.get(s[0], []):
                typed = typed.join(values, NAME, "left")
            label = capital(s[0])
            nodes.append((s[0], label, typed.drop("type") if "type" in df.columns else typed))
            if "type" in df.columns:
                for r in df.select(F.lower("type").alias("t")).distinct().filter("t is not null").collect():
                    nodes.append((s[0], capital(r["t"]), typed.filter(F.lower("type") == r["t"]).select(NAME)))
        elif len(s) == 3 and s[0] in types and s[2] in types:
            df = read(f)
            a, b = df.columns[:2]
            rest = df.columns[2:]
            unique = df.toDF("__x", "__y", *rest)
            out = _inferred(unique, rest).select(key(s[0], F.col("__x")).alias("__a"), key(s[2], F.col("__y")).alias("__b"), *[F.col(f"`{c}`") for c in rest])
            edges.append((s[1], out, s[1] != "knows"))
    if not nodes:
        raise GqlError(f"no node files in {folder}")
    return _graph_from_tables(spark, nodes, edges)


# ---- edge lists and triples


def graph_from_edge_list(spark: SparkSession, path: str, node_label: str = "Node", label: str = "LINK") -> PropertyGraph:
    """Lines of two numbers apart by white space; lines that begin with # are comments."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.get(parts, F.lit(0)).try_cast("bigint").alias("a"), F.get(parts, F.lit(1)).try_cast("bigint").alias("b")).filter("a is not null and b is not null")
    g = PropertyGraph(spark)
    node, edge = g.next_code(), g.next_code()
    keys = rows.select(F.col("a").alias("id")).unionByName(rows.select(F.col("b").alias("id"))).distinct()
    g.nodes.append(NodeTable(node_label, frozenset((node_label,)), keys.select((F.lit(node << 48) + F.col("id")).alias(ID), "id")))
    ends = rows.select((F.lit(node << 48) + F.col("a")).alias(SRC), (F.lit(node << 48) + F.col("b")).alias(DST))
    g.edges.append(EdgeTable(label, frozenset((label,)), _numbered(ends, edge, EID), True, frozenset((node_label,)), frozenset((node_label,))))
    return g


_TRIPLE = r"^\s*(\S+)\s+(\S+)\s+(.+?)\s*\.\s*$"
_VECTOR = r'^"\[(.*)\]"'


def local_name(term):
    """What follows the last #, / or : of an IRI or a prefixed name."""
    return F.regexp_extract(F.regexp_replace(term, r"[<>]", ""), r"([^#/:]*)$", 1)


def graph_from_triples(spark: SparkSession, path: str, node_label: str = "img", id_prop: str = "id", vectors: str | None = None, metric: str = "L2Sq") -> PropertyGraph:
    """N-Triples, or Turtle with one triple a line: resources become nodes with their integer local
    names, predicates become edge labels. Triples with a literal are skipped; float lists of the file
    ``vectors`` become vectors under their predicate's local name."""
    line = F.col("value")
    rows = spark.read.text(path).filter(line.rlike(_TRIPLE) & ~line.startswith("@") & ~line.startswith("#"))
    rows = rows.select(*[F.regexp_extract("value", _TRIPLE, k).alias(n) for k, n in ((1, "s"), (2, "p"), (3, "o"))]).filter(~F.col("o").startswith('"'))
    rows = rows.select(local_name(F.col("s")).try_cast("bigint").alias("s"), local_name(F.col("p")).alias("p"), local_name(F.col("o")).try_cast("bigint").alias("o")).filter("s is not null and o is not null")
    g = PropertyGraph(spark)
    node = g.next_code()
    keys = rows.select(F.col("s").alias(id_prop)).unionByName(rows.select(F.col("o").alias(id_prop))).distinct()
    nid = lambda c: F.lit(node << 48) + F.col(c)
    g.nodes.append(NodeTable(node_label, frozenset((node_label,)), keys.select(nid(id_prop).alias(ID), id_prop)))
    rows = _numbered(rows.select(nid("s").alias(SRC), nid("o").alias(DST), "p"), g.next_code(), EID)
    for r in sorted(rows.select("p").distinct().collect()):
        g.edges.append(EdgeTable(r["p"], frozenset((r["p"],)), rows.filter(F.col("p") == r["p"]).drop("p"), True, frozenset((node_label,)), frozenset((node_label,))))
    if vectors:
        lists = spark.read.text(vectors).filter(line.rlike(_TRIPLE)).select(*[F.regexp_extract("value", _TRIPLE, k).alias(n) for k, n in ((1, "s"), (2, "p"), (3, "o"))])
        lists = lists.select(local_name(F.col("s")).try_cast("bigint").alias(id_prop), local_name(F.col("p")).alias("p"), F.split(F.regexp_extract("o", _VECTOR, 1), r"\s*,\s*").cast("array<float>").alias("vector"))
        for r in sorted(lists.select("p").distinct().collect()):
            mine = lists.filter(F.col("p") == r["p"]).select(nid(id_prop).alias(ID), "vector")
            first = mine.first()
            g.vectors[r["p"]] = (mine, len(first["vector"]) if first else 0, metric)
    return g


def vectors_from_csv(spark: SparkSession, g: PropertyGraph, path: str, label: str, prop: str, attr: str, metric: str = "L2Sq") -> None:
    """Adds the vectors of a CSV file (key, v0, v1, ...) to the nodes whose property is the key."""
    df = spark.read.csv(path, header=False)
    values = F.array(*[F.col(c).cast("float") for c in df.columns[1:]])
    rows = df.select(F.col(df.columns[0]).alias("__k"), values.alias("vector"))
    nodes = reduce(DataFrame.unionByName, [t.df.select(ID, F.col(prop).cast("string").alias("__k")) for t in g.nodes if label in t.labels and prop in t.props])
    g.vectors[attr] = (written(nodes.join(rows, "__k").select(ID, "vector"), "vectors"), len(df.columns) - 1, metric)


__all__ = ["T", "graph_from_csv", "graph_from_edge_list", "graph_from_elements", "graph_from_json", "graph_from_json_text", "graph_from_ldbc", "graph_from_triples", "vectors_from_csv"]
