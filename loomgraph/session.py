"""The entry point: a graph, its catalog and the statements that run on it."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog as C
from .catalog import DEFAULT, Catalog
from .changes import apply_change
from .graph import DST, EID, ID, SRC, PropertyGraph
from .lang.lexer import GqlError
from .lang.parser import parse
from .lang.tree import Change, Ddl, Query
from .operators.vector_index import build_cells
from .plans.query import Planned, plan_query
from .sources import files, store


class GraphSession:
    """Runs GQL on a property graph.

    Queries give lazy DataFrames. Changes replace the graph's tables at once and live in this session
    until ``save``; a change that fails undoes everything since the last save.
    """

    def __init__(self, spark: SparkSession, graph: PropertyGraph | None = None, path: str | None = None, catalog: Catalog | None = None):
        self.spark, self.path = spark, path
        self.graph = graph or PropertyGraph(spark)
        self.catalog = catalog or Catalog()
        self.warnings: list[str] = []
        self.timeout: float | None = None
        self._saved = (self.graph.copy(), Catalog.from_json(self.catalog.to_json()))

    # -- opening and saving

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> GraphSession:
        """A saved graph; an empty one if there is none at the path."""
        if not store._fs(spark, path)[0].exists(store._fs(spark, path)[1]):
            return cls(spark, path=path)
        graph, meta = store.open_graph(spark, path)
        return cls(spark, graph, path, Catalog.from_json(meta))

    @classmethod
    def import_json(cls, spark: SparkSession, source: str, path: str | None = None) -> GraphSession:
        return cls(spark, files.graph_from_json(spark, source), path)

    @classmethod
    def import_json_str(cls, spark: SparkSession, text: str, path: str | None = None) -> GraphSession:
        return cls(spark, files.graph_from_json_text(spark, text), path)

    @classmethod
    def import_csv(cls, spark: SparkSession, folder: str, path: str | None = None) -> GraphSession:
        return cls(spark, files.graph_from_csv(spark, folder), path)

    def save(self, path: str | None = None) -> None:
        path = path or self.path
        if path is None:
            raise GqlError("there is no path to save to")
        store.save_graph(self.graph, path, self.catalog.to_json())
        graph, _ = store.open_graph(self.spark, path)
        graph.codes = self.graph.codes
        self.graph, self.path = graph, path
        self._saved = (self.graph.copy(), Catalog.from_json(self.catalog.to_json()))

    # -- statements

    def plan(self, text: str, limit: int | None = None) -> Planned:
        q = parse(text)
        if not isinstance(q, Query):
            raise GqlError("only queries are planned")
        return plan_query(self.graph, q, limit)

    def check(self, text: str) -> list[str]:
        """The query's warnings; raises on errors. Nothing is run but what a path search needs."""
        return self.plan(text).warnings

    def explain(self, text: str) -> str:
        return self.plan(text).df._jdf.queryExecution().toString()

    def execute(self, text: str, limit: int = 0) -> DataFrame:
        """The rows of a statement; ``limit`` 0 is no limit."""
        statement = parse(text)
        if isinstance(statement, Query):
            planned = plan_query(self.graph, statement, limit or None)
            self.warnings = planned.warnings
            return planned.df
        if isinstance(statement, Change):
            return self._change(statement)
        return self._ddl(statement)

    def query_sparql(self, text: str, mapping=None) -> DataFrame:
        from .sparql import translate

        return plan_query(self.graph, translate(text, mapping)).df

    def set_timeout(self, seconds: float | None) -> None:
        """The most that a statement run by ``run_in_group`` may take; None is no limit."""
        self.timeout = seconds

    def cancel(self) -> None:
        """Stops the jobs of this session's thread group; see ``run_in_group``."""
        self.spark.sparkContext.cancelJobGroup(f"loomgraph-{id(self)}")

    def run_in_group(self, text: str, limit: int = 0) -> list:
        """Collects a statement's rows as a job group that ``cancel`` (from another thread) stops."""
        self.spark.sparkContext.setJobGroup(f"loomgraph-{id(self)}", text[:200], True)
        timer = threading.Timer(self.timeout, self.cancel) if self.timeout else None
        if timer:
            timer.start()
        try:
            return self.execute(text, limit).collect()
        finally:
            if timer:
                timer.cancel()

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _change(self, c: Change) -> DataFrame:
        try:
            graph, returned = apply_change(self.graph, c)
            if self.catalog.active != DEFAULT and c.kind != "DELETE":
                found = C.violations(graph, C.require(self.catalog, self.catalog.active))
                if found:
                    raise GqlError("G2000 graph type violation: " + "; ".join(found))
        except Exception:
            self.graph = self._saved[0].copy()
            self.catalog = Catalog.from_json(self._saved[1].to_json())
            raise
        self.graph = graph
        return returned if returned is not None else self._rows([], "ok boolean")

    def _type(self, name: str) -> list:
        return C.infer(self.graph) if name == DEFAULT else C.require(self.catalog, name)

    def _ddl(self, d: Ddl) -> DataFrame:
        cat = self.catalog
        if d.kind == "create type":
            if d.name in cat.types:
                raise GqlError(f"graph type {d.name} exists")
            cat.types[d.name] = d.body
            return self._rows([(f"GRAPH TYPE '{d.name}' created",)], "status string")
        if d.kind == "use type":
            if d.name != DEFAULT:
                C.require(cat, d.name)
            cat.active = d.name
            return self._rows([(f"Active GRAPH TYPE: {d.name}",)], "status string")
        if d.kind == "drop type":
            C.require(cat, d.name)
            del cat.types[d.name]
            cat.active = DEFAULT if cat.active == d.name else cat.active
            return self._rows([(f"GRAPH TYPE '{d.name}' dropped",)], "status string")
        if d.kind == "show types":
            return self._rows([(n, n == cat.active) for n in (DEFAULT, *sorted(cat.types))], "name string, active boolean")
        if d.kind in ("show type", "show current type"):
            name = d.name or cat.active
            return self._rows([(e[0], C.element_text(e)) for e in self._type(name)], "kind string, type string")
        if d.kind == "validate type":
            return self._rows([(x,) for x in C.violations(self.graph, self._type(d.name))], "violation string")
        if d.kind == "create index":
            if d.name in cat.indexes:
                raise GqlError(f"index {d.name} exists")
            cat.indexes[d.name] = d.body
            return self._rows([(f"INDEX '{d.name}' created",)], "status string")
        if d.kind == "drop index":
            if d.name not in cat.indexes:
                raise GqlError(f"there is no index {d.name}")
            del cat.indexes[d.name]
            return self._rows([(f"INDEX '{d.name}' dropped",)], "status string")
        rows = [(n, label, prop, kind, "declared") for n, (label, prop, kind) in sorted(cat.indexes.items())]
        rows += [(f"auto_{label}_{prop}", label, prop, "HASH", "automatic") for label, prop in C.unique_properties(self.graph)]
        return self._rows(rows, "name string, label string, property string, kind string, origin string")

    # -- the graph itself

    @property
    def node_count(self) -> int:
        return self.graph.node_count()

    @property
    def edge_count(self) -> int:
        return self.graph.edge_count()

    def schema(self) -> dict[str, int]:
        """Labels in use and how many elements have them."""
        return self.graph.labels()

    def graph_types(self) -> list[str]:
        return [DEFAULT, *sorted(self.catalog.types)]

    def node(self, node_id: int) -> DataFrame:
        """The node as (id, labels, props JSON)."""
        return store._elements(self.graph.nodes, [ID], lambda t: []).filter(F.col(ID) == node_id)

    def edge(self, edge_id: int) -> DataFrame:
        return store._elements(self.graph.edges, [EID, SRC, DST], lambda t: [F.lit(t.directed).alias("directed")]).filter(F.col(EID) == edge_id)

    def index_vectors(self, attr: str, cells: int | None = None, probes: int | None = None) -> None:
        """Makes NEAREST on the attribute approximate: a search opens ``probes`` of ``cells`` cells, and more
        only where these hold too few of the matched nodes."""
        if attr not in self.graph.vectors:
            raise GqlError(f"there are no vectors {attr}")
        found = build_cells(*self.graph.vectors[attr], cells, probes)
        if found is not None:
            self.graph.cells[attr] = found

    def drop_vector_index(self, attr: str) -> None:
        self.graph.cells.pop(attr, None)

    def to_json(self) -> str:
        return store.dump_json(self.graph)

    def to_gql(self) -> str:
        return store.dump_gql(self.graph)
