"""Graph types: what labels, properties and ends a graph's elements may have; and declared indexes.

The reserved type DEFAULT is inferred from the data. A declared type that is in use is checked against
what statements insert or change.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from .graph import DST, ID, SRC, EdgeTable, NodeTable, PropertyGraph, kind_of
from .lang.lexer import GqlError

DEFAULT = "DEFAULT"
TYPE_WORDS = {"int": "INT", "float": "FLOAT", "str": "STRING", "bool": "BOOL", "list": "LIST", "record": "RECORD", "null": "NULL", "any": "ANY", "date": "DATE", "datetime": "LOCAL_DATETIME", "mixed": "ANY"}
#: Violations of each kind that a validation reports at most.
SAMPLES = 16

#: ("node", labels, (fields, open)) or ("edge", labels, (fields, open), source, target, directed)
ElementType = tuple


@dataclass
class Catalog:
    types: dict[str, list[ElementType]] = field(default_factory=dict)
    active: str = DEFAULT
    indexes: dict[str, tuple[str, str, str]] = field(default_factory=dict)

    def to_json(self) -> dict:
        plain = lambda x: sorted(x) if isinstance(x, frozenset) else [plain(y) for y in x] if isinstance(x, (list, tuple)) else {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x
        return {"types": {n: plain(t) for n, t in self.types.items()}, "active": self.active, "indexes": {n: list(x) for n, x in self.indexes.items()}}

    @staticmethod
    def from_json(data: dict) -> Catalog:
        def element(x: list) -> ElementType:
            record = lambda r: ({k: frozenset(v) for k, v in r[0].items()}, r[1])
            if x[0] == "node":
                return ("node", frozenset(x[1]), record(x[2]))
            return ("edge", frozenset(x[1]), record(x[2]), (frozenset(x[3][0]), record(x[3][1])), (frozenset(x[4][0]), record(x[4][1])), x[5])

        return Catalog({n: [element(x) for x in t] for n, t in data.get("types", {}).items()}, data.get("active", DEFAULT), {n: tuple(x) for n, x in data.get("indexes", {}).items()})


def _record_of(t: NodeTable | EdgeTable) -> tuple[dict[str, frozenset[str]], bool] | None:
    """The table's properties and kinds; NULL where some rows lack one. None for an empty table."""
    props = t.props
    counts = t.df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(f"`{p}`")).alias(p) for p in props]).first()
    if not counts["__n"]:
        return None
    fields: dict[str, frozenset[str]] = {}
    for p, dt in sorted(props.items()):
        if not counts[p]:
            continue
        kinds = {r[0] for r in t.df.select(F.col(f"`{p}`.kind")).distinct().collect() if r[0]} if kind_of(dt) == "mixed" else {kind_of(dt)}
        fields[p] = frozenset(kinds | ({"null"} if counts[p] < counts["__n"] else set()))
    return fields, False


def infer(g: PropertyGraph) -> list[ElementType]:
    """One node type for each label set, one edge type for each label set and pair of ends."""
    out: list[ElementType] = []
    for t in g.nodes:
        record = _record_of(t)
        if record is not None:
            out.append(("node", t.labels, record))
    by_name = {t.name: t.labels for t in g.nodes}
    for t in g.edges:
        record = _record_of(t)
        if record is None:
            continue
        ends = {(by_name[a], by_name[b]) for a in t.src for b in t.dst} if t.src and t.dst and len(t.src) == len(t.dst) == 1 else _ends(g, t)
        for a, b in sorted(ends, key=lambda x: (sorted(x[0]), sorted(x[1]))):
            out.append(("edge", t.labels, record, (a, ({}, True)), (b, ({}, True)), t.directed))
    return out


def _labels_by_id(g: PropertyGraph):
    from functools import reduce

    from pyspark.sql import DataFrame

    return reduce(DataFrame.unionByName, [t.df.select(ID, F.array(*[F.lit(x) for x in sorted(t.labels)]).cast("array<string>").alias("labels")) for t in g.nodes])


def _ends(g: PropertyGraph, t: EdgeTable) -> set[tuple[frozenset[str], frozenset[str]]]:
    ids = _labels_by_id(g)
    j = t.df.select(SRC, DST).join(ids.toDF(SRC, "a"), SRC).join(ids.toDF(DST, "b"), DST).select("a", "b").distinct()
    return {(frozenset(r["a"]), frozenset(r["b"])) for r in j.collect()}


def record_text(record: tuple) -> str:
    fields, is_open = record
    parts = [f"{k} {' | '.join(sorted((TYPE_WORDS[x] for x in v), key=lambda w: w == 'NULL'))}" for k, v in sorted(fields.items())]
    return "{" + ", ".join(parts + (["*"] if is_open and fields else [])) + "}"


def element_text(e: ElementType) -> str:
    label = lambda x: ":" + "&".join(sorted(x)) if x else ""
    body = " ".join(x for x in (label(e[1]), record_text(e[2]) if e[2][0] or not e[2][1] else "") if x)
    if e[0] == "node":
        return f"({body})"
    left, right = f"({label(e[3][0])})", f"({label(e[4][0])})"
    return f"{left}-[{body}]->{right}" if e[5] else f"{left}~[{body}]~{right}"


def violations(g: PropertyGraph, types: list[ElementType]) -> list[str]:
    """Elements that no type of the list describes: labels must be equal, properties of a listed kind."""
    out: list[str] = []
    nodes = [t for t in types if t[0] == "node"]
    edges = [t for t in types if t[0] == "edge"]
    for t in g.nodes:
        out += _table_violations(t, [x for x in nodes if x[1] == t.labels], "node")
    for t in g.edges:
        same = [x for x in edges if x[1] == t.labels and x[5] == t.directed]
        out += _table_violations(t, same, "edge")
        if same and not t.df.isEmpty():
            allowed = {(x[3][0], x[4][0]) for x in same} | ({(x[4][0], x[3][0]) for x in same if not x[5]})
            for a, b in _ends(g, t):
                if (a, b) not in allowed:
                    out.append(f"edge {sorted(t.labels)} joins {sorted(a)} and {sorted(b)}")
    return out[: 2 * SAMPLES]


def _table_violations(t: NodeTable | EdgeTable, types: list[ElementType], what: str) -> list[str]:
    if t.df.isEmpty():
        return []
    if not types:
        return [f"{what} with labels {sorted(t.labels)} is of no type"]
    problems: list[list[str]] = []
    for x in types:
        fields, is_open = x[2]
        found = []
        for p, dt in t.props.items():
            c = F.col(f"`{p}`")
            if p not in fields:
                if not is_open and not t.df.filter(c.isNotNull()).isEmpty():
                    found.append(f"{what} {sorted(t.labels)} has a property {p} that its type lacks")
                continue
            kinds = fields[p]
            if "any" in kinds:
                continue
            fits = c["kind"].isin(list(kinds)) if kind_of(dt) == "mixed" else F.lit(kind_of(dt) in kinds)
            if not t.df.filter(c.isNotNull() & ~fits).isEmpty():
                found.append(f"{what} {sorted(t.labels)}: {p} is not {' | '.join(sorted(TYPE_WORDS[k] for k in kinds))}")
        for p, kinds in fields.items():
            if not kinds & {"null", "any"}:
                missing = True if p not in t.props else not t.df.filter(F.col(f"`{p}`").isNull()).isEmpty()
                if missing:
                    found.append(f"{what} {sorted(t.labels)} lacks {p}")
        if not found:
            return []
        problems.append(found)
    return min(problems, key=len)


def unique_properties(g: PropertyGraph) -> list[tuple[str, str]]:
    """(label, property) pairs that every node of the label has with a value of its own."""
    out = []
    for t in g.nodes:
        names = sorted(t.props)
        if not names:
            continue
        # estimates in one pass leave few candidates; only these are counted exactly, in another
        column = lambda p: F.col(f"`{p}`")
        sums = [x for p in names for x in (F.count(column(p)), F.approx_count_distinct(F.to_json(F.struct(column(p)))))]
        n, *found = t.df.agg(F.count(F.lit(1)), *sums).first()
        likely = [p for k, p in enumerate(names) if n and found[2 * k] == n and found[2 * k + 1] >= 0.8 * n]
        exact = t.df.agg(*[F.count_distinct(column(p)) for p in likely]).first() if likely else []
        out += [(label, p) for p, distinct in zip(likely, exact, strict=True) if distinct == n for label in sorted(t.labels)]
    return out


def require(catalog: Catalog, name: str) -> list[ElementType]:
    if name not in catalog.types:
        raise GqlError(f"there is no graph type {name}")
    return catalog.types[name]
