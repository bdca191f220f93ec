"""SPARQL SELECT queries as GQL syntax trees.

Resources are nodes that hold their key in a property; a predicate is an edge label. Supported are
basic graph patterns, OPTIONAL, UNION of branches with the same variables, FILTER, property paths,
grouping by variables, aggregates, ORDER BY (unbound first) and LIMIT; anything else is refused by name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .lang.lexer import GqlError
from .lang.tree import (
    Agg, Attr, Bin, Call, Case, Concat, EdgeP, Exists, Expr, IsNull, Item, Join, Lit, ListLit, Match, NodeP, Pattern, Prefix, Query, Repeat, Selected, SortKey, Un, UnionP, Var, label_names,
)

# What a query may not contain.
REFUSED = ("OFFSET", "ASK", "CONSTRUCT", "DESCRIBE", "FROM", "GRAPH", "SERVICE", "MINUS", "VALUES", "BIND", "HAVING", "GROUP_CONCAT")
XSD_NUMBERS = {"integer": int, "int": int, "long": int, "decimal": float, "double": float, "float": float}


@dataclass(frozen=True)
class Mapping:
    """How resources are laid out: edge labels are whole IRIs or local names; the node's key property
    has the IRI or its integer local name; nodes may all have one label. ``properties`` are predicates
    that read a node's property instead of following an edge."""

    local_predicates: bool = False
    key: str = "iri"
    integer_key: bool = False
    node_label: str | None = None
    properties: frozenset[str] = frozenset()

    @staticmethod
    def of_triples(label: str = "img", key: str = "id") -> Mapping:
        return Mapping(True, key, True, label)


def local_name(iri: str) -> str:
    return re.split(r"[#/:]", iri.rstrip("/"))[-1]


_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|<(?P<iri>[^<>"{}|^`\\\s]*)>|[?$](?P<var>\w+)|"(?P<str>(?:[^"\\]|\\.)*)"|'(?P<str2>[^']*)'
    |(?P<num>[+-]?\d+\.\d*(?:[eE][+-]?\d+)?|[+-]?\.\d+|[+-]?\d+(?:[eE][+-]?\d+)?)|(?P<pname>[A-Za-z_][\w-]*)?:(?P<plocal>[\w-]*)|(?P<word>[A-Za-z_]\w*)
    |(?P<sym>\^\^|&&|\|\||!=|<=|>=|[{}().;,*/+|^!?<>=-])""",
    re.VERBOSE,
)


@dataclass
class _Tok:
    kind: str
    text: str


def _tokens(text: str) -> list[_Tok]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise GqlError(f"unexpected {text[at]!r} at {at}")
        at = m.end()
        if m["space"] is not None:
            continue
        if m["iri"] is not None:
            out.append(_Tok("iri", m["iri"]))
        elif m["var"] is not None:
            out.append(_Tok("var", m["var"]))
        elif m["str"] is not None:
            out.append(_Tok("str", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m["str"])))
        elif m["str2"] is not None:
            out.append(_Tok("str", m["str2"]))
        elif m["num"] is not None:
            out.append(_Tok("num", m["num"]))
        elif m["plocal"] is not None:
            out.append(_Tok("pname", f"{m['pname'] or ''}:{m['plocal']}"))
        elif m["word"] is not None:
            out.append(_Tok("word", m["word"]))
        else:
            out.append(_Tok("sym", m["sym"]))
    return [*out, _Tok("end", "")]


@dataclass
class _Group:
    """One group: what must match, and the optional parts in order."""

    patterns: list[Pattern] = field(default_factory=list)
    filters: list[Expr] = field(default_factory=list)
    optionals: list["_Group"] = field(default_factory=list)
    variables: set[str] = field(default_factory=set)  # that denote nodes
    values: dict[str, Expr] = field(default_factory=dict)  # variables that stand for a property


class _Sparql:
    def __init__(self, text: str, mapping: Mapping):
        self.tokens, self.at, self.mapping = _tokens(text), 0, mapping
        self.prefixes: dict[str, str] = {}
        self.constants: dict[str, str] = {}
        self.values: dict[str, Expr] = {}
        self.labels: dict[str, list[str]] = {}
        self.names = 0
        self.seen_predicates: set[str] = set()

    @property
    def now(self) -> _Tok:
        return self.tokens[self.at]

    def word(self, *words: str) -> bool:
        if all(self.tokens[min(self.at + k, len(self.tokens) - 1)].kind == "word" and self.tokens[self.at + k].text.upper() == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def sym(self, text: str) -> bool:
        if self.now.kind == "sym" and self.now.text == text:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not (self.sym(text) or self.word(text)):
            raise GqlError(f"expected {text!r}, got {self.now.text or 'the end'!r}")

    def take(self, kind: str) -> str:
        if self.now.kind != kind:
            raise GqlError(f"expected a {kind}, got {self.now.text or 'the end'!r}")
        self.at += 1
        return self.tokens[self.at - 1].text

    def refuse(self) -> None:
        if self.now.kind == "word" and self.now.text.upper() in REFUSED:
            raise GqlError(f"{self.now.text.upper()} is not supported")

    def fresh(self) -> str:
        self.names += 1
        return f"__x{self.names}"

    # -- query

    def query(self) -> Query:
        while True:
            if self.word("PREFIX"):
                name = self.take("pname").rstrip(":")
                self.prefixes[name] = self.take("iri")
            elif self.word("BASE"):
                self.take("iri")
            else:
                break
        self.refuse()
        self.need("SELECT")
        distinct = self.word("DISTINCT")
        self.word("REDUCED")
        chosen: list[tuple[str, object]] | None = None if self.sym("*") else []
        select_at = self.at
        if chosen is not None:
            while self.now.kind == "var" or (self.now.kind == "sym" and self.now.text == "("):
                if self.now.kind == "var":
                    self.at += 1
                else:
                    self._skip()
        self.refuse()
        self.word("WHERE")
        group = self.group()
        after = self.at
        self.at = select_at
        items: list[Item] = []
        if chosen is None:
            names = sorted(self._named(group))
            items = [Item(self.variable(n), n) for n in names]
        else:
            while self.now.kind == "var" or (self.now.kind == "sym" and self.now.text == "("):
                if self.now.kind == "var":
                    n = self.take("var")
                    items.append(Item(self.variable(n), n))
                else:
                    self.need("(")
                    e = self.expr()
                    self.need("AS")
                    items.append(Item(e, self.take("var")))
                    self.need(")")
        self.at = after
        q = Query(self.matches(group), returns=items, distinct=distinct)
        if self.word("GROUP", "BY"):
            keys = []
            while self.now.kind == "var":
                keys.append(self.variable(self.take("var")))
            if not keys:
                raise GqlError("GROUP BY takes variables")
            q.group_by = keys
        self.refuse()
        if self.word("ORDER", "BY"):
            aliases = {i.alias: i.expr for i in items}
            while True:
                descending = self.word("DESC")
                wrapped = descending or self.word("ASC")
                if self.now.kind == "var" and not wrapped:
                    n = self.take("var")
                    e = aliases.get(n) or self.variable(n)
                elif self.sym("("):
                    e = Var(self.tokens[self.at].text) if self.now.kind == "var" and self.now.text in aliases and not isinstance(aliases[self.now.text], (Var, Attr)) else None
                    if e is not None:
                        e = aliases[self.take("var")]
                    else:
                        e = self.expr()
                    self.need(")")
                else:
                    break
                q.order_by.append(SortKey(e, descending, nulls_first=not descending))
        self.refuse()
        if self.word("LIMIT"):
            q.limit = int(self.take("num"))
        self.refuse()
        if self.now.kind != "end":
            raise GqlError(f"unexpected {self.now.text!r}")
        return q

    def _skip(self) -> None:
        depth = 0
        while True:
            if self.now.kind == "end":
                raise GqlError("unclosed parenthesis")
            depth += (self.now.text == "(") - (self.now.text == ")") if self.now.kind == "sym" else 0
            self.at += 1
            if not depth:
                return

    def _named(self, g: _Group) -> set[str]:
        out = {v for v in g.variables if not v.startswith("__")} | set(g.values)
        for o in g.optionals:
            out |= self._named(o)
        return out

    def variable(self, name: str) -> Expr:
        """A variable reads its node's key, or the property that it stands for."""
        return self.values[name] if name in self.values else Attr(Var(name), self.mapping.key)

    def matches(self, g: _Group) -> list[Match]:
        where = _all(g.filters)
        patterns = g.patterns or [NodeP(self.fresh())]
        out = [Match(patterns[0] if len(patterns) == 1 else Join(patterns), where)]
        for o in g.optionals:
            if o.optionals:
                raise GqlError("OPTIONAL inside OPTIONAL is not supported")
            out.append(Match(o.patterns[0] if len(o.patterns) == 1 else Join(o.patterns), _all(o.filters), True))
        return out

    # -- groups

    def group(self) -> _Group:
        self.need("{")
        g = _Group()
        while not self.sym("}"):
            self.refuse()
            if self.word("OPTIONAL"):
                g.optionals.append(self.group())
            elif self.word("FILTER"):
                g.filters.append(self.filter())
            elif self.now.kind == "sym" and self.now.text == "{":
                if self.tokens[self.at + 1].kind == "word" and self.tokens[self.at + 1].text.upper() == "SELECT":
                    raise GqlError("subqueries are not supported")
                self.union(g)
            elif self.sym("."):
                continue
            else:
                self.triples(g)
        return g

    def union(self, g: _Group) -> None:
        arms = [self.group()]
        while self.word("UNION"):
            arms.append(self.group())
        if len(arms) == 1:
            x = arms[0]
            g.patterns += x.patterns
            g.filters += x.filters
            g.optionals += x.optionals
            g.variables |= x.variables
            return
        names = [{v for v in a.variables if not v.startswith("__")} for a in arms]
        if any(n != names[0] for n in names):
            raise GqlError("UNION takes branches that bind the same variables")
        from .lang.tree import FilterP

        parts = []
        for a in arms:
            if len(a.patterns) != 1 or a.optionals:
                raise GqlError("a UNION branch is one path")
            w = _all(a.filters)
            parts.append(FilterP(a.patterns[0], w) if w is not None else a.patterns[0])
        g.patterns.append(UnionP(parts))
        g.variables |= names[0]

    def filter(self) -> Expr:
        if self.word("EXISTS"):
            return self.exists(False)
        if self.word("NOT", "EXISTS"):
            return self.exists(True)
        if self.sym("("):
            e = self.expr()
            self.need(")")
            return e
        return self.primary()

    def exists(self, negated: bool) -> Expr:
        return Exists(Query(self.matches(self.group())), negated)

    def term(self, g: _Group) -> NodeP:
        t = self.now
        if t.kind == "var":
            self.at += 1
            g.variables.add(t.text)
            return self._node(t.text)
        iri = self.iri()
        var = self.constants.setdefault(iri, f"__c{len(self.constants)}")
        value = local_name(iri)
        key = (int(value) if re.fullmatch(r"-?\d+", value) else None) if self.mapping.integer_key else iri
        p = self._node(var)
        p.values.append((self.mapping.key, Lit(key)))
        return p

    def _node(self, var: str) -> NodeP:
        labels = ([self.mapping.node_label] if self.mapping.node_label else []) + self.labels.get(var, [])
        label = None
        for x in labels:
            label = ("name", x) if label is None else ("and", label, ("name", x))
        return NodeP(var, label)

    def iri(self) -> str:
        t = self.now
        self.at += 1
        if t.kind == "iri":
            return t.text
        if t.kind == "pname":
            prefix, _, name = t.text.partition(":")
            if prefix not in self.prefixes:
                raise GqlError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + name
        raise GqlError(f"expected a term, got {t.text or 'the end'!r}")

    def triples(self, g: _Group) -> None:
        subject = self.term(g)
        while True:
            if self.now.kind == "word" and self.now.text == "a":
                self.at += 1
                self.labels.setdefault(subject.var, []).append(local_name(self.iri()))
                subject = self._node(subject.var)
                g.patterns.append(subject)
            elif self.now.kind == "var":
                name = self.take("var")
                if name in self.seen_predicates or name in g.variables:
                    raise GqlError("a predicate variable can be mentioned once")
                self.seen_predicates.add(name)
                g.patterns.append(Concat([subject, EdgeP("->"), self.term(g)]))
            else:
                prop = self._property()
                if prop is not None:
                    self._read_property(g, subject, prop)
                else:
                    path = self.path()
                    while True:
                        self._edge(g, subject, path, self.term(g))
                        if not self.sym(","):
                            break
            if not self.sym(";"):
                break
            if self.now.kind == "sym" and self.now.text in (".", "}"):
                break

    def _property(self) -> str | None:
        """The name, if the predicate is one that reads a property."""
        if self.now.kind not in ("iri", "pname"):
            return None
        before = self.at
        name = local_name(self.iri())
        if name in self.mapping.properties:
            return name
        self.at = before
        return None

    def _read_property(self, g: _Group, subject: NodeP, prop: str) -> None:
        read = Attr(Var(subject.var), prop)
        if not any(subject.var in _vars_of(p) for p in g.patterns):
            g.patterns.append(subject)
        if self.now.kind == "var":
            name = self.take("var")
            if name in self.values:
                g.filters.append(Bin("=", self.values[name], read))
            else:
                self.values[name] = g.values[name] = read
                g.filters.append(IsNull(read, True))
        else:
            g.filters.append(Bin("=", read, self.literal()))

    def _edge(self, g: _Group, a: NodeP, path: list, b: NodeP) -> None:
        """A sequence of steps; closures are searched for each pair of ends by themselves."""
        items: list[Pattern] = [a]
        for k, step in enumerate(path):
            end = b if k == len(path) - 1 else NodeP(self.fresh())
            if isinstance(step, Repeat):
                if len(items) > 1:
                    g.patterns.append(Concat(items))
                items = [NodeP(items[-1].var)] if len(items) > 1 else items
                g.patterns.append(Selected(Prefix("WALK", "SHORTEST", 1), Concat([items[-1], step, end])))
                items = [NodeP(end.var)]
            else:
                items += [step, end]
        if len(items) > 1:
            g.patterns.append(Concat(items))

    # -- property paths

    def path(self) -> list:
        arms = [self.sequence()]
        while self.sym("|"):
            arms.append(self.sequence())
        if len(arms) == 1:
            return arms[0]
        if all(len(a) == 1 and isinstance(a[0], EdgeP) and a[0].dir == arms[0][0].dir for a in arms):
            label = arms[0][0].label
            for a in arms[1:]:
                label = ("or", label, a[0].label)
            return [EdgeP(arms[0][0].dir, label=label)]
        if any(isinstance(x, Repeat) for a in arms for x in a):
            raise GqlError("a closure inside an alternative is not supported")
        wrapped = [Concat([NodeP(), *[y for x in a for y in (x, NodeP())]]) for a in arms]
        return [UnionP(wrapped)]

    def sequence(self) -> list:
        out = self.step()
        while self.sym("/"):
            out += self.step()
        return out

    def step(self) -> list:
        back = self.sym("^")
        out = self.step_primary()
        if back:
            out = [_reversed(x) for x in reversed(out)]
        for text, low, high in (("*", 0, None), ("+", 1, None), ("?", 0, 1)):
            if self.sym(text):
                inner = out[0] if len(out) == 1 else Concat([NodeP(), *[y for x in out for y in (x, NodeP())]])
                return [Repeat(inner, low, high)]
        return out

    def step_primary(self) -> list:
        if self.sym("("):
            out = self.path()
            self.need(")")
            return out
        if self.sym("!"):
            label: tuple | None = None
            many = self.sym("(")
            while True:
                one = ("name", self._label(self.iri()))
                label = one if label is None else ("or", label, one)
                if not (many and self.sym("|")):
                    break
            if many:
                self.need(")")
            return [EdgeP("->", label=("not", label))]
        return [EdgeP("->", label=("name", self._label(self.iri())))]

    def _label(self, iri: str) -> str:
        return local_name(iri) if self.mapping.local_predicates else iri

    # -- expressions

    def expr(self) -> Expr:
        out = self.conjunction()
        while self.sym("||"):
            out = Bin("OR", out, self.conjunction())
        return out

    def conjunction(self) -> Expr:
        out = self.relation()
        while self.sym("&&"):
            out = Bin("AND", out, self.relation())
        return out

    def relation(self) -> Expr:
        left = self.sum()
        for s, op in (("=", "="), ("!=", "<>"), ("<=", "<="), (">=", ">="), ("<", "<"), (">", ">")):
            if self.sym(s):
                return Bin(op, left, self.sum())
        negated = self.word("NOT", "IN")
        if negated or self.word("IN"):
            self.need("(")
            items = [self.expr()]
            while self.sym(","):
                items.append(self.expr())
            self.need(")")
            test: Expr = Bin("IN", left, ListLit(items))
            return Un("NOT", test) if negated else test
        return left

    def sum(self) -> Expr:
        out = self.product()
        while True:
            if self.sym("+"):
                out = Bin("+", out, self.product())
            elif self.sym("-"):
                out = Bin("-", out, self.product())
            elif self.now.kind == "num" and self.now.text[0] in "+-":
                out = Bin("+", out, self.product())
            else:
                return out

    def product(self) -> Expr:
        out = self.unary()
        while True:
            if self.sym("*"):
                out = Bin("*", out, self.unary())
            elif self.sym("/"):
                out = Bin("/", out, self.unary())
            else:
                return out

    def unary(self) -> Expr:
        if self.sym("!"):
            return Un("NOT", self.unary())
        if self.sym("-"):
            return Un("-", self.unary())
        return self.primary()

    def literal(self) -> Expr:
        t = self.now
        if t.kind == "num":
            self.at += 1
            return Lit(int(t.text) if re.fullmatch(r"[+-]?\d+", t.text) else float(t.text))
        if t.kind == "str":
            self.at += 1
            if self.sym("^^"):
                kind = local_name(self.iri())
                if kind in XSD_NUMBERS:
                    return Lit(XSD_NUMBERS[kind](t.text))
                return Lit(t.text == "true") if kind == "boolean" else Lit(t.text)
            return Lit(t.text)
        if self.word("TRUE"):
            return Lit(True)
        if self.word("FALSE"):
            return Lit(False)
        iri = self.iri()
        value = local_name(iri)
        return Lit(int(value) if self.mapping.integer_key and re.fullmatch(r"-?\d+", value) else iri)

    def primary(self) -> Expr:
        t = self.now
        if self.sym("("):
            e = self.expr()
            self.need(")")
            return e
        if t.kind == "var":
            self.at += 1
            return self.variable(t.text)
        if t.kind != "word" or t.text.upper() in ("TRUE", "FALSE"):
            return self.literal()
        name = t.text.upper()
        self.refuse()
        self.at += 1
        if name == "EXISTS":
            return self.exists(False)
        if name == "NOT" and self.word("EXISTS"):
            return self.exists(True)
        self.need("(")
        if name in ("COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE"):
            distinct = self.word("DISTINCT")
            if self.sym("*"):
                if distinct:
                    raise GqlError("COUNT(DISTINCT *) is not supported")
                self.need(")")
                return Agg("COUNT", False, None)
            e = self.expr()
            self.need(")")
            return Agg("MIN" if name == "SAMPLE" else name, distinct, e)
        args = [self.expr()]
        while self.sym(","):
            args.append(self.expr())
        self.need(")")
        if name == "BOUND":
            return IsNull(args[0], True)
        if name == "IF":
            return Case([(args[0], args[1])], args[2])
        if name == "COALESCE":
            return Call("COALESCE", args)
        if name in ("ABS", "CEIL", "FLOOR", "ROUND"):
            return Call(name, args)
        raise GqlError(f"function {name} is not supported")


def _vars_of(p: object) -> set[str]:
    from .lang.tree import walk

    return {x.var for x in walk(p) if isinstance(x, NodeP) and x.var}


def _all(parts: list[Expr]) -> Expr | None:
    out: Expr | None = None
    for p in parts:
        out = p if out is None else Bin("AND", out, p)
    return out


def _reversed(p: Pattern) -> Pattern:
    if isinstance(p, EdgeP):
        return EdgeP({"->": "<-", "<-": "->"}.get(p.dir, p.dir), label=p.label)
    if isinstance(p, Concat):
        return Concat([_reversed(x) for x in reversed(p.items)])
    if isinstance(p, UnionP):
        return UnionP([_reversed(x) for x in p.arms])
    if isinstance(p, Repeat):
        return Repeat(_reversed(p.inner), p.low, p.high)
    return p


def translate(text: str, mapping: Mapping | None = None) -> Query:
    return _Sparql(text, mapping or Mapping()).query()


__all__ = ["Mapping", "label_names", "translate"]
