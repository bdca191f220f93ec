"""GQL statements by recursive descent."""

from __future__ import annotations

from .lexer import GqlError, Token, tokenize
from .tree import (
    Agg, AsType, Attr, Bin, Call, Case, Cast, Change, Comprehension, Concat, Ddl, EdgeP, Exists, Expr, FilterP, IsNull, IsType, Item, Join, ListLit, Lit,
    Match, Maybe, Named, Nearest, NodeP, Pattern, Prefix, Query, Rec, Repeat, Selected, SortKey, Un, UnionP, Value, Var,
)

# Words that can't name a variable.
RESERVED = frozenset(
    "MATCH OPTIONAL WHERE RETURN DISTINCT GROUP ORDER BY LIMIT AND OR NOT IN IS AS NULL CASE WHEN THEN ELSE END EXISTS INSERT SET REMOVE DELETE DETACH "
    "NODETACH ASC DESC ASCENDING DESCENDING NEAREST true false".split()
)
AGGREGATES = {"COUNT": "COUNT", "SUM": "SUM", "AVG": "AVG", "MIN": "MIN", "MAX": "MAX", "COLLECT_LIST": "COLLECT_LIST", "COLLECT": "COLLECT_LIST", "ARRAY_AGG": "COLLECT_LIST"}
FUNCTIONS = frozenset(
    "FLOOR CEIL CEILING ROUND ABS SIGN SQRT EXP LN LOG POW POWER SIN COS TAN RADIANS DEGREES MOD COALESCE PATH_LENGTH CARDINALITY ELEMENTS NODES EDGES "
    "DATE LOCAL_DATETIME DURATION VECTOR".split()
)
TYPE_NAMES = {
    "int": "int", "INT": "int", "INTEGER": "int", "float": "float", "FLOAT": "float", "DOUBLE": "float", "bool": "bool", "BOOL": "bool", "BOOLEAN": "bool",
    "str": "str", "STRING": "str", "ANY": "any", "DATE": "date", "LOCAL_DATETIME": "datetime",
}
MILLISECONDS = {"weeks": 604_800_000, "days": 86_400_000, "hours": 3_600_000, "minutes": 60_000, "seconds": 1_000, "milliseconds": 1}


class Parser:
    def __init__(self, text: str):
        self.tokens = tokenize(text)
        self.at = 0

    # -- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, k: int = 1) -> Token:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)]

    def sym(self, *texts: str) -> bool:
        """Are these symbols next? If so, they are taken."""
        if all(self.peek(k).kind == "sym" and self.peek(k).text == t for k, t in enumerate(texts)):
            self.at += len(texts)
            return True
        return False

    def word(self, *words: str) -> bool:
        if all(self.peek(k).is_word(w) for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, text: str) -> None:
        if not (self.sym(text) or self.word(text)):
            raise GqlError(f"expected {text!r}, got {self.now.text or 'the end'!r} at {self.now.at}")

    def name(self) -> str:
        if self.now.kind != "name":
            raise GqlError(f"expected a name, got {self.now.text or 'the end'!r} at {self.now.at}")
        self.at += 1
        return self.tokens[self.at - 1].text

    def int_(self) -> int:
        if self.now.kind != "int":
            raise GqlError(f"expected an integer, got {self.now.text or 'the end'!r} at {self.now.at}")
        self.at += 1
        return int(self.tokens[self.at - 1].text)

    def many(self, one, separator: str = ",") -> list:
        out = [one()]
        while self.sym(separator):
            out.append(one())
        return out

    # -- statements

    def statement(self) -> Query | Change | Ddl:
        out = self.ddl() or self.query_or_change()
        self.sym(";")
        if self.now.kind != "end":
            raise GqlError(f"unexpected {self.now.text!r} at {self.now.at}")
        return out

    def query_or_change(self) -> Query | Change:
        matches = self.matches(bare=True)
        if self.now.text in ("INSERT", "SET", "REMOVE", "DELETE", "DETACH", "NODETACH") and self.now.kind == "name":
            return self.change(matches)
        if not matches:
            raise GqlError(f"unexpected {self.now.text or 'end of the query'!r} at {self.now.at}")
        return self.rest_of_query(matches)

    def matches(self, bare: bool = False) -> list[Match]:
        out: list[Match] = []
        while True:
            optional = self.now.is_word("OPTIONAL") and self.peek().is_word("MATCH")
            if optional:
                self.at += 2
            elif not self.word("MATCH") and not (bare and not out and self._pattern_begins()):
                return out
            pattern = self.join()
            out.append(Match(pattern, self.expr() if self.word("WHERE") else None, optional))

    def _pattern_begins(self) -> bool:
        t = self.now
        if t.kind == "sym":
            return t.text in ("(", "-", "<", "~", "-->", "<--")
        return t.kind == "name" and (t.text in ("ALL", "ANY", "SHORTEST", "WALK", "TRAIL", "SIMPLE", "ACYCLIC") or self.peek().text == "=")

    def rest_of_query(self, matches: list[Match]) -> Query:
        q = Query(matches)
        if self.now.is_word("NEAREST") and self.peek().kind == "int":
            self.at += 1
            k = self.int_()
            rows = self.word("ROWS")
            var = self.name()
            self.need(".")
            attr = self.name()
            self.need("TO")
            target = self.term()
            q.nearest = Nearest(k, rows, var, attr, target, self.name() if self.word("AS") else None)
        early = self.group_by()
        if self.word("RETURN"):
            q.distinct = self.word("DISTINCT")
            q.returns = self.many(self.item)
        late = self.group_by()
        if early is not None and late is not None:
            raise GqlError("GROUP BY stands before and after RETURN")
        q.group_by = early if early is not None else late
        q.order_by, q.limit = self.order_by(), self.limit()
        return q

    def item(self) -> Item:
        e = self.expr(returned=True)
        return Item(e, self.name() if self.word("AS") else None)

    def group_by(self) -> list[Expr] | None:
        if not self.word("GROUP", "BY"):
            return None
        if self.sym("(", ")"):
            return []
        return self.many(lambda: self.expr(returned=True))

    def order_by(self) -> list[SortKey]:
        return self.many(self.sort_key) if self.word("ORDER", "BY") else []

    def sort_key(self) -> SortKey:
        key = SortKey(self.expr(returned=True))
        if self.word("DESC") or self.word("DESCENDING"):
            key.descending = True
        else:
            self.word("ASC") or self.word("ASCENDING")
        if self.word("NULLS"):
            key.nulls_first = self.word("FIRST")
            if not key.nulls_first:
                self.need("LAST")
        return key

    def limit(self) -> int | None:
        return self.int_() if self.word("LIMIT") else None

    def change(self, matches: list[Match]) -> Change:
        detach = self.word("DETACH")
        if not detach:
            self.word("NODETACH")
        kind = self.name()
        c = Change(kind, matches, detach=detach)
        if kind == "INSERT":
            c.patterns = self.many(self.operand)
            for p in c.patterns:
                _check_insert(p)
        elif not matches:
            raise GqlError(f"{kind} needs a MATCH before it")
        elif kind == "SET":
            c.items = self.many(self.set_item)
        elif kind == "REMOVE":
            c.items = self.many(self.remove_item)
        elif kind == "DELETE":
            c.targets = self.many(self.expr)
        else:
            raise GqlError(f"unexpected {kind!r}")
        if self.word("RETURN"):
            self.word("DISTINCT")
            c.returns = self.many(self.item)
        c.order_by, c.limit = self.order_by(), self.limit()
        if self.now.kind == "name" and self.now.text in ("INSERT", "SET", "REMOVE", "DELETE", "DETACH"):
            raise GqlError("a statement has one data-modifying operation")
        return c

    def set_item(self) -> tuple:
        var = self.name()
        if self.sym("."):
            attr = self.name()
            self.need("=")
            return (var, attr, None, self.expr())
        if self.sym("="):
            return (var, None, None, self.expr())
        return (var, None, self._labels_to_set(), None)

    def remove_item(self) -> tuple:
        var = self.name()
        return (var, self.name(), None) if self.sym(".") else (var, None, self._labels_to_set())

    def _labels_to_set(self) -> list[str]:
        self.need(":") if not self.word("IS") else None
        return self.many(self.name, "&")

    # -- schemas and indexes

    def ddl(self) -> Ddl | None:
        if self.word("CREATE", "GRAPH", "TYPE"):
            name = self.name()
            if name == "DEFAULT":
                raise GqlError("DEFAULT is reserved")
            self.need("AS")
            self.need("{")
            body = self.many(self.element_type)
            self.need("}")
            return Ddl("create type", name, body)
        for words, kind in ((("USE", "GRAPH", "TYPE"), "use type"), (("DROP", "GRAPH", "TYPE"), "drop type"), (("VALIDATE", "GRAPH", "TYPE"), "validate type"), (("SHOW", "GRAPH", "TYPE"), "show type")):
            if self.word(*words):
                name = self.name()
                if kind == "drop type" and name == "DEFAULT":
                    raise GqlError("DEFAULT is reserved")
                return Ddl(kind, name)
        if self.word("SHOW", "GRAPH", "TYPES"):
            return Ddl("show types")
        if self.word("SHOW", "CURRENT", "GRAPH", "TYPE"):
            return Ddl("show current type")
        if self.word("SHOW", "INDEXES"):
            return Ddl("show indexes")
        if self.word("DROP", "INDEX"):
            return Ddl("drop index", self.name())
        if self.now.is_word("CREATE"):
            self.at += 1
            kind = "BTREE" if self.word("BTREE") else "HASH" if self.word("HASH") else None
            self.need("INDEX")
            name = None if self.now.is_word("ON") else self.name()
            self.need("ON")
            self.need(":")
            label = self.name()
            self.need("(")
            prop = self.name()
            self.need(")")
            if self.word("USING"):
                kind = self.name().upper()
            return Ddl("create index", name or f"ix_{label}_{prop}", (label, prop, kind or "HASH"))
        return None

    def element_type(self) -> tuple:
        """("node", labels, record) or ("edge", labels, record, source, target, directed)"""
        source = self._node_type()
        if self.sym("-", "["):
            labels, record = self._type_body()
            self.need("]")
            self.need("-")
            self.need(">")
            return ("edge", labels, record, source[1:], self._node_type()[1:], True)
        if self.sym("~", "["):
            labels, record = self._type_body()
            self.need("]")
            self.need("~")
            return ("edge", labels, record, source[1:], self._node_type()[1:], False)
        if self.sym("<", "-", "["):
            labels, record = self._type_body()
            self.need("]")
            self.need("-")
            return ("edge", labels, record, self._node_type()[1:], source[1:], True)
        return source

    def _node_type(self) -> tuple:
        self.need("(")
        labels, record = self._type_body()
        self.need(")")
        return ("node", labels, record)

    def _type_body(self) -> tuple:
        if self.now.kind == "name":
            self.at += 1
        labels = frozenset(self.many(self.name, "&")) if self.sym(":") else frozenset()
        fields, is_open = {}, True
        if self.sym("{"):
            is_open = False
            while not self.sym("}"):
                if self.sym("*"):
                    is_open = True
                else:
                    key = self.name()
                    self.sym(":")
                    types = self.many(self.type_, "|")
                    fields[key] = frozenset(t[0] if t[0] != "list" else "list" for t in types)
                self.sym(",")
        return labels, (fields, is_open)

    # -- patterns

    def join(self) -> Pattern:
        operands = self.many(self.operand)
        return operands[0] if len(operands) == 1 else Join(operands)

    def operand(self) -> Pattern:
        var = None
        if self.now.kind == "name" and self.peek().kind == "sym" and self.peek().text == "=":
            var = self.name()
            self.at += 1
        prefix = self.prefix()
        pattern = self.path_union()
        if prefix != Prefix():
            pattern = Selected(prefix, pattern)
        return Named(var, pattern) if var else pattern

    def prefix(self) -> Prefix:
        mode, search, count = "WALK", "ALL", 1
        modes = ("WALK", "TRAIL", "SIMPLE", "ACYCLIC")

        def take_mode() -> str:
            for m in modes:
                if self.word(m):
                    return m
            return ""

        def noise() -> None:
            self.word("PATHS") or self.word("PATH")

        early = take_mode()
        if not early:
            if self.word("ALL", "SHORTEST"):
                early, search = take_mode(), "GROUPS"
            elif self.word("ANY", "SHORTEST"):
                early, search = take_mode(), "SHORTEST"
            elif self.word("ANY"):
                search, count = "ANY", self.int_() if self.now.kind == "int" else 1
                early = take_mode()
            elif self.word("SHORTEST"):
                count = self.int_() if self.now.kind == "int" else 1
                search, early = "SHORTEST", take_mode()
                noise()
                if self.word("GROUPS") or self.word("GROUP"):
                    search = "GROUPS"
            elif self.word("ALL"):
                early = take_mode()
        noise()
        if search != "ALL" and count < 1:
            raise GqlError("a path search needs a count of 1 at least")
        return Prefix(early or mode, search, count)

    def path_union(self) -> Pattern:
        arms = self.many(self.path_term, "|")
        return arms[0] if len(arms) == 1 else UnionP(arms)

    def path_term(self) -> Pattern:
        items = [self.path_factor()]
        while self.now.kind == "sym" and self.now.text in ("(", "-", "<", "~", "-->", "<--"):
            items.append(self.path_factor())
        return items[0] if len(items) == 1 else Concat(items)

    def path_factor(self) -> Pattern:
        inner = self.path_primary()
        if self.sym("*"):
            return Repeat(inner, 0, None)
        if self.sym("+"):
            return Repeat(inner, 1, None)
        if self.sym("?"):
            return Maybe(inner)
        if self.sym("{"):
            low = 0 if self.now.text == "," else self.int_()
            high: int | None = low
            if self.sym(","):
                high = self.int_() if self.now.kind == "int" else None
            self.need("}")
            return Repeat(inner, low, high)
        return inner

    def path_primary(self) -> Pattern:
        if self.now.kind == "sym" and self.now.text == "(":
            before = self.at
            try:
                return self.node()
            except GqlError as first:
                failed, self.at = self.at, before
                try:
                    self.need("(")
                    inner = self.path_union()
                    if self.word("WHERE"):
                        inner = FilterP(inner, self.expr())
                    self.need(")")
                    return inner
                except GqlError:
                    if failed >= self.at:
                        raise first from None
                    raise
        return self.edge()

    def node(self) -> NodeP:
        self.need("(")
        p = NodeP()
        self.descriptor(p)
        self.need(")")
        return p

    def edge(self) -> EdgeP:
        if self.sym("-->"):
            return EdgeP("->")
        if self.sym("<--"):
            return EdgeP("<-")
        if self.sym("<", "-", "["):
            p = EdgeP("<-")
            self._edge_end(p, "-")
            return p
        if self.sym("<", "-"):
            return EdgeP("<-")
        if self.sym("~", "["):
            p = EdgeP("~")
            self._edge_end(p, "~")
            return p
        if self.sym("~"):
            return EdgeP("~")
        if self.sym("-", "["):
            p = EdgeP("-")
            self.descriptor(p)
            self.need("]")
            if self.sym("-->"):
                raise GqlError("unexpected '-->'")
            self.need("-")
            if self.sym(">"):
                p.dir = "->"
            return p
        if self.sym("-", ">"):
            return EdgeP("->")
        if self.sym("-"):
            return EdgeP("-")
        raise GqlError(f"expected a node or an edge, got {self.now.text or 'the end'!r} at {self.now.at}")

    def _edge_end(self, p: EdgeP, end: str) -> None:
        self.descriptor(p)
        self.need("]")
        self.need(end)

    def descriptor(self, p: NodeP | EdgeP) -> None:
        if self.now.kind == "name" and self.now.text not in RESERVED:
            p.var = self.name()
        if self.sym(":") or (self.now.is_word("IS") and self.word("IS")):
            p.label = self.label()
        if self.sym("{"):
            p.closed = self.sym("{")
            while not self.sym("}"):
                key = self.name()
                if self.sym(":"):
                    p.values.append((key, self.expr()))
                else:
                    p.types.append((key, self.type_()))
                if not self.sym(",") and self.now.text != "}":
                    raise GqlError(f"expected ',' or '}}' at {self.now.at}")
            if p.closed:
                self.need("}")
        if self.word("WHERE"):
            p.where = self.expr()

    def label(self) -> tuple:
        out = self.label_and()
        while self.sym("|"):
            out = ("or", out, self.label_and())
        return out

    def label_and(self) -> tuple:
        out = self.label_not()
        while self.sym("&"):
            out = ("and", out, self.label_not())
        return out

    def label_not(self) -> tuple:
        if self.sym("!"):
            return ("not", self.label_not())
        if self.sym("("):
            out = self.label()
            self.need(")")
            return out
        if self.sym("*") or self.sym("%"):
            return ("any",)
        return ("name", self.name())

    def type_(self) -> tuple:
        if self.sym("*"):
            return ("any",)
        if self.sym("["):
            inner = self.type_()
            self.need("]")
            return ("list", inner)
        if self.sym("{"):
            fields = {}
            while not self.sym("}"):
                key = self.name()
                self.sym(":")
                fields[key] = self.type_()
                self.sym(",")
            return ("record", fields)
        word = self.name()
        if word == "LIST" and self.sym("<"):
            inner = self.type_()
            self.need(">")
            return ("list", inner)
        if word == "NULL":
            return ("null",)
        if word == "RECORD" and self.now.text == "{":
            return self.type_()
        if word not in TYPE_NAMES:
            raise GqlError(f"unknown type {word!r} at {self.tokens[self.at - 1].at}")
        return (TYPE_NAMES[word],)

    # -- expressions; AND and OR share one level, NOT binds tighter than comparisons

    def expr(self, returned: bool = False) -> Expr:
        out = self.comparison(returned)
        while True:
            op = "AND" if self.word("AND") else "OR" if self.word("OR") else None
            if op is None:
                return out
            out = Bin(op, out, self.comparison(returned))

    def comparison(self, returned: bool = False) -> Expr:
        left = self.term()
        while True:
            if self.word("IS", "NOT", "NULL"):
                left = IsNull(left, True)
            elif self.word("IS", "NULL"):
                left = IsNull(left, False)
            elif self.word("IS") or self.word("TYPED"):
                left = IsType(left, self.type_())
            elif not returned and self.word("IN"):
                left = Bin("IN", left, self.term())
            elif not returned and self.word("AS"):
                left = AsType(left, self.type_())
            elif self.now.kind == "name" and self.now.text in ("int", "float", "bool", "str"):
                left = IsType(left, self.type_())
            elif self.now.kind == "sym" and self.now.text in ("=", "<>", "!=", "<", "<=", ">", ">="):
                op = self.now.text
                self.at += 1
                left = Bin("<>" if op == "!=" else op, left, self.term())
            else:
                return left

    def term(self) -> Expr:
        out = self.factor()
        while self.now.kind == "sym" and self.now.text in ("+", "-"):
            op = self.now.text
            self.at += 1
            out = Bin(op, out, self.factor())
        return out

    def factor(self) -> Expr:
        out = self.unary()
        while self.now.kind == "sym" and self.now.text in ("*", "/"):
            op = self.now.text
            self.at += 1
            out = Bin(op, out, self.unary())
        return out

    def unary(self) -> Expr:
        if self.sym("-"):
            arg = self.unary()
            if isinstance(arg, Lit) and type(arg.value) in (int, float):
                return Lit(-arg.value)
            return Un("-", arg)
        if self.now.is_word("NOT") and not self.peek().is_word("EXISTS"):
            self.at += 1
            return Un("NOT", self.unary())
        out = self.primary()
        while self.sym("."):
            out = Attr(out, self.name())
        return out

    def primary(self) -> Expr:
        t = self.now
        if t.kind in ("int", "float", "str"):
            self.at += 1
            return Lit({"int": int, "float": float, "str": str}[t.kind](t.text))
        if self.sym("("):
            out = self.expr()
            self.need(")")
            return out
        if self.sym("["):
            return self.list_or_comprehension()
        if self.now.text == "{" and t.kind == "sym":
            return self.record()
        if t.kind != "name":
            raise GqlError(f"expected an expression, got {t.text or 'the end'!r} at {t.at}")
        if self.word("true"):
            return Lit(True)
        if self.word("false"):
            return Lit(False)
        if self.word("null") or self.word("NULL"):
            return Lit(None)
        if self.word("CASE"):
            arms = []
            while self.word("WHEN"):
                when = self.expr()
                self.need("THEN")
                arms.append((when, self.expr()))
            if not arms:
                raise GqlError(f"CASE without WHEN at {t.at}")
            other = self.expr() if self.word("ELSE") else None
            self.need("END")
            return Case(arms, other)
        negated = t.text == "NOT"
        if negated or (t.text == "EXISTS" and self.peek().text == "{"):
            self.at += 1 + negated
            return Exists(self.subquery(), negated)
        following = self.peek()
        if following.kind == "sym" and following.text == "{":
            if t.text == "VALUE":
                self.at += 1
                q = self.subquery(value=True)
                return Value(q)
            if t.text == "RECORD":
                self.at += 1
                return self.record()
        if following.kind == "sym" and following.text == "(":
            upper = t.text.upper()
            if upper in AGGREGATES:
                return self.aggregate(AGGREGATES[upper])
            if upper == "CAST":
                self.at += 2
                arg = self.expr(returned=True)
                self.need("AS")
                kind = self.name().upper()
                if kind not in ("INTEGER", "INT", "FLOAT"):
                    raise GqlError(f"can't cast to {kind}")
                self.need(")")
                return Cast(arg, "INTEGER" if kind == "INT" else kind)
            if upper in FUNCTIONS:
                self.at += 2
                args = [] if self.now.text == ")" else self.many(self.expr)
                self.need(")")
                return _duration(args) if upper == "DURATION" else Call(upper, args)
            raise GqlError(f"unknown function {t.text!r} at {t.at}")
        if t.text in RESERVED:
            raise GqlError(f"unexpected {t.text!r} at {t.at}")
        self.at += 1
        return Var(t.text)

    def aggregate(self, kind: str) -> Agg:
        self.at += 2
        if self.sym("*"):
            if kind != "COUNT":
                raise GqlError(f"{kind}(*) has no meaning")
            self.need(")")
            return Agg(kind, False, None)
        distinct = self.word("DISTINCT")
        if not distinct:
            self.word("ALL")
        arg = self.expr()
        self.need(")")
        return Agg(kind, distinct, arg)

    def record(self) -> Rec:
        self.need("{")
        out: dict[str, Expr] = {}
        while not self.sym("}"):
            key = self.name()
            self.need(":")
            out[key] = self.expr()
            if not self.sym(",") and self.now.text != "}":
                raise GqlError(f"expected ',' or '}}' at {self.now.at}")
        return Rec(out)

    def list_or_comprehension(self) -> Expr:
        if self.sym("]"):
            return ListLit([])
        if self.now.kind == "name" and self.peek().is_word("IN"):
            var = self.name()
            self.at += 1
            source = self.term()
            where = self.expr() if self.word("WHERE") else None
            self.need("|")
            body = self.expr()
            self.need("]")
            return Comprehension(var, source, where, body)
        items = self.many(self.expr)
        self.need("]")
        if not all(isinstance(x, (Lit, ListLit, Rec)) for x in items):
            raise GqlError("list literals hold constants only")
        return ListLit(items)

    def subquery(self, value: bool = False) -> Query:
        self.need("{")
        matches = self.matches(bare=True)
        if not matches:
            raise GqlError(f"a subquery needs a MATCH at {self.now.at}")
        if value:
            q = self.rest_of_query(matches)
            if not q.returns or len(q.returns) != 1:
                raise GqlError("VALUE returns exactly one item")
        else:
            q = Query(matches)
        self.need("}")
        return q


def _duration(args: list[Expr]) -> Expr:
    if len(args) != 1 or not isinstance(args[0], Rec):
        raise GqlError("DURATION takes a record such as {days: 3}")
    out: Expr | None = None
    for key, e in args[0].fields.items():
        if key not in MILLISECONDS:
            raise GqlError(f"unknown duration unit {key!r}")
        part: Expr = Lit(e.value * MILLISECONDS[key]) if isinstance(e, Lit) and isinstance(e.value, int) else Bin("*", e, Lit(MILLISECONDS[key]))
        out = part if out is None else Bin("+", out, part)
    return out or Lit(0)


def _check_insert(p: Pattern) -> None:
    items = p.items if isinstance(p, Concat) else [p]
    for x in items:
        if not isinstance(x, (NodeP, EdgeP)):
            raise GqlError("INSERT takes nodes and edges only: no repetition, union, prefix or path variable")
        if x.where is not None or x.types:
            raise GqlError("INSERT takes property values only")
        if isinstance(x, EdgeP) and x.dir == "-":
            raise GqlError("an inserted edge needs a direction")
        _plain_labels(x.label)
    kinds = [isinstance(x, NodeP) for x in items]
    if not kinds[0] or not kinds[-1] or any(a == b for a, b in zip(kinds, kinds[1:], strict=False)):
        raise GqlError("INSERT alternates nodes and edges")


def _plain_labels(label: tuple | None) -> None:
    if label is not None and label[0] in ("or", "not", "any"):
        raise GqlError("INSERT labels are joined by & only")
    if label is not None and label[0] == "and":
        _plain_labels(label[1])
        _plain_labels(label[2])


def parse(text: str) -> Query | Change | Ddl:
    return Parser(text).statement()
