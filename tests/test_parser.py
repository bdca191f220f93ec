import pytest

from loomgraph.lang.lexer import GqlError, tokenize
from loomgraph.lang.parser import parse
from loomgraph.lang.tree import Bin, Change, Concat, Ddl, EdgeP, Join, Named, NodeP, Prefix, Query, Repeat, Selected, Un, UnionP


def pattern(text):
    return parse(f"MATCH {text} RETURN 1 AS one").matches[0].pattern


def test_comments_and_arrows():
    assert [t.text for t in tokenize("a -- rest\n/* x */ --> <--")][:-1] == ["a", "-->", "<--"]


def test_unclosed_string():
    with pytest.raises(GqlError):
        parse("MATCH (x {a: 'b}) RETURN x")


def test_pattern_shapes():
    p = pattern("(a:A&!B {k: 1})-[e:R|S]->{1,3}(b)")
    assert isinstance(p, Concat) and isinstance(p.items[0], NodeP) and isinstance(p.items[1], Repeat)
    assert p.items[0].label == ("and", ("name", "A"), ("not", ("name", "B")))
    assert (p.items[1].low, p.items[1].high) == (1, 3)
    assert isinstance(pattern("(a)->(b) | (a)<-(b)"), UnionP)
    assert isinstance(pattern("(a), (b)"), Join)
    assert [x.dir for x in pattern("(a)-[]->(b)<-[]-(c)~[]~(d)-[]-(e)").items if isinstance(x, EdgeP)] == ["->", "<-", "~", "-"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ALL SHORTEST", Prefix("WALK", "GROUPS", 1)),
        ("ANY SHORTEST", Prefix("WALK", "SHORTEST", 1)),
        ("SHORTEST 3", Prefix("WALK", "SHORTEST", 3)),
        ("SHORTEST 2 GROUPS", Prefix("WALK", "GROUPS", 2)),
        ("ANY 2 TRAIL", Prefix("TRAIL", "ANY", 2)),
        ("TRAIL", Prefix("TRAIL", "ALL", 1)),
        ("ACYCLIC PATHS", Prefix("ACYCLIC", "ALL", 1)),
    ],
)
def test_prefixes(text, want):
    p = pattern(f"p = {text} (a)-[]->*(b)")
    assert isinstance(p, Named) and isinstance(p.inner, Selected) and p.inner.prefix == want


def test_and_or_share_a_level_and_not_binds_tightly():
    e = parse("MATCH (x) WHERE x.a = 1 OR x.b = 2 AND x.c = 3 RETURN x").matches[0].where
    assert isinstance(e, Bin) and e.op == "AND" and e.left.op == "OR"
    e = parse("MATCH (x) WHERE NOT x.a = x.b RETURN x").matches[0].where
    assert isinstance(e, Bin) and e.op == "=" and isinstance(e.left, Un)


def test_statements():
    assert isinstance(parse("(x:A)"), Query)
    assert isinstance(parse("INSERT (:A {k: 1})-[:R]->(:B)"), Change)
    assert isinstance(parse("CREATE BTREE INDEX i ON :A(k)"), Ddl)
    assert parse("MATCH (x) RETURN x.a AS a GROUP BY a ORDER BY a DESC NULLS FIRST LIMIT 3").limit == 3


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (x) GROUP BY x RETURN x GROUP BY x",
        "MATCH (x) RETURN [1, x.a]",
        "INSERT (:A)-[:R]-(:B)",
        "INSERT (:A|B)",
        "INSERT (:A)-[:R]->{2}(:B)",
        "SET x.a = 1",
        "MATCH (x) SET x.a = 1 DELETE x",
        "MATCH (x) RETURN upper(x.a)",
        "CREATE GRAPH TYPE DEFAULT AS { (:A) }",
        "MATCH (x) RETURN x OFFSET 2",
        "MATCH (x) WHERE x.a STARTS WITH 'b' RETURN x",
        "MATCH SHORTEST 0 (a)-[]->*(b) RETURN a",
    ],
)
def test_refused(text):
    with pytest.raises(GqlError):
        parse(text)
