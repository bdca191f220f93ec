"""Small graphs and how to read results, for the tests."""

import json

from loomgraph.session import GraphSession


def node(i, labels, **props):
    return {"id": i, "labels": labels.split("&") if labels else [], "props": props}


def edge(i, a, labels, b, directed=True, **props):
    return {"id": i, "labels": labels.split("&"), "props": props, "endpoints": [a, b], "directionality": "->" if directed else "~~"}


def session(spark, nodes, edges=()):
    return GraphSession.import_json_str(spark, json.dumps({"nodes": nodes, "edges": list(edges)}))


def rows(s, text):
    """The result as a sorted list of tuples, in the order of the columns."""
    return sorted((tuple(r) for r in s.execute(text).collect()), key=repr)


def ordered(s, text):
    return [tuple(r) for r in s.execute(text).collect()]


FRAUD = (
    [node("a1", "Account", owner="Anya", isBlocked=False), node("a2", "Account", owner="Sven", isBlocked=False), node("p1", "Account", owner="Jon", isBlocked=False), node("p2", "Account", owner="Max", isBlocked=True), node("d1", "Dummy&Person", owner="Finn", isBlocked=False, isDummy=True)],
    [edge("t1", "p1", "Transfer", "p2", amount=2500000), edge("t2", "p2", "Transfer", "a2", amount=3000000), edge("t3", "a2", "Transfer", "a1", amount=3500000), edge("t4", "a1", "Transfer", "p1", amount=2000000), edge("t5", "a1", "Foo", "d1", amount=2000000)],
)
MULTI = (
    [node(x, "N", id=k) for k, x in enumerate("abcd")],
    [edge("r1", "a", "R", "b"), edge("r2", "a", "R", "b"), edge("r3", "b", "R", "c"), edge("r4", "c", "R", "c"), edge("s1", "a", "S", "b")],
)
ROUTES = (
    [node(x, "N", name=x) for x in "ABCDE"],
    [edge("1", "A", "R", "B"), edge("2", "B", "R", "D"), edge("3", "A", "R", "C"), edge("4", "C", "R", "E"), edge("5", "E", "R", "D")],
)
DIAMOND = (
    [node(x, "N", name=x) for x in "ABCDEF"],
    [edge("1", "A", "R", "B"), edge("2", "B", "R", "D"), edge("3", "A", "R", "C"), edge("4", "C", "R", "D"), edge("5", "A", "R", "E"), edge("6", "E", "R", "F"), edge("7", "F", "R", "D")],
)
TRIANGLE = ([node(x, "N", name=x) for x in "XYZ"], [edge("1", "X", "R", "Y"), edge("2", "Y", "R", "Z"), edge("3", "Z", "R", "X")])
CHAIN = ([node(x, "N", name=x) for x in "abc"], [edge("1", "a", "R", "b", p=1), edge("2", "b", "R", "c", p=2)])
SOCIAL = (
    [node("n1", "Person&Teacher", name="Ada", status="active"), node("n2", "Person&Student", name="Ben", status=1), node("n3", "Comment", content="hi", status=True)],
    [edge("e1", "n1", "Knows", "n2", directed=False, since=2020), edge("e2", "n1", "Likes", "n3"), edge("e3", "n3", "Author", "n2")],
)
PEOPLE = ([node("a", "P", name="ann", age=30, score=1.5), node("b", "P", name="bob", age=25), node("c", "P", name="cat"), node("d", "P", name="dan", age=30, score=-2.5)], [])
