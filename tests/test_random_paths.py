"""Quantified paths on small random multigraphs against plain enumeration."""

import random
from collections import Counter, defaultdict

import pytest
from graphs import edge, node, rows, session


def random_graph(seed):
    rnd = random.Random(seed)
    n, m = 5, 8
    edges = [(f"e{k}", rnd.randrange(n), rnd.choice("RS"), rnd.randrange(n)) for k in range(m)]
    return n, edges


def walks(n, edges, longest, keep):
    """All walks as (node list, edge list), a walk extended only while ``keep`` holds of it."""
    level = [([a], []) for a in range(n)]
    out = list(level)
    for _ in range(longest):
        level = [(ns + [b], es + [i]) for ns, es in level for i, a, _, b in edges if a == ns[-1]]
        level = [w for w in level if keep(*w)]
        out += level
    return out


def simple(ns, es):
    inner = ns[:-1]
    return len(set(inner)) == len(inner) and (ns[-1] not in inner[1:]) and (len(ns) < 3 or ns[-1] not in inner or ns[-1] == ns[0])


def ends(ws, low=0):
    return Counter((ns[0], ns[-1], len(es)) for ns, es in ws if len(es) >= low)


@pytest.mark.parametrize("seed", range(3))
def test_modes_and_searches(spark, seed):
    n, edges = random_graph(seed)
    s = session(spark, [node(f"n{k}", "N", k=k) for k in range(n)], [edge(i, f"n{a}", t, f"n{b}") for i, a, t, b in edges])

    def got(prefix, quantifier):
        text = f"MATCH p = {prefix} (a:N)-[]->{quantifier}(b:N) RETURN a.k AS a, b.k AS b, PATH_LENGTH(p) AS l, COUNT(*) AS n GROUP BY a.k, b.k, l"
        return Counter({(a, b, length): c for a, b, length, c in rows(s, text)})

    trail = walks(n, edges, len(edges), lambda ns, es: len(set(es)) == len(es))
    acyclic = walks(n, edges, n, lambda ns, es: len(set(ns)) == len(ns))
    closing = walks(n, edges, n, lambda ns, es: simple(ns, es) and (len(ns) < 3 or ns[-2] != ns[0]))
    every = walks(n, edges, 4, lambda ns, es: True)
    assert got("TRAIL", "*") == ends(trail)
    assert got("TRAIL", "+") == ends(trail, 1)
    assert got("ACYCLIC", "*") == ends(acyclic)
    assert got("SIMPLE", "*") == ends(closing)
    assert got("", "{1,3}") == Counter({k: v for k, v in ends(every, 1).items() if k[2] <= 3})

    many = ends(walks(n, edges, 9, lambda ns, es: True))
    by_pair = defaultdict(list)
    for (a, b, length), c in sorted(many.items(), key=lambda x: x[0][2]):
        by_pair[a, b].append((length, c))
    assert got("ALL SHORTEST", "*") == Counter({(*pair, v[0][0]): v[0][1] for pair, v in by_pair.items()})
    two = Counter({(*pair, length): c for pair, v in by_pair.items() for length, c in v[:2]})
    assert got("SHORTEST 2 GROUPS", "*") == two
    three = Counter()
    for pair, v in by_pair.items():
        left = 3
        for length, c in v:
            if left:
                three[(*pair, length)] = min(left, c)
                left -= min(left, c)
    assert got("SHORTEST 3", "*") == three
