"""Components of tangled graphs: few rounds, and the same result by rounds and by whole colours."""

import random

import pytest

from evidentia.operators import graphs as G


def cyclic(edges):
    """The plain version."""
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)

    def reach(x):
        seen, left = set(), list(to.get(x, ()))
        while left:
            y = left.pop()
            if y not in seen:
                seen.add(y)
                left += to.get(y, ())
        return seen

    all_of = {x: reach(x) for x in to}
    return {x: min(y for y in all_of[x] if x in all_of.get(y, ())) for x in to if x in all_of[x]}


def test_a_tree_with_back_edges_takes_few_rounds(spark, monkeypatch):
    rounds, own = [], G.cut
    monkeypatch.setattr(G, "cut", lambda d: own(d) if not rounds.append(1) else None)
    edges = [(k // 2, k) for k in range(2, 1000)] + [(k, k // 4) for k in range(0, 1000, 40)]
    got = G.cycle_members(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.id: r.cycle for r in got} == cyclic(edges) and len(got) == len(cyclic(edges))
    assert len(rounds) <= 35


def tangle():
    """Rings of 2 to 40 nodes at random, some of them joined both ways, with tails, chords and loops."""
    rng, edges, rings, n = random.Random(5), [], [], 0
    for size in [2, 3, 5, 8, 13, 40, 2, 4]:
        ring = list(range(n, n + size))
        n += size
        rng.shuffle(ring)
        rings.append(ring)
        edges += zip(ring, ring[1:] + ring[:1], strict=True)
        edges += [(rng.choice(ring), rng.choice(ring)) for _ in range(size // 2)]
        edges += [(rng.choice(ring), n), (n, n + 1), (n + 2, rng.choice(ring))]
        n += 3
    for i, j in ((0, 1), (1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 3), (5, 6), (0, 7)):
        edges.append((rng.choice(rings[i]), rng.choice(rings[j])))
    return edges


@pytest.mark.parametrize(("kind", "group"), [("long", 50_000), ("long", 20), ("string", 20), ("double", 50_000)])
def test_components_by_colours_and_by_rounds(spark, monkeypatch, kind, group):
    monkeypatch.setattr(G, "GROUP", group)
    as_kind = {"long": int, "string": lambda x: f"é{x:03}", "double": float}[kind]
    edges = [(as_kind(a), as_kind(b)) for a, b in tangle()]
    got = G.cycle_members(spark.createDataFrame(edges, f"src {kind}, dst {kind}")).collect()
    assert sorted((r.id, r.cycle) for r in got) == sorted(cyclic(edges).items())


def test_rings_end_when_they_are_walked_around(spark, monkeypatch):
    rounds, own = [], G.cut
    monkeypatch.setattr(G, "cut", lambda d: own(d) if not rounds.append(1) else None)
    edges = [x for k in range(0, 3000, 3) for x in ((k, k + 1), (k + 1, k + 2), (k + 2, k))]
    c = G.contract(spark.createDataFrame(edges, "src int, dst int"))
    assert {r.id: r.cycle for r in c.rings.collect()} == {k: k // 3 * 3 for k in range(3000)}
    assert c.inner.isEmpty() and c.edges.isEmpty() and len(rounds) <= 8
