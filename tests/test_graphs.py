"""Graph operators against plain versions, and their number of rounds."""

import random

import pytest

from evidentia.operators import graphs as G


def reach(edges, roots):
    depth, front = {r: 0 for r in roots}, list(roots)
    while front:
        front = [b for b in {b for a, b in edges if a in set(front)} if b not in depth and depth.setdefault(b, max(depth[x] for x in front) + 1) is not None]
    return depth


def graphs():
    rng = random.Random(3)
    yield [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (7, 7), (8, 9), (0, 1), (6, 10), (10, 11)]
    yield [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 1), (5, 5), (9, 8), (8, 7), (7, 9), (7, 20), (20, 21), (21, 22), (22, 9)]
    yield [(i, j) for i in range(4) for j in range(4) if i != j] + [(3, 10), (10, 11), (11, 12), (12, 2)]
    yield []
    yield list({(rng.randrange(8), rng.randrange(8)) for _ in range(9)})


@pytest.mark.parametrize("edges", list(graphs()))
def test_graph_operators(spark, edges):
    nodes = sorted({x for e in edges for x in e} | {90})
    df = spark.createDataFrame(edges + edges[:2], "src int, dst int")
    n = spark.createDataFrame([(x,) for x in nodes], "id int")
    to = {x: reach(edges, [x]) for x in nodes}
    on = {x: {y for y in nodes if x in to[y] and y in to[x]} for x in nodes}
    cyclic = {x: min(on[x]) for x in nodes if len(on[x]) > 1 or (x, x) in edges}
    assert {r.id: r.cycle for r in G.cycle_members(df).collect()} == cyclic
    roots = nodes[:2]
    got = G.reachable(df, n.filter(n.id.isin(roots))).collect()
    assert {r.id: r.depth for r in got} == reach(edges, roots) and len(got) == len({r.id for r in got})
    level = {x: None if any(x in to[c] for c in cyclic) else 1 for x in nodes}
    for _ in nodes:
        for a, b in edges:
            if level[b]:
                level[b] = max(level[b], level[a] + 1)
    got = G.execution_order(n, df).collect()
    assert {r.id: r.level for r in got} == level and len(got) == len(nodes)


@pytest.mark.parametrize("ring", [False, True])
def test_a_thousand_nodes_take_few_rounds(spark, monkeypatch, ring):
    rounds, own = [], G.cut
    ids = list(range(1000))
    random.Random(1).shuffle(ids)
    edges = list(zip(ids, ids[1:] + ids[:1] if ring else ids[1:], strict=False))
    df, n = spark.createDataFrame(edges, "src int, dst int"), spark.range(1000)

    monkeypatch.setattr(G, "cut", lambda d: own(d) if not rounds.append(1) else None)
    assert G.cycle_members(df).count() == (1000 if ring else 0)
    assert len(rounds) <= 24  # of them 15 at most in the doubling
    rounds.clear()
    levels = {r.id: r.level for r in G.execution_order(n, df).collect()}
    assert levels == ({i: None for i in ids} if ring else {x: k + 1 for k, x in enumerate(ids)}) and len(rounds) <= 26
    rounds.clear()
    got = {r.id: r.depth for r in G.reachable(df, n.filter(n.id == ids[0])).collect()}
    assert got == {x: k for k, x in enumerate(ids)} and len(rounds) <= 24
