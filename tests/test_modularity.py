"""Communities by modularity against a plain, single-machine Louvain."""

import random
from collections import defaultdict

import pytest

from lodewell.operators import graph, modularity

EDGES = "source long, target long, weight double"


def quality(edges, member):
    m2 = 2 * sum(w for *_, w in edges)
    total = defaultdict(float)
    for a, b, w in edges:
        total[member[a]] += w
        total[member[b]] += w
    return sum(2 * w for a, b, w in edges if member[a] == member[b]) / m2 - sum((t / m2) ** 2 for t in total.values())


def louvain(edges, nodes):
    links = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        links[a][b] += w
        links[b][a] += w
    for x in nodes:
        links[x]
    m2, member = sum(sum(v.values()) for v in links.values()), {x: x for x in nodes}
    while True:
        at, k = {x: x for x in links}, {x: sum(v.values()) for x, v in links.items()}
        total, moved, ever = dict(k), True, False
        while moved:
            moved = False
            for x in sorted(links):
                weight = defaultdict(float)
                for y, w in links[x].items():
                    if y != x:
                        weight[at[y]] += w
                total[at[x]] -= k[x]
                score = lambda c: weight[c] - k[x] * total[c] / m2  # noqa: B023, E731
                best = max([at[x], *sorted(weight)], key=lambda c: (score(c) + (1e-12 if c == at[x] else 0)))  # noqa: B023
                total[best] += k[x]
                if best != at[x]:
                    at[x], moved, ever = best, True, True
        if not ever:
            return member
        member = {x: at[c] for x, c in member.items()}
        wider = defaultdict(lambda: defaultdict(float))
        for a, row in links.items():
            wider[at[a]]
            for b, w in row.items():
                wider[at[a]][at[b]] += w
        links = wider


def connected(edges, member):
    inner = defaultdict(set)
    for a, b, _ in edges:
        if member[a] == member[b]:
            inner[a].add(b)
            inner[b].add(a)
    groups = defaultdict(set)
    for x, c in member.items():
        groups[c].add(x)
    for group in groups.values():
        seen, todo = set(), [min(group)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += inner[x]
        if seen != group:
            return False
    return True


def planted(groups, size, within, between, seed):
    rng = random.Random(seed)
    n = groups * size
    return [(i, j, float(rng.choice([1, 1, 2, 3]))) for i in range(n) for j in range(i) if rng.random() < (within if i // size == j // size else between)], n


@pytest.mark.parametrize("settings", [(8, 12, 0.5, 0.03, 1), (5, 20, 0.25, 0.05, 2)])
def test_modularity_is_that_of_louvain(spark, settings):
    edges, n = planted(*settings)
    df = spark.createDataFrame(edges, EDGES)
    members = modularity.communities(df, spark.range(n + 2).toDF("id"))
    member = {r["id"]: r["community"] for r in members.collect()}
    assert set(member) == set(range(n + 2)) and member[n] == n and member[n + 1] == n + 1  # without edges
    assert quality(edges, member) >= 0.99 * quality(edges, louvain(edges, range(n)))
    assert modularity.modularity(df, members) == pytest.approx(quality(edges, member))
    assert connected(edges, member) and all(member[c] == c and c <= x for x, c in member.items())
    found = {r["community"]: r["hub"] for r in graph.hubs(members, df).collect()}
    assert set(found) == set(member.values()) and all(member[hub] == c for c, hub in found.items())


def test_a_ring_of_cliques(spark):
    edges = [(5 * g + i, 5 * g + j, 1.0) for g in range(6) for i in range(5) for j in range(i)] + [(5 * g, (5 * g + 5) % 30, 1.0) for g in range(6)]
    member = {r["id"]: r["community"] for r in modularity.communities(spark.createDataFrame(edges, EDGES), spark.range(30).toDF("id")).collect()}
    assert member == {x: x // 5 * 5 for x in range(30)}


def test_edges_of_every_kind(spark):
    edges = [(1, 2, None), (2, 1, 0.0), (3, 4, 1.0), (3, 3, 4.0), (None, 1, 1.0), (1, 99, 50.0)]
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (5,), (None,)], "id long")
    got = sorted((r["id"], r["community"]) for r in modularity.communities(spark.createDataFrame(edges, EDGES), nodes).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)]
    none = spark.createDataFrame([], EDGES)
    assert modularity.communities(none, nodes.limit(0)).count() == 0 and modularity.modularity(none, nodes.withColumn("community", nodes["id"])) == 0.0
    assert sorted(r["community"] for r in modularity.communities(none, nodes).collect()) == [1, 2, 3, 4, 5]
