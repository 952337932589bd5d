"""Communities in few rounds, by partition, and in parts that no task outgrows."""

import random

from test_modularity import EDGES, connected, louvain, planted, quality

from lodewell.operators import modularity
from lodewell.sources import tables


def recorded(monkeypatch):
    labels, plans = [], []

    def written(df, label="step", by=None):
        labels.append(label)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return tables.materialize(df, label, by)

    monkeypatch.setattr(modularity, "materialize", written)
    return labels, plans


def test_a_graph_without_groups_takes_few_rounds(spark, monkeypatch):
    labels, plans = recorded(monkeypatch)
    rng = random.Random(3)
    edges = [(s, 1000 + p, 1.0) for p in range(600) for s in rng.sample(range(30), 6)]
    df, ids = spark.createDataFrame(edges, EDGES), [*range(30), *range(1000, 1600)]
    found = modularity.communities(df, spark.createDataFrame([(i,) for i in ids], "id long"))
    member = {r["id"]: r["community"] for r in found.collect()}
    assert len(labels) <= 60
    assert not any("Broadcast" in plan for plan in plans)
    assert connected(edges, member) and quality(edges, member) >= quality(edges, louvain(edges, ids))


def test_nodes_move_in_parts_and_hubs_by_sums(spark, monkeypatch):
    edges, n = planted(5, 12, 0.7, 0.03, 4)
    edges += [(n, i, 1.0) for i in range(0, n, 2)]  # a hub
    monkeypatch.setattr(modularity, "_PART", 150)
    monkeypatch.setattr(modularity, "_HUB", 25)
    member = {r["id"]: r["community"] for r in modularity.communities(spark.createDataFrame(edges, EDGES), spark.range(n + 1).toDF("id")).collect()}
    assert set(member) == set(range(n + 1)) and connected(edges, member) and all(member[c] == c and c <= x for x, c in member.items())
    assert quality(edges, member) >= 0.97 * quality(edges, louvain(edges, range(n + 1)))


def test_few_links_are_a_task_of_their_own(spark, monkeypatch):
    """All levels and passes of a graph of few links are one step, and no worse than moves of single nodes alone."""
    labels, plans = recorded(monkeypatch)
    rng = random.Random(5)
    edges = [(s, 1000 + p, 1.0) for p in range(900) for s in rng.sample(range(40), 8)]
    df, ids = spark.createDataFrame(edges, EDGES), [*range(40), *range(1000, 1900)]
    member = {r["id"]: r["community"] for r in modularity.communities(df, spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    assert len(labels) <= 6 and not any("Broadcast" in plan for plan in plans)
    assert set(member) == set(ids) and connected(edges, member) and quality(edges, member) >= 1.2 * quality(edges, louvain(edges, ids))


def test_components_of_few_links_need_no_rounds(spark, monkeypatch):
    """Components are dealt whole, small ones several to a task, and only a large one is moved in parts."""
    labels, plans = recorded(monkeypatch)
    monkeypatch.setattr(modularity, "_PART", 200)
    edges, n = [], 0
    for seed, (groups, size) in enumerate([(3, 6), (2, 5), (4, 6), (2, 4), (3, 5)]):
        some, more = planted(groups, size, 0.9, 0.05, seed)
        edges += [(a + n, b + n, w) for a, b, w in some]
        n += more
    df, nodes = spark.createDataFrame(edges, EDGES), spark.range(n + 1).toDF("id")
    member = {r["id"]: r["community"] for r in modularity.communities(df, nodes).collect()}
    assert "solved" in labels and "state" not in labels and not any("Broadcast" in plan for plan in plans)
    assert set(member) == set(range(n + 1)) and connected(edges, member) and quality(edges, member) >= 0.99 * quality(edges, louvain(edges, range(n + 1)))
    some, more = planted(6, 10, 0.9, 0.03, 9)
    edges, df = edges + [(a + n, b + n, w) for a, b, w in some], spark.createDataFrame(edges + [(a + n, b + n, w) for a, b, w in some], EDGES)
    member = {r["id"]: r["community"] for r in modularity.communities(df, spark.range(n + more + 1).toDF("id")).collect()}
    assert "state" in labels and set(member) == set(range(n + more + 1)) and member[n + more] == n + more
    assert connected(edges, member) and quality(edges, member) >= 0.97 * quality(edges, louvain(edges, range(n + more)))
