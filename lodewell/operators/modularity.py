"""Communities by modularity: local moves, refinement and contraction, level by level.

A graph is held as `links` (node, other, weight), each edge both ways and a self link twice, so that the weights of a
node sum up to its degree k. Moving a node from community a to c changes the modularity by
2 (w_c - w_a) / m2 - 2 k (t_c - t_a + k) / m2^2, with w the weight between the node and a community, t the
sum of the degrees in it, and m2 the sum of all degrees.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewell.operators.components import connected_components
from lodewell.operators.graph import both_ways
from lodewell.sources.tables import by_partition, discard, handed, materialize

_LEAST = 1e-12  # of a gain that is not rounding
_PART = 1 << 20  # links by which a task moves nodes, about
_NODES = 1 << 17  # nodes that a task moves, about
_HUB = 1 << 19  # links of a node that no task gets whole
_STEADY = 0.02  # of the modularity: what a round in parts gains, or it is the last
_WORTH = 0.01  # of the modularity: what moves of single nodes gain, or no pass follows
_FEW = 2  # parts of links: a graph or component of no more is a task's own from single nodes to its communities


def modularity(edges: DataFrame, members: DataFrame) -> float:
    """The modularity of `members` (id, community) in the weighted, undirected graph of `edges`; 0 without edges."""
    links = by_partition(both_ways(edges))
    of = lambda name: members.select(F.col("id").alias(name), F.col("community").alias(f"{name}_in"))
    inside = links.join(of("node"), "node").join(of("other"), "other").agg(
        F.sum(F.when(F.col("node_in") == F.col("other_in"), F.col("weight"))).alias("inside"), F.sum("weight").alias("all")
    ).first()
    if not inside["all"]:
        return 0.0
    tot = links.join(of("node"), "node").groupBy("node_in").agg(F.sum("weight").alias("t"))
    return (inside["inside"] or 0.0) / inside["all"] - tot.agg(F.sum((F.col("t") / inside["all"]) ** 2)).first()[0]


def _moves(first: list, near: list, weights: list, k: list, free: list | None, at: list, total: list, size: list, m2: float, parts: int, *, settle: bool, least: float = 0.0) -> None:
    """Moves the nodes 0, 1, ... one after the other, each to the best community by what has moved before, in place.

    The links of node i are those from first[i] to first[i + 1]: to the node `near`, which is in community at[near]; numbers
    behind the last node stand for nodes that stay. What moves here is taken to move in each of the `parts`, and of two nodes
    alone only the larger one goes to the other. With one part nodes move until a round raises the modularity by no more than
    `least`. Without `settle` a node moves once, and only while it is alone.
    """
    going, slack = True, _LEAST * m2
    while going:
        gained = 0.0
        for i, ki in enumerate(k):
            here = at[i]
            if free and not free[i] or not settle and size[here] > 1:
                continue
            around: dict[int, float] = {}
            had, those, f = around.get, slice(first[i], first[i + 1]), ki / m2
            for j, w in zip(near[those], weights[those], strict=True):
                c = at[j]
                around[c] = had(c, 0.0) + w
            stays = had(here, 0.0) - f * (total[here] - ki)
            best, most = here, stays + slack
            for c, w in around.items():
                score = w - f * total[c]
                if score > most and c != here and not (parts > 1 and settle and c > here and size[c] == size[here] == 1):
                    best, most = c, score
            if best != here:
                at[i] = best
                total[here], total[best] = total[here] - parts * ki, total[best] + parts * ki
                size[here], size[best] = size[here] - 1, size[best] + 1
                gained += most - stays
        going = settle and parts == 1 and 2 * gained > least * m2


def _walk(m2: float, parts: int, *, settle: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What a task makes of its nodes (id, community, k, t, size, free) and their links (node, other, weight, to, t_to, size_to).

    Its nodes move as `_moves` says; communities of the nodes of other tasks are those they had, and nodes are dealt by hash.
    """

    def walk(links: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        links, nodes = links.sort_values(["node", "other"]), nodes.sort_values("id")
        n, place = len(nodes), pd.Index(nodes["id"])
        codes, names = pd.factorize(pd.concat([links["to"], nodes["community"]], ignore_index=True), sort=True)
        totals, sizes = np.zeros(len(names)), np.zeros(len(names), np.int64)
        totals[codes], sizes[codes] = np.concatenate([links["t_to"], nodes["t"]]), np.concatenate([links["size_to"], nodes["size"]])
        far, before = codes[: len(links)], codes[len(links) :]
        end, near, weights = place.get_indexer(links["node"]), place.get_indexer(links["other"]), links["weight"].to_numpy()
        near = np.where(near >= 0, near, n + far)
        own = np.bincount(end, weights * (far == before[end]), n)
        at = [*before.tolist(), *range(len(names))]
        first = np.searchsorted(end, np.arange(n + 1)).tolist()
        _moves(first, near.tolist(), weights.tolist(), nodes["k"].tolist(), nodes["free"].tolist(), at, totals.tolist(), sizes.tolist(), m2, parts, settle=settle)
        now = np.array(at, dtype=np.int64)
        then = np.bincount(end, weights * (now[near] == now[end]), n)
        return pd.DataFrame({"id": nodes["id"].to_numpy(), "community": names.take(before), "to": names.take(now[:n]), "k": nodes["k"].to_numpy(), "own": own, "then": then})

    return walk


class _Graph:
    """A level in a task: links a-b of weight w between the nodes 0 to n - 1, sorted; m2 is that of all tasks."""

    def __init__(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, m2: float):
        keys, place = np.unique(a * n + b, return_inverse=True)
        self.a, self.b, self.w, self.n, self.m2 = keys // n, keys % n, np.bincount(place, w, len(keys)), n, m2
        self.k = np.bincount(self.a, self.w, n)

    def value(self, at: np.ndarray) -> float:
        return self.w[at[self.a] == at[self.b]].sum() / self.m2 - ((np.bincount(at, self.k) / self.m2) ** 2).sum()

    def moved(self, at: np.ndarray, some: np.ndarray, *, settle: bool, least: float = 0.0) -> np.ndarray:
        """Communities, numbered from 0, after moves from `at` along `some` of the links."""
        a, now = self.a[some], at.tolist()
        first = np.searchsorted(a, np.arange(self.n + 1)).tolist()
        _moves(first, self.b[some].tolist(), self.w[some].tolist(), self.k.tolist(), None, now, np.bincount(at, self.k).tolist(), np.bincount(at).tolist(), self.m2, 1, settle=settle, least=least)
        return np.unique(now, return_inverse=True)[1]

    def settled(self, at: np.ndarray, least: float) -> tuple[np.ndarray, float]:
        at = self.moved(at, self.a != self.b, settle=True, least=least)
        return at, self.value(at)

    def refined(self, at: np.ndarray) -> np.ndarray:
        return self.moved(np.arange(self.n), (self.a != self.b) & (at[self.a] == at[self.b]), settle=False)

    def parted(self, at: np.ndarray) -> np.ndarray:
        inner, root = at[self.a] == at[self.b], np.arange(self.n)
        a, b = self.a[inner], self.b[inner]
        while not np.array_equal(x := root[a], y := root[b]):
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(root, further := root[root]):
                root = further
        return np.unique(root, return_inverse=True)[1]

    def joined(self, at: np.ndarray, least: float) -> tuple[np.ndarray, float]:
        """Connected communities, numbered from 0, after all levels of a pass from `at`, and their modularity."""
        graph, inside, over = self, np.arange(self.n), False
        at, now = graph.settled(at, least)
        while at.max() + 1 < graph.n:
            fine = graph.parted(at) if over else graph.refined(at)
            fine = graph.parted(at) if fine.max() + 1 == graph.n else fine
            inside = fine[inside]
            if over:
                break
            into = np.zeros(fine.max() + 1, np.int64)
            into[fine] = at
            graph, before = _Graph(fine[graph.a], fine[graph.b], graph.w, len(into), self.m2), now
            at, now = graph.settled(into, least)
            over = now < before + least
        return inside, now


def _whole(m2: float, least: float, *, passes: bool) -> Callable[..., pd.DataFrame]:
    """(id, community) of the nodes of the links (node, other, weight) that a task has whole, as `communities` finds them.

    They start in the communities of `nodes` (id, community), or alone, and one pass is made. With `passes` others follow, which
    start from single nodes in the communities found, the smallest fifth of which are taken apart, as long as that gains a
    hundredth. What a round or level is to gain counts for all links; of that a task asks its share.
    """

    def solved(links: pd.DataFrame, nodes: pd.DataFrame | None = None) -> pd.DataFrame:
        ends, ids = pd.factorize(pd.concat([links["node"], links["other"]], ignore_index=True), sort=True)
        whole = _Graph(ends[: len(links)], ends[len(links) :], links["weight"].to_numpy(), len(ids), m2)
        some = least * whole.k.sum() / m2
        start = np.arange(len(ids)) if nodes is None else pd.factorize(nodes.set_index("id")["community"].reindex(ids), sort=True)[0]
        member, value = whole.joined(start, some)
        while passes:
            total = np.bincount(member, whole.k)
            small = np.argsort(total, kind="stable")[: -(-len(total) // 5)]
            start = np.where(np.isin(member, small), len(total) + np.arange(whole.n), member)
            found, now = whole.joined(np.unique(start, return_inverse=True)[1], some)
            gain = now - value
            if gain > 0:
                member, value = found, now
            if gain < _WORTH * abs(value):
                break
        smallest = np.unique(member, return_index=True)[1]
        return pd.DataFrame({"id": ids, "community": ids.take(smallest[member])})

    return solved


def _best_of_hubs(near: DataFrame, known: DataFrame, m2: float) -> DataFrame:
    """As `_walk`, for nodes with too many links for a task: each goes to its best community, which is found by sums."""
    weights = near.groupBy(F.col("node").alias("id"), "to").agg(F.sum("weight").alias("w"), F.first("t_to").alias("t_to"))
    stays, k = F.col("to") == F.col("community"), F.col("k")
    score = F.col("w") - k * (F.col("t_to") - F.when(stays, k).otherwise(0.0)) / m2
    best = weights.join(known, "id").groupBy("id", "community", "k", "t", "free").agg(
        F.max(F.when(stays, score)).alias("here"), F.max(F.when(stays, F.col("w"))).alias("own"), F.max(F.when(~stays, F.struct(score.alias("s"), "to"))).alias("b")
    )
    goes = F.col("free") & (F.col("b.s") > F.coalesce("here", -k * (F.col("t") - k) / m2) + _LEAST * m2)
    own = F.coalesce("own", F.lit(0.0))
    return best.select("id", "community", F.when(goes, F.col("b.to")).otherwise(F.col("community")).alias("to"), "k", own.alias("own"), own.alias("then"))


class _Level:
    """A level's links, with what all its rounds use. Nodes with over `_HUB` links are kept apart."""

    def __init__(self, links: DataFrame, m2: float):
        each = links.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.when(F.col("node") == F.col("other"), F.col("weight"))).alias("loop"))
        size = each.agg(F.sum("n"), F.max("n"), F.sum("loop"), F.count("*")).first()
        self.links, self.m2, self.loops, self.few = links, m2, size[2] or 0.0, size[0] <= _FEW * _PART
        self.parts = max(-(-size[0] // _PART), -(-size[3] // _NODES))
        self.hubs = materialize(each.where(F.col("n") > _HUB).select("node"), "hubs") if size[1] > _HUB else None

    def walked(self, near: DataFrame, known: DataFrame, parts: int, part: Column, end: Column, *, settle: bool) -> DataFrame:
        kind = dict(known.dtypes)["id"]
        out = f"id {kind}, community {kind}, to {kind}, k double, own double, then double"
        nodes = known.select("id", "community", "k", "t", "size", "free", part.alias("part")).groupBy("part")
        links = near.select("node", "other", "weight", "to", "t_to", "size_to", end.alias("part")).groupBy("part")
        return links.cogroup(nodes).applyInPandas(_walk(self.m2, parts, settle=settle), out)

    def round(self, state: DataFrame, share: int, number: int) -> DataFrame:
        """(id, community, to, k, own, then): where the nodes of one in `share` go, by a hash that changes from round to round,
        and the weight between a node and its community before and, if there is one part, after."""
        totals = state.groupBy("community").agg(F.sum("k").alias("t"), F.count("*").alias("size"))
        free = F.pmod(F.xxhash64("id", F.lit(number), F.lit(1)), F.lit(share)) == 0
        known = state.join(totals, "community").withColumn("free", free)
        to = known.select(F.col("id").alias("other"), F.col("community").alias("to"), F.col("t").alias("t_to"), F.col("size").alias("size_to")).hint("shuffle_hash")
        near = self.links.where("node <> other").join(to, "other")
        part = lambda c: F.pmod(F.xxhash64(c, F.lit(number)), F.lit(self.parts))
        walked = lambda near, known: self.walked(near, known, self.parts, part("id"), part("node"), settle=True)
        if self.hubs is None:
            return materialize(walked(near, known), "state")
        hubs = self.hubs.select(F.col("node").alias("id"))
        found = walked(near.join(self.hubs, "node", "left_anti"), known.join(hubs, "id", "left_anti"))
        return materialize(found.union(_best_of_hubs(near.join(self.hubs, "node", "left_semi"), known, self.m2)), "state")

    def value(self, moved: DataFrame, community: str, inside: str) -> float:
        sums = moved.groupBy(community).agg(F.sum("k").alias("t"), F.sum(inside).alias("w"))
        row = sums.agg(F.sum("w"), F.sum((F.col("t") / self.m2) ** 2)).first()
        return (row[0] + self.loops) / self.m2 - row[1]

    def settled(self, state: DataFrame, least: float, worth: float | None = None) -> tuple[DataFrame | None, float]:
        """(id, community, k) after moves until a round gains less than `least`, and its modularity; None if the first gains
        less than the share `worth`.

        Where tasks have parts, the share `_STEADY` is to be gained. All nodes may move at once, and one in four after a round
        that lowers the modularity by more than that. Such a round is taken back. `state` is deleted if it isn't returned.
        """
        after = lambda moved: moved.select("id", F.col("to").alias("community"), "k")
        share, number, held, moved = 1, 1, state, self.round(state, 1, 0)
        best = self.value(moved, "community", "own")
        while True:
            alone = self.parts == 1 and self.hubs is None
            following = None if alone else self.round(after(moved), share, number)
            now = self.value(moved, "to", "then") if alone else self.value(following, "community", "own")
            number, gain = number + 1, now - best
            if worth is not None and gain < worth * abs(best):
                discard(held, moved, *([following] if following else []))
                return None, best
            worth = None
            if gain > 0:
                discard(held)
                held, state, best, moved = moved, after(moved), now, following
            else:
                discard(moved, *([following] if following else []))
                moved = None
            steady = max(least, _STEADY * abs(best))
            if alone or abs(gain) < steady or share > 1 and gain < steady:
                discard(*([moved] if moved else []))
                return state, best
            if not moved:
                share, moved, number = 4, self.round(state, 4, number), number + 1

    def refined(self, state: DataFrame) -> DataFrame:
        """(id, whole, community, k): communities within those of `state`, grown from single nodes.

        Only nodes that are still alone move, to a community they are linked to and whose members stay, so that every
        community is connected. A task has whole communities, or a part by hash of one with many inner links.
        """
        whole = lambda end: state.select(F.col("id").alias(end), F.col("community").alias(f"{end}_in")).hint("shuffle_hash")
        inner = self.links.where("node <> other").join(whole("node"), "node").join(whole("other"), "other").where("node_in = other_in")
        inner = inner.select("node", "other", "weight", F.col("node_in").alias("whole"))
        known = state.select("id", F.col("community").alias("whole"), F.col("id").alias("community"), "k", F.col("k").alias("t"), F.lit(1).alias("size"), F.lit(True).alias("free"))
        part, written = lambda c: F.lit(0), []
        if self.parts > 1:
            inner = materialize(inner, "inner")
            ways = materialize(inner.groupBy("whole").agg(F.ceil(F.count("*") / _PART).alias("ways")), "ways")
            written = [inner, ways]
            unit = lambda c: F.pmod(F.xxhash64(c), F.coalesce("ways", F.lit(1)))
            part = lambda c: F.pmod(F.xxhash64("whole", unit(c)), F.lit(self.parts))
            inner, known = inner.join(ways, "whole").where(part("node") == part("other")), known.join(ways, "whole", "left")
        near = inner.withColumns({"to": F.col("other"), "t_to": F.lit(0.0), "size_to": F.lit(1)})
        grown = self.walked(near, known, 1, part("id"), part("node"), settle=False).select("id", F.col("to").alias("community"), "k")
        out = materialize(grown.join(state.select("id", F.col("community").alias("whole")), "id").select("id", "whole", "community", "k"), "state")
        discard(*written)
        return out

    def whole(self, state: DataFrame, least: float) -> DataFrame:
        """(id, community) after all further levels of a pass, by one task: for few links."""
        kind = dict(state.dtypes)["id"]
        links, nodes = (df.withColumn("part", F.lit(0)).groupBy("part") for df in (self.links, state.select("id", "community")))
        return materialize(links.cogroup(nodes).applyInPandas(_whole(self.m2, least, passes=False), f"id {kind}, community {kind}"), "state")

    def parted(self, state: DataFrame) -> DataFrame:
        """As `refined`: the connected parts of the communities."""
        of = lambda end: state.select(F.col("id").alias(end), F.col("community").alias(f"{end}_in"))
        inner = self.links.where("node < other").join(of("node"), "node").join(of("other"), "other").where("node_in = other_in")
        parts = connected_components(inner, "node", "other").select(F.col("node").alias("id"), "component")
        fine = state.select("id", F.col("community").alias("whole"), "k").join(parts, "id", "left")
        return materialize(fine.select("id", "whole", F.coalesce("component", "id").alias("community"), "k"), "state")


def _dealt(links: DataFrame) -> tuple[DataFrame, int]:
    """(node, part) of the nodes whose component has few links, so that a task has whole components, and how many links the
    others have. Of small components about `_PART` links share a part, and a larger one has its own."""
    found = connected_components(links.where("node < other"), "node", "other")
    each = links.groupBy("node").agg(F.count("*").alias("n")).join(found, "node", "left")
    each = materialize(each.select("node", "n", F.coalesce("component", "node").alias("component")), "components")
    sizes, size = each.groupBy("component").agg(F.sum("n").alias("size")), F.col("size")
    rest, shared = sizes.agg(F.sum(F.when(size > _FEW * _PART, size)), F.sum(F.when(size <= _PART // 4, size))).first()
    code = F.xxhash64("component")
    part = F.when(size > _PART // 4, code).otherwise(F.pmod(code, F.lit(-(-(shared or 1) // _PART))))
    return each.join(sizes.where(size <= _FEW * _PART), "component").select("node", part.alias("part")), rest or 0


def communities(edges: DataFrame, nodes: DataFrame, *, least: float = 1e-5) -> DataFrame:
    """(id, community) of every node of `nodes` (id), and of no other: communities of high modularity, named by their smallest member.

    `edges` are weighted and undirected, and a null or zero weight counts as 1. Each level moves nodes until a round of moves
    raises the modularity by less than `least`, refines the communities, and contracts the refined ones to the nodes of the
    next level, which start in the community they came from; a pass ends when a level gains less than that, with the connected
    parts of its communities. Then single nodes move between the communities found, and as long as that gains a hundredth,
    another pass starts from there. Communities are connected, a node without edges is one of its own, and the result does not
    depend on chance. Null ids and edges with an unknown end are left out. Nothing but sums reaches the driver.

    No community reaches beyond a connected component. Components of at most `_FEW` times `_PART` links are dealt to tasks
    whole, which make all passes over theirs (`_whole`). The nodes of larger ones move in parts, one task each, until a level
    has so few links that one task makes the rest of the pass.
    """
    ids = materialize(by_partition(nodes.select("id").where("id IS NOT NULL").distinct()), "ids")
    known = lambda df, end: df.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    rows = known(known(by_partition(edges.select("source", "target", "weight")), "source"), "target")
    links = both_ways(rows).groupBy("node", "other").agg(F.sum("weight").alias("weight"))
    links = materialize(links.select("node", "other", "weight"), "around")
    m2, rest = links.agg(F.sum("weight"), F.count("*")).first()
    links = by_partition(links, rows=rest)
    members = materialize(by_partition(ids.select("id", F.col("id").alias("community")), rows=rest), "members")
    discard(ids)
    solved, value = None, None
    if m2:
        kind = dict(members.dtypes)["id"]
        units, size = links.withColumn("part", F.lit(0)), rest
        dealt, rest = _dealt(links) if size > _FEW * _PART else (None, 0)
        if dealt:
            units = by_partition(links.join(dealt, "node"), rows=8 * size)
        if rest < size:
            alone = _whole(m2, least, passes=True)
            solved = units.groupBy("part").applyInPandas(lambda links: alone(links), f"id {kind}, community {kind}")
            solved = materialize(solved, "solved")
        if 0 < rest < size:
            links = by_partition(materialize(links.join(dealt, "node", "left_anti"), "around"), rows=rest)
    all_links = links
    while rest:
        links, level = all_links, _Level(all_links, m2)
        degree = links.groupBy(F.col("node").alias("id")).agg(F.sum("weight").alias("k"))
        settled, now = level.settled(materialize(degree.join(members, "id").select("id", "community", "k"), "state"), least, None if value is None else _WORTH)
        if settled is None:
            break
        inside = materialize(members.select("id", F.col("id").alias("node")), "members")
        over = False
        while True:
            n, found = settled.agg(F.count("*"), F.count_distinct("community")).first()
            if found == n:
                break
            fine = level.parted(settled) if over else level.refined(settled)
            if not over and fine.select("community").distinct().count() >= (n if level.parts == 1 else 0.9 * n):  # little gained by pairs: the connected parts then
                discard(fine)
                fine = level.parted(settled)
            to = lambda end: fine.select(F.col("id").alias(end), F.col("community").alias(f"{end}_to"))  # noqa: B023, E731
            moved = materialize(inside.join(to("node"), "node", "left").select("id", F.coalesce("node_to", "node").alias("node")), "members")
            discard(inside)
            inside = moved
            if over:
                break
            joined = links.join(to("node").hint("shuffle_hash"), "node").join(to("other").hint("shuffle_hash"), "other")
            contracted = materialize(joined.groupBy(F.col("node_to").alias("node"), F.col("other_to").alias("other")).agg(F.sum("weight").alias("weight")), "around")
            state = materialize(fine.groupBy(F.col("community").alias("id")).agg(F.min("whole").alias("community"), F.sum("k").alias("k")), "state")
            discard(fine, *([links] if links is not all_links else []))
            links, level, before = contracted, _Level(contracted, m2), now
            if level.few:
                ends = level.whole(state, least).select(F.col("id").alias("node"), F.col("community").alias("end"))
                moved = materialize(inside.join(ends, "node", "left").select("id", F.coalesce("end", "node").alias("node")), "members")
                discard(inside)
                inside = moved
                break
            settled, now = level.settled(state, least)
            over = now < before + least
        value = now
        smallest = inside.groupBy("node").agg(F.min("id").alias("community"))
        after = materialize(inside.join(smallest, "node").select("id", "community"), "members")
        discard(members, inside, *([links] if links is not all_links else []))
        members = after
    if solved:
        ends = solved.select("id", F.col("community").alias("end"))
        members = members.join(ends, "id", "left").select("id", F.coalesce("end", "community").alias("community"))
    return handed(members, edges.sparkSession)
