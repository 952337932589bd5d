"""SimHash near-duplicate groups through a vantage-point tree over Hamming distance."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewell.functions.names import fresh
from lodewell.llm.dealing import unit_pairs
from lodewell.operators.components import connected_components
from lodewell.sources.tables import materialize

HASH_SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3

_ROWS_AT_ONCE = 1 << 16  # of shingle hashes whose bits are counted together


def fingerprint(data: bytes | None) -> int:
    """The 64-bit SimHash of a text in UTF-8, as a signed integer; 0 where there is no word.

    Bytes are lower-cased and split as ASCII, which leaves every other character as it is.
    """
    words = data.lower().split() if data else []
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    width = min(SHINGLE_WORDS, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a : b - 1], HASH_SEED) for a, b in zip(starts, starts[width:], strict=False)),
        dtype=np.uint64,
        count=len(words) - width + 1,
    )
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _ROWS_AT_ONCE):
        part = hashes[at : at + _ROWS_AT_ONCE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(k, fp), key and fingerprint, for every row of `docs`; a null or blank text has fingerprint 0."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(values, pa.int64())], names=["k", "fp"])

    plain = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t"))
    return plain.mapInArrow(compute, f"k {docs.schema[key].dataType.simpleString()}, fp long")


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Differing bits of unsigned fingerprints."""
    return np.bitwise_count(np.bitwise_xor(a, b))


@dataclass
class VantageTree:
    """Inner nodes as parallel arrays; a child below 0 is the leaf numbered ~child.

    Points at most `radius` bits from `vantage` are inside, the others outside.
    """

    vantage: np.ndarray
    radius: np.ndarray
    inside: np.ndarray
    outside: np.ndarray
    leaves: int

    def route(self, points: np.ndarray, reach: int = MAX_BITS) -> Iterator[tuple[np.ndarray, int, bool]]:
        """(positions, leaf, at home): each point at home in one leaf and visiting the leaves it may have partners in.

        A pair within `reach` that a node separates has its inner point within `reach` of the boundary. Only that
        point crosses it, so the pair meets in one leaf alone; below, a visitor enters whatever the triangle
        inequality does not exclude.
        """
        todo = [(0 if len(self.vantage) else -1, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node < 0:
                for kind in (True, False):
                    if (some := at[home == kind]).size:
                        yield some, ~node, kind
                continue
            far = distance(points[at], self.vantage[node]).astype(np.int16) - self.radius[node]
            inside, outside = far <= 0, far > 0
            stays = np.where(home, inside, far <= reach)
            todo.append((int(self.inside[node]), at[stays], home[stays]))
            leaves = np.where(home, outside | (far > -reach), far > -reach)
            todo.append((int(self.outside[node]), at[leaves], (home & outside)[leaves]))


def build_tree(sample: np.ndarray, leaves: int, *, reach: int = MAX_BITS, tries: int = 24, seed: int = 7) -> VantageTree:
    """A tree of about `leaves` leaves over a sample; vantage points are those that leave least near the boundary."""
    rng = np.random.default_rng(seed)
    nodes: list[list] = []
    made = 0

    def grow(points: np.ndarray, want: int) -> int:
        nonlocal made
        best = None
        if want > 1 and len(points) >= 4:
            for v in rng.choice(points, size=min(tries, len(points)), replace=False):
                d = distance(points, v).astype(np.int16)
                r = int(np.median(d))
                share = float((d <= r).mean())
                if not 0.02 < share < 0.98:
                    r -= 1
                    share = float((d <= r).mean())
                if not 0.02 < share < 0.98:
                    continue
                crossing = float(((d > r - reach) & (d <= r + reach)).mean()) + abs(share - 0.5)
                if best is None or crossing < best[0]:
                    best = (crossing, v, r, d <= r, share)
        if best is None:
            made += 1
            return ~(made - 1)
        _, v, r, inside, share = best
        here = len(nodes)
        nodes.append([v, r, 0, 0])
        low = min(max(1, round(want * share)), want - 1)
        nodes[here][2] = grow(points[inside], low)
        nodes[here][3] = grow(points[~inside], want - low)
        return here

    grow(np.unique(sample), leaves)
    column = lambda i, kind: np.array([n[i] for n in nodes], dtype=kind)
    return VantageTree(column(0, np.uint64), column(1, np.int16), column(2, np.int64), column(3, np.int64), made)


class Forest:
    """Connected labels over 0..n-1, merged from arrays of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def leaf_links(points: np.ndarray, home: np.ndarray, reach: int = MAX_BITS, *, within: bool = True, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked points: a spanning forest of the pairs within `reach` that have a partner at home.

    Without `within`, points at home are compared with the others only.
    """
    forest, own = Forest(len(points)), np.flatnonzero(home)
    order = np.concatenate([own, np.flatnonzero(~home)]) if within else np.flatnonzero(~home)
    target = points[own]
    for at in range(0, len(order), block):
        rows = order[at : at + block]
        # Points at home are compared with those before them only.
        columns = min(at + len(rows), len(own)) if within else len(own)
        i, j = np.nonzero(distance(points[rows][:, None], target[None, :columns]) <= reach)
        a, b = rows[i], own[j]
        forest.merge(a[a != b], b[a != b])
    linked = np.flatnonzero(forest.label != np.arange(len(points)))
    return linked, forest.label[linked]


def near_links(
    prints: DataFrame, *, fp: str = "fp", leaf_rows: int = 2000, min_leaves: int = 32, sample_rows: int = 8192, sample_per_leaf: int = 16, unit_rows: int = 16384
) -> DataFrame:
    """(src, dst) links of distinct fingerprints, enough to connect all that are linked at `MAX_BITS` or fewer bits.

    `prints` holds each fingerprint once; an empty table has no links. The tree has about n / `leaf_rows` leaves at every
    size, `min_leaves` at least. It is fitted on a sample by hash of about `sample_per_leaf` fingerprints a leaf (one in
    125 at these settings) or `sample_rows`, if that is more: the sample and the tree, some tens of bytes a leaf, are
    all that reaches the driver. A leaf of more than `unit_rows` members or visitors is dealt out in units, and every two
    units are compared in a group of their own; the other leaves are a group each. A group returns a spanning forest,
    so thousands of near copies give thousands of links.
    """
    n = prints.count()
    leaves = max(min_leaves, -(-n // leaf_rows))
    share = min(1.0, max(sample_rows, sample_per_leaf * leaves) / max(1, n))
    chosen = F.pmod(F.xxhash64(fp), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = prints.where(chosen).select(fp).toPandas()[fp].to_numpy(np.int64)
    tree = build_tree(np.sort(sample).view(np.uint64), leaves)
    units: dict[tuple[int, bool], int] = {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for at, leaf, home in tree.route(batch.column(0).to_numpy().view(np.uint64)):
                found[leaf, home] += len(at)
        rows = [(leaf, home, n) for (leaf, home), n in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.int64(), pa.bool_(), pa.int64()), strict=True)], names=["leaf", "home", "n"])

    plain = prints.select(F.col(fp).alias("fp"))
    large = plain.mapInArrow(count, "leaf long, home boolean, n long").groupBy("leaf", "home").agg(F.sum("n").alias("n")).where(F.col("n") > unit_rows)
    for r in large.collect():  # a row for each `unit_rows` routed fingerprints at most
        units[r["leaf"], r["home"]] = -(-r["n"] // unit_rows)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            parts = []
            for at, leaf, home in tree.route(points):
                homes, visits = units.get((leaf, True)), units.get((leaf, False))
                if homes is None and visits is None:
                    parts.append((at, leaf, 0, 0, home))
                    continue
                homes, visits = homes or 1, visits or 1
                unit = (points[at] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(homes if home else visits)
                parts += [(at[mine], leaf, a, b, not right) for mine, a, b, right in unit_pairs(unit.astype(np.int64), home, homes, visits)]
            column = lambda i, kind: np.repeat(np.array([p[i] for p in parts], kind), [len(p[0]) for p in parts])
            at = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            columns = [column(1, np.int64), column(2, np.int64), column(3, np.int64), column(4, bool), points[at].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["leaf", "a", "b", "home", "fp"])

    def link(group: pa.Table) -> pa.Table:
        points = group.column("fp").to_numpy().view(np.uint64)
        within = group.column("a")[0] == group.column("b")[0]
        a, b = leaf_links(points, group.column("home").to_numpy(zero_copy_only=False), within=within)
        return pa.table({"src": points[a].view(np.int64), "dst": points[b].view(np.int64)})

    routed = plain.mapInArrow(spread, "leaf long, a long, b long, home boolean, fp long")
    return routed.groupBy("leaf", "a", "b").applyInArrow(link, "src long, dst long")


def groups(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: key, fingerprint (16 hex digits), component_id (smallest key reachable).

    Rows whose fingerprints differ in 3 or fewer bits are linked. A null or blank text has fingerprint 0 and is
    linked like any other; a text of any length is read whole. Rows with a null key keep their fingerprint and take
    part in nothing else: they get the group of their fingerprint, null if no key has it. Repeated rows are returned as
    often as given, an empty table gives no rows, and other columns, whatever their names, are left out.
    """
    prints, answer = _answered(docs, text, key)
    return prints.join(answer, "fp").select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _answered(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(k, fp) of every row, and (fp, root, component_id) of every fingerprint; `root` names the group."""
    prints = materialize(fingerprints(docs, text=text, key=key), "fingerprints")
    # One row per distinct fingerprint: exact copies, however many, take no further part.
    distinct = materialize(prints.groupBy("fp").agg(F.min("k").alias("low")), "distinct")
    parts = connected_components(near_links(distinct.select("fp")))
    rooted = distinct.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    # Written, so that both sides of the last join are plain exchanges and a hot fingerprint can be split.
    return prints, materialize(rooted.join(lowest, "root").select("fp", "root", "component_id"), "answer")


def deduplicate(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` that are first (smallest key) in their group, all columns kept; rows with a null key stay.

    A row is judged by its key and its own fingerprint, so that texts of different groups may share a key: each
    group keeps one row. Of rows of one group repeated under the key that stays, that with the smallest text (null
    first) is returned, an arbitrary one if the texts are equal too. Null and blank texts are one group, texts of any
    length are read whole, and an empty table stays empty. Columns may have any names.
    """
    prints, answer = _answered(docs, text, key)
    placed = prints.where("k IS NOT NULL").join(answer, "fp")
    keys = placed.groupBy("k").agg((F.count("*") > 1).alias("several"), F.min("component_id").alias("first"))
    # Rows under a key of their own are judged by the key; only those that share one need their fingerprint.
    keys = materialize(keys.where((F.col("k") != F.col("first")) | F.col("several")), "keys")
    kept = docs.join(keys.select("k").withColumnRenamed("k", gone := fresh(docs, "_gone")), F.col(key) == F.col(gone), "left_anti")
    several = keys.where("several").select(F.col("k").alias(gone))
    if several.isEmpty():
        return kept
    shared = docs.join(several, F.col(key) == F.col(gone), "left_semi")
    shared = shared.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.col(text).alias("t"), _fingerprint_of(F.col(text)).alias("fp"))
    # Written, so that a hot fingerprint can be split in the join.
    chosen = materialize(shared, "shared").join(answer, "fp").where("k = component_id")
    least = F.struct(F.col("t").isNotNull(), F.coalesce("t", F.lit("")))
    return kept.unionByName(chosen.groupBy("k", "root").agg(F.min_by("row", least).alias("row")).select("row.*"))


def _fingerprint_of(text: Column) -> Column:
    @F.pandas_udf("long")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return compute(text.cast("binary"))
