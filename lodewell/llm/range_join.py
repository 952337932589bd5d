"""Near-duplicate vectors by an exact metric range join.

On the unit sphere a cosine of at least t is a Euclidean distance of at most eps = sqrt(2 - 2t). Pivots divide the
vectors of a label into cells, each vector at home with its nearest pivot. A vector also visits a cell unless the
triangle inequality, or the distance to the plane between the two pivots, rules out a partner there. Cells join
independently; of two cells only the later one's vectors visit, so each pair meets once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.llm.dealing import unit_pairs
from lodewell.llm.simhash import Forest
from lodewell.llm.vectors import matrix, units, usable
from lodewell.operators.components import connected_components
from lodewell.sources.tables import materialize

COSINE = 0.93


def pivot_number(n: int) -> int:
    """How many pivots n vectors get."""
    return max(2, math.isqrt(n) // 8 + 1)


@dataclass(frozen=True)
class Pivots:
    """Unit vectors that divide the sphere into cells, each point at home with the nearest."""

    x: np.ndarray
    reach: float

    def route(self, x: np.ndarray, *, every: bool = False) -> Iterator[tuple[np.ndarray, int, bool]]:
        """(positions, cell, at home) of unit vectors, and with home False the cells that they visit.

        Of two cells only the later one's vectors visit the other, or with `every` those of both.
        """
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ self.x.T)))
        home = d.argmin(axis=1)
        nearest = d[np.arange(len(x)), home]
        apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.x @ self.x.T)))
        for c in range(len(self.x)):
            if (at := np.flatnonzero(home == c)).size:
                yield at, c, True
            other = (home != c) if every else (home > c)
            near = other & (d[:, c] <= nearest + 2 * self.reach)
            plane = (d[:, c] ** 2 - nearest**2) <= 2 * self.reach * apart[home, c]
            if (at := np.flatnonzero(near & plane)).size:
                yield at, c, False


def reach_of(cosine: float) -> float:
    """The distance of unit vectors with this cosine, with room for rounding."""
    return math.sqrt(2 - 2 * cosine) + 1e-7


def links_within(home: np.ndarray, other: np.ndarray | None, cosine: float, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in home, positions in other) of linked unit vectors; without other, pairs of home, each once.

    Pivots from home divide both sides; a cell compares its members with one another or with the others that lie in it
    or visit it.
    """
    if not len(home):
        return
    picked = np.unique(np.linspace(0, len(home) - 1, pivot_number(len(home))).astype(np.int64))
    pivots = Pivots(home[picked], reach_of(cosine))
    members: dict[int, np.ndarray] = {}
    visitors: dict[int, list[np.ndarray]] = {}
    for at, cell, stays in pivots.route(home):
        if stays:
            members[cell] = at
        elif other is None:
            visitors.setdefault(cell, []).append(at)
    if other is not None:
        for at, cell, _ in pivots.route(other, every=True):
            visitors.setdefault(cell, []).append(at)
    target = home if other is None else other
    for cell, mine in members.items():
        x = home[mine]
        if other is None:
            for at in range(0, len(mine), block):
                i, j = np.nonzero(x[at : at + block] @ x[at:].T >= cosine)
                i, j = (i + at)[i < j], (j + at)[i < j]
                yield mine[i], mine[j]
        for theirs in visitors.get(cell, []):
            for at in range(0, len(theirs), block):
                i, j = np.nonzero(x @ target[theirs[at : at + block]].T >= cosine)
                yield mine[i], theirs[at + j]


@dataclass
class Cells:
    """The pivots of each large part (label and dimension) with the number of its first cell, and in how many units the
    homes and visitors of a cell are dealt."""

    pivots: dict[str, Pivots]
    first: dict[str, int]
    home_units: dict[int, int] = field(default_factory=dict)
    visit_units: dict[int, int] = field(default_factory=dict)

    def route(self, part: str, x: np.ndarray) -> Iterator[tuple[np.ndarray, int, bool]]:
        for at, cell, home in self.pivots[part].route(x):
            yield at, self.first[part] + cell, home


def near_vectors(
    vectors: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
    part_rows: int = 4096,
    unit_rows: int = 4096,
) -> DataFrame:
    """One row per row of `vectors`: key, n_links, component_id (smallest key reachable), kept (key = component_id).

    Vectors of one label, not null, are linked if their cosine in double precision is at least `cosine`; vectors that
    are null, empty, zero or hold a null or non-finite component, and vectors of different length, link with nothing.
    Exact copies are joined as one vector and counted as many; repeated rows are copies. A null key is returned
    with component_id null and kept false, but its row counts as a partner. An empty table gives no rows, and other
    columns, whatever their names, are left out.

    A label of more than `part_rows` vectors is divided by pivots, an eighth of the square root of their number, which are
    all that reaches the driver; a smaller one is one group, divided by pivots of its own. Cells of over `unit_rows`
    vectors are dealt out in units, and every two units compared in a group of their own, by pivots again. A group
    returns counts and a spanning forest of its links.
    """
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).alias("x"), F.col(label).alias("l"))
    part = F.concat_ws(":", F.col("l").cast("string"), F.size("x").cast("string"))
    rows = rows.withColumn("part", F.when(usable("x") & F.col("l").isNotNull(), part))
    copies = rows.where("part IS NOT NULL").groupBy("part", "x").agg(F.min("k").alias("low"), F.count("*").alias("m"))
    # A copy's number stands for it: keys may be null or of any type.
    copies = materialize(copies.withColumn("rep", F.monotonically_increasing_id()), "copies")
    sizes = copies.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > part_rows).collect()  # a row for each `part_rows` vectors at most
    cells = _choose(copies, {r["part"]: pivot_number(r["n"]) for r in sizes}, reach_of(cosine))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = np.array(batch.column(0).to_pylist(), dtype=object)
            for p in set(parts):
                at = np.flatnonzero(parts == p)
                some = batch.take(pa.array(at))
                if p not in cells.pivots:
                    yield _dealt(some, np.arange(len(at)), p, True, 1, 0)
                    continue
                for where, cell, home in cells.route(p, units(matrix(some.column(3)))):
                    yield _dealt(some, where, str(cell), home, cells.home_units.get(cell, 1), cells.visit_units.get(cell, 0))

    def _dealt(batch: pa.RecordBatch, at: np.ndarray, cell: str, home: bool, homes: int, visits: int) -> pa.RecordBatch:
        """The rows at `at` for each pair of units that theirs is in."""
        unit = (batch.column(1).to_numpy()[at] * 0x9E3779B1 >> 7) % (homes if home else max(1, visits))
        pairs = list(unit_pairs(unit, home, homes, visits))
        count = [len(mine) for mine, *_ in pairs]
        groups = np.repeat([f"{cell}/{a}/{b}" for _, a, b, _ in pairs], count)
        right = np.repeat([r for *_, r in pairs], count)
        out = batch.take(pa.array(at[np.concatenate([mine for mine, *_ in pairs])]))
        return pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(right), out.column(1), out.column(2), out.column(3)], names=["g", "right", "rep", "m", "x"])

    def join(group: pa.Table) -> pa.Table:
        right, rep, m = (group.column(c).to_numpy(zero_copy_only=False) for c in ("right", "rep", "m"))
        x = units(matrix(group.column("x")))
        left = np.flatnonzero(~right)
        other = np.flatnonzero(right)
        _, a, b = group.column("g")[0].as_py().rsplit("/", 2)
        found, forest = np.zeros(len(rep), np.int64), Forest(len(rep))
        for i, j in links_within(x[left], None if a == b else x[other], cosine):
            i, j = left[i], (left if a == b else other)[j]
            np.add.at(found, i, m[j])
            np.add.at(found, j, m[i])
            forest.merge(i, j)
        some = np.flatnonzero(found)
        return pa.table({"rep": rep[some], "n": found[some], "root": rep[forest.label[some]]})

    plain = copies.select("part", "rep", "m", "x")
    kind = "g string, right boolean, rep long, m long, x " + copies.schema["x"].dataType.simpleString()
    if cells.pivots:
        _count_units(plain, cells, unit_rows)
    found = materialize(plain.mapInArrow(spread, kind).groupBy("g").applyInArrow(join, "rep long, n long, root long"), "links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = connected_components(found, "rep", "root").withColumnRenamed("node", "rep")
    known = copies.join(counts, "rep", "left").join(parts, "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    known = known.join(lowest, "root").select("part", "x", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    known = materialize(known, "answer")  # both sides of the join are plain exchanges: a hot vector can be split
    out = rows.join(known, ["part", "x"], "left")
    component = F.when(F.col("part").isNull(), F.col("k")).otherwise(F.col("component_id"))
    component = F.when(F.col("k").isNotNull(), component)
    return out.select(
        F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("k"), F.lit(False)).alias("kept")
    )


def _choose(copies: DataFrame, wanted: dict[str, int], reach: float) -> Cells:
    """Pivots of the parts in `wanted`: of each hash bucket of a part the vector with the least hash."""
    cells = Cells({}, {})
    if not wanted:
        return cells
    table = copies.sparkSession.createDataFrame(sorted(wanted.items()), "part string, want long")
    hashed = copies.join(F.broadcast(table), "part").withColumn("h", F.xxhash64("x"))
    picked = hashed.groupBy("part", F.pmod("h", "want").alias("b")).agg(F.min_by("rep", "h").alias("rep")).select("rep")
    chosen: dict[str, list] = {}
    for r in copies.join(F.broadcast(picked), "rep", "left_semi").select("part", "rep", "x").collect():
        chosen.setdefault(r["part"], []).append((r["rep"], r["x"]))
    at = 0
    for part, rows in sorted(chosen.items()):
        x = np.array([x for _, x in sorted(rows, key=lambda r: r[0])], np.float64)
        cells.pivots[part], cells.first[part] = Pivots(units(x), reach), at
        at += len(x)
    return cells


def _count_units(plain: DataFrame, cells: Cells, unit_rows: int) -> None:
    """Count who is at home in each cell and who visits, and deal them in units of about `unit_rows`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = np.array(batch.column(0).to_pylist(), dtype=object)
            found: list[tuple[int, bool, int]] = []
            for p in cells.pivots.keys() & set(parts):
                some = batch.take(pa.array(np.flatnonzero(parts == p)))
                found += [(cell, home, len(at)) for at, cell, home in cells.route(p, units(matrix(some.column(3))))]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.int64())], names=["c", "home", "n"])

    for r in plain.mapInArrow(count, "c long, home boolean, n long").groupBy("c", "home").agg(F.sum("n").alias("n")).collect():
        (cells.home_units if r["home"] else cells.visit_units)[r["c"]] = -(-r["n"] // unit_rows)
