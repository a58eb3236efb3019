"""Cells of unit vectors for exact similarity joins, by pivots on two levels.

A row lives in the cell of its nearest pivot, first among the pivots of the top level, then among
those of the second level below that pivot. A row that looks for partners within a radius also
visits every cell whose border is within it: a partner that lives there cannot be closer
than that border. This holds on each level, whatever the pivots are.

Cells are numbered in one order. In a join of a table with itself a row visits only cells up to
its own, so each pair meets once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pivots of one level, and below one pivot of the top level. Two levels make enough cells for
# the square of it, times the rows of a block.
MAX_PIVOTS = 4096
# A tree of so many bytes is shipped to the tasks; the second level of a larger one stays distributed.
MAX_TREE_BYTES = 64 * 1024 * 1024
_SECOND = 1 << 32
# A row that looks for partners is copied to at most so many cells on average; cells grow for that up to so many bytes of vectors.
MAX_VISITS = 16
MAX_CELL_BYTES = 64 * 1024 * 1024
# Rows that reach so large a share of the cells are not told apart by them.
_USELESS = 0.75
# Rows that tell how many cells a row reaches, about.
_PROBED = 512
# Places of rows in cells that a task gives out at a time.
_PLACES = 1 << 16
_DRAWS = 1 << 40


def unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix with rows of unit length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    lengths = np.asarray(column.value_lengths())
    if (lengths != lengths[0]).any():
        raise ValueError(f"vectors of different lengths: {sorted(set(lengths.tolist()))[:5]}")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def reached(vectors: np.ndarray, pivots: np.ndarray, slack: float | None, upto_own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, the cells they belong to, and whether the cell is the row's own.

    Without ``slack`` every row has just its own cell. Rows marked in ``upto_own`` visit no cell after their own.
    """
    if not len(pivots):
        return np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.ones(len(vectors), bool)
    squared = 2.0 - 2.0 * vectors @ pivots.T
    home = squared.argmin(axis=1)
    if slack is None:
        return np.arange(len(vectors)), home, np.ones(len(vectors), bool)
    gaps = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * pivots @ pivots.T))
    hit = squared - squared[np.arange(len(home)), home][:, None] <= 2.0 * slack * gaps[home]
    if upto_own is not None:
        hit &= ~upto_own[:, None] | (np.arange(len(pivots))[None, :] <= home[:, None])
    hit[np.arange(len(home)), home] = True
    rows, cells = np.nonzero(hit)
    return rows, cells, cells == home[rows]


class PivotTree:
    """Pivots drawn from ``(_id, _v)`` for about one cell per ``rows`` rows; the same draw whatever the partitioning."""

    def __init__(self, points: DataFrame, rows: int, max_bytes: int = MAX_TREE_BYTES) -> None:
        n = self.n = points.count()
        leaves = self.leaves = max(1, -(-n // rows))
        top = points.orderBy(F.xxhash64("_id"), "_id").limit(min(MAX_PIVOTS, max(1, round(leaves**0.5)))).select("_v").toArrow()
        self.empty = top.num_rows == 0
        self.top = unit_rows(top["_v"])
        # As many draws as cells, twice at most but for chance; another hash than that of the top level.
        share = min(_DRAWS, int(_DRAWS * leaves / max(1, n)))
        drawn = points.where(F.pmod(F.xxhash64(F.lit(2), "_id"), F.lit(_DRAWS)) < share)
        self.seconds: list[np.ndarray] | None = None
        self.drawn = drawn
        if not self.empty and 8 * leaves * self.top.shape[1] <= max_bytes:
            found = unit_rows(drawn.orderBy(F.xxhash64("_id"), "_id").select("_v").toArrow()["_v"])
            home = reached(found, self.top, None, None)[1] if len(found) else np.empty(0, np.int64)
            self.seconds = [found[home == cell] if len(found) else found for cell in range(len(self.top))]

    def flat(self) -> PivotTree:
        """The same points in one cell."""
        self.top, self.leaves = self.top[:1], 1
        self.seconds = [self.top[:0]]
        return self

    def place(self, df: DataFrame, radius: float | None, halved: bool = False) -> DataFrame:
        """``_cell, _own, _id, _v``: every row of ``(_id, _v)`` in its own cell and, with a radius, in those that it reaches."""
        slack = None if radius is None else radius + 1e-6
        kinds = f"_id {df.schema['_id'].dataType.simpleString()}, _v {df.schema['_v'].dataType.simpleString()}"
        placed = f"_cell bigint, _own boolean, {kinds}"
        if self.seconds is not None:
            return df.mapInArrow(_descend(self.top, self.seconds, slack, halved), placed)
        first = df.mapInArrow(_descend(self.top, None, slack, halved), placed)
        below = self.drawn.mapInArrow(_descend(self.top, None, None, False), placed).select("_cell", F.xxhash64("_id").alias("_h"), "_id", "_v")
        # A cell of the top level is dealt to as many groups as it has draws, each with all pivots of the cell.
        dealt = F.broadcast(below.groupBy("_cell").agg(F.count("*").alias("_groups")))  # MAX_PIVOTS rows at most
        rows = first.join(dealt, "_cell", "left").withColumn("_deal", F.pmod(F.xxhash64("_id"), F.coalesce("_groups", F.lit(1)))).drop("_groups")
        pivots = below.join(dealt, "_cell").withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_groups") - 1))).drop("_groups")
        keys = ["_cell", "_deal"]
        return rows.groupBy(*keys).cogroup(pivots.groupBy(*keys)).applyInArrow(_below(slack, halved), placed)


def fitting_tree(points: DataFrame, looking: DataFrame, rows: int, radius: float, halved: bool, max_bytes: int = MAX_TREE_BYTES) -> tuple[PivotTree, int]:
    """A tree in which the rows of ``looking`` reach few cells, and the rows of its cells, at least ``rows``.

    Vectors without clusters reach nearly all cells, and one copy for each of them would make the shuffle
    quadratic. Some rows, drawn by their ids, tell how many cells they reach; while these are too many, the cells
    are made larger. Where rows reach nearly all cells these spare no comparison: there is one cell then, of as few
    hash blocks as the cores need, for a row is copied once for each block. The pairs that are found are the same for every tree.
    """
    cores = points.sparkSession.sparkContext.defaultParallelism
    while True:
        tree = PivotTree(points, rows, max_bytes)
        if tree.empty or tree.leaves <= MAX_VISITS:
            return tree, rows
        largest = max(rows, MAX_CELL_BYTES // (8 * tree.top.shape[1]))
        n = tree.n if halved else looking.count()
        share = min(_DRAWS, int(_DRAWS * _PROBED / max(1, n)))
        probed = looking.where(F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(_DRAWS)) < share)
        seen = tree.place(probed.select("_id", "_v"), radius, halved).agg(F.count_if("_own").alias("rows"), F.count("*").alias("places")).first()
        # Of a table with itself a row visits half of the cells at most.
        if seen["places"] * (1 + halved) > _USELESS * tree.leaves * seen["rows"]:
            return tree.flat(), max(rows, min(largest, math.ceil((tree.n * n / (2 * cores)) ** 0.5)))
        if rows >= largest or seen["places"] <= MAX_VISITS * seen["rows"]:
            return tree, rows
        rows = min(largest, -(-rows * max(2 * MAX_VISITS * seen["rows"], seen["places"]) // (MAX_VISITS * seen["rows"])))


def _taken(rows: np.ndarray, cells: np.ndarray, own: np.ndarray, ids, vectors) -> list:
    return [pa.array(cells, pa.int64()), pa.array(own), ids.take(pa.array(rows)), vectors.take(pa.array(rows))]


_NAMES = ["_cell", "_own", "_id", "_v"]


def _descend(top: np.ndarray, seconds: list[np.ndarray] | None, slack: float | None, halved: bool):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row may reach every cell: few rows at a time then.
        step = max(1, _PLACES // (len(top) if seconds is None else max(1, sum(map(len, seconds))))) if slack is not None else _PLACES
        for batch in (whole.slice(start, step) for whole in batches for start in range(0, whole.num_rows, step)):
            ids, column = batch.column("_id"), batch.column("_v")
            vectors = unit_rows(column)
            rows, cells, own = reached(vectors, top, slack, np.ones(len(vectors), bool) if halved else None)
            if seconds is not None:
                parts = []
                for cell in np.unique(cells).tolist():
                    mine = np.flatnonzero(cells == cell)
                    r, c, o = reached(vectors[rows[mine]], seconds[cell], slack, own[mine] if halved else None)
                    parts.append((rows[mine][r], cell * _SECOND + c, o & own[mine][r]))
                rows, cells, own = (np.concatenate(p) for p in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(_taken(rows, cells, own, ids, column), names=_NAMES)

    return assign


def _below(slack: float | None, halved: bool):
    def assign(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        vectors = unit_rows(rows["_v"])
        if not len(vectors):
            return pa.table(_taken(*[np.empty(0, np.int64)] * 2, np.empty(0, bool), rows["_id"], rows["_v"]), names=_NAMES)
        own = rows["_own"].to_numpy().astype(bool)
        r, c, o = reached(vectors, unit_rows(pivots.sort_by([("_h", "ascending"), ("_id", "ascending")])["_v"]), slack, own if halved else None)
        top = int(rows["_cell"][0].as_py())
        return pa.table(_taken(r, top * _SECOND + c, o & own[r], rows["_id"], rows["_v"]), names=_NAMES)

    return assign
