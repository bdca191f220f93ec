"""An approximate index of vectors: cells around centres, of which a search opens the nearest.

The centres are fitted by k-means on at most SAMPLE rows, those of the smallest hashes of their ids;
then every row goes to the cell of its nearest centre. The rows are written in the order of the cells,
so that a search for a few cells skips the other files and row groups. Centres are at most MOST_CELLS
vectors: that is all that the driver and the workers hold. How many cells a search opens is measured on
the sample: as few as hold RECALL of the ten nearest other sample rows of TRIALS sample rows. Vectors in
clusters need few; where there is no structure, most cells are opened and an exact search costs the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import ID
from ..storage import written

CELL = "__cell"
SAMPLE = 20_000
MOST_CELLS = 1024
ROUNDS = 12
TRIALS = 200
RECALL = 0.95


def _points(vectors, metric: str) -> np.ndarray:
    """Rows as doubles; of length one for Cosine (zero vectors stay)."""
    points = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    if metric == "Cosine" and len(points):
        points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
    return points


def _squared_gaps(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of points and centres, less the points' own squared lengths."""
    return (centres**2).sum(axis=1) - 2 * points @ centres.T


def _centres(points: np.ndarray, cells: int, seed: int) -> np.ndarray:
    centres = points[np.random.default_rng(seed).choice(len(points), cells, replace=False)].copy()
    for _ in range(ROUNDS):
        own = _squared_gaps(points, centres).argmin(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=cells)
        np.add.at(sums, own, points)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def _by_nearness(points: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    """All cells for each point, the most promising first."""
    gaps = -points @ centres.T if metric == "Ip" else _squared_gaps(points, centres)
    return gaps.argsort(axis=1, kind="stable")


def _probes(points: np.ndarray, centres: np.ndarray, metric: str) -> int:
    """The cells to open, from the sample."""
    trials = min(TRIALS, len(points))
    own = _squared_gaps(points, centres).argmin(axis=1)
    some = points[:trials]
    gaps = -some @ points.T if metric == "Ip" else _squared_gaps(some, points)
    gaps[np.arange(trials), np.arange(trials)] = np.inf
    best = gaps.argsort(axis=1, kind="stable")[:, : min(10, len(points) - 1)]
    if not best.size:
        return len(centres)
    rank = _by_nearness(some, centres, metric).argsort(axis=1)  # of each cell, for each trial
    ranks = np.sort(np.take_along_axis(rank, own[best], axis=1).ravel())
    return int(ranks[int(np.ceil(RECALL * len(ranks))) - 1]) + 1


@dataclass
class VectorCells:
    rows: DataFrame  # __id, vector, __cell
    centres: np.ndarray
    metric: str
    probes: int

    def by_nearness(self, target: list[float]) -> list[int]:
        """All cells, the most promising first."""
        return _by_nearness(_points([target], self.metric), self.centres, self.metric)[0].tolist()

    def near(self, target: list[float], k: int, matched: DataFrame) -> DataFrame:
        """(__id, vector) of the nearest cells: ``probes`` of them, or twice as many until k of the matched
        rows' ids are among them; in the end all, so that a search misses no row for want of others."""
        order, take = self.by_nearness(target), self.probes
        while True:
            rows = self.rows.filter(F.col(CELL).isin(order[:take])).drop(CELL)
            if take >= len(order) or matched.join(rows.select(ID), ID).limit(k).count() >= k:
                return rows
            take *= 2


def build_cells(vectors: DataFrame, dim: int, metric: str, cells: int | None = None, probes: int | None = None, seed: int = 11) -> VectorCells | None:
    """An index over (__id, vector); None where there is nothing to index. Rows without a vector of the
    dimension stay out, as in an exact search. By default there are as many cells as the square root of
    the rows, and as many are opened as the sample asks for."""
    held = vectors.select(ID, "vector").filter((F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull()))
    n = held.count()
    if not n:
        return None
    sample = held.orderBy(F.xxhash64(ID, F.lit(seed)), ID).limit(SAMPLE).select("vector").toPandas()
    points = _points(sample["vector"], metric)
    cells = max(1, min(cells or round(n**0.5), MOST_CELLS, len(points)))
    centres = _centres(points, cells, seed)

    lengths, unit = (centres**2).sum(axis=1), metric == "Cosine"

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # as above, but with nothing of this package: workers on other machines may lack it
        for b in batches:
            if len(b):
                points = np.array([np.asarray(v, dtype=np.float64) for v in b["vector"]])
                if unit:
                    points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
                b[CELL] = (lengths - 2 * points @ centres.T).argmin(axis=1).astype("int32")
                yield b

    rows = held.mapInPandas(assigned, f"{ID} long, vector array<float>, {CELL} int")
    # the id parts a cell that holds a large share of the rows
    ordered = rows.repartitionByRange(F.col(CELL), F.col(ID)).sortWithinPartitions(CELL, ID)
    return VectorCells(written(ordered, "cells"), centres, metric, max(1, min(probes or _probes(points, centres, metric), cells)))
