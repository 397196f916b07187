"""An inverted file of vectors: cells around trained centroids, and which of them a query has to look into.

Similarity is the cosine, so distances are angles, and the triangle inequality holds for them: a vector whose angle from
a centroid is between ``inner`` and ``outer`` is at least ``max(a - outer, inner - a)`` away from a query whose angle from
that centroid is ``a``. Cells that cannot hold a better vector need not be read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The number of cells is bounded: the centroids go to every task. A cell has about so many vectors or more: fewer are
#: compared at once faster than cells are told apart.
MOST_CELLS, CELL_ROWS = 4096, 1024
#: Centroids are trained on about so many vectors each, picked by hash.
TRAINED_ON = 64
ITERATIONS = 5
#: Vectors of zeros have no direction and are in a cell of their own.
ZERO_CELL = -1
#: Angles are exact to far more than this.
SLACK = 1e-9


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """The vectors at length 1, a row each; those of zeros stay zeros."""
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _angles(units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centroids.T, -1.0, 1.0))


@dataclass(frozen=True)
class CellFile:
    """Centroids, a row each, and the rings their vectors lie in: least and greatest angle, NaN for an empty cell."""

    centroids: np.ndarray
    inner: np.ndarray | None = None
    outer: np.ndarray | None = None
    has_zeros: bool = False

    @property
    def size(self) -> int:
        return len(self.centroids)

    def place(self, vector: Column) -> Column:
        """The cell of a vector and its angle from the centroid, as a struct."""
        centroids = self.centroids

        @F.pandas_udf("cell int, angle double")
        def placed(vectors: pd.Series) -> pd.DataFrame:
            units = unit_rows(vectors)
            angles = _angles(units, centroids)
            cell = angles.argmin(axis=1)
            angle = angles[np.arange(len(cell)), cell]
            none = ~units.any(axis=1)
            return pd.DataFrame({"cell": np.where(none, ZERO_CELL, cell), "angle": np.where(none, 0.0, angle)})

        return placed(vector)

    def with_rings(self, placed: DataFrame) -> CellFile:
        """The same file with the rings of the ``placed`` vectors: one row per cell is collected."""
        rows = placed.groupBy("cell").agg(F.min("angle").alias("inner"), F.max("angle").alias("outer")).collect()
        inner, outer = np.full(self.size, np.nan), np.full(self.size, np.nan)
        for r in rows:
            if r["cell"] != ZERO_CELL:
                inner[r["cell"]], outer[r["cell"]] = r["inner"], r["outer"]
        return replace(self, inner=inner, outer=outer, has_zeros=any(r["cell"] == ZERO_CELL for r in rows))

    def _order(self, angles: np.ndarray) -> np.ndarray:
        return np.argsort(angles, axis=1, kind="stable")

    def open_cells(self, units: np.ndarray, to_beat: np.ndarray) -> np.ndarray:
        """Of each query (a row) the cells that may hold a vector with at least the score ``to_beat``; the last column is
        the cell of zeros."""
        angles = _angles(units, self.centroids)
        apart = np.maximum(np.maximum(angles - self.outer, self.inner - angles), 0.0)
        limit = to_beat[:, None] - SLACK
        # A query of zeros has the score 0 with every vector.
        bound = np.where(units.any(axis=1)[:, None], np.cos(np.minimum(apart, np.pi)), 0.0)
        return np.hstack([(bound >= limit) & ~np.isnan(self.outer), (limit <= 0) & self.has_zeros])

    def reachable(self, vector: Column, to_beat: Column, but: int) -> Column:
        """The cells that may hold a vector with at least the score ``to_beat``, without the ``but`` nearest ones."""
        file = self

        @F.pandas_udf("array<int>")
        def cells(vectors: pd.Series, beat: pd.Series) -> pd.Series:
            units = unit_rows(vectors)
            open_ = file.open_cells(units, beat.to_numpy())
            np.put_along_axis(open_, file._order(_angles(units, file.centroids))[:, :but], False, axis=1)
            numbers = np.append(np.arange(file.size, dtype=np.int32), np.int32(ZERO_CELL))
            return pd.Series([numbers[row] for row in open_])

        return cells(vector, to_beat)

    def rank_of(self, vector: Column, cell: Column) -> Column:
        """The place of a cell among those nearest to a query, from 1; the cell of zeros comes last."""
        file = self

        @F.pandas_udf("int")
        def rank(vectors: pd.Series, cell: pd.Series) -> pd.Series:
            order = file._order(_angles(unit_rows(vectors), file.centroids))
            own = cell.to_numpy()
            found = (order == own[:, None]).argmax(axis=1) + 1
            return pd.Series(np.where(own == ZERO_CELL, file.size, found).astype(np.int32))

        return rank(vector, cell)


@dataclass(frozen=True)
class Look:
    """Which cells a query looks into: the ``probes`` nearest ones and, with ``whole``, all that may hold a better vector."""

    file: CellFile
    probes: int
    whole: bool

    def own(self, units: np.ndarray) -> np.ndarray:
        """The nearest cell of each query."""
        steps = range(0, len(units), CELL_ROWS)
        return np.concatenate([_angles(units[i : i + CELL_ROWS], self.file.centroids).argmin(axis=1) for i in steps])

    def first(self, units: np.ndarray) -> np.ndarray:
        """The nearest cells of each query (a row), as marks; the last column is the cell of zeros."""
        marks = np.zeros((len(units), self.file.size + 1), bool)
        np.put_along_axis(marks, self.file._order(_angles(units, self.file.centroids))[:, : self.probes], True, axis=1)
        return marks


def trained(vectors: DataFrame, n_cells: int | None = None) -> CellFile | None:
    """Centroids of the column ``vector``, by k-means on Spark over a bounded part of the rows, picked by their hash.

    Their number is about the square root of that of the vectors, up to ``MOST_CELLS`` and as far as cells keep
    ``CELL_ROWS`` vectors. None where one cell is enough, or where no vector has a direction.
    """
    some = vectors.where(F.exists("vector", lambda x: x != 0)).select(F.col("vector").cast("array<double>").alias("vector"))
    n = some.count()
    k = min(n_cells or min(round(n**0.5), n // CELL_ROWS), MOST_CELLS, n)
    if k <= 1:
        return None
    share = min(1.0, TRAINED_ON * k / n)
    picked = some.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) <= int(share * (1 << 20)))
    means = KMeans(k=k, distanceMeasure="cosine", initMode="random", maxIter=ITERATIONS, seed=1)
    model = means.fit(picked.select(array_to_vector("vector").alias("features")))
    centres = unit_rows(pd.Series(model.clusterCenters()))
    return CellFile(centres[centres.any(axis=1)])


def placed_in(file: CellFile, vectors: DataFrame) -> DataFrame:
    """``vectors`` with their ``cell`` and its ``angle``."""
    place = vectors.withColumn("_place", file.place(F.col("vector")))
    return place.select(*vectors.columns, "_place.cell", "_place.angle")
