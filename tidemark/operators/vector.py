"""Exact nearest neighbours: the distance is a column, the k best are a top-k, which keeps k rows in each task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import distance


def nearest(df: DataFrame, vector_col: str, query: Sequence[float], k: int | None, metric: str = "l2", id_col: str = "vec_id", where: Column | None = None, out: str = "distance") -> DataFrame:
    """The ``k`` rows closest to the query with their distance, ties by id; all rows in no order if ``k`` is None. ``where`` filters before ranking."""
    rows = df if where is None else df.filter(where)
    measured = rows.withColumn(out, distance.metric(metric)(distance.as_vector(F.col(vector_col)), distance.as_vector(query)))
    measured = measured.filter(F.col(out).isNotNull())
    return measured if k is None else measured.orderBy(out, id_col).limit(k)


def _nearest_in_batches(ids: np.ndarray, queries: np.ndarray, k: int, probed: np.ndarray | None):
    """The ``k`` best rows of a task for each query, ties by id; ``probed`` (query, cell) tells the cells that a query reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0), np.empty(0, np.int64))] * len(ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, vectors = batch.column("_id").to_numpy(zero_copy_only=False), np.array(batch.column("_v").to_pylist(), float)
            cell = batch.column("_cell").to_numpy(zero_copy_only=False)
            for i, query in enumerate(queries):
                seen = slice(None) if probed is None else probed[i, cell]
                far = np.concatenate([best[i][0], np.sqrt(((vectors[seen] - query) ** 2).sum(1))])
                of = np.concatenate([best[i][1], rows[seen]])
                order = np.lexsort((of, far))[:k]
                best[i] = (far[order], of[order])
        sizes = [len(x) for x, _ in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([x for _, x in best])), pa.array(np.concatenate([x for x, _ in best]))], names=["query_id", "vec_id", "distance"])

    return run


def nearest_of_each(df: DataFrame, vector_col: str, queries: DataFrame, k: int, cells: Cells | None = None, count: int = 4, id_col: str = "vec_id", cell_col: str = "cell", block: int = 256) -> DataFrame:
    """query_id, vec_id, distance: the ``k`` rows closest to each of ``queries`` (same columns as ``df``), exactly or, with
    ``cells``, among the ``count`` nearest cells. Queries go out in blocks; a task keeps k rows for each query of a block."""
    cell = F.col(cell_col) if cells else F.lit(0)
    parts, found = [], []

    def search() -> None:
        ids, vectors = np.array([i for i, _ in parts], np.int64), np.array([v for _, v in parts], float)
        probed = None
        if cells:
            probed = np.zeros((len(ids), len(cells.centroids)), bool)
            for i, v in enumerate(vectors):
                probed[i, cells.probes(v, count)] = True
        rows = df.filter(F.size(vector_col) == vectors.shape[1]).select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), cell.alias("_cell"))
        found.append(rows.mapInArrow(_nearest_in_batches(ids, vectors, k, probed), "query_id long, vec_id long, distance double"))
        parts.clear()

    for row in queries.filter(F.col(vector_col).isNotNull()).select(id_col, vector_col).orderBy(F.size(vector_col), id_col).toLocalIterator():
        if len(parts) == block or parts and len(parts[0][1]) != len(row[1]):
            search()
        parts.append((row[0], row[1]))
    if parts:
        search()
    if not found:
        return df.sparkSession.createDataFrame([], "query_id long, vec_id long, distance double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return reduce(DataFrame.unionAll, found).withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


@dataclass(frozen=True)
class Cells:
    """An inverted-file index: every row belongs to the cell of its nearest centroid, and a search reads the cells nearest
    to the query. Centroids are fitted on a sample of at most ``sample`` rows; all rows are assigned."""

    centroids: tuple[tuple[float, ...], ...]

    @staticmethod
    def fit(df: DataFrame, vector_col: str, cells: int = 16, sample: int = 4096, rounds: int = 8, seed: int = 7) -> Cells:
        order = F.xxhash64(F.col(vector_col).cast("array<double>"))
        rows = df.filter(F.col(vector_col).isNotNull()).select(vector_col, order.alias("_o")).orderBy("_o").limit(sample).collect()
        data = np.array([r[0] for r in rows], float)
        if not len(data):
            return Cells(())
        rng = np.random.default_rng(seed)
        centres = data[rng.choice(len(data), min(cells, len(data)), replace=False)]
        for _ in range(rounds):
            nearest_cell = ((data[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([data[nearest_cell == k].mean(0) if (nearest_cell == k).any() else centres[k] for k in range(len(centres))])
        return Cells(tuple(map(tuple, centres.tolist())))

    def assign(self, df: DataFrame, vector_col: str, out: str = "cell") -> DataFrame:
        """Adds the cell of each row; write it with ``partitionBy`` on that column, so that searches prune directories."""
        vector = distance.as_vector(F.col(vector_col))
        measured = [F.struct(distance.l2(vector, distance.as_vector(c)).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(self.centroids)]
        return df.withColumn(out, F.array_min(F.array(*measured))["k"] if measured else F.lit(None).cast("int"))

    def probes(self, query: Sequence[float], count: int) -> list[int]:
        """The cells nearest to a query."""
        far = ((np.array(self.centroids) - np.array(query, float)) ** 2).sum(1) if self.centroids else np.empty(0)
        return np.argsort(far, kind="stable")[:count].tolist()

    def nearest(self, assigned: DataFrame, vector_col: str, query: Sequence[float], k: int, count: int = 4, id_col: str = "vec_id", cell_col: str = "cell") -> DataFrame:
        """The best ``k`` of the ``count`` nearest cells: approximate unless all cells are probed."""
        return nearest(assigned, vector_col, query, k, id_col=id_col, where=F.col(cell_col).isin(self.probes(query, count)))
