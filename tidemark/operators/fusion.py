"""Fusion of candidate paths: intersection as semi-joins, reciprocal ranks as a union."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Constant of reciprocal rank fusion.
RANK_OFFSET = 60


class AccessPath(Protocol):
    """Anything that turns a query into candidates."""

    def candidates(self, df: DataFrame, query) -> DataFrame:
        """id and score, best score first."""


def intersect(rows: DataFrame, paths: Sequence[DataFrame], id_col: str) -> DataFrame:
    """Rows whose id is in every path."""
    return reduce(lambda df, path: df.join(path.select(id_col), id_col, "left_semi"), paths, rows)


def ranked(path: DataFrame, id_col: str, score_col: str, ascending: bool = False) -> DataFrame:
    """id and rank within a path. A path is a top-k list: its length is bounded by k, so one task ranks it."""
    score = F.col(score_col).asc() if ascending else F.col(score_col).desc()
    return path.select(id_col, F.row_number().over(Window.orderBy(score, id_col)).alias("_rank"))


def reciprocal_ranks(paths: Sequence[tuple[DataFrame, str, bool]], id_col: str, k: int, out: str = "score") -> DataFrame:
    """The best ``k`` ids by the sum of 1 / (60 + rank) over paths (list, score column, whether less is better)."""
    parts = [ranked(path, id_col, score, ascending) for path, score, ascending in paths]
    union = reduce(DataFrame.unionAll, parts)
    return union.groupBy(id_col).agg(F.sum(1 / (F.lit(RANK_OFFSET) + F.col("_rank"))).alias(out)).orderBy(F.col(out).desc(), id_col).limit(k)


def explain(paths: Sequence[tuple[str, DataFrame]]) -> str:
    """The paths of a fused query, each with its plans."""
    return "\n".join(f"-- {name}\n{path._jdf.queryExecution().toString()}" for name, path in paths)
