"""Breadth-first search by frontier joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reach(edges: DataFrame, starts: DataFrame, hops: int, directed: bool = True) -> DataFrame:
    """node, depth of all that lies within ``hops`` of the starts (a column node). ``edges`` has src and dst.

    Each hop joins the frontier with the edges, makes it distinct and takes known nodes away, so no path is walked
    twice; the plan has one join a hop."""
    steps = edges.select("src", "dst")
    if not directed:
        steps = steps.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    levels = [starts.select("node").distinct()]
    for _ in range(hops):
        known = reduce(DataFrame.unionAll, levels)
        found = levels[-1].join(steps, levels[-1]["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct()
        levels.append(found.join(known, "node", "left_anti"))
    return reduce(DataFrame.unionAll, [level.select("node", F.lit(k).alias("depth")) for k, level in enumerate(levels)])
