"""Memory life cycle: forgetting curve, tiers, row security and quotas by agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument


def strength(count: Column, age: Column, decay: float) -> Column:
    """Frequency times decay: ln(1 + count) * exp(-decay * age)."""
    return F.log1p(count) * F.exp(-F.lit(float(decay)) * age)


def tier(value: Column, hot: float, warm: float) -> Column:
    return F.when(value >= hot, "hot").when(value >= warm, "warm").otherwise("cold")


def secured(df: DataFrame, agent: int, agent_col: str = "_agent_id") -> DataFrame:
    """Only this agent's rows; the condition reaches the scan."""
    return df.filter(F.col(agent_col) == agent)


def over_quota(df: DataFrame, limit: int, agent_col: str = "_agent_id") -> DataFrame:
    """Agents with more rows than allowed."""
    if limit < 0:
        raise InvalidArgument("a quota is 0 or more")
    return df.groupBy(agent_col).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > limit)
