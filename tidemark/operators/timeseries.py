"""Time series: ranges, down-sampling, retention, and files by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(df: DataFrame, ts_col: str, start: str, end: str) -> DataFrame:
    """start <= ts < end, as constants that reach the scan."""
    kind = df.schema[ts_col].dataType.simpleString()
    return df.filter((F.col(ts_col) >= F.lit(start).cast(kind)) & (F.col(ts_col) < F.lit(end).cast(kind)))


def downsample(df: DataFrame, ts_col: str, every: str, by: list[str], aggregates: list[Column]) -> DataFrame:
    """One row per tumbling window and key: partial aggregation before the shuffle."""
    grouped = df.groupBy(F.window(ts_col, every).alias("_w"), *by).agg(*aggregates)
    return grouped.select(F.col("_w.start").alias("bucket"), *[c for c in grouped.columns if c != "_w"])


def retain(df: DataFrame, ts_col: str, now: str, days: int) -> DataFrame:
    """Rows younger than ``days`` at ``now``."""
    kind = df.schema[ts_col].dataType.simpleString()
    return df.filter(F.col(ts_col) >= (F.lit(now).cast(kind) - F.make_dt_interval(F.lit(days))))


def write_by_day(df: DataFrame, ts_col: str, path: str) -> None:
    """Files in one directory per day, so that ranges prune directories and retention drops them."""
    day = F.to_date(ts_col)
    df.withColumn("day", day).repartition("day", F.pmod(F.xxhash64(ts_col), F.lit(16))).write.partitionBy("day").parquet(path)
