"""Streams: index maintenance behind the commit log, with a freshness watermark, and windowed down-sampling."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.engine import Engine
from tidemark.sources import table as store

ENTRY = "version long, xid long, actions array<struct<do:string,oid:long,path:string>>"


class IndexFollower:
    """Keeps a sorted projection of one column up to date from the log, asynchronously.

    The stream's source is the log's folder; a batch appends the entries of newly added files and then notes the version
    it has applied. Searches read the projection for what is applied and scan the files that are not."""

    def __init__(self, engine: Engine, table: str, column: str, path: str):
        self.engine, self.table, self.column, self.path = engine, table, column.lower(), path.rstrip("/")

    def _apply(self, batch: DataFrame, number: int) -> None:
        oid = self.engine._state.named(self.table).oid
        entries = batch.select("version", F.explode("actions").alias("a")).filter((F.col("a.oid") == oid) & F.col("a.do").isin("add", "compact"))
        live = set(self.engine._state.named(self.table).files)  # what compaction has replaced since needs no entries
        found = sorted((r["version"], r["path"]) for r in entries.select("version", "a.path").collect() if r["path"] in live)  # metadata
        top = batch.agg(F.max("version")).first()[0]
        spark = self.engine.spark
        if found:
            table = self.engine._state.named(self.table)
            parts = [Engine._sorted_entries(store.read(spark, table.schema, (p,)), self.column).withColumn("_path", F.lit(p)) for _, p in found]
            functools.reduce(DataFrame.unionAll, parts).write.mode("overwrite").parquet(f"{self.path}/entries/batch={number}")
        if top is not None:  # after the entries: a batch that is run again writes the same
            applied = [(top, p) for _, p in found] or [(top, None)]
            spark.createDataFrame(applied, "version long, path string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/applied/batch={number}")

    def start(self, once: bool = True) -> StreamingQuery:
        """Follows the log; ``once``: what there is now, in one go."""
        source = self.engine.spark.readStream.schema(ENTRY).option("pathGlobFilter", "*.json").json(f"{self.engine.root}/log")
        writer = source.writeStream.foreachBatch(self._apply).option("checkpointLocation", f"{self.path}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer).start()

    def applied(self) -> tuple[int, set[str]]:
        """(the newest version applied, the folders that the projection covers)"""
        try:
            rows = self.engine.spark.read.schema("version long, path string").parquet(f"{self.path}/applied").collect()
        except Exception as e:  # nothing was applied yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0, set()
        return max((r["version"] for r in rows), default=0), {r["path"] for r in rows if r["path"]}

    def lag(self) -> int:
        """Versions that the projection is behind."""
        return self.engine.version - self.applied()[0]

    def lookup(self, key) -> DataFrame:
        """Ids of the rows with this key, fresh: applied entries of the folders that the table still has, the rest from the table's
        files. Entries of folders that a compaction has replaced are left alone."""
        spark, table = self.engine.spark, self.engine._state.named(self.table)
        _, applied = self.applied()
        covered = applied.intersection(table.files)
        kind = next(c.field.dataType for c in table.columns if c.name == self.column)
        tail = store.read(spark, table.schema, tuple(p for p in table.files if p not in covered)).select(F.col(f"`{self.column}`").alias("_key"), "_tid")
        rows = tail
        if covered:
            entries = spark.read.schema(f"_key {kind.simpleString()}, _tid long, _path string").parquet(f"{self.path}/entries/*")
            named = spark.createDataFrame([(p,) for p in sorted(covered)], "_path string")
            rows = tail.unionAll(entries.filter(F.col("_key") == F.lit(key)).join(named, "_path", "left_semi").select("_key", "_tid"))
        found = rows.filter(F.col("_key") == F.lit(key)).select("_tid").distinct()
        return found.join(store.deleted_ids(spark, table.deletions), "_tid", "left_anti") if table.deletions else found


def downsample_stream(stream: DataFrame, ts_col: str, every: str, late: str, by: list[str], aggregates: list[Column]) -> DataFrame:
    """Tumbling windows over a stream; rows later than ``late`` are dropped, and state older than that is let go."""
    timed = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, late)
    grouped = timed.groupBy(F.window(ts_col, every).alias("_w"), *by).agg(*aggregates)
    return grouped.select(F.col("_w.start").alias("bucket"), *[c for c in grouped.columns if c != "_w"])
