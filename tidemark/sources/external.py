"""External files as tables, and tables as external files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.errors import InvalidArgument

FORMATS = ("parquet", "csv", "json", "orc", "text")


def read_files(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Files in a format that Spark splits; CSV and JSON want a schema, for inference reads everything twice."""
    if kind not in FORMATS:
        raise InvalidArgument(f"unknown format {kind!r}")
    if kind in ("csv", "json") and schema is None:
        raise InvalidArgument(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}) | options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_files(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """A table's own columns as files, partitioned by directory where asked."""
    if kind not in FORMATS:
        raise InvalidArgument(f"unknown format {kind!r}")
    rows = df.select(*[c for c in df.columns if not c.startswith("_")])
    writer = rows.write.mode(mode).format(kind)
    if kind == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
