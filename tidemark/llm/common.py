"""Helpers shared by the training-data operators: shared staging, row identity, Arrow streaming."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: (session, path, owner) of every staged table that is still there.
_staged: list[tuple[SparkSession, str, str | None]] = []
_owner: list[str | None] = [None]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one set here when that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        at = spark.sparkContext.getCheckpointDir()
        root = at or "/tmp/checkpoints/tidemark"
        if not at:
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression).option("parquet.compression.codec.zstd.level", "1")
    writer.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    delete_on_exit(spark, path)
    _staged.append((spark, path, _owner[-1]))
    return spark.read.schema(df.schema).parquet(path)


#: Bytes that a task gathers of a staged table before it writes them; whole texts make Spark's usual 128 MB heavy.
ROW_GROUP = 16 << 20
#: Rows of a few numbers that a broadcast table may have: some 32 MB.
BROADCAST_ROWS = 1_000_000


def looked_up(staged: DataFrame) -> DataFrame:
    """A staged table to join with: broadcast if its counted rows are few enough, dealt out by key if not."""
    return F.broadcast(staged) if staged.count() <= BROADCAST_ROWS else staged


def delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """What is staged inside belongs to ``owner``."""
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def release(owner: str | None = None, path: str | None = None) -> None:
    """Delete the staged tables of ``owner``, or the one at ``path``; results that still read them must have been written before."""
    for entry in [x for x in _staged if (x[1] == path if path else x[2] == owner)]:
        spark, at, _ = entry
        _staged.remove(entry)
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def staged_count(owner: str | None = None) -> int:
    return sum(x[2] == owner for x in _staged)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Rows of long texts make Spark's usual Arrow batch of 10,000 rows large; a setting of the caller's own stays."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1500")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """Adds a number to every row. The numbers follow the layout of this very scan, which a lost executor or another
    count of cores may change: stage the result, and read rows and numbers from there alone."""
    return df.withColumn(name, F.monotonically_increasing_id())


def packed_rows(df: DataFrame, id_col: str, text_col: str, name: str, row_col: str | None = None) -> DataFrame:
    """_row, _id, _n_bytes and the compressed text, staged: rows are numbered and texts read from the input once."""
    rows = df.withColumn("_row", F.col(f"`{row_col}`")) if row_col else with_row(df)
    kind = df.schema[id_col].dataType.simpleString()
    rows = rows.select("_row", F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("_text"))
    return stage(rows.mapInArrow(_pack, f"_row long, _id {kind}, _n_bytes long, _zstd binary"), name, "none")


def unpacked(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of batches whose texts, unpacked, hold about ``most_bytes``, or of one row, with those texts."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        start = held = 0
        for k, n in enumerate([*batch.column("_n_bytes").to_pylist(), None]):
            if n is None or held and held + n > most_bytes:
                if k > start:
                    part = batch.slice(start, k - start)
                    yield part, [unpack.decompress(x) for x in part.column("_zstd").to_pylist()]
                start, held = k, 0
            held += n or 0


def sliced(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that ``column`` holds about ``most_bytes`` at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = [0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()]
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(1)
    for batch in sliced(batches, "_text"):
        texts = batch.column("_text").cast(pa.binary()).to_pylist()
        sizes = pa.array(list(map(len, texts)), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_id"), sizes, pa.array([pack.compress(x) for x in texts], pa.binary())], names=["_row", "_id", "_n_bytes", "_zstd"])
