"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Each stage works on all that its predecessor kept: the quality classifier drops what it rejects, exact dedup and
near-dedup keep one document of each group, suffix dedup cuts long repeated passages out of the texts that are left,
and packing lays what remains into sequences. All but the last return the columns of ``documents``, and whatever other
columns the input has.

Defined cases are those of the operators. A document whose whole text is a repeat stays with an empty text; ``n_chars``
follows the text where the column exists. A null text that loses nothing stays null.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, exact_dedup, near_dedup, packing, quality, suffix_dedup


OWNER = "pipeline"


def _stage(function: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(OWNER)  # the stage before was written: what it had staged can go
        common.small_batches(spark)
        with common.owned(OWNER):
            return function(docs)

    return run_stage


STAGES = [
    ("quality classifier", _stage(quality.accepted)),
    ("exact dedup", _stage(exact_dedup.deduplicated)),
    ("near dedup", _stage(near_dedup.one_of_each)),
    ("suffix-array dedup", _stage(suffix_dedup.without_repeats)),
    ("packing", _stage(packing.pack)),
]
ORACLE_SQL = None  # classifier, sketches and packing can't be said in SQL; tests/llm holds brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``; each stage's rows are written to the shared folder before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        found.write.parquet(f"{root}/{k}")
        docs = spark.read.schema(found.schema).parquet(f"{root}/{k}")
    common.release(OWNER)
    common.delete_on_exit(spark, root)
    return docs
