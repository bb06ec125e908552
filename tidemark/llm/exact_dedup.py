"""Exact deduplication by an extendible-hash index on shared files.

1. One pass over the texts (white-space runs become one space) folds equal texts of a map task into one *entry*,
   comparing bytes; rows keep only the entry's number, so a text that a third of all rows share travels once for each
   map task and not once for each row.
2. A directory of hash prefixes is doubled until no bucket holds more than its capacity; a bucket of one single hash
   can't be split and overflows into its chain.
3. Owner tasks take contiguous runs of buckets (key ranges), sort their entries by hash, chain the entries of equal
   hash and compare bytes along the chain; the index they find is written to the shared folder.
4. Rows meet the index by entry number, which no more rows share than one map task held.

Defined cases: a null or empty text is the empty text, and all of these are one group; of rows with equal texts the
smallest id stays, a null id counting as larger than any, and of equal ids the row read first; an empty table gives an
empty result; other columns of the input are never read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, free_name, shuffle_partitions, sliced, stage, text_of, with_row

WHITE = r"[\x20\x09-\x0D]+"
#: Bytes of text that a map task holds to fold equal texts; beyond it a new table begins.
FOLD_BYTES = 24 << 20
#: Buckets that every owner task gets, about.
BUCKETS_PER_OWNER = 8
#: Bits of the first count, and of the last: what shares all of these stays in one bucket and is chained by its hash.
FIRST_DEPTH, LAST_DEPTH = 12, 60


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, " ")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gives each row the number of its entry; the entry's text stays on the entry's first row alone."""
    entry, held = TaskContext.get().partitionId() << 40, 0
    chains: dict[int, list[tuple[int, str]]] = {}
    for batch in batches:
        entries, texts = [], []
        for h, text in zip(batch.column("_h").to_pylist(), batch.column("_text").to_pylist(), strict=True):
            chain = chains.setdefault(h, [])
            found = next((e for e, other in chain if other == text), None)
            if found is None:
                if held > FOLD_BYTES:
                    chains, held = {h: (chain := [])}, 0
                chain.append((entry, text))
                found, held, entry = entry, held + len(text) + 200, entry + 1
                texts.append(text)
            else:
                texts.append(None)
            entries.append(found)
        yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_id"), batch.column("_h"), batch.column("_sha"), pa.array(entries, pa.int64()), pa.array(texts, pa.string())], names=["_row", "_id", "_h", "_sha", "_entry", "_text"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over entries sorted by hash: each entry's class is the first entry of its chain with the same bytes."""
    at, chain = None, []
    for batch in batches:
        for part in sliced([batch], "_text"):
            classes = []
            for h, entry, text in zip(part.column("_h").to_pylist(), part.column("_entry").to_pylist(), part.column("_text").to_pylist(), strict=True):
                if h != at:
                    at, chain = h, []
                found = next((e for e, other in chain if other == text), None)
                if found is None:
                    chain.append((found := entry, text))
                classes.append(found)
            yield pa.RecordBatch.from_arrays([part.column("_bucket"), part.column("_h"), part.column("_entry"), pa.array(classes, pa.int64())], names=["_bucket", "_h", "_entry", "_class"])


def directory(entries: DataFrame, owners: int, capacity: int | None = None) -> list[tuple[int, int, int]]:
    """Buckets (prefix, depth, entries) by ascending key range, as directory doubling leaves them.

    Only prefixes of overfull buckets are counted again at a greater depth, until a bucket holds one hash alone. What
    reaches the driver is bounded by the number of owners and of buckets, not of entries: capacity grows with the input
    unless it is given."""
    depth = FIRST_DEPTH
    rows = entries.groupBy(_prefix(depth).alias("p")).count().collect()
    counts = {r["p"]: r["count"] for r in rows}
    single: set[int] = set()  # prefixes at this depth that hold one hash
    capacity = capacity or max(16, sum(counts.values()) // (owners * BUCKETS_PER_OWNER))

    def split(prefix: int, at: int, deepest: int, known: list[int], before: list[int]) -> list[tuple[int, int, int]]:
        low, high = (bisect_left(known, p << (deepest - at)) for p in (prefix, prefix + 1))
        n = before[high] - before[low]
        if n <= capacity or at == deepest or high - low == 1 and known[low] in single:
            return [(prefix, at, n)]
        return split(2 * prefix, at + 1, deepest, known, before) + split(2 * prefix + 1, at + 1, deepest, known, before)

    def sums() -> tuple[list[int], list[int]]:
        known = sorted(counts)
        return known, [0, *accumulate(counts[p] for p in known)]

    buckets = split(0, 0, depth, *sums())
    while depth < LAST_DEPTH and (over := {b[0] for b in buckets if b[1] == depth and b[2] > capacity and b[0] not in single}):
        deeper = min(LAST_DEPTH, depth + 4)
        rows = entries.filter(_prefix(depth).isin(list(over))).groupBy(_prefix(deeper).alias("p")).agg(F.count(F.lit(1)).alias("n"), (F.min("_h") == F.max("_h")).alias("one")).collect()
        counts, single = {r["p"]: r["n"] for r in rows}, {r["p"] for r in rows if r["one"]}
        known = sums()
        buckets = [b for p, d, n in buckets for b in (split(p, d, deeper, *known) if d == depth and p in over else [(p, d, n)])]
        depth = deeper
    return buckets


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("_h", 64 - depth)


def _bucket_of(buckets: list[tuple[int, int, int]]) -> Column:
    """Bucket number of a hash: binary search among the first hashes of all buckets, a literal that grows with the owners alone."""
    starts = F.split(F.lit(",".join(str((prefix << (64 - depth)) - (1 << 63)) for prefix, depth, _ in buckets)), ",").cast("array<bigint>")
    at = F.col("_h").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))  # unsigned order as signed order
    steps = F.array(*[F.lit(1 << k) for k in range(max(1, len(buckets) - 1).bit_length() - 1, -1, -1)])

    def step(found: Column, size: Column) -> Column:
        return F.when(F.get(starts, found + size) <= at, found + size).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, capacity: int | None = None) -> DataFrame:
    """One row per input row: _row, doc_id, keep_id, group_size, kept, text_sha256. ``row_col`` names a row number of the input, or one is made."""
    spark = df.sparkSession
    owners = shuffle_partitions(spark)
    df = df if row_col else with_row(df)
    text = normalised(text_of(text_col))
    hashed = df.select(F.col(f"`{row_col or '_row'}`").alias("_row"), F.col(f"`{id_col}`").alias("_id"), text.alias("_text")).select("_row", "_id", F.xxhash64("_text").alias("_h"), F.sha2(F.col("_text").cast("binary"), 256).alias("_sha"), "_text")
    id_type = df.schema[id_col].dataType.simpleString()
    folded = stage(hashed.mapInArrow(_fold, f"_row long, _id {id_type}, _h long, _sha string, _entry long, _text string"), "exact-entries")
    entries = folded.filter(F.col("_text").isNotNull())
    buckets = directory(entries, owners, capacity)
    per_owner = max(1, sum(n for _, _, n in buckets)) / owners
    owner_of, seen = [], 0
    for _, _, n in buckets:
        owner_of.append(min(owners - 1, int((seen + n / 2) / per_owner)))
        seen += n
    owner = F.element_at(F.split(F.lit(",".join(map(str, owner_of))), ","), F.col("_bucket") + 1).cast("int")
    ranged = entries.select("_h", "_entry", "_text", _bucket_of(buckets).alias("_bucket")).repartitionById(owners, owner).sortWithinPartitions("_bucket", "_h", "_entry")
    index = stage(ranged.mapInArrow(_chain, "_bucket int, _h long, _entry long, _class long"), "exact-index")
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_row").alias("r"))
    per_entry = folded.groupBy("_entry").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    members = stage(index.join(per_entry, "_entry").select("_entry", "_class", "_n", "_first"), "exact-members")
    classes = members.groupBy("_class").agg(F.sum("_n").alias("_size"), F.min("_first").alias("_keep"))
    of_entry = members.select("_entry", "_class").join(classes, "_class").select("_entry", "_size", "_keep")
    out = folded.select("_row", "_id", "_sha", "_entry").join(of_entry, "_entry")
    return out.select("_row", F.col("_id").alias("doc_id"), F.col("_keep.id").alias("keep_id"), F.col("_size").cast("long").alias("group_size"), (F.col("_row") == F.col("_keep.r")).alias("kept"), F.col("_sha").alias("text_sha256"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows that stay, with all their columns."""
    row = free_name(df, "_exact_row")
    rows = stage(with_row(df, row), "exact-input")
    kept = exact_groups(rows, id_col, text_col, row).filter("kept").select(F.col("_row").alias(row))
    return rows.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).drop("_row")


OP1_SQL = """
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, g.text_sha256 FROM d JOIN g ON d.t = g.t
"""
