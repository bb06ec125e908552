"""Token counts by section, from one encoding of the whole document.

A document is encoded once, so its counts add up to what a model will see; tokens keep their byte spans, and an
interval join (both sides sorted, one binary search) lays them over the sections. A token that crosses a boundary is
allocated by an explicit rule:

* ``start``: to the section in which its first byte lies;
* ``most``: to the section that holds most of its bytes, the earlier one on a tie;
* ``share``: to every section it touches, in proportion to its bytes there.

Sections are the lines of a text by default (a line ends with its line feed), or any spans given in an array column.

Defined cases: a null or empty text has one empty section without tokens; given spans must ascend without overlap, may
leave gaps, and tokens of gaps are counted in no section but in ``doc_tokens``; a null or empty array of spans gives no rows; rows with equal ids stay apart as rows; an
empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_bpe
from tidemark.llm.common import documents, sliced, text_of

BYTE_BPE = "byte_bpe_50k.tiktoken"
RULES = ("start", "most", "share")
#: The library's pattern gives up on white space of some 900,000 characters; texts with long runs are encoded by the
#: automaton and the pair merging of ``bpe``, whose ids are the same.
LONG_SPACE = re.compile(r"\s{50000}")


@lru_cache(2)
def _encoding(path: str):
    """(tiktoken encoding, bytes of every token)"""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def _ids(encoding, path: str, text: str) -> np.ndarray:
    if LONG_SPACE.search(text):
        return byte_bpe(path).encode([text])[0]
    return encoding.encode_to_numpy(text, disallowed_special=())


def line_spans(data: bytes) -> np.ndarray:
    """[start, end) of every line in bytes; the line feed belongs to the line that it ends."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    return np.stack([np.append(0, ends[:-1]), ends], 1)


def attribute(token_ends: np.ndarray, spans: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each span. ``token_ends``: byte after each token; tokens follow each other without gaps."""
    starts = np.append(0, token_ends[:-1])[: len(token_ends)]
    first = np.searchsorted(spans[:, 1], starts, "right")  # the first span that ends after the token's start
    last = np.searchsorted(spans[:, 0], token_ends, "left") - 1  # the last span that starts before the token's end
    counts, crossing = np.zeros(len(spans)), np.zeros(len(spans), np.int64)
    inside = first == last
    whole = inside & (spans[np.minimum(first, len(spans) - 1), 0] <= starts) & (spans[np.minimum(first, len(spans) - 1), 1] >= token_ends)
    np.add.at(counts, first[whole], 1)
    for k in np.flatnonzero(~whole & (first <= last)):
        touched = np.arange(first[k], last[k] + 1)
        held = np.minimum(spans[touched, 1], token_ends[k]) - np.maximum(spans[touched, 0], starts[k])
        crossing[touched[held > 0]] += 1
        if rule == "share":
            counts[touched] += held / (token_ends[k] - starts[k])
        elif rule == "most":
            counts[touched[np.argmax(held)]] += 1
        elif spans[touched[0], 0] <= starts[k]:
            counts[touched[0]] += 1
    return counts, crossing


def section_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None, rule: str = "most", ranks: str | None = None) -> DataFrame:
    """One row per section: doc_id, section, byte_start, byte_end, n_tokens, n_crossing, doc_tokens.

    ``spans_col`` names an array<struct<start,end>> of byte spans; without it sections are lines."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = str(ranks or public_tokenizers.path(BYTE_BPE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = _encoding(path)
        for batch in sliced(batches, "_text", 2 << 20):
            given = batch.column("_spans").to_pylist() if spans_col else [None] * batch.num_rows
            source, parts = [], []
            for row, (text, spans) in enumerate(zip(batch.column("_text").to_pylist(), given, strict=True)):
                ends = np.cumsum(sizes[np.asarray(_ids(encoding, path, text), np.int64)]) if text else np.empty(0, np.int64)
                spans = line_spans(text.encode()) if not spans_col else np.array([[x[0], x[1]] if isinstance(x, tuple) else [*x.values()] for x in spans or ()], np.int64).reshape(-1, 2)
                if not len(spans):
                    continue
                counts, crossing = attribute(ends, spans, rule)
                source += [row] * len(spans)
                parts.append((np.arange(len(spans)), spans, counts, crossing, np.full(len(spans), len(ends))))
            if not source:
                continue
            number, spans, counts, crossing, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(source)), pa.array(number.astype(np.int64)), pa.array(spans[:, 0].astype(np.int64)), pa.array(spans[:, 1].astype(np.int64)), pa.array(counts), pa.array(crossing), pa.array(whole.astype(np.int64))], names=["doc_id", "section", "byte_start", "byte_end", "n_tokens", "n_crossing", "doc_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    columns = [F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"), *([F.col(spans_col).alias("_spans")] if spans_col else [])]
    return df.select(*columns).mapInArrow(run, f"doc_id {kind}, section long, byte_start long, byte_end long, n_tokens double, n_crossing long, doc_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; tokens that cross lines go where most of their bytes lie."""
    return section_tokens(documents(spark, sf_dir)).withColumn("n_tokens", F.col("n_tokens").cast("long"))
