"""Packing tokenised documents into sequences: shortest-pack-first over the length histogram.

1. Every document is encoded; documents longer than a sequence are cut into whole sequences and a rest. Each map task
   numbers its pieces within each length.
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the input) goes to the driver, which places
   lengths longest first, always into the packs that are shortest so far, moving whole counts of like packs at once.
   The outcome is a small table of packing patterns with counts.
3. A piece's rank among pieces of its length (the counts of earlier tasks plus its own number) picks the pattern,
   the sequence and the offset. No task ever holds all pieces of a length.

Defined cases: a null or empty text is the end id alone; strings of special tokens inside a text are ordinary text;
rows with equal ids are packed as separate documents; an empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import documents, sliced, stage, text_of

WORD_BPE = "word_bpe_49k.json"
CAPACITY, END_ID = 4096, 2
#: Chunks between white space whose ids a worker remembers. When so many are new, they become the older ones, and what was
#: not asked for since the last time is forgotten.
CHUNKS_KEPT = 100_000
END_MARK = b"\xff"
# Fixed value: the word pattern of the tokenizer's file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Places in patterns (their number grows with lengths and depth, not with pieces) that are broadcast; more are joined by shuffle.
SLOTS_BROADCAST = 400_000
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # str.split() cuts there, the tokenizer doesn't


class WordEncoder:
    """Ids of whole texts, as the tokenizer's file defines them.

    The tokenizer drops white space and lets no token cross it or the bounds of its words, so both chunks between
    white space and words are encoded once and remembered. Words are merged by a byte-pair core: the mark of a
    word's end becomes a byte that UTF-8 never has, and ids ascend with the order of merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        of_char = {c: b for b, c in _byte_chars().items()}
        mark = model["end_of_word_suffix"]
        ranks = {}
        for token, number in model["vocab"].items():
            stem = token.removesuffix(mark) if token.endswith(mark) and token != mark else token
            if all(c in of_char for c in stem):
                ranks[bytes(of_char[c] for c in stem) + END_MARK * (stem != token)] = number
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.split = regex.compile(WORD_PATTERN).findall
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older_chunks: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.alike: dict[str, bool] = {}

    def _same_class(self, char: str) -> bool:
        """Whether the library takes a character for what the pattern here does: the two may follow different versions of
        Unicode. Each character is tried once, beside letters, digits and marks."""
        if char not in self.alike:
            if len(self.alike) > CHUNKS_KEPT:
                self.alike = {}
            tries = [f"a{char}b", f"1{char}!", char]
            assigned = char < "\U00010000" and unicodedata.category(char) != "Cn"  # pairs beyond may compose in one version alone
            self.alike[char] = assigned and all(self._whole(x) == self._split(x) for x in tries)
        return self.alike[char]

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not chunk.isascii() and not all(self._same_class(c) for c in set(chunk) if c > "\x7f"):
            return self._whole(chunk)
        return self._split(chunk)

    def _word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            if (ids := self.older_words.get(word)) is None:
                found = self.core.encode_single_piece(word.encode() + END_MARK)
                ids = struct.pack(f"<{len(found)}I", *found)
            self.words[word] = ids
        return ids

    def _split(self, chunk: str) -> bytes:
        if chunk.isascii():
            chunk = chunk.lower()
            if chunk.isalpha():
                return self._word(chunk)
            if chunk[:-1].isalpha() and not chunk[-1].isdigit():  # a word and one mark
                return self._word(chunk[:-1]) + self._word(chunk[-1])
        else:
            chunk = unicodedata.normalize("NFC", chunk)
            chunk = chunk.lower() if "\u03a3" not in chunk else "".join(map(str.lower, chunk))
        return b"".join(map(self._word, self.split(chunk)))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        for text in texts:
            if _ODD_SPACE.search(text):
                yield self._whole(text)
                continue
            chunks = text.split()
            try:
                yield b"".join(map(self.chunks.__getitem__, chunks))
            except KeyError:
                if len(self.chunks) > CHUNKS_KEPT:
                    self.chunks, self.older_chunks = {}, self.chunks
                if len(self.words) > CHUNKS_KEPT:
                    self.words, self.older_words = {}, self.words
                known, older = self.chunks, self.older_chunks
                for chunk in set(chunks).difference(known):
                    known[chunk] = ids if (ids := older.get(chunk)) is not None else self._chunk(chunk)
                yield b"".join(map(self.chunks.__getitem__, chunks))


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(path), TaskContext.get().partitionId()
        seen, end = np.zeros(capacity + 1, np.int64), np.asarray([end_id], "<u4").tobytes()
        for batch in sliced(batches, "_text"):
            source, start, length, crc, whole, number = [], [], [], [], [], []
            for row, ids in enumerate(encoder.encode(batch.column("_text").to_pylist())):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    source.append(row)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    whole.append(n)
                    number.append(int(seen[len(piece) // 4]))
                    seen[len(piece) // 4] += 1
            columns = [batch.column("_id").take(pa.array(source, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, whole)), pa.array([part] * len(source), pa.int32()), pa.array(number, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_part", "_number"])

    return run


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order, how many sequences have it). Longest lengths first, each into the shortest packs."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []  # a heap of the rooms left, largest first

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        if room not in groups:
            groups[room] = []
            heapq.heappush(rooms, -room)
        groups[room].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while rooms and not groups.get(-rooms[0]):
                groups.pop(-heapq.heappop(rooms), None)
            room = -rooms[0] if rooms else 0
            if room < length:
                put(capacity - length, (length,), left)
                break
            pattern, count = groups[room].pop()
            taken = min(left, count)
            if count > taken:
                groups[room].append((pattern, count - taken))
            put(room - length, (*pattern, length), taken)
            left -= taken
    return [x for room in sorted(groups) for x in groups[room]]


def pattern_slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset) of every place in every pattern."""
    ranks: dict[int, int] = {}
    slots, sequence = [], 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            first = ranks.get(length, 0)
            slots.append((length, first, first + count, sequence, offset))
            ranks[length] = first + count
            offset += length
        sequence += count
    return slots


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = df.sparkSession
    path = tokenizer or public_tokenizers.path(WORD_BPE)
    kind = df.schema[id_col].dataType.simpleString()
    encoded = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    pieces = stage(encoded.mapInArrow(_pieces(str(path), capacity, end_id), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, _part int, _number long"), "pieces")
    counts = stage(pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    table = pattern_slots(pack_histogram(histogram, capacity))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # dealt out by task and length, of which there are more in a larger corpus; a key holds no more than one task's pieces
    ranked = pieces.hint("merge").join(bases, ["_part", "length"]).withColumn("_rank", F.col("_base") + F.col("_number"))
    by_length: dict[int, list[tuple]] = {}
    for length, first, _, sequence, offset in table:
        by_length.setdefault(length, []).append((first, sequence, offset))
    columns = [(length, *map(list, zip(*sorted(found), strict=True))) for length, found in sorted(by_length.items())]
    slots = spark.createDataFrame(columns, "length long, _from array<long>, _sequence array<long>, _offset array<long>")
    slots = F.broadcast(slots) if len(table) <= SLOTS_BROADCAST else slots.hint("merge")
    steps = F.array(*[F.lit(1 << k) for k in range(max(1, max(map(len, by_length.values()), default=1)).bit_length(), -1, -1)])
    later = lambda at, step: F.when(F.get("_from", at + step) <= F.col("_rank"), at + step).otherwise(at)
    placed = ranked.join(slots, "length").withColumn("_at", F.aggregate(steps, F.lit(0), later))  # one place a piece, by binary search
    sequence = F.get("_sequence", F.col("_at")) + F.col("_rank") - F.get("_from", F.col("_at"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), F.get("_offset", F.col("_at")).alias("offset"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
