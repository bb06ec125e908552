"""Byte-level BPE, encoding and decoding.

Pre-tokenisation uses no regular expression. Texts become arrays of codepoint classes, two characters of look-ahead
are folded into a symbol per character, and the eight-state automaton that says where pieces begin is run over all
characters at once: its transition functions form a small monoid, and composing them is associative, so blocks are
composed side by side, block functions are scanned by doubling, and a second pass replays every block from its
known first state. The slices then feed a remembered pair merging; byte offsets of all tokens are kept, so that any
range of tokens decodes to its own bytes.

Defined cases: a null or empty text has no ids; no special tokens exist; rows are independent of each other, so
repeated ids change nothing; pieces of any length merge in n log n steps; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, sliced, text_of

BYTE_BPE_MULTI = "byte_bpe_multi_50k.tiktoken"
#: Pieces whose ids a worker remembers; beyond it the memory starts anew.
PIECES_KEPT = 200_000
BLOCK = 256

# Classes of codepoints; the separator between texts is a codepoint of its own.
LETTER, NUMBER, OTHER, SPACE, SEPARATOR = range(5)
# Symbols: classes with what follows folded in.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_PREFIX, S_LONE, S_RUN, S_END = range(9)
# States: what the open piece is.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, AFTER_PREFIX, ONE_MORE, TWO_MORE = range(8)
SEPARATOR_CODE = 0x110000


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of every codepoint, by general category and the White_Space property."""
    of = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(SEPARATOR_CODE)), np.uint8, SEPARATOR_CODE)
    spaces = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[spaces] = SPACE
    return np.append(table, np.uint8(SEPARATOR))


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """step[state, symbol] and begins[state, symbol]."""
    step, begins = np.zeros((8, 9), np.uint8), np.ones((8, 9), np.uint8)
    for state in range(8):
        for symbol, run in ((S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_OTHER, IN_OTHER)):
            step[state, symbol], begins[state, symbol] = run, state not in (run, AFTER_PREFIX)
        for symbol, rest in ((S_SHORT, ONE_MORE), (S_LONG, TWO_MORE)):
            inside = state in (IN_OTHER, AFTER_PREFIX)
            step[state, symbol], begins[state, symbol] = (IN_OTHER, 0) if inside else (rest, 1)
        step[state, S_PREFIX], step[state, S_LONE], step[state, S_RUN], step[state, S_END] = AFTER_PREFIX, FRESH, IN_SPACE, FRESH
        begins[state, S_RUN] = state != IN_SPACE
    step[ONE_MORE, :S_PREFIX], begins[ONE_MORE, :S_PREFIX] = FRESH, 0
    step[TWO_MORE, :S_PREFIX], begins[TWO_MORE, :S_PREFIX] = ONE_MORE, 0
    return step, begins


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, element times symbol, element times element, state that an element leads to from FRESH)."""
    step, _ = _automaton()
    elements = {tuple(range(8)): 0}
    order = [tuple(range(8))]
    for element in order:
        for symbol in range(9):
            product = tuple(int(step[s, symbol]) for s in element)
            if product not in elements:
                elements[product] = len(order)
                order.append(product)
    by_symbol = np.array([[elements[tuple(int(step[s, x]) for s in e)] for x in range(9)] for e in order], np.uint16)
    product = np.array([[elements[tuple(b[s] for s in a)] for b in order] for a in order], np.uint16)
    return by_symbol[0].copy(), by_symbol, product, np.array([e[FRESH] for e in order], np.uint8)


def symbols(codes: np.ndarray) -> np.ndarray:
    """Look-ahead folded in. ``codes`` ends with a separator."""
    kind = class_table()[codes]
    after = np.append(kind[1:], np.uint8(SEPARATOR))
    out = kind.copy()  # letters, numbers and others are their own symbols
    space = kind == SPACE
    solid = after < SPACE
    out[space] = S_RUN
    ends = space & solid
    out[ends] = S_LONE
    out[ends & (codes == 0x20)] = S_PREFIX
    out[kind == SEPARATOR] = S_END
    quotes = np.flatnonzero(codes == 0x27)
    if len(quotes):
        last = len(codes) - 1
        one, two = codes[np.minimum(quotes + 1, last)], codes[np.minimum(quotes + 2, last)]
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
        out[quotes[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]] = S_LONG
    return out


def begins(symbol: np.ndarray) -> np.ndarray:
    """Where pieces begin: the automaton over all symbols, by an associative scan of transition functions."""
    n = len(symbol)
    blocks = max(1, -(-n // BLOCK))
    padded = np.full(blocks * BLOCK, S_END, np.uint8)
    padded[:n] = symbol
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    generator, by_symbol, product, from_fresh = monoid()
    flat = by_symbol.ravel()
    whole = generator[columns[0]]
    for column in columns[1:]:
        whole = flat.take(whole * np.uint16(9) + column)
    reach = 1
    while reach < blocks:  # inclusive scan by doubling
        whole = np.concatenate([whole[:reach], product[whole[:-reach], whole[reach:]]])
        reach *= 2
    state = np.concatenate([np.array([FRESH], np.uint8), from_fresh[whole[:-1]]])
    step, begin = (x.ravel() for x in _automaton())
    out = np.empty_like(columns)
    for k, column in enumerate(columns):
        at = state * np.uint8(9) + column
        begin.take(at, out=out[k])
        state = step.take(at)
    return out.T.ravel()[:n].view(bool)


def slices(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' bytes, the byte offsets of all pieces in them with the end appended, and for each text the number of pieces before it."""
    joined = "".join(texts)
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(counts + 1) - 1  # of the separators
    codes = np.empty(len(joined) + len(texts), np.uint32)
    keep = np.ones(len(codes), bool)
    keep[ends] = False
    codes[keep] = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    codes[ends] = SEPARATOR_CODE
    width = np.where(codes < 0x80, 1, 2).astype(np.int8)
    if codes.max(initial=0) >= 0x800:
        width += codes >= 0x800
        width += codes >= 0x10000
    width[ends] = 0
    offset = np.cumsum(width, dtype=np.int64) - width
    first = np.flatnonzero(begins(symbols(codes)))
    starts = first[keep[first]]  # without the separators' own
    data = joined.encode()
    return data, np.append(offset[starts], len(data)), np.searchsorted(starts, np.append(0, ends + 1))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: again and again the pair of least rank, leftmost first, is merged."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here; 0: merged away
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = after[i]
        if not end[i] or j >= n or end[j] != to:
            continue
        end[i], end[j], after[i] = to, 0, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get(piece[i : end[after[j]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[j]]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : to])) is not None:
            heapq.heappush(heap, (r, before[i], to))
    return [ranks[piece[i : end[i]]] for i in range(n) if end[i]]


class ByteBpe:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = np.fromiter(map(len, self.tokens), np.int32, len(self.tokens))
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        data, offsets, at = slices(texts)
        if len(self.known) > PIECES_KEPT:
            self.known = {}
        bounds, known = offsets.tolist(), self.known
        pieces = [data[i:j] for i, j in zip(bounds, bounds[1:])]
        for piece in set(pieces).difference(known):
            known[piece] = np.asarray(merge(piece, self.ranks), "<i4").tobytes()
        ids = list(map(known.__getitem__, pieces))
        at = at.tolist()
        return [np.frombuffer(b"".join(ids[i:j]), "<i4") for i, j in zip(at, at[1:])]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte at which each token ends."""
        return np.cumsum(self.sizes[ids], dtype=np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    bounds = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*arrays, np.empty(0, np.int32)]).astype(np.int32)))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, ends array<int>: the tokens of each text and the byte after each token."""
    path = str(ranks or public_tokenizers.path(BYTE_BPE_MULTI))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in sliced(batches, "_text", 4 << 20):
            ids = bpe.encode(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids), _lists([bpe.offsets(x) for x in ids])], names=["doc_id", "ids", "ends"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, ends array<int>")


def decode(df: DataFrame, ids_col: str = "ids", ranks: str | None = None, out: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for. Null ids decode to no bytes."""
    path = str(ranks or public_tokenizers.path(BYTE_BPE_MULTI))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                data = [bpe.decode(x or ()) for x in batch.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{out}` binary")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again, as digests."""
    tokens = encode(documents(spark, sf_dir)).select("doc_id", "ids")
    csv = F.array_join(F.col("ids").cast("array<string>"), ",")
    digests = tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(csv.cast("binary"), 256).alias("ids_sha256"), "ids")
    return decode(digests).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
