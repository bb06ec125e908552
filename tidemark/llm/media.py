"""Media columns: bytes stored as lossless WebP pictures and read back.

``store`` writes a payload as one RGB picture (three samples a pixel, 64 pixels a row) in the lossless WebP format. For
each picture the writer estimates what the palette, subtract-green, predictor and cross-colour transforms would save and
applies those that do; then come back-references, a colour cache if it saves bits, and canonical prefix codes.
``WebpReader`` decodes the whole format: prefix codes (simple, normal and meta codes), back-references, colour cache, and
the inverse transforms. With one group of codes, what would begin at each bit is looked up for all bits of a window at
once and the stream's chain is followed; pictures with meta codes and very small ones go symbol by symbol. ``restore_all``
reads many files at once: a code length, and then a token, of every stream at a step; ``store_all`` writes the pictures
that take no transform at once, each as ``store`` would alone.

Defined cases: a null or empty text becomes one row of spaces; equal texts give equal files; rows are independent, so
repeated ids change nothing; a payload of more than ``TALLEST`` rows becomes a wider picture whose last pixels, beyond
the payload, are transparent (one file up to 768 MiB, beyond it files one after the other); an empty table gives no
rows; other columns are never read.
"""

from __future__ import annotations

import itertools
import math
import struct
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, sliced, text_of

#: Bytes in a row of pixels, and pixels in a row.
ROW_BYTES, WIDTH = 192, 64
#: Largest height that the format's 14 bits hold.
TALLEST = 1 << 14
SIGNATURE = 0x2F
#: A colour cache has to bring the bits down to this share: it makes codes larger and reading slower.
CACHE_WORTH = 0.97
#: Red and blue share one code unless codes of their own bring the bits below this share.
SHARED_WORTH = 0.98
#: A transform has to bring the estimated bits down to this share.
TRANSFORM_WORTH = 0.98
EIGHT = np.arange(8, dtype=np.uint32)
#: Pictures of fewer pixels are read symbol by symbol.
FEW_PIXELS = 48
#: Pictures that are read a token of each at a time: the fewest, the most pixels of one and of all, the most.
FEW_STREAMS, TOGETHER, TOGETHER_ALL, MOST_STREAMS = 32, 1 << 15, 1 << 21, 1 << 11
#: Pixels of pictures that are written at once.
WRITTEN_TOGETHER = 1 << 18
#: Bytes of a stream that are looked up at once.
WINDOW = 1 << 14
#: Longest code that is written; the format allows 15.
LONGEST = 12
#: Bits of a key that hold a place among pixels.
PLACE_BITS = 21
PLACE = np.uint64((1 << PLACE_BITS) - 1)
#: Pixels among which earlier copies are looked for, the shortest and longest copy, and the farthest.
BLOCK, SHORTEST_COPY, LONGEST_COPY, FARTHEST = 1 << 18, 3, 4096, (1 << 20) - 120

# Fixed values of the format: the order in which code length code lengths are stored, and the nearby offsets of distance codes.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
NEARBY = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]


# By symbol: how often a code length comes at least, and in how many bits it is told how much more often; the least length
# or distance, and the bits that are added to it.
LENGTH_TIMES = np.array([1] * 16 + [3, 3, 11])
LENGTH_EXTRA = np.array([0] * 16 + [2, 3, 7])
PREFIX_BITS = np.maximum((np.arange(40) - 2) >> 1, 0)
PREFIX_MASK = (1 << PREFIX_BITS) - 1
PREFIX_BASE = np.where(np.arange(40) < 4, np.arange(40) + 1, ((2 + (np.arange(40) & 1)) << PREFIX_BITS) + 1)


class WebpError(ValueError):
    """The bytes are not a lossless WebP picture."""


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.value, self.held = data, at, 0, 0

    def need(self, n: int) -> None:
        while self.held < n:
            chunk = self.data[self.at : self.at + 6]
            if not chunk:
                if self.at > len(self.data) + 16:
                    raise WebpError("the bit stream ends too early")
                chunk = b"\0"
                self.at += 1
            else:
                self.at += len(chunk)
            self.value |= int.from_bytes(chunk, "little") << self.held
            self.held += 8 * len(chunk)

    def read(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.held -= n
        return out

    def position(self) -> int:
        """Bits read so far."""
        return 8 * self.at - self.held

    def seek(self, bit: int) -> None:
        self.at, self.value, self.held = bit >> 3, 0, 0
        self.read(bit & 7)


@lru_cache(16)
def _turned(size: int) -> np.ndarray:
    """Every number of ``size`` bits with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(size):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


def _canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols by (length, symbol), their lengths, the first place of each among codes of the longest length, and that length."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    sizes = lengths[used].astype(np.int64)
    longest = int(sizes[-1])
    shares = 1 << (longest - sizes)
    return used, sizes, np.cumsum(shares) - shares, longest


class PrefixCode:
    """A canonical prefix code, looked up by the next ``longest`` bits."""

    def __init__(self, lengths: list[int] | np.ndarray):
        lengths = np.asarray(lengths)
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.single, self.longest, self.special = int(used[0]) if len(used) else 0, 0, used[used >= 256]
            self.symbols, self.sizes = np.array([self.single]), np.zeros(1, np.int64)
            return
        self.single, self.special = None, used[used >= 256]
        used, sizes, _, self.longest = _canonical(lengths)
        shares = 1 << (self.longest - sizes)
        if int(shares.sum()) != 1 << self.longest:
            raise WebpError("a prefix code is not complete")
        turned = _turned(self.longest)
        both = np.repeat(used << 4 | sizes, shares)[turned]
        self.symbols, self.sizes = both >> 4, both & 15

    @cached_property
    def table(self) -> list[tuple[int, int]]:
        """(symbol, length) by the next bits."""
        return list(zip(self.symbols.tolist(), self.sizes.tolist(), strict=True))

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        bits.need(self.longest)
        symbol, n = self.table[bits.value & ((1 << self.longest) - 1)]
        bits.value >>= n
        bits.held -= n
        return symbol


def _read_code(bits: Bits, size: int) -> PrefixCode:
    lengths = [0] * size
    if bits.read(1):  # simple
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return _code(bytes(lengths))
    of_lengths = [0] * 19
    for k in range(bits.read(4) + 4):
        of_lengths[CODE_LENGTH_ORDER[k]] = bits.read(3)
    table, longest = _small_code(tuple(of_lengths))
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
        if left > size:
            raise WebpError("too many code lengths")
    begin, at, last, used = bits.position(), 0, 8, 0
    held = int.from_bytes(bits.data[begin >> 3 : (begin >> 3) + size * 7 // 8 + 8], "little") >> (begin & 7)  # at most 7 bits a length
    mask = (1 << longest) - 1
    while at < size and left:
        left -= 1
        symbol, n = table[held & mask]
        held >>= n
        used += n
        if symbol < 16:
            lengths[at] = symbol
            last = symbol or last
            at += 1
            continue
        value, times, extra = (last, 3, 2) if symbol == 16 else (0, 3, 3) if symbol == 17 else (0, 11, 7)
        times += held & ((1 << extra) - 1)
        held >>= extra
        used += extra
        if at + times > size:
            raise WebpError("code lengths run over")
        lengths[at : at + times] = [value] * times
        at += times
    bits.seek(begin + used)
    return _code(bytes(lengths))


@lru_cache(1024)
def _small_code(lengths: tuple[int, ...]) -> tuple[list[tuple[int, int]], int]:
    """(symbol, length) by the next bits of a code of a few symbols, and how many bits that are."""
    longest = max(lengths)
    ordered = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(ordered) <= 1:
        return [(ordered[0][1] if ordered else 0, 0)], 0
    places = [(s, n) for n, s in ordered for _ in range(1 << longest - n)]
    if len(places) != 1 << longest:
        raise WebpError("a prefix code is not complete")
    return [places[k] for k in _turned(longest).tolist()], longest


@lru_cache(64)
def _code(lengths: bytes) -> PrefixCode:
    return PrefixCode(np.frombuffer(lengths, np.uint8))


def _extra(bits: Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def _shrunk(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


class WebpReader:
    """Pixels of a lossless WebP picture as an array [height, width] of 32-bit ARGB."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
            raise WebpError("no WebP file")
        at, end = 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
        while at + 8 <= end and data[at : at + 4] != b"VP8L":
            at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1) // 2 * 2
        if at + 8 > end:
            raise WebpError("no lossless picture")
        size = struct.unpack_from("<I", data, at + 4)[0]
        self.bits = Bits(data[at + 8 : at + 8 + size])
        if self.bits.read(8) != SIGNATURE:
            raise WebpError("wrong signature")
        self.width, self.height = self.bits.read(14) + 1, self.bits.read(14) + 1
        self.alpha = self.bits.read(1)
        if self.bits.read(3):
            raise WebpError("unknown version")

    def pixels(self) -> np.ndarray:
        self.begin()
        return self.finished(self._image(self.inner, self.height, main=True))

    def begin(self) -> None:
        """Reads the transforms, and with them the main picture's width."""
        transforms, seen, width = [], set(), self.width
        while self.bits.read(1):
            kind = self.bits.read(2)
            if kind in seen:
                raise WebpError("a transform occurs twice")
            seen.add(kind)
            if kind in (0, 1):
                block = self.bits.read(3) + 2
                transforms.append((kind, block, self._image(_shrunk(width, block), _shrunk(self.height, block)), width))
            elif kind == 2:
                transforms.append((kind, 0, None, width))
            else:
                colours = self.bits.read(8) + 1
                palette = self._image(colours, 1)[0]
                table = np.cumsum(palette.view(np.uint8).reshape(-1, 4), 0, dtype=np.uint8).view(np.uint32).ravel()
                packed = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
                transforms.append((kind, packed, table, width))
                width = _shrunk(width, packed)
        self.transforms, self.inner = transforms, width

    def finished(self, out: np.ndarray) -> np.ndarray:
        """The picture, from the pixels that the transforms left."""
        for kind, block, table, width in reversed(self.transforms):
            out = (_unpredict, _uncross, _add_green, _unpalette)[kind](out, block, table, width)
        return out

    def one_group(self) -> bool:
        """Reads the main picture's head, if one group of codes follows; ``cache_bits`` is told then."""
        begin = self.bits.position()
        self.cache_bits = self.bits.read(4) if self.bits.read(1) else 0
        if self.cache_bits > 11:
            raise WebpError("the colour cache is too large")
        if not self.bits.read(1):
            return True
        self.bits.seek(begin)
        return False

    def _image(self, width: int, height: int, main: bool = False) -> np.ndarray:
        bits = self.bits
        cache_bits = bits.read(4) if bits.read(1) else 0
        if cache_bits > 11:
            raise WebpError("the colour cache is too large")
        groups, meta, meta_bits = 1, None, 0
        if main and bits.read(1):
            meta_bits = bits.read(3) + 2
            entropy = self._image(_shrunk(width, meta_bits), _shrunk(height, meta_bits))
            meta = ((entropy >> 8) & 0xFFFF).astype(np.int64)
            groups = int(meta.max()) + 1
        cache = 1 << cache_bits if cache_bits else 0
        codes = [[_read_code(bits, size) for size in (256 + 24 + cache, 256, 256, 256, 40)] for _ in range(groups)]
        if meta is None and width * height > FEW_PIXELS:
            return self._side_by_side(codes[0], width, width * height, cache, cache_bits).reshape(height, width)
        out = [0] * (width * height)
        colours, shift, done = [0] * cache, 32 - cache_bits, 0
        cached = 0  # pixels that are in the cache already
        total = width * height
        group = codes[0]
        while done < total:
            if meta is not None:
                group = codes[meta[(done // width) >> meta_bits, (done % width) >> meta_bits]]
            green = group[0].read(bits)
            if green < 256:
                red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
                out[done] = alpha << 24 | red << 16 | green << 8 | blue
                done += 1
            elif green < 280:
                length = _extra(bits, green - 256)
                distance = _distance(_extra(bits, group[4].read(bits)), width)
                if distance > done or done + length > total:
                    raise WebpError("a back-reference leaves the picture")
                for k in range(done, done + length):
                    out[k] = out[k - distance]
                done += length
            else:
                if green - 280 >= cache:
                    raise WebpError("no such cache entry")
                for k in range(cached, done):
                    colours[(0x1E35A7BD * out[k] & 0xFFFFFFFF) >> shift] = out[k]
                cached = done
                out[done] = colours[green - 280]
                done += 1
        return np.array(out, np.uint32).reshape(height, width)

    def _side_by_side(self, group: list[PrefixCode], width: int, total: int, cache: int, cache_bits: int) -> np.ndarray:
        """Pixels of one group of codes: what would begin at each bit of a window is looked up for all bits at once, the
        chain of beginnings that the stream really takes is followed, and copies and cache entries are filled in."""
        bits, raw = self.bits, np.frombuffer(self.bits.data, np.uint8)
        filled = _Filled(total, cache, 32 - cache_bits)
        at = bits.position()
        while filled.done < total:
            if at > 8 * len(raw):
                raise WebpError("the bit stream ends too early")
            part = np.zeros(min(WINDOW, len(raw) - (at >> 3)) + 24, np.uint32)
            held = raw[at >> 3 : (at >> 3) + len(part)]
            part[: len(held)] = held
            four = part[:-3] | part[1:-2] << 8 | part[2:-1] << 16 | part[3:] << 24
            peek = (four[:, None] >> EIGHT).ravel().astype(np.int64)  # 25 bits at least
            bit = np.arange(len(peek))
            # where a code ends that begins at each bit; past the window's end the last bit stands for all
            ends = [bit + c.sizes.take(peek & ((1 << c.longest) - 1), mode="clip") if c.longest else bit for c in group[:4]]
            then = lambda spot, k: ends[k].take(spot, mode="clip") if group[k].longest else spot  # noqa: B023, E731
            green = group[0].symbols.take(peek & ((1 << group[0].longest) - 1), mode="clip")
            after = then(then(then(ends[0], 1), 2), 3)
            lengths = distances = copying = np.empty(0, np.int64)
            if len(group[0].special):
                special = np.flatnonzero(green >= 256)
                after[special] = ends[0][special]
                copying = special[green[special] < 280]
                lengths, spot = _extras(peek, ends[0][copying], green[copying] - 256)
                next_code = peek.take(spot, mode="clip") & ((1 << group[4].longest) - 1)
                distances, after[copying] = _extras(peek, spot + group[4].sizes[next_code], group[4].symbols[next_code])
            last = len(peek) - 128  # a token that begins before lies in the window whole
            after[last:] = 0
            chain, base = after.data, at >> 3 << 3
            here, begun = at - base, []
            push = begun.append
            for _ in range(total - filled.done):
                following = chain[here]
                if following <= here:  # the end of the window, or a token without any bits
                    break
                push(here)
                here = following
            else:
                following = -1
            if following == here and here < last:  # no code has more than one symbol: all that follows is the same
                begun += [here] * (total - filled.done - len(begun))
            spot = np.array(begun, np.int64)
            symbol = green[spot]
            if len(symbol) and int(symbol.max()) >= 280 + cache:
                raise WebpError("no such cache entry")
            copied = (symbol >= 256) & (symbol < 280)
            which = np.searchsorted(copying, spot[copied])
            length, distance = lengths[which], _distances(distances[which], width)
            sizes = np.ones(len(symbol), np.int64)
            sizes[copied] = length
            reached = filled.done + np.cumsum(sizes)
            used = int(np.searchsorted(reached, total)) + 1  # tokens up to the one that fills the picture
            if used < len(symbol):
                here = int(after[spot[used - 1]])
                spot, symbol, sizes, copied, reached = (x[:used] for x in (spot, symbol, sizes, copied, reached))
                length, distance = length[: copied.sum()], distance[: copied.sum()]
            if len(reached) and (reached[-1] > total or (distance > (reached - sizes)[copied]).any()):
                raise WebpError("a back-reference leaves the picture")
            before = np.flatnonzero(copied) - np.arange(len(length))
            at = base + here
            spot, symbol = spot[~copied], symbol[~copied]
            pixel, spot = symbol << 8, ends[0][spot]
            for k, shift in ((1, 16), (2, 0), (3, 24)):
                pixel |= group[k].symbols.take(peek.take(spot, mode="clip") & ((1 << group[k].longest) - 1), mode="clip") << shift
                spot = then(spot, k)
            filled.add(np.where(symbol < 256, pixel, 279 - symbol), before, length, distance)
        bits.seek(at)
        return filled.out


class _Streams:
    """The main pictures of many readers with one group of codes each, read a token of each at a time."""

    def __init__(self, readers: list[WebpReader]):
        self.readers = readers
        sizes = np.array([len(r.bits.data) for r in readers], np.int64)
        self.ends = 8 * np.cumsum(sizes)
        raw = np.frombuffer(b"".join([*(r.bits.data for r in readers), b"\0" * 16]), np.uint8)
        #: The 64 bits from each byte on.
        self.words = np.ndarray(len(raw) - 7, "<i8", raw, 0, (1,)).copy()
        self.at = self.ends - 8 * sizes + [r.bits.position() for r in readers]

    def _peek(self, at: np.ndarray) -> np.ndarray:
        """57 bits at least."""
        return self.words.take(at >> 3, mode="clip") >> (at & 7)

    def _lengths(self, sizes: np.ndarray) -> np.ndarray:
        """The next code of every stream: a row of code lengths for each, of alphabets of some sizes."""
        out, seen = np.zeros((len(sizes), int(sizes.max())), np.uint8), self._peek(self.at)
        simple = np.flatnonzero(seen & 1)
        value = seen[simple]
        two, wide = value >> 1 & 1, value >> 2 & 1
        first, then = value >> 3 & np.where(wide, 255, 1), np.where(wide, 11, 4)
        second = np.where(two, value >> then & 255, first)
        if (np.maximum(first, second) >= sizes[simple]).any():
            raise WebpError("no such symbol")
        out[simple, first] = out[simple, second] = 1
        self.at[simple] += then + 8 * two
        normal = np.flatnonzero(seen & 1 == 0)
        if len(normal):
            self._normal_lengths(out, normal, sizes[normal])
        return out

    def _normal_lengths(self, out: np.ndarray, stream: np.ndarray, size: np.ndarray) -> None:
        at = self.at[stream]
        held = (self._peek(at) >> 1 & 15) + 4
        at += 5
        of_lengths = np.zeros((len(stream), 19), np.uint8)
        for k, symbol in enumerate(CODE_LENGTH_ORDER):
            of_lengths[:, symbol] = np.where(k < held, self._peek(at + 3 * k) & 7, 0)
        at += 3 * held
        table, begins, longest = _tables(of_lengths)
        seen = self._peek(at)
        some, n = seen & 1, 2 + 2 * (seen >> 1 & 7)
        left = np.where(some, 2 + (seen >> 4 & (1 << n) - 1), size)
        at += 1 + some * (3 + n)
        if (left > size).any():
            raise WebpError("too many code lengths")
        # rows: the stream, where its bits and its lengths are, the last length but 0, lengths told yet, alphabet, and its table
        state = np.stack([stream, at, np.zeros_like(at), np.full_like(at, 8), left, size, begins, (1 << longest) - 1])
        told = []
        while state.shape[1]:
            stream, at, place, last, left, size, begin, mask = state
            seen = self._peek(at)
            entry = table.take(begin + (seen & mask))
            symbol, n = entry >> 4, entry & 15
            extra = LENGTH_EXTRA.take(symbol)
            times = LENGTH_TIMES.take(symbol) + (seen >> n & (1 << extra) - 1)
            value = np.where(symbol < 16, symbol, np.where(symbol == 16, last, 0))
            told.append(np.stack([stream, place, times, value]))
            np.copyto(last, symbol, where=(symbol > 0) & (symbol < 16))
            at += n + extra
            place += times
            left -= 1
            going = (place < size) & (left > 0)
            if not going.all():
                if (place > size).any():
                    raise WebpError("code lengths run over")
                self.at[stream] = at
                state = state[:, going]
        stream, place, times, value = np.concatenate(told, 1)
        kept = value > 0
        first, times, value = (stream * out.shape[1] + place)[kept], times[kept], value[kept]
        out.ravel()[_spans(first, times)] = np.repeat(value, times)

    def pixels(self) -> list[np.ndarray | None]:
        """Pixels of each stream as the transforms left them; None where a code is longer than those written here, for its
        table would be large, and for the few streams that were left over."""
        n = len(self.readers)
        cache_bits = np.array([r.cache_bits for r in self.readers], np.int64)
        tables, codes, before, fits = [], [], 0, np.ones(n, bool)
        for size in (280 + np.where(cache_bits > 0, 1 << cache_bits, 0), *(np.full(n, x) for x in (256, 256, 256, 40))):
            lengths = self._lengths(size)
            fits &= lengths.max(1) <= LONGEST
            lengths[~fits] = 0
            table, begins, longest = _tables(lengths)
            tables.append(table)
            codes.append((begins + before, longest))
            before += len(table)
        bits = np.stack([longest for _, longest in codes])
        totals = np.array([r.inner * r.height for r in self.readers], np.int64)
        order = np.argsort(cache_bits > 0, kind="stable")  # those with a colour cache last
        base = np.empty(n, np.int64)
        base[order] = np.cumsum(totals[order]) - totals[order]
        value = np.zeros(int(totals.sum()), np.int64)
        # in 64 bits of the table: a symbol where the pixel has it, above 8 bits for lengths, so that entries add up
        parts = [tables[k].astype(np.int64) >> 4 << shift + 8 | tables[k] & 15 for k, shift in enumerate((8, 16, 0, 24))]
        table = np.concatenate([*parts, tables[4].astype(np.int64)])
        varied = [k for k in (1, 2, 3) if bits[k].any()]
        same = sum(table[codes[k][0]] for k in (1, 2, 3) if k not in varied)
        # rows: the stream, where its bits and its pixels are, its last pixel's end, and its codes' tables
        state = np.stack([np.arange(n), self.at, base, base + totals, *(x for begins, longest in codes for x in (begins, (1 << longest) - 1))])
        state = state[:, fits]  # of four codes, or of two with 10 and 18 bits more, the bits are seen at once
        copies, read = [np.zeros((4, 0), np.int64)], np.zeros(n, bool)
        while state.shape[1] >= FEW_STREAMS:
            stream, at, place, end, *codes = state
            seen = self._peek(at)
            green = table.take(codes[0] + (seen & codes[1]))
            seen >>= green & 15
            special = (green >= 256 << 16).nonzero()[0]
            rest, pixel = seen.take(special), green.copy()
            for k in varied:
                entry = table.take(codes[2 * k] + (seen & codes[2 * k + 1]))
                pixel += entry
                entry &= 15
                seen >>= entry
            if len(special):
                symbol = green.take(special)
                size = symbol & 15
                symbol >>= 16
                cached = 279 - symbol << 8
                copied = (symbol < 280).nonzero()[0]
                if len(copied):
                    cached[copied] = 0
                    which, rest, symbol = special.take(copied), rest.take(copied), symbol.take(copied) - 256
                    more = PREFIX_BITS.take(symbol)
                    length = PREFIX_BASE.take(symbol) + (rest & PREFIX_MASK.take(symbol))
                    rest >>= more
                    entry = table.take(codes[8].take(which) + (rest & codes[9].take(which)))
                    symbol = entry >> 4
                    entry &= 15
                    rest >>= entry
                    distance = PREFIX_BASE.take(symbol) + (rest & PREFIX_MASK.take(symbol))
                    size[copied] += more + entry + PREFIX_BITS.take(symbol)
                    copies.append(np.array((stream.take(which), place.take(which), length, distance)))
                pixel[special] = cached | size
            value[place] = pixel
            at += pixel & 255
            place += 1
            if len(special) and len(copied):
                place[which] += length - 1
            going = place < end
            if not going.all():
                over = stream[~going]
                read[over] = True
                if (at[~going] > self.ends[over]).any():
                    raise WebpError("the bit stream ends too early")
                state = state.take(going.nonzero()[0], 1)
        value >>= 8
        if varied != [1, 2, 3]:
            np.add(value, np.repeat(same[order] >> 8, totals[order]), out=value, where=value >= 0)
        return self._filled(value, np.concatenate(copies, 1), base, totals, read, cache_bits)

    def _filled(self, value: np.ndarray, copies: np.ndarray, base: np.ndarray, totals: np.ndarray, read: np.ndarray, cache_bits: np.ndarray) -> list[np.ndarray | None]:
        """The pictures: copies and what the colour caches held are looked up for all pixels at once."""
        stream, place, length, code = copies[:, read[copies[0]]]
        distance = _distances(code, np.array([r.inner for r in self.readers])[stream])
        if (distance > place - base[stream]).any() or (place + length > (base + totals)[stream]).any():
            raise WebpError("a back-reference leaves the picture")
        source = np.arange(len(value))
        source[_spans(place, length)] -= np.repeat(distance, length)
        source = _arrived(source)
        cached = np.flatnonzero(cache_bits)
        first = len(value) - int(totals[cached].sum())
        out = np.empty(len(value), np.uint32)
        out[:first] = value[source[:first]]
        if len(cached):
            which, shift = (np.repeat(x, totals[cached]) for x in (np.arange(len(cached), dtype=np.uint16), 32 - cache_bits[cached]))
            out[first:] = _with_caches(value[first:], source[first:] - first, which, shift)
        return [out[at : at + n].reshape(r.height, r.inner) if k else None for r, at, n, k in zip(self.readers, base.tolist(), totals.tolist(), read.tolist(), strict=True)]


def _with_caches(told: np.ndarray, source: np.ndarray, stream: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Pixels of whole streams: -1 - k asks for entry k of the stream's colour cache, and ``source`` is where a copy comes from."""
    own = np.where(told < 0, -1 - told, _entry(told.astype(np.uint32), shift))
    asks = told < 0
    while True:
        entry = own[source]
        order = np.argsort(entry.astype(np.int16), kind="stable")
        order = order[np.argsort(stream[order], kind="stable")]
        begins = _new((entry | stream.astype(np.int64) << 11)[order])
        earlier = np.empty_like(order)
        earlier[order[1:]] = order[:-1]
        first = order[begins]
        earlier[first] = first
        never = first[asks[first]]
        if not len(never):
            return told[_arrived(np.where(asks, earlier, source))]
        told[never] = own[never] = 0  # the colour 0, which has an entry of its own
        asks[never] = False


def _spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of stretches, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix codes, a row of lengths each: symbol << 4 | length by the next bits, where each code's part begins, and how
    many bits it takes. A code of one symbol takes none."""
    row, symbol = np.nonzero(lengths)
    size, times = lengths[row, symbol].astype(np.int64), np.bincount(row, minlength=len(lengths))
    longest = lengths.max(1).astype(np.int64)
    few = times <= 1
    if few.any():
        longest[few] = size[few[row]] = 0
        none = np.flatnonzero(times == 0)  # as if of symbol 0 alone
        row, symbol, size = (np.concatenate([x, y]) for x, y in ((row, none), (symbol, 0 * none), (size, 0 * none)))
    order = np.argsort((row << 4 | size).astype(np.int32), kind="stable")
    row, symbol, size = row[order], symbol[order], size[order]
    shares = 1 << longest[row] - size
    if (np.bincount(row, shares) != 1 << longest).any():
        raise WebpError("a prefix code is not complete")
    placed = np.repeat((symbol << 4 | size).astype(np.int32), shares)
    begins = np.cumsum(1 << longest) - (1 << longest)
    out = np.empty_like(placed)
    for bits in np.flatnonzero(np.bincount(longest)).tolist():
        begin = begins[longest == bits, None]
        out[begin + np.arange(1 << bits)] = placed[begin + _turned(bits)]
    return out, begins, longest


def _extras(peek: np.ndarray, spot: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances from their prefix symbols and the extra bits at ``spot``, and where these end."""
    n = np.maximum((symbol - 2) >> 1, 0)
    extra = peek.take(spot, mode="clip") & ((1 << n) - 1)
    return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << n) + extra + 1).astype(np.int64), spot + n


def _distances(codes: np.ndarray, width: int) -> np.ndarray:
    dx, dy = np.array([(0, 0), *NEARBY], np.int64)[np.where(codes > 120, 0, codes)].T
    return np.where(codes > 120, codes - 120, np.maximum(1, dx + dy * width))


class _Filled:
    """Pixels as tokens tell them: a value, -1 - k for entry k of the colour cache, or a copy from further back.

    Every pixel of a window points to where its value comes from: itself, or an earlier pixel; pointers are followed by
    jumping until all have arrived."""

    def __init__(self, total: int, cache: int, shift: int):
        self.cache, self.shift, self.done = cache, shift, 0
        self.out, self.entries = np.zeros(total, np.uint32), np.zeros(total if cache else 0, np.int16)
        self.colours, self.written = np.zeros(cache, np.uint32), np.zeros(cache, bool)

    def add(self, values: np.ndarray, before: np.ndarray, lengths: np.ndarray, distances: np.ndarray) -> None:
        """The next pixels: values, and of each copy among them how many values stand before it."""
        if not len(before) and not self.cache:
            self.out[self.done : self.done + len(values)] = values
            self.done += len(values)
            return
        n = len(values) + int(lengths.sum())
        copied = np.repeat(before, lengths) + np.arange(n - len(values))
        single = np.ones(n, bool)
        single[copied] = False
        told = np.zeros(n, np.int64)
        told[single] = values
        source = np.arange(n)
        source[copied] -= np.repeat(distances, lengths)
        far = copied[source[copied] < 0]  # from an earlier window
        if len(far):
            back = self.done + source[far]
            told[far] = self.out[back]
            source[far] = far
        source = _arrived(source)
        if self.cache:
            self._from_cache(told, source, far, back if len(far) else None)
        else:
            self.out[self.done : self.done + n] = told[source]
        self.done += n

    def _from_cache(self, told: np.ndarray, source: np.ndarray, far: np.ndarray, back: np.ndarray | None) -> None:
        own = np.where(told < 0, -1 - told, _entry(told.astype(np.uint32), self.shift))
        if back is not None:
            own[far] = self.entries[back]
        while True:
            entry = own[source]
            order = np.argsort(entry.astype(np.int16), kind="stable")
            begins = _new(entry[order])
            earlier = np.empty_like(order)
            earlier[order[1:]] = order[:-1]
            first = order[begins]
            earlier[first] = first
            asks = told < 0
            fresh = first[asks[first]]  # entries as earlier windows left them
            never = fresh[~self.written[entry[fresh]]]
            if not len(never):
                break
            told[never] = own[never] = 0  # the colour 0, which has an entry of its own
        told[fresh] = self.colours[entry[fresh]]
        asks[fresh] = False
        source = _arrived(np.where(asks, earlier, source))
        pixels = told[source].astype(np.uint32)
        n = len(pixels)
        self.out[self.done : self.done + n], self.entries[self.done : self.done + n] = pixels, entry
        latest = order[np.append(begins[1:], True)] if n else order
        self.colours[entry[latest]] = pixels[latest]
        self.written[entry[latest]] = True


def _arrived(source: np.ndarray) -> np.ndarray:
    """Where pointers to earlier places end."""
    while True:
        further = source[source]
        if (further == source).all():
            return source
        source = further


def _entry(pixels: np.ndarray, shift: int) -> np.ndarray:
    """Each pixel's entry in the colour cache."""
    return (pixels * np.uint32(0x1E35A7BD) >> np.uint32(shift)).astype(np.int64)


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = NEARBY[code - 1]
    return max(1, dx + dy * width)


def _channels(image: np.ndarray) -> np.ndarray:
    """Bytes blue, green, red, alpha of every pixel."""
    return np.ascontiguousarray(image).view(np.uint8).reshape(*image.shape, 4)


def _add_green(image: np.ndarray, *_) -> np.ndarray:
    out = _channels(image).copy()
    out[..., 0] += out[..., 1]
    out[..., 2] += out[..., 1]
    return out.view(np.uint32)[..., 0]


def _uncross(image: np.ndarray, block: int, table: np.ndarray, width: int) -> np.ndarray:
    out = _channels(image).copy()
    rows, columns = np.arange(len(image)) >> block, np.arange(width) >> block
    factors = _channels(table)[rows][:, columns].view(np.int8).astype(np.int32)
    signed = lambda x: x.view(np.int8).astype(np.int32)
    green = signed(np.ascontiguousarray(out[..., 1]))
    red = (out[..., 2] + (factors[..., 0] * green >> 5)).astype(np.uint8)
    blue = out[..., 0] + (factors[..., 1] * green >> 5) + (factors[..., 2] * signed(red) >> 5)
    out[..., 2], out[..., 0] = red, blue.astype(np.uint8)
    return out.view(np.uint32)[..., 0]


def _unpalette(image: np.ndarray, packed: int, table: np.ndarray, width: int) -> np.ndarray:
    index = _channels(image)[..., 1]
    if packed:
        each, size = 1 << packed, 8 >> packed
        x = np.arange(width)
        index = index[:, x >> packed] >> ((x & (each - 1)) * size).astype(np.uint8) & ((1 << size) - 1)
    whole = np.zeros(256, np.uint32)
    whole[: len(table)] = table
    return whole[index]


def _clip(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _predicted(mode: int, left: tuple, top: tuple, top_left: tuple, top_right: tuple) -> tuple:
    """The predictor's pixel, from its neighbours' channels."""
    mean = lambda a, b: tuple((x + y) >> 1 for x, y in zip(a, b, strict=True))
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return top_right
        case 4:
            return top_left
        case 5:
            return mean(mean(left, top_right), top)
        case 6:
            return mean(left, top_left)
        case 7:
            return mean(left, top)
        case 8:
            return mean(top_left, top)
        case 9:
            return mean(top, top_right)
        case 10:
            return mean(mean(left, top_left), mean(top, top_right))
        case 11:
            to_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
            to_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
            return left if to_left < to_top else top
        case 12:
            return tuple(_clip(x + t - c) for x, t, c in zip(left, top, top_left, strict=True))
        case 13:
            # half the difference, cut towards zero
            return tuple(_clip(m + int((m - c) / 2)) for m, c in zip(mean(left, top), top_left, strict=True))
    return (0, 0, 0, 255)


def _unpredict(image: np.ndarray, block: int, table: np.ndarray, width: int) -> np.ndarray:
    modes = (table >> 8) & 15
    out = _channels(image).copy()
    out[0, 0, 3:] -= np.uint8(1)  # the first pixel's guess is opaque black; bytes wrap round
    out[0] = np.cumsum(out[0], 0, dtype=np.uint8)
    out[:, 0] = np.cumsum(out[:, 0], 0, dtype=np.uint8)
    for y in range(1, len(out)):
        row = np.repeat(modes[y >> block], 1 << block)[:width]
        if np.isin(row, BY_ROWS).all():
            _unpredict_row(out[y], out[y - 1], row)
        else:
            _unpredict_pixels(out[y], out[y - 1], row.tolist())
    return out.view(np.uint32)[..., 0]


#: Predictors that need nothing of the same row but the pixel to the left.
BY_ROWS = (0, 1, 2, 3, 4, 8, 9)


def _from_above(mode: int, above: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Guesses for all pixels of rows but the first column; ``left`` holds the rows' first pixels."""
    top, corner, right = above[..., 1:, :], above[..., :-1, :], np.concatenate([above[..., 2:, :], left], -2)
    mean = lambda x, y: ((x.astype(np.uint16) + y) >> 1).astype(np.uint8)
    match mode:
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 8:
            return mean(corner, top)
        case 9:
            return mean(top, right)
    return np.broadcast_to(np.array([0, 0, 0, 255], np.uint8), top.shape)


def _unpredict_row(row: np.ndarray, above: np.ndarray, modes: np.ndarray) -> None:
    inner = modes[1:]
    for mode in set(inner.tolist()) - {1}:
        row[1:] += np.where((inner == mode)[:, None], _from_above(mode, above, row[:1]), 0).astype(np.uint8)
    if (inner == 1).any():  # sums that begin anew after each pixel guessed from above
        begins = np.flatnonzero(np.append(True, inner != 1))
        sums = np.cumsum(row, 0, dtype=np.uint8)
        before = sums[begins] - row[begins]
        row[:] = sums - np.repeat(before, np.diff(np.append(begins, len(row))), 0)


def _unpredict_pixels(row: np.ndarray, above: np.ndarray, modes: list[int]) -> None:
    rest, up = row.tolist(), above.tolist()
    now = [tuple(rest[0])]
    for x in range(1, len(rest)):
        right = up[x + 1] if x + 1 < len(rest) else now[0]
        guess = _predicted(modes[x], now[x - 1], up[x], up[x - 1], right)
        now.append(tuple((a + b) & 255 for a, b in zip(rest[x], guess, strict=True)))
    row[:] = now


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Lengths of a prefix code of least cost for two or more counts above 0, none above ``longest``."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    weights = counts[used]
    order = np.argsort(weights, kind="stable")
    out[used[order]] = _tree(weights[order].tolist(), longest)
    return out


def _tree(weights: list[int], longest: int) -> list[int]:
    """Depths of ascending weights in a tree of least cost, by two queues, of weights and of joined nodes; the weights
    are halved until it is flat enough."""
    n = len(weights)
    while True:
        endless = sum(weights) + 1
        queue = [*weights, endless, endless]
        joined, parent = [endless] * (n + 1), [0] * (2 * n)
        leaf = node = 0
        for k in range(n - 1):
            x, y = queue[leaf], joined[node]
            if x <= y:
                parent[leaf] = k
                leaf += 1
                both, x = x, queue[leaf]
            else:
                parent[n + node] = k
                node += 1
                both, y = y, joined[node]
            if x <= y:
                parent[leaf] = k
                leaf += 1
                both += x
            else:
                parent[n + node] = k
                node += 1
                both += y
            joined[k] = both
        depth = [0] * (n - 1)
        for k in range(n - 3, -1, -1):
            depth[k] = depth[parent[n + k]] + 1
        found = [depth[k] + 1 for k in parent[:n]]
        if max(found) <= longest:
            return found
        weights = [(w + 1) // 2 for w in weights]


def _new(x: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    begins = np.flatnonzero(_new(x))
    ends = np.empty_like(begins)
    ends[:-1], ends[-1:] = begins[1:], len(x)
    return begins, ends - begins


class _Writer:
    """Numbers of up to 64 bits, put together at the end."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if self.values:
            self.parts.append((np.array(self.values, np.uint64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []
        self.parts.append((values, sizes))

    def data(self) -> bytes:
        self.put_all(np.empty(0, np.uint64), np.empty(0, np.int64))
        values, sizes = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        values, sizes = values[sizes > 0], sizes[sizes > 0]
        ends = np.cumsum(sizes)
        return _packed(values, ends - sizes, (int(ends[-1]) >> 6) + 1)[: -(-int(ends[-1]) // 8)]


def _packed(values: np.ndarray, starts: np.ndarray, n_words: int) -> bytes:
    """Numbers at their places, in bits, from left to right."""
    word, shift = starts >> 6, (starts & 63).astype(np.uint64)
    out = np.zeros(n_words + 1, np.uint64)
    first = np.flatnonzero(_new(word))
    out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
    over = (values >> np.uint64(1)) >> (np.uint64(63) - shift)
    out[word[first] + 1] |= np.bitwise_or.reduceat(over, first)
    return out.tobytes()


@lru_cache(4096)
def _run_tokens(value: int, n: int) -> tuple[tuple[int, int, int], ...]:
    """(code length symbol, extra value, extra bits) for a run of one length."""
    tokens = []
    if value:
        tokens.append((value, 0, 0))
        n -= 1
    while n >= 3:
        some = min(n, 138 if not value else 6)
        tokens.append((16, some - 3, 2) if value else (18, some - 11, 7) if some > 10 else (17, some - 3, 3))
        n -= some
    return (*tokens, *[(value, 0, 0)] * n)


def _length_tokens(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    begins, sizes = _runs(lengths)
    runs = map(_run_tokens, lengths[begins].tolist(), sizes.tolist())
    return list(itertools.chain.from_iterable(runs))


def _put_code(out: _Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a code for the counted symbols; returns its bits and lengths by symbol."""
    used = np.flatnonzero(counts)
    bits, lengths = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.int64)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        out.put(1 | (len(symbols) - 1) << 1, 2)
        out.put(*((symbols[0] << 1, 2) if symbols[0] < 2 else (symbols[0] << 1 | 1, 9)))
        if len(symbols) == 2:
            out.put(symbols[1], 8)
            bits[symbols[1]], lengths[used] = 1, 1
        return bits, lengths
    lengths = code_lengths(counts, LONGEST)
    symbols, _, first, longest = _canonical(lengths)
    bits[symbols] = _turned(longest)[first].astype(np.uint64)
    tokens = _length_tokens(lengths)
    kinds = Counter([k for k, _, _ in tokens])
    if len(kinds) == 1:
        kinds[(tokens[0][0] + 1) % 16] = 1
    ordered = sorted(kinds, key=lambda k: (kinds[k], k))
    sizes = [0] * 19
    for k, n in zip(ordered, _tree([kinds[k] for k in ordered], 7), strict=True):
        sizes[k] = n
    longest = max(sizes)
    turned, place, reverse = {}, 0, _turned(longest)
    for n, k in sorted((n, k) for k, n in enumerate(sizes) if n):
        turned[k] = int(reverse[place])
        place += 1 << longest - n
    held = max(4, 1 + max(k for k, s in enumerate(CODE_LENGTH_ORDER) if sizes[s]))
    out.put((held - 4) << 1, 5)
    out.values += [sizes[s] for s in CODE_LENGTH_ORDER[:held]]
    out.sizes += [3] * held
    out.put(0, 1)  # all lengths follow
    out.values += [turned[kind] | extra << sizes[kind] for kind, extra, _ in tokens]
    out.sizes += [sizes[kind] + n for kind, _, n in tokens]
    return bits, lengths


CHANNEL = np.array([0, 256, 512, 768], np.int64)


def _counts(channels: np.ndarray) -> np.ndarray:
    """How often each value occurs, a row for each of blue, green, red and alpha."""
    return np.bincount((channels.reshape(-1, 4) + CHANNEL).ravel(), minlength=1024).reshape(4, 256)


#: n * log2(n) in 256ths of a bit. Whole numbers add up to the same sums in any order.
ENTROPY = np.rint(256 * np.arange(1 << 17) * np.log2(np.maximum(np.arange(1 << 17), 1))).astype(np.int64)


def _entropy(counts: np.ndarray) -> np.ndarray:
    if counts.size and int(counts.max()) >= len(ENTROPY):
        return np.rint(256 * counts * np.log2(np.maximum(counts, 1))).astype(np.int64)
    return ENTROPY.take(counts)


def _costs(counts: np.ndarray, each: int = 5) -> np.ndarray:
    """Bits of the symbols counted in each row, under a code of its own, and some for each symbol that the code names."""
    return (_entropy(counts.sum(-1)) - _entropy(counts).sum(-1)) / 256 + each * np.count_nonzero(counts, -1)


def _cost(counts: np.ndarray) -> float:
    return float(_costs(counts).sum())


def _picture_costs(*versions: np.ndarray) -> list[float]:
    """Estimated bits of each version of one picture, whose channels count as one alphabet."""
    values = np.stack(versions).reshape(len(versions), -1, 4)[..., :3].astype(np.int64)
    values += np.arange(0, 256 * len(versions), 256)[:, None, None]
    return _costs(np.bincount(values.ravel(), minlength=256 * len(versions)).reshape(-1, 256), 15).tolist()


def _less_green(channels: np.ndarray) -> np.ndarray:
    out = channels.copy()
    out[..., 0] -= channels[..., 1]
    out[..., 2] -= channels[..., 1]
    return out


def _three(pixels: np.ndarray) -> np.ndarray:
    """By place a hash of three pixels, in its high bits, and the place."""
    wide = pixels.astype(np.uint64)
    key = (wide[:-2] | wide[1:-1] << np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) ^ wide[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return key & ~PLACE | np.arange(len(key), dtype=np.uint64)


def _agreed(pixels: np.ndarray, i: int, j: int, most: int) -> int:
    """How many pixels from two places on are the same."""
    length, ahead = 0, 16
    while length < most:
        n = min(ahead, most - length)
        differ = pixels[i + length : i + length + n] != pixels[j + length : j + length + n]
        agreed = int(differ.argmax()) if differ.any() else n
        length += agreed
        if agreed < n:
            break
        ahead *= 4
    return length


def _copies(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of stretches that stand before, from left to right: the latest place with the same three pixels."""
    found, free = [], 0
    for block in range(0, len(pixels), BLOCK):
        part = pixels[block : block + BLOCK]
        if len(part) <= SHORTEST_COPY:
            continue
        key = np.sort(_three(part))
        order, key = (key & PLACE).astype(np.int64), key & ~PLACE
        same = key[1:] == key[:-1]
        later, earlier = order[1:][same], order[:-1][same]
        by_place = np.argsort(later)
        for i, j in zip(later[by_place].tolist(), earlier[by_place].tolist(), strict=True):
            if block + i < free:
                continue
            length = _agreed(part, i, j, min(LONGEST_COPY, len(part) - i))
            if length >= SHORTEST_COPY and i - j <= FARTHEST:
                found.append((block + i, length, i - j))
                free = block + i + length
    return found


def _hits(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    """Which pixels stand in the colour cache when their turn comes."""
    order = np.argsort(_entry(pixels, 32 - cache_bits).astype(np.int16), kind="stable")
    hits = np.empty(len(pixels), bool)
    hits[order] = ~_new(pixels[order])  # equal pixels have equal entries
    return hits


def _prefixed(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number, of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    n = (value - 1).bit_length() - 2
    return 2 * n + ((value - 1) >> n & 1) + 2, (value - 1) & ((1 << n) - 1), n


def _put_image(out: _Writer, image: np.ndarray, main: bool = False) -> None:
    """Entropy-coded pixels: back-references, then a colour cache if that saves bits."""
    width, pixels = image.shape[1], np.ascontiguousarray(image).ravel()
    channels = pixels.view(np.uint8).reshape(-1, 4)
    copies = _copies(pixels)
    single = np.ones(len(pixels), bool)
    for at, length, _ in copies:
        single[at : at + length] = False
    place = np.flatnonzero(single)
    single = channels[place]
    blue, green, red, alpha = single.T.astype(np.int64)
    cache_bits = max(1, min(10, len(pixels).bit_length() - 2))
    hit = _hits(pixels, cache_bits)[place]
    symbol, counted = green, _counts(single)
    greens = counted[1]
    if hit.any():
        with_cache = np.where(hit, 280 + _entry(pixels[place], 32 - cache_bits), green)
        fewer, more = _counts(single[~hit]), np.bincount(with_cache)
        if _cost(fewer[[0, 2, 3]]) + _cost(more) < CACHE_WORTH * _cost(counted):
            symbol, counted, greens = with_cache, fewer, more
        else:
            hit = np.zeros(len(place), bool)
    cache_bits = cache_bits if hit.any() else 0
    out.put(1 | cache_bits << 1, 5) if cache_bits else out.put(0, 1)
    if main:
        out.put(0, 1)  # one group of codes
    told = [(256 + a, b, n, c, d, m) for (a, b, n), (c, d, m) in ((_prefixed(x), _prefixed(1 if y == width else 2 if y == 1 else y + 120)) for _, x, y in copies)]
    length_symbol, length_extra, length_size, far_symbol, far_extra, far_size = np.array(told, np.int64).reshape(-1, 6).T
    counts = np.bincount(length_symbol, minlength=280 + (1 << cache_bits if cache_bits else 0))
    counts[: len(greens)] += greens
    reds, blues, alphas, far = counted[2], counted[0], counted[3], np.bincount(far_symbol, minlength=40)
    if _cost(counted[[0, 2]]) > SHARED_WORTH * (_cost(reds + blues) + 5 * np.count_nonzero(reds + blues)):
        reds = blues = reds + blues
    codes = [_put_code(out, counts)]
    first = len(out.values)
    codes.append(_put_code(out, reds))
    if reds is blues:
        codes.append(codes[1])
        out.values += out.values[first:]
        out.sizes += out.sizes[first:]
    else:
        codes.append(_put_code(out, blues))
    codes += [_put_code(out, alphas), _put_code(out, far)]
    values, sizes = codes[0][0][symbol], codes[0][1][symbol]
    for (bits, lengths), x in zip(codes[1:4], (red, blue, alpha), strict=True):
        if lengths.any():
            values |= np.where(hit, np.uint64(0), bits[x]) << sizes.astype(np.uint64)
            sizes = sizes + np.where(hit, 0, lengths[x])
    if copies:
        also, size = codes[0][0][length_symbol], codes[0][1][length_symbol]
        for x, n in ((length_extra.astype(np.uint64), length_size), (codes[4][0][far_symbol], codes[4][1][far_symbol]), (far_extra.astype(np.uint64), far_size)):
            also |= x << size.astype(np.uint64)
            size = size + n
        order = np.argsort(np.concatenate([place, [at for at, _, _ in copies]]), kind="stable")
        values, sizes = np.concatenate([values, also])[order], np.concatenate([sizes, size])[order]
    out.put_all(values, sizes)


def _guesses(image: np.ndarray, mode: int) -> np.ndarray:
    """What the predictor says for every pixel, with the first row's and column's own rules."""
    out = np.empty_like(image)
    out[0, 0] = (0, 0, 0, 255)
    out[0, 1:] = image[0, :-1]
    out[1:, 0] = image[:-1, 0]
    out[1:, 1:] = image[1:, :-1] if mode == 1 else _from_above(mode, image[:-1], image[1:, :1])
    return out


def _predict(channels: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """What remains after the best predictor of each block, and the table of predictors."""
    height, width, _ = channels.shape
    rest = np.stack([channels - _guesses(channels, mode) for mode in BY_ROWS])
    far = np.abs(rest.view(np.int8).astype(np.int64)).sum(3)
    far = np.add.reduceat(np.add.reduceat(far, np.arange(0, height, 1 << block), 1), np.arange(0, width, 1 << block), 2)
    best = far.argmin(0)
    chosen = np.repeat(np.repeat(best, 1 << block, 0)[:height], 1 << block, 1)[:, :width]
    table = np.array(BY_ROWS, np.uint32)[best] << np.uint32(8) | np.uint32(0xFF000000)
    return np.take_along_axis(rest, chosen[None, ..., None], 0)[0], table


def _shares(products: np.ndarray, n: int) -> tuple[int, int, int]:
    """Of green in red, green in blue and red in blue, from the sums of products of blue, green, red and 1 over n pixels."""
    means = products / n
    blue, green, red = (means - np.outer(means[3], means[3]))[:3].tolist()  # covariances

    def share(both: float, own: float, other: float) -> int:
        explained = min(both * both / (own * other), 0.999) if own * other > 0 else 0.0
        return min(127, max(-128, round(32 * both / own))) if -n / 2 * math.log2(1 - explained) > TABLE_BITS else 0

    to_red, to_blue = share(red[1], green[1], red[2]), share(blue[1], green[1], blue[0])
    return to_red, to_blue, share(blue[2] - to_blue / 32 * green[2], red[2], blue[0])


def _cross(channels: np.ndarray) -> tuple[np.ndarray, tuple[int, int, int]]:
    """Red less a share of green, blue less shares of green and red, and these shares in 32nds, by least squares. Shares
    that explain so little that their table would cost more are 0."""
    signed = channels.reshape(-1, 4).view(np.int8).astype(np.float64)
    signed[:, 3] = 1
    to_red, to_blue, red_blue = _shares(signed.T @ signed, len(signed))
    if not (to_red or to_blue or red_blue):
        return channels, (0, 0, 0)
    blue, green, red = (np.ascontiguousarray(channels[..., k]).view(np.int8).astype(np.int64) for k in range(3))
    out = channels.copy()
    out[..., 2] = (red - (to_red * green >> 5)).astype(np.uint8)
    out[..., 0] = (blue - (to_blue * green >> 5) - (red_blue * red >> 5)).astype(np.uint8)
    return out, (to_red, to_blue, red_blue)


#: Bits that a transform's table of one pixel takes.
TABLE_BITS = 64
#: Sides of the blocks that share a predictor, or the shares of cross-colour, as powers of two.
PREDICTED, CROSSED = 4, 9


def _put_palette(out: _Writer, image: np.ndarray, colours: np.ndarray) -> np.ndarray:
    """Writes the palette; returns the picture of its indices, several in a pixel for few colours."""
    out.put(1 | 3 << 1 | (len(colours) - 1) << 3, 11)
    table = colours.view(np.uint8).reshape(-1, 4)
    _put_image(out, np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8)).view(np.uint32).reshape(1, -1))
    index = np.searchsorted(colours, image)
    packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
    each = 1 << packed
    wide = np.zeros((len(index), _shrunk(index.shape[1], packed) * each), np.int64)
    wide[:, : index.shape[1]] = index
    joined = (wide.reshape(len(index), -1, each) << (np.arange(each) * (8 >> packed))).sum(2)
    return joined.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)


def _put_transforms(out: _Writer, image: np.ndarray) -> np.ndarray:
    """Writes the transforms that are estimated to save bits; returns the picture that they leave."""
    channels = _channels(image)
    less_green, (crossed, shares) = _less_green(channels), _cross(channels)
    left, top = channels.copy(), channels.copy()  # but for the rules of the edges
    left[:, 1:] -= channels[:, :-1]
    top[1:] -= channels[:-1]
    least, green_cost, *guessed, cross_cost = _picture_costs(channels, less_green, left, top, crossed)
    ordered = np.sort(image, axis=None)
    begins, times = _runs(ordered)
    if len(begins) <= 256 and 24 * len(begins) + _cost(times) < min(least, _cost(_counts(channels)[:3])):
        return _put_palette(out, image, ordered[begins])
    if min(guessed) < TRANSFORM_WORTH * least:
        rest, table = _predict(channels, PREDICTED)
        rest_green, (rest_crossed, rest_shares) = _less_green(rest), _cross(rest)
        costs = _picture_costs(rest, rest_green, rest_crossed)
        if costs[0] + 4 * table.size < TRANSFORM_WORTH * least:
            out.put(1 | (PREDICTED - 2) << 3, 6)
            _put_image(out, table)
            channels, less_green, crossed, shares = rest, rest_green, rest_crossed, rest_shares
            least, green_cost, cross_cost = costs
    if any(shares) and cross_cost + TABLE_BITS < min(TRANSFORM_WORTH * least, green_cost):
        out.put(1 | 1 << 1 | (CROSSED - 2) << 3, 6)
        to_red, to_blue, red_blue = (x & 255 for x in shares)
        _put_image(out, np.full((_shrunk(len(image), CROSSED), _shrunk(image.shape[1], CROSSED)), 255 << 24 | red_blue << 16 | to_blue << 8 | to_red, np.uint32))
        channels = crossed
    elif green_cost < TRANSFORM_WORTH * least:
        out.put(1 | 2 << 1, 3)
        channels = less_green
    return np.ascontiguousarray(channels).view(np.uint32)[..., 0]


def write_pixels(image: np.ndarray) -> bytes:
    """A lossless WebP file of 32-bit ARGB pixels [height, width]."""
    out = _Writer()
    out.put(SIGNATURE, 8)
    out.put(image.shape[1] - 1, 14)
    out.put(image.shape[0] - 1, 14)
    out.put(int((image >> np.uint32(24)).min() < 255), 4)  # alpha is used; version 0
    image = _put_transforms(out, image)
    out.put(0, 1)
    _put_image(out, image, main=True)
    return _riff(out.data())


def _riff(body: bytes) -> bytes:
    padded = body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + padded


def write_webp(samples: np.ndarray) -> bytes:
    """A lossless WebP file of RGB samples [height, width, 3]."""
    pixels = np.full((*samples.shape[:2], 4), 255, np.uint8)
    pixels[..., :3] = samples[..., ::-1]
    return write_pixels(pixels.view(np.uint32)[..., 0])


def padded(data: bytes) -> bytes:
    """Spaces appended up to a positive multiple of a row."""
    return data + b" " * (-len(data) % ROW_BYTES if data else ROW_BYTES)


def store(payload: bytes) -> bytes:
    """The payload as one picture; as several behind each other if it has more pixels than the format allows."""
    if len(payload) > 3 * TALLEST * TALLEST:
        return b"".join(store(payload[k : k + 3 * TALLEST * TALLEST]) for k in range(0, len(payload), 3 * TALLEST * TALLEST))
    samples = np.frombuffer(payload, np.uint8).reshape(-1, 3)
    across = WIDTH
    while len(samples) > across * TALLEST:
        across *= 2
    pixels = np.zeros((-(-len(samples) // across) * across, 4), np.uint8)  # transparent beyond the payload
    pixels[: len(samples), :3] = samples[:, ::-1]
    pixels[: len(samples), 3] = 255
    return write_pixels(pixels.view(np.uint32).reshape(-1, across))


class _Pictures:
    """Payloads of whole rows written as pictures without transforms, all at once, exactly as ``store`` writes each."""

    def __init__(self, payloads: list[bytes]):
        self.set(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 3), np.array([len(x) // 3 for x in payloads], np.int64))

    def set(self, samples: np.ndarray, sizes: np.ndarray) -> None:
        self.samples, self.sizes, self.n = samples, sizes, len(sizes)
        self.ends = np.cumsum(sizes)
        self.which = np.repeat(np.arange(self.n), sizes)

    def _counted(self, which: np.ndarray, values: np.ndarray, width: int = 256) -> np.ndarray:
        """How often each value occurs in each picture."""
        return np.bincount(which * width + values, minlength=self.n * width).reshape(self.n, width)

    def plain(self) -> np.ndarray:
        """Which pictures take no transform."""
        samples, begins = self.samples, self.ends - self.sizes
        red, green, blue = (self._counted(self.which, samples[:, k]) for k in range(3))
        own = _costs(red + green + blue, 15)
        less_green, left, top = samples.copy(), samples.reshape(-1, WIDTH, 3).copy(), samples.reshape(-1, ROW_BYTES).copy()
        less_green[:, ::2] -= samples[:, 1:2]
        left[:, 1:] -= samples.reshape(-1, WIDTH, 3)[:, :-1]
        top[1:] -= samples.reshape(-1, ROW_BYTES)[:-1]
        top[begins // WIDTH] = samples.reshape(-1, ROW_BYTES)[begins // WIDTH]
        wide = np.repeat(self.which, 3)
        green_cost, left_cost, top_cost = (_costs(self._counted(wide, x.ravel()), 15) for x in (less_green, left, top))
        signed = np.ones((4, len(samples)), np.int64)
        signed[:3] = samples.view(np.int8)[:, ::-1].T
        products = np.empty((self.n, 4, 4))
        for i in range(4):
            for j in range(i, 4):
                products[:, i, j] = products[:, j, i] = np.add.reduceat(signed[i] * signed[j], begins)
        shares = np.array([_shares(x, n) for x, n in zip(products, self.sizes.tolist(), strict=True)])
        crossed = shares.any(1)
        some = crossed[self.which]
        to_red, to_blue, red_blue = shares[self.which[some]].T
        others, less = signed[:3, some], samples[some]  # of blue, green and red
        less[:, 0] -= (to_red * others[1] >> 5).astype(np.uint8)
        less[:, 2] -= ((to_blue * others[1] >> 5) + (red_blue * others[2] >> 5)).astype(np.uint8)
        cross_cost = _costs(self._counted(np.repeat(self.which[some], 3), less.ravel()), 15)
        crossed &= cross_cost + TABLE_BITS < np.minimum(TRANSFORM_WORTH * own, green_cost)
        colour = samples.astype(np.int64) @ np.array([1 << 16, 1 << 8, 1])
        ordered = np.sort(colour | self.which << 24)
        first, times = _runs(ordered)
        picture = ordered[first] >> 24
        colours = np.bincount(picture, minlength=self.n)
        entropy = _entropy(self.sizes) - np.add.reduceat(_entropy(times), np.cumsum(colours) - colours)
        palette = (colours <= 256) & (24 * colours + entropy / 256 + 5 * colours < np.minimum(own, _costs(red) + _costs(green) + _costs(blue)))
        return ~(palette | crossed | (np.minimum(np.minimum(left_cost, top_cost), green_cost) < TRANSFORM_WORTH * own))

    def _copies(self, pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_copies`` of each picture."""
        key = np.sort(_three(pixels)[self.which[2:] == self.which[:-2]])
        order, key = (key & PLACE).astype(np.int64), key & ~PLACE
        same = (key[1:] == key[:-1]) & (self.which[order[1:]] == self.which[order[:-1]])
        pairs = np.sort(order[1:][same] << PLACE_BITS | order[:-1][same])
        later, earlier = pairs >> PLACE_BITS, pairs & int(PLACE)
        most = np.minimum(self.ends[self.which[later]] - later, LONGEST_COPY)
        ahead = np.lib.stride_tricks.sliding_window_view(np.append(pixels, np.zeros(16, np.uint32)), 16)
        length = np.empty(len(later), np.int64)
        for k in range(0, len(later), 1 << 16):
            differ = ahead[later[k : k + (1 << 16)]] != ahead[earlier[k : k + (1 << 16)]]
            length[k : k + (1 << 16)] = np.where(differ.any(1), differ.argmax(1), 16)
        found, free = [], 0
        for i, j, n, end in zip(later.tolist(), earlier.tolist(), np.minimum(length, most).tolist(), most.tolist(), strict=True):
            if i < free:
                continue
            if n == 16:
                n = _agreed(pixels, i, j, end)
            if n >= SHORTEST_COPY and i - j <= FARTHEST:
                found.append((i, n, i - j))
                free = i + n
        return tuple(np.array(found, np.int64).reshape(-1, 3).T)

    def files(self) -> list[bytes]:
        n, which = self.n, self.which
        samples = self.samples.astype(np.int64)
        pixels = (samples @ np.array([1 << 16, 1 << 8, 1]) | 255 << 24).astype(np.uint32)
        at, length, distance = self._copies(pixels)
        single = np.ones(len(pixels), bool)
        single[_spans(at, length)] = False
        place = np.flatnonzero(single)
        cache_bits = np.clip(np.frexp(self.sizes)[1] - 2, 1, 10).astype(np.int64)
        entry = _entry(pixels, (32 - cache_bits)[which])
        order = np.sort((which << 11 | entry) << PLACE_BITS | np.arange(len(pixels))) & int(PLACE)
        hit = np.zeros(len(pixels), bool)
        hit[order[1:]] = (pixels[order[1:]] == pixels[order[:-1]]) & (which[order[1:]] == which[order[:-1]])
        hit, entry, picture = hit[place], entry[place], which[place]
        red, green, blue = samples[place].T
        # with and without a colour cache
        wide = 280 + 1024
        with_cache = np.where(hit, 280 + entry, green)
        few, rest = picture[~hit], ~hit
        more, greens = self._counted(picture, with_cache, wide), self._counted(picture, green)
        reds, blues, fewer_reds, fewer_blues = self._counted(picture, red), self._counted(picture, blue), self._counted(few, red[rest]), self._counted(few, blue[rest])
        alphas, fewer_alphas = np.bincount(picture, minlength=n), np.bincount(few, minlength=n)
        cached = _costs(fewer_blues) + _costs(fewer_reds) + 5 * (fewer_alphas > 0) + _costs(more) < CACHE_WORTH * (_costs(blues) + _costs(greens) + _costs(reds) + 5 * (alphas > 0))
        cached &= fewer_alphas < alphas
        hit &= cached[picture]
        symbol = np.where(hit, with_cache, green)
        cache_bits[~cached] = 0
        counts = np.where(cached[:, None], more, 0)
        counts[:, :256] = np.where(cached[:, None], more[:, :256], greens)
        reds, blues = np.where(cached[:, None], fewer_reds, reds), np.where(cached[:, None], fewer_blues, blues)
        alphas = np.where(cached, fewer_alphas, alphas)
        copier = which[at]
        length_symbol, length_extra, length_size = _all_prefixed(length)
        far_symbol, far_extra, far_size = _all_prefixed(np.where(distance == WIDTH, 1, np.where(distance == 1, 2, distance + 120)))
        counts += self._counted(copier, 256 + length_symbol, wide)
        both = reds + blues
        shared = _costs(blues) + _costs(reds) > SHARED_WORTH * (_costs(both) + 5 * np.count_nonzero(both, 1))
        own = np.flatnonzero(~shared)
        reds[shared] = both[shared]
        of_blue = np.arange(n)
        of_blue[own] = n + np.arange(len(own))
        greens = _Codes(counts, 280 + np.where(cached, 1 << cache_bits, 0))
        colours = _Codes(np.concatenate([reds, blues[own]]), np.full(n + len(own), 256))
        fars = _Codes(self._counted(copier, far_symbol, 40), np.full(n, 40))
        # tokens, by place
        value, size = np.zeros(len(pixels), np.int64), np.zeros(len(pixels), np.int64)
        values, sizes = greens.bits[picture, symbol], greens.lengths[picture, symbol].astype(np.int64)
        literal = ~hit
        for row, x in ((picture, red), (of_blue[picture], blue)):
            values |= colours.bits[row, x] * literal << sizes
            sizes += colours.lengths[row, x] * literal
        value[place], size[place] = values, sizes
        values, sizes = greens.bits[copier, 256 + length_symbol], greens.lengths[copier, 256 + length_symbol].astype(np.int64)
        for x, k in ((length_extra, length_size), (fars.bits[copier, far_symbol], fars.lengths[copier, far_symbol]), (far_extra, far_size)):
            values |= x << sizes
            sizes += k
        value[at], size[at] = values, sizes
        begun = size > 0
        # the parts of every file in their order
        head = SIGNATURE | WIDTH - 1 << 8 | self.sizes // WIDTH - 1 << 22 | np.where(cached, 1 | cache_bits << 1, 0) << 41
        alpha = np.where(alphas > 0, 1 | (255 << 1 | 1) << 2, 1), np.where(alphas > 0, 11, 4)
        each = np.arange(n)
        parts = [(each, head, np.where(cached, 47, 43)), greens.parts(each), colours.parts(each), colours.parts(of_blue), (each, *alpha), fars.parts(each), (which[begun], value[begun], size[begun])]
        key = np.concatenate([(x << 3 | k).astype(np.uint16) for k, (x, _, _) in enumerate(parts)])
        order = np.argsort(key, kind="stable")
        picture, values, sizes = (key >> 3)[order].astype(np.int64), *(np.concatenate([x[k] for x in parts])[order] for k in (1, 2))
        ends = np.cumsum(sizes)
        last = np.cumsum(np.bincount(picture, minlength=n)) - 1
        bits = np.diff(ends[last], prepend=0)
        words = (bits + 63) // 64
        begins = np.cumsum(words) - words
        starts = ends - sizes + (64 * begins - ends[last] + bits)[picture]
        data = _packed(values.astype(np.uint64), starts, int(words.sum()))
        return [_riff(data[8 * k : 8 * k + (m + 7) // 8]) for k, m in zip(begins.tolist(), bits.tolist(), strict=True)]


class _Codes:
    """What ``_put_code`` writes for each row of counts, alphabets being of some widths."""

    def __init__(self, counts: np.ndarray, widths: np.ndarray):
        m = len(counts)
        row, symbol = np.nonzero(counts)
        times = np.bincount(row, minlength=m)
        ends = np.cumsum(times)
        symbols = np.append(symbol, 0)
        first, last = np.where(times > 0, symbols[ends - times], 0), np.where(times > 0, symbols[ends - 1], 0)
        simple = (times <= 2) & (last < 256)
        two = simple & (times == 2)
        head = 1 | two << 1 | np.where(first < 2, first << 1, first << 1 | 1) << 2
        head_size = np.where(first < 2, 4, 11)
        head |= np.where(two, last, 0) << head_size
        head_size += 8 * two
        self.lengths = np.zeros(counts.shape, np.uint8)
        order = np.argsort(row << 32 | counts[row, symbol], kind="stable")
        weights, depths = counts[row, symbol][order].tolist(), []
        for end, n, plain in zip(ends.tolist(), times.tolist(), simple.tolist(), strict=True):
            depths += [1 if n == 2 else 0] * n if plain else _tree(weights[end - n : end], LONGEST)
        self.lengths[row, symbol[order]] = depths
        self.bits = _code_bits(self.lengths)
        # code lengths, told in runs
        normal = np.flatnonzero(~simple)
        told = np.arange(counts.shape[1]) < widths[normal, None]
        flat, owner = self.lengths[normal][told], np.repeat(np.arange(len(normal)), widths[normal])
        begins = np.flatnonzero(_new(flat) | _new(owner))
        value, run = flat[begins].astype(np.int64), np.diff(begins, append=len(flat))
        (kinds, extras, extra_sizes), token_begins = _all_run_tokens()
        index = 2 * run + (value > 0)
        n_tokens = token_begins[index + 1] - token_begins[index]
        token = _spans(token_begins[index], n_tokens)
        owner, kind = np.repeat(owner[begins], n_tokens), kinds[token]
        kind = np.where(kind == 1, np.repeat(value, n_tokens), kind)
        sizes = np.zeros((len(normal), 19), np.uint8)
        for k, seen in enumerate(np.bincount(owner * 19 + kind, minlength=19 * len(normal)).reshape(-1, 19).tolist()):
            used = sorted((c, x) for x, c in enumerate(seen) if c)
            if len(used) == 1:
                used.insert(0, (1, (used[0][1] + 1) % 16))
            for (_, x), size in zip(used, _tree([c for c, _ in used], 7), strict=True):
                sizes[k, x] = size
        turned = _code_bits(sizes)
        stored = sizes[:, CODE_LENGTH_ORDER].astype(np.int64)
        held = np.maximum(4, 19 - (stored[:, ::-1] > 0).argmax(1))
        head[normal] = held - 4 << 1 | (stored << 5 + 3 * np.arange(19)).sum(1)
        head_size[normal] = 5 + 3 * held + 1
        values = turned[owner, kind] | extras[token] << sizes[owner, kind]
        rows = np.concatenate([np.arange(m) << 1, normal[owner] << 1 | 1])
        order = np.argsort(rows.astype(np.uint16) if m < 1 << 15 else rows, kind="stable")
        self.values = np.concatenate([head, values])[order]
        self.sizes = np.concatenate([head_size, sizes[owner, kind] + extra_sizes[token]])[order]
        self.n_parts = np.bincount(rows >> 1, minlength=m)
        self.begins = np.cumsum(self.n_parts) - self.n_parts

    def parts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some rows: which of them, the numbers and their bits."""
        at = _spans(self.begins[rows], self.n_parts[rows])
        return np.repeat(np.arange(len(rows)), self.n_parts[rows]), self.values[at], self.sizes[at]


def _code_bits(lengths: np.ndarray) -> np.ndarray:
    """The bits of canonical codes, a row of lengths each."""
    row, symbol = np.nonzero(lengths)
    size, longest = lengths[row, symbol].astype(np.int64), lengths.max(1, initial=0).astype(np.int64)
    order = np.argsort((row << 4 | size).astype(np.int32), kind="stable")
    row, symbol, size = row[order], symbol[order], size[order]
    shares = 1 << longest[row] - size
    whole = np.where(longest > 0, 1 << longest, 0)
    first = np.cumsum(shares) - shares - (np.cumsum(whole) - whole)[row]
    out = np.zeros(lengths.shape, np.int64)
    out[row, symbol] = _turned(LONGEST)[first] >> LONGEST - longest[row]
    return out


@lru_cache(1)
def _all_run_tokens() -> tuple[np.ndarray, np.ndarray]:
    """``_run_tokens`` of the values 0 and 1 for runs of all lengths, and where those of 2 * length + value begin."""
    runs = [_run_tokens(value, n) for n in range(280 + 1024 + 1) for value in (0, 1)]
    return np.array(list(itertools.chain.from_iterable(runs)), np.int64).T, np.cumsum([0, *map(len, runs)])


def _all_prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    less = values - 1
    n = np.maximum(np.frexp(less)[1].astype(np.int64) - 2, 0)
    return np.where(values <= 4, less, 2 * n + (less >> n & 1) + 2), np.where(values <= 4, 0, less & (1 << n) - 1), n


def store_all(payloads: list[bytes]) -> list[bytes]:
    """Files of many payloads, as ``store`` writes them."""
    found: list[bytes | None] = [None] * len(payloads)
    part: list[int] = []
    pixels = 0

    def write() -> None:
        if len(part) >= FEW_STREAMS:
            together = _Pictures([payloads[k] for k in part])
            plain = together.plain()
            if plain.any():
                together.set(together.samples[plain[together.which]], together.sizes[plain])
                for k, file in zip(np.array(part)[plain].tolist(), together.files(), strict=True):
                    found[k] = file
        part.clear()

    for k, payload in enumerate(payloads):
        n = len(payload) // 3
        if n > min(TOGETHER, WIDTH * TALLEST):
            continue
        if pixels + n > WRITTEN_TOGETHER or len(part) == MOST_STREAMS:
            write()
            pixels = 0
        part.append(k)
        pixels += n
    write()
    return [store(payload) if x is None else x for payload, x in zip(payloads, found, strict=True)]


def pictures(media: bytes) -> Iterator[np.ndarray]:
    """Red, green, blue and alpha of each picture in the file."""
    at = 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        yield _channels(WebpReader(media[at : at + size]).pixels())[..., [2, 1, 0, 3]]
        at += size


def restore(media: bytes) -> bytes:
    """The payload: the samples of all pixels that aren't transparent."""
    found = []
    for picture in pictures(media):
        shown = picture.reshape(-1, 4)
        found.append(np.ascontiguousarray(shown[shown[:, 3] > 0, :3]).tobytes())
    return b"".join(found)


def restore_all(files: list[bytes]) -> list[bytes]:
    """The payloads of many files, as ``restore`` gives them."""
    found: list[bytes | None] = [None] * len(files)
    part: list[tuple[int, WebpReader]] = []
    pixels = 0

    def read() -> None:
        if len(part) >= FEW_STREAMS:
            for (k, reader), image in zip(part, _Streams([r for _, r in part]).pixels(), strict=True):
                if image is not None:
                    shown = _channels(reader.finished(image)).reshape(-1, 4)
                    found[k] = (shown if shown[:, 3].all() else shown[shown[:, 3] > 0])[:, 2::-1].tobytes()
        part.clear()

    for k, file in enumerate(files):
        if len(file) < 12 or len(file) != 8 + struct.unpack_from("<I", file, 4)[0]:
            continue  # several pictures, or none
        reader = WebpReader(file)
        reader.begin()
        n = reader.inner * reader.height
        if n > TOGETHER or not reader.one_group():
            continue
        if pixels + n > TOGETHER_ALL or len(part) == MOST_STREAMS:
            read()
            pixels = 0
        part.append((k, reader))
        pixels += n
    read()
    return [restore(file) if x is None else x for file, x in zip(files, found, strict=True)]


def features(samples: np.ndarray) -> str:
    """Mean and deviation of each channel, and an average hash of 8 x 8 cells, in hexadecimal."""
    height = len(samples)
    pixels = samples.reshape(-1, 3).astype(np.int64)
    mean = pixels.sum(0) / len(pixels)
    spread = np.sqrt(np.maximum((pixels * pixels).sum(0) / len(pixels) - mean * mean, 0))
    columns = pixels.reshape(height, 8, -1).sum(2)
    bounds = np.arange(9) * height // 8
    cells = np.add.reduceat(columns, bounds[:-1]) / np.diff(bounds)[:, None] if height >= 8 else columns[bounds[:-1]]
    flags = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    return ",".join(f"{x:.3f}" for x in (*mean, *spread)) + "," + flags


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as a picture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            data = batch.column("_text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array(store_all([padded(x) for x in data]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def decode_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds payload, the bytes read back, and feature, a string describing the picture. ``df`` has no such columns yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, media_col):
            payload = restore_all(batch.column(media_col).to_pylist())
            shown = [features(np.frombuffer(x, np.uint8).reshape(-1, WIDTH, 3)) for x in payload]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payload, pa.binary()), pa.array(shown, pa.string())], names=[*batch.schema.names, "payload", "feature"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, payload binary, feature string")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as pictures and read back, as digests."""
    back = decode_media(encode_media(documents(spark, sf_dir)))
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
