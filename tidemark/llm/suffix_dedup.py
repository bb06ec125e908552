"""Removal of long byte strings that occur more than once, by a hash-compared suffix sort.

A byte goes if it is covered by a string of ``length`` bytes that also starts anywhere else in the corpus. Sorting all
suffixes of a corpus is out of reach, so only suffixes whose first ``length`` bytes can repeat are sorted:

1. Prefix polynomial hashes give the hash of any substring at once. Every window of ``length`` bytes chooses an anchor,
   the least hashed substring of ``ANCHOR`` bytes in it; equal windows choose equal anchors at equal places, so an
   anchor that occurs once settles all windows that chose it. Neighbouring windows with one anchor form a run.
   Runs of equal bytes within one segment are folded where they are.
2. Anchors are counted. The contexts of runs of repeated anchors are cut out of the texts and digested (BLAKE2, 128
   bits, which stands for the bytes); runs whose whole context occurs again are covered at once.
3. Of anchors with several contexts one run for each goes on. Their suffixes are mergesorted; a comparison finds the
   common extension by binary search on the prefix hashes, and extensions of ``length`` bytes or more between
   neighbours are verified byte by byte. Anchors with very many distinct contexts, which would make one task large,
   are dealt out by window hash instead: equal windows of a batch are settled where they are, and one of each goes on
   to a part of the anchor's windows that grows no larger with the corpus; this exact way takes two hashes of
   different families (polynomial and XXH3) as its verification.

Rows are numbered and texts packed once, in the shared folder; every later pass reads those.

Defined cases: a null or empty text has no bytes and loses none; texts shorter than ``length`` lose none; matches never
cross texts, overlapping matches in one text count; equal texts of ``length`` bytes or more lose everything; rows with
equal ids stay apart; an empty table gives no rows; other columns are not read. Kept texts that would end in the
middle of a character lose that character's remaining bytes; kept bytes are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key, lru_cache
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, free_name, packed_rows, shuffle_partitions, sliced, stage, unpacked, with_row

LENGTH, ANCHOR = 200, 48
#: Distinct contexts of one anchor that one task sorts; anchors with more are dealt out by window hash.
TASK_CONTEXTS = 256
#: Contexts whose windows meet in one task there, about.
PART_CONTEXTS = 4096
PLACE_BITS = 28  # of a place in a batch of texts
#: Windows of a long text that are hashed at a time.
SEGMENT = 1 << 20
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


@lru_cache(4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2^64."""
    out = []
    for x in (base, pow(base, -1, 1 << 64)):
        powers = np.full(size, x, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers))
    return out[0], out[1]


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, max(1 << 16, 1 << int(size - 1).bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the low bits of a polynomial hash."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Prefixes:
    """Prefix hashes of a byte array."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        self.power, self.inverse = powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all(self, size: int) -> np.ndarray:
        """The hash of every substring of one size."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def runs(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor's distance from the first window, anchor hash) of all runs."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if len(data) < length:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    if len(data) >= 1 << PLACE_BITS:
        raise ValueError("a text is longer than the places that runs() can hold")
    hashes = Prefixes(data)
    anchors = hashes.all(anchor)
    places = np.arange(len(anchors), dtype=np.uint64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    chosen = (sliding_min((anchors & ~low) | places, length - anchor + 1) & low).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), np.maximum(sizes - length + 1, 0))
    if not len(owner):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    counts = np.maximum(sizes - length + 1, 0)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]
    at = chosen[window]
    begin = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])))
    many = np.diff(np.append(begin, len(owner)))
    first, at, owner = window[begin], at[begin], owner[begin]
    return owner, first - starts[owner], many, at - first, anchors[at].view(np.int64)


def segmented(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of (texts, first bytes, parts) of about ``SEGMENT`` bytes: long texts in segments that overlap by less than
    one window, so each window is in one."""
    source, begin, parts, held = [], [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), SEGMENT):
            part = text[at : at + SEGMENT + length - 1]
            if held and held + len(part) > SEGMENT:
                yield source, begin, parts
                source, begin, parts, held = [], [], [], 0
            source.append(k)
            begin.append(at)
            parts.append(part)
            held += len(part)
    if parts:
        yield source, begin, parts


def folded(parts: list[bytes], found: tuple[np.ndarray, ...], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(run whose context has the same bytes and comes first here, or the run itself; whether its context comes again here)"""
    owner, first, many, _, h = found
    leader, again = np.arange(len(h)), np.zeros(len(h), bool)
    order = np.argsort(h, kind="stable")
    same = np.append(h[order][1:] == h[order][:-1], False)
    seen: dict[tuple[int, bytes], int] = {}
    for k in np.sort(order[same | np.append(False, same[:-1])]).tolist():
        context = parts[owner[k]][first[k] : first[k] + many[k] - 1 + length]
        one = seen.setdefault((int(h[k]), context), k)
        if one != k:
            leader[k], again[one] = one, True
    return leader, again


def _find_runs(length: int):
    """Runs, one for each context of a segment; the others of equal bytes are told at once as covered ranges (``_h`` null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in unpacked(batches):
            for source, begin, parts in segmented(texts, length):
                found = runs(parts, length)
                owner, first, many, off, h = found
                leader, again = folded(parts, found, length)
                kept = leader == np.arange(len(leader))
                rows = batch.column("_row").to_numpy()[np.array(source, np.int64)[owner]]
                first = first + np.array(begin, np.int64)[owner]
                told = [(r, a, b - a - length + 1) for r, a, b in _ranges(rows[~kept], first[~kept], many[~kept], length)]
                n = len(told)
                columns = [
                    pa.array([None] * n + h[kept].tolist(), pa.int64()), pa.array([x[0] for x in told] + rows[kept].tolist(), pa.int64()), pa.array([x[1] for x in told] + first[kept].tolist(), pa.int32()),
                    pa.array([x[2] for x in told] + many[kept].tolist(), pa.int32()), pa.array([0] * n + off[kept].tolist(), pa.int16()), pa.array([True] * n + again[kept].tolist(), pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["_h", "_row", "_lo", "_n", "_off", "_again"])

    return run


def _ranges(rows: np.ndarray, first: np.ndarray, many: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Covered byte ranges (row, start, end) of runs, those that touch in one."""
    out: list[list[int]] = []
    for k in np.lexsort((first, rows)).tolist():
        row, start, end = int(rows[k]), int(first[k]), int(first[k] + many[k] - 1 + length)
        if out and out[-1][0] == row and start <= out[-1][2]:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([row, start, end])
    return [(a, b, c) for a, b, c in out]


class SuffixOrder:
    """Order of suffixes of some byte strings, compared by hashes."""

    def __init__(self, data: bytes):
        hashes = Prefixes(np.frombuffer(data, np.uint8))
        self.data, self.sums, self.power = data, hashes.sums.tolist(), hashes.power[: len(data) + 1].tolist()

    def extension(self, i: int, j: int, most: int) -> int:
        """Length of the common extension of the suffixes at i and j, up to ``most``: binary search on hashes."""
        sums, low, high = self.sums, 0, most
        pi, pj, si, sj = self.power[i], self.power[j], sums[i], sums[j]
        if not ((sums[i + most] - si) * pj - (sums[j + most] - sj) * pi) & MASK:
            return most
        while low < high:
            middle = (low + high + 1) >> 1
            if ((sums[i + middle] - si) * pj - (sums[j + middle] - sj) * pi) & MASK:
                high = middle - 1
            else:
                low = middle
        return low

    def sort(self, suffixes: list[int], most: int) -> list[int]:
        """A mergesort of the suffixes by their first ``most`` bytes."""

        def compare(i: int, j: int) -> int:
            n = self.extension(i, j, most)
            return 0 if n == most else self.data[i + n] - self.data[j + n]

        return sorted(suffixes, key=cmp_to_key(compare))


def repeated_windows(contexts: list[bytes], offs: list[int], length: int) -> list[np.ndarray]:
    """For contexts of one anchor, which of their windows also begin another context's window.

    Windows whose own hash occurs once are left out before sorting: their extensions are shorter than ``length``."""
    data = b"".join(contexts)
    counts = np.array([len(x) - length + 1 for x in contexts])
    starts = np.cumsum([0, *map(len, contexts)])[:-1]
    found = [np.zeros(n, bool) for n in counts]
    owner = np.repeat(np.arange(len(contexts)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    hashes = Prefixes(np.frombuffer(data, np.uint8)).all(length)[starts[owner] + within]
    by_hash = np.argsort(hashes, kind="stable")
    same = hashes[by_hash][1:] == hashes[by_hash][:-1]
    may = np.zeros(len(hashes), bool)
    may[by_hash[1:][same]] = may[by_hash[:-1][same]] = True
    may = np.flatnonzero(may)
    if not len(may):
        return found
    order = SuffixOrder(data)
    by_shift: dict[int, dict[int, tuple[int, int]]] = {}
    for k, w in zip(owner[may].tolist(), within[may].tolist(), strict=True):  # windows at one distance from the anchor together
        by_shift.setdefault(w - offs[k], {})[int(starts[k]) + w] = (k, w)
    for suffixes in by_shift.values():
        for i, j in pairwise(order.sort(list(suffixes), length)):
            if order.extension(i, j, length) == length and data[i : i + length] == data[j : j + length]:
                for k, w in (suffixes[i], suffixes[j]):
                    found[k][w] = True
    return found


def _flag_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges[::2], edges[1::2] - edges[::2]


def _sort_groups(length: int):
    """Over contexts ordered by anchor: the windows that repeat, of contexts that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows, lo, many = [], [], []

        def settle() -> None:
            if len(held) > 1:
                for (_, once, row, first, _, _), flags in zip(held, repeated_windows([x[5] for x in held], [x[4] for x in held], length), strict=True):
                    if once:
                        for a, n in zip(*_flag_runs(flags), strict=True):
                            rows.append(row)
                            lo.append(first + int(a))
                            many.append(int(n))
            held.clear()

        for batch in batches:
            for record in zip(*(batch.column(c).to_pylist() for c in ("_h", "_once", "_row", "_lo", "_off", "_bytes")), strict=True):
                if held and record[0] != held[0][0]:
                    settle()
                held.append(record)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(lo, pa.int32()), pa.array(many, pa.int32())], names=["_row", "_lo", "_n"])
                rows, lo, many = [], [], []
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(lo, pa.int32()), pa.array(many, pa.int32())], names=["_row", "_lo", "_n"])

    return run


WINDOW = np.dtype([("w1", "<i8"), ("w2", "<i8"), ("row", "<i8"), ("lo", "<i4"), ("once", "?"), ("known", "?")])


def _repeated(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the windows ordered by their two hashes, the number of each one's group of equals)"""
    ordered = windows[np.lexsort((windows["w2"], windows["w1"]))]
    new = np.append(True, (ordered["w1"][1:] != ordered["w1"][:-1]) | (ordered["w2"][1:] != ordered["w2"][:-1]))
    return ordered, np.cumsum(new) - 1


def _told(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (row, first window, windows) of single windows."""
    windows = windows[np.lexsort((windows["lo"], windows["row"]))]
    begin = np.flatnonzero(np.append(True, (windows["row"][1:] != windows["row"][:-1]) | (windows["lo"][1:] != windows["lo"][:-1] + 1))) if len(windows) else np.empty(0, np.int64)
    return windows["row"][begin].astype(np.int64), windows["lo"][begin].astype(np.int32), np.diff(np.append(begin, len(windows))).astype(np.int32)


def _settle(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows found to repeat, one representative of each group of equals): a window repeats if it has an equal or is known to."""
    ordered, group = _repeated(windows)
    if not len(ordered):
        return ordered, ordered
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    repeats = (np.diff(np.append(first, len(ordered))) > 1) | np.logical_or.reduceat(ordered["known"], first)
    reps = ordered[first].copy()
    reps["known"] = repeats
    return ordered[repeats[group] & ordered["once"]], reps


def _deal(length: int):
    """Windows of contexts of anchors that have very many. Equal windows of a batch are settled at once; one
    representative of each goes on, packed by anchor and by a part of its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                contexts, parts = part.column("_bytes").to_pylist(), part.column("_parts").to_numpy()
                data = np.frombuffer(b"".join(contexts), np.uint8)
                counts = np.array([len(x) - length + 1 for x in contexts])
                starts = np.cumsum([0, *map(len, contexts)])[:-1]
                owner = np.repeat(np.arange(len(contexts)), counts)
                within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                first = starts[owner] + within
                windows = np.empty(len(owner), WINDOW)
                windows["w1"] = Prefixes(data).of(first, first + length).view(np.int64)
                whole, digest = data.tobytes(), xxhash.xxh3_64_intdigest
                windows["w2"] = np.fromiter((digest(whole[i : i + length]) for i in first.tolist()), np.uint64, len(first)).view(np.int64)
                windows["row"], windows["lo"] = part.column("_row").to_numpy()[owner], part.column("_lo").to_numpy()[owner] + within
                windows["once"] = np.array(part.column("_once").to_pylist(), bool)[owner]
                windows["known"] = ~windows["once"]
                anchor = part.column("_h").to_numpy()[owner]
                salt = (windows["w1"] % parts[owner]).astype(np.int64)
                found, packed = [np.empty(0, WINDOW)], []
                order = np.lexsort((salt, anchor))
                bounds = np.flatnonzero(np.append(True, (anchor[order][1:] != anchor[order][:-1]) | (salt[order][1:] != salt[order][:-1])))
                for group in np.split(order, bounds[1:]):
                    repeated, reps = _settle(windows[group])
                    found.append(repeated)
                    packed.append((int(anchor[group[0]]), int(salt[group[0]]), reps.tobytes()))
                row, lo, many = _told(np.concatenate(found))
                n, m = len(packed), len(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in packed] + [None] * m, pa.int64()), pa.array([x[1] for x in packed] + [None] * m, pa.int64()), pa.array([x[2] for x in packed] + [None] * m, pa.binary()),
                     pa.array([None] * n + row.tolist(), pa.int64()), pa.array([None] * n + lo.tolist(), pa.int32()), pa.array([None] * n + many.tolist(), pa.int32())],
                    names=["_h", "_salt", "_windows", "_row", "_lo", "_n"],
                )

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over packed windows ordered by anchor and part: those that repeat in other batches."""
    at, held = None, []

    def settled() -> pa.RecordBatch:
        repeated, _ = _settle(np.concatenate([np.frombuffer(x, WINDOW) for x in held])) if held else (np.empty(0, WINDOW), None)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _told(repeated)], names=["_row", "_lo", "_n"])

    for batch in batches:
        for h, salt, windows in zip(batch.column("_h").to_pylist(), batch.column("_salt").to_pylist(), batch.column("_windows").to_pylist(), strict=True):
            if (h, salt) != at:
                yield settled()
                at, held = (h, salt), []
            held.append(windows)
    yield settled()


def _digested(length: int):
    """The digest of every listed context of compressed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in unpacked(batches):
            source, digests, fields = [], [], {n: [] for n in ("_h", "_lo", "_n", "_off", "_again")}
            for k, (data, found) in enumerate(zip(texts, part.column("_runs").to_pylist(), strict=True)):
                for one in found:
                    source.append(k)
                    digests.append(blake2b(data[one["_lo"] : one["_lo"] + one["_n"] - 1 + length], digest_size=16).digest())
                    for n, values in fields.items():
                        values.append(one[n])
            kinds = {"_h": pa.int64(), "_lo": pa.int32(), "_n": pa.int32(), "_off": pa.int16(), "_again": pa.bool_()}
            yield pa.RecordBatch.from_arrays([part.column("_row").take(pa.array(source, pa.int32())), pa.array(digests, pa.binary()), *(pa.array(v, kinds[n]) for n, v in fields.items())], names=["_row", "_d", *fields])

    return run


def _contexts(length: int):
    """Cuts contexts out of compressed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in unpacked(batches, 1 << 20):
            source, cut, names = [], [], ("_h", "_once", "_lo", "_off")
            fields: dict[str, list] = {n: [] for n in names}
            for k, (data, reps) in enumerate(zip(texts, part.column("_reps").to_pylist(), strict=True)):
                for rep in reps:
                    source.append(k)
                    cut.append(data[rep["_lo"] : rep["_lo"] + rep["_n"] - 1 + length])
                    for n in names:
                        fields[n].append(rep[n])
            yield pa.RecordBatch.from_arrays([pa.array(fields["_h"], pa.int64()), pa.array(fields["_once"], pa.bool_()), part.column("_row").take(pa.array(source, pa.int32())), pa.array(fields["_lo"], pa.int32()), pa.array(fields["_off"], pa.int16()), pa.array(cut, pa.binary())], names=["_h", "_once", "_row", "_lo", "_off", "_bytes"])

    return run


def covered(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """_row, _spans: the covered byte ranges of rows that have any, unmerged. ``packed``: see ``packed_rows``."""
    texts = packed.select("_row", "_n_bytes", "_zstd")
    found = stage(texts.filter(F.col("_n_bytes") >= length).mapInArrow(_find_runs(length), "_h long, _row long, _lo int, _n int, _off smallint, _again boolean"), "runs")
    times = (F.count(F.lit(1)) + F.count_if("_again")).alias("_k")
    repeated = stage(found.filter("_h IS NOT NULL").groupBy("_h").agg(times).filter("_k > 1").select("_h"), "anchors")
    per_row = found.join(repeated, "_h").groupBy("_row").agg(F.collect_list(F.struct("_h", "_lo", "_n", "_off", "_again")).alias("_runs"))  # bounded by the row's own text
    candidates = stage(texts.join(per_row, "_row").mapInArrow(_digested(length), "_row long, _d binary, _h long, _lo int, _n int, _off smallint, _again boolean"), "candidates")
    by_context = stage(candidates.groupBy("_h", "_d").agg(times, F.min(F.struct("_row", "_lo", "_n", "_off")).alias("_rep")), "contexts")
    per_anchor = stage(by_context.groupBy("_h").agg(F.count(F.lit(1)).alias("_contexts")).filter("_contexts > 1"), "mixed-anchors")
    reps = by_context.join(per_anchor.select("_h"), "_h").select("_rep.*", "_h", (F.col("_k") == 1).alias("_once"))
    per_row = reps.groupBy("_row").agg(F.collect_list(F.struct("_lo", "_n", "_off", "_h", "_once")).alias("_reps"))
    cut = stage(texts.join(per_row, "_row").mapInArrow(_contexts(length), "_h long, _once boolean, _row long, _lo int, _off smallint, _bytes binary"), "cut")
    parts = F.ceil(F.col("_contexts") / PART_CONTEXTS).cast("long")
    large = stage(per_anchor.filter(F.col("_contexts") > TASK_CONTEXTS).select("_h", parts.alias("_parts")), "large")
    tasks = shuffle_partitions(packed.sparkSession)
    small = cut.join(large, "_h", "left_anti").repartition(tasks, "_h").sortWithinPartitions("_h")
    sorted_windows = small.mapInArrow(_sort_groups(length), "_row long, _lo int, _n int")
    dealt = stage(cut.join(large, "_h").mapInArrow(_deal(length), "_h long, _salt long, _windows binary, _row long, _lo int, _n int"), "dealt")
    met = dealt.filter("_windows IS NOT NULL").select("_h", "_salt", "_windows").repartition(tasks, "_h", "_salt").sortWithinPartitions("_h", "_salt")
    dealt_windows = dealt.filter("_row IS NOT NULL").select("_row", "_lo", "_n").unionAll(met.mapInArrow(_meet, "_row long, _lo int, _n int"))
    # a join of its own, so that Spark can split the one context that very many rows share
    many = candidates.join(stage(by_context.filter("_k > 1").select("_h", "_d"), "repeated-contexts"), ["_h", "_d"], "left_semi")
    many = stage(many.select("_row", "_lo", "_n"), "repeated-runs")
    told = found.filter("_h IS NULL").select("_row", "_lo", "_n")
    spans = told.unionAll(many).unionAll(sorted_windows).unionAll(dealt_windows)
    span = F.struct(F.col("_lo").alias("start"), (F.col("_lo") + F.col("_n") - 1 + length).alias("end"))
    return spans.groupBy("_row").agg(F.collect_list(span).alias("_spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for start, end in spans:
        parts.append(data[at:start])
        at = end
    return b"".join([*parts, data[at:]])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in unpacked(batches, 2 << 20):
        size, spans, kept = [], [], []
        for data, found in zip(texts, batch.column("_spans").to_pylist(), strict=True):
            runs_ = merged([(x["start"], x["end"]) for x in found or ()])
            size.append(len(data))
            spans.append([{"start": a, "end": b} for a, b in runs_])
            kept.append(kept_bytes(data, runs_) if runs_ else data)
        yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_id"), pa.array(size, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], names=["_row", "doc_id", "n_bytes", "spans", "kept"])


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, row_col: str | None = None) -> DataFrame:
    """One row per input row: _row, doc_id, n_bytes, spans (maximal removed byte ranges), kept (the remaining bytes)."""
    kind = df.schema[id_col].dataType.simpleString()
    packed = packed_rows(df, id_col, text_col, "suffix-texts", row_col)
    joined = packed.join(covered(packed, length), "_row", "left")
    return joined.mapInArrow(_cut, f"_row long, doc_id {kind}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The input with repeated strings cut out of its texts; rows and other columns stay, an ``n_chars`` column follows the
    text. A character that was cut in part goes whole. Only texts that lose something are changed."""
    row, found_col = free_name(df, "_cut_row"), free_name(df, "_spans")
    rows = stage(with_row(df, row), "suffix-input")
    spans = covered(packed_rows(rows, id_col, text_col, "suffix-texts", row), length).select(F.col("_row").alias(row), F.col("_spans").alias(found_col))
    names = df.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced([whole], text_col, 2 << 20):
                texts = []
                for text, found in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                    if found:
                        text = kept_bytes(text.encode(), merged([(x["start"], x["end"]) for x in found])).decode("utf-8", "ignore")
                    texts.append(text)
                columns = batch.columns[: len(names)]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = rows.join(spans, row, "left").select(*[F.col(f"`{c}`") for c in df.columns], found_col)
    out = joined.mapInArrow(run, df.schema)
    if text_col == "text" and "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(df.schema["n_chars"].dataType))
    return out


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
