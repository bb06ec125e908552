import random
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import media, quality, sharding


class Bitwriter:
    """A plain encoder for the parts of the format that the library's own writer leaves out."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]

    def code(self, lengths):
        """Writes a normal code by plain lengths; returns symbol -> bits."""
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) == 1 and used[0] < 256:
            self.put(0b001 | 0b100, 3)
            self.put(used[0], 8)
            return {used[0]: []}
        self.put(0, 1)
        self.put(19 - 4, 4)
        kinds = sorted(set(lengths))
        size = max(1, (len(kinds) - 1).bit_length())
        short = (1 << size) - len(kinds)  # the first ``short`` kinds have one bit less: a complete code
        width = {k: size - (j < short) for j, k in enumerate(kinds)} if len(kinds) > 1 else {kinds[0]: 1, (kinds[0] + 1) % 16: 1}
        for k in media.CODE_LENGTH_ORDER:
            self.put(width.get(k, 0), 3)
        self.put(0, 1)
        table = canonical([width.get(k, 0) for k in range(19)])
        for n in lengths:
            self.bits += table[n]
        return canonical(lengths)

    def data(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def canonical(lengths):
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[s] = [code >> (n - 1 - k) & 1 for k in range(n)]
        code, last = code + 1, n
    return out


def balanced(symbols, size):
    """A complete code of mixed lengths over some symbols of an alphabet."""
    symbols = sorted(symbols)
    if len(symbols) == 1:
        return [1 if s == symbols[0] else 0 for s in range(size)]
    deep = (len(symbols) - 1).bit_length()
    short = (1 << deep) - len(symbols)
    lengths = dict.fromkeys(symbols, deep) | dict.fromkeys(symbols[:short], deep - 1)
    return [lengths.get(s, 0) for s in range(size)]


def put_extra(out, value):
    """Prefix symbol and extra bits of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    n = (value - 1).bit_length() - 2
    high = (value - 1) >> n
    return 2 * n + (high & 1) + 2, (value - 1) & ((1 << n) - 1), n


def put_image(out, pixels, main=False, cache_bits=0, copies=False):
    """Pixels as literals, cache entries where they fit, and copies of what stands 1 before where asked."""
    tokens, cache, k = [], {}, 0
    index = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while k < len(pixels):
        run = 0
        while copies and k and k + run < len(pixels) and pixels[k + run] == pixels[k + run - 1] and run < 4000:
            run += 1
        if run >= 3:
            tokens.append(("copy", run))
            seen = pixels[k : k + run]
            k += run
        else:
            p = pixels[k]
            tokens.append(("cache", index(p)) if cache_bits and cache.get(index(p)) == p else ("pixel", p))
            seen = [p]
            k += 1
        if cache_bits:
            for p in seen:
                cache[index(p)] = p
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    # distance 1 is plane code 2 (one to the left): symbol 1
    greens = {p >> 8 & 255 for t, p in tokens if t == "pixel"} | {256 + put_extra(out, n)[0] for t, n in tokens if t == "copy"} | {280 + n for t, n in tokens if t == "cache"}
    reds, blues, alphas = ({p >> s & 255 for t, p in tokens if t == "pixel"} or {0} for s in (16, 0, 24))
    size = 280 + (1 << cache_bits if cache_bits else 0)
    if len(greens) == 1 and min(greens) > 255:
        greens.add(0)
    codes = [out.code(balanced(s, n)) for s, n in ((greens, size), (reds, 256), (blues, 256), (alphas, 256), ({1}, 40))]
    for kind, value in tokens:
        if kind == "pixel":
            for code, shift in zip(codes, (8, 16, 0, 24), strict=False):
                out.bits += code[value >> shift & 255]
        elif kind == "cache":
            out.bits += codes[0][280 + value]
        else:
            symbol, extra, n = put_extra(out, value)
            out.bits += codes[0][256 + symbol]
            out.put(extra, n)
            out.bits += codes[4][1]


def file_of(width, height, put):
    out = Bitwriter()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    put(out)
    body = out.data()
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def picture(rng, width, height, colours=None):
    pool = [rng.getrandbits(32) for _ in range(colours)] if colours else None
    out = []
    while len(out) < width * height:
        out += [rng.choice(pool) if pool else rng.getrandbits(32)] * rng.choice([1, 1, 2, 9])
    return out[: width * height]


@pytest.mark.parametrize("cache_bits", [0, 1, 6, 11])
@pytest.mark.parametrize("copies", [False, True])
def test_literals_copies_and_cache(cache_bits, copies):
    rng = random.Random(cache_bits)
    pixels = picture(rng, 13, 9, 20)
    data = file_of(13, 9, lambda out: (out.put(0, 1), put_image(out, pixels, True, cache_bits, copies)))
    assert media.WebpReader(data).pixels().ravel().tolist() == pixels


def channels(p):
    return [p >> s & 255 for s in (0, 8, 16, 24)]


def joined(c):
    return sum((x & 255) << s for x, s in zip(c, (0, 8, 16, 24), strict=True))


def test_subtract_green():
    pixels = picture(random.Random(1), 7, 5)
    stored = [joined([b - g, g, r - g, a]) for b, g, r, a in map(channels, pixels)]
    data = file_of(7, 5, lambda out: (out.put(1, 1), out.put(2, 2), out.put(0, 1), put_image(out, stored, True)))
    assert media.WebpReader(data).pixels().ravel().tolist() == pixels


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 11, 16, 60, 256])
def test_palette(colours):
    rng = random.Random(colours)
    palette = [rng.getrandbits(32) for _ in range(colours)]
    width, height = 11, 6
    picked = [rng.randrange(colours) for _ in range(width * height)]
    each = 8 if colours <= 2 else 4 if colours <= 4 else 2 if colours <= 16 else 1
    stored = []
    for y in range(height):
        for x in range(0, width, each):
            group = picked[y * width + x : y * width + min(width, x + each)]
            stored.append(sum(v << (k * 8 // each) for k, v in enumerate(group)) << 8 | 0xFF000000)
    deltas = [palette[0]] + [joined([a - b for a, b in zip(channels(q), channels(p), strict=True)]) for p, q in zip(palette, palette[1:], strict=False)]

    def put(out):
        out.put(1, 1)
        out.put(3, 2)
        out.put(colours - 1, 8)
        put_image(out, deltas)
        out.put(0, 1)
        put_image(out, stored, True)

    assert media.WebpReader(file_of(width, height, put)).pixels().ravel().tolist() == [palette[k] for k in picked]


def signed(x):
    return x - 256 if x > 127 else x


def test_cross_colour():
    rng = random.Random(5)
    width, height, bits = 9, 7, 2
    pixels = picture(rng, width, height)
    table = [rng.getrandbits(24) | 0xFF000000 for _ in range(3 * 2)]
    stored = []
    for k, p in enumerate(pixels):
        b, g, r, a = channels(p)
        to_red, to_blue, red_blue = map(signed, channels(table[(k // width >> bits) * 3 + (k % width >> bits)])[:3])
        stored.append(joined([b - (to_blue * signed(g) >> 5) - (red_blue * signed(r) >> 5), g, r - (to_red * signed(g) >> 5), a]))

    def put(out):
        out.put(1, 1)
        out.put(1, 2)
        out.put(bits - 2, 3)
        put_image(out, table)
        out.put(0, 1)
        put_image(out, stored, True)

    assert media.WebpReader(file_of(width, height, put)).pixels().ravel().tolist() == pixels


def guess(mode, left, top, corner, right):
    """The predictors, from the format's description."""
    half = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    clamp = lambda x: max(0, min(255, x))
    if mode == 11:
        estimate = [x + t - c for x, t, c in zip(left, top, corner, strict=True)]
        far = lambda q: sum(abs(e - v) for e, v in zip(estimate, q, strict=True))
        return left if far(left) < far(top) else top
    return {
        0: [0, 0, 0, 255], 1: left, 2: top, 3: right, 4: corner, 5: half(half(left, right), top), 6: half(left, corner), 7: half(left, top), 8: half(corner, top), 9: half(top, right),
        10: half(half(left, corner), half(top, right)), 12: [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)],
        13: [clamp(m + int((m - c) / 2)) for m, c in zip(half(left, top), corner, strict=True)],
    }[mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    rng = random.Random(mode)
    width, height = 6, 5
    pixels = [channels(p) for p in picture(rng, width, height)]
    stored = []
    for k, p in enumerate(pixels):
        y, x = divmod(k, width)
        at = lambda dy, dx: pixels[k + dy * width + dx]  # noqa: B023, E731
        if not y:
            g = at(0, -1) if x else [0, 0, 0, 255]
        elif not x:
            g = at(-1, 0)
        else:
            g = guess(mode, at(0, -1), at(-1, 0), at(-1, -1), at(-1, 1))  # the last column's top right is this row's first
        stored.append(joined([a - b for a, b in zip(p, g, strict=True)]))

    def put(out):
        out.put(1, 1)
        out.put(0, 2)
        out.put(0, 3)
        put_image(out, [mode << 8 | 0xFF000000] * 4)
        out.put(0, 1)
        put_image(out, stored, True)

    assert media.WebpReader(file_of(width, height, put)).pixels().ravel().tolist() == [joined(p) for p in pixels]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=1500))
def test_payloads_round_trip(data):
    stored = media.store(media.padded(data))
    assert media.restore(stored) == media.padded(data) and len(media.padded(data)) % 192 == 0 < len(media.padded(data))


def test_tall_payloads_and_broken_files(monkeypatch):
    monkeypatch.setattr(media, "TALLEST", 3)
    payload = media.padded(bytes(range(256)) * 9)
    assert media.restore(media.store(payload)) == payload
    for broken in (b"", b"RIFF1234WEBPVP8 ", media.store(payload)[:40]):
        with pytest.raises(media.WebpError):
            media.WebpReader(broken).pixels()


def transforms_of(data):
    """The kinds of transform in the file, and whether the picture has a colour cache."""
    reader = media.WebpReader(data)
    bits, kinds, width = reader.bits, [], reader.width
    while bits.read(1):
        kinds.append(["predictor", "cross", "green", "palette"][bits.read(2)])
        if kinds[-1] in ("predictor", "cross"):
            block = bits.read(3) + 2
            reader._image(media._shrunk(width, block), media._shrunk(reader.height, block))
        elif kinds[-1] == "palette":
            reader._image(bits.read(8) + 1, 1)
    return kinds, bool(bits.read(1))


def written_pictures():
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:70, :64]
    noise = rng.integers(0, 256, (70, 64))
    smooth = np.stack([2 * x + y, x + 2 * y, x + y + 40], 2) + rng.integers(0, 2, (70, 64, 3))
    signed_noise = noise.astype(np.uint8).view(np.int8).astype(int)
    crossed = np.stack([signed_noise * 3 // 4, noise, signed_noise * -1 // 4], 2) + rng.integers(0, 3, (70, 64, 3))
    greyish = np.stack([noise, noise, noise], 2) + rng.integers(0, 2, (70, 64, 3))
    few = rng.integers(0, 256, (13, 3))[rng.integers(0, 13, (70, 64))]
    words = rng.integers(0, 256, (700, 3))[rng.zipf(1.3, (70, 64)) % 700]
    return {"predictor": smooth, "cross": crossed, "green": greyish, "palette": few, "cache": words, "none": rng.integers(97, 123, (70, 64, 3))}


@pytest.mark.parametrize("kind", ["predictor", "cross", "green", "palette", "cache", "none"])
def test_the_writer_chooses_and_both_readers_agree(kind, monkeypatch):
    samples = (written_pictures()[kind] & 255).astype(np.uint8)
    stored = media.write_webp(samples)
    kinds, cached = transforms_of(stored)
    assert kind in kinds if kind not in ("cache", "none") else cached == (kind == "cache") and not kinds
    for few, window in ((0, 1 << 14), (0, 64), (1 << 30, 64)):  # side by side, over many windows, and symbol by symbol
        monkeypatch.setattr(media, "FEW_PIXELS", few)
        monkeypatch.setattr(media, "WINDOW", window)
        assert (media._channels(media.WebpReader(stored).pixels())[..., 2::-1] == samples).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([b"the ", b"cat", b"\n", b"sat on", b"  ", "é€".encode(), b"abc" * 40, b"\x00\xff"]), max_size=400))
def test_both_readers_agree_on_texts(pieces):
    payload = media.padded(b"".join(pieces))
    stored = media.store(payload)
    few, media.FEW_PIXELS = media.FEW_PIXELS, 1 << 30
    try:
        slow = media.restore(stored)
    finally:
        media.FEW_PIXELS = few
    assert slow == media.restore(stored) == payload


def test_a_cache_entry_that_was_never_written():
    def put(out):
        out.put(0, 1)
        out.put(1, 1)
        out.put(3, 4)
        out.put(0, 1)
        greens = out.code(balanced({7, 280, 285, 286}, 288))
        red, blue, alpha = (out.code(balanced({k}, 256)) for k in (1, 2, 255))
        out.code(balanced({0}, 40))
        for green in [285, 7, 286, 280] * 25:
            out.bits += greens[green]

    data = file_of(10, 10, put)
    fast = media.WebpReader(data).pixels()
    written = [0] * 8
    expected = []
    for green in [285, 7, 286, 280] * 25:
        expected.append(written[green - 280] if green > 255 else 0xFF010702)
        written[(0x1E35A7BD * expected[-1] & 0xFFFFFFFF) >> 29] = expected[-1]
    assert fast.ravel().tolist() == expected


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1 << 40), min_size=2, max_size=40), st.integers(6, 15))
def test_code_lengths(counts, longest):
    lengths = media.code_lengths(np.array(counts), longest).tolist()
    assert sum(2.0**-n for n in lengths) == 1 and max(lengths) <= longest
    heap, cost = sorted(counts), 0
    while len(heap) > 1:
        both = heap[0] + heap[1]
        cost += both
        heap = sorted([*heap[2:], both])
    free = media.code_lengths(np.array(counts), 60).tolist()
    assert sum(n * c for n, c in zip(free, counts, strict=True)) == cost


def test_payloads_beyond_the_tallest_picture_are_one_file():
    payload = media.padded(random.Random(4).randbytes(50_000) * 79)
    stored = media.store(payload)
    assert struct.unpack_from("<I", stored, 4)[0] + 8 == len(stored)
    reader = media.WebpReader(stored)
    assert (reader.width, reader.alpha) == (128, 1) and media.restore(stored) == payload


def test_features_by_hand():
    data = random.Random(8).randbytes(192 * 11)
    samples = np.frombuffer(data, np.uint8).reshape(-1, 64, 3)
    told = media.features(samples).split(",")
    of = [[data[k] for k in range(c, len(data), 3)] for c in range(3)]
    means = [sum(x) / len(x) for x in of]
    spreads = [(sum((v - m) ** 2 for v in x) / len(x)) ** 0.5 for x, m in zip(of, means, strict=True)]
    assert [float(x) for x in told[:6]] == pytest.approx([*means, *spreads], abs=1e-3)
    cells = []
    for r in range(8):
        first, last = r * 11 // 8, (r + 1) * 11 // 8
        for c in range(8):
            cells.append(sum(sum(data[192 * y + 24 * c : 192 * y + 24 * c + 24]) for y in range(first, last)) / (last - first))
    flags = "".join("1" if x > sum(cells) / 64 else "0" for x in cells)
    assert told[6] == f"{int(flags, 2):016x}"


def test_media_columns(frame, corpus):
    rows = media.decode_media(media.encode_media(frame)).collect()
    assert Counter((r.doc_id, r.n_bytes, bytes(r.payload)) for r in rows) == Counter((i, len((t or "").encode()), media.padded((t or "").encode())) for i, t in corpus)
    assert len({(bytes(r.payload), r.feature, bytes(r.media)) for r in rows}) == len({bytes(r.payload) for r in rows})


def test_labellers_and_scorer_agree_with_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality.classified(docs).join(labels, "doc_id").select("quality", "kept").collect()
    assert not [r for r in found if r.quality == 1 and not r.kept]  # no good document goes
    bad = [r.kept for r in found if r.quality == 0]
    assert sum(bad) <= 0.1 * len(bad)


def test_quality_of_odd_tables(frame, empty):
    assert frame.count() == quality.classified(frame).count()
    assert quality.accepted(frame).columns == frame.columns
    assert quality.classified(empty).collect() == []
    assert quality.classified(frame.filter("text IS NULL OR text = ''")).filter("NOT kept").count() == 0


def test_expectation_maximisation_finds_the_labellers():
    rng = np.random.default_rng(2)
    truth = rng.random(20000) < 0.15  # bad
    votes = np.where(rng.random((20000, 6)) < np.where(truth[:, None], 0.5, 0.02), quality.BAD, quality.GOOD)
    votes[rng.random((20000, 6)) < 0.2] = quality.NOTHING
    codes = (votes * 3 ** np.arange(6)).sum(1)
    posterior = quality.fit_labellers(Counter(codes.tolist()))
    guess_bad = np.array([posterior[c] < 0.5 for c in codes])
    assert (guess_bad == truth).mean() > 0.95


def test_shards(frame, corpus):
    rows, slot_map = sharding.shard_rows(frame, 8)
    got = rows.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in corpus)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert len(slot_map.shard_of) == sharding.SLOTS


def test_shards_follow_no_layout(frame, spark):
    """Slots come from what records hold: other partitions, other order, same shards; equal records are spread."""
    many = frame.select("doc_id", "text").unionAll(spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same").alias("text")))
    told = [Counter((r.doc_id, r.text_crc32, r.virtual_slot, r.shard) for r in sharding.shard_rows(x, 8)[0].collect()) for x in (many.repartition(7), many.coalesce(1).orderBy("text"))]
    assert told[0] == told[1] and len({k[2] for k in told[0] if k[0] == 5}) > 2000
    size = Counter()
    for (_, _, _, shard), n in told[0].items():
        size[shard] += n
    assert len(size) == 8


def test_short_texts_and_one_class(spark):
    assert quality.judged("plain", {0: 0.9, 2: 0.1}, None, 0.5) == (0.9, 0.9, True)
    assert quality.judged("%% ## $$ @@", {0: 0.9, 2: 0.1}, None, 0.5)[2] is False
    assert quality.judged("", {}, None, 0.5) == (1.0, 1.0, True)


def test_rebalancing_moves_little(spark, tmp_path):
    rng = random.Random(1)
    sizes = [rng.randrange(1000) for _ in range(4096)]
    one = sharding.balanced_map(sizes, 10)
    loads = lambda m: [sum(b for b, s in zip(sizes, m.shard_of, strict=True) if s == k) for k in range(m.shards)]
    assert max(loads(one)) - min(loads(one)) <= 1000
    two = sharding.rebalanced_map(one, sizes, 11)
    moved = [(a, b) for a, b in zip(one.shard_of, two.shard_of, strict=True) if a != b]
    assert all(b == 10 for _, b in moved) and max(loads(two)) - min(loads(two)) <= 2000
    less = sharding.rebalanced_map(two, sizes, 9)
    assert max(less.shard_of) == 8 and less.version == 3 and max(loads(less)) - min(loads(less)) <= 2000
    one.save(spark, str(tmp_path / "map"))
    two.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == two and sharding.SlotMap.load(spark, str(tmp_path / "map"), 1) == one


def test_empty(empty):
    assert media.encode_media(empty).collect() == [] and sharding.shard_rows(empty, 4)[0].collect() == []


def many_payloads():
    """Payloads of all kinds of choices: texts, noise, runs, few colours, smooth, grey and related channels, recurring colours."""
    rng = random.Random(11)
    words, pool = ["the ", "cat", "\n", "sat on", "  ", "é€", "abc" * 40, "\0\0\0"], [rng.randbytes(3) for _ in range(700)]
    out = []
    for k in range(30):
        n = rng.choice([0, 1, 100, 700, 3000])
        noise = rng.randbytes(n)
        out += [
            "".join(rng.choices(words, k=n // 3)).encode(), "".join(rng.choices(words[:4], k=n // 9)).encode(), noise, bytes(n), b"ab" * n,
            bytes((i * 3 + rng.randrange(2)) & 255 for i in range(n)), b"".join(bytes([g, g, g ^ k & 1]) for g in noise),
            b"".join(bytes([(g * 3 // 4) & 255, g & 255, (-g // 4) & 255]) for g in (x - 256 if x > 127 else x for x in noise)),
            b"".join(pool[int(rng.paretovariate(0.8)) % 700] for _ in noise), bytes(rng.choices(b"abc", k=n)),
        ]
    return [media.padded(x) for x in out]


@pytest.mark.parametrize(("few", "written", "read"), [(32, 1 << 18, 1 << 21), (1, 1 << 12, 1 << 13), (1, 1, 1), (1 << 30, 1 << 18, 1 << 21)])
def test_pictures_together_are_those_written_and_read_alone(few, written, read, monkeypatch):
    payloads = many_payloads()
    alone = [media.store(x) for x in payloads]
    assert {kind for x in alone for kind in (*transforms_of(x)[0], transforms_of(x)[1])} == {"predictor", "cross", "green", "palette", True, False}
    for name, value in (("FEW_STREAMS", few), ("WRITTEN_TOGETHER", written), ("TOGETHER_ALL", read)):
        monkeypatch.setattr(media, name, value)
    assert media.store_all(payloads) == alone and media.restore_all(alone) == payloads
    assert media.store_all(payloads[::-1]) == alone[::-1] and media.store_all([]) == media.restore_all([]) == []


def test_many_pictures_take_less_time_together():
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(3000)]
    payloads = [media.padded(" ".join(words[int(rng.paretovariate(0.7)) % 3000] for _ in range(300)).encode()) for _ in range(400)]
    stored = [media.store(x) for x in payloads]

    def seconds(run):
        times = []
        for _ in range(2):
            begin = time.process_time()
            run()
            times.append(time.process_time() - begin)
        return min(times)

    assert seconds(lambda: media.store_all(payloads)) < 0.8 * seconds(lambda: [media.store(x) for x in payloads])
    assert seconds(lambda: media.restore_all(stored)) < 0.8 * seconds(lambda: [media.restore(x) for x in stored])


def test_together_reads_other_writers_files_and_refuses_broken_ones(monkeypatch):
    monkeypatch.setattr(media, "FEW_STREAMS", 1)
    rng, files, shown = random.Random(7), [], []
    for k in range(60):
        cache_bits, width, height = k % 12, rng.randint(1, 20), rng.randint(1, 9)
        pixels = picture(rng, width, height, 20 if k % 3 else None)
        files.append(file_of(width, height, lambda out: (out.put(0, 1), put_image(out, pixels, True, cache_bits, k % 2 > 0))))  # noqa: B023
        shown.append(b"".join(bytes([p >> 16 & 255, p >> 8 & 255, p & 255]) for p in pixels if p >> 24))
    assert media.restore_all(files) == shown == [media.restore(x) for x in files]
    whole = media.store(media.padded(bytes(range(256)) * 9))
    for cut in (40, 200, len(whole) // 2, len(whole) - 40):
        body = whole[20:cut] + b"\0" * (cut & 1)
        broken = b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body
        with pytest.raises(media.WebpError):
            media.restore_all([*files, broken])


def test_streams_with_longer_codes_are_read_alone(monkeypatch):
    payloads = many_payloads()[:60]
    stored = [media.store(x) for x in payloads]
    for name, value in (("FEW_STREAMS", 1), ("LONGEST", 6)):
        monkeypatch.setattr(media, name, value)
    assert media.restore_all(stored) == payloads
