"""Near-duplicates by Order MinHash, verified by banded alignment.

1. A text is the sequence of its words (white space separates them); its k-mers are runs of ``K`` words, labelled with
   their occurrence number. For each of ``BANDS`` hash functions the ``SKETCH`` least labelled k-mers are taken and put
   back into text order; the sequence is the band's key. Texts close in edit distance share keys: with a similarity s
   a band agrees with probability of about s^SKETCH, so that 0.8 is missed with 0.0007.
2. Equal word sequences are folded first; only one representative of each goes on, so copies cost nothing.
3. Within a bucket of one key every member is first compared with the bucket's leaders, so that most classes form from
   few candidates. Leaders are the text with most copies and then the least id, from which others most often
   derive, and the least of a hash that differs by band; in a second round the member with most links so far and, for
   members without any link, two more drawn by hash in every bucket. Then the buckets that still hold several classes
   are settled exactly: of their texts all pairs in different classes meet that an exact prefix filter leaves (rarest
   k-mers first, with the bound that places in that order set). The most promising pair of each two classes is verified
   first, then every pair whose classes are still apart.
4. A candidate pair is verified by aligning the two k-mer sequences: with m aligned k-mers of a and b in all the
   similarity is m / (a + b - m), which is the Jaccard similarity where order is kept. The alignment is the longest
   common subsequence, found bit-parallel in the band outside which no alignment reaches the threshold.
5. Classes are the connected components of verified pairs, found by repeated joins. Pairs within one class need no
   further verification, so ``n_links_found`` counts the links that were tried, not all that there are.

Defined cases: a null text is empty; texts without words are copies of each other; texts of fewer than ``K`` words have
one k-mer, the whole text; the class id is the least id in it, a null id counting as larger than any; rows with equal
ids are separate members; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, free_name, packed_rows, sliced, stage, unpacked, with_row

K, SIMILARITY = 5, 0.8
BANDS, SKETCH = 24, 6
#: Words whose hashes a worker remembers; beyond it the memory starts anew.
WORDS_KEPT = 120_000
#: Values hashed at a time for one text.
MATRIX = 1 << 20
_words: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def kmers(text: str, k: int = K) -> tuple[np.ndarray, int]:
    """Hashes of the text's k-mers in order, and a hash of its word sequence."""
    words = text.split()
    if len(_words) > WORDS_KEPT:
        _words.clear()
    try:
        codes = list(map(_words.__getitem__, words))
    except KeyError:
        for word in set(words).difference(_words):
            _words[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        codes = list(map(_words.__getitem__, words))
    hashed = np.array(codes, np.uint64)
    whole = xxhash.xxh3_64_intdigest(hashed.tobytes())
    if not len(hashed):
        return hashed, whole
    out = np.zeros(max(1, len(hashed) - k + 1), np.uint64)
    for j in range(min(k, len(hashed))):
        out = _mix(out + hashed[j : j + len(out)])
    return out, whole


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Occurrence numbers hashed in: the second time that a k-mer occurs it is another one."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    if new.all():
        return hashes
    first = np.flatnonzero(new)
    nth = np.arange(len(hashes)) - np.repeat(first, np.diff(np.append(first, len(hashes))))
    out = np.empty_like(hashes)
    out[order] = np.where(nth > 0, _mix(ordered + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), ordered)
    return out


@lru_cache(4)
def _seeds(bands: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 64, (bands, 1), np.uint64)


def order_sketch(hashes: np.ndarray, bands: int = BANDS, sketch: int = SKETCH) -> np.ndarray:
    """One key for each band: the least labelled k-mers in text order."""
    of = labelled(hashes)
    if len(of) > sketch:
        some = max(1, MATRIX // len(of))  # bands at a time, so that long texts need no large matrix
        parts = [np.argpartition(_mix(of[None, :] ^ _seeds(bands)[b : b + some]), sketch - 1, axis=1)[:, :sketch] for b in range(0, bands, some)]
        least = np.sort(np.concatenate(parts), axis=1)
    else:
        least = np.broadcast_to(np.arange(len(of)), (bands, len(of)))
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.T:
        key = _mix(key + hashes[column])
    return key.view(np.int64)


def _sketches(k: int, bands: int, sketch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in unpacked(batches, 2 << 20):
            whole, second, count, keys = [], [], [], []
            for text in texts:
                hashes, one = kmers(text.decode(), k)
                whole.append(one)
                second.append(int(_mix(np.bitwise_xor.reduce(_mix(hashes + np.arange(len(hashes), dtype=np.uint64)))[None])[0]) if len(hashes) else 0)
                count.append(len(hashes))
                keys.append(order_sketch(hashes, bands, sketch) if len(hashes) else np.empty(0, np.int64))
            bounds = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("_id"), pa.array(np.array(whole, np.uint64).view(np.int64)), pa.array(np.array(second, np.uint64).view(np.int64)), pa.array(count, pa.int32()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))],
                names=["_row", "_id", "_k1", "_k2", "_n", "_bands"],
            )

    return run


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> int:
    """Length of the longest common subsequence inside the band outside which ``least`` can't be reached; exact if it is reached."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    differ = np.flatnonzero(a != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[head:][::-1] != b[head:][::-1][: n - head])
    tail = int(differ[0]) if len(differ) else n - head
    a, b = a[head : n - tail].tolist(), b[head : len(b) - tail].tolist()
    if not a or not b:
        return head + tail
    # at the threshold a + b - 2m single steps leave the diagonal, where m / (a + b - m) = least
    total = len(a) + len(b) + 2 * (head + tail)
    band = int(total * (1 - least) / (1 + least)) + 1
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    window, state = (1 << 2 * band + 1) - 1, full
    for i, x in enumerate(a):
        match = where.get(x, 0)
        if match:
            match &= window << i - band if i >= band else window >> band - i
            carried = state & match
            state = (state + carried | state & ~match) & full
    return head + tail + len(b) - state.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """m / (a + b - m) for m aligned k-mers; where it is below ``least``, a lower bound."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    total = len(a) + len(b)
    need = least * total / (1 + least)
    if min(len(a), len(b)) < need - 1e-9:
        return 0.0
    common = np.intersect1d(a, b)
    if len(common) < len(a) and len(common) < len(b):
        first, second = Counter(a.tolist()), Counter(b.tolist())
        if sum(min(first[x], second[x]) for x in common.tolist()) < need - 1e-9:
            return 0.0
    m = aligned(a, b, least)
    return m / (total - m)


def _kmers_of(k: int):
    """k-mer hashes of compressed texts, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in unpacked(batches, 2 << 20):
            found = [kmers(x.decode(), k)[0].astype(np.uint32).tobytes() for x in texts]
            yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(found, pa.binary())], names=["_row", "_kmers"])

    return run


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                pairs = zip(part.column("_ka").to_pylist(), part.column("_kb").to_pylist(), strict=True)
                good = pa.array([similarity(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), least) >= least for a, b in pairs], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("_a"), part.column("_b"), good], names=["_a", "_b", "_good"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each k-mer of a text, numbered where it repeats: equal tokens are what alignment could pair."""
    for batch in batches:
        for part in sliced([batch], "_kmers", 1 << 20):
            found = []
            for x in part.column("_kmers").to_pylist():
                ordered = np.sort(np.frombuffer(x, np.uint32))
                first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
                nth = np.arange(len(ordered)) - np.repeat(first, np.diff(np.append(first, len(ordered))))
                found.append(ordered.astype(np.int64) | nth << 32)
            lengths = [len(x) for x in found]
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            columns = [pa.array(np.repeat(part.column(c).to_numpy(zero_copy_only=False), lengths), t) for c, t in (("_row", pa.int64()), ("_n", pa.int32()), ("_c", pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(flat)], names=["_row", "_n", "_c", "_token"])


def unsettled_pairs(texts: DataFrame, least: float) -> DataFrame:
    """_a, _b, _ca, _cb, _p: every pair of ``texts`` (_row, _n, _c, _kmers) of different classes _c that can reach ``least``.

    With a and b k-mers, m of them aligned, m >= least * max(a, b); so in any one order of all k-mers the first common
    one of such a pair stands among the first a - least * a of a, and no more than the rest from it on can be aligned.
    The order is by frequency, and k-mers of one text alone are counted but never joined."""
    tokens = texts.mapInArrow(_tokens, "_row long, _n int, _c long, _token long")
    common = stage(tokens.groupBy("_token").agg(F.count(F.lit(1)).alias("_df")).filter("_df > 1"), "common-kmers")
    ranked = tokens.join(common, "_token").groupBy("_row", "_n", "_c").agg(F.sort_array(F.collect_list(F.struct("_df", "_token"))).alias("_s"))
    ranked = ranked.select("_row", "_n", "_c", F.size("_s").alias("_m"), F.posexplode("_s").alias("_at", "_t"))
    placed = ranked.select("_row", "_n", "_c", F.col("_t._token").alias("_token"), (F.col("_n") - F.col("_m") + F.col("_at")).alias("_p"))
    heads = stage(placed.filter(F.col("_p") <= F.col("_n") - F.ceil(F.lit(least) * F.col("_n") - 1e-6)).withColumn("_left", F.col("_n") - F.col("_p")), "prefixes")
    # classes meet before texts do, so that the texts of one class never meet each other
    blocks = heads.groupBy("_token", "_c").agg(F.max("_left").alias("_left"), F.min("_n").alias("_n"))
    named = lambda df, x: df.select("_token", *[F.col(c).alias(c + x) for c in df.columns if c != "_token"])
    fits = F.least("_lefta", "_leftb") >= F.lit(least / (1 + least)) * (F.col("_na") + F.col("_nb")) - 1e-6
    bounds = [F.col(c).alias(c + "m") for c in ("_lefta", "_na", "_leftb", "_nb")]
    met = stage(named(blocks, "a").join(named(blocks, "b"), "_token").filter((F.col("_ca") < F.col("_cb")) & fits).select("_token", "_ca", "_cb", *bounds), "class-blocks")
    # of a class only the texts that could fit the best of the other class go on
    could = lambda x, y: F.least("_left" + x, f"_left{y}m") >= F.lit(least / (1 + least)) * (F.col("_n" + x) + F.col(f"_n{y}m")) - 1e-6
    one = met.join(named(heads, "a"), ["_token", "_ca"]).filter(could("a", "b"))
    found = one.join(named(heads, "b"), ["_token", "_cb"]).filter(fits)
    return found.groupBy(F.col("_rowa").alias("_a"), F.col("_rowb").alias("_b"), "_ca", "_cb").agg(F.min(F.col("_pa") + F.col("_pb")).alias("_p"))


def components(edges: DataFrame) -> DataFrame:
    """_row, _component: for every row in ``edges`` (_a, _b) the least row that it is linked to, by label passing and
    pointer jumping over joins; a few rounds even for long chains."""
    both = stage(edges.select("_a", "_b").unionAll(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct(), "links")
    labels = stage(both.groupBy("_a").agg(F.least(F.col("_a"), F.min("_b")).alias("_c")), "labels")
    while True:
        passed = both.join(labels.select(F.col("_a").alias("_b"), F.col("_c").alias("_d")), "_b").groupBy("_a").agg(F.min("_d").alias("_d"))
        lower = labels.join(passed, "_a").select("_a", F.col("_c").alias("_old"), F.least("_c", "_d").alias("_c"))
        jump = labels.select(F.col("_a").alias("_c"), F.col("_c").alias("_e"))
        new = stage(lower.join(jump, "_c").select("_a", "_old", F.least("_c", "_e").alias("_c")), "labels")
        labels = new.select("_a", "_c")
        if new.filter("_old != _c").limit(1).count() == 0:
            return labels.select(F.col("_a").alias("_row"), F.col("_c").alias("_component"))


def relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` after further links: only the links between classes are passed along, with each class as one row."""
    named = lambda x, y: labels.select(F.col("_row").alias(x), F.col("_component").alias(y))
    between = edges.join(named("_a", "_x"), "_a", "left").join(named("_b", "_y"), "_b", "left")
    between = between.select(F.coalesce("_x", "_a").alias("_a"), F.coalesce("_y", "_b").alias("_b")).filter("_a != _b")
    found = components(stage(between, "class-links"))
    up = labels.join(found.select(F.col("_row").alias("_component"), F.col("_component").alias("_up")), "_component", "left")
    new = found.join(labels.select("_row"), "_row", "left_anti").select("_row", "_component")
    return stage(up.select("_row", F.coalesce("_up", "_component").alias("_component")).unionAll(new), "labels")


def _pairs(x: str, y: str) -> list:
    return [F.least(x, y).alias("_a"), F.greatest(x, y).alias("_b")]


def _oriented(x: str, y: str):
    return F.struct(*_pairs(x, y)).alias("_o")


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, least: float = SIMILARITY, bands: int = BANDS, sketch: int = SKETCH, row_col: str | None = None) -> DataFrame:
    """One row per input row: _row, doc_id, class_id, class_size, n_links_found (links of its text that were tried and verified), kept (one row of each class)."""
    kind = df.schema[id_col].dataType.simpleString()
    packed = packed_rows(df, id_col, text_col, "near-texts", row_col)
    # joins of what grows with the corpus are dealt out by key at every size, so that small inputs show what large ones take
    sketches = stage(packed.mapInArrow(_sketches(k, bands, sketch), f"_row long, _id {kind}, _k1 long, _k2 long, _n int, _bands array<long>"), "sketches")
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_row").alias("r"))
    folded = stage(sketches.groupBy("_k1", "_k2", "_n").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_copies")), "folded")
    reps = folded.select(F.col("_first.r").alias("_row"), "_copies")
    keys = sketches.select("_row", "_id", "_n", "_bands").join(reps.hint("merge"), "_row").select("_row", "_id", "_n", "_copies", F.explode("_bands").alias("_key"))
    members = stage(keys, "members")
    spread = lambda row: F.xxhash64(row, F.pmod("_key", F.lit(4)))  # noqa: E731  leaders differ by band
    leaders = members.groupBy("_key").agg(F.count(F.lit(1)).alias("_k"), F.min(F.struct((-F.col("_copies")).alias("c"), F.col("_id").isNull().alias("u"), "_id", "_row", "_n")).alias("_l1"), F.min(F.struct(spread("_row").alias("h"), "_row", "_n")).alias("_l2")).filter("_k > 1")
    leaders = stage(leaders.select("_key", F.array(F.struct("_l1._row", "_l1._n"), F.struct("_l2._row", "_l2._n")).alias("_leaders")), "leaders")
    bound = F.least("_n", "_ln") >= F.lit(least) * F.greatest("_n", "_ln")  # what sizes alone rule out

    shared = stage(members.join(leaders.select("_key").hint("merge"), "_key", "left_semi"), "shared-members")

    def candidates(of: DataFrame, among: DataFrame) -> DataFrame:
        met = among.join(of, "_key").select("_row", "_n", F.array_distinct("_leaders").alias("_leaders"))
        met = met.select("_row", "_n", F.explode("_leaders").alias("_l")).select("_row", "_n", F.col("_l._row").alias("_lr"), F.col("_l._n").alias("_ln"))
        return met.filter((F.col("_row") != F.col("_lr")) & bound).select(*_pairs("_row", "_lr")).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        named = lambda name, value: hashes.select(F.col("_row").alias(name), F.col("_kmers").alias(value))
        return stage(pairs.hint("merge").join(named("_a", "_ka"), "_a").hint("merge").join(named("_b", "_kb"), "_b").mapInArrow(_verify(least), "_a long, _b long, _good boolean"), "verified")

    first = stage(candidates(leaders, shared), "pairs")
    bucketed = shared.select("_row").distinct()
    hashes = stage(packed.join(bucketed.hint("merge"), "_row", "left_semi").mapInArrow(_kmers_of(k), "_row long, _kmers binary"), "kmers")
    tried = verified(first)
    good = tried.filter("_good")
    degrees = good.select(F.explode(F.array("_a", "_b")).alias("_row")).groupBy("_row").agg(F.count(F.lit(1)).alias("_degree"))
    degrees = stage(degrees, "degrees")
    hubs = shared.join(degrees, "_row").groupBy("_key").agg(F.max(F.struct("_degree", "_row", "_n")).alias("_l")).select("_key", F.array(F.struct("_l._row", "_l._n")).alias("_leaders"))
    loose = shared.join(degrees, "_row", "left_anti")
    drawn = F.struct(F.xxhash64("_row", "_key").alias("h"), "_row", "_n")
    others = shared.groupBy("_key").agg(F.min(drawn).alias("_l3"), F.max(drawn).alias("_l4")).select("_key", F.array(F.struct("_l3._row", "_l3._n"), F.struct("_l4._row", "_l4._n")).alias("_leaders"))
    more = candidates(hubs, shared).unionAll(candidates(others, loose)).distinct()
    second = stage(more.join(tried.select("_a", "_b"), ["_a", "_b"], "left_anti"), "pairs")
    good = good.unionAll(verified(second).filter("_good")).select("_a", "_b")
    labels = components(good)

    classed = stage(shared.join(labels, "_row", "left").select("_key", "_row", "_n", F.coalesce("_component", "_row").alias("_c")), "classed-members")
    split = classed.groupBy("_key").agg(F.min("_c").alias("_c0"), F.max("_c").alias("_c1")).filter("_c0 != _c1").select("_key")
    unsettled = stage(classed.join(split, "_key", "left_semi").select("_row", "_n", "_c").distinct(), "unsettled")
    rest = stage(unsettled_pairs(unsettled.join(hashes, "_row"), least), "unsettled-pairs")

    best = rest.groupBy("_ca", "_cb").agg(F.min(F.struct("_p", "_a", "_b")).alias("_m")).select(_oriented("_m._a", "_m._b")).select("_o.*")
    best = stage(best.join(tried.select("_a", "_b").unionAll(second.select("_a", "_b")), ["_a", "_b"], "left_anti"), "best-pairs")
    linked = verified(best).filter("_good").select("_a", "_b")
    good = good.unionAll(linked)
    labels = relabelled(labels, linked)
    now = lambda name, value: labels.select(F.col("_row").alias(name), F.col("_component").alias(value))
    apart = rest.select(_oriented("_a", "_b")).select("_o.*").join(now("_a", "_x"), "_a", "left").join(now("_b", "_y"), "_b", "left")
    apart = apart.filter(F.coalesce("_x", "_a") != F.coalesce("_y", "_b")).select("_a", "_b")
    for done in (tried, second, best):
        apart = apart.join(done.select("_a", "_b"), ["_a", "_b"], "left_anti")
    last = verified(stage(apart, "last-pairs")).filter("_good").select("_a", "_b")
    if last.limit(1).count():
        good = good.unionAll(last)
        labels = relabelled(labels, last)
    links = good.select(F.explode(F.array("_a", "_b")).alias("_row")).groupBy("_row").agg(F.count(F.lit(1)).alias("n_links_found"))
    of_text = folded.withColumn("_row", F.col("_first.r")).join(labels, "_row", "left").join(links, "_row", "left")
    of_text = stage(of_text.select("_k1", "_k2", "_n", "_first", "_copies", F.coalesce("_component", "_row").alias("_component"), F.coalesce("n_links_found", F.lit(0)).alias("n_links_found")), "classes")
    classes = stage(of_text.groupBy("_component").agg(F.min("_first").alias("_keep"), F.sum("_copies").alias("class_size")), "class-sizes")
    by_text = stage(of_text.join(classes, "_component").select("_k1", "_k2", "_n", "_keep", "class_size", "n_links_found"), "by-text")
    out = sketches.select("_row", "_id", "_k1", "_k2", "_n").join(by_text.hint("merge"), ["_k1", "_k2", "_n"])
    return out.select("_row", F.col("_id").alias("doc_id"), F.col("_keep.id").alias("class_id"), "class_size", "n_links_found", (F.col("_row") == F.col("_keep.r")).alias("kept"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows that stay, one of each class, with all their columns."""
    row = free_name(df, "_near_row")
    rows = stage(with_row(df, row), "near-input")
    kept = near_classes(rows, id_col, text_col, row_col=row).filter("kept").select(F.col("_row").alias(row))
    return rows.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir)).drop("_row")
