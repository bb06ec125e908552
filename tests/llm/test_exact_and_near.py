import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, near_dedup


def key(i):
    return (i is None, i or 0)


def test_exact_groups(frame, corpus):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in corpus]
    groups = {}
    for (i, _), t in zip(corpus, norm, strict=True):
        groups.setdefault(t, []).append(i)
    expected = sorted((key(i), key(min(groups[t], key=key)), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(corpus, norm, strict=True))
    got = exact_dedup.exact_groups(frame).collect()
    assert sorted((key(r.doc_id), key(r.keep_id), r.group_size, r.text_sha256) for r in got) == expected
    assert Counter(r.text_sha256 for r in got if r.kept) == {hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups}
    assert all(r.kept <= (r.doc_id == r.keep_id) for r in got)


def test_exact_with_full_buckets_and_colliding_hashes(frame, monkeypatch):
    usual = sorted((key(r.doc_id), r.kept, r.group_size) for r in exact_dedup.exact_groups(frame, capacity=1).collect())
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    collided = sorted((key(r.doc_id), r.kept, r.group_size) for r in exact_dedup.exact_groups(frame, capacity=1).collect())
    assert collided == usual


def test_directory_covers_all_hashes(spark):
    hashes = [random.Random(1).getrandbits(64) - (1 << 63) for _ in range(500)] + [5] * 50
    buckets = exact_dedup.directory(spark.createDataFrame([(h,) for h in hashes], "_h long"), 4, 10)
    assert sum(2.0**-d for _, d, _ in buckets) == 1 and sum(n for _, _, n in buckets) == 550
    inside = lambda p, d: {h for h in hashes if (h & (1 << 64) - 1) >> (64 - d) == p}
    assert all(n <= 10 or len(inside(p, d)) == 1 for p, d, n in buckets)  # equal hashes alone overflow
    found = spark.createDataFrame([(h,) for h in hashes], "_h long").select("_h", exact_dedup._bucket_of(buckets).alias("b")).collect()
    for h, b in found:
        prefix, depth, _ = buckets[b]
        assert (h & (1 << 64) - 1) >> (64 - depth) == prefix


def test_many_buckets(spark):
    """More buckets than the first count has cells."""
    buckets = [(p, 14, 1) for p in range(1 << 14)]
    found = spark.range(1000).select(F.xxhash64("id").alias("_h")).select("_h", exact_dedup._bucket_of(buckets).alias("b")).collect()
    assert all((h & (1 << 64) - 1) >> 50 == b for h, b in found)


def test_exact_keeps_columns(frame):
    kept = exact_dedup.deduplicated(frame)
    assert kept.columns == frame.columns and kept.count() == exact_dedup.exact_groups(frame).filter("kept").count()


def brute_classes(corpus):
    texts = {}
    for i, t in corpus:
        texts.setdefault(tuple((t or "").split()), []).append(i)
    words = list(texts)
    shingles = [Counter(zip(*(w[j:] for j in range(5)), strict=False)) if len(w) >= 5 else Counter({w: 1} if w else {}) for w in words]
    parent = list(range(len(words)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(words)):
        for b in range(a):
            common = (shingles[a] & shingles[b]).total()
            if common and common >= 0.8 * (shingles[a].total() + shingles[b].total() - common):
                parent[root(a)] = root(b)
    classes = {}
    for k, w in enumerate(words):
        classes.setdefault(root(k), []).extend(texts[w])
    return classes


def test_near_classes(frame, corpus):
    expected = sorted((key(i), key(min(c, key=key)), len(c)) for c in brute_classes(corpus).values() for i in c)
    got = near_dedup.near_classes(frame).collect()
    assert sorted((key(r.doc_id), key(r.class_id), r.class_size) for r in got) == expected
    assert sum(r.kept for r in got) == len(brute_classes(corpus))
    one = near_dedup.one_of_each(frame)
    assert one.columns == frame.columns and one.count() == len(brute_classes(corpus))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_exact_where_it_counts():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 40))]
        b = [x for x in a if rng.random() > 0.08]
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), rng.randrange(6))
        b = b or [1]
        m = lcs(a, b)
        true = m / (len(a) + len(b) - m)
        got = near_dedup.similarity(np.array(a, np.uint32), np.array(b, np.uint32))
        assert (got >= 0.8) == (true >= 0.8) and (got < 0.8 or got == true)


def test_sketches_miss_few():
    rng = np.random.default_rng(3)
    hits = 0
    for _ in range(200):
        a = rng.integers(0, 1 << 63, 400, np.uint64)
        b = a.copy()
        b[rng.choice(400, 44, replace=False)] = rng.integers(0, 1 << 63, 44, np.uint64)  # Jaccard 0.8
        hits += bool((near_dedup.order_sketch(a) == near_dedup.order_sketch(b)).any())
    assert hits >= 197
    assert not (near_dedup.order_sketch(a) == near_dedup.order_sketch(a[::-1])).all()  # order counts


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 102), (101, 102)], "_a long, _b long")
    found = {r._row: r._component for r in near_dedup.components(edges).collect()}
    assert found == {k: 0 for k in range(41)} | {k: 100 for k in (100, 101, 102)}


def test_empty(empty):
    assert exact_dedup.exact_groups(empty).collect() == [] and near_dedup.near_classes(empty).collect() == []


@pytest.mark.parametrize("text", ["", "one", "a b c d", "a b c d e"])
def test_short_texts_have_one_kmer(text):
    assert len(near_dedup.kmers(text)[0]) == (1 if text else 0)


def test_no_pair_of_a_shared_bucket_is_left_out(spark):
    """A dense group whose members are mostly just below the threshold of each other, with partners that never lead."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(300)]

    def changed(words, many):
        words = list(words)
        for k in rng.sample(range(len(words)), many):
            words[k] = f"x{rng.getrandbits(60)}"
        return words

    group = [changed(base, 6) for _ in range(60)]
    texts = group + [changed(w, 6) for w in group]
    hashes = [near_dedup.kmers(" ".join(w))[0] for w in texts]
    keys = [set(near_dedup.order_sketch(h, 3).tolist()) for h in hashes]
    expected = [(a, b) for a in range(len(texts)) for b in range(a) if keys[a] & keys[b] and near_dedup.similarity(hashes[a], hashes[b]) >= 0.8]
    got = near_dedup.near_classes(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string"), bands=3).collect()
    of = {r.doc_id: r.class_id for r in got}
    assert len(expected) > 20 and [(a, b) for a, b in expected if of[a] != of[b]] == []
