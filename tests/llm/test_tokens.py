import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing, token_counts


@pytest.fixture(scope="module")
def ours():
    return bpe.byte_bpe(str(public_tokenizers.path(bpe.BYTE_BPE_MULTI)))


@pytest.fixture(scope="module")
def library(ours):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


TRICKY = ["", "'s", "''s", "'s's", " 's", "\n's", "a'rest", "don't", "'ll'", "  a", "a  ", "\n\n", " \n x", "\t\t1", "!!'re", " !x", "1'st", "x　 y", "é́", "'", "'r", "'l", "a" * 300, " " * 50 + "b"]


def test_encoding_equals_the_library(ours, library):
    assert [x.tolist() for x in ours.encode(TRICKY)] == [library.encode_ordinary(x) for x in TRICKY]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abst'' \n\tlrevmd1!é中"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_random_texts(ours, library, texts):
    got = ours.encode(texts)
    assert [x.tolist() for x in got] == [library.encode_ordinary(x) for x in texts]
    for ids, text in zip(got, texts, strict=True):
        assert ours.decode(ids.tolist()) == text.encode()
        ends = ours.offsets(ids)
        for k in range(len(ids)):
            assert ours.tokens[ids[k]] == text.encode()[(ends[k - 1] if k else 0) : ends[k]]


def test_scan_is_associative_over_block_bounds():
    rng = random.Random(2)
    symbol = np.array([rng.choice([0, 1, 2, 5, 6, 7, 8]) for _ in range(5 * bpe.BLOCK + 17)], np.uint8)
    step, begin = bpe._automaton()
    state, expected = bpe.FRESH, []
    for s in symbol:
        expected.append(bool(begin[state, s]))
        state = step[state, s]
    assert bpe.begins(symbol).tolist() == expected


def test_bpe_query_shape(frame, corpus, library):
    got = bpe.decode(bpe.encode(frame)).select("doc_id", "ids", F.sha2("decoded", 256).alias("sha")).collect()
    expected = Counter((i, tuple(library.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in corpus)
    assert Counter((r.doc_id, tuple(r.ids), r.sha) for r in got) == expected


def test_words_equal_the_library():
    path = str(public_tokenizers.path(packing.WORD_BPE))
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rng = random.Random(9)
    pieces = ["Σ", "a", "É", "'s", "'re", "<|endoftext|>", "ÿ", "İ", "1", "²", "中", "\x1c", " ", "́", "***", "ß", "..", "the", "ing", "😀", "\x85", " "]
    texts = ["".join(rng.choice([*pieces, " ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    got = packing.WordEncoder(path).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


def test_every_code_point_equals_the_library():
    path = str(public_tokenizers.path(packing.WORD_BPE))
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = [" ".join(f"a{chr(c)}b 1{chr(c)}! {chr(c)}" for c in range(k, min(k + 64, 0x110000)) if not 0xD800 <= c < 0xE000) for k in range(0, 0x30000, 64)]
    texts = [t for t in texts if t]
    got = packing.WordEncoder(path).encode(texts)
    assert [k for k, (x, y) in enumerate(zip(got, plain.encode_batch(texts, add_special_tokens=False), strict=True)) if np.frombuffer(x, "<u4").tolist() != y.ids] == []


def test_slots_beyond_a_broadcast(frame, monkeypatch):
    want = Counter(map(tuple, packing.pack(frame, capacity=64).collect()))
    monkeypatch.setattr(packing, "SLOTS_BROADCAST", 0)
    assert Counter(map(tuple, packing.pack(frame, capacity=64).collect())) == want


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(frame, corpus, capacity):
    path = str(public_tokenizers.path(packing.WORD_BPE))
    ids = Counter()
    for (i, _), data in zip(corpus, packing.WordEncoder(path).encode([t or "" for _, t in corpus]), strict=True):
        ids[i, data + np.array([2], "<u4").tobytes()] += 1
    rows = packing.pack(frame, capacity=capacity).collect()
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    expected = Counter()
    for (i, data), n in ids.items():
        total = len(data) // 4
        for at in range(0, total, capacity):
            part = data[4 * at : 4 * (at + capacity)]
            expected[i, at, len(part) // 4, zlib.crc32(part), total] += n
    assert pieces == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity


def test_histogram_packing_wastes_little():
    rng = random.Random(5)
    histogram = Counter(min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20000))
    patterns = packing.pack_histogram(histogram)
    placed = Counter()
    for lengths, n in patterns:
        assert sum(lengths) <= 4096
        for length in lengths:
            placed[length] += n
    assert placed == histogram
    assert sum(k * n for k, n in histogram.items()) / (4096 * sum(n for _, n in patterns)) > 0.98


def brute_sections(text, rule):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(token_counts.BYTE_BPE), "rb"))}
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    data, owner, k = text.encode(), [], 0
    for b in data:
        owner.append(k)
        k += b == 10
    sections = [0.0] * (max(owner, default=0) + 1)
    at = 0
    for token in enc.encode_ordinary(text):
        held = Counter(owner[at : at + len(enc.decode_single_token_bytes(token))])
        at += held.total()
        if rule == "start":
            sections[min(held)] += 1
        elif rule == "most":
            sections[min(held, key=lambda s: (-held[s], s))] += 1
        else:
            for s, n in held.items():
                sections[s] += n / held.total()
    return sections


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(frame, corpus, rule):
    got = {}
    for r in token_counts.section_tokens(frame, rule=rule).orderBy("section").collect():
        got.setdefault(r.doc_id, []).append(r.n_tokens)
    for i, text in corpus:
        if i is not None and sum(j == i for j, _ in corpus) == 1:
            assert got[i] == pytest.approx(brute_sections(text or "", rule))


def test_long_white_space(spark):
    """The library's own pattern raises on these."""
    text = "a line\n" + " " * 2_000_000 + "\n" * 50 + "end"
    rows = token_counts.section_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(rows) == 52 and sum(r.n_tokens for r in rows) == rows[0].doc_tokens and rows[-1].byte_end == len(text)


def test_null_spans_give_no_rows(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, "some text", []), (3, "some text", [(0, 4)])], "doc_id long, text string, at array<struct<start:int,end:int>>")
    assert [r.doc_id for r in token_counts.section_tokens(df, spans_col="at").collect()] == [3]


def test_crossing_tokens_by_hand():
    ends, spans = np.array([3, 6, 8]), np.array([[0, 4], [4, 5], [5, 7]])
    assert token_counts.attribute(ends, spans, "start")[0].tolist() == [2, 0, 1]
    assert token_counts.attribute(ends, spans, "most")[0].tolist() == [2, 0, 1]
    assert token_counts.attribute(ends, spans, "share")[0].tolist() == pytest.approx([1 + 1 / 3, 1 / 3, 1 / 3 + 1 / 2])
    assert token_counts.attribute(ends, spans, "most")[1].tolist() == [1, 1, 2]


def test_empty(empty):
    assert bpe.decode(bpe.encode(empty)).collect() == [] and packing.pack(empty).collect() == [] and token_counts.section_tokens(empty).collect() == []
