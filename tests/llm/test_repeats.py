import hashlib
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, suffix_dedup


def brute_cut(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out.append((sum(gone), sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1])), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("length", "contexts"), [(200, 256), (60, 256), (60, 1)])
def test_cut_repeats(frame, corpus, length, contexts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TASK_CONTEXTS", contexts)  # 1: all mixed anchors take the dealt-out way
    monkeypatch.setattr(suffix_dedup, "PART_CONTEXTS", 2 if contexts == 1 else 4096)
    texts = [(t or "").encode() for _, t in corpus]
    expected = Counter((i, len(t), n, spans, kept) for (i, _), t, (n, spans, kept) in zip(corpus, texts, brute_cut(texts, length), strict=True))
    rows = suffix_dedup.cut_repeats(frame, length=length).collect()
    assert Counter((r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.spans), bytes(r.kept)) for r in rows) == expected


def test_long_texts_are_cut_in_segments(monkeypatch):
    rng = random.Random(1)
    text = bytes(rng.choice(b"ab") for _ in range(5000))
    whole = suffix_dedup.runs([text], 100)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    groups = list(suffix_dedup.segmented([b"", text, b"ab"], 100))
    assert max(sum(map(len, parts)) for _, _, parts in groups) <= 700 + 99
    found = {}
    for source, begin, parts in groups:
        for owner, first, many, off, h in zip(*suffix_dedup.runs(parts, 100), strict=True):
            assert source[owner] == 1
            for k in range(many):
                found[begin[owner] + first + k] = (h, k - off)
    expected = {first + k: (h, k - off) for _, first, many, off, h in zip(*whole, strict=True) for k in range(many)}
    assert {p: h for p, (h, _) in found.items()} == {p: h for p, (h, _) in expected.items()}


def test_equal_runs_fold_in_their_segment():
    parts = [b"x" * 300, b"ab" * 200 + b"x" * 250]
    found = suffix_dedup.runs(parts, 100)
    leader, again = suffix_dedup.folded(parts, found, 100)
    cut = [parts[o][f : f + n + 99] for o, f, n, _, _ in zip(*found, strict=True)]
    assert len(set(leader.tolist())) < 20 < len(leader) and all(cut[k] == cut[j] for k, j in enumerate(leader.tolist()))
    assert {k for k, x in enumerate(again) if x} == {j for k, j in enumerate(leader.tolist()) if j != k}


@pytest.mark.parametrize("unit", [b"a", b"ab", bytes(range(65, 91)) * 9])
def test_a_very_long_periodic_text(unit):
    """8 MB of one period: what a text gives doesn't follow its size, and no more than a segment is hashed at a time."""
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    text = unit * ((8 << 20) // len(unit))
    rows = sum(len(set(suffix_dedup.folded(parts, suffix_dedup.runs(parts), 200)[0].tolist())) for _, _, parts in suffix_dedup.segmented([text], 200))
    assert rows < 5000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20


def test_suffixes_are_sorted():
    rng = random.Random(3)
    data = bytes(rng.choice(b"ab") for _ in range(400))
    order = suffix_dedup.SuffixOrder(data)
    suffixes = list(range(350))
    assert [data[k : k + 50] for k in order.sort(suffixes, 50)] == sorted(data[k : k + 50] for k in suffixes)
    for _ in range(200):
        i, j = rng.randrange(350), rng.randrange(350)
        n = next((k for k in range(50) if data[i + k] != data[j + k]), 50)
        assert order.extension(i, j, 50) == n


def test_cut_texts_keep_their_rows(frame):
    out = suffix_dedup.without_repeats(frame)
    assert out.columns == frame.columns and out.count() == frame.count()
    assert out.filter("text IS NULL").count() == frame.filter("text IS NULL").count()
    assert not [r for r in out.collect() if r.text and "�" in r.text]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutated(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        k = rng.randrange(len(text))
        match rng.randrange(3):
            case 0:
                text[k] = rng.choice("abcé")
            case 1:
                del text[k]
            case 2:
                text.insert(k, rng.choice("abcé"))
    return "".join(text)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    base = ["".join(rng.choice("abcé") for _ in range(rng.choice([16, 24, 70]))) for _ in range(10)]
    pairs = [(b, mutated(rng, b, rng.randint(0, 4))) for b in base * 10] + [(rng.choice(base), rng.choice(base)) for _ in range(50)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b"), edits).alias("w")).collect()
    assert [(r.a, r.b) for r in got if r.w != (distance(r.a, r.b) <= edits)] == []


def expected_lines(docs, budgets):
    """(dropped, near) of each row, by comparing every line with every other."""
    places, first = {}, {}
    for row, (i, text) in enumerate(docs):
        for p, line in enumerate((text or "").split("\n")):
            places[row, p] = (i is None, i or 0, row, p)
            if line.strip():
                first[line] = min(first.get(line, places[row, p]), places[row, p])

    def budget(a, b):
        return max([e for least, e in budgets if min(len(a), len(b)) >= least], default=0)

    late = {a for a in first if any(first[b] < first[a] and abs(len(a) - len(b)) <= budget(a, b) and distance(a, b) <= budget(a, b) for b in first)}
    out = []
    for row, (_, text) in enumerate(docs):
        lines = list(enumerate((text or "").split("\n")))
        near = sum(line in late and first[line] == places[row, p] for p, line in lines)
        out.append(([p for p, line in lines if line.strip() and (line in late or first[line] != places[row, p])], near))
    return out


@pytest.mark.parametrize(("budgets", "few"), [(((16, 1),), 16), (((4, 1), (16, 2)), 16), (((4, 1), (16, 2)), 2), (((1, 1), (5, 2), (12, 3)), 3)])
def test_line_decisions(spark, budgets, few):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcé") for _ in range(rng.choice([3, 4, 10, 16, 20, 24]))) for _ in range(12)]
    docs = [(k, "\n".join(mutated(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(4))) for k in range(60)]
    docs += [(70, None), (71, ""), (None, base[0]), (3, f"\n\n  \n{base[1]}"), (3, f"\n\n  \n{base[1]}")]
    got = line_dedup.line_decisions(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), budgets=budgets, few=few).orderBy("_row").collect()
    assert [(r.dropped, r.n_near) for r in got] == expected_lines(docs, budgets)


def test_many_lines_of_one_form(spark):
    """Lines of one long common part meet in groups that have to be cut again and again."""
    rng = random.Random(3)
    lines = [f"chapter {rng.randrange(100000):05d} of the book, {rng.choice(['', 'un', 'abridged, '])}printed" for _ in range(300)]
    lines += ["a" * n for n in range(3, 30)] + ["ab" * n for n in range(2, 16)]
    docs = [(k, x) for k, x in enumerate(lines)]
    rng.shuffle(docs)
    docs.sort(key=lambda x: x[0])
    got = line_dedup.line_decisions(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), few=4).orderBy("_row").collect()
    assert [(r.dropped, r.n_near) for r in got] == expected_lines(docs, line_dedup.BUDGETS)


def test_lines_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "same line here\nown", 5, "x"), (2, "same line here\nother words", 6, "y")], "doc_id long, text string, _line_row int, _Line_Gone string").coalesce(1)
    out = line_dedup.without_repeated_lines(df).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, "same line here\nown", 5, "x"), (2, "other words", 6, "y")]


def test_lines_cut_out_of_texts(spark):
    df = spark.createDataFrame([(1, "x y z\n\nkept"), (2, "x y z\nmore\n\n"), (3, None)], "doc_id long, text string").coalesce(1)
    assert [r.text for r in line_dedup.without_repeated_lines(df).orderBy("doc_id").collect()] == ["x y z\n\nkept", "more\n\n", None]


def test_empty(empty):
    assert suffix_dedup.cut_repeats(empty).collect() == [] and line_dedup.line_decisions(empty).collect() == []


def test_edits_far_from_an_end(spark):
    long = F.repeat(F.lit("abcdefgh"), 300_000)  # 2.4 million characters before the edit
    row = spark.range(1).select(line_dedup.within_edits(F.concat(long, F.lit("xyz")), F.concat(long, F.lit("xwz")), 1).alias("one"), line_dedup.within_edits(F.concat(long, F.lit("xyz")), F.concat(long, F.lit("wvz")), 1).alias("two")).first()
    assert (row.one, row.two) == (True, False)
