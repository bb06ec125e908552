import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from test_exact_and_near import brute_classes, key
from test_repeats import brute_cut

import __spark_entry__
import corpus_pipeline
from tidemark.llm import packing


def test_pipeline_against_brute_force(spark, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    accepted = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert accepted.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in accepted.select("doc_id", "text").collect()]
    first = {}
    for i, t in sorted(rows, key=lambda x: key(x[0])):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
    near = brute_classes(list(first.values()))
    kept = []
    for ids in near.values():
        least = min(ids, key=key)
        kept.append(next(x for x in first.values() if x[0] == least and (x[1] is None or any(x[1] == t for i, t in first.values() if i == least))))
    ambiguous = {i for i, n in Counter(i for i, _ in first.values()).items() if n > 1}  # ids that stand for several texts
    texts = [(t or "").encode() for _, t in kept]
    cut = [(i, data.decode("utf-8", "ignore")) for (i, _), (_, _, data) in zip(kept, brute_cut(texts, 200), strict=True)]
    encoder = packing.WordEncoder(str(public_tokenizers.path(packing.WORD_BPE)))
    expected = Counter()
    for (i, _), ids in zip(cut, encoder.encode([t for _, t in cut]), strict=True):
        data = ids + np.array([2], "<u4").tobytes()
        for at in range(0, len(data) // 4, 4096):
            expected[i, at, zlib.crc32(data[4 * at : 4 * (at + 4096)])] += 1
    got = Counter((r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert {k: v for k, v in got.items() if k[0] not in ambiguous} == {k: v for k, v in expected.items() if k[0] not in ambiguous}


def test_stages_keep_columns_and_stand_empty_tables(spark, empty, tmp_path):
    docs = empty.withColumnRenamed("score", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name.replace(" ", "-")))
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.read.schema(out.schema).parquet(str(tmp_path / name.replace(" ", "-")))
        else:
            assert out.count() == 0


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
