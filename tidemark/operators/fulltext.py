"""Full text: postings, document frequencies and BM25."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import Tokenizer, words

K1, B = 1.2, 0.75


def postings(df: DataFrame, id_col: str, text_col: str, tokenizer: Tokenizer = words) -> DataFrame:
    """term, doc, tf, positions: the posting list, one row per term and document."""
    terms = df.select(F.col(id_col).alias("doc"), F.posexplode(tokenizer(F.col(text_col))).alias("position", "term"))
    return terms.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


def document_frequency(df: DataFrame, text_col: str, tokenizer: Tokenizer = words) -> DataFrame:
    """term, df: terms are made distinct within a document before the shuffle, and summed in part."""
    return df.select(F.explode(F.array_distinct(tokenizer(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def matches(text: Column, terms: Sequence[str], tokenizer: Tokenizer = words, every: bool = False) -> Column:
    """Whether a text holds one of the terms, or every one."""
    found = [F.array_contains(tokenizer(text), t) for t in terms]
    out = found[0]
    for f in found[1:]:
        out = (out & f) if every else (out | f)
    return out


def _frequency(term: str) -> Column:
    return F.size(F.filter("_t", lambda x: x == term))


def bm25(df: DataFrame, id_col: str, text_col: str, terms: Sequence[str], k: int | None = None, tokenizer: Tokenizer = words, out: str = "score") -> DataFrame:
    """``id_col`` and score of the documents that hold a term, the best ``k`` if asked, ties by id.

    Corpus statistics are one row, whatever the corpus: counts come from one aggregation over the scan, and the second
    pass needs no shuffle. idf is ln(1 + (N - df + 0.5) / (df + 0.5))."""
    tokens = tokenizer(F.col(text_col))
    counted = df.select(F.col(id_col), tokens.alias("_t")).select(id_col, F.size("_t").alias("_n"), *[_frequency(t).alias(f"_f{k}") for k, t in enumerate(terms)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("_n").alias("avg"), *[F.count_if(F.col(f"_f{k}") > 0).alias(f"d{k}") for k in range(len(terms))]).first()
    score = F.lit(0.0)
    for j in range(len(terms)):
        tf = F.col(f"_f{j}").cast("double")
        idf = F.log(F.lit(1 + (stats["n"] - stats[f"d{j}"] + 0.5) / (stats[f"d{j}"] + 0.5)))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_n") / F.lit(float(stats["avg"] or 1))))
    hit = F.lit(False)
    for j in range(len(terms)):
        hit = hit | (F.col(f"_f{j}") > 0)
    scored = counted.filter(hit).select(id_col, score.alias(out))
    return scored.orderBy(F.col(out).desc(), id_col).limit(k) if k is not None else scored
