"""Quality classification from weak labels.

1. Six heuristic labellers vote on every document: bad, good, or nothing.
2. Expectation-maximisation over the counts of vote patterns (3^6 at most, whatever the corpus) estimates how each
   labeller votes on good and on bad documents, and so the posterior of every pattern. No labelled document is needed.
3. Posterior labels of a bounded random sample (``SAMPLE`` documents, about) train a linear scorer over hashed
   features: byte trigrams and a few binned word statistics.
4. Every whole document is scored; it stays if its probability of being good is ``LEAST_GOOD`` or more. A text of fewer
   than ``FEW_WORDS`` words also stays if the labellers' posterior says good. Where the sample has one class alone and no
   scorer can be trained, the posterior decides.

The pattern counts cover all documents; only the scorer's training rows are sampled, by a hash of the text,
and the sample's bound is a parameter.

Defined cases: a null or empty text has no evidence against it, gets the votes of no labeller and stays; rows with
equal ids are scored each by its own text, equal texts equally; an empty table gives no rows; other columns are
carried along or not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, sliced, stage, text_of, with_row

SAMPLE = 6000
BUCKETS = 1 << 15
LEAST_GOOD = 0.5
#: Texts of fewer words go only if the scorer and the labellers' posterior both reject them.
FEW_WORDS = 5
#: Common short words of English, French, German and Spanish, which running text holds many of.
COMMON = frozenset(
    "the of and to in a is that it was for on are with as be this have from or by at an not but"
    " le la les de des du et en un une est que qui pour dans sur au par plus ne pas"
    " der die das und zu den von mit ist des sich auf ein eine dem nicht im auch"
    " el los las y del al se con por una su para como lo más o".split()
)
_MARKS = re.compile(r"[^\w\s.,;:'’\"()?¿¡-]")
LABELLERS = ("symbols", "capitals", "repeats", "common words", "sentences", "variety")
GOOD, BAD, NOTHING = 1, 2, 0


def statistics(text: str) -> tuple[float, float, float, float, float, float, int]:
    """(marks by words, capitals by letters, repeated neighbours, common words, sentence ends, distinct words; number of words)"""
    words = text.split()
    n = len(words)
    if not n:
        return 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0
    marks = len(_MARKS.findall(text)) / n
    cased = sum(1 for w in words if len(w) > 1 and w.isupper())
    repeats = sum(map(eq, words, words[1:])) / max(1, n - 1)
    folded = text.lower().split()
    common = sum(1 for w in folded if w in COMMON or w.rstrip(".,;:") in COMMON) / n
    ends = (text.count(".") + text.count("?") + text.count("!")) / n
    return marks, cased / n, repeats, common, ends, len(set(folded)) / n, n


def votes(values: tuple[float, float, float, float, float, float, int]) -> tuple[int, ...]:
    """The labellers' votes from a text's statistics."""
    marks, capitals, repeats, common, ends, variety, n = values
    if not n:
        return (NOTHING,) * 6
    if n < FEW_WORDS:  # too few for all but the marks
        return (BAD if marks > 0.5 else NOTHING, *(NOTHING,) * 5)
    expected = min(1.0, 6 * n**-0.35)  # distinct words become rarer in long texts
    return (
        BAD if marks > 0.3 else GOOD if marks < 0.05 else NOTHING,
        BAD if capitals > 0.4 else GOOD if capitals < 0.1 else NOTHING,
        BAD if repeats > 0.3 else GOOD if repeats < 0.1 else NOTHING,
        NOTHING if n < 20 else BAD if common < 0.04 else GOOD if common > 0.12 else NOTHING,
        NOTHING if n < 20 else BAD if ends > 0.5 or ends < 0.004 else GOOD if 0.02 < ends < 0.3 else NOTHING,
        NOTHING if n < 20 else BAD if variety < 0.35 * expected else GOOD if variety > 0.6 * expected else NOTHING,
    )


def pattern(given: tuple[int, ...]) -> int:
    return sum(v * 3**k for k, v in enumerate(given))


def fit_labellers(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """The posterior probability of being good of every vote pattern.

    Votes are independent given the class, and whether a labeller votes at all says nothing. What is estimated, from all
    documents, is how often each labeller that votes says bad of good and of bad documents: the first guess is that it
    seldom blames a good one and sees a third of the bad ones, for each looks at one fault alone."""
    if not counts:
        return {}
    codes = np.array(sorted(counts))
    weight = np.array([counts[c] for c in codes], float)
    given = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    blames, voted = given == BAD, given != NOTHING
    blame = np.repeat([[0.005], [0.35]], len(LABELLERS), 1)  # of good, of bad documents
    share = np.array([0.85, 0.15])
    for _ in range(rounds):
        seen = np.where(blames, np.log(blame)[:, None], np.log1p(-blame)[:, None]) * voted
        joint = np.log(share)[:, None] + seen.sum(2)
        posterior = np.exp(joint - joint.max(0))
        posterior /= posterior.sum(0)
        held = posterior * weight
        share = (held.sum(1) + 1) / (held.sum() + 2)
        blame = (held @ blames + [[0.01], [0.7]]) / (held @ voted + 2)
    return dict(zip(codes.tolist(), posterior[0].tolist(), strict=True))


def _binned(values: tuple) -> list[int]:
    """Word statistics as hashed one-hot features."""
    edges = ((0.05, 0.15, 0.3, 0.6), (0.1, 0.25, 0.5, 0.8), (0.05, 0.15, 0.4, 0.7), (0.02, 0.05, 0.1, 0.2), (0.004, 0.02, 0.3, 0.5), (0.1, 0.2, 0.4, 0.7))
    return [hash((k, sum(v > e for e in edge))) % BUCKETS for k, (v, edge) in enumerate(zip(values, edges, strict=False))]


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the byte trigram that starts at each byte but the last two."""
    x = data.astype(np.uint32)
    code = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    return (code * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64)


def features(text: str, values: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of one text: buckets and values; trigrams together weigh as much as two binned statistics."""
    data = np.frombuffer(text.encode(), np.uint8)
    bins = np.array(_binned(values))
    if len(data) < 3:
        return bins, np.ones(len(bins))
    counts = np.bincount(trigram_buckets(data), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    weight = np.sqrt(counts[found])
    return np.append(found, bins), np.append(2 * weight / np.linalg.norm(weight), np.ones(len(bins)))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], passes: int = 12) -> np.ndarray:
    """Weights of a logistic scorer on soft labels; the last weight is the intercept. Rows come in a fixed order."""
    weights, squared = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    good = sum(label for _, _, label in rows)
    balance = (len(rows) / max(1.0, 2 * good), len(rows) / max(1.0, 2 * (len(rows) - good)))
    order = np.random.default_rng(7).permutation(len(rows))
    for _ in range(passes):
        for k in order:
            bucket, value, label = rows[k]
            p = 1 / (1 + np.exp(-np.clip(weights[bucket] @ value + weights[-1], -30, 30)))
            slope = (p - label) * (balance[0] * label + balance[1] * (1 - label))
            step = slope * value + 1e-6 * weights[bucket]
            np.add.at(squared, bucket, step * step)
            np.add.at(weights, bucket, -0.3 * step / np.sqrt(squared[bucket]))
            squared[-1] += slope * slope
            weights[-1] -= 0.3 * slope / np.sqrt(squared[-1])
    return weights


def score(text: str, values: tuple, weights: np.ndarray) -> float:
    bucket, value = features(text, values)
    return float(1 / (1 + np.exp(-np.clip(weights[bucket] @ value + weights[-1], -30, 30))))


def judged(text: str, posterior: dict[int, float], weights: np.ndarray | None, least_good: float) -> tuple[float, float, bool]:
    """(the labellers' posterior, the scorer's probability or, without a scorer, the posterior again, whether the text stays)"""
    values = statistics(text)
    if not values[-1]:
        return 1.0, 1.0, True
    weak = posterior.get(pattern(votes(values)), 1.0)
    good = weak if weights is None else score(text, values, weights)
    return weak, good, good >= least_good or values[-1] < FEW_WORDS and weak >= least_good


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "_text"):
        found = [statistics(t) for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pattern(votes(x)) for x in found], pa.int32())], names=["_pattern"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "_text"):
        found = [(v := statistics(t), features(t, v)) for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_order"), pa.array([pattern(votes(v)) for v, _ in found], pa.int32()), pa.array([b.astype(np.int32).tobytes() for _, (b, _) in found], pa.binary()), pa.array([w.astype(np.float32).tobytes() for _, (_, w) in found], pa.binary())], names=["_order", "_pattern", "_bucket", "_value"])


def fit(df: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> tuple[dict[int, float], np.ndarray | None]:
    """(posterior of every vote pattern, scorer's weights; none where only one class was found). Patterns are counted over all rows."""
    texts = df.select(text_of(text_col).alias("_text"))
    counted = texts.mapInArrow(_vote, "_pattern int").groupBy("_pattern").count()
    counts = {r["_pattern"]: r["count"] for r in counted.collect()}  # 3^6 rows at most
    posterior = fit_labellers(counts)
    total = sum(counts.values())
    informative = {c for c in counts if c}  # a document on which nobody votes teaches nothing
    if not informative:
        return posterior, None
    order = F.xxhash64("_text")  # by content, so that the sample is the same however the rows are laid out; copies count once
    part = min(1.0, sample / total)
    drawn = texts.withColumn("_order", order).filter(F.pmod("_order", F.lit(1 << 30)) < int(part * (1 << 30))).dropDuplicates(["_order"])
    rows = drawn.mapInArrow(_featured, "_order long, _pattern int, _bucket binary, _value binary").collect()  # about ``sample`` rows
    rows = [r for r in sorted(rows, key=lambda r: (r["_order"], r["_pattern"], len(r["_bucket"]))) if r["_pattern"] in informative]
    data = [(np.frombuffer(r["_bucket"], np.int32), np.frombuffer(r["_value"], np.float32).astype(float), posterior[r["_pattern"]]) for r in rows]
    labels = [label >= 0.5 for _, _, label in data]
    return posterior, train(data) if any(labels) and not all(labels) else None


def classified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least_good: float = LEAST_GOOD, row_col: str | None = None) -> DataFrame:
    """One row per input row: _row, doc_id, weak_good (the labellers' posterior), good (the scorer's probability), kept."""
    posterior, weights = fit(df, text_col, sample)
    rows = df.withColumn("_row", F.col(row_col)) if row_col else with_row(df)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            found = [judged(text, posterior, weights, least_good) for text in batch.column("_text").to_pylist()]
            weak, good, kept = ([x[k] for x in found] for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), pa.array(weak, pa.float64()), pa.array(good, pa.float64()), pa.array(kept, pa.bool_())], names=["_row", "doc_id", "weak_good", "good", "kept"])

    return rows.select("_row", F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text")).mapInArrow(run, f"_row long, doc_id {kind}, weak_good double, good double, kept boolean")


def accepted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows that stay, with all their columns: the same scores, in one pass over the rows."""
    posterior, weights = fit(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            yield batch.filter(pa.array([judged(text or "", posterior, weights, LEAST_GOOD)[2] for text in batch.column(text_col).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(documents(spark, sf_dir)).select("doc_id", F.round("weak_good", 6).alias("weak_good"), F.round("good", 6).alias("good"), "kept")
