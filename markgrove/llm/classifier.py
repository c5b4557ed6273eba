"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight for each hashed text feature is shared by all grades, and ordered thresholds cut the score into grades:
P(grade <= k) = logistic(threshold_k - score). A document is selected by the tail probability of the highest grades.
Features are hashed and binary: each distinct word (lower case, without
punctuation at its ends), and for each word shape (classes of characters, runs collapsed) and for
the share of distinct words the band in which its share of the document lies. Weights are fitted by proximal AdaGrad on
all batches of a bounded sample of the labelled rows, with a lasso penalty, in one task, until the penalised likelihood settles;
scoring covers whole texts.

Defined results: labels with a null, and labels of documents that are not there, are not used and take no part of the sample;
a document counts once for each different grade that it is given; a document whose id repeats counts once for each text;
identifiers may be of any type that joins; a null text has no words; texts of any length are read whole; rows of equal text
get equal scores; without usable labels every document gets the middle score 0 and evenly spaced thresholds; an empty table
stays empty; columns other than doc_id and text, whatever their names, are not carried.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.parse import spread
from .common import tune

#: Hash space, grades 0 .. GRADES - 1, and the bound of the sample of labelled rows that the model is fitted on.
FEATURES, GRADES, MAX_LABELLED = 1 << 18, 3, 12_000

#: Most rounds of fitting, the change of the penalised loss that ends it, step, lasso penalty; least tail probability
#: P(grade >= SELECT_GRADE) of a selected document.
ROUNDS, SETTLED, STEP, LASSO, SELECT_GRADE, SELECT = 400, 2e-5, 0.3, 5e-4, 2, 0.6

#: ASCII marks that are not part of a word's feature at its ends.
PUNCTUATION = b".,;:!?\"'()[]{}"

#: Lower ends of the bands of a share.
BANDS = (0.0, 0.02, 0.1, 0.3, 0.6, 0.9)


def hashed(text: str | bytes) -> int:
    return xxhash.xxh64_intdigest(text) & (FEATURES - 1)


def shape(word: bytes) -> str:
    """Classes of a word's characters, runs collapsed."""
    out, last = [], ""
    for c in word.decode("utf-8", "replace"):
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "x" if c.isalpha() else c
        if kind != last:
            out.append(kind)
            last = kind
    return "".join(out)


class Words(dict):
    """(feature, shape) of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> tuple[int, str]:
        if len(self) > 150_000:
            self.clear()
        plain = word.lower().strip(PUNCTUATION)
        found = self[word] = (hashed(plain or word), shape(word))
        return found


WORDS = Words()


def band(share: float) -> int:
    return sum(share > b for b in BANDS)


def features(text: str | None) -> np.ndarray:
    """Distinct hashed features of a whole text."""
    words = (text or "").encode("utf-8", "replace").split()
    counts = Counter(words)
    found, shapes = set(), Counter()
    for word, n in counts.items():
        i, s = WORDS[word]
        found.add(i)
        shapes[s] += n
    for s, n in shapes.items():
        found.add(hashed(f"shape {s} {band(n / len(words))}"))
    if words:
        found.add(hashed(f"distinct {band(len(counts) / len(words))}"))
        found.add(hashed(f"most {band(max(counts.values()) / len(words))}"))
    return np.fromiter(found, dtype=np.int32, count=len(found))


def fit(rows: list[np.ndarray], grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds."""
    weights, thresholds = np.zeros(FEATURES), np.linspace(-1.0, 1.0, GRADES - 1)
    if not len(rows):
        return weights, thresholds
    share = np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] / len(grades)
    thresholds = np.log((share + 1e-3) / (1 - share + 1e-3)) + np.arange(GRADES - 1) * 1e-3
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), sizes)
    square, square_t = np.full(FEATURES, 1e-12), np.full(GRADES - 1, 1e-12)
    last = math.inf
    for _ in range(ROUNDS):
        s = np.bincount(row, weights[flat], len(rows))
        below = np.hstack([np.zeros((len(rows), 1)), 1 / (1 + np.exp(np.clip(s[:, None] - thresholds, -500, 500))), np.ones((len(rows), 1))])
        high, low = below[np.arange(len(rows)), grades + 1], below[np.arange(len(rows)), grades]
        p = np.maximum(high - low, 1e-9)
        loss = float(-np.log(p).mean() + LASSO * np.abs(weights).sum())
        if abs(last - loss) <= SETTLED * max(1.0, abs(loss)):
            break
        last = loss
        slope = -np.bincount(flat, (high + low - 1)[row], FEATURES) / len(rows)
        square += slope * slope
        rate = STEP / np.sqrt(square)
        weights = weights - rate * slope
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * LASSO, 0)
        slope_t = np.zeros(GRADES - 1)
        for k in range(GRADES - 1):
            slope_t[k] = -((high * (1 - high) / p)[grades == k].sum() - (low * (1 - low) / p)[grades == k + 1].sum()) / len(rows)
        square_t += slope_t * slope_t
        thresholds = np.maximum.accumulate(thresholds - STEP / np.sqrt(square_t) * slope_t + np.arange(GRADES - 1) * 1e-9)
    return weights, thresholds


def grade(quality: Column, toxic: Column) -> Column:
    """The rating of a labelled row: 0 toxic, 1 poor, 2 good; null if either label is null."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic > 0, 0).when(quality <= 0, 1).otherwise(2)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most max_labelled of labels (doc_id, grade), those first by a hash of doc_id."""
    order = F.xxhash64(F.col("of").cast("string"))
    usable = labels.where("doc_id is not null and grade is not null").select(F.col("doc_id").alias("of"), F.col("grade").cast("int").alias("grade")).distinct()
    there = usable.join(docs.select("doc_id").distinct(), F.col("of") == F.col("doc_id"), "left_semi")
    sample = there.orderBy(order, "of", "grade").limit(max_labelled)  # a proven bound, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("of")).select(order.alias("place"), "text", "grade")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.sort(features(t)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("grade"), pa.array(each, type=pa.binary())], names=["place", "grade", "features"])

    def solve(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("place", "grade", "features")), strict=True))
        weights, thresholds = fit([np.frombuffer(f, dtype=np.int32) for _, _, f in rows], np.array([g for _, g, _ in rows], dtype=np.int64))
        return pa.table({"weights": pa.array([weights.astype(np.float32).tobytes()], type=pa.binary()), "thresholds": pa.array([thresholds.tobytes()], type=pa.binary())})

    # equal rows of a repeated id are one; ids with several texts may still exceed the bound, so it is taken again
    found = rows.mapInArrow(extract, "place long, grade int, features binary").distinct().orderBy("place", "grade", "features").limit(max_labelled)
    model = found.groupBy().applyInArrow(solve, "weights binary, thresholds binary").first()
    if model is None:
        return fit([], np.zeros(0, dtype=np.int64))
    return np.frombuffer(model[0], dtype=np.float32).astype(np.float64), np.frombuffer(model[1])


def classify(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, score, expected_grade, tail_probability, kept of every row."""
    spark = tune(docs.sparkSession)
    weights, thresholds = spark.sparkContext.broadcast(model[0].astype(np.float32)), model[1]  # of the fixed size FEATURES
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value.astype(np.float64)
        for batch in batches:
            s = np.array([w[np.sort(features(t))].sum() for t in batch.column("text").to_pylist()], dtype=np.float64)
            above = 1 / (1 + np.exp(np.clip(thresholds[None, :] - s[:, None], -500, 500)))  # P(grade > k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in (s, above.sum(axis=1), above[:, SELECT_GRADE - 1]))], names=["doc_id", "score", "expected_grade", "tail_probability"])

    found = spread(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, score double, expected_grade double, tail_probability double")
    return found.withColumn("kept", F.col("tail_probability") >= SELECT)


def select(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on labels (doc_id, quality, toxic), then classify all of docs."""
    rated = labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return classify(docs, train(docs, rated))
