"""Operator 5: ordinal cumulative-link regression of graded ratings on hashed text.

P(grade <= j) = sigmoid(threshold_j - w.x), with one weight vector for all grades and ordered thresholds. The model
gives the expected grade and the tail probability P(grade >= cut); documents whose tail probability is below `least`
are rejected. It is fitted on at most `MOST` documents of each grade (those of smallest hash), on the driver; every
document is scored in its task, on its whole text. The driver gets nothing else.

Defined results. A null or empty text has no terms but those of its shape and gets a score as any other. Repeated rows
each get the same score. Without labels, or with one grade only, every document keeps tail probability 1 and that grade
(0 without labels). An empty table gives no rows. Null doc_ids are scored, with held_out false. A tail probability of just
the limit selects. Texts of any length are read whole. Other columns are ignored, or kept by `scored` as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import forget_others
from .features import DIMENSIONS, PIECE, Cached, frequent, fresh, hashed, held_out, labelled_sample, parts_of, sparse_rows

#: Documents of each grade that the fit takes; rows a term needs among them; passes; pull towards zero.
MOST, LEAST_ROWS, STEPS, PULL = 4000, 5, 150, 1e-4
#: A document is kept unless its probability of the cut grade or a higher one is below this.
LEAST = 0.35


@dataclass
class Model:
    terms: np.ndarray  # dimensions in use, in order
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; P(grade <= grades[j]) for all but the last grade
    grades: np.ndarray


def shape(word: str) -> str:
    """The word's letters as a or A, its digits as 0, each run once; other characters as they are, runs of one up to 3."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    out: list[str] = []
    for c in kinds:
        if out[-1:] != [c] or (c not in "aA0" and out[-3:] != [c] * 3):
            out.append(c)
    return "".join(out)


def word_terms(word: str) -> tuple[int, ...]:
    """The hashed shape of what stands between blanks, then its pieces; a long one's parts."""
    low = word.lower()
    pieces = PIECE.findall(low)
    return (hashed("s " + shape(word)), *(hashed("w " + part) for piece in pieces for part in parts_of(piece)))


def text_terms() -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    known = Cached(word_terms)

    def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        n = len(words)
        count = Counter(words)
        code = np.fromiter(map({w: i for i, w in enumerate(count)}.__getitem__, words), np.int64, n)
        # each word's terms, its shape first, weigh as often as the word occurs
        own = [known[w] for w in count]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        times = np.repeat(np.fromiter(count.values(), np.float64, len(own)), sizes)
        found, where = np.unique(np.fromiter(chain.from_iterable(own), np.int64, int(sizes.sum())), return_inverse=True)
        parts, values = [found], [np.sqrt(np.bincount(where, times, len(found)) / max(n, 1))]
        lines = [x for x in text.split("\n") if x.strip()] if text else []
        repeats = int((code[1:] == code[:-1]).sum())
        letters = sum(map(len, words))
        facts = {
            "words": int(np.log2(n + 1)),
            "new": int(10 * len(count) / n) if n else -1,
            "new by length": (int(10 * len(count) / n), int(np.log2(n))) if n else -1,
            "again": int(20 * repeats / n) if n else -1,
            "lines": int(10 * len(set(lines)) / len(lines)) if lines else -1,
            "per line": int(np.log2(n / len(lines) + 1)) if lines else -1,
            "long": int(letters / n) if n else -1,
            "upper": int(10 * sum(map(str.isupper, words)) / n) if n else -1,
            "marks": int(10 * sum(not w[-1].isalnum() for w in words) / n) if n else -1,
            "few": min(n, 12),
        }
        own = np.array([hashed(f"f {k} {v}") for k, v in facts.items()])
        at = np.concatenate([*parts, own])
        value = np.concatenate([*values, np.full(len(own), 0.5)])
        at, where = np.unique(at, return_inverse=True)
        return at, np.bincount(where, value)

    return terms


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST) -> Model:
    at, values, y = sparse_rows(labelled_sample(docs, labels, label, most), text_terms)
    grades = np.unique(y)
    if len(grades) < 2:
        return Model(np.zeros(0, int), np.zeros(0), np.zeros(0), grades if len(grades) else np.zeros(1, int))
    terms = frequent(at, LEAST_ROWS)
    place = np.full(DIMENSIONS, -1)
    place[terms] = np.arange(len(terms))
    row = np.repeat(np.arange(len(at)), [len(a) for a in at])
    col, value = place[np.concatenate(at)], np.concatenate(values).astype(float)
    row, col, value = row[col >= 0], col[col >= 0], value[col >= 0]
    grade = np.searchsorted(grades, y)
    share = np.bincount(grade) / len(grade)
    weights, cuts = np.zeros(len(terms)), np.log(np.cumsum(share)[:-1] / (1 - np.cumsum(share)[:-1]))
    first, second = np.zeros(len(terms) + len(cuts)), np.zeros(len(terms) + len(cuts))
    for step in range(1, STEPS + 1):
        score = np.bincount(row, weights[col] * value, len(at))
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        high, low = sigmoid(edges[grade + 1] - score), sigmoid(edges[grade] - score)
        slope_high, slope_low = high * (1 - high), low * (1 - low)
        likely = np.maximum(high - low, 1e-9)
        by_score = (slope_high - slope_low) / likely / len(at)
        by_cut = np.zeros(len(cuts) + 2)
        np.add.at(by_cut, grade + 1, -slope_high / likely / len(at))
        np.add.at(by_cut, grade, slope_low / likely / len(at))
        slope = np.concatenate([np.bincount(col, by_score[row] * value, len(terms)) + PULL * weights, by_cut[1:-1]])
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights, cuts = weights - move[: len(terms)], np.sort(cuts - move[len(terms) :])
    return Model(terms, weights, cuts, grades)


def scored(docs: DataFrame, model: Model, cut: int | None = None) -> DataFrame:
    """The documents as they are, with two more columns: expected_grade and tail_probability (`fresh` names, if taken)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    new = [fresh(docs.columns, x) for x in ("expected_grade", "tail_probability")]
    out = StructType([*docs.schema.fields, *(StructField(x, DoubleType()) for x in new)])
    place = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        own = sent.value
        weights = np.zeros(DIMENSIONS)
        weights[own.terms] = own.weights
        at_least = own.grades[-1] if cut is None else cut
        j = int(np.searchsorted(own.grades, at_least))
        make = text_terms()
        for batch in batches:
            x = np.array([float(weights[a] @ b) for a, b in map(make, (t or "" for t in batch.column(place).to_pylist()))])
            below = sigmoid(own.thresholds[None, :] - x[:, None])
            expected = own.grades[-1] - below @ np.diff(own.grades) if len(own.grades) > 1 else np.full(len(x), float(own.grades[0]))
            tail = 1 - below[:, j - 1] if 0 < j <= below.shape[1] else np.full(len(x), float(j == 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], names=[*batch.schema.names, *new])

    return docs.mapInArrow(score, out)


def graded(docs: DataFrame, labels: DataFrame, label: str = "quality", least: float = LEAST) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability, selected of every document."""
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fit(docs, labels, label))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= least).alias("selected"))
