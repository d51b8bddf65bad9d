"""Operator 7: toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)) over the terms i that a text has. Terms are its
runs of letters and digits, lower-cased, and their first four to eight letters; a run of more than 24 characters (a
script without blanks, glued words) is known by all its runs of five. The factors v give each pair of terms a weight of
its own, so an insult beside a group's name can weigh more than both alone. Terms go into the model if they tell the
labels apart alone, or in a pair of whole words: `pairs_that_tell` finds pairs whose documents' labels differ from what
the terms' own weights give them, and the factors begin at those pairs' effects, so that the descent needn't find them
by chance.

The model is fitted on at most `MOST` labelled documents of each label (those of smallest hash), on the driver; every
document is scored in its task, on its whole text. No label of a held-out document is learnt, and doc_id, lang, source and labels are no inputs.

Defined results. A null or empty text has no terms and gets the bias's score. Repeated rows each get the same score.
Without labels of both kinds the score is 0, or 1 where all are toxic. An empty table gives no rows. Null doc_ids are
scored, with held_out false. A score of just the threshold is predicted toxic. Texts of any length are read whole. Other
columns are ignored, or kept by `scored` as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import forget_others
from .features import DIMENSIONS, PIECE, WHOLE, Cached, frequent, fresh, hashed, held_out, labelled_sample, parts_of, sparse_rows
from .quality import sigmoid

#: Documents of each label that the fit takes; rows a term needs among them; factors; passes; rows in a step.
MOST, LEAST_ROWS, FACTORS, PASSES, BATCH = 4000, 4, 8, 12, 128
PULL, RATE, THRESHOLD = 2e-3, 0.08, 0.3
PREFIXES = range(4, 9)
#: The G statistic a term needs: chance alone passes it once in some 10,000 terms.
TELLING = 15.0
#: The standard deviations a pair's documents need at least to be apart from what the words' own weights say, pairs that
#: chance alone may put further apart, and the least variance that counts (8 documents at even odds).
APART, CHANCE, LEAST_VARIANCE = 5.5, 0.04, 2.0
#: Pairs counted at once: two numbers of four bytes each.
BLOCK = 1 << 24


@dataclass
class Model:
    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def word_terms(piece: str) -> tuple[int, ...]:
    """Hashed terms of a lower-cased run of letters and digits; those of whole words are even."""
    if len(piece) > WHOLE:
        return tuple({hashed("p " + x) | 1 for x in parts_of(piece)})
    return tuple({hashed("w " + piece) & ~1, *(hashed(f"{n} {piece[:n]}") | 1 for n in PREFIXES if len(piece) >= n)})


def pieces_of(text: str | None) -> set[str]:
    return set(PIECE.findall((text or "").lower()))


def text_terms() -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    known = Cached(word_terms)

    def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(sorted(set().union(*map(known.__getitem__, pieces_of(text)))), np.int64)
        return at, np.zeros(0)  # a term counts once: no values to send

    return terms


def telling(at: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Terms whose rows by label differ from the labels' shares beyond chance (G statistic, one degree of freedom)."""
    terms = frequent(at, LEAST_ROWS)
    both = np.stack([np.bincount(np.concatenate([a for a, z in zip(at, y, strict=True) if z == label]), minlength=DIMENSIONS)[terms] for label in (0, 1)]).astype(float)
    expected = both.sum(0) * (np.bincount(y, minlength=2) / len(y))[:, None]
    g = 2 * (both * np.log(np.maximum(both, 1e-9) / expected)).sum(0)
    return terms[g >= TELLING]


@dataclass
class Pairs:
    """Words (terms, in order) and the effects, in log odds, of pairs of their places; each pair stands in both orders."""

    words: np.ndarray
    one: np.ndarray
    other: np.ndarray
    effect: np.ndarray


def pairs_that_tell(at: list[np.ndarray], miss: np.ndarray, spread: np.ndarray) -> Pairs:
    """Pairs of words that tell the labels apart beyond the words' own weights.

    miss and spread are each document's label less its expected label, and that label's variance. What a word misses by
    itself isn't a pair's doing, so a pair must be further apart than either word. All pairs of words that could be far
    enough apart are counted, for a block of words at a time; the more there are, the further apart a pair must be.
    """
    own = [a[a % 2 == 0] for a in at]
    words = far_enough(own, miss, spread)
    place = np.full(DIMENSIONS, -1)
    place[words] = np.arange(len(words))
    own = [p[p >= 0] for p in (place[a] for a in own)]
    col, row = np.concatenate([*own, np.zeros(0, np.int64)]), np.repeat(np.arange(len(own)), [len(p) for p in own])
    alone = np.abs(np.bincount(col, miss[row], len(words))) / np.sqrt(np.bincount(col, spread[row], len(words)) + 0.5)
    apart = max(APART, NormalDist().inv_cdf(1 - CHANCE / max(len(words) * (len(words) - 1), 1)))
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    block = max(1, BLOCK // max(len(words), 1))
    for low in range(0, len(words), block):
        off, var = np.zeros((2, min(block, len(words) - low), len(words)), np.float32)
        for i, has in enumerate(own):
            first = has[np.searchsorted(has, low) : np.searchsorted(has, low + block)] - low
            if len(first):
                off[first[:, None], has] += miss[i]
                var[first[:, None], has] += spread[i]
        z = np.abs(off) / np.sqrt(var + 0.5)
        a, b = np.nonzero((var >= LEAST_VARIANCE) & (z >= apart))
        good = z[a, b] >= 1.5 * np.maximum(alone[b], alone[a + low])
        a, b = a[good], b[good]
        out.append((a + low, b, np.clip(off[a, b] / var[a, b], -4, 4)))
    one, other, effect = (np.concatenate([x[k] for x in out]) for k in range(3))
    found = np.unique(one)
    return Pairs(words[found], np.searchsorted(found, one), np.searchsorted(found, other), effect)


def far_enough(own: list[np.ndarray], miss: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Words that may be in a pair that is APART: of the documents with a word, some may be so, those that miss most for
    their variance first. No other word can be."""
    least = np.full(DIMENSIONS, -1)
    often = frequent(own, LEAST_ROWS)
    least[often] = np.arange(len(often))
    best = np.zeros(len(often))
    for side in (1, -1):
        rows = np.flatnonzero(side * miss > 0)
        rows = rows[np.argsort(-np.abs(miss[rows]) / np.maximum(spread[rows], 1e-12), kind="stable")]
        off, var = np.zeros((2, len(often)))
        for i in rows:
            has = least[own[i]]
            has = has[has >= 0]
            off[has] += abs(miss[i])
            # any documents with a variance from here on miss no more than these; pairs of less than LEAST_VARIANCE don't count
            best[has] = np.maximum(best[has], off[has] / np.sqrt(np.maximum(var[has], LEAST_VARIANCE) + 0.5))
            var[has] += spread[i]
    return often[best >= APART]


def first_factors(pairs: Pairs) -> np.ndarray:
    """Factors whose products come near to the effects of pairs: the largest eigenvectors, with a diagonal that allows roots."""
    n = len(pairs.words)
    diagonal = np.bincount(pairs.one, np.abs(pairs.effect), n)[:, None]
    draw = np.random.default_rng(3)
    q = draw.normal(size=(n, min(n, FACTORS)))
    values = np.zeros(q.shape[1])
    for _ in range(100 if n else 0):
        q, _ = np.linalg.qr(q)
        after = diagonal * q + sums(pairs.one, pairs.effect[:, None] * q[pairs.other], n)
        values = (q * after).sum(axis=0)
        q = after
    out = np.zeros((n, FACTORS))
    if n:
        out[:, : q.shape[1]] = np.linalg.qr(q)[0] * np.sqrt(np.maximum(values, 0))
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST) -> Model:
    kinds = labels.select("doc_id", (F.col(label).cast("int") > 0).cast("int").alias("toxic"))
    at, _, y = sparse_rows(labelled_sample(docs, kinds, "toxic", most), text_terms)
    if len(np.unique(y)) < 2:
        return Model(np.zeros(0, int), 40.0 if y.sum() else -40.0, np.zeros(0), np.zeros((0, FACTORS)))
    by_label = {r["toxic"]: r["n"] for r in kinds.dropna().where(~held_out(F.col("doc_id"))).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    start = float(np.log(y.mean() / (1 - y.mean())))
    terms = telling(at, y)
    rows = placed(at, terms)
    linear = descended(rows, y, Model(terms, start, np.zeros(len(terms)), np.zeros((len(terms), FACTORS))), 0)
    likely = sigmoid(np.array([raw_score(linear, own) for own in rows]))
    pairs = pairs_that_tell(at, y - likely, likely * (1 - likely))
    terms = np.union1d(terms, pairs.words).astype(np.int64)
    factors = np.random.default_rng(5).normal(0, 0.05, (len(terms), FACTORS))
    factors[np.searchsorted(terms, pairs.words)] += first_factors(pairs)
    model = descended(placed(at, terms), y, Model(terms, start, np.zeros(len(terms)), factors), 1)
    # the sample holds as many of each label as it may; the bias takes the labels' real shares back
    real = np.log(by_label.get(1, 1) / by_label.get(0, 1))
    return Model(terms, model.bias + real - float(np.log(y.sum() / (len(y) - y.sum()))), model.weights, model.factors)


def placed(at: list[np.ndarray], terms: np.ndarray) -> list[np.ndarray]:
    """Each document's places in `terms`."""
    place = np.full(DIMENSIONS, -1)
    place[terms] = np.arange(len(terms))
    return [p[p >= 0] for p in (place[a] for a in at)]


def descended(rows: list[np.ndarray], y: np.ndarray, model: Model, by_factors: int) -> Model:
    """The model after gradient descent on the sample; by_factors is 0 for the weights alone."""
    draw, bias, weights, factors = np.random.default_rng(7), model.bias, model.weights.copy(), model.factors.copy()
    sum_w, sum_v, sum_b = np.full(weights.shape, 1e-4), np.full(factors.shape, 1e-4), 1e-4
    for _ in range(PASSES):
        order = draw.permutation(len(rows))
        for low in range(0, len(order), BATCH):
            own = order[low : low + BATCH]
            col = np.concatenate([rows[i] for i in own])
            row = np.repeat(np.arange(len(own)), [len(rows[i]) for i in own])
            v = factors[col]
            total = sums(row, v, len(own))
            score = bias + np.bincount(row, weights[col], len(own)) + 0.5 * ((total**2).sum(1) - np.bincount(row, (v * v).sum(1), len(own)))
            miss = (sigmoid(score) - y[own]) / len(own)
            touched, where = np.unique(col, return_inverse=True)
            slope_w = np.bincount(where, miss[row], len(touched)) + PULL * weights[touched] / 10
            sum_w[touched] += slope_w**2
            weights[touched] -= RATE * slope_w / np.sqrt(sum_w[touched])
            if by_factors:
                slope_v = sums(where, miss[row][:, None] * (total[row] - v), len(touched)) + PULL * factors[touched]
                sum_v[touched] += slope_v**2
                factors[touched] -= RATE / 4 * slope_v / np.sqrt(sum_v[touched])
            sum_b += miss.sum() ** 2
            bias -= RATE * miss.sum() / np.sqrt(sum_b)
    return Model(model.terms, bias, weights, factors)


def sums(group: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of each group's rows."""
    return np.stack([np.bincount(group, rows[:, f], n) for f in range(rows.shape[1])], axis=1)


def raw_score(model: Model, has: np.ndarray) -> float:
    """The log odds of a text with these places of the model's terms."""
    v = model.factors[has]
    return model.bias + float(model.weights[has].sum()) + 0.5 * float((v.sum(0) ** 2).sum() - (v * v).sum())


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The documents as they are, with one more column: score (a `fresh` name, if taken)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")
    new = fresh(docs.columns, "score")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        own = sent.value
        at = np.full(DIMENSIONS, -1)
        at[own.terms] = np.arange(len(own.terms))
        # only terms of the model are kept with a word
        known = Cached(lambda word: tuple(int(at[t]) for t in word_terms(word) if at[t] >= 0))
        for batch in batches:
            out = [raw_score(own, np.array(sorted(set().union(*map(known.__getitem__, pieces_of(text)))), np.int64)) for text in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(np.array(out)), pa.float64())], names=[*batch.schema.names, new])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(new, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fit(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
