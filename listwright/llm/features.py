"""Hashed text terms and labelled samples for the two classifiers (operators 5 and 7)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget_others

#: Hashed dimensions, and words kept with their terms in a task; when full, the cache starts anew.
DIMENSIONS, CACHED_WORDS = 1 << 18, 300_000
#: Runs of letters and digits; longer ones (scripts without blanks, glued words) are known by all their runs of PART characters.
PIECE, WHOLE, PART = re.compile(r"[^\W_]+"), 24, 5


def hashed(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & (DIMENSIONS - 1)


def parts_of(piece: str) -> list[str]:
    """A run of letters and digits by itself, or all overlapping parts of a long one: nothing of it is left out."""
    if len(piece) <= WHOLE:
        return [piece]
    return list({piece[i : i + PART] for i in range(len(piece) - PART + 1)})


class Cached(dict):
    """word -> make(word), kept up to a bound."""

    def __init__(self, make: Callable[[str], object]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> object:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = value = self.make(word)
        return value


def fresh(columns: list[str], name: str) -> str:
    """`name`, with as many underscores behind it as no column of the caller has, whatever the case of letters."""
    known = {c.lower() for c in columns}
    while name.lower() in known:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2: no label of theirs is learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label): at most `most` documents of each label, those with the smallest hash of doc_id.

    That bounds what a fit gets: `most` documents of each label, each with its distinct terms, DIMENSIONS at most.
    A document with several labels has the smallest; null labels and held-out documents don't count. The sample's
    (doc_id, label) rows, at most `most` for each label, are what is broadcast to the documents.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).where(~held_out(F.col("doc_id")))
    grades = [r["label"] for r in known.groupBy("label").count().orderBy("label").collect()]
    chosen = None
    for grade in grades:
        own = known.where(F.col("label") == grade).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = own if chosen is None else chosen.unionByName(own)
    if chosen is None:
        chosen = known
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return text.join(F.broadcast(chosen), "doc_id")


def sparse_rows(sample: DataFrame, terms: Callable[[], Callable[[str], tuple[np.ndarray, np.ndarray]]]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(indices, values, labels) of a bounded sample; the terms are made in tasks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        make = terms()
        for batch in batches:
            found = [make(x) for x in batch.column(1).to_pylist()]
            cols = [batch.column(0), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([b.astype("<f4").tobytes() for _, b in found], pa.binary()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "at", "value", "label"])

    got = sample.select("doc_id", "text", "label").mapInArrow(rows, "doc_id long, at binary, value binary, label int").orderBy("doc_id", "at").collect()
    at = [np.frombuffer(r["at"], "<i4") for r in got]
    return at, [np.frombuffer(r["value"], "<f4") for r in got], np.array([r["label"] for r in got], np.int64)


def frequent(at: list[np.ndarray], least: int) -> np.ndarray:
    """Dimensions that at least `least` rows have, in order."""
    counts = np.bincount(np.concatenate(at) if at else np.zeros(0, int), minlength=DIMENSIONS)
    return np.flatnonzero(counts >= least)
