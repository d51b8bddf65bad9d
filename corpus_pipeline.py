"""A corpus pipeline over `documents`: quality, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, and all but the last return the columns
of docs with the caller's values, whatever other columns there are. Rows with null or empty texts pass the filters by
the same scores as any other row. An empty table gives no rows at any stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm import minhash, packing, quality, substring, toxicity
from listwright.llm.common import table, written
from listwright.llm.queries import tokenizer_file

#: No stage but the near duplicates is expressible in SQL.
ORACLE_SQL = None


def good_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of the better grade is below quality.LEAST.

    A row's own text decides, so repeated rows stay or go together; a probability of just the limit stays.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return chosen(docs, quality.scored(docs, model), 1, lambda p: p >= quality.LEAST)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity reaches toxicity.THRESHOLD; repeated rows stay or go together."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return chosen(docs, toxicity.scored(docs, model), 0, lambda p: p < toxicity.THRESHOLD)


def chosen(docs: DataFrame, scored: DataFrame, place: int, good: Callable[[Column], Column]) -> DataFrame:
    """The rows of good scores; the score is the column `place` columns behind the document's own."""
    return scored.where(good(F.col(scored.columns[len(docs.columns) + place]))).select(*(F.col(f"`{c}`") for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, that of smallest doc_id.

    Of rows that repeat doc_id and text one stays; unlike texts of one doc_id are unlike documents; rows without a
    doc_id, and documents without words, are linked with nothing and stay.
    """
    return minhash.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages out of texts that occur in an earlier document; no document goes, though a text may become empty.

    Of repeated rows the first keeps its text. n_chars is counted anew.
    """
    return substring.deduplicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' tokens in sequences. A null or empty text is its closing id; repeated rows count each."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_enough),
    ("toxicity", not_toxic),
    ("minhash_near_dedup", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
