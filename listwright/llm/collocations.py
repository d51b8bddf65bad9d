"""Operator 12: collocations, by streams of counted phrases in prefix and in suffix order.

The layout is that of streaming language-model estimation. Phrases of one to three words are counted; a stream of the
counts sorted by their last words (suffix order) has, before each phrase, what it ends in, and one sorted by their first
words (prefix order) what it begins with. One pass over each stream, in step with the phrases that are shorter and stand
before their extensions, gives every phrase its right counts, its left counts and its most frequent extension on either
side: there is no table of counts to look anything up in, and no state but the last word and the last pair.

Counting. A task counts the phrases of some 2 MB of text at a time by sorting numbered words; Spark adds these up. Only
phrases that occur LEAST times matter, and those of three words have two such pairs in them, so the frequent pairs are
marked in a bitmap of FILTER bits (16 MB, whatever the corpus), and phrases of three words whose pairs aren't marked are
not counted at all. Pairs that share a bit with others are counted in vain, so nothing changes by it.

A very common word has very many extensions: streams are divided by the next word's hash too, with a copy of the first
word's count in each part.

Defined results. A null or empty text has no words; a null lang is `und`, an empty one a lang of its own. Repeated rows
count each. Texts are counted whole; one of more than SLICE bytes, a part between separators at a time. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Occurrences a candidate needs, rows of each lang, percent of a candidate that one longer phrase may hold.
LEAST, MOST, HELD = 10, 2000, 50
#: Parts of a lang that are ranked by themselves first.
RANKED = 8
#: Bits that mark frequent pairs, parts of a word's extensions, bytes of text counted at a time, rows of a sent batch.
FILTER, PARTS, SLICE, SENT = 1 << 27, 16, 1 << 21, 50_000
#: Bytes to bytes: A-Z to a-z, tabs to blanks, separators to one byte that no UTF-8 text has.
BREAK, NEXT = 0xFF, 0xFE
TO_BYTES = bytes(BREAK if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
COUNTS = "lang string, size int, phrase string, f long"


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """(langs, translated texts) of some SLICE bytes; longer texts are parted at separators, where there are any."""
    langs: list[str] = []
    texts: list[bytes] = []
    held = 0
    some = (batch.slice(low, 100) for batch in batches for low in range(0, batch.num_rows, 100))  # not all of a batch at once
    for batch in some:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            for part in parted(text.translate(TO_BYTES)):
                langs.append(lang)
                texts.append(part)
                held += len(part)
                if held >= SLICE:
                    yield langs, texts
                    langs, texts, held = [], [], 0
    if texts:
        yield langs, texts


def parted(text: bytes) -> Iterator[bytes]:
    low = 0
    while len(text) - low > SLICE:
        cut = text.rfind(BREAK, low, low + SLICE)
        cut = cut if cut >= 0 else text.find(BREAK, low + SLICE)
        if cut < 0:
            break
        yield text[low:cut]
        low = cut + 1
    yield text[low:]


class Numbered:
    """The words of some texts as numbers: `lang` and `word` of each place, -1 for a separator."""

    def __init__(self, langs: list[str], texts: list[bytes]) -> None:
        next_text = bytes([0x20, NEXT, 0x20])
        # a separator stands alone; so does what parts the texts, a byte that is put in afterwards
        own = next_text.join(t.replace(bytes([BREAK]), bytes([0x20, BREAK, 0x20])) for t in texts)
        places = pa.array(own.split(), pa.binary()).dictionary_encode()
        self.words = places.dictionary
        word = places.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = pc.index_in(pa.array([bytes([BREAK]), bytes([NEXT])], pa.binary()), self.words).to_pylist()
        known = pa.array(langs, pa.string()).dictionary_encode()
        self.langs = known.dictionary
        of_text = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lang = of_text[np.cumsum(word == ends[1])] if ends[1] is not None else np.full(len(word), of_text[0] if len(of_text) else 0)
        gap = np.isin(word, [e for e in ends if e is not None])
        self.word = np.where(gap, -1, word)

    def single(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of each place's word of its lang, langs, words, counts); -1 for a separator."""
        there = np.flatnonzero(self.word >= 0)
        kinds, number, counts = np.unique(self.lang[there] * len(self.words) + self.word[there], return_inverse=True, return_counts=True)
        at = np.full(len(self.word), -1)
        at[there] = number
        return at, kinds // len(self.words), kinds % len(self.words), counts

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of langs and of words."""
        return np.array([xxhash.xxh3_64_intdigest((x or "").encode()) for x in self.langs.to_pylist()], np.uint64), np.array([xxhash.xxh3_64_intdigest(w) for w in self.words.to_pylist()], np.uint64)


def pair_bits(lang: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The bit of a pair, from hashes."""
    x = (lang * np.uint64(0x9E3779B97F4A7C15)) ^ one
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + other
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(FILTER)).astype(np.int64)


def rows_of(text: Numbered, lang: np.ndarray, words: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(counts), SENT):
        own = slice(low, low + SENT)
        parts = [text.words.take(pa.array(w[own])) for w in words]
        phrase = pc.binary_join_element_wise(*parts, b" ") if len(parts) > 1 else parts[0]
        cols = [text.langs.take(pa.array(lang[own])), pa.array(np.full(len(phrase), len(words), np.int32)), phrase.cast(pa.string()), pa.array(counts[own])]
        yield pa.RecordBatch.from_arrays(cols, names=["lang", "size", "phrase", "f"])


def words_and_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and pairs of each slice, and each lang's words (size 0)."""
    for langs, texts in slices(batches):
        text = Numbered(langs, texts)
        at, lang, word, counts = text.single()
        if not len(counts):
            continue
        yield from rows_of(text, lang, [word], counts)
        kinds, which = np.unique(lang, return_inverse=True)
        total = np.bincount(which, counts).astype(np.int64)
        cols = [text.langs.take(pa.array(kinds)), pa.array(np.zeros(len(kinds), np.int32)), pa.array([""] * len(kinds)), pa.array(total)]
        yield pa.RecordBatch.from_arrays(cols, names=["lang", "size", "phrase", "f"])
        two = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
        pairs, counts = np.unique(at[two] * len(word) + at[two + 1], return_counts=True)
        one, other = pairs // len(word), pairs % len(word)
        yield from rows_of(text, lang[one], [word[one], word[other]], counts)


def triples(bitmap: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of phrases of three words both of whose pairs are marked."""
    marked = np.frombuffer(bitmap.value, np.uint8)
    for langs, texts in slices(batches):
        text = Numbered(langs, texts)
        of_lang, of_word = text.hashes()
        two = np.flatnonzero((text.word[:-1] >= 0) & (text.word[1:] >= 0))
        bit = pair_bits(of_lang[text.lang[two]], of_word[text.word[two]], of_word[text.word[two + 1]])
        good = two[(marked[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
        first = good[np.isin(good + 1, good, assume_unique=True)]
        if not len(first):
            continue
        at, lang, word, _ = text.single()
        kinds, number = np.unique(at[first] * len(word) + at[first + 1], return_inverse=True)
        three, counts = np.unique(number * len(word) + at[first + 2], return_counts=True)
        pair, last = kinds[three // len(word)], three % len(word)
        yield from rows_of(text, lang[pair // len(word)], [word[pair // len(word)], word[pair % len(word)], word[last]], counts)


def added(counts: DataFrame, least: int) -> DataFrame:
    """The counts of all slices together; of each lang's words, and of phrases that occur often enough."""
    return counts.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("size") == 0))


def pair_bitmap(counts: DataFrame) -> bytes:
    """FILTER bits, those of the counted pairs set. The driver gets FILTER / 8 bytes at most."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [[xxhash.xxh3_64_intdigest(x.encode()) for x in (lang, *phrase.split(" "))] for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            own = np.array(digests, np.uint64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(pair_bits(own[:, 0], own[:, 1], own[:, 2]))], names=["bit"])

    block = 1 << 15
    found = counts.where("size = 2").select("lang", "phrase").mapInArrow(bits, "bit long").groupBy(F.floor(F.col("bit") / block).alias("block")).agg(F.bitmap_construct_agg(F.col("bit") % block).alias("bits"))
    out = bytearray(FILTER // 8)
    for r in found.toLocalIterator():
        out[r["block"] * block // 8 : (r["block"] + 1) * block // 8] = r["bits"]
    return bytes(out)


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, size, phrase, f) of the phrases of one to three words that occur `least` times, and of size 0 each lang's
    number of words."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = written(added(rows.mapInArrow(words_and_pairs, COUNTS), least), "collocations-short")
    bitmap = docs.sparkSession.sparkContext.broadcast(pair_bitmap(short))
    return short.unionByName(added(rows.mapInArrow(lambda batches: triples(bitmap, batches), COUNTS), least))


def stream(rows: DataFrame, order: str) -> DataFrame:
    """Rows dealt by ranges of their first words in `order` and sorted, so that a phrase stands before its extensions.

    The extensions of a word are in PARTS parts by their second word, and its own row in each: every part is a stream
    that needs no other. Two phrases with the same first two words are in one part.
    """
    own = F.col(order)
    part = F.when(F.size(own) > 1, F.array(F.pmod(F.xxhash64(own[1]), F.lit(PARTS)).cast("int"))).otherwise(F.array(*map(F.lit, range(PARTS))))
    return rows.withColumns({"first": own[0], "part": F.explode(part)}).repartitionByRange("lang", "first", "part").sortWithinPartitions("lang", "first", "part", order)


def in_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a stream (..., size, f): each phrase with the counts of the word and of the pair it extends, which
    stand before it, and its most frequent extension.

    What goes from batch to batch is the last word's and the last pair's count, and the last pair's row, which waits for
    its extensions.
    """
    one = two = longest = 0
    waiting: pa.RecordBatch | None = None

    def out(rows: pa.RecordBatch, *more: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(x, pa.int64()) for x in more)], names=[*rows.schema.names, "by_one", "by_two", "extension"])

    for batch in batches:
        size, f = batch.column("size").to_numpy(), batch.column("f").to_numpy()
        if not len(f):
            continue
        place = np.arange(len(f))
        last_one, last_two = (np.maximum.accumulate(np.where(size == k, place, -1)) for k in (1, 2))
        by_one, by_two = np.where(last_one >= 0, f[last_one], one), np.where(last_two >= 0, f[last_two], two)
        longer = np.where(size == 3, f, 0)
        heads = np.flatnonzero(size < 3)  # a word or a pair; the pair's extensions follow it
        if not len(heads):
            longest = max(longest, int(longer.max()))
            yield out(batch, by_one, by_two, np.zeros(len(f)))
            continue
        if waiting is not None:
            yield out(waiting, np.array([one]), np.array([two]), np.array([max(longest, int(longer[: heads[0]].max(initial=0)))]))
            waiting = None
        extension = np.zeros(len(f), np.int64)
        extension[heads] = np.maximum.reduceat(longer, heads)
        chosen = place
        if size[heads[-1]] == 2:
            waiting, longest = batch.take(pa.array(heads[-1:])), int(extension[heads[-1]])
            chosen = np.delete(place, heads[-1])
        yield out(batch.take(pa.array(chosen)), by_one[chosen], by_two[chosen], extension[chosen])
        one, two = int(by_one[-1]), int(by_two[-1])
    if waiting is not None:
        yield out(waiting, np.array([one]), np.array([two]), np.array([longest]))


def candidates(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, size, a, l1, r1, l2, r2, extension) of the phrases of two and three words.

    l1 and r1 belong to the cut after the first word, l2 and r2 to that after the second (phrases of three words only).
    """
    rows = counts.where("size > 0").withColumn("words", F.split("phrase", " "))
    shape = "lang string, words array<string>, size int, f long"
    ends = stream(rows.select("lang", "words", "size", "f", F.reverse("words").alias("ends")), "ends")
    ended = ends.select("lang", "words", "size", "f").mapInArrow(in_step, f"{shape}, by_one long, by_two long, extension long")
    alone = rows.where("size = 1").select("lang", "words", "size", "f", *(F.lit(0).cast("long").alias(c) for c in ("last_one", "last_two", "left_extension")))
    known = ended.where("size > 1").select("lang", "words", "size", "f", F.col("by_one").alias("last_one"), F.col("by_two").alias("last_two"), F.col("extension").alias("left_extension")).unionByName(alone)
    begun = stream(known, "words").select("lang", "words", "size", "f", "last_one", "last_two", "left_extension")
    both = begun.mapInArrow(in_step, f"{shape}, last_one long, last_two long, left_extension long, by_one long, by_two long, extension long").where("size > 1")
    three = F.col("size") == 3
    return both.select(
        "lang", F.array_join("words", " ").alias("phrase"), "size", F.col("f").alias("a"), F.col("by_one").alias("l1"), F.when(three, F.col("last_two")).otherwise(F.col("last_one")).alias("r1"),
        F.when(three, F.col("by_two")).alias("l2"), F.when(three, F.col("last_one")).alias("r2"), F.greatest("left_extension", "extension").alias("extension"),
    )


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, held: int = HELD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's `most` best candidates."""
    counts = written(phrase_counts(docs, least), "collocations-counts")
    # whole numbers of 38 digits: exact up to 10^16 occurrences of one phrase
    score = lambda k: F.expr(f"CAST(1000000 AS DECIMAL(38,0)) * (CAST(a AS DECIMAL(20,0)) * a) div (CAST(l{k} AS DECIMAL(20,0)) * r{k})")
    scored = candidates(counts).where(F.col("extension") * 100 < F.col("a") * held).withColumns({"s1": score(1), "s2": score(2)})
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    pick = lambda x: F.when(second, F.col(f"{x}2")).otherwise(F.col(f"{x}1"))
    rows = scored.select("lang", "phrase", "a", pick("l").alias("l"), pick("r").alias("r"), pick("s").alias("score"))
    # the first of each of RANKED parts of a lang, then the first of these: however many tasks there are, one gets RANKED * most rows
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED)))
    some = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("_n") <= most).drop("_n", "part")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    words = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
