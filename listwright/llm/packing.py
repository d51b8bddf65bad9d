"""Operator 8: packing documents into sequences by exact complements, then best fit.

`tokenized_pieces` cuts each document's ids into pieces of at most `capacity`. `packing_plan` works on the counts of
each length: at most `capacity` numbers, however many documents there are. `packed` gives each piece a place.

Defined results. A null or empty text is the closing id alone. Rows are packed as they come: repeated rows and null
doc_ids are documents of their own. An empty table gives no rows. Texts of any length are cut into as many pieces as
they need. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, forget_others, written

CAPACITY = 4096
END_ID = 1
#: Words kept with their ids in a Python worker (about 200 bytes each); when full, the cache starts anew.
CACHED_WORDS = 800_000
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SPLIT_ALONE = re.compile("[\x1c-\x1f\u03a3\u0130]")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


class Letters(dict):
    """character -> whether the tokenizer cuts it from punctuation before and after it, and from nothing else in it."""

    def __init__(self, encoder: object) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, c: str) -> bool:
        pieces = [x for x, _ in self.encoder.pre_tokenizer.pre_tokenize_str(self.encoder.normalizer.normalize_str(f"!a{c}b!"))]
        self[c] = found = len(pieces) == 3
        return found


class Words:
    """A tokenizer with the ids of words it has met, as bytes. One for each Python worker, which serves many tasks.

    The tokenizer's added tokens have their ids where their exact strings stand in a text (`parts` cuts there first).
    What is left between them has none, though lower-casing may make such a string: that is cut as any other word.
    A run of letters, or of punctuation, is one word to the tokenizer, so such runs are encoded many at a time and
    their ids divided at the tokens that end a word. Words of both are put together; all else is encoded alone.
    """

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(tokenizer)
        self.encoder.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in self.encoder.get_added_tokens_decoder().items()}
        self.border = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.letter = Letters(self.encoder)
        vocabulary = self.encoder.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def parts(self, text: str | None) -> list[str | bytes]:
        """The words of a text, and the ids, as bytes, of the added tokens that stand between them."""
        if not text or not any(token in text for token in self.added):
            return in_words(text)
        out: list[str | bytes] = []
        for k, part in enumerate(self.border.split(text)):
            out += [self.added[part]] if k % 2 else in_words(part)
        return out

    def letters(self, word: str) -> bool:
        """Whether the tokenizer takes all characters for letters, when it has lower-cased them: some become a letter and
        a mark, and its version of Unicode isn't Python's."""
        return word.isascii() and word.isalpha() or word.isalpha() and all(map(self.letter.__getitem__, word))

    def learn(self, words: set[str | bytes]) -> None:
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        known.update((x, x) for x in self.added.values())  # ids stand for themselves
        runs, mixed, other = [], [], []
        for w in words - known.keys():
            core = w.rstrip(PUNCTUATION)
            if core == w or not core:
                (runs if not core or self.letters(w) else other).append(w)
            elif self.letters(core):
                mixed.append((w, core, w[len(core) :]))
            else:
                other.append(w)
        runs += {x for _, core, tail in mixed for x in (core, tail)} - known.keys() - set(runs)
        for low in range(0, len(runs), 1000):
            own = runs[low : low + 1000]
            (code,) = self.encoder.encode_batch_fast([" ".join(own)], add_special_tokens=False)
            ids = np.array(code.ids, "<u4")
            ends = (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()
            buffer, start = ids.tobytes(), 0
            if len(ends) != len(own):
                other += own
                continue
            for w, end in zip(own, ends, strict=True):
                known[w] = buffer[start:end]
                start = end
        for w in other:
            known[w] = np.array(self.encoder.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        for w, core, tail in mixed:
            known[w] = known[core] + known[tail]


@lru_cache(1)
def words_of(tokenizer: str) -> Words:
    return Words(tokenizer)


def in_words(text: str | None) -> list[str]:
    """Pieces of a text between which the tokenizer never joins characters, lower-cased as it does it.

    str.split() also splits at four control characters that aren't white space to the tokenizer, and the final form of
    one Greek letter depends on what follows: texts with these keep what they have.
    """
    if not text:
        return []
    if SPLIT_ALONE.search(text):
        return re.split("[ \n]+", text)
    return text.lower().split()


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document. `part` and `local_rank` number the pieces of one length within a task."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        KEPT["packing"] = words.known
        forget_others("packing")
        ranks: Counter[int] = Counter()
        part, end = TaskContext.get().partitionId(), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for low in range(0, batch.num_rows, 200):
                texts = [words.parts(x) for x in batch.column(1).slice(low, 200).to_pylist()]
                words.learn(set().union(*texts))
                for doc, own in zip(ids[low : low + 200], texts, strict=True):
                    code = b"".join(map(words.known.__getitem__, own)) + end
                    for k, at in enumerate(range(0, len(code), 4 * capacity)):
                        piece = code[at : at + 4 * capacity]
                        n = len(piece) // 4
                        out.append((doc, k, at // 4, n, zlib.crc32(piece), part, ranks[n]))
                        ranks[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)


class Sums:
    """Index of the sums of one, two and three lengths: for each sum, lengths that make it.

    pair[s] is the larger length of a pair of sum s, triple[s] the largest of three; 0 where there is none. The index is
    made once. Lengths get used up, so what it names is checked against the counts; where they don't suffice any more,
    another combination of that sum is looked for and put into the index.
    """

    def __init__(self, counts: np.ndarray) -> None:
        capacity = len(counts) - 1
        self.pair, self.triple = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
        lengths = np.flatnonzero(counts)
        for a in lengths:  # ascending: the largest first member stays
            b = lengths[(lengths <= min(a, capacity - a)) & ((lengths < a) | (counts[a] > 1))]
            self.pair[a + b] = a
        pairs = np.flatnonzero(self.pair)
        for a in lengths:
            two = pairs[(pairs <= capacity - a) & (self.pair[pairs] <= a)]
            self.triple[a + two] = a

    def two(self, total: int, free: np.ndarray, top: int) -> list[int] | None:
        """Two lengths, at most `top`, of this sum that are there."""
        if not self.pair[total]:
            return None  # counts only fall
        own = [int(self.pair[total]), total - int(self.pair[total])]
        if own[0] <= top and self.there(own, free):
            return own
        a = np.flatnonzero(free[: min(total, top + 1)] > 0)
        a = a[a * 2 >= total]
        a = a[(free[total - a] > 0) & ((a * 2 != total) | (free[a] > 1))]
        if not len(a):
            return None
        self.pair[total] = max(self.pair[total], a[-1]) if own[0] > top else a[-1]
        return [int(a[-1]), total - int(a[-1])]

    def three(self, total: int, free: np.ndarray) -> list[int] | None:
        if not self.triple[total]:
            return None
        tries = [int(self.triple[total])]
        a = np.flatnonzero(free[:total] > 0)
        tries += a[a * 3 >= total][::-1].tolist()
        for x in tries:
            two = self.two(total - x, free, x)
            if two and self.there([x, *two], free):
                self.triple[total] = x
                return [x, *two]
        return None

    def exact(self, gap: int, free: np.ndarray) -> list[int] | None:
        """One, two or three lengths that are there and fill the gap."""
        return [gap] if free[gap] > 0 else self.two(gap, free, gap) or self.three(gap, free)

    @staticmethod
    def there(own: list[int], free: np.ndarray) -> bool:
        return all(free[x] >= own.count(x) for x in own)


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, copies in a bin, bins, first bin, offset): which pieces of a length go where.

    A bin starts with the longest lengths left. Once three pieces could fill its gap, the gap is looked up among the
    lengths left and the indexed sums of two and of three of them (`Sums`), as far as the counts allow; if none is
    exact, the longest that fits goes in (best fit) and the lookup is repeated. A bin is repeated as often as the counts
    allow, so each step uses up a length: the plan has at most `capacity` kinds of bins.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    used = np.zeros(capacity + 1, np.int64)
    plan, bins, sums = [], 0, Sums(left)
    while (lengths := np.flatnonzero(left)).size:
        free, gap, own = left.copy(), capacity, []
        while gap:
            fits = np.flatnonzero(free[: gap + 1] > 0)
            if not fits.size:
                break
            longest = int(fits[-1])
            more = sums.exact(gap, free) if own and gap <= 3 * longest else None
            if more is None:  # the longest that fits, as often as three more of it would still fit
                n = max(1, min(int(free[longest]), gap // longest - 3)) if own else 1
                more = [longest] * n
            for x in more:
                free[x] -= 1
                gap -= x
            own += more
        uses = Counter(own)
        times = min(int(left[x]) // n for x, n in uses.items())
        at = 0
        for x, n in sorted(uses.items(), reverse=True):
            plan.append((x, used[x], n, times, bins, at))
            at += x * n
            used[x] += n * times
            left[x] -= n * times
        bins += times
    return np.array(plan, np.int64).reshape(-1, 6)


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Each piece with sequence_id and offset; pieces from `tokenized_pieces`, written to a table.

    Only counts by length reach the driver: `capacity` numbers at most. The plan sent out is of that order as well. A
    length that holds most rows isn't gathered: its pieces are numbered within each task, and counts by task shift
    those numbers.
    """
    spark = pieces.sparkSession
    by_part = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = packing_plan(counts, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    sent = spark.sparkContext.broadcast(plan)
    shift = by_part.select(
        F.col("part").alias("of_part"),
        F.col("length").alias("of_length"),
        F.expr("sum(n) over (partition by length order by part) - n").alias("shift"),
    )
    # as many rows as tasks x lengths: never broadcast
    ranked = pieces.join(shift.hint("merge"), (F.col("part") == F.col("of_part")) & (F.col("length") == F.col("of_length")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("local_rank") + F.col("shift")).alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        keys = own[:, 0] << 48 | own[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = own[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            q, k = np.divmod(rank - row[:, 1], row[:, 2])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 4] + q), pa.array(row[:, 5] + k * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return packed(written(tokenized_pieces(docs, tokenizer, capacity), "packing-pieces"), capacity)
