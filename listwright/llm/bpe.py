"""Operator 9: byte-level BPE encoding and decoding by DuckDB recursive queries, one per partition's new words.

A task cuts each text into words by the pattern and looks up those it hasn't met. They become rows (word, position,
token); the recursive query joins neighbouring rows to the merge table, contracts each word's leftmost pair of minimum
rank and ends where no word has a pair left. A query goes through `ROUNDS` rounds at most; what isn't done then begins
the next one, so that a word of any length is contracted in the same way with bounded memory. Pairs of the same rank
are contracted in one round if the token that they make is part of no pair of a smaller rank, which could come between,
and can't overlap itself; else only the leftmost is. Decoding begins at a document's ids: rows (document, position, token) meet the
vocabulary, and an ordered aggregation makes the bytes.

Where the pattern begins a match at each space that follows a character other than white space, and letters, with or
without a space before them, or any match that stands alone, are one match (`space_led`), a text without white space before a space is cut there first, and the words of such a
part are remembered together.

Defined results. A null or empty text has no tokens and the digests of no bytes. Rows are encoded as they come, so
repeated rows and null doc_ids stay. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, forget_others

#: Words that one query takes, rounds that it goes, documents decoded at once, and words and parts of texts kept in a
#: Python worker (some 150 bytes each); when full, the cache starts anew.
WORDS_AT_ONCE, ROUNDS, DOCUMENTS, CACHED_WORDS = 40_000, 64, 500, 800_000
AMONG_SPACES = re.compile(r"^ |\s ")
#: One character of each class that patterns ask for: letters, numbers, white space, all else. None is in a pattern itself.
CLASSES = {"L": "\u03b1", "N": "\u0663", "S": "\u2003", "O": "\u00a7"}
#: Planes that have characters with a class of their own.
PLANES = (0, 1, 2, 3, 14)

#: A row's spot is its word's number << 32 | its place in the word: one number to sort by.
ENCODE = f"""
WITH RECURSIVE state(round, spot, tok) AS (
  SELECT 0, spot, tok FROM letters
  UNION ALL (
    WITH beside AS (
      SELECT round, spot, tok, lead(spot) OVER own AS next_spot, lead(tok) OVER own AS following, lag(spot) OVER own AS last_spot, lag(tok) OVER own AS before
      FROM state WHERE round < {ROUNDS} WINDOW own AS (ORDER BY spot)),
    paired AS (
      SELECT *, CASE WHEN next_spot >> 32 = spot >> 32 THEN tok::BIGINT << 32 | following END AS pair,
        CASE WHEN last_spot >> 32 = spot >> 32 THEN before::BIGINT << 32 | tok END AS last_pair FROM beside),
    ranked AS (
      SELECT p.*, m.rank, m.quiet FROM paired p LEFT JOIN merges m USING (pair)),
    best AS (
      SELECT spot >> 32 AS word, min(rank::BIGINT << 32 | (spot & 4294967295)) AS first FROM ranked WHERE rank IS NOT NULL GROUP BY 1)
    SELECT r.round + 1, r.spot,
      CASE WHEN r.rank = first >> 32 AND (r.quiet OR r.spot & 4294967295 = first & 4294967295) THEN r.rank ELSE r.tok END
    FROM ranked r JOIN best ON word = r.spot >> 32 LEFT JOIN merges b ON b.pair = r.last_pair
    WHERE (b.rank = first >> 32 AND (b.quiet OR r.last_spot & 4294967295 = first & 4294967295)) IS NOT TRUE)),
final AS (SELECT spot >> 32 AS word, max(round) AS round FROM state GROUP BY 1)
SELECT spot, tok, s.round FROM state s JOIN final f ON f.word = s.spot >> 32 AND f.round = s.round ORDER BY spot
"""
DECODE = "SELECT list(bytes ORDER BY place) AS parts FROM coded JOIN vocabulary USING (tok)"


@lru_cache(1)
def unlike_characters() -> tuple[tuple[int, str], ...]:
    """(code point, stand-in) of the characters whose class in this process is another than the library's.

    The library and Python follow different versions of Unicode. What the library takes a character for shows in whether
    it cuts the character from a letter, a digit or a sign before it: a token of that and of the character's first byte
    is only made where it doesn't.
    """
    import regex
    import tiktoken

    codes = [c for plane in PLANES for c in range(plane << 16, (plane + 1) << 16) if not 0xD800 <= c < 0xE000]
    letters = {m.start() for m in regex.finditer(r"\p{L}", "".join(map(chr, codes)))}
    numbers = {m.start() for m in regex.finditer(r"\p{N}", "".join(map(chr, codes)))}
    blanks = {m.start() for m in regex.finditer(r"\s", "".join(map(chr, codes)))}
    theirs = ["S"] * len(codes)
    for name, before in (("L", "a"), ("N", "1"), ("O", "!")):
        ranks = {bytes([i]): i for i in range(256)} | {before.encode() + bytes([i]): 256 + i for i in range(256)}
        probe = tiktoken.Encoding("probe", pat_str=r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s", mergeable_ranks=ranks, special_tokens={})
        for low in range(0, len(codes), 4096):
            own = codes[low : low + 4096]
            ids = np.array(probe.encode_ordinary("".join(f"\n{before}{chr(c)}" for c in own)))
            sizes = np.where(ids < 256, 1, 2)
            starts = np.cumsum(sizes) - sizes
            at = np.cumsum([0] + [2 + len(chr(c).encode()) for c in own])[:-1] + 1
            joined = ids[np.searchsorted(starts, at)] >= 256
            for k in np.flatnonzero(joined).tolist():
                theirs[low + k] = name
    ours = ("L" if k in letters else "N" if k in numbers else "S" if k in blanks else "O" for k in range(len(codes)))
    return tuple((c, CLASSES[b]) for c, a, b in zip(codes, ours, theirs, strict=True) if a != b or chr(c).isalpha() != (b == "L"))


class Words:
    """The merge table in DuckDB, with the words met so far. One for each Python worker, which serves many tasks."""

    def __init__(self, ranks_path: str, pattern: str, space_led: bool, unlike: tuple[tuple[int, str], ...] = ()) -> None:
        import duckdb
        import regex

        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.stand_ins = dict(unlike)
        self.unlike = frozenset(map(chr, self.stand_ins))
        self.space_led = space_led
        self.known: dict[str, bytes] = {}
        own = self.ranks
        merges = np.array([(own[t[:i]], own[t[i:]], r) for t, r in own.items() for i in range(1, len(t)) if t[:i] in own and t[i:] in own], np.int64).reshape(-1, 3)
        early = merges[:, 2] <= merges[:, :2].max(axis=1)  # a token of such a pair may be made after the pair is due
        loud = np.union1d(merges[early, :2][merges[early, :2] >= merges[early, 2:]], [r for t, r in own.items() if any(t[:k] == t[-k:] for k in range(1, len(t)))])
        self.byte_ids = np.array([own[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.load("merges", pa.table({"pair": merges[:, 0] << 32 | merges[:, 1], "rank": merges[:, 2].astype(np.int32), "quiet": ~np.isin(merges[:, 2], loud)}))
        self.load("vocabulary", pa.table({"tok": pa.array(list(own.values()), pa.int32()), "bytes": pa.array(list(own), pa.binary())}))

    def load(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def find(self, text: str) -> list[str]:
        """The matches of the pattern, with each character taken for what the library takes it for."""
        if text.isascii() or self.unlike.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stand_ins))]

    def divided(self, text: str | None) -> list[str]:
        """The words of a text, or parts of it between which no match of the pattern goes on."""
        if not text:
            return []
        if not self.space_led or AMONG_SPACES.search(text):
            return self.find(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def learn(self, parts: set[str]) -> None:
        """Puts the ids of all `parts` into `known`, as bytes."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = parts - self.known.keys()
        several = {x: own for x in new if not self.one_word(x) and len(own := self.find(x)) != 1} if self.space_led else {}
        self.learn_words((new - several.keys()).union(*several.values()))
        known = self.known
        known.update((x, b"".join([known[w] for w in own])) for x, own in several.items())

    def one_word(self, part: str) -> bool:
        """Letters alone, whatever the version of Unicode, behind a blank or none."""
        return (part[0] == " " or part[0].isalpha()) and part[1:].isalpha() and (part.isascii() or self.unlike.isdisjoint(part))

    def learn_words(self, words: set[str]) -> None:
        waiting: list[tuple[str, bytes]] = []
        for w in words - self.known.keys():
            code = w.encode()
            if code in self.ranks:  # a whole token is never divided
                self.known[w] = np.array([self.ranks[code]], "<u4").tobytes()
            else:
                waiting.append((w, code))
        for low in range(0, len(waiting), WORDS_AT_ONCE):
            own = waiting[low : low + WORDS_AT_ONCE]
            sizes = np.array([len(c) for _, c in own])
            letters = np.frombuffer(b"".join(c for _, c in own), np.uint8)
            word = np.repeat(np.arange(len(own)), sizes)
            place = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rows = pa.table({"spot": word << 32 | place, "tok": self.byte_ids[letters]})
            while len(rows):
                self.load("letters", rows)
                got = self.db.execute(ENCODE).fetchnumpy()
                going = got["round"] >= ROUNDS
                rows = pa.table({k: got[k][going] for k in ("spot", "tok")})
                done, ids = got["spot"][~going] >> 32, got["tok"][~going].astype("<u4").tobytes()
                borders = [*np.flatnonzero(np.diff(done, prepend=-1)).tolist(), len(done)]
                for k, a, b in zip(done[borders[:-1]].tolist(), borders[:-1], borders[1:], strict=True):
                    self.known[own[k][0]] = ids[4 * a : 4 * b]

    def decoded(self, codes: list[bytes]) -> list[bytes]:
        """The bytes of documents given by their ids: those of all tokens in order, cut at the documents' ends."""
        sizes = [len(c) // 4 for c in codes]
        ids = np.frombuffer(b"".join(codes), "<u4").astype(np.int32)
        if not len(ids):
            return [b""] * len(codes)
        self.load("coded", pa.table({"place": np.arange(len(ids)), "tok": ids}))
        parts = self.db.sql(DECODE).to_arrow_table()["parts"].combine_chunks()
        parts = parts.chunk(0) if isinstance(parts, pa.ChunkedArray) else parts
        tokens = parts[0].values
        ends, data = spread(tokens)
        at = ends[np.cumsum([0, *sizes])].tolist()
        return [data[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def spread(parts: pa.Array) -> tuple[np.ndarray, bytes]:
    """The ends of a binary array's items, and all of them one after another, as they lie in its buffer."""
    kind = np.int64 if pa.types.is_large_binary(parts.type) else np.int32
    ends = np.frombuffer(parts.buffers()[1], kind)[parts.offset : parts.offset + len(parts) + 1]
    return ends - ends[0], parts.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes()


@lru_cache(1)
def words_of(ranks_path: str, pattern: str, space_led: bool, unlike: tuple[tuple[int, str], ...]) -> Words:
    return Words(ranks_path, pattern, space_led, unlike)


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False, space_led: bool = False) -> DataFrame:
    """One row per document with digests; with_ids adds the ids themselves and the decoded text."""

    unlike = unlike_characters()

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(ranks_path, pattern, space_led, unlike)
        KEPT["bpe"] = words.known
        forget_others("bpe")
        for batch in batches:
            for low in range(0, batch.num_rows, DOCUMENTS):
                ids = batch.column(0).slice(low, DOCUMENTS)
                texts = [words.divided(x) for x in batch.column(1).slice(low, DOCUMENTS).to_pylist()]
                words.learn(set().union(*texts))
                code = [b"".join(map(words.known.__getitem__, own)) for own in texts]
                back = words.decoded(code)
                cols = [ids, pa.array([len(c) // 4 for c in code], pa.int64()), *(pa.array([hashlib.sha256(x).hexdigest() for x in own], pa.string()) for own in (code, back))]
                names = OUT.split(", ")
                if with_ids:
                    cols += [pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in code], pa.list_(pa.int32())), pa.array([b.decode() for b in back], pa.string())]
                    names = [*names, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in names])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(codes, OUT + ", ids array<int>, decoded string" * with_ids)
