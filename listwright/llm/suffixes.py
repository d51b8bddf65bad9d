"""Operator 2: suffix-array deduplication by a distributed, common-prefix-aware merge sort.

Every byte covered by a `length`-byte string that also starts anywhere else goes, first occurrences included. Sorting
the suffix at each byte would move the corpus hundreds of times over, so only suffixes at anchors are sorted, which
decide all others exactly:

1. The anchor of a window of `length` bytes is the place in it where a gear hash of 32 bytes is least (leftmost of
   equals) among its first `SPAN` places. Equal windows have their anchors at the same offset. An anchor serves a run
   of windows; all of them hold the bytes from 31 before it to `length - SPAN - 31` after (its core). Anchors whose
   core's hash occurs once in the corpus can have no repeated window and are dropped.
2. Of the others, a task sorts the suffixes (bytes from the anchor on, as far as its windows reach), joins equal ones,
   and writes them as front-coded runs: common prefix with the one before, and the rest. Runs are exchanged by core.
3. A receiver merges its runs by a loser tree that knows each head's common prefix with the last one taken: two heads
   are compared by these numbers, and byte by byte only from an equal one on. The merged order with its common prefixes
   is the suffix array with LCPs of that core.
4. Two suffixes that share R bytes from the anchor on and L bytes before it share L + R bytes; from `length` on, these
   are covered. The LCPs' tree is walked from the deepest prefix up; each set's bytes before the anchor, read backwards,
   are kept sorted, and the smaller of two sets is put into the larger. A suffix's best partner at a depth is its
   neighbour then, so a core with n different suffixes takes n log^2 n steps, not n^2.

Memory: a task holds runs of `RUN_BYTES`, a receiver the distinct suffixes of its bucket; buckets follow the number of
anchors left. A core with more than `HOT_ANCHORS` anchors (a passage that very many documents share) would be one bucket
that grows with the corpus. Its anchors go another way, as exact (`hot_spans`): an anchor is covered wholly if all bytes
of its windows stand elsewhere, which one digest tells; of the others, those at a passage's ends, each window's digest is
counted. Both are aggregations that combine in the tasks, and nothing of a core is gathered.

Defined results. A null or empty text has no bytes, no spans and the digest of nothing. Repeated rows of a doc_id, and
null doc_ids, are documents of their own, and copies of each other if their texts are. Texts shorter than `length` bytes
lose nothing. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .substring import gear_hash, identified

LENGTH, SPAN, GRAM = 400, 256, 32
#: Bytes of suffixes that a task sorts at once, and anchors of a bucket.
RUN_BYTES, BUCKET_ANCHORS = 24 << 20, 60_000
#: Anchors of a core that are merged in one bucket at most, and windows whose digests a task makes at once.
HOT_ANCHORS, BATCH_WINDOWS = 30_000, 1 << 16
#: Shares into which the rows of a digest are dealt.
SALTS = 16


def anchors_of(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window): for each anchor the run of window starts that it serves."""
    n_windows = len(data) - length + 1
    if n_windows < 1:
        return (np.zeros(0, np.int64),) * 3
    own = gear_hash(data)[GRAM - 1 :].astype(np.uint64) << np.uint64(32)
    own |= np.arange(GRAM - 1, len(data), dtype=np.uint64)
    step = 1
    while step < SPAN:
        own = np.minimum(own[:-step], own[step:])
        step *= 2
    at = (own[:n_windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:] - 1, n_windows - 1)
    return at[first], first, last


def cores(docs: DataFrame, length: int) -> DataFrame:
    """(core, row, at, first, last) of all anchors; docs has row and text."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = length - SPAN - GRAM + 2
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for low in range(0, batch.num_rows, 200):
                core, row, parts = [], [], []
                for r, text in zip(rows[low : low + 200], batch.column(1).slice(low, 200).to_pylist(), strict=True):
                    code = (text or "").encode("utf-8", "surrogatepass")
                    at, first, last = anchors_of(np.frombuffer(code, np.uint8), length)
                    core += [hashlib.blake2b(code[a - GRAM + 1 : a + ahead], digest_size=8).digest() for a in at.tolist()]
                    row += [r] * len(at)
                    parts.append(np.stack([at, first, last]))
                at, first, last = np.concatenate(parts, axis=1)
                cols = [pa.array(np.frombuffer(b"".join(core), np.int64)), pa.array(row, pa.int64()), *(pa.array(x.astype(np.int32)) for x in (at, first, last))]
                yield pa.RecordBatch.from_arrays(cols, names=["core", "row", "at", "first", "last"])

    return docs.select("row", "text").mapInArrow(found, "core long, row long, at int, first int, last int")


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    high = min(len(a), len(b))
    if a[known:high] == b[known:high]:
        return high
    low, high = known, high - 1
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


RUN = ["bucket", "shared", "rest_n", "rest", "left_n", "left", "members_n", "rows", "starts"]
RUN_SCHEMA = "bucket int, shared binary, rest_n binary, rest binary, left_n binary, left binary, members_n binary, rows binary, starts binary"


def coded(bucket: int, entries: dict[tuple[bytes, bytes], list[tuple[int, int]]]) -> list:
    """A front-coded run of the sorted (suffix, bytes before it backwards)."""
    import zstandard

    keys = sorted(entries)
    shared = [0, *(common(a[0], b[0]) for a, b in zip(keys, keys[1:], strict=False))]
    rest = [k[0][n:] for k, n in zip(keys, shared, strict=True)]
    members = [entries[k] for k in keys]
    pack = zstandard.ZstdCompressor(level=3).compress
    small = lambda x: np.array(x, np.uint16).tobytes()
    flat = np.array([m for own in members for m in own], np.int64).reshape(-1, 2)
    return [bucket, small(shared), small([len(x) for x in rest]), pack(b"".join(rest)), small([len(k[1]) for k in keys]), pack(b"".join(k[1] for k in keys)), np.array([len(m) for m in members], np.uint32).tobytes(), flat[:, 0].tobytes(), flat[:, 1].tobytes()]


class Run:
    """Reads a front-coded run one suffix at a time. `lcp` is the head's common prefix with the last suffix taken."""

    def __init__(self, row: dict) -> None:
        import zstandard

        unpack = lambda x: zstandard.ZstdDecompressor().decompress(x)
        self.shared, self.rest_n, self.left_n = (np.frombuffer(row[k], np.uint16).tolist() for k in ("shared", "rest_n", "left_n"))
        self.rest, self.left = unpack(row["rest"]), unpack(row["left"])
        self.members_n = np.frombuffer(row["members_n"], np.uint32).tolist()
        self.rows, self.starts = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["starts"], np.int64)
        self.i, self.rest_at, self.left_at, self.member_at = -1, 0, 0, 0
        self.head: bytes | None = b""
        self.lcp = 0
        self.step()

    def step(self) -> None:
        """The run's next suffix becomes its head; the old head is the last one taken."""
        self.i += 1
        if self.i == len(self.shared):
            self.head = None
            return
        self.lcp, n = self.shared[self.i], self.rest_n[self.i]
        self.head = self.head[: self.lcp] + self.rest[self.rest_at : self.rest_at + n]
        self.rest_at += n

    def taken(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(bytes before the head backwards, rows, starts) of the head's members."""
        n, m = self.left_n[self.i], self.members_n[self.i]
        left = self.left[self.left_at : self.left_at + n]
        own = slice(self.member_at, self.member_at + m)
        self.left_at += n
        self.member_at += m
        return left, self.rows[own], self.starts[own]


def merged(runs: list[Run]) -> Iterator[tuple[bytes, int, Run]]:
    """(suffix, common prefix with the one before, its run) in order, by a loser tree.

    Of two heads the one that shares more with the last suffix taken is smaller; with equal shares they are compared
    from there on, and the loser notes what it shares with the winner.
    """
    n = 1
    while n < len(runs):
        n *= 2
    losers: list[Run | None] = [None] * n

    def play(a: Run | None, b: Run | None) -> tuple[Run | None, Run | None]:
        """(winner, loser)."""
        if a is None or a.head is None:
            return b, a
        if b is None or b.head is None:
            return a, b
        if a.lcp != b.lcp:
            return (a, b) if a.lcp > b.lcp else (b, a)
        shared = common(a.head, b.head, a.lcp)
        if a.head[shared : shared + 1] <= b.head[shared : shared + 1]:
            b.lcp = shared
            return a, b
        a.lcp = shared
        return b, a

    def build(node: int) -> Run | None:
        if node >= n:
            return runs[node - n] if node - n < len(runs) else None
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    place = {id(r): i + n for i, r in enumerate(runs)}
    winner = build(1)
    while winner is not None and winner.head is not None:
        yield winner.head, winner.lcp, winner
        own = winner
        own.step()
        node = place[id(own)] // 2
        winner = own
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def bucket_spans(runs: list[Run], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, starts, ends) of the covered bytes around the anchors of a bucket."""
    deepest = length - (SPAN - 1)  # a shorter common suffix can't reach the length
    members: list[tuple[np.ndarray, np.ndarray]] = []
    reach: list[list[int]] = []
    stack: list[tuple[int, list[tuple[bytes, int]]]] = []
    last: list[tuple[bytes, int]] = []

    def join(a: list, b: list, depth: int) -> list:
        if len(a) < len(b):
            a, b = b, a
        for item in b:
            at = bisect_left(a, item)
            for other in a[max(at - 1, 0) : at + 1]:
                shared = common(item[0], other[0])
                if shared + depth >= length:
                    for i in (item[1], other[1]):
                        own = reach[i]
                        own[0], own[1] = max(own[0], shared), max(own[1], depth)
            a.insert(at, item)
        return a

    def close(depth: int) -> list:
        """Joins all sets that share more than `depth`."""
        own = last
        while stack and stack[-1][0] >= depth:
            deep, other = stack.pop()
            own = join(other, own, deep)
        return own

    def spans() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, starts, ends = [], [], []
        for (row, start), (left, right) in zip(members, reach, strict=True):
            if left + right >= length:
                rows.append(row)
                starts.append(start - left)
                ends.append(start + right)
        if not rows:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(rows), np.concatenate(starts), np.concatenate(ends)

    for suffix, shared, run in merged(runs):
        if last:
            if shared < deepest:
                close(0)
                stack.clear()
                yield spans()
                members.clear()
                reach.clear()
            else:
                stack.append((shared, close(shared)))
        left, rows, starts = run.taken()
        last = [(left, len(members))]
        members.append((rows, starts))
        reach.append([len(left), len(suffix)] if len(rows) > 1 else [0, 0])
    close(0)
    yield spans()


def covered(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """(row, start, end) covered bytes; texts has row, text and anchors array<struct<core, at, first, last, hot>>,
    of which the hot ones are passed over."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        size = 0

        def out() -> pa.RecordBatch:
            cols = list(zip(*(coded(b, own) for b, own in sorted(held.items())), strict=True)) or [[]] * len(RUN)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(cols)], names=RUN)

        for batch in batches:
            rows = batch.column(0).to_pylist()
            for low in range(0, batch.num_rows, 50):
                for r, text, own in zip(rows[low : low + 50], batch.column(1).slice(low, 50).to_pylist(), batch.column(2).slice(low, 50).to_pylist(), strict=True):
                    code = text.encode("utf-8", "surrogatepass")
                    for a in own:
                        if a["hot"]:
                            continue
                        start = a["at"] - GRAM + 1
                        key = code[start : a["last"] + length], code[a["first"] : start][::-1]
                        held.setdefault(a["core"] % buckets, {}).setdefault(key, []).append((r, start))
                        size += len(key[0]) + len(key[1])
                if size > RUN_BYTES:
                    yield out()
                    size = 0
        if held:
            yield out()

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(own: list[Run]) -> Iterator[pa.RecordBatch]:
            for cols in bucket_spans(own, length):
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["row", "start", "end"])

        bucket, own = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["bucket"] != bucket and own:
                    yield from done(own)
                    own = []
                bucket = row["bucket"]
                own.append(Run(row))
        if own:
            yield from done(own)

    exchanged = texts.select("row", "text", "anchors").mapInArrow(runs, RUN_SCHEMA).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return exchanged.mapInArrow(spans, "row long, start long, end long")


def digests(texts: DataFrame, size: int | None) -> DataFrame:
    """(high, low, row, start, end): the 128-bit digest of each range of a text, or of each window of `size` bytes in it.

    texts has row, text and ranges array<struct<start, end>> of bytes.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            cols = [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(row, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["high", "low", "row", "start", "end"])

        digest, row, start, end = [], [], [], []
        for batch in batches:
            for i in range(batch.num_rows):
                r, text, ranges = (batch.column(k)[i].as_py() for k in range(3))
                code = memoryview(text.encode("utf-8", "surrogatepass"))
                for own in ranges:
                    low, high = own["start"], own["end"]
                    n = high - low if size is None else size
                    for at in range(low, high - n + 1):
                        digest.append(hashlib.blake2b(code[at : at + n], digest_size=16).digest())
                        row.append(r)
                        start.append(at)
                        end.append(at + n)
                    if len(row) >= BATCH_WINDOWS:
                        yield out()
                        digest, row, start, end = [], [], [], []
        if row:
            yield out()

    return texts.select("row", "text", "ranges").mapInArrow(made, "high long, low long, row long, start long, end long")


def hot_spans(texts: DataFrame, length: int) -> DataFrame:
    """(row, start, end) covered bytes around the hot anchors of texts (row, text, anchors).

    Equal windows have their anchors in one core, so windows of hot anchors are met by such windows only. Anchors whose
    windows hold the same bytes are decided; one of each such set stays, as a partner of the others' windows. A digest's
    rows may be a large part of all, so they are salted where they meet the repeated digests, which are few beside them.
    """
    key, salted = ["high", "low"], ["high", "low", "salt"]
    hot = F.filter("anchors", lambda a: a["hot"])
    reach = F.transform(hot, lambda a: F.struct(a["first"].alias("start"), (a["last"] + length).alias("end")))
    own = texts.where(F.exists("anchors", lambda a: a["hot"]))
    whole = written(digests(own.select("row", "text", reach.alias("ranges")), None), "suffix-hot-ranges")
    sets = written(whole.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("row", "start", "end")).alias("one")).where("n > 1"), "suffix-hot-sets")
    span = ["row", "start", "end"]

    def met(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        every = keys.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        return rows.withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(SALTS))).join(every.hint("merge"), salted, how).select(*span)

    decided = met(whole, sets, "left_semi")
    open_ = met(whole, sets, "left_anti").unionByName(sets.select("one.*"))
    ranges = open_.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    windows = written(digests(texts.select("row", "text").join(ranges.hint("merge"), "row"), length), "suffix-hot-windows")
    again = windows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return decided.unionByName(met(windows, again, "left_semi"))


def suffix_report(docs: DataFrame, length: int = LENGTH, hot_anchors: int = HOT_ANCHORS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    hot_anchors: cores with more anchors than this aren't gathered; the result is the same at any number.
    """
    rows = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "suffix-docs")
    every = cores(rows, length)
    n = F.count("*")
    twice = written(every.groupBy("core").agg(n.alias("n")).where("n > 1").select("core", (F.col("n") > hot_anchors).alias("hot")), "suffix-cores")
    alive = written(every.join(twice.hint("merge"), "core"), "suffix-anchors")
    merging, hot = alive.agg(F.count_if(~F.col("hot")), F.count_if("hot")).first()
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-merging // BUCKET_ANCHORS))
    of_row = alive.groupBy("row").agg(F.collect_list(F.struct("core", "at", "first", "last", "hot")).alias("anchors"))
    kept = F.when(F.col("anchors").isNotNull(), F.col("text"))
    code = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    both = rows.join(of_row.hint("merge"), "row", "left")
    texts = written(both.select("row", "doc_id", F.octet_length(code).cast("long").alias("n_bytes"), F.sha2(code, 256).alias("sha256"), kept.alias("text"), "anchors"), "suffix-texts")
    found = covered(texts.where("anchors is not null"), length, buckets)
    if hot:
        found = found.unionByName(hot_spans(texts.where("anchors is not null"), length))
    spans = written(found.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "suffix-spans")
    hit = texts.where("anchors is not null").select("row", "text").join(spans.hint("merge"), "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, count, sums = [], [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                code, parts, at, n = text.encode("utf-8", "surrogatepass"), [], 0, 0
                for low, high in sorted((s["start"], s["end"]) for s in own):
                    if low > at or not n:
                        n += 1
                        parts.append(code[at:low])
                    at = max(at, high)
                left = b"".join([*parts, code[at:]])
                gone.append(len(code) - len(left))
                count.append(n)
                sums.append(hashlib.sha256(left).hexdigest())
            cols = [batch.column(0), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "n_removed", "n_spans", "kept_sha256"])

    done = hit.select("row", "text", "spans").mapInArrow(cut, "row long, n_removed long, n_spans long, kept_sha256 string")
    out = texts.select("row", "doc_id", "n_bytes", "sha256").join(done.hint("merge"), "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))
