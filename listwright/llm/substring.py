"""Operator 3: substring deduplication by content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes are cut where the gear hash of the last 32 bytes is the least within `RADIUS` bytes on both sides,
so cuts depend on nearby content only and an insertion moves none but those beside it; at most `LONGEST` bytes
lie between cuts. A chunk is known by its 128-bit BLAKE2b digest; of equal chunks the one of smallest (doc_id, position)
stays. A run of neighbouring later copies is found by its chunks and then grows at both ends, byte by byte, as far as
the text around the first copies agrees (`CONTEXT` bytes at most; a chunk is some 50 bytes long, and a cut depends on 55
bytes before it and 24 after it). Runs of `LEAST` bytes or more are removed whole: shorter ones, such as a stock phrase,
stay. A removed byte's equal always stands in a smaller (doc_id, row, place), so one copy of everything stays.

Defined results. A null text is empty: nothing is removed, and null texts stay null. Removal never splits a character: a
removed run begins and ends at character starts. Of repeated rows of a doc_id each counts as a document of its own; the
row number within its task tells them apart, so one of two identical rows loses its text to the other. Rows with a null
doc_id come after all others and are treated alike. An empty table gives no rows. In `deduplicated` all other columns
are kept, whatever their names, `n_chars` (if there) is counted anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import forget_others, written
from .features import fresh

#: Bytes on both sides of a cut with a greater hash; longest chunk; shortest removed run; bytes compared around a run.
RADIUS, LONGEST, LEAST, CONTEXT = 24, 512, 200, 256
#: Files whose numbers are broadcast at most (8 MB).
BROADCAST_FILES = 500_000
GEAR = np.random.default_rng(20240101).integers(0, 2**32, 256, dtype=np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum of the last 32 bytes' numbers, each shifted by its age."""
    h = GEAR[data]
    for k in range(5):
        n = 1 << k
        h[n:] = h[n:] + (h[:-n] << np.uint32(n))
    return h


def cuts(data: np.ndarray) -> np.ndarray:
    """Chunk borders, 0 and the length among them."""
    n = len(data)
    if n <= 2 * RADIUS:
        return np.array([0, n]) if n else np.zeros(1, int)
    h = gear_hash(data)
    width = 2 * RADIUS + 1
    low, span = h, 1  # minimum of the `span` hashes from each place on, doubled up to the width
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: n - width + 1], low[width - span : width - span + n - width + 1])
    at = np.flatnonzero(h[RADIUS : n - RADIUS] == low) + RADIUS + 1
    at = at[np.diff(at, prepend=-RADIUS) >= RADIUS]
    borders = np.concatenate([[0], at[at < n], [n]])
    far = np.flatnonzero(np.diff(borders) > LONGEST)
    if far.size:
        more = [np.arange(borders[i] + LONGEST, borders[i + 1], LONGEST) for i in far]
        borders = np.unique(np.concatenate([borders, *more]))
    return borders


def numbered(docs: DataFrame, name: str, row: str = "row") -> DataFrame:
    """The documents as a table with a column `row`, unique and fixed once written."""
    return written(docs.withColumn(row, F.monotonically_increasing_id()), name)


def identified(docs: DataFrame, name: str, row: str = "row") -> DataFrame:
    """The documents with a column `row` (a name that docs hasn't) that is the same in each plan they are used in.

    Rows of a scan of Parquet files are numbered by file and place in the file, which don't depend on how the scan is
    split into tasks; rows that come from anything else are written first. The list of files is the driver's, as it is
    Spark's own; it is broadcast, 16 bytes for each file, up to `BROADCAST_FILES`, and joined by a shuffle beyond.
    """
    file, at, number = (fresh(docs.columns, x) for x in ("_row_file", "_row_at", "_row_number"))
    try:
        placed = docs.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
    except AnalysisException:
        return numbered(docs, name, row)
    files = sorted(r[file] for r in placed.select(file).distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), f"{file} long, {number} long")
    place = F.shiftleft(number, 40).bitwiseOR(F.col(at))
    numbers = F.broadcast(numbers) if len(files) <= BROADCAST_FILES else numbers.hint("merge")
    return placed.join(numbers, file).select(*(F.col(f"`{c}`") for c in docs.columns), place.alias(row))


def chunks(docs: DataFrame) -> DataFrame:
    """(row, doc_id, at, size, digest) of every chunk; docs has row, doc_id and text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low in range(0, batch.num_rows, 200):
                row, doc, at, size, digest = [], [], [], [], []
                for r, d, text in zip(rows[low : low + 200], ids[low : low + 200], batch.column(2).slice(low, 200).to_pylist(), strict=True):
                    code = (text or "").encode("utf-8", "surrogatepass")
                    borders = cuts(np.frombuffer(code, np.uint8))
                    b = borders.tolist()
                    row += [r] * (len(b) - 1)
                    doc += [d] * (len(b) - 1)
                    at += b[:-1]
                    size += np.diff(borders).tolist()
                    digest += [hashlib.blake2b(code[x:y], digest_size=16).digest() for x, y in zip(b[:-1], b[1:], strict=True)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((row, doc, at, size, digest), kinds, strict=True)], names=["row", "doc_id", "at", "size", "digest"])

    own = docs.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(made, "row long, doc_id long, at long, size int, digest binary")


def removed_runs(docs: DataFrame) -> DataFrame:
    """(row, runs) of the rows that hold later copies; docs has row, doc_id and text.

    A run is struct<at, end, before, after>: neighbouring chunks that are later copies, and up to `CONTEXT` bytes that
    stand before its first chunk's first copy and after its last chunk's.

    The digests' first places come from one aggregation, which Spark combines in the tasks before the exchange. Only
    digests that occur again are joined back, and both sides of that join are tables, so that AQE can split a digest
    that very many documents share. So it is with contexts, which are cut once for each place.
    """
    pieces = written(chunks(docs), "chunks")
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), "row", "at")
    first = pieces.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = written(first.select("digest", F.col("first.row").alias("first_row"), F.col("first.at").alias("first_at")), "chunk-first")
    later = pieces.join(first.hint("merge"), "digest").where("row <> first_row or at <> first_at")
    end = F.col("at") + F.col("size")
    spans = later.select("row", F.struct("at", end.alias("end"), F.col("first_row").alias("a_row"), F.col("first_at").alias("a_at"), F.col("first_row").alias("b_row"), (F.col("first_at") + F.col("size")).alias("b_at")).alias("span"))
    own = spans.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    runs = F.expr(
        """aggregate(spans, cast(array() as array<struct<at: bigint, end: bigint, a_row: bigint, a_at: bigint, b_row: bigint, b_at: bigint>>), (done, x) ->
             if(size(done) > 0 and done[size(done) - 1].end = x.at,
                concat(slice(done, 1, size(done) - 1), array(named_struct(
                  'at', done[size(done) - 1].at, 'end', x.end, 'a_row', done[size(done) - 1].a_row, 'a_at', done[size(done) - 1].a_at, 'b_row', x.b_row, 'b_at', x.b_at))),
                concat(done, array(x))))"""
    )
    found = written(own.select("row", F.explode(runs).alias("run")).select("row", "run.*"), "chunk-runs")
    asked = found.select(F.col("a_row").alias("row"), F.col("a_at").alias("at")).union(found.select("b_row", "b_at"))
    around = written(contexts(docs, asked.distinct().groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("at"))), "chunk-contexts")
    before = around.select(F.col("row").alias("a_row"), F.col("at").alias("a_at"), "before")
    after = around.select(F.col("row").alias("b_row"), F.col("at").alias("b_at"), "after")
    found = found.join(before.hint("merge"), ["a_row", "a_at"]).join(after.hint("merge"), ["b_row", "b_at"])
    return found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "end", "before", "after"))).alias("runs"))


def contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(row, at, before, after): the bytes around each place (row, at array<long>)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                code = text.encode("utf-8", "surrogatepass")
                for low in range(0, len(at), 5000):
                    own = at[low : low + 5000]
                    cols = [pa.array([row] * len(own), pa.int64()), pa.array(own, pa.int64())]
                    cols += [pa.array([code[max(0, x - CONTEXT) : x] for x in own], pa.binary()), pa.array([code[x : x + CONTEXT] for x in own], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["row", "at", "before", "after"])

    own = docs.select("row", F.col("text").cast("string").alias("text")).join(asked.hint("merge"), "row").select("row", "at", "text")
    return own.mapInArrow(cut, "row long, at long, before binary, after binary")


def extended(code: bytes, runs: list[dict], least: int) -> list[tuple[int, int]]:
    """The runs, longer by the bytes that also stand around their first copies; of `least` bytes or more, at characters."""
    out: list[list[int]] = []
    edge = 0
    for k, run in enumerate(runs):
        at, end, before, after = run["at"], run["end"], run["before"], run["after"]
        n, most = 0, min(len(before), at - edge)
        while n < most and before[-1 - n] == code[at - 1 - n]:
            n += 1
        at -= n
        n, most = 0, min(len(after), (runs[k + 1]["at"] if k + 1 < len(runs) else len(code)) - end)
        while n < most and after[n] == code[end + n]:
            n += 1
        edge = end + n
        if out and at <= out[-1][1]:
            out[-1][1] = edge
        else:
            out.append([at, edge])
    kept = []
    for low, high in out:
        while low < high and code[low] & 0xC0 == 0x80:
            low += 1
        while high < len(code) and high > low and code[high] & 0xC0 == 0x80:
            high -= 1
        if high - low >= least:
            kept.append((low, high))
    return kept


def cut_out(docs: DataFrame, runs: DataFrame, least: int) -> DataFrame:
    """(row, own, kept, n_bytes, n_removed, n_spans, kept_sha256): docs has row, text and a struct `own`."""
    both = docs.select("row", "own", F.col("text").cast("string").alias("text")).join(runs.hint("merge"), "row", "left")

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, gone, count, sums = [], [], [], [], []
            for x, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                code = (x or "").encode("utf-8", "surrogatepass")
                cut = extended(code, own, least) if own else []
                borders = [0, *(b for run in cut for b in run), len(code)]
                left = b"".join(code[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True))
                kept.append(None if x is None else left.decode("utf-8", "surrogatepass"))
                n.append(len(code))
                gone.append(len(code) - len(left))
                count.append(len(cut))
                sums.append(hashlib.sha256(left).hexdigest())
            cols = [pa.array(kept, pa.string()), *(pa.array(c, pa.int64()) for c in (n, gone, count)), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["row", "own", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = StructType([both.schema["row"], both.schema["own"], StructField("kept", StringType()), *(StructField(x, LongType()) for x in ("n_bytes", "n_removed", "n_spans")), StructField("kept_sha256", StringType())])
    return both.mapInArrow(out, schema)


def without_copies(docs: DataFrame, least: int) -> DataFrame:
    """What `cut_out` gives for whole documents; their columns are inside `own`, where no name can clash."""
    row = fresh(docs.columns, "row")
    placed = identified(docs, "substring-docs", row)
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = placed.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(c for c, n in zip(names, docs.columns, strict=True) if n != "text")).alias("own"))
    return cut_out(rows, removed_runs(rows), least)


def substring_report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return without_copies(docs.select("doc_id", "text"), least).select(F.col("own.doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def deduplicated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents without their repeated passages, in the same columns."""
    left = without_copies(docs, least)
    cols = {c: F.col(f"own.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("kept").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return left.select(*(cols[name].alias(name) for name in docs.columns))
