"""Vector blocks that operators 4 and 6 share: usable vectors, packed into rows of many vectors each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors in a shard and queries in a block: 64 doubles each make 1 MB and 0.25 MB.
SHARD, BLOCK = 2048, 512


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) without vectors that are null, empty or hold null or non-finite components."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite)


def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of at most `size` vectors of one width: (block string, width int, ids array<long>, data binary)."""

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(width: int) -> pa.RecordBatch:
            nonlocal n
            ids = np.concatenate([a for a, _ in held[width]])
            data = np.concatenate([b for _, b in held[width]])
            held[width] = [(ids[size:], data[size:])] if len(ids) > size else []
            n += 1
            cols = [pa.array([f"{name}{part}-{n}"]), pa.array([width], pa.int32()), pa.array([ids[:size]], pa.list_(pa.int64())), pa.array([data[:size].tobytes()])]
            return pa.RecordBatch.from_arrays(cols, names=["block", "width", "ids", "data"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            widths = lists.value_lengths().to_numpy(zero_copy_only=False)
            starts = np.cumsum(widths) - widths
            for width in np.unique(widths):
                own = widths == width
                data = flat[starts[own][:, None] + np.arange(width)]
                held.setdefault(int(width), []).append((ids[own], data))
                while sum(len(a) for a, _ in held[int(width)]) >= size:
                    yield out(int(width))
        for width in list(held):
            while held[width] and sum(len(a) for a, _ in held[width]):
                yield out(width)

    return rows.mapInArrow(packs, "block string, width int, ids array<long>, data binary")


def paired(shards: DataFrame, queries: DataFrame, columns: list[str]) -> DataFrame:
    """Every shard beside every query block of its width: a join on a slot, each block being copied to each slot.

    Slots follow the number of shards, so a task holds a few shards and reads all query blocks one after another. The
    number of rows is shards x blocks, each standing for SHARD x BLOCK scores; no vector pair is ever a row.
    """
    slots = max(1, min(shards.count(), shards.sparkSession.sparkContext.defaultParallelism * 4))
    left = shards.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)))
    right = queries.select(
        F.col("block").alias("q_block"), F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("q_slot"),
    )
    both = left.join(right.hint("merge"), (F.col("slot") == F.col("q_slot")) & (F.col("width") == F.col("q_width")))
    return both.select(*columns)


def ints(x: list[int]) -> np.ndarray:
    return np.array(x, np.int64)


def doubles(x: bytes, width: int) -> np.ndarray:
    return np.frombuffer(x, np.float64).reshape(-1, width)


def each_pair(fn: Callable[..., tuple], names: list[str], kinds: list[pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: `fn` gets the values of one row and returns columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cols = fn(*row)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best: smallest score, then smallest id."""
    order = np.lexsort((vec, score, query))
    q = query[order]
    first = np.searchsorted(q, q, side="left")
    return order[np.arange(len(q)) - first < k]
