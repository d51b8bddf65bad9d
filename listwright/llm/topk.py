"""Operator 4: exact top-k by inner product, in three phases with a uniform threshold.

A vector's score is the sum of `LISTS` partial scores, one for each slice of its components; a slice of a shard is one
list. Phase 1 takes each list's k highest entries, completes the scores of these alone and gathers the k best: a query's
k-th best of all shards is a safe cutoff. Phase 2 sends the cutoffs to all shards. A shard whose lists' longest slices
can't reach a query's cutoff (Cauchy's bound) isn't looked at for that query. In the others an entry can only reach the
cutoff if in some list it lies above the list's share of it, so every list collects its entries above that share. Phase
3 completes the scores of those entries and keeps each shard's k best that reach the cutoff.

Defined results. Vectors that are null, empty, or hold null or non-finite components take no part. Vectors of
different lengths don't meet. A query never meets its own vec_id, so repeated rows of one vec_id don't meet each other;
as candidates of others each of them counts, as a query a repeated vec_id is asked once, with its least vector. Ties go
to the smaller vec_id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import BLOCK, SHARD, best, blocks, doubles, each_pair, ints, paired, usable

LISTS = 4
#: Beyond this, a sum of products might not be exact in doubles.
EXACT = 2.0**53


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; exact also where doubles aren't (in Python's integers, then)."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return a @ b.T
    return a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T


def completed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows in the same place, exact as `scores`."""
    if a.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return np.einsum("ij,ij->i", a, b)
    return (a.astype(np.int64).astype(object) * b.astype(np.int64).astype(object)).sum(axis=1)


def slices(width: int) -> list[slice]:
    edges = np.linspace(0, width, min(LISTS, width) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for (vec_id, v) rows; components are whole numbers in doubles."""
    shards = written(blocks(vectors, SHARD, "s"), "topk-shards")
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = written(blocks(queries, BLOCK, "q"), "topk-queries")

    def gather(width: int, ids: list, data: bytes, q_ids: list, q_data: bytes) -> tuple:
        """Phase 1: the k best of each list, with their whole scores."""
        v, q, vec, own = doubles(data, width), doubles(q_data, width), ints(ids), ints(q_ids)
        rows, cols = [], []
        for s in slices(width):
            part = -scores(q[:, s], v[:, s]).astype(np.float64)
            part[own[:, None] == vec] = np.inf
            near = np.argpartition(part, min(k, len(vec)) - 1, axis=1)[:, :k]
            rows.append(np.repeat(np.arange(len(own)), near.shape[1]))
            cols.append(near.ravel())
        at = np.unique(np.concatenate(rows) * len(vec) + np.concatenate(cols))
        r, c = np.divmod(at, len(vec))
        r, c = r[own[r] != vec[c]], c[own[r] != vec[c]]
        whole = completed(q[r], v[c]).astype(np.int64)
        keep = best(own[r], vec[c], -whole, k)
        return own[r][keep], vec[c][keep], whole[keep]

    def collect(width: int, ids: list, data: bytes, q_ids: list, q_data: bytes, cutoffs: dict) -> tuple:
        """Phases 2 and 3 in a shard: what lies above its list's share of the cutoff, completed."""
        v, q, vec, own = doubles(data, width), doubles(q_data, width), ints(ids), ints(q_ids)
        cutoff = np.array([cutoffs.get(x, -np.inf) for x in own.tolist()])
        bound = sum(np.sqrt((q[:, s] ** 2).sum(axis=1)) * np.sqrt((v[:, s] ** 2).sum(axis=1).max()) for s in slices(width))
        may = bound * (1 + 1e-9) >= cutoff
        q, own, cutoff = q[may], own[may], cutoff[may]
        if not len(own):
            return own, own, own
        parts = [scores(q[:, s], v[:, s]) for s in slices(width)]
        tops = np.stack([p.max(axis=1).astype(np.float64) for p in parts])
        # uniform shares: each list may fall short of its top by the same amount, so that the shares sum to the cutoff
        slack = (tops.sum(axis=0) - cutoff) / len(parts)
        seen = np.zeros(parts[0].shape, bool)
        for p, top in zip(parts, tops, strict=True):
            seen |= p >= (top - slack)[:, None]
        r, c = np.nonzero(seen & (own[:, None] != vec))
        whole = sum(p[r, c] for p in parts)
        reach = whole >= cutoff[r]
        r, c, whole = r[reach], c[reach], np.asarray(whole[reach]).astype(np.int64)
        keep = best(own[r], vec[c], -whole, k)
        return own[r][keep], vec[c][keep], whole[keep]

    found, kinds = ["query_id", "vec_id", "score"], [pa.int64()] * 3
    of_pair = ["width", "ids", "data", "q_ids", "q_data"]
    local = paired(shards, asked, of_pair).mapInArrow(each_pair(gather, found, kinds), "query_id long, vec_id long, score long")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff"))
    # a block's cutoffs travel with its queries: never more than BLOCK of them in a row
    members = asked.select("block", F.explode("ids").alias("query_id"))
    with_cutoff = members.join(ranked.hint("merge"), "query_id").groupBy("block").agg(F.map_from_entries(F.collect_set(F.struct("query_id", "cutoff"))).alias("cutoffs"))
    asked = written(asked.join(with_cutoff.hint("merge"), "block", "left"), "topk-cutoffs")

    pairs = paired(shards, asked.drop("cutoffs"), [*of_pair, "q_block"]).join(asked.select(F.col("block").alias("q_block"), "cutoffs").hint("merge"), "q_block").select(*of_pair, "cutoffs")

    def collected(width: int, ids: list, data: bytes, q_ids: list, q_data: bytes, cutoffs: list | None) -> tuple:
        return collect(width, ids, data, q_ids, q_data, dict(cutoffs or []))

    sent = pairs.mapInArrow(each_pair(collected, found, kinds), "query_id long, vec_id long, score long")
    ranked = sent.withColumn("rank", F.row_number().over(by_score).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def quantized(vectors: DataFrame, factor: float = 256.0) -> DataFrame:
    """(vec_id, v) with v = floor(factor * x) of every usable vector."""
    return usable(vectors).select("vec_id", F.transform("v", lambda x: F.floor(x * factor).cast("double")).alias("v"))
