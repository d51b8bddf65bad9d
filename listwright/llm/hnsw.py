"""Operator 6: approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

`build_index` packs the vectors into shards. A shard's distinct vectors are the nodes of its graph; a node keeps all
ids of its vector, in order. Levels are drawn from the node's content, so a rerun of a lost task gives the same graph.
On each level a node links to near nodes of that level, of which those are kept that are nearer to it than to a kept
one, filled up with the nearest; links go both ways, within the level's bound. Levels are stored as flat neighbour
arrays: one row of `degree` positions for each node, -1 where there are fewer. `search` walks each shard's graph from
the top for a block of queries at once and merges the shards' answers.

Defined results. Vectors that are null, empty, zero, or hold null or non-finite components take no part. Vectors of
different lengths don't meet. A query never meets its own vec_id. Repeated rows of one vec_id count each; as a query a
repeated vec_id is asked once, with its least vector. Ties go to the smaller vec_id, also among thousands of equal
vectors. An empty table gives no rows. Other columns are ignored. Scores are Euclidean distances of the original vectors in doubles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import BLOCK, SHARD, best, blocks, doubles, each_pair, ints, paired, usable

#: Links of a node on a level (twice as many on the lowest), and nodes that a search keeps in view.
LINKS, VIEW = 16, 96
INDEX = "block string, width int, ids array<long>, data binary, owners array<int>, nodes binary, levels array<array<int>>, links array<binary>"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


def linked(points: np.ndarray, degree: int) -> np.ndarray:
    """Flat neighbour array (n, degree) of one level."""
    n = len(points)
    near_n = min(n - 1, 2 * degree)
    out = np.full((n, degree), -1, np.int32)
    if near_n < 1:
        return out
    chosen: list[list[int]] = []
    for low in range(0, n, 512):
        far = squared(points[low : low + 512], points)
        far[np.arange(len(far)), np.arange(low, low + len(far))] = np.inf
        near = np.argpartition(far, near_n - 1, axis=1)[:, :near_n]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)
        own = np.take_along_axis(far, near, 1)
        for i in range(len(far)):
            around = points[near[i]]
            between = squared(around, around)
            kept: list[int] = []
            for j in range(near_n):
                if len(kept) < degree // 2 and all(own[i, j] < between[j, x] for x in kept):
                    kept.append(j)
            rest = [j for j in range(near_n) if j not in set(kept)]
            kept += rest[: max(0, degree // 2 - len(kept))]
            chosen.append(near[i, kept].tolist())
    both: list[list[int]] = [list(x) for x in chosen]
    for i, own_links in enumerate(chosen):
        for j in own_links:
            if i not in both[j] and len(both[j]) < degree:
                both[j].append(i)
    for i, own_links in enumerate(both):
        out[i, : len(own_links)] = own_links[:degree]
    return out


def graph(data: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(node of each vector, nodes' vectors, nodes on each level from the lowest, their neighbour arrays)."""
    nodes, owner = np.unique(data, axis=0, return_inverse=True)
    draw = np.array([zlib.crc32(x.tobytes()) for x in nodes], np.float64) + 1
    height = np.floor(-np.log(draw / 2.0**32) / np.log(LINKS)).astype(int)
    levels, links = [], []
    for level in range(height.max() + 1):
        on = np.flatnonzero(height >= level).astype(np.int32)
        levels.append(on)
        links.append(linked(nodes[on], 2 * LINKS if level == 0 else LINKS))
    return owner.reshape(-1).astype(np.int32), nodes, levels, links


def build_index(vectors: DataFrame) -> DataFrame:
    """The index as a table, one row for each shard; vectors are (vec_id, v) rows."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, width, ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                owner, nodes, levels, links = graph(doubles(data, width), ints(ids))
                cols = [[name], [width], [ids], [data], [owner.tolist()], [nodes.tobytes()], [[x.tolist() for x in levels]], [[x.tobytes() for x in links]]]
                kinds = [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

    shards = written(blocks(vectors, SHARD, "s"), "hnsw-shards")
    spread = shards.repartition(max(1, shards.count()), "block")
    return written(spread.mapInArrow(built, INDEX), "hnsw-index")


def walk(queries: np.ndarray, nodes: np.ndarray, levels: list[np.ndarray], links: list[np.ndarray], view: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) in view of each query, nearest first; -1 where there are fewer."""
    n_q, norms = len(queries), (nodes * nodes).sum(1)
    own = (queries * queries).sum(1)

    def far(q: np.ndarray, node: np.ndarray) -> np.ndarray:
        return own[q][:, None] + norms[node] - 2 * np.einsum("qd,qkd->qk", queries[q], nodes[node])

    place = np.full(len(nodes), -1)
    at = np.full((n_q, 1), levels[-1][0])
    dist = far(np.arange(n_q), at)
    for level in range(len(levels) - 1, -1, -1):
        place[:] = -1
        place[levels[level]] = np.arange(len(levels[level]))
        width = view if level == 0 else 8
        seen = np.zeros((n_q, len(nodes)), bool)
        np.put_along_axis(seen, at, True, 1)
        opened = np.zeros(at.shape, bool)
        active = np.arange(n_q)
        while active.size:
            # the four nearest unopened nodes in view of each query are opened together
            waiting = np.where(opened[active] | (at[active] < 0), np.inf, dist[active])
            pick = np.argsort(waiting, axis=1, kind="stable")[:, :4]
            real = np.isfinite(np.take_along_axis(waiting, pick, 1))
            active, pick, real = active[real.any(1)], pick[real.any(1)], real[real.any(1)]
            if not active.size:
                break
            rows = np.repeat(np.arange(len(active)), pick.shape[1])[real.ravel()]
            opened[active[rows], pick.ravel()[real.ravel()]] = True
            new = np.where(real[:, :, None], links[level][place[np.take_along_axis(at[active], pick, 1)]], -1).reshape(len(active), -1)
            new = np.where(new >= 0, levels[level][new], -1)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[(new >= 0) & np.take_along_axis(seen[active], np.maximum(new, 0), 1)] = -1
            hit = np.nonzero(new >= 0)
            seen[active[hit[0]], new[hit]] = True
            more = np.full(new.shape, np.inf)
            more[hit] = own[active[hit[0]]] + norms[new[hit]] - 2 * np.einsum("kd,kd->k", queries[active[hit[0]]], nodes[new[hit]])
            all_at, all_far = np.hstack([at[active], new]), np.hstack([dist[active], more])
            all_open = np.hstack([opened[active], np.zeros(new.shape, bool)])
            order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
            if at.shape[1] < order.shape[1]:
                grow = order.shape[1] - at.shape[1]
                at = np.pad(at, ((0, 0), (0, grow)), constant_values=-1)
                dist = np.pad(dist, ((0, 0), (0, grow)), constant_values=np.inf)
                opened = np.pad(opened, ((0, 0), (0, grow)))
            n = order.shape[1]
            at[active, :n], dist[active, :n], opened[active, :n] = (np.take_along_axis(x, order, 1) for x in (all_at, all_far, all_open))
    return at, dist


def search(index: DataFrame, queries: DataFrame, k: int, view: int = VIEW) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found; queries are (vec_id, v) rows."""
    asked = written(blocks(queries.groupBy("vec_id").agg(F.min("v").alias("v")), BLOCK, "q"), "hnsw-queries")

    def nearest(width: int, ids: list, data: bytes, owners: list, nodes: bytes, levels: list, links: list, q_ids: list, q_data: bytes) -> tuple:
        vec, own, v, q, points = ints(ids), ints(q_ids), doubles(data, width), doubles(q_data, width), doubles(nodes, width)
        flat = [np.frombuffer(x, np.int32).reshape(len(on), -1) for x, on in zip(links, levels, strict=True)]
        at, _ = walk(q, points, [np.array(x) for x in levels], flat, view)
        order = np.lexsort((vec, owners))
        first = np.searchsorted(np.array(owners)[order], np.arange(len(points) + 1))
        r, c = np.nonzero(at >= 0)
        node = at[r, c]
        # of the ids that share a vector only the smallest k and the query's own can matter
        n = np.minimum(first[node + 1] - first[node], k + 1)
        rows = np.repeat(np.arange(len(r)), n)
        member = order[first[node][rows] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        query = r[rows]
        other = own[query] != vec[member]
        query, member = query[other], member[other]
        score = np.sqrt(((q[query] - v[member]) ** 2).sum(1))
        keep = best(own[query], vec[member], score, k)
        return own[query][keep], vec[member][keep], score[keep]

    columns = ["width", "ids", "data", "owners", "nodes", "levels", "links", "q_ids", "q_data"]
    found = paired(index, asked, columns).mapInArrow(
        each_pair(nearest, ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]), "query_id long, vec_id long, score double"
    )
    nearest_first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest_first).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nonzero(vectors: DataFrame) -> DataFrame:
    return usable(vectors).where(F.exists("v", lambda x: x != 0))
