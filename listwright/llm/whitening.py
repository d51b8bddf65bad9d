"""Operator 13: whitening of embeddings by QDWH spectral divide-and-conquer.

Entries become whole numbers, each distinct vector counts once (the fit list), and three passes over that list give its
exact sums, its centred covariance, and what the covariance of the whitened list differs from the identity by. The
covariance, whose size is the square of the vectors' width and doesn't grow with the rows, is taken apart on the driver:
the polar factor of a shifted covariance, found by QR-based dynamically weighted Halley steps (QDWH), gives the projector
on the components above the shift; both sides are taken apart in the same way until single components are left. Means
and components, of bounded size too, are broadcast to whiten every row.

Defined results. Rows whose vector is null, empty, or holds null or non-finite entries don't count; nor do entries of
2^56 or more, which have no whole number of 64 bits. Vectors of each width are whitened by themselves. Components whose
variance is zero to double precision (all of them where one distinct vector is left) can't be whitened and have no rows.
A deviation of more than 64 bits is null. Repeated rows and null vec_ids are rows of their own; equal variances have
components in some order. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Steps of a component of size one, the shift of the whole numbers, and the components returned.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Partial matrices meet in so many tasks before the driver adds these up one by one.
SLOTS = 16
EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Whitening:
    """n and exact sums of the fit list of one width; components in columns, by falling variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, with the mean's whole part taken off in whole numbers."""
        whole, rest = self.mean()
        return (x - whole).astype(float) - rest

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        both = [divmod(s, self.n) for s in self.sums]
        return np.array([w for w, _ in both], np.int64), np.array([r / self.n for _, r in both])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of (n * x - S)^2."""
        whole, _ = self.mean()
        rest = [s % self.n for s in self.sums]
        y = x - whole
        if len(y) and self.n * (float(np.abs(y.astype(float)).max()) + 1) < (2.0**62 / x.shape[1]) ** 0.5:
            return ((y * self.n - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        found = (sum((self.n * c - r) ** 2 for c, r in zip(row, rest, strict=True)) for row in y.tolist())
        return [v if v < 2**63 else None for v in found]


def steps(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the usable rows."""
    own = F.col("embedding").cast("array<double>")
    good = F.forall(own, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**56)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), own.alias("c")).where((F.size("c") > 0) & good)
    return rows.select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long")).alias("x"))


def matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places, vectors) of a batch's lists."""
    lists = batch.column(column)
    widths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(widths) - widths
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        yield int(width), own, flat[starts[own][:, None] + np.arange(width)]


def exact_sums(fit_list: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """width -> (n, sums). Tasks add up halves of 32 bits, Spark adds the tasks' sums as decimals."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for width, own, x in matrices(batch, 0):
                sums = held.setdefault(width, [0, np.zeros(width, np.int64), np.zeros(width, np.int64)])
                sums[0] += len(own)
                sums[1] += (x >> 32).sum(axis=0)
                sums[2] += (x & 0xFFFFFFFF).sum(axis=0)
        for width, (n, high, low) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(high), pa.array(low)], names=["width", "at", "n", "high", "low"])

    parts = fit_list.select("x").mapInArrow(partial, "width int, at int, n long, high long, low long")
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = parts.groupBy("width", "at").agg(total("n"), total("high"), total("low")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r["width"], r["at"])):
        out.setdefault(r["width"], (int(r["n"]), []))[1].append((int(r["high"]) << 32) + int(r["low"]))
    return out


def mean_products(fit_list: DataFrame, counts: dict[int, int], centre: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """width -> the mean of z z' over the list, where z is what `centre` makes of the vectors of a width.

    Each task holds one matrix of each width; the tasks' matrices meet in SLOTS tasks, and the driver adds up those.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, x in matrices(batch, 0):
                z = centre(width, x)
                held[width] = held.get(width, 0.0) + z.T @ z
        yield from sent(held, TaskContext.get().partitionId() % SLOTS)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held[width] = held.get(width, 0.0) + square(data)
        yield from sent(held, 0)

    shape = "slot int, width int, data binary"
    parts = fit_list.select("x").mapInArrow(partial, shape).repartition(SLOTS, "slot").mapInArrow(added, shape)
    out: dict[int, np.ndarray] = {}
    for r in parts.toLocalIterator():
        out[r["width"]] = out.get(r["width"], 0.0) + square(r["data"])
    return {width: total / counts[width] for width, total in out.items()}


def square(data: bytes) -> np.ndarray:
    flat = np.frombuffer(data, "<f8")
    return flat.reshape(int(len(flat) ** 0.5), -1)


def sent(held: dict[int, np.ndarray], slot: int) -> Iterator[pa.RecordBatch]:
    for width, matrix in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([width], pa.int32()), pa.array([matrix.astype("<f8").tobytes()], pa.binary())], names=["slot", "width", "data"])


def polar_sign(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH steps that need a QR decomposition each.

    The weights follow a lower bound on the smallest singular value; 1e-16 of the largest is assumed at the start, from
    which the bound comes to 1 in six or seven steps.
    """
    d = len(a)
    size = np.linalg.norm(a)
    x, low = a / size, 1e-16
    for _ in range(40):
        rest = max(low, 1e-300) ** 2
        g = (4 * (1 - rest) / rest**2) ** (1 / 3)
        u = np.sqrt(1 + g) + 0.5 * np.sqrt(max(8 - 4 * g + 8 * (2 - rest) / (rest * np.sqrt(1 + g)), 0.0))
        v = (u - 1) ** 2 / 4
        w = u + v - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(w) * x, np.eye(d)]))
        after = (v / w) * x + (u - v / w) / np.sqrt(w) * (q[:d] @ q[d:].T)
        after = (after + after.T) / 2
        moved = np.linalg.norm(after - x)
        x, low = after, min(1.0, low * (u + v * rest) / (1 + w * rest))
        if 1 - low < 10 * EPS and moved < EPS ** (1 / 3):
            break
    return x


def halves(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """(basis, k): an orthogonal basis whose first k columns span the components above a shift, the others the rest.

    Shifts are tried from the diagonal's median on; None if the matrix is a multiple of the identity but for rounding.
    """
    d = len(a)
    diagonal = np.diag(a)
    for shift in (float(np.median(diagonal)), float(diagonal.mean()), float(diagonal.mean()) * (1 + 1e-9), *np.quantile(diagonal, np.arange(1, 16) / 16).tolist()):
        off = a - shift * np.eye(d)
        if np.linalg.norm(off) <= 4 * EPS * d * np.linalg.norm(a):
            return None
        sign = polar_sign(off)
        k = int(round((np.trace(sign) + d) / 2))
        if not 0 < k < d or np.linalg.norm(sign @ sign - np.eye(d)) > 1e-8 * d:
            continue  # all on one side, or a component at the shift itself
        above = (sign + np.eye(d)) / 2
        # the projector's k largest columns, then a full basis, one step of subspace iteration for both sides
        order = np.argsort(-np.linalg.norm(above, axis=0), kind="stable")
        first, _ = np.linalg.qr(above @ pivoted(above[:, order], k))
        both, _ = np.linalg.qr(np.hstack([first, (np.eye(d) - above)]))
        basis = np.hstack([first, both[:, k:d]])
        both, _ = np.linalg.qr(np.hstack([above @ basis[:, :k], basis[:, k:] - above @ basis[:, k:]]))
        if np.linalg.norm(both[:, k:].T @ a @ both[:, :k]) <= 1e3 * EPS * d * np.linalg.norm(a):
            return both, k
    if np.linalg.norm(a - np.diag(diagonal)) > 1e-10 * np.linalg.norm(a):
        raise ArithmeticError("no shift takes the covariance apart")
    return None  # components that differ by rounding only


def pivoted(columns: np.ndarray, k: int) -> np.ndarray:
    """k columns that are far from depending on one another, by pivoted orthogonalization."""
    rest, chosen = columns.copy(), []
    for _ in range(k):
        at = int(np.argmax((rest * rest).sum(axis=0)))
        chosen.append(at)
        unit = rest[:, at] / np.linalg.norm(rest[:, at])
        rest -= np.outer(unit, unit @ rest)
    return columns[:, chosen]


def spectrum(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(variances, components in columns) of the `most` largest, by falling variance.

    A subspace whose components all come after the wanted ones isn't taken apart.
    """
    values: list[float] = []
    found: list[np.ndarray] = []
    todo = [(a, np.eye(len(a)))]
    while todo and len(found) < most:
        own, basis = todo.pop()
        cut = halves(own) if len(own) > 1 else None
        if cut is None:
            order = np.argsort(-np.diag(own), kind="stable")
            for i in order:
                found.append(basis[:, i])
                values.append(float(own[i, i]))
            continue
        q, k = cut
        for part in (q[:, k:], q[:, :k]):  # the larger components are popped first
            inner = part.T @ own @ part
            todo.append(((inner + inner.T) / 2, basis @ part))
    order = np.argsort(-np.array(values), kind="stable")[:most]
    out = np.stack(found, axis=1)[:, order]
    return np.array(values)[order], out / np.linalg.norm(out, axis=0)


def fit(rows: DataFrame, most: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of each width; rows as `steps` gives them."""
    fit_list = written(rows.select("x").distinct(), "whitening-fit")
    models: dict[int, Whitening] = {}
    none = np.zeros((0, 0))
    for width, (n, sums) in exact_sums(fit_list).items():
        models[width] = Whitening(n, tuple(sums), none, none, none)
    counts = {width: m.n for width, m in models.items()}
    sent_models = fit_list.sparkSession.sparkContext.broadcast(models)
    for width, v in mean_products(fit_list, counts, lambda w, x: sent_models.value[w].centred(x)).items():
        v = (v + v.T) / 2
        variances, components = spectrum(v, most)
        real = variances > width * EPS * max(float(np.trace(v)), 0.0)
        models[width] = replace(models[width], components=components[:, real], variances=variances[real], explained=variances[real] / np.trace(v) if real.any() else variances[real])
    models = {width: m for width, m in models.items() if len(m.variances)}
    whole = fit_list.sparkSession.sparkContext.broadcast(models)

    def whitened(width: int, x: np.ndarray) -> np.ndarray:
        return whole.value[width].whitened(x) if width in whole.value else np.zeros((1, 1))

    for width, v in mean_products(fit_list, counts, whitened).items():
        if width in models:
            models[width] = replace(models[width], identity_error=float(np.abs(v - np.eye(len(v))).max()))
    return models


def whitened(rows: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row of `steps` and component."""
    sent_models = rows.sparkSession.sparkContext.broadcast(models)
    kinds = {"vec_id": pa.int64(), "component": pa.int32(), "n": pa.int64(), "deviation": pa.int64(), "whitened": pa.float64(), "explained": pa.float64(), "identity_error": pa.float64()}

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent_models.value
        for batch in batches:
            for width, own, x in matrices(batch, 1):
                model = known.get(width)
                if model is None:
                    continue
                k = len(model.variances)
                each = np.repeat(np.arange(len(own)), k)
                cols = [
                    batch.column(0).take(pa.array(own[each])), np.tile(np.arange(1, k + 1), len(own)), np.full(len(each), model.n), pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                    model.whitened(x).ravel(), np.tile(model.explained, len(own)), np.full(len(each), model.identity_error),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, np.ndarray) else c for c, t in zip(cols, kinds.values(), strict=True)], names=list(kinds))

    return rows.mapInArrow(rows_of, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitening(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    rows = steps(vectors)
    return whitened(rows, fit(rows, most))
