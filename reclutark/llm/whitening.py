"""Whitening of embeddings; components by contour integration (FEAST) with inertia counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reclutark.llm.common import ship

#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000

#: Entries beyond this, after scaling, are set to it, so that whole numbers stay in 64 bits.
LIMIT = 1 << 60

#: Components whose eigenvalue is not above this share of the trace are rounding noise and not given out.
NOISE = 1e-10

#: Eigenvalues that one contour encloses at most (more only if they lie closer than ``CLOSE``, relatively), and its quadrature nodes.
ENCLOSED, CLOSE, NODES = 8, 1e-9, 12
ROUNDS = 40

Batches = Iterator[pa.RecordBatch]


def negative_count(matrix: np.ndarray) -> int:
    """Number of negative eigenvalues of a symmetric matrix, by Sylvester's law: the signs in an LDL' with complete pivoting."""
    a, k, count = matrix.copy(), 0, 0
    n = len(a)
    while k < n:
        rest = np.abs(a[k:, k:])
        r = k + int(np.argmax(np.diag(rest)))
        np.fill_diagonal(rest, -1)
        p, q = divmod(int(np.argmax(rest)), n - k)
        size = 1 if abs(a[r, r]) >= 0.64 * rest[p, q] else 2
        for at, to in ((r, k),) if size == 1 else ((min(p, q) + k, k), (max(p, q) + k, k + 1)):
            a[[at, to]] = a[[to, at]]
            a[:, [at, to]] = a[:, [to, at]]
        if size == 1 and a[k, k] == 0:
            break
        count += size == 2 or a[k, k] < 0  # a 2 x 2 pivot has one eigenvalue of each sign
        pivot, below = a[k : k + size, k : k + size], a[k + size :, k : k + size]
        a[k + size :, k + size :] -= below @ np.linalg.solve(pivot, below.T)
        k += size
    return int(count)


def _slices(above: Callable[[float], int], low: float, high: float, wanted: int) -> Iterator[tuple[float, float, int]]:
    """Intervals from the top that hold the ``wanted`` largest eigenvalues, with the number in each."""
    stack = [(low, high, above(low), 0)]
    while stack:
        low, high, over_low, over_high = stack.pop()
        if over_low == over_high or over_high >= wanted:
            continue
        if over_low - over_high <= ENCLOSED or high - low <= CLOSE * high:
            yield low, high, over_low - over_high
            continue
        middle = np.sqrt(low * high) if high > 4 * low else (low + high) / 2
        over = above(middle)
        stack += [(low, middle, over_low, over), (middle, high, over, over_high)]


def _enclosed(matrix: np.ndarray, low: float, high: float, count: int, norm: float) -> np.ndarray:
    """Ritz vectors for the eigenvalues between ``low`` and ``high``, of which there are ``count``."""
    d = len(matrix)
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(0.5j * np.pi * (1 - nodes))
    center, radius = (low + high) / 2, (high - low) / 2
    random = np.random.default_rng(d)
    size = min(d, 2 * count + 4)
    while True:
        basis, best, vectors = random.normal(size=(d, size)), np.inf, None
        for _ in range(ROUNDS):
            projected = np.zeros((d, basis.shape[1]))
            for turn, weight in zip(turns, weights):
                solved = np.linalg.solve((center + radius * turn) * np.eye(d) - matrix, basis.astype(complex))
                projected += weight / 2 * (radius * turn * solved).real
            basis = np.linalg.qr(projected)[0]
            values, small = np.linalg.eigh(basis.T @ matrix @ basis)
            basis = basis @ small
            slack = 1e-13 * norm
            inside = (values >= low - slack) & (values <= high + slack)
            if inside.sum() >= count:
                error = np.abs(matrix @ basis[:, inside] - basis[:, inside] * values[inside]).max()
                if error < best / 2:
                    best, vectors = error, basis[:, inside]
                else:
                    break  # at rounding level
        if vectors is not None and best <= 1e-10 * norm:
            return vectors
        if size == d:
            raise ArithmeticError(f"{count} eigenvalues between {low} and {high}, not all of them found")
        size = min(d, 2 * size)


def largest_components(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a covariance, falling, and their unit vectors as columns; fewer if the rest is noise.

    Inertia counts of the shifted matrix cut the spectrum into intervals; quadrature of shifted complex solves around each projects onto its
    eigenvectors, which Rayleigh-Ritz extracts; no count may be missed.  A last Rayleigh-Ritz over all intervals makes the vectors orthogonal.
    """
    matrix = np.asarray(matrix, dtype=float)
    trace = float(np.trace(matrix)) if len(matrix) else 0.0
    if not trace > 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    matrix, norm = matrix / trace, 1.0  # eigenvalues lie between 0 and 1

    def above(shift: float) -> int:
        return len(matrix) - negative_count(matrix - shift * np.eye(len(matrix)))

    total = above(NOISE)
    wanted = min(wanted, total)
    parts = [_enclosed(matrix, low, high, count, norm) for low, high, count in _slices(above, NOISE, 1 + 1e-9, wanted)]
    left, size, _ = np.linalg.svd(np.hstack(parts), full_matrices=False)
    basis = left[:, size > 0.5]  # a vector on the edge of two intervals comes twice
    values, small = np.linalg.eigh(basis.T @ matrix @ basis)
    if len(values) < wanted:
        raise ArithmeticError(f"{wanted} components counted, {len(values)} found")
    return values[::-1][:wanted] * trace, (basis @ small)[:, ::-1][:, :wanted]


@dataclass
class Whitening:
    """Count and exact sums of the fitted vectors, their components, and how far whitened vectors are from the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, batch: pa.RecordBatch) -> np.ndarray:
        return _centred(_entries(batch, len(self.sums)), self.n, self.sums)

    def whitened(self, batch: pa.RecordBatch) -> np.ndarray:
        return self.centred(batch) @ (self.components / np.sqrt(self.values))


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` of rows whose vector is there and finite throughout, as doubles."""
    entries = F.col("embedding").cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select("vec_id", entries.alias("vector")).filter(entries.isNotNull() & finite)


def _entries(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """Scaled entries, without the offset, as whole numbers; short vectors end in zeros."""
    lists = batch.column(batch.schema.get_field_index("vector"))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(SCALE * flat), -LIMIT, LIMIT).astype(np.int64)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    out[np.arange(dims) < sizes[:, None]] = whole
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n; the whole part of the mean goes first, exactly."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    part = np.array([s % n / n for s in sums])
    return (x - whole).astype(float) - part


def _added(vectors: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], rows: int, columns: int) -> np.ndarray:
    """Sum over all batches of a matrix each; tasks add up before the shuffle, and as many numbers as it has reach the driver."""

    def add(batches: Batches) -> Batches:
        total = np.zeros((rows, columns))
        for batch in batches:
            total += of(batch)
        i, j = np.indices(total.shape, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    out = np.zeros((rows, columns))
    for i, j, v in vectors.mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = v
    return out


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors, and the exact sum of each dimension's scaled entries; there are as many as the longest vector has."""

    def add(batches: Batches) -> Batches:
        n, totals = 0, []
        for batch in batches:
            lists = batch.column(1)
            longest = int(np.diff(lists.offsets.to_numpy()).max(initial=0))
            x = _entries(batch, longest)
            big = len(x) and int(np.abs(x).max(initial=0)) * len(x) >= 1 << 62
            found = (x.astype(object) if big else x).sum(axis=0).tolist()
            n += len(x)
            totals += [0] * (longest - len(totals))
            for k, v in enumerate(found):
                totals[k] += v
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, len(totals)), pa.int32()), pa.array([str(v) for v in (n, *totals)])], names=["dim", "total"]
        )

    whole = F.sum(F.col("total").cast("decimal(38,0)"))
    found = {dim: int(total) for dim, total in vectors.mapInArrow(add, "dim int, total string").groupBy("dim").agg(whole).collect()}
    return found.get(-1, 0), [found[k] for k in range(len(found) - 1)]


def fit(vectors: DataFrame, wanted: int = 32) -> Whitening:
    """Whitening of all usable vectors.  Three passes: exact sums, centred products, products of the whitened vectors.

    What the driver gets is bounded by the square of the dimension, whatever the number of vectors.
    """
    ship(vectors.sparkSession)
    vectors = usable(vectors)
    n, sums = _sums(vectors)
    d = len(sums)
    model = Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    if not n or not d:
        return model

    def products(batch: pa.RecordBatch) -> np.ndarray:
        x = _centred(_entries(batch, d), n, sums)
        return x.T @ x

    covariance = _added(vectors, products, d, d) / n
    covariance = (covariance + covariance.T) / 2
    model.trace = float(np.trace(covariance))
    model.values, model.components = largest_components(covariance, wanted)
    k = len(model.values)
    if k:
        fitted = model

        def whitened_products(batch: pa.RecordBatch) -> np.ndarray:
            w = fitted.whitened(batch)
            return np.vstack([w.T @ w, w.sum(axis=0)])

        found = _added(vectors, whitened_products, k + 1, k) / n
        model.identity_error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    return model


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n * x - S)^2; null beyond 64 bits."""
    y = x - np.array([s // n for s in sums], dtype=np.int64)
    bound = n * (int(np.abs(y).max(initial=0)) + 1)
    if bound * bound * x.shape[1] >= 1 << 63:
        y = y.astype(object)
    off = n * y - np.array([s % n for s in sums], dtype=y.dtype)
    return [int(v) if v < 1 << 63 else None for v in (off * off).sum(axis=1)]


def whiten(vectors: DataFrame, wanted: int = 32) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per usable vector and component.

    Entries become whole numbers (``SCALE``, ``OFFSET``); components are the unit eigenvectors of their covariance, numbered by falling eigenvalue.

    Rows with a null vector, or null or non-finite entries, go.  Vectors shorter than the longest count as ending in zeros; entries beyond
    2^60 after scaling count as that; a deviation beyond 64 bits is null.  Null and repeated ids give rows each, repeated vectors count each, other
    columns are left out.  Components without variance can't be whitened and are not given, so one vector alone, equal vectors
    and empty tables give no row.  Components of equal eigenvalue are any orthonormal ones, the same for all rows.
    """
    model = fit(vectors, wanted)
    vectors, d = usable(vectors), len(model.sums)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    k = len(model.values)
    explained = model.values / model.trace if k else np.zeros(0)

    def rows(batches: Batches) -> Batches:
        for batch in batches:
            m = batch.num_rows
            if not m or not k:
                continue
            deviations = pa.array(_deviations(_entries(batch, d), model.n, model.sums), pa.int64())
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    deviations.take(pa.array(at)), pa.array(model.whitened(batch).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(rows, schema)
