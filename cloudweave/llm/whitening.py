"""Embedding whitening: the leading eigenvectors of the covariance by Jacobi-Davidson.

The covariance is never formed. A product of it with a few vectors is one pass over the fit list, held as blocks of
rows: each task centres its rows, multiplies and adds up; what reaches the driver is a vector for each one
multiplied. All else, the search space and its Rayleigh-Ritz problem, has as many numbers as a few vectors.

A step takes the Ritz pairs that are not yet within reach of double precision and solves each one's projected correction
equation roughly by MINRES, all at once, so that an inner step is one pass too. Pairs that have
converged are locked, the others' corrections widen the search space, which is cut back to its best Ritz vectors
when it is full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudweave.llm import common
from cloudweave.llm.topk import floor_256

#: Components; vectors of the search space at most, and kept when it is cut back; steps of MINRES; bytes of a block of rows.
COMPONENTS, SPACE, KEPT, INNER, BLOCK = 4, 48, 24, 3, 1 << 18
#: A residual of so many times the largest Ritz value has reached double precision; outer steps at most. A smaller
#: residual than FLOOR that STALLED steps do not halve is as small as the rounding of the sums lets it be.
TOLERANCE, OUTER, FLOOR, STALLED = 2.0**-46, 200, 2.0**-36, 12

_SLOT = "slot int, v double"


def fit_vectors(x: DataFrame, dims: int) -> DataFrame:
    """(n, data): the rows (x) of equal length in blocks of 64-bit integers."""
    rows = max(1, BLOCK // (8 * max(1, dims)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column("x"), dims)
            cuts = range(0, len(m), rows)
            yield pa.RecordBatch.from_arrays([pa.array([len(m[a : a + rows]) for a in cuts], pa.int64()), pa.array([m[a : a + rows].tobytes() for a in cuts], pa.binary())], names=["n", "data"])

    return common.materialize(x.mapInArrow(run, "n long, data binary"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def summed(blocks: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of of(block), a short vector of doubles. Tasks send one sum each, executors add them slot by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            for data in batch.column("data"):
                part = of(np.frombuffer(data.as_buffer(), np.int64).reshape(-1, dims))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["slot", "v"])

    found = dict(blocks.mapInArrow(run, _SLOT).groupBy("slot").agg(F.sum("v")).collect())
    return np.array([found[k] for k in range(len(found))])


def covariance_product(blocks: DataFrame, mean: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """V @ u for a matrix u of a few columns, without V."""
    dims = len(mean)

    def product(u: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return (c.T @ (c @ u)).ravel()

        return summed(blocks, dims, part).reshape(dims, -1) / n

    return product


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """new's columns made orthogonal to basis and each other, without those that have nothing left."""
    out = np.zeros((len(new), 0))
    for v in new.T:
        scale = np.linalg.norm(v)
        for _ in range(3):  # once more than twice is enough
            v = v - basis @ (basis.T @ v)
            v = v - out @ (out.T @ v)
        left = np.linalg.norm(v)
        if left > 1e-10 * scale and left > 0:
            out = np.column_stack([out, v / left])
    return out


def corrections(product: Callable[[np.ndarray], np.ndarray], space: np.ndarray, ritz: np.ndarray, theta: np.ndarray, residual: np.ndarray, steps: int = INNER, enough: float = 1e-3) -> np.ndarray:
    """MINRES for (I - QQ')(V - theta)(I - QQ') t = -r with t orthogonal to Q, for each column of residual.

    Q holds the locked vectors and all of ritz. The columns' recurrences are independent and share each pass over the data.
    """
    q = np.linalg.qr(np.column_stack([space, ritz]))[0]
    project = lambda v: v - q @ (q.T @ v)
    r = project(-residual)
    t = np.zeros_like(r)
    beta = np.linalg.norm(r, axis=0)
    first = np.where(beta > 0, beta, 1)
    v, v_old, w, w_old = r / first, np.zeros_like(r), np.zeros_like(r), np.zeros_like(r)
    c, c_old, s, s_old = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    eta, b = beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        live = np.abs(eta) > enough * beta
        if not live.any():
            break
        p = project(product(v) - theta * v)
        a = (v * p).sum(0)
        p = project(p - a * v - b * v_old)
        b_new = np.linalg.norm(p, axis=0)
        # Givens rotations of the tridiagonal matrix's new column
        r0 = c * a - c_old * s * b
        r1 = np.sqrt(r0**2 + b_new**2)
        r2, r3 = s * a + c_old * c * b, s_old * b
        live &= r1 > 0
        safe = np.where(r1 > 0, r1, 1)
        w_new = (v - r3 * w_old - r2 * w) / safe
        c_new, s_new = r0 / safe, b_new / safe
        t = t + np.where(live, c_new * eta, 0) * w_new
        eta = np.where(live, -s_new * eta, 0)
        v_old, v = v, np.where(b_new > 0, p / np.where(b_new > 0, b_new, 1), 0)
        w_old, w, c_old, c, s_old, s, b = w, w_new, c, c_new, s, s_new, b_new
    return project(t)


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], dims: int, count: int = COMPONENTS, space: int = SPACE, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """The count largest eigenvalues, falling, and their unit eigenvectors in columns (fewer if dims is less).

    Raises ArithmeticError if residuals have not reached double precision after OUTER steps.
    """
    count = min(count, dims)
    locked, values = np.zeros((dims, 0)), np.zeros(0)
    basis = _orthonormal(np.random.default_rng(0).standard_normal((dims, min(dims, 2 * count))), locked)
    image = product(basis)
    largest, best, since = 0.0, np.inf, 0
    for _ in range(OUTER):
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, ritz_image = basis @ turn, image @ turn
        want = count - locked.shape[1]
        residual = ritz_image[:, :want] - theta[:want] * ritz[:, :want]
        residual -= locked @ (locked.T @ residual)
        largest = max([largest, *theta[:1], *values])
        size = np.linalg.norm(residual, axis=0)
        whole = basis.shape[1] + locked.shape[1] == dims  # then Ritz pairs are the eigenpairs
        # The leading pairs that have converged are locked: a later one may still be overtaken.
        best, since = (size[0], 0) if size[0] < best / 2 else (best, since + 1)
        done = int(since >= STALLED and size[0] <= FLOOR * largest)
        while done < want and (size[done] <= TOLERANCE * largest or whole):
            done += 1
        if done:
            best, since = np.inf, 0
            locked, values = np.column_stack([locked, ritz[:, :done]]), np.append(values, theta[:done])
            basis, image = ritz[:, done:], ritz_image[:, done:]
            if locked.shape[1] == count:
                order = np.argsort(-values, kind="stable")
                return values[order], locked[:, order]
            ritz, ritz_image, theta, residual, want, size = basis, image, theta[done:], residual[:, done:], want - done, size[done:]
        if basis.shape[1] + want > space and basis.shape[1] > kept:
            basis, image = ritz[:, :kept], ritz_image[:, :kept]
        open_ = size > TOLERANCE * largest
        open_ = open_ if open_.any() else np.ones(want, bool)
        new = corrections(product, locked, ritz[:, :want], theta[:want][open_], residual[:, open_])
        new = _orthonormal(new, np.column_stack([locked, basis]))
        if not new.shape[1]:  # nothing left to add from the corrections
            new = _orthonormal(np.random.default_rng(basis.shape[1]).standard_normal((dims, want)), np.column_stack([locked, basis]))
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
    raise ArithmeticError(f"a residual of {best:g} is left after {OUTER} steps")


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each vector and leading component.

    Components x of a vector become floor(256 x). The fit list is each distinct vector once, n in all; mean and
    covariance (divisor n) are over it. Null vectors, and those with null or non-finite components, are dropped.
    Repeated ids and null ids have rows of their own. Vectors of unlike length count as if the shorter ended in
    zeros. A component without variance (its eigenvalue is rounding only) cannot be whitened and has no rows, so
    one distinct vector, or none, gives no rows. A deviation beyond 64 bits is null; a component beyond them is held at their ends.
    """
    x = vectors.select(F.col(id_column).cast("long").alias("vec_id"), floor_256(F.col(vector_column)).alias("x")).where("x is not null")
    dims, least = x.agg(F.max(F.size("x")), F.min(F.size("x"))).head()
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    none = vectors.sparkSession.createDataFrame([], shape)
    if not dims:
        return none
    if least < dims:
        x = x.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))))
    blocks = fit_vectors(x.select("x").distinct(), dims)
    n = blocks.agg(F.sum("n")).head()[0]
    S = exact_sums(blocks, dims)
    mean = np.array([s / n for s in S])  # rounded once
    product = covariance_product(blocks, mean, n)
    trace = float(summed(blocks, dims, lambda b: np.array([((b - mean) ** 2).sum()]))[0]) / n
    if not trace > 0:
        return none
    values, axes = eigenpairs(product, dims, components)
    full = values > 64 * np.finfo(float).eps * trace
    values, axes = values[full], axes[:, full]
    k = len(values)
    scaled = axes / np.sqrt(values)

    def moments(b: np.ndarray) -> np.ndarray:
        z = (b - mean) @ scaled
        return np.concatenate([z.sum(0), (z.T @ z).ravel()])

    found = summed(blocks, dims, moments) / n
    error = float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())
    explained = values / trace
    common.discard(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = matrix(batch.column("x"), dims)
            z, each = (m - mean) @ scaled, np.repeat(np.arange(len(m)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))), pa.array(np.full(len(each), n)), deviations(m, n, S).take(pa.array(each)), pa.array(z.ravel()), pa.array(np.tile(explained, len(m))), pa.array(np.full(len(each), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(run, shape)


def exact_sums(blocks: DataFrame, dims: int) -> list[int]:
    """The sum of each dimension, in integers. Halves of 32 bits are added apart, so that no sum leaves 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            for data in batch.column("data"):
                x = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, dims)
                low, high = low + (x & 0xFFFFFFFF).sum(0), high + (x >> 32).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(low), pa.array(high)], names=["slot", "low", "high"])

    total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high")]
    found = {r.slot: int(r.low) + (int(r.high) << 32) for r in blocks.mapInArrow(run, "slot int, low long, high long").groupBy("slot").agg(*total).collect()}
    return [found[k] for k in range(dims)]


def deviations(m: np.ndarray, n: int, S: list[int]) -> pa.Array:
    """The sum of (n x - S)^2 of each row, exact; null beyond 64 bits."""
    far = max(n * int(m.max(initial=0)) - min(S), max(S) - n * int(m.min(initial=0)), 0)
    if far * far * m.shape[1] < 2**63:
        return pa.array(((n * m - np.array(S, np.int64)) ** 2).sum(1))
    total = [sum((n * x - s) ** 2 for x, s in zip(row, S, strict=True)) for row in m.tolist()]
    return pa.array([t if t < 2**63 else None for t in total], pa.int64())
