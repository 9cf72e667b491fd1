"""Whitening of vectors by their leading principal components, found by Jacobi-Davidson.

The covariance is never formed. Where it is needed, its product with a block of
vectors is summed over the stored, centred rows by Spark tasks (a "pass"). The driver
holds a subspace of a few dozen vectors of one row's width: Rayleigh-Ritz gives the best
approximations in it; for each that isn't accurate yet, MINRES solves the
projected correction equation, all of them in step, one pass a step; the corrections
widen the subspace, which is cut back to its best part when it grows too wide.
Components whose residuals have reached double precision are locked, and all further
work is done orthogonally to them.

Entries become integers first, so that sums are exact. The fit uses each distinct vector
once and divides by their number. Rows are centred exactly ((n * x - S) / n, with n * x
- S in whole numbers) before anything is multiplied.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are
left out; equal vectors get equal results; rows that share an id each get theirs; a null
id stays null; vectors of unequal lengths raise an error, and so do entries or
deviations beyond 64 bits. A component whose variance is zero, to double precision, can't
be scaled and is left out: with fewer than two distinct vectors there is none. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rolecall.llm.scratch import written

EPS = np.finfo(np.float64).eps
_BLOCK_BYTES, _BLOCK_ROWS = 4 << 20, 1024
_LIMIT = 1 << 62

Operator = Callable[[np.ndarray], np.ndarray]


# -- the eigensolver: everything here is of one row's width -----------------------------


@dataclass
class Eigenpairs:
    values: np.ndarray
    vectors: np.ndarray  # one column each
    residuals: np.ndarray
    passes: int


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to the bases; may have fewer columns."""
    out = np.zeros((len(new), 0))
    for column in new.T:
        length = np.linalg.norm(column)
        if not length:
            continue
        column = column / length
        for _ in range(3):
            for basis in (*bases, out):
                column = column - basis @ (basis.T @ column)
            left = np.linalg.norm(column)
            if left < 1e-10:
                break
            column = column / left
        else:
            out = np.column_stack([out, column])
    return out


def _corrections(
    apply: Operator,
    known: np.ndarray,
    ritz: np.ndarray,
    values: np.ndarray,
    residuals: np.ndarray,
    steps: int,
) -> np.ndarray:
    """MINRES on (I - QQ')(A - value)(I - QQ') t = -residual, for all columns in step.

    Q holds the locked vectors and the column's own Ritz vector.
    """

    def projected(block: np.ndarray) -> np.ndarray:
        block = block - known @ (known.T @ block)
        return block - ritz * (ritz * block).sum(axis=0)

    width = residuals.shape[1]
    v = projected(-residuals)
    beta = np.linalg.norm(v, axis=0)
    start = np.maximum(beta, np.finfo(float).tiny)
    v, v_old = v / start, np.zeros_like(v)
    w, w_old = np.zeros_like(v), np.zeros_like(v)
    found = np.zeros_like(v)
    c_old, s_old, c, s = np.ones(width), np.zeros(width), np.ones(width), np.zeros(width)
    eta, beta = beta.copy(), np.zeros(width)
    going = start > np.finfo(float).tiny
    for _ in range(steps):
        u = projected(apply(v) - v * values)
        alpha = (v * u).sum(axis=0)
        u = u - alpha * v - beta * v_old
        beta_new = np.linalg.norm(u, axis=0)
        # The last two rotations, then a new one that removes beta_new.
        delta = c * alpha - c_old * s * beta
        rho_1 = np.hypot(delta, beta_new)
        rho_2 = s * alpha + c_old * c * beta
        rho_3 = s_old * beta
        safe = np.where(rho_1 > 0, rho_1, 1)
        c_old, s_old = c, s
        c, s = delta / safe, beta_new / safe
        step = (v - rho_3 * w_old - rho_2 * w) / safe
        w_old, w = w, step
        found = found + np.where(going & (rho_1 > 0), c * eta, 0) * step
        eta = -s * eta
        going = going & (beta_new > 1e-12 * (np.abs(values) + np.abs(alpha))) & (rho_1 > 0)
        if not going.any():
            break
        v_old, v = v, u / np.where(beta_new > 0, beta_new, 1)
        beta = beta_new
    return projected(found)


def jacobi_davidson(
    apply: Operator,
    size: int,
    wanted: int,
    scale: float,
    inner: int = 6,
    extra: int = 4,
    widest: int = 64,
    rounds: int = 200,
    roundings: float = 64,
    seed: int = 42,
) -> Eigenpairs:
    """The ``wanted`` largest eigenpairs of a symmetric operator, by falling value.

    ``apply`` multiplies a block of columns; ``scale`` bounds the largest eigenvalue
    (the trace will do). A pair is locked once its residual is within ``roundings``
    roundings of the largest value.
    """
    wanted = min(wanted, size)
    passes = 0

    def counted(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return apply(block)

    rng = np.random.default_rng(seed)
    locked, values, errors = np.zeros((size, 0)), [], []
    start = min(size, wanted + extra)
    basis = _orthonormal(rng.normal(size=(size, start)))
    image = counted(basis)
    widest = max(widest, 2 * start)
    for _ in range(rounds):
        small = basis.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, ritz_image = basis @ y, image @ y
        need = min(wanted - len(values), len(theta))
        top = max([*values, *theta[:1], 0.0])
        residuals = ritz_image[:, :need] - ritz[:, :need] * theta[:need]
        residuals = residuals - locked @ (locked.T @ residuals)
        norms = np.linalg.norm(residuals, axis=0)
        whole = basis.shape[1] + locked.shape[1] >= size
        within = roundings * EPS * max(top, EPS * scale)
        # Only a leading run is locked: a smaller value may yet be overtaken.
        done = need if whole else int(np.argmin(np.r_[norms <= within, False]))
        if done:
            locked = np.column_stack([locked, ritz[:, :done]])
            values += theta[:done].tolist()
            errors += norms[:done].tolist()
            basis, image = ritz[:, done:], ritz_image[:, done:]
            ritz, ritz_image = basis, image
            theta, residuals, norms = theta[done:], residuals[:, done:], norms[done:]
            need -= done
        if len(values) >= wanted:
            break
        open_ = np.flatnonzero(norms > within) if need else np.zeros(0, int)
        if not len(open_):
            fresh = rng.normal(size=(size, 1))
        else:
            fresh = _corrections(
                counted, locked, ritz[:, open_], theta[open_], residuals[:, open_], inner
            )
        fresh = fresh[:, : size - basis.shape[1] - locked.shape[1]]
        if basis.shape[1] + fresh.shape[1] > widest:
            kept = min(basis.shape[1], wanted - len(values) + extra)
            basis, image = ritz[:, :kept], ritz_image[:, :kept]
        fresh = _orthonormal(fresh, locked, basis)
        if not fresh.shape[1]:
            fresh = _orthonormal(rng.normal(size=(size, 1)), locked, basis)
        if not fresh.shape[1]:
            raise ArithmeticError("the subspace can't be widened")
        basis = np.column_stack([basis, fresh])
        image = np.column_stack([image, counted(fresh)])
    else:
        raise ArithmeticError(f"residuals {norms} after {rounds} rounds")
    order = np.argsort(-np.array(values), kind="stable")
    return Eigenpairs(
        np.array(values)[order], locked[:, order], np.array(errors)[order], passes
    )


# -- the rows, in Spark ------------------------------------------------------------------


def integer_vectors(
    rows: DataFrame, vector_col: str, scale: int = 64, shift: int = 1_000_000
) -> DataFrame:
    """Adds ``x``: floor(scale * c) + shift of each entry; drops rows without a vector."""
    vector = F.col(vector_col)
    sound = F.forall(
        vector,
        lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))),
    )
    usable = rows.where(vector.isNotNull() & (F.size(vector) > 0) & sound)

    def whole(c: Column) -> Column:
        scaled = scale * c.cast("double")
        fits = F.abs(scaled) < F.lit(float(_LIMIT))
        return F.when(fits, F.floor(scaled) + F.lit(shift)).otherwise(
            F.raise_error(F.lit("an entry doesn't fit in 64 bits"))
        )

    return usable.withColumn("x", F.transform(vector, whole))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _deviations(whole: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S in whole numbers."""
    least, most = int(whole.min(initial=0)), int(whole.max(initial=0))
    if n * max(abs(least), abs(most)) > _LIMIT:
        raise OverflowError("sums of the entries don't fit in 64 bits")
    return n * whole - sums


@dataclass
class Fit:
    """What whitening needs: n, S, the components and the variances along them."""

    n: int
    sums: np.ndarray
    trace: float
    pairs: Eigenpairs
    identity_error: float

    def deviation(self, whole: np.ndarray) -> np.ndarray:
        """The sum of (n * x - S) ** 2 for each row, exact."""
        apart = _deviations(whole, self.n, self.sums)
        most = int(np.abs(apart).max(initial=0))
        if most * most * whole.shape[1] > _LIMIT:
            raise OverflowError("deviations don't fit in 64 bits")
        return (apart * apart).sum(axis=1)

    def whitened(self, whole: np.ndarray) -> np.ndarray:
        centred = _deviations(whole, self.n, self.sums) / self.n
        return centred @ self.pairs.vectors / np.sqrt(self.pairs.values)


def _centred_blocks(distinct: DataFrame, n: int, sums: np.ndarray) -> DataFrame:
    """The centred rows as matrices of doubles, a few megabytes each."""
    width = len(sums)
    most = max(1, min(_BLOCK_ROWS, _BLOCK_BYTES // (8 * width)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, most):
                whole = _matrix(batch.column(0).slice(begin, most), width)
                block = (_deviations(whole, n, sums) / n).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.binary())], names=["block"]
                )

    return distinct.select("x").mapInArrow(pack, "block binary")


def _summed(blocks: DataFrame, width: int, per_block: Callable) -> np.ndarray:
    """The sum over all blocks of ``per_block(matrix)``, an array of fixed shape.

    Each task adds up its own blocks; Spark adds up the tasks' entries, so that the
    driver receives one array however many tasks there are.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = lost = None
        for batch in batches:
            for block in batch.column(0):
                matrix = np.frombuffer(block.as_buffer(), np.float64).reshape(-1, width)
                part = per_block(matrix)
                if total is None:
                    total, lost = part, np.zeros_like(part)
                    continue
                # What rounding loses is carried along, so that blocks add no error.
                new = total + part
                moved = new - total
                lost += (total - (new - moved)) + (part - moved)
                total = new
        if total is not None:
            flat = (total + lost).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)],
                names=["at", "part"],
            )

    parts = blocks.mapInArrow(add, "at int, part double")
    rows = parts.groupBy("at").agg(F.sum("part").alias("total")).orderBy("at").collect()
    return np.array([r["total"] for r in rows])


def fit(vectors: DataFrame, components: int = 16, **solver) -> Fit | None:
    """The fit over the distinct vectors of ``x``; None where no component has variance."""
    distinct = written(vectors.select("x").distinct(), "distinct-vectors")
    shape = distinct.agg(
        F.count("*"), F.min(F.size("x")), F.max(F.size("x"))
    ).first()
    n, width = shape[0], shape[2]
    if not n:
        return None
    if shape[1] != width:
        raise ValueError(f"vectors have from {shape[1]} to {width} entries")
    summed = distinct.select(F.posexplode("x").alias("at", "entry")).groupBy("at")
    rows = summed.agg(F.sum("entry").alias("total")).orderBy("at").collect()
    sums = np.array([r["total"] for r in rows], np.int64)
    blocks = written(_centred_blocks(distinct, n, sums), "centred")

    # Each square is of a centred entry, so the trace has full relative accuracy.
    trace = float(_summed(blocks, width, lambda m: np.array([np.vdot(m, m)]))[0]) / n
    if not trace > 0:
        return None
    spark = vectors.sparkSession

    def apply(block: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(block)  # width x a few dozen
        try:
            total = _summed(blocks, width, lambda m: m.T @ (m @ shared.value))
        finally:
            shared.unpersist()
        return total.reshape(width, -1) / n

    # Rounding in the sums over the tasks' blocks grows with the root of their number.
    noise = 64 + 4 * np.sqrt(blocks.count())
    solver = {"roundings": noise} | solver
    pairs = jacobi_davidson(apply, width, components, trace, **solver)
    real = pairs.values > 64 * EPS * width * pairs.values[0]
    pairs = Eigenpairs(
        pairs.values[real], pairs.vectors[:, real], pairs.residuals[real], pairs.passes
    )
    scaled = spark.sparkContext.broadcast(pairs.vectors / np.sqrt(pairs.values))

    def white_products(matrix: np.ndarray) -> np.ndarray:
        white = matrix @ scaled.value
        return np.vstack([white.T @ white, white.sum(axis=0)])

    total = _summed(blocks, width, white_products).reshape(-1, real.sum())
    mean = total[-1] / n
    apart = total[:-1] / n - np.outer(mean, mean) - np.eye(real.sum())
    return Fit(n, sums, trace, pairs, float(np.abs(apart).max()))




def whiten(
    rows: DataFrame,
    vector_col: str = "embedding",
    components: int = 16,
    scale: int = 64,
    shift: int = 1_000_000,
    into: str = "whitening",
    **solver,
) -> DataFrame:
    """``rows`` with a column ``into``, an array of one entry for each component.

    An entry is {component, whitened, explained}. Beside it, ``into`` holds n, the row's
    exact deviation from the mean, and identity_error, the largest entry by which the
    whitened fit vectors' covariance differs from the identity. Rows without a usable
    vector are dropped; all columns stay but one named ``into``.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns if c != into]
    vectors = integer_vectors(
        rows.select(F.struct(*kept).alias("row"), F.col(f"`{vector_col}`").alias("v")),
        "v", scale, shift,
    ).select("row", "x")
    found = fit(vectors, components, **solver)
    kind = (
        "struct<n: long, deviation: long, identity_error: double, components: "
        "array<struct<component: int, whitened: double, explained: double>>>"
    )
    if found is None:
        return vectors.select("row.*", F.lit(None).cast(kind).alias(into)).limit(0)
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = shared.value
        k = len(fitted.pairs.values)
        explained = fitted.pairs.values / fitted.trace
        for batch in batches:
            whole = _matrix(batch, len(fitted.sums))
            rows = len(whole)
            entries = pa.StructArray.from_arrays(
                [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(fitted.whitened(whole).ravel()),
                    pa.array(np.tile(explained, rows)),
                ],
                names=["component", "whitened", "explained"],
            )
            ends = pa.array(np.arange(0, rows * k + 1, k, dtype=np.int32))
            yield pa.StructArray.from_arrays(
                [
                    pa.array(np.full(rows, fitted.n)),
                    pa.array(fitted.deviation(whole)),
                    pa.array(np.full(rows, fitted.identity_error)),
                    pa.ListArray.from_arrays(ends, entries),
                ],
                names=["n", "deviation", "identity_error", "components"],
            )

    project.__annotations__ = {
        "batches": Iterator[pa.Array],
        "return": Iterator[pa.Array],
    }
    udf = F.arrow_udf(project, returnType=kind)
    return vectors.select("row.*", udf("x").alias(into))
