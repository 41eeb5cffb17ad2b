"""Embedding whitening by a block Jacobi-Davidson method.

The covariance is never formed: each product with a block of vectors is one job
over the distinct vectors, centred before they are multiplied. The driver holds
matrices of the dimension alone. Ritz pairs of a growing space are corrected by
their projected correction equations, solved by inner MINRES, whose products
share one job for all pairs; a pair is locked once its residual reaches double
precision.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Tasks that add up the partial sums of a job; the driver gets as many rows.
_ADDERS = 8
_EPS = float(np.finfo(np.float64).eps)
#: A space of so many times the wanted components is cut back to its leading Ritz vectors.
_SPACE = 4
_INNER = 6


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _added(df: DataFrame, part: Callable, kind: type, size: int) -> np.ndarray:
    """The sum of part(x) over the Arrow batches of df (x), an array of so many numbers: first in each task, then in a few tasks, then on the driver."""

    def total(arrays):
        sum_, rest, any_ = np.zeros(size, kind), np.zeros(size, kind), False
        for a in arrays:
            any_ = True
            if kind is np.float64:  # what an addition rounds off is added with the next one
                a = a - rest
                new = sum_ + a
                rest, sum_ = (new - sum_) - a, new
            else:
                sum_ = sum_ + a
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([sum_.tobytes()], pa.binary())], ["sum"])

    def here(batches):
        return total(part(b.column("x")) for b in batches if b.num_rows)

    def there(batches):
        return total(np.frombuffer(x, kind) for b in batches for x in b.column("sum").to_pylist())

    rows = df.mapInArrow(here, "sum binary").repartition(_ADDERS).mapInArrow(there, "sum binary").collect()
    return sum((np.frombuffer(r["sum"], kind) for r in rows), np.zeros(size, kind))


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """new's columns made orthonormal to basis and to each other; those that hardly add a direction are left out."""
    out = basis
    for column in new.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        v = column / size
        for _ in range(3):
            v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            out = np.column_stack((out, v))
    return out[:, basis.shape[1] :]


def _corrections(product: Callable, ritz: np.ndarray, theta: np.ndarray, residual: np.ndarray, locked: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t of (I - QQ')(V - theta I)(I - QQ') t = -residual for each Ritz vector, Q being it and the locked ones: MINRES in step."""

    def out_of(y):
        y = y - locked @ (locked.T @ y)
        return y - ritz * np.sum(ritz * y, 0)

    safe = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b != 0)
    b = out_of(-residual)
    beta = np.linalg.norm(b, axis=0)
    start = beta.copy()
    t, v0, v1 = np.zeros_like(b), np.zeros_like(b), safe(b, np.broadcast_to(beta, b.shape))
    w0, w1 = np.zeros_like(b), np.zeros_like(b)
    eta, c0, c1, s0, s1 = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    last = np.zeros_like(beta)  # the coupling of v0 and v1
    for _ in range(steps):
        if np.all(np.abs(eta) <= 1e-3 * start):
            break
        av = out_of(product(v1) - v1 * theta)
        alpha = np.sum(v1 * av, 0)
        v2 = av - v1 * alpha - v0 * last
        beta = np.linalg.norm(v2, axis=0)
        delta, r2, r3 = c1 * alpha - c0 * s1 * last, s1 * alpha + c0 * c1 * last, s0 * last
        r1 = np.hypot(delta, beta)
        c2, s2 = safe(delta, r1), safe(beta, r1)
        w2 = safe(v1 - w0 * r3 - w1 * r2, np.broadcast_to(r1, v1.shape))
        t = t + w2 * (c2 * eta)
        eta = -s2 * eta
        v0, v1, w0, w1 = v1, safe(v2, np.broadcast_to(beta, v2.shape)), w1, w2
        c0, c1, s0, s1, last = c1, c2, s1, s2, beta
    return out_of(t)


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], size: int, count: int, rounds: int = 200, inner: int = _INNER) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues, falling, and unit eigenvectors (columns) of the symmetric matrix of that size that product multiplies by.

    Raises RuntimeError if the residuals don't come down to double precision of
    the largest eigenvalue.
    """
    count = min(size, count)
    aim = 2 * max(size, 64) * _EPS
    basis = _orthonormal(np.random.default_rng(20240301).standard_normal((size, min(size, count + 4))), np.zeros((size, 0)))
    image = product(basis)
    whole = 0  # times that the whole space was gone through
    for _ in range(rounds):
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        residual = image[:, :count] - basis[:, :count] * theta[:count]
        left = np.linalg.norm(residual, axis=0) / max(np.abs(theta).max(), np.finfo(float).tiny)
        done = left <= aim
        if done.all() or (whole and left.max() <= 100 * aim):
            return theta[:count], basis[:, :count]
        if basis.shape[1] == size:
            if whole == 3:
                break
            whole += 1
            basis = np.linalg.qr(basis)[0]
            image = product(basis)
            continue
        live = np.flatnonzero(~done)
        new = _corrections(product, basis[:, live], theta[live], residual[:, live], basis[:, :count][:, done], inner)
        if basis.shape[1] + len(live) > max(_SPACE * count, count + 4 + len(live)):
            basis, image = basis[:, : count + 4], image[:, : count + 4]
        new = _orthonormal(new, basis)
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(basis.shape[1]).standard_normal((size, 1)), basis)
        basis, image = np.column_stack((basis, new)), np.column_stack((image, product(new)))
    raise RuntimeError("the eigenvectors' residuals didn't reach double precision")


def integers(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """vectors -> row (the other columns), x (floor(64 * entry) + 1000000 for each entry, array<long>).

    Rows go whose vector is null or holds null or non-finite entries; so do
    those whose vector is shorter than the longest one, as entries are missing.
    """
    c = F.col(f"`{vector_col}`").cast("array<double>")
    fine = vectors.where(c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    width = fine.agg(F.max(F.size(c))).first()[0] or 0
    row = F.struct(*[F.col(f"`{x}`") for x in vectors.columns if x != vector_col])
    return fine.where((F.size(c) == width) & F.lit(width > 0)).select(row.alias("row"), F.transform(c, lambda v: F.floor(v * SCALE).cast("long") + SHIFT).alias("x"))


def whitened(vectors: DataFrame, count: int = COMPONENTS, vector_col: str = "embedding") -> DataFrame:
    """vectors -> row, n, deviation, whitened, explained (arrays by component), identity_error for each row that `integers` keeps.

    The fit list is each distinct x once: n vectors with sums S. `deviation` is
    the exact sum of (n * x - S)**2, decimal(38,0). `whitened` holds x - S / n
    projected on the leading eigenvectors of the fit list's covariance, over the
    root of the eigenvalue; null for components without variance (with one
    distinct vector, all). `explained` is the eigenvalue's share of the trace.
    `identity_error` is the largest absolute entry of the whitened fit list's
    covariance minus the identity, over the components that have variance.
    Vectors of fewer dimensions than `count` have so many components; repeated
    rows get the same result each; no vectors give no rows; the other columns
    stay in `row`.
    """
    rows = integers(vectors, vector_col)
    schema = f"row {rows.schema['row'].dataType.simpleString()}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    fit = stored(rows.select("x").distinct(), "fit")
    first = fit.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
    n, width = first["n"], first["width"]
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    sums = [int(s) for s in _added(fit, lambda x: _matrix(x, width).sum(0), np.int64, width)]
    floor = np.array([s // n for s in sums], np.int64)
    over = [s % n for s in sums]  # S = n * floor + over, so that x - S / n loses nothing to the shift
    mean = np.array([o / n for o in over])
    centred = lambda x: (_matrix(x, width) - floor) - mean

    def product(block: np.ndarray) -> np.ndarray:
        def part(x):
            z = centred(x)
            return (z.T @ (z @ block)).ravel()

        return _added(fit, part, np.float64, block.size).reshape(block.shape) / n

    spread = _added(fit, lambda x: np.concatenate(((centred(x) ** 2).sum(0), np.zeros(1))), np.float64, width + 1)[:-1] / n
    trace = float(spread.sum())
    value, axis = leading_pairs(product, width, count) if trace else (np.zeros(min(width, count)), np.eye(width)[:, :count])
    has = value > 4 * max(width, 64) * _EPS * trace
    scaled = axis[:, has] / np.sqrt(value[has])
    explained = np.where(has, value / trace, 0.0).tolist() if trace else [0.0] * len(value)
    k = int(has.sum())
    error = 0.0
    if k:
        middle = _added(fit, lambda x: (centred(x) @ scaled).sum(0), np.float64, k) / n

        def squared(x):
            w = centred(x) @ scaled - middle
            return (w.T @ w).ravel()

        error = float(np.abs(_added(fit, squared, np.float64, k * k).reshape(k, k) / n - np.eye(k)).max())

    def results(batches):
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column("x"), width) - floor
            if float((np.abs(x).max(0).astype(float) * n + n).max()) ** 2 * width < 2.0**62:
                step = x * n - np.array(over, np.int64)
                far = [Decimal(v) for v in (step * step).sum(1).tolist()]
            else:
                step = x.astype(object) * n - np.array(over, object)
                far = [Decimal(int(v)) for v in (step * step).sum(1)]
            white = np.full((m, len(value)), np.nan)
            white[:, has] = (x - mean) @ scaled
            flat = pa.array(white.ravel(), pa.float64(), mask=np.isnan(white.ravel()))
            each = np.arange(0, (m + 1) * len(value), len(value), dtype=np.int32) if len(value) else np.zeros(m + 1, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array([n] * m, pa.int64()),
                    pa.array(far, pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(pa.array(each), flat),
                    pa.array([explained] * m, pa.list_(pa.float64())),
                    pa.array([error] * m, pa.float64()),
                ],
                ["row", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(results, schema)
