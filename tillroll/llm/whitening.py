"""Whitening of embeddings on fixed-point entries.

1. An entry c becomes the whole number floor(256 * c); the fit list holds each distinct vector once.
2. Count and sums of the fit list are exact. The scatter is summed in the tasks from centred vectors.
3. Pivoted Cholesky factors the covariance: the largest remaining diagonal entry is next, and it ends where
   nothing but rounding is left, so a covariance of less than full rank has a factor of fewer columns.
4. One-sided Jacobi turns the columns of that triangular factor until they are orthogonal. Their squared
   norms are the eigenvalues, the normalised columns the components; the covariance is not touched again.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.scratch import stored

SCALE = 256
COMPONENTS = 4
MOST_DIMENSIONS = 4096  # the covariance of so many is 134 MB on the driver
_ADDERS = 16
_WIDTHS = (1, 2, 4, 8)


def _fixed(values: np.ndarray) -> bytes | None:
    """The entries floor(256 * c) as bytes, the width of one first; None if one is no 64-bit number."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if not (np.abs(scaled) < 2.0**63).all():  # false for NaN too
        return None
    whole = scaled.astype(np.int64)
    low, high = (int(whole.min()), int(whole.max())) if len(whole) else (0, 0)
    width = next(w for w in _WIDTHS if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return bytes([width]) + whole.astype(f"<i{width}").tobytes()


def _entries(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<i{x[0]}", offset=1).astype(np.int64)


def _fixed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, found, sizes = [], [], []
        for i, item in enumerate(batch.column(1)):
            if item.is_valid and item.values.null_count == 0:
                x = _fixed(item.values.to_numpy(zero_copy_only=False))
                if x is not None:
                    kept.append(i)
                    found.append(x)
                    sizes.append(len(item.values))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(found, pa.binary()), pa.array(sizes, pa.int32())],
            ["vec_id", "x", "size"],
        )


def fixed_vectors(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, x (fixed-point entries), size of the rows whose vector is complete and finite."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    return embeddings.select("vec_id", column).mapInArrow(_fixed_rows, f"vec_id {kind}, x binary, size int")


def _sums(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dimensions, object)
        for batch in batches:
            block = np.zeros(dimensions, np.int64)
            for x in batch.column(0):
                own = _entries(x.as_py())
                if len(x.as_py()) > 1 + 4 * dimensions:  # 64-bit entries
                    sums = sums + own.astype(object)
                else:
                    block += own
            sums = sums + block.astype(object)
            n += batch.num_rows
        values = [Decimal(int(v)) for v in [n, *sums]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, dimensions, dtype=np.int32)), pa.array(values, pa.decimal128(38, 0))], ["i", "value"]
        )

    return run


def _scatter(mean: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for at in range(0, len(rows), 2000):
                centred = np.stack([_entries(x) for x in rows[at : at + 2000]]) - mean
                total += centred.T @ centred
        yield from _matrix(total)

    return run


def _whitened_scatter(mean: np.ndarray, projection: np.ndarray):
    """Of the whitened vectors w with a 1 behind them: sums of w wT, of w and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((projection.shape[1] + 1,) * 2)
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for at in range(0, len(rows), 2000):
                w = (np.stack([_entries(x) for x in rows[at : at + 2000]]) - mean) @ projection
                w = np.column_stack([w, np.ones(len(w))])
                total += w.T @ w
        yield from _matrix(total)

    return run


def _matrix(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(total), 64):
        part = total[at : at + 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array([r.tobytes() for r in part], pa.binary())], ["i", "row"]
        )


def _added(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions, dimensions))
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[i] += np.frombuffer(row.as_py())
        yield from _matrix(total)

    return run


def _total(fit: DataFrame, part, dimensions: int) -> np.ndarray:
    """The sum of the matrices that the tasks over `fit` make, row by row, in a fixed number of adders."""
    schema = "i int, row binary"
    adders = fit.mapInArrow(part, schema).repartition(_ADDERS).mapInArrow(_added(dimensions), schema)
    rows = adders.repartition(1).mapInArrow(_added(dimensions), schema).collect()
    return np.stack([np.frombuffer(r["row"]) for r in sorted(rows, key=lambda r: r["i"])])


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """L with matrix = L LT, a column per pivot: lower triangular if its rows are taken in pivot order."""
    size = len(matrix)
    factor, columns, done = np.zeros((size, size)), 0, []
    diagonal = np.diag(matrix).copy()
    least = size * np.finfo(float).eps * max(float(diagonal.max(initial=0.0)), 0.0)
    while columns < size:
        k = int(np.argmax(diagonal))
        if diagonal[k] <= least:
            break
        column = (matrix[:, k] - factor[:, :columns] @ factor[k, :columns]) / np.sqrt(diagonal[k])
        column[done] = 0.0
        factor[:, columns] = column
        diagonal = np.maximum(diagonal - column * column, 0.0)
        diagonal[k] = 0.0
        done.append(k)
        columns += 1
    return factor[:, :columns]


def one_sided_jacobi(factor: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(squared norms, unit columns) of the factor with its columns turned until they are orthogonal.

    Largest first. A round turns disjoint pairs of columns at once; a sweep has a round for every way to pair
    them off, so that each pair meets once.
    """
    a = factor.T.copy()  # a row per column
    count = len(a)
    seats = list(range(count + count % 2))  # the last is nobody where the number is odd
    for _ in range(sweeps):
        turned = False
        for _ in range(max(0, len(seats) - 1)):
            half = len(seats) // 2
            pairs = [(x, y) for x, y in zip(seats[:half], reversed(seats[half:])) if max(x, y) < count]
            p, q = np.array(pairs, int).reshape(-1, 2).T
            seats = [seats[0], seats[-1], *seats[1:-1]]
            alpha, beta, gamma = (a[p] ** 2).sum(1), (a[q] ** 2).sum(1), (a[p] * a[q]).sum(1)
            on = np.abs(gamma) > tolerance * np.sqrt(alpha * beta)
            if not on.any():
                continue
            turned = True
            p, q, alpha, beta, gamma = p[on], q[on], alpha[on], beta[on], gamma[on]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
        if not turned:
            break
    values = (a**2).sum(1)
    order = np.argsort(-values, kind="stable")
    return values[order], (a[order] / np.sqrt(values[order])[:, None]).T


class Whitening(NamedTuple):
    """n and the sums of the fit list, exact; eigenvalues, largest first; components as columns; the trace
    of the covariance; identity_error: how far the whitened fit list's covariance is from the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float


def fit_whitening(vectors: DataFrame, dimensions: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of fixed_vectors of one size: of each distinct vector once."""
    fit = stored(vectors.where(F.col("size") == dimensions).select("x").distinct(), "fit-list")
    exact = {r["i"]: int(r["value"]) for r in fit.mapInArrow(_sums(dimensions), "i int, value decimal(38,0)").groupBy("i").agg(F.sum("value").alias("value")).collect()}
    n, sums = exact.get(-1, 0), [exact.get(i, 0) for i in range(dimensions)]
    if not n or not dimensions:
        return Whitening(n, sums, np.zeros(0), np.zeros((dimensions, 0)), 0.0, 0.0)
    mean = np.array([s / n for s in sums])
    covariance = _total(fit, _scatter(mean), dimensions) / n
    values, turned = one_sided_jacobi(pivoted_cholesky(covariance))
    values, turned = values[:components], turned[:, :components]
    error = 0.0
    if len(values):
        w = _total(fit, _whitened_scatter(mean, turned / np.sqrt(values)), len(values) + 1)
        centre = w[-1, :-1] / n
        error = float(np.abs(w[:-1, :-1] / n - np.outer(centre, centre) - np.eye(len(values))).max())
    return Whitening(n, sums, values, turned, float(np.trace(covariance)), error)


def _whitened(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean = np.array([s / model.n for s in model.sums])
        sums, projection = np.array(model.sums, object), model.components / np.sqrt(model.values)
        many = len(model.values)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                x = np.stack([_entries(v.as_py()) for v in part.column(1)])
                reach = model.n * int(np.abs(x).max()) + max(abs(s) for s in model.sums)
                wide = reach * reach * x.shape[1] >= 1 << 63  # then 64 bits might not do
                far = (x.astype(object) if wide else x) * model.n - (sums if wide else sums.astype(np.int64))
                deviation = [int(v) for v in (far * far).sum(1)]
                row = pa.array(np.repeat(np.arange(part.num_rows), many))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(row),
                        pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), part.num_rows)),
                        pa.array(deviation, pa.int64()).take(row),
                        pa.array(((x - mean) @ projection).ravel()),
                    ],
                    ["vec_id", "component", "deviation", "whitened"],
                )

    return run


def whiten(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every row on the first components.

    Returns vec_id, component (from 1, by falling eigenvalue), n (vectors fitted), deviation (sum over the
    dimensions of (n * x - S) squared, exact), whitened, explained (share of the trace), identity_error.

    Rows are dropped whose vector is null or has null, NaN, infinite or, times 256, wider than 64-bit entries,
    and those of another size than most (ties: the larger). Rows without vec_id and repeated rows come back
    like others, repeated vectors count once in the fit. Components without variance are left out, so equal
    vectors alone, empty vectors and an empty table give no rows. Columns other than vec_id and the vector
    are not read. A deviation beyond 64 bits raises, and so do more than 4,096 dimensions (ValueError).

    The driver sees the covariance and one number per size of vectors; the tasks get mean and components.
    """
    spark, kind = embeddings.sparkSession, embeddings.schema["vec_id"].dataType.simpleString()
    vectors = stored(fixed_vectors(embeddings, column), "fixed-vectors")
    sizes = vectors.groupBy("size").count().agg(F.max(F.struct("count", "size")).alias("most")).first()["most"]
    dimensions = sizes["size"] if sizes else 0
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions")
    model = fit_whitening(vectors, dimensions, components)
    if not len(model.values):
        return spark.createDataFrame(
            [], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        )
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return (
        vectors.where(F.col("size") == dimensions)
        .select("vec_id", "x")
        .mapInArrow(_whitened(model), f"vec_id {kind}, component int, deviation long, whitened double")
        .select(
            "vec_id",
            "component",
            F.lit(model.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            shares[F.col("component") - 1].alias("explained"),
            F.lit(model.identity_error).alias("identity_error"),
        )
    )
