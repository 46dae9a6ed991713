"""PCA whitening of an embedding table.

1. Distributed centred covariance. Entries become integers; one pass sums them,
   a second sums products of entries less a whole-number centre (the floor of
   the mean). All sums are exact integers, so neither the order of
   tasks nor a repeated task changes a bit; the rest of the centring (less
   than one per dimension) is taken out exactly on the driver, which holds one
   d x d matrix and nothing that grows with the rows.
2. Householder reflections bring the covariance to a tridiagonal matrix.
3. Sturm counts (how many eigenvalues lie below a bound) bisect each of the
   leading eigenvalues down to the last bits.
4. Inverse iteration gives each eigenvector of the tridiagonal matrix; those
   whose eigenvalues lie close together are made orthogonal to each
   other in every step. The reflections carry them back.
5. The mean and the components (k x d numbers) go to the tasks, which project
   their rows; the whitened covariance is measured over all of them.

Edge cases: rows whose vector is null or holds null, infinite or NaN entries are dropped; rows
of another dimension than most (ties: the larger) are dropped too; repeated and
null ids are rows of their own; components stop at the rank of the covariance
(eigenvalues below 1e-10 of the largest have no direction), so equal rows, a
single row or an empty table give no row; tied eigenvalues give any
orthonormal basis of their space, the same for all rows; entries beyond
+-2^42 are taken as that bound; ``deviation`` is a decimal where a long might
overflow; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
LIMIT = 1 << 52  # scaled entries are held within +-LIMIT
RANK = 1e-10
_EXACT = 1 << 53  # whole numbers below this are exact doubles


def _matrix(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are kept, their scaled integer entries)."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(values).fill_null(-1).to_numpy(zero_copy_only=False)
    keep = lengths == dim
    chosen = values.filter(pa.array(keep))
    flat = chosen.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    fine = np.isfinite(flat).all(axis=1)
    keep[np.flatnonzero(keep)[~fine]] = False
    with np.errstate(over="ignore"):
        return keep, np.clip(np.floor(flat[fine] * SCALE), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _whole_sum(x: np.ndarray) -> list[int]:
    """Exact column sums."""
    if len(x) == 0 or int(np.abs(x).max()) * len(x) < 1 << 62:
        return [int(v) for v in x.sum(axis=0)]
    return [sum(col) for col in x.T.tolist()]


def _products(y: np.ndarray) -> np.ndarray:
    """Exact y' y: by blocks small enough for whole doubles, else in Python integers."""
    top = int(np.abs(y).max()) if y.size else 0
    out = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    rows = _EXACT // (top * top + 1)
    if rows < 1:
        big = y.astype(object)
        return out + big.T @ big
    for i in range(0, len(y), rows):
        part = y[i : i + rows].astype(np.float64)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def _sums_task(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, low, high = 0, [0] * dim, [None] * dim, [None] * dim
        for batch in batches:
            _, x = _matrix(batch.column(0), dim)
            if not len(x):
                continue
            n += len(x)
            sums = [a + b for a, b in zip(sums, _whole_sum(x), strict=True)]
            low = [b if a is None else min(a, b) for a, b in zip(low, x.min(axis=0).tolist(), strict=True)]
            high = [b if a is None else max(a, b) for a, b in zip(high, x.max(axis=0).tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), _decimals(sums), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                names=["i", "n", "s", "low", "high"])
    return run


def _products_task(dim: int, centre: list[int]):
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = None, np.array(centre, dtype=np.int64)
        for batch in batches:
            _, x = _matrix(batch.column(0), dim)
            if len(x):
                part = _products(x - at)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array((upper[0] * dim + upper[1]).tolist(), pa.int32()), _decimals(total[upper])], names=["ij", "s"])
    return run


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder: diagonal, off-diagonal and the orthogonal q with ``a = q t q'``."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or np.linalg.norm(x[1:]) == 0:
            continue
        v = x.copy()
        v[0] += size if x[0] >= 0 else -size
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = p - (v @ p) * v
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -size if x[0] >= 0 else size
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def count_below(d: np.ndarray, e: np.ndarray, x: float) -> int:
    """Sturm count: eigenvalues of the tridiagonal matrix below x."""
    tiny = np.finfo(float).tiny
    count, p = 0, 1.0
    for i in range(len(d)):
        p = d[i] - x - (e[i - 1] ** 2 / p if i else 0.0)
        if abs(p) < tiny:
            p = -tiny
        count += p < 0
    return count


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until its interval has no double inside."""
    around = np.abs(np.concatenate([[0.0], e])) + np.abs(np.concatenate([e, [0.0]]))
    floor, ceiling = float((d - around).min()), float((d + around).max())
    out = []
    for j in range(k):
        low, high = floor, max(ceiling, floor) + abs(ceiling) * 1e-15 + np.finfo(float).tiny
        if out:
            high = min(high, float(np.nextafter(out[-1], np.inf)))
        while True:
            mid = low + (high - low) / 2
            if mid <= low or mid >= high:
                break
            if len(d) - count_below(d, e, mid) > j:  # more than j eigenvalues are mid or larger
                low = mid
            else:
                high = mid
        out.append(low)
    return np.array(out)


def _solve(d: np.ndarray, e: np.ndarray, x: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(t - x) y = b for a tridiagonal t, by elimination with row exchanges."""
    n = len(d)
    main, up, upper, y = d - x, np.append(e, 0.0), np.zeros(n), b.copy()
    low = e
    for i in range(n - 1):
        if abs(low[i]) > abs(main[i]):
            row = (low[i], main[i + 1], up[i + 1])
            f = main[i] / row[0]
            main[i + 1], up[i + 1] = up[i] - f * row[1], upper[i] - f * row[2]
            main[i], up[i], upper[i] = row
            y[i], y[i + 1] = y[i + 1], y[i] - f * y[i + 1]
        else:
            f = low[i] / (main[i] if abs(main[i]) > tiny else tiny)
            main[i + 1] -= f * up[i]
            up[i + 1] -= f * upper[i]
            y[i + 1] -= f * y[i]
    for i in range(n - 1, -1, -1):
        rest = y[i] - (up[i] * y[i + 1] if i + 1 < n else 0.0) - (upper[i] * y[i + 2] if i + 2 < n else 0.0)
        y[i] = rest / (main[i] if abs(main[i]) > tiny else tiny)
    return y


def eigenvectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Inverse iteration, one column per value; vectors of a cluster are kept orthogonal in every step."""
    size = max(float(np.abs(d).max()), float(np.abs(e).max()) if len(e) else 0.0)
    tiny = np.finfo(float).eps * size
    start = np.random.RandomState(7).uniform(0.5, 1.5, (len(d), len(values)))
    out = np.zeros((len(d), len(values)))
    first = 0
    for j, x in enumerate(values):
        if j and values[j - 1] - x > 1e-3 * size:
            first = j  # a cluster ends
        near = x - tiny * (j - first)  # equal values are told apart by their last bits
        y = start[:, j]
        for _ in range(6):
            y = _solve(d, e, near, y / np.linalg.norm(y), tiny)
            y /= np.abs(y).max()
            for _ in range(2):
                for i in range(first, j):
                    y = y - (out[:, i] @ y) * out[:, i]
        out[:, j] = y / np.linalg.norm(y)
    return out


def principal_axes(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the leading components within the rank."""
    k = min(k, len(cov))
    scale = float(np.abs(cov).max()) if cov.size else 0.0
    if not k or scale == 0:
        return np.empty(0), np.empty((len(cov), 0))
    d, e, q = tridiagonal(cov / scale)
    values = leading_eigenvalues(d, e, k)
    values = values[values > RANK * values[0]]
    return values * scale, q @ eigenvectors(d, e, values)


def _project_task(dim: int, centre: list[int], rest: list[float], shifted: list[int], n: int, axes: np.ndarray, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, off = np.array(centre, dtype=np.int64), np.array(rest)
        for batch in batches:
            keep, x = _matrix(batch.column(1), dim)
            y = x - at
            if wide:
                far = [sum((n * a - b) ** 2 for a, b in zip(row, shifted, strict=True)) for row in y.tolist()]
                deviation = _decimals(far)
            else:
                far = n * y - np.array(shifted, dtype=np.int64)
                deviation = pa.array((far * far).sum(axis=1), pa.int64())
            z = (y.astype(np.float64) - off) @ axes
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), deviation, *(pa.array(np.ascontiguousarray(z[:, j])) for j in range(z.shape[1]))],
                names=["vec_id", "deviation", *(f"w{j + 1}" for j in range(z.shape[1]))])
    return run


def _dimension(base: DataFrame) -> int:
    sizes = base.filter("v IS NOT NULL").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return sizes[0].d if sizes else 0


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per kept row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    base = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    id_type = base.schema["vec_id"].dataType.simpleString()
    nothing = spark.createDataFrame([], f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    dim = _dimension(base)
    if not dim:
        return nothing
    sums = sorted(base.select("v").mapInArrow(_sums_task(dim), "i int, n long, s decimal(38,0), low long, high long").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).collect(), key=lambda r: r.i)
    if not sums:
        return nothing
    n, totals = sums[0].n, [int(r.s) for r in sums]
    centre = [t // n for t in totals]
    shifted = [t - n * c for t, c in zip(totals, centre, strict=True)]  # sums about the centre, 0 to n - 1
    products = np.zeros((dim, dim), dtype=object)
    for r in base.select("v").mapInArrow(_products_task(dim, centre), "ij int, s decimal(38,0)").groupBy("ij").agg(F.sum("s").alias("s")).toLocalIterator():
        products[r.ij // dim, r.ij % dim] = products[r.ij % dim, r.ij // dim] = int(r.s)
    # Exact up to the one rounding of each entry.
    cov = np.array([[float(Fraction(n * int(products[i, j]) - shifted[i] * shifted[j], n * n)) for j in range(dim)] for i in range(dim)])
    values, axes = principal_axes(cov, components)
    if not len(values):
        return nothing
    furthest = max(max(abs(r.low - c), abs(r.high - c)) for r, c in zip(sums, centre, strict=True))
    wide = (n * (furthest + 1)) ** 2 * dim >= 1 << 63
    rest = [s / n for s in shifted]
    names = [f"w{j + 1}" for j in range(len(values))]
    projected = materialize(base.mapInArrow(
        _project_task(dim, centre, rest, shifted, n, axes / np.sqrt(values), wide),
        f"vec_id {id_type}, deviation {'decimal(38,0)' if wide else 'long'}, " + ", ".join(f"{w} double" for w in names)), "whitened")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    spread = projected.agg(*[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(spread[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    trace = float(sum(Fraction(n * int(products[i, i]) - shifted[i] ** 2, n * n) for i in range(dim)))
    parts = F.array(*[F.struct(F.lit(j + 1).alias("component"), F.col(w).alias("whitened"), F.lit(float(v) / trace).alias("explained"))
                      for j, (w, v) in enumerate(zip(names, values, strict=True))])
    return projected.select("vec_id", "deviation", F.explode(parts).alias("p")).select(
        "vec_id", "p.component", F.lit(n).cast("long").alias("n"), "deviation", "p.whitened", "p.explained", F.lit(float(error)).alias("identity_error"))
