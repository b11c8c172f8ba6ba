"""Embedding whitening by principal components (operator 11).

Entries become whole numbers, so that sums and centred products are exact and don't
depend on how rows are dealt. One reading gives each dimension's sum, a second one the
covariance: rows are centred at the whole number nearest to the mean before they are
multiplied, and what that differs from the mean is taken off the sums at the end. Every
task adds up one small matrix; a fixed number of tasks add those up as a stream.

The covariance, whose size is that of a vector squared, is brought to tridiagonal form by
Householder reflections; Sturm counts and bisection give the leading eigenvalues, inverse
iteration their vectors, each reorthogonalised against those of its cluster. The components
go to all tasks, which project their rows; a third reading measures the whitened covariance.

Defined cases: rows whose vector is null or holds null or non-finite entries, or entries of
2**40 or more in size, are dropped, as are empty vectors; vectors of each length are fitted
and whitened by themselves; components whose eigenvalue is not above 1e-11 of the largest one
can't be whitened and are left out (so one vector alone, or equal ones, give no rows); a
deviation beyond a long is null; rows that repeat an id, and null ids, are kept as they
are; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
FLAT = 1e-11  # of the largest eigenvalue
ADDERS = 32  # tasks that add up the matrices of all others


# --- the symmetric eigenproblem: a matrix of the size of one vector


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and Q with Q.T @ a @ Q tridiagonal, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.abs(x[1:]).max()
        if size == 0:
            continue
        v = x / max(size, abs(x[0]))
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        below = a[k + 1 :, k + 1 :]
        p = below @ v
        w = 2 * (p - (v @ p) * v)
        below -= np.outer(v, w) + np.outer(w, v)
        side = x - 2 * v * (v @ x)
        a[k + 1 :, k], a[k, k + 1 :] = side, side
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def sturm_counts(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each point: negative pivots of the matrix less that point."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    pivot = np.ones_like(at)
    below = np.zeros(len(at), np.int64)
    for i in range(len(d)):
        pivot = d[i] - at - (e[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest, falling, by bisection down to neighbouring doubles."""
    n = len(d)
    spread = np.r_[0.0, np.abs(e)] + np.r_[np.abs(e), 0.0]
    lo, hi = np.full(k, (d - spread).min()), np.full(k, (d + spread).max())
    pad = np.finfo(float).eps * n * max(np.abs(lo).max(), np.abs(hi).max()) + np.finfo(float).tiny
    lo, hi = lo - pad, hi + pad
    rank = n - 1 - np.arange(k)  # eigenvalues below the wanted one
    while True:
        middle = lo + (hi - lo) / 2
        open_ = (middle > lo) & (middle < hi)
        if not open_.any():
            return hi
        above = sturm_counts(d, e, middle) <= rank
        lo, hi = np.where(open_ & above, middle, lo), np.where(open_ & ~above, middle, hi)


def _solved(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """(T - shift) x = b, by elimination with row exchanges."""
    n = len(d)
    small = np.finfo(float).eps * max(np.abs(d).max(), np.abs(e).max(initial=0.0), np.finfo(float).tiny)
    main, up, second, x = d - shift, np.r_[e, 0.0], np.zeros(n), b.copy()
    for i in range(n - 1):
        low = e[i]
        if abs(low) > abs(main[i]):
            f = main[i] / low
            main[i], up[i], second[i], after = low, main[i + 1], up[i + 1], up[i]
            main[i + 1], up[i + 1] = after - f * up[i], -f * second[i]
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
        else:
            f = low / (main[i] if main[i] else small)
            main[i + 1] -= f * up[i]
            x[i + 1] -= f * x[i]
        if not main[i]:
            main[i] = small
    for i in range(n - 1, -1, -1):
        rest = (up[i] * x[i + 1] if i + 1 < n else 0.0) + (second[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = (x[i] - rest) / (main[i] if abs(main[i]) > small else np.copysign(small, main[i]))
    return x


def eigenvectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, seed: int = 11) -> np.ndarray:
    """Unit vectors by inverse iteration, one column for each of the falling values.

    Values that lie near each other are one cluster, whose vectors are made orthogonal as
    they are found; equal values are set apart a little, so that each has its own shift.
    """
    n, k = len(d), len(values)
    norm = max(np.abs(d).max() + 2 * np.abs(e).max(initial=0.0), np.finfo(float).tiny)
    apart, near = 4 * np.finfo(float).eps * norm, 1e-3 * norm
    random = np.random.default_rng(seed)
    out, first, shift = np.zeros((n, k)), 0, np.inf
    for j in range(k):
        if j and values[j - 1] - values[j] > near:
            first = j
        shift = min(values[j], shift - apart) if j > first else values[j]
        x = random.normal(size=n)
        for _ in range(5):
            x = _solved(d, e, shift, x / np.abs(x).max())
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
            x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def principal_components(cov: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues, falling, and their unit vectors as columns; flat directions are left out."""
    size = np.abs(cov).max(initial=0.0)
    if size == 0:
        return np.zeros(0), np.zeros((len(cov), 0))
    d, e, q = tridiagonal(cov / size)
    values = leading_eigenvalues(d, e, min(most, len(cov)))
    values = values[values > FLAT * values[0]]
    vectors = q @ eigenvectors(d, e, values)
    vectors /= np.linalg.norm(vectors, axis=0)
    return values * size, vectors


# --- readings of the table


def _numbers(table: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of each length as whole numbers, with the places of their rows."""
    column = table.column("vector")
    lengths = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    begin = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        x = flat[begin[at][:, None] + np.arange(dim)]
        yield int(dim), at, np.floor(SCALE * x).astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums = {}, {}
    for batch in batches:
        for dim, at, x in _numbers(batch):
            n[dim] = n.get(dim, 0) + len(at)
            sums[dim] = sums.get(dim, 0) + x.sum(0)
    for dim in n:
        yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([n[dim]], pa.int64()), "sums": pa.array([sums[dim].tolist()], pa.list_(pa.int64()))})


def _matrix(dim: int, m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "m": pa.array([m.tobytes()], pa.binary())})


def _products(centre):
    """Sums of the outer products of what `centre` makes of vectors of a length; a task's matrices are rows."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {}
        for batch in batches:
            for dim, _, x in _numbers(batch):
                for lo in range(0, len(x), 8192):
                    y = centre(dim, x[lo : lo + 8192])
                    if y is not None:
                        made[dim] = made.get(dim, 0) + y.T @ y
        for dim, m in made.items():
            yield _matrix(dim, m)

    return job


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = {}
    for batch in batches:
        for dim, m in zip(batch.column("dim").to_pylist(), batch.column("m"), strict=True):
            made[dim] = made.get(dim, 0) + np.frombuffer(m.as_buffer())
    for dim, m in made.items():
        yield _matrix(dim, m)


def _summed(rows: DataFrame, centre) -> dict[int, np.ndarray]:
    """The sum over all rows by length of vector: one matrix each, of the size of a vector squared."""
    kind = "dim int, m binary"
    partial = rows.mapInArrow(_products(centre), kind).repartition(ADDERS).mapInArrow(_added, kind)
    total = {dim: np.frombuffer(m) for dim, m in partial.repartition(1).mapInArrow(_added, kind).collect()}
    return {dim: m.reshape(int(np.sqrt(len(m))), -1) for dim, m in total.items()}


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Exact sums of (n*x - S)**2, null beyond a long."""
    most = max(abs(n * int(x.max(initial=0)) - int(sums.min())), abs(n * int(x.min(initial=0)) - int(sums.max())))
    if most < 2**62 and x.shape[1] * most**2 < 2**62:
        return pa.array(((n * x - sums) ** 2).sum(1), pa.int64())
    wide = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(1)
    return pa.array([v if v < 2**63 else None for v in wide], pa.int64())


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> dict[int, dict]:
    """For each length of vector: n, sums, centred covariance's trace, eigenvalues, vectors, and identity_error."""
    sums = rows.mapInArrow(_sums, "dim int, n long, sums array<long>")
    by_place = sums.select("dim", "n", F.posexplode("sums").alias("at", "s")).groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    fitted: dict[int, dict] = {}
    for r in by_place.orderBy("dim", "at").collect():  # a row for each dimension
        one = fitted.setdefault(r.dim, {"n": r.n, "sums": []})
        one["sums"].append(r.s)
    for one in fitted.values():
        one["sums"] = np.array(one["sums"], np.int64)
        one["whole"] = (2 * one["sums"] + one["n"]) // (2 * one["n"])
        one["rest"] = (one["sums"] - one["n"] * one["whole"]) / one["n"]
    whole = {dim: one["whole"] for dim, one in fitted.items()}
    for dim, m in _summed(rows, lambda dim, x: (x - whole[dim]).astype(np.float64)).items():
        one = fitted[dim]
        cov = m / one["n"] - np.outer(one["rest"], one["rest"])
        one["values"], one["vectors"] = principal_components((cov + cov.T) / 2, components)
        one["trace"] = float(np.trace(cov))
        one["project"] = one["vectors"] / np.sqrt(one["values"])
    maps = {dim: (one["whole"], one["rest"], one["project"]) for dim, one in fitted.items()}

    def whitened(dim: int, x: np.ndarray) -> np.ndarray | None:
        whole, rest, project = maps[dim]
        return np.c_[(x - whole - rest) @ project, np.ones(len(x))] if project.shape[1] else None

    for dim, m in _summed(rows, whitened).items():
        mean = m[-1, :-1] / m[-1, -1]
        cov = m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean)
        fitted[dim]["identity_error"] = float(np.abs(cov - np.eye(len(cov))).max())
    return fitted


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: `id_col`, n, deviation, whitened (array, by falling eigenvalue), explained (array), identity_error."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    # NaN is above all numbers
    good = F.forall("vector", lambda v: v.isNotNull() & (F.abs(v) < 2.0**40)) & (F.size("vector") > 0)
    rows = given.filter(F.coalesce(good, F.lit(False)))
    fitted = spark.sparkContext.broadcast(fit_whitening(rows, components))  # of a vector's size by the number of components, for each length

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in _numbers(batch):
                one = fitted.value[dim]
                k = len(one["values"])
                white = (x - one["whole"] - one["rest"]) @ one["project"]
                explained = np.tile(one["values"] / one["trace"], len(x)) if k else np.zeros(0)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column("id").take(pa.array(at)), "n": pa.array(np.full(len(x), one["n"])), "deviation": _deviation(x, one["n"], one["sums"]),
                    "whitened": pa.ListArray.from_arrays(offsets, pa.array(white.ravel())), "explained": pa.ListArray.from_arrays(offsets, pa.array(explained)),
                    "identity_error": pa.array(np.full(len(x), one.get("identity_error")), pa.float64()),
                })

    out = rows.mapInArrow(project, "id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    return out.withColumnRenamed("id", id_col)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = white.select("vec_id", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"), "n", "deviation", "identity_error")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


QUERIES = {"op11_whitening": op11_whitening}
SQL: dict[str, str] = {}
