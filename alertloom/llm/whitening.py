"""Whitening of embeddings: exact integer sums, a centred scatter from all tasks, its pivoted Cholesky factor, and one-sided Jacobi
rotations on that factor, whose column norms and directions are the eigenvalues' roots and the components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import stash, unstash

#: Components returned.
COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Entries whose 64-fold is beyond this count as not finite, as no 64-bit sum could hold them.
LARGEST = float(1 << 52)
#: Numbers of all models together (sum of squared lengths) that the driver takes.
MOST_NUMBERS = 1 << 24
#: Partial tables are added up in so many groups first.
SALTS = 64
#: Sweeps of rotations after which the factor must have orthogonal columns, and the cosine that counts as orthogonal.
SWEEPS, ORTHOGONAL = 60, 1e-15


def sound(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector is there, not empty, and all finite; x holds floor(64 c) + 1,000,000."""
    c = F.transform("embedding", lambda e: e.cast("double") * SCALE)
    fine = F.forall(c, lambda e: F.coalesce(F.abs(e) <= LARGEST, F.lit(False)) & ~F.coalesce(F.isnan(e), F.lit(False)))
    whole = F.transform(c, lambda e: F.floor(e).cast("long") + SHIFT)
    return embeddings.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def _matrices(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length in a batch."""
    lists = batch.column(column)
    sizes = np.diff(lists.offsets.to_numpy())
    flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of a task's vectors, a row for each length and place."""
    found: dict[int, list] = {}
    for batch in batches:
        for rows, x in _matrices(batch) if batch.num_rows else ():
            n, s = found.get(x.shape[1], (0, np.zeros(x.shape[1], object)))
            high, low = x >> 26, x & ((1 << 26) - 1)  # neither sum can overflow
            found[x.shape[1]] = (n + len(rows), s + high.sum(0).astype(object) * (1 << 26) + low.sum(0).astype(object))
    for d, (n, s) in found.items():
        yield pa.RecordBatch.from_pydict({"d": pa.array([d] * d, pa.int32()), "place": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "s": pa.array([str(int(v)) for v in s], pa.string())})


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """x - s / n in double precision: the whole part of the mean is taken off as an integer."""
    whole = [v // n for v in s]
    rest = np.array([(v - n * w) / n for v, w in zip(s, whole, strict=True)])
    return (x - np.array(whole, np.int64)).astype(float) - rest


def _scatters(sums: dict[int, tuple[int, list[int]]]):
    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch) if batch.num_rows else ():
                y = centred(x, *sums[x.shape[1]])
                found[x.shape[1]] = found.get(x.shape[1], 0) + y.T @ y
        salt = TaskContext.get().partitionId() % SALTS
        for d, v in found.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * d, pa.int32()), "place": pa.array(range(d), pa.int32()), "salt": pa.array([salt] * d, pa.int32()), "row": pa.array(list(v), pa.list_(pa.float64()))})

    return scatter


SCATTER = "d int, place int, salt int, row array<double>"


def _added(key: tuple, table: pa.Table) -> pa.Table:
    rows = np.array(table["row"].to_pylist()).sum(0)
    return pa.table({"d": table["d"][:1], "place": table["place"][:1], "salt": table["salt"][:1], "row": pa.array([rows], pa.list_(pa.float64()))})


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with v = L L^T, a column for each pivot (the largest diagonal entry left), as far as the pivots stand above rounding errors."""
    d = len(v)
    left, out, diagonal = np.ones(d, bool), np.zeros((d, d)), np.diag(v).astype(float).copy()
    floor = d * np.finfo(float).eps * max(diagonal.max(initial=0.0), 0.0)
    for k in range(d):
        p = int(np.argmax(np.where(left, diagonal, -np.inf)))
        if diagonal[p] <= floor:
            return out[:, :k]
        column = (v[:, p] - out[:, :k] @ out[p, :k]) * left
        pivot = np.sqrt(diagonal[p])
        out[:, k] = column / pivot
        out[p, k] = pivot
        left[p] = False
        diagonal -= out[:, k] ** 2
    return out


def _rounds(k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs of columns in which every two meet once: one stays, the others go round."""
    ring = list(range(k + k % 2))
    out = []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], ring[: half - 1 : -1], strict=True) if max(a, b) < k]
        out.append(tuple(np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2)
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of factor factor^T, falling: its columns are rotated in pairs until all are orthogonal."""
    a = factor.copy()
    rounds = _rounds(a.shape[1])
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in rounds:
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx * yy)
            cosine = np.divide(np.abs(xy), size, out=np.zeros_like(xy), where=size > 0)
            worst = max(worst, cosine.max(initial=0.0))
            turn = cosine > ORTHOGONAL
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if worst <= ORTHOGONAL * max(8, len(a)):
            break
    else:
        raise RuntimeError("the rotations did not come to an end")
    norms = np.sqrt((a * a).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    vectors = a[:, order] / norms[order]
    top = np.abs(vectors).argmax(0)
    return norms[order] ** 2, vectors * np.sign(vectors[top, np.arange(len(order))])


def _projected(x: np.ndarray, model: dict) -> np.ndarray:
    return centred(x, model["n"], model["s"]) @ model["axes"]


def _moments(models: dict[int, dict]):
    """Count, means and centred scatter of a task's whitened vectors, as one array for each length; batches join by their means."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for batch in batches:
            for _, x in _matrices(batch) if batch.num_rows else ():
                w = _projected(x, models[x.shape[1]])
                mean = w.mean(0)
                new = (len(w), mean, (w - mean).T @ (w - mean))
                found[x.shape[1]] = joined(found[x.shape[1]], new) if x.shape[1] in found else new
        salt = TaskContext.get().partitionId() % SALTS
        for d, m in found.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "salt": pa.array([salt], pa.int32()), "n": pa.array([m[0]], pa.int64()), "mean": pa.array([m[1]], pa.list_(pa.float64())), "m2": pa.array([m[2].ravel()], pa.list_(pa.float64()))})

    return moments


MOMENTS = "d int, salt int, n long, mean array<double>, m2 array<double>"


def joined(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred scatter of two sets of rows together."""
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def _joined(key: tuple, table: pa.Table) -> pa.Table:
    out = None
    for row in table.to_pylist():
        k = len(row["mean"])
        new = (row["n"], np.array(row["mean"]), np.array(row["m2"]).reshape(k, k))
        out = new if out is None else joined(out, new)
    return pa.table({"d": table["d"][:1], "salt": table["salt"][:1], "n": pa.array([out[0]], pa.int64()), "mean": pa.array([out[1]], pa.list_(pa.float64())), "m2": pa.array([out[2].ravel()], pa.list_(pa.float64()))})


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Sum of (n x - s)^2 of each row, exact; None where no 64-bit integer holds it."""
    whole = [v // n for v in s]
    gap = x - np.array(whole, np.int64)
    if float(np.abs(gap).max(initial=0) + 1) * n < 2**31 / np.sqrt(x.shape[1]):
        y = n * gap - np.array([v - n * w for v, w in zip(s, whole, strict=True)], np.int64)
        return (y * y).sum(1).tolist()
    y = n * gap.astype(object) - np.array([v - n * w for v, w in zip(s, whole, strict=True)], object)
    return [v if v < 1 << 63 else None for v in (y * y).sum(1).tolist()]


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _rows(models: dict[int, dict]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch) if batch.num_rows else ():
                m = models[x.shape[1]]
                k, n = m["axes"].shape[1], len(at)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": batch.column("vec_id").take(pa.array(np.repeat(at, k))), "component": pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), "n": np.full(n * k, m["n"]),
                        "deviation": pa.array(deviations(x, m["n"], m["s"]), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))), "whitened": _projected(x, m).ravel(),
                        "explained": np.tile(m["explained"], n), "identity_error": np.full(n * k, m["identity_error"]),
                    }
                )

    return rows


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, dict]:
    """The model of each length of vectors in ``vectors`` (a written table with x): n, s, axes (components over their deviations, as
    columns), eigenvalues, explained, identity_error. The driver gets sums, scatters and moments only, whose size goes with the length."""
    parts = vectors.select("x").mapInArrow(_sums, "d int, place int, n long, s string")
    exact = parts.groupBy("d", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"))
    sums: dict[int, tuple[int, list[int]]] = {}
    sizes = vectors.select(F.size("x").alias("d")).distinct().agg(F.coalesce(F.sum(F.col("d").cast("long") * F.col("d")), F.lit(0))).first()[0]
    if sizes > MOST_NUMBERS:
        raise ValueError(f"the lengths' squares sum to {sizes}; at most {MOST_NUMBERS} fit on the driver")
    for d, _, n, s in sorted(map(tuple, exact.collect())):
        sums.setdefault(d, (n, []))[1].append(int(s))
    scatters = vectors.select("x").mapInArrow(_scatters(sums), SCATTER)
    scatters = scatters.groupBy("d", "place", "salt").applyInArrow(_added, SCATTER).groupBy("d", "place").applyInArrow(_added, SCATTER)
    table = sorted((r["d"], r["place"], r["row"]) for r in scatters.collect())
    models = {}
    for d, (n, s) in sums.items():
        v = np.array([row for e, _, row in table if e == d]) / n
        values, vectors_ = jacobi(pivoted_cholesky((v + v.T) / 2))
        values, vectors_ = values[:components], vectors_[:, :components]
        trace = float(np.trace(v))
        models[d] = {"n": n, "s": s, "eigenvalues": values, "components": vectors_, "axes": vectors_ / np.sqrt(values), "explained": values / trace if trace > 0 else values, "identity_error": 0.0}
    moments = vectors.select("x").mapInArrow(_moments(models), MOMENTS)
    moments = moments.groupBy("d", "salt").applyInArrow(_joined, MOMENTS).groupBy("d").applyInArrow(_joined, MOMENTS)
    for row in moments.collect():
        k = len(row["mean"])
        models[row["d"]]["identity_error"] = float(np.abs(np.array(row["m2"]).reshape(k, k) / row["n"] - np.eye(k)).max(initial=0.0))
    return models


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of ``embeddings`` (vec_id, embedding).

    Rows whose vector is null or empty, or holds null, non-finite or enormous entries (64 times more than 2^52) are left out. Vectors of
    each length have a model of their own, whose n counts them. Components of no variance (beyond the rank that the factor has at
    double precision, so all of a single row or of equal rows) give no rows. deviation is null where it is beyond 64 bits. A null or repeated
    vec_id is carried along. An empty table gives no rows. Other columns aren't read.
    """
    vectors = stash(sound(embeddings))
    models = fit(vectors, components)
    return vectors.mapInArrow(_rows(models), OUT)
