"""Embedding whitening by incremental eigendecomposition.

Each partition keeps the eigenvalues and eigenvectors of the scatter of the vectors it has read. One more vector changes the
scatter by a centred rank-one term: the new eigenvalues are the roots of a secular equation, entries that hardly meet the term
and equal eigenvalues are deflated first, and the vectors follow from the roots (Gu and Eisenstat, 1994). Two spectra combine
by successive rank-one updates: one for each eigenvector of the second, and one for the difference of the means. Partitions'
spectra combine in groups until one is left. Its basis is refined by a distributed Rayleigh-Ritz step: the scatter is projected
on it in one more pass over the vectors, and the small projected matrix is diagonalised.

Vectors are scaled to integers, so counts, sums and distances from the mean are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripweave.llm.common import fresh, written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Spectra or matrices that one task combines.
FAN = 16
#: Vectors that one task turns into a spectrum, about a millisecond each; small tables are dealt to so many tasks too.
VECTORS_EACH, LEAST_PARTS, MOST_PARTS = 10_000, 32, 20_000
#: Components whose share of the trace is less than this are rounding, not variance.
LEAST_SHARE = 1e-13
EPS = float(np.finfo(np.float64).eps)
RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 / rho + sum(z_j^2 / (d_j - x)) for rising ``d``, no ``z`` of 0 and ``rho`` > 0: the pole next to each, and the
    distance from it. Each root is found from its nearer pole, so small distances keep their digits."""
    k, z2 = len(d), z * z
    ends = np.append(d[1:], d[-1] + rho * z2.sum())
    gap, rows = ends - d, np.arange(k)
    value = 1 / rho + (z2 / (d - (d + gap / 2)[:, None])).sum(1)
    right = (value < 0) & (rows < k - 1)
    origin = rows + right
    poles = d - d[origin][:, None]
    first, second = np.where(right, -gap, 0.0), np.where(right, 0.0, gap)
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, np.where(value < 0, gap, gap / 2))
    low = np.where((value < 0) & ~right, gap / 2, low)
    lower = rows[None, :] <= rows[:, None]
    x = (low + high) / 2
    for _ in range(60):
        t = poles - x[:, None]
        r = z2 / t
        f = 1 / rho + r.sum(1)
        slope = r / t
        below = (slope * lower).sum(1)
        above = slope.sum(1) - below
        low, high = np.where(f < 0, x, low), np.where(f > 0, x, high)
        done = (np.abs(f) <= 8 * EPS * (1 / rho + np.abs(r).sum(1))) | (high - low <= EPS * np.abs(x))
        if done.all():
            break
        # The two poles beside the root stand for all others, with their slopes kept.
        a1, a2 = first - x, second - x
        c = f - a1 * below - a2 * above
        a = (a1 + a2) * f - a1 * a2 * (below + above)
        b = a1 * a2 * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = x + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        x = np.where(done, x, new)
    return origin, x


def rank_one(d: np.ndarray, q: np.ndarray, u: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors of ``q diag(d) q' + rho u u'`` for rising ``d`` and ``rho`` >= 0."""
    z = u @ q
    norm = float(np.sqrt(z @ z))
    if norm == 0 or rho == 0:
        return d, q
    z, rho = z / norm, rho * norm * norm
    least = 8 * EPS * max(abs(float(d[0])), abs(float(d[-1])), rho)
    close = np.diff(d) <= least
    if close.any():  # equal values: turn their vectors so that one of them alone meets u
        q = q.copy()
        cuts = np.append(np.append(0, np.flatnonzero(~close) + 1), len(d))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            length = float(np.sqrt(z[i:j] @ z[i:j]))
            if j - i > 1 and length > 0:
                w = z[i:j].copy()
                w[-1] -= length
                if size := float(w @ w):
                    q[:, i:j] -= np.outer(q[:, i:j] @ w, w) * (2 / size)
                z[i:j] = 0
                z[j - 1] = length
    live = np.flatnonzero(rho * np.abs(z) > least)
    if not len(live):
        return d, q
    own, meets, k = d[live], z[live], len(live)
    origin, x = secular_roots(own, meets, rho)
    apart = (own[:, None] - own[origin]) - x  # d_j - root_i
    # The update whose exact roots these are: its vectors are orthogonal to the last digits.
    between = own[None, :] - own[:, None]
    others = np.ones((k, k))
    others[:, :-1] = between[~np.eye(k, dtype=bool)].reshape(k, k - 1)
    exact = np.sqrt(np.abs(np.prod(-apart / others, axis=1)))
    turn = np.copysign(exact, meets)[:, None] / apart
    turn /= np.sqrt((turn * turn).sum(0))
    d, q = d.copy(), q.copy()
    d[live] = own[origin] + x
    q[:, live] = q[:, live] @ turn
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


class Spectrum:
    """Number, exact sums, and the eigenvalues and eigenvectors of the scatter of some integer vectors."""

    def __init__(self, width: int) -> None:
        self.n, self.sums = 0, [0] * width
        self.d, self.q = np.zeros(width), np.eye(width)

    def add(self, rows: np.ndarray) -> None:
        """One rank-one update for each row."""
        sums = np.array(self.sums, np.int64)
        for x in rows:
            if self.n:
                mean, rest = np.divmod(sums, self.n)
                self.d, self.q = rank_one(self.d, self.q, (x - mean) - rest / self.n, self.n / (self.n + 1))
            self.n += 1
            sums += x
        self.sums = sums.tolist()

    def merge(self, other: Spectrum) -> None:
        """Successive rank-one updates: the other's eigenvectors, then the difference of the means."""
        for value, vector in zip(other.d.tolist(), other.q.T, strict=True):
            if value > 0:
                self.d, self.q = rank_one(self.d, self.q, vector, value)
        n, m = self.n, other.n
        apart = np.array([(n * b - m * a) / (n * m) for a, b in zip(self.sums, other.sums, strict=True)])
        self.d, self.q = rank_one(self.d, self.q, apart, n * m / (n + m))
        self.n, self.sums = n + m, [a + b for a, b in zip(self.sums, other.sums, strict=True)]


SPECTRA = "part long, n long, sums array<long>, d array<double>, q array<double>"


def _held(part: int, s: Spectrum) -> dict:
    return {"part": part, "n": s.n, "sums": s.sums, "d": s.d.tolist(), "q": s.q.ravel().tolist()}


def _read(row: object) -> Spectrum:
    s = Spectrum(len(row.d))
    s.n, s.sums = int(row.n), [int(x) for x in row.sums]
    s.d = np.array(row.d, np.float64)
    s.q = np.array(row.q, np.float64).reshape(len(s.d), -1)
    return s


def _combined(rows: DataFrame, combine: Callable[[pd.DataFrame], pd.DataFrame], name: str) -> DataFrame:
    """Rows, each with its number ``part``, combined in groups of FAN until one is left. ``combine`` keeps the schema."""
    rows = written(rows, name)
    while rows.count() > 1:
        group = F.floor(F.col("part") / FAN).cast("long")
        rows = written(rows.withColumn("part", group).groupBy("part").applyInPandas(combine, rows.schema), name)
    return rows


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def spectrum(rows: DataFrame, width: int) -> Spectrum | None:
    """The spectrum of the scatter of ``x`` (arrays of ``width`` longs), None without rows. What comes to the driver is one spectrum."""
    parts = min(max(rows.count() // VECTORS_EACH, LEAST_PARTS), MOST_PARTS)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Spectrum(width)
        for batch in batches:
            s.add(_matrix(batch["x"], width))
        if s.n:
            yield pa.RecordBatch.from_pylist([_held(TaskContext.get().partitionId(), s)], schema=kinds)

    kinds = pa.schema(
        [("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("d", pa.list_(pa.float64()))]
        + [("q", pa.list_(pa.float64()))]
    )

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        first, *others = [_read(r) for r in group.sort_values("part").itertuples(index=False)]
        for s in others:
            first.merge(s)
        return pd.DataFrame([_held(int(group["part"].iloc[0]), first)])

    found = _combined(rows.repartition(parts, "x").mapInArrow(each, SPECTRA), combine, "spectra").collect()
    return _read(found[0]) if found else None


def summed(rows: DataFrame, width: int, values: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows ``x`` of the outer product of ``values`` of the row with itself."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            v = values(_matrix(batch["x"], width))
            total = total + v.T @ v
        if isinstance(total, np.ndarray):
            part = pa.array([TaskContext.get().partitionId()], pa.int64())
            yield pa.RecordBatch.from_arrays([part, pa.array([total.ravel()], pa.list_(pa.float64()))], ["part", "m"])

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": group["part"].iloc[:1], "m": [np.sum(np.stack(group["m"].tolist()), axis=0)]})

    m = np.array(_combined(rows.mapInArrow(each, "part long, m array<double>"), combine, "sums").first().m)
    return m.reshape(int(len(m) ** 0.5), -1)


class Centred:
    """Distances from the mean ``sums / n``, exact as ``n * x - sums`` where a long holds them."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.base = n, np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sums of (n * x - sums)^2; null where a long cannot hold one."""
        y = x - self.base
        most = int(np.abs(y).max(initial=0)) * self.n + self.n
        if most * most * y.shape[1] < 1 << 63:
            far = y * self.n - self.rest
            return (far * far).sum(1).tolist()
        rest = self.rest.tolist()
        found = [sum((v * self.n - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in found]


def integer_vectors(rows: DataFrame, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``rows`` with ``x``, ``floor(scale * c) + shift`` for each entry c as double. Rows drop out whose vector is null, empty or holds
    null or non-finite entries, or an entry beyond 2^52 when scaled, and those of another than the commonest length
    (the smallest of equally common ones): components are defined over vectors of one length only."""
    column, x = F.col(f"`{vector}`").cast("array<double>"), fresh(rows, "x")
    limit = float(1 << 52)
    fits = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < limit))
    whole = F.transform(column, lambda c: F.floor(c * scale).cast("long") + shift)
    rows = rows.filter(column.isNotNull() & (F.size(column) > 0) & fits).withColumn(x, whole)
    lengths = rows.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size(x) == (lengths[0].n if lengths else 0)).withColumnRenamed(x, "x")


def whiten(
    rows: DataFrame, *, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row for each row with a usable vector (see ``integer_vectors``) and each component, in the columns of RESULT.

    The covariance is that of the distinct integer vectors. Components without variance are left out, so a table whose vectors
    are all equal, or an empty one, gives no rows. Repeated rows and rows without an id are kept.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("embedding"))
    rows = written(integer_vectors(rows, "embedding").select("vec_id", "x"), "vectors")
    some = rows.select(F.size("x").alias("n")).first()
    if some is None:
        return spark.createDataFrame([], RESULT)
    width = some.n
    fit = written(rows.select("x").distinct(), "fit")
    told = spectrum(fit, width)
    n, centre = told.n, Centred(told.n, told.sums)
    basis = np.linalg.qr(told.q)[0]
    values, turn = np.linalg.eigh(summed(fit, width, lambda x: centre(x) @ basis) / n)
    trace = float(values.sum())
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > LEAST_SHARE * trace] if trace > 0 else order[:0]
    if not len(order):
        return spark.createDataFrame([], RESULT)
    share = (values[order] / trace).tolist()
    projection = (basis @ turn[:, order]) / np.sqrt(values[order])
    error = float(np.abs(summed(fit, width, lambda x: centre(x) @ projection) / n - np.eye(len(order))).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, k = _matrix(batch["x"], width), len(share)
            far = pa.array(centre.deviations(x), pa.int64())
            at = np.repeat(np.arange(len(x)), k)
            columns = [
                batch["vec_id"].take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(len(at), n), pa.int64()), far.take(pa.array(at)),
                pa.array((centre(x) @ projection).ravel(), pa.float64()), pa.array(share * len(x), pa.float64()),
                pa.array(np.full(len(at), error), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in RESULT.split(", ")])

    return rows.mapInArrow(project, RESULT)
