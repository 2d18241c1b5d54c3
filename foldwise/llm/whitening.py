"""Embedding whitening: principal components of a distributed covariance, refined in mixed precision.

Vectors become whole numbers ``x = floor(64 c) + 1000000``; every different x counts once in the
fit.  Two passes over the different vectors give the sums and, around the whole numbers nearest to
the means, the cross-products; both are sums of integers and therefore exact, whatever the
partitioning.  The covariance is their exact quotient, a matrix as wide as a vector (its only
size on the driver; the number of vectors plays no part there).

Its eigenvectors start from a float32 decomposition and are corrected by the iteration of Ogita and
Aishima (2018): with ``R = I - X'X`` and ``S = X'VX``, ``X + XE`` has squared errors, at the price
of a few matrix products, first in double and then in extended precision.  Eigenvalues too close to be
told apart at the present accuracy form a cluster: there E only restores orthogonality, and the
cluster is turned by the eigenvectors of its own small shifted matrix ``Y'(V - mu I)Y`` (the second
part of the method), after which the iteration goes on.

Defined results: rows whose vector is null, or holds an entry that is null, not finite or beyond the
range of a long, are dropped, as are rows whose length is not that of most rows (ties: the longer);
components stop where the eigenvalue is zero to working accuracy, as nothing can be divided by it
(so one different vector, or none, gives no row); equal eigenvalues leave their vectors free
within their space; repeated rows are whitened each and fitted once; an empty table gives an empty
table; other columns are passed on.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.session import materialize

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
CHUNK = 4096
LIMB = 20
STEPS = 12
BIG = "decimal(38,0)"


def whole_numbers(vector: str | Column) -> Column:
    """The vector as whole numbers, null if it can't be used."""
    v = F.col(f"`{vector}`") if isinstance(vector, str) else vector
    far = F.lit(float(2**62))
    good = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < far, F.lit(False)))
    return F.when(good, F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT))


def _rows(batch, width: int):
    """Whole-number vectors of an Arrow batch, in chunks of rows."""
    x = np.asarray(batch.column("x").flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(-1, width)
    for k in range(0, len(x), CHUNK):
        yield x[k:k + CHUNK]


def _exact_sum(a: np.ndarray) -> np.ndarray:
    """Column sums as Python integers."""
    top = int(np.abs(a).max(initial=0))
    return a.sum(axis=0).astype(object) if top * len(a) < 2**62 else a.astype(object).sum(axis=0)


def exact_products(z: np.ndarray) -> np.ndarray:
    """z'z as Python integers: matrix products of short limbs, which doubles hold exactly."""
    top = int(np.abs(z).max(initial=0))
    if top * top * len(z) < 2**53:
        f = z.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    limbs, rest = [], z
    while True:
        limbs.append((rest & (2**LIMB - 1)).astype(float))
        rest = rest >> LIMB
        if ((rest == 0) | (rest == -1)).all():
            limbs.append(rest.astype(float))
            break
    total = np.zeros((z.shape[1], z.shape[1]), dtype=object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total += (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return total


def _summed(vectors: DataFrame, width: int, measure) -> dict:
    """Sums over all vectors of what ``measure`` gives per chunk: {(i, j): integer}, one row per entry leaves a task."""

    def run(batches):
        total: dict = {}
        for batch in batches:
            for x in _rows(batch, width):
                for key, value in measure(x):
                    total[key] = total.get(key, 0) + value
        keys = list(total)
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
            pa.array([Decimal(int(total[k])) for k in keys], pa.decimal128(38, 0)),
        ], names=["i", "j", "v"])

    each = vectors.select("x").mapInArrow(run, f"i int, j int, v {BIG}")
    return {(r["i"], r["j"]): int(r["v"]) for r in each.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}


# ---- eigenvectors -------------------------------------------------------------------------------

def _correction(v, x):
    """One step: corrected vectors, eigenvalues, size of the correction and the clusters left."""
    eye = np.eye(len(v), dtype=x.dtype)
    r = eye - x.T @ x
    s = x.T @ (v @ x)
    lam = np.diag(s) / (1 - np.diag(r))
    spread = 2 * (np.linalg.norm((s - np.diag(lam)).astype(float)) + float(np.abs(lam).max()) * np.linalg.norm(r.astype(float)))
    gap = lam[None, :] - lam[:, None]
    apart = np.abs(gap) > spread
    upper = np.triu(np.where(apart, (s + lam[None, :] * r) / np.where(apart, gap, 1), r / 2), 1)
    # e + e' = r holds exactly, so that small gaps turn vectors but never cost orthogonality
    e = upper + np.triu(r - upper, 1).T + np.diag(np.diag(r)) / 2
    order = np.argsort(lam, kind="stable")
    clusters, own = [], [order[0]]
    for a, b in zip(order, order[1:]):
        if lam[b] - lam[a] > spread:
            clusters.append(own)
            own = []
        own.append(b)
    clusters.append(own)
    return x + x @ e, lam, float(np.abs(e).max()), [c for c in clusters if len(c) > 1]


def _turned(v, x, lam, clusters):
    """Every cluster turned by the eigenvectors of its own matrix, shifted by its mean so that only its small differences count."""
    x = x.copy()
    for c in clusters:
        y = x[:, c]
        mu = lam[c].mean()
        t = y.T @ (v @ y - mu * y)
        t = (t + t.T) / 2
        size = np.abs(t).max()
        if size > 0:
            _, w = np.linalg.eigh((t / size).astype(float))
            x[:, c] = y @ w.astype(x.dtype)
    return x


def refined_eigen(v: np.ndarray):
    """(eigenvalues, eigenvectors in columns, corrections) of a symmetric matrix, falling, in extended precision."""
    size = np.abs(v).max()
    if not size > 0:
        return np.zeros(len(v), v.dtype), np.eye(len(v), dtype=v.dtype), []
    a = v / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    log, lam = [], None
    for kind, enough in ((np.float64, 1e-13), (np.longdouble, 1e-17)):
        m, x, best, held, noise = a.astype(kind), x.astype(kind), np.inf, None, 16 * len(v) * np.finfo(kind).eps
        for _ in range(STEPS):
            x, lam, change, clusters = _correction(m, x)
            log.append((np.dtype(kind).name, change, sum(map(len, clusters))))
            # a cluster whose eigenvalues differ by rounding only is left as it is
            clusters = [c for c in clusters if np.ptp(lam[c]) > noise or held is None]
            settled = change < enough or held is not None and change > 0.5 * best
            if settled and not clusters:
                break
            if clusters:
                x = _turned(m, x, lam, clusters)
            best = np.inf if clusters else min(best, change)
            held = clusters
    x = _correction(a.astype(np.longdouble), x)[0]
    lam = np.einsum("ij,ij->j", x, a.astype(np.longdouble) @ x) / np.einsum("ij,ij->j", x, x)
    x = x / np.sqrt(np.einsum("ij,ij->j", x, x))
    order = np.argsort(-lam, kind="stable")
    lam, x = lam[order] * size, x[:, order]
    return lam, x * np.where(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])] < 0, -1, 1), log


# ---- the fit -------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """Counts, sums and components of a fit; ``middle`` holds the whole numbers nearest to the means."""

    width: int
    n: int
    middle: tuple
    sums: tuple  # of x - middle
    values: np.ndarray
    vectors: np.ndarray  # columns
    trace: float

    def share(self) -> list[float]:
        return [float(v) / self.trace for v in self.values]

    def projection(self):
        """(middle, remaining means, matrix): whitened = ((x - middle) - remaining means) @ matrix."""
        rest = np.array([np.longdouble(s) / np.longdouble(self.n) for s in self.sums], dtype=float).reshape(-1)
        return np.array(self.middle, dtype=np.int64), rest, (self.vectors / np.sqrt(self.values)).astype(float)


def _usual_width(rows: DataFrame) -> int | None:
    top = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return None if top is None else top["w"]


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The fit over the different vectors of ``rows`` (column ``x``) and those vectors, stored."""
    width = _usual_width(rows)
    if not width:
        return None, rows.select("x").limit(0)
    different = materialize(rows.filter(F.size("x") == width).select("x").distinct())
    first = _summed(different, width, lambda x: [((-1, 0), len(x)), *(((i, 0), v) for i, v in enumerate(_exact_sum(x - SHIFT)))])
    n = first[-1, 0]
    near = [(2 * first[i, 0] + n) // (2 * n) for i in range(width)]
    middle = tuple(SHIFT + m for m in near)
    at = np.array(middle, dtype=np.int64)
    upper = [(i, j) for i in range(width) for j in range(i, width)]

    def products(x):
        p = exact_products(x - at)
        return [(ij, p[ij]) for ij in upper]

    second = _summed(different, width, products)
    sums = tuple(first[i, 0] - n * near[i] for i in range(width))
    v = np.zeros((width, width), dtype=np.longdouble)
    for i, j in upper:
        v[i, j] = v[j, i] = np.longdouble(n * second[i, j] - sums[i] * sums[j]) / np.longdouble(n * n)
    values, vectors, _ = refined_eigen(v)
    keep = int((values > values[0] * width * 1e-15).sum()) if values[0] > 0 else 0
    keep = min(keep, components)
    return Whitening(width, n, middle, sums, values[:keep], vectors[:, :keep], float(np.trace(v))), different


def _whitened(model: Whitening):
    middle, rest, matrix = model.projection()
    return lambda x: ((x - middle) - rest) @ matrix


def identity_error(model: Whitening, different: DataFrame) -> float | None:
    """Largest entry of the whitened vectors' covariance minus the identity, measured on all of them."""
    k = len(model.values)
    if not k:
        return None
    width, turn = model.width, _whitened(model)

    def run(batches):
        total, cross = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for x in _rows(batch, width):
                w = turn(x)
                total += w.sum(axis=0)
                cross += w.T @ w
        i, j = np.indices((k, k))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate((i.ravel(), np.full(k, -1))), pa.int32()), pa.array(np.concatenate((j.ravel(), np.arange(k))), pa.int32()),
            pa.array(np.concatenate((cross.ravel(), total))),
        ], names=["i", "j", "v"])

    got = {(r["i"], r["j"]): r["v"] for r in different.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    mean = np.array([got[-1, j] for j in range(k)]) / model.n
    cov = np.array([[got[i, j] for j in range(k)] for i in range(k)]) / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


def exact_deviation(x: np.ndarray, model: Whitening) -> list[int]:
    """Sum over dimensions of (n x - S)^2 per row, in whole numbers of any size."""
    z = x - np.array(model.middle, dtype=np.int64)
    top = model.n * int(np.abs(z).max(initial=0)) + max(map(abs, model.sums))
    if top * top * model.width < 2**62:
        d = model.n * z - np.array(model.sums, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    d = model.n * z.astype(object) - np.array(model.sums, dtype=object)
    return (d * d).sum(axis=1).tolist()


def apply(rows: DataFrame, model: Whitening, into: str = "whitened") -> DataFrame:
    """All columns of ``rows`` but ``x``, ``into`` (array of the components) and ``<into>_deviation`` (null beyond 38 digits)."""
    kept = [c for c in rows.columns if c not in ("x", into, f"{into}_deviation")]
    names = [f"c{k}" for k in range(len(kept))]
    thin = rows.filter(F.size("x") == model.width).select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)], "x")
    width, turn, most = model.width, _whitened(model), 10**38

    def run(batches):
        for batch in batches:
            w, d = [], []
            for x in _rows(batch, width):
                w.extend(turn(x).tolist())
                d.extend(Decimal(v) if v < most else None for v in exact_deviation(x, model))
            columns = [c for c, name in zip(batch.columns, batch.schema.names) if name != "x"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(w, pa.list_(pa.float64())), pa.array(d, pa.decimal128(38, 0))],
                names=[*[n for n in batch.schema.names if n != "x"], "w", "d"],
            )

    fields = [f for f in thin.schema.fields if f.name != "x"]
    schema = T.StructType([*fields, T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("d", T.DecimalType(38, 0))])
    out = thin.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names)], F.col("w").alias(into), F.col("d").alias(f"{into}_deviation"))


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows with a usable vector: their columns but the vector, and ``x`` (an input column of that name is dropped)."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in (vector, "x")]
    return df.select(*others, whole_numbers(vector).alias("x")).filter("x IS NOT NULL")


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, into: str = "whitened") -> tuple[DataFrame, Whitening | None, float | None]:
    """Whitened rows, the fit and its measured identity error."""
    rows = usable(df, vector)
    model, different = fit(rows, components)
    if model is None or not len(model.values):
        kept = [F.col(f"`{c}`") for c in rows.columns if c not in ("x", into, f"{into}_deviation")]
        none = rows.limit(0).select(*kept, F.array().cast("array<double>").alias(into), F.lit(None).cast(BIG).alias(f"{into}_deviation"))
        return none, model, None
    return apply(rows, model, into), model, identity_error(model, different)
