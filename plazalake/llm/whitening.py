"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

X, the centred fit list (each distinct vector once), is never gathered: X v and X' u
are products over its blocks, summed over tasks. The left vectors u are never stored
either: as X V = U R with a small triangular R, a task gets its part of U from its
rows, V and R. So a lost executor costs a read of its blocks, and what reaches the
driver are d + k + 1 sums a step, whatever the number of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard
from .vectors import common_length, matrix, scaled, usable

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries in a packed block of the fit list, of 2, 4 or 8 bytes each.
BLOCK = 1 << 19
#: Relative size of what counts as nothing: rounding of sums of products.
TINY = 1e-12
SUMS = "i int, v double"


def _sums(blocks: DataFrame, task, most: int) -> np.ndarray:
    """Vectors of `most` doubles that task gives for each block, summed within tasks, then over them."""

    def run(batches):
        total = None
        for batch in batches:
            for wide, raw in zip(batch.column("wide").to_pylist(), batch.column("x").to_pylist(), strict=True):
                part = task(np.frombuffer(raw, f"<i{wide}").astype(np.int64))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(most), pa.int32()), pa.array(total, pa.float64())], names=["i", "v"])

    out = np.zeros(most)
    for r in blocks.mapInArrow(run, SUMS).groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def _pack(vectors: DataFrame, d: int) -> DataFrame:
    """Blocks of x - SHIFT: n, wide (bytes of an entry: 2, 4 or 8), x."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(0), d, np.int64) - SHIFT
            step = max(1, BLOCK // d)
            for at in range(0, len(x), step):
                part = x[at : at + step]
                most = int(np.abs(part).max())
                wide = next(w for w in (2, 4, 8) if most < 1 << 8 * w - 1)
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), pa.array([wide], pa.int32()), pa.array([part.astype(f"<i{wide}").tobytes()], pa.binary())], names=["n", "wide", "x"])

    return vectors.mapInArrow(run, "n long, wide int, x binary")


class Fit:
    """n, S (exact sums of x by dimension), components (rows, unit vectors) and their deviations, the variances, trace of the covariance, identity_error."""

    def __init__(self, n: int, d: int, sums: list[int]):
        self.n, self.d, self.sums = n, d, sums
        self.components, self.variances = np.zeros((0, d)), np.zeros(0)
        self.trace = self.identity_error = 0.0
        self.passes = 0


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """S / n - SHIFT as a whole number and the rest, so that x - SHIFT - whole - rest is as exact as doubles are."""
    whole = [s // n - SHIFT for s in sums]
    rest = [(s % n) / n for s in sums]
    return np.array(whole, np.int64), np.array(rest)


def _centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - whole) - rest


def _exact_sums(blocks: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows, and sums by dimension as whole numbers."""

    def run(batches):
        n, total = 0, [0] * d
        for batch in batches:
            for size, wide, raw in zip(batch.column("n").to_pylist(), batch.column("wide").to_pylist(), batch.column("x").to_pylist(), strict=True):
                x = np.frombuffer(raw, f"<i{wide}").astype(np.int64).reshape(-1, d)
                # halves of 26 bits: 2^37 rows of a block would be needed to overflow a sum
                low, high = (x & ((1 << 26) - 1)).sum(0, dtype=np.int64), (x >> 26).sum(0, dtype=np.int64)
                n, total = n + size, [t + (int(h) << 26) + int(w) for t, h, w in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(v) for v in (n, *total)])], names=["i", "v"])

    found = {r["i"]: int(r["v"]) for r in blocks.mapInArrow(run, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    n = found.get(-1, 0)
    return n, [found.get(i, 0) + SHIFT * n for i in range(d)]


def bidiagonalise(blocks: DataFrame, fit: Fit, components: int, seed: int = 0) -> None:
    """Fill in fit's components, variances and trace.

    Every step takes one pass: w = X v less its share of all earlier left vectors
    (whose coefficients follow from the X' u of their own passes), then |w|^2, X' w and
    U' w, which shows whether w must be made orthogonal once more, by a second pass.
    The right vectors are orthogonalised on the driver, twice. Where the space that is
    reached from the first vector ends, the next one is new, so repeated variances are found.

    It ends when the wanted components have converged and what is left of the sum of
    squares can't hold another of their size, at the latest when the rows' space is used up.
    """
    n, d = fit.n, fit.d
    whole, rest = _centre(n, fit.sums)
    total = float(_sums(blocks, lambda x: np.array([np.square(_centred(x.reshape(-1, d), whole, rest)).sum()]), 1)[0])
    fit.trace = total / n
    if not total > 0:
        return
    wanted, floor = min(components, d), TINY * math.sqrt(total)
    draw = np.random.default_rng(seed)
    right, left, r = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((0, 0))  # V, X' U and R
    alphas: list[float] = []
    betas: list[float] = []  # what stands above the diagonal

    def away(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - right @ (right.T @ v)
        return v

    def fresh() -> np.ndarray | None:
        """A unit vector of the rows' space orthogonal to V; None if there is none."""
        g = away(draw.standard_normal(d))

        def through(x):
            x = _centred(x.reshape(-1, d), whole, rest)
            return x.T @ (x @ g)

        fit.passes += 1
        v = away(_sums(blocks, through, d))
        size = float(np.linalg.norm(v))
        return v / size if size > TINY * total else None

    v = fresh()
    while v is not None:
        k = right.shape[1]
        c, solve = left.T @ v, right @ np.linalg.inv(r)
        for _ in range(3):

            def step(x, solve=solve, v=v, c=c):
                x = _centred(x.reshape(-1, d), whole, rest)
                u = x @ solve
                w = x @ v - u @ c
                return np.concatenate(([w @ w], x.T @ w, u.T @ w))

            got = _sums(blocks, step, 1 + d + k)
            fit.passes += 1
            size, back, along = math.sqrt(got[0]), got[1 : 1 + d], got[1 + d :]  # along: sums with U
            if size <= floor or np.abs(along).max(initial=0.0) <= 1e-12 * size:
                break
            c = c + along
        if size <= floor:
            break
        alphas.append(size)
        r = np.block([[r, c[:, None]], [np.zeros((1, k)), np.array([[size]])]])
        following = back / size - size * v
        right, left, k = np.column_stack((right, v)), np.column_stack((left, back / size)), k + 1
        following = away(following)
        beta = float(np.linalg.norm(following))
        p, s, _ = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        converged = k >= wanted and np.abs(beta * p[-1, :wanted]).max() <= 1e-14 * s[0]
        if k == d or (converged and total - float(np.square(s).sum()) < 0.99 * s[wanted - 1] ** 2):
            break
        if beta > floor:
            v = following / beta
        else:
            v, beta = fresh(), 0.0
        if v is not None:
            betas.append(beta)
    if not alphas:
        return
    _, s, q = np.linalg.svd(np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1))
    keep = np.flatnonzero(s > d * TINY * s[0])[:wanted]
    fit.components, fit.variances = (q @ right.T)[keep], np.square(s[keep]) / n


def fit_whitening(rows: DataFrame, d: int, components: int) -> Fit:
    """rows (x): the fit list is each distinct x once."""
    distinct = cut(_pack(rows.select("x").distinct(), d), "fit")
    n, sums = _exact_sums(distinct, d)
    fit = Fit(n, d, sums)
    if n:
        bidiagonalise(distinct, fit, components)
        k = len(fit.variances)
        if k:
            whole, rest = _centre(n, sums)
            project = (fit.components / np.sqrt(fit.variances)[:, None]).T

            def moments(x):
                w = _centred(x.reshape(-1, d), whole, rest) @ project
                return np.concatenate((w.sum(0), (w.T @ w).ravel()))

            got = _sums(distinct, moments, k + k * k)
            mean = got[:k] / n
            fit.identity_error = float(np.abs(got[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    discard(distinct)
    return fit


def apply_whitening(rows: DataFrame, fit: Fit, id_col: str) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error of each row (id, x) and component.

    deviation is exact; null where it doesn't fit into a long.
    """
    kind = rows.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]])
    n, d, k = fit.n, fit.d, len(fit.variances)
    if not k:
        return rows.sparkSession.createDataFrame([], out)
    sums, error = fit.sums, fit.identity_error
    project, explained = (fit.components / np.sqrt(fit.variances)[:, None]).T, fit.variances / fit.trace

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), d, np.int64)
            b = len(x)
            if not b:
                continue
            top = n * (int(np.abs(x).max()) + 1) * 2
            if top < 1 << 62:
                y = n * x - np.array(sums, np.int64)
            else:
                y = n * x.astype(object) - np.array(sums, dtype=object)
            if int(np.abs(y).max()) ** 2 * d < 1 << 63:
                deviation = pa.array((y.astype(np.int64) ** 2).sum(1))
            else:
                exact = [sum(int(e) ** 2 for e in row) for row in y]
                deviation = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
            white = (y.astype(float) / n) @ project
            at = pa.array(np.repeat(np.arange(b), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b)),
                    pa.array(np.full(b * k, n, np.int64)),
                    deviation.take(at),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, b)),
                    pa.array(np.full(b * k, error)),
                ],
                names=out.names,
            )

    return rows.select(id_col, "x").mapInArrow(run, out)


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows of vectors whitened: one row for each usable vector and component, numbered from 1 by falling variance.

    A vector counts if it isn't null, has the most frequent length (of a tie the longest)
    and holds neither nulls nor entries that aren't finite. Its entries c become
    floor(64 c) + 1000000, those beyond 2^52 in size count as that. The fit list holds
    each distinct vector once, so repeated rows weigh nothing but are all returned; rows
    with a null id too. Components without variance are left out: no usable rows, or one
    distinct vector alone, give none. Of components with one variance any basis may come out.
    """
    rows = usable(vectors.select(F.col(id_col), F.col(vector_col).alias("_v")), "_v")
    d = common_length(rows, "_v")
    rows = rows.where(F.size("_v") == (d or 0)).select(id_col, scaled(F.col("_v"), SCALE, SHIFT).alias("x"))
    fit = fit_whitening(rows, d, components) if d else Fit(0, 0, [])
    return apply_whitening(rows, fit, id_col)
