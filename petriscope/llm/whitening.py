"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance is never formed: each pass over the vectors gives Xᵀ(XQ) for a
block Q of directions, on rows centred before they are multiplied.  A QR
decomposition makes the next block, Rayleigh-Ritz within it the components; the
same product gives their residuals, and passes go on until those certify all k.
Where they shrink too slowly (a flat spectrum), the block is doubled; a block as
wide as the space is exact.  What a task gives and the driver holds is a matrix
of dimensions by block, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Residual of a component, as a share of the largest eigenvalue, that certifies it.
CERTAIN = 1e-13
#: Components whose eigenvalue is a smaller share of the largest are rounding, not variance.
NEGLIGIBLE = 1e-11
#: Passes in which the residuals must be expected to get there; else the block is doubled.
PATIENCE = 6


@dataclass(frozen=True)
class Levels:
    """Vectors as whole numbers floor(scale * entry) + shift, of one length."""

    dims: int
    scale: float
    shift: int

    def read(self, vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the rows that take part, their whole numbers as int64)."""
        fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), self.dims), False)
        at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
        flat = pc.fill_null(vectors.filter(fits).flatten().cast(pa.float64()), float("nan"))
        values = flat.to_numpy(zero_copy_only=False).reshape(-1, self.dims)
        good = np.isfinite(values).all(1)
        return at[good], np.floor(self.scale * values[good]).astype(np.int64) + self.shift


@dataclass(frozen=True)
class Whitening:
    """What a fit gives; ``axes`` holds the components as columns, divided by the roots of their eigenvalues."""

    levels: Levels
    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        return (self.eigenvalues / self.trace).tolist() if len(self.eigenvalues) else []

    def apply(self, df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        """(id, deviation decimal, whitened array<double>) of each vector that takes part; one narrow pass."""
        levels, n, sums, axes = self.levels, self.n, self.sums, self.axes

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, x = levels.read(batch.column(1))
                away = apart(x, n, sums)
                exact = float(np.abs(away).max(initial=0)) ** 2 * levels.dims < 2.0**62
                squares = (away * away).sum(1).tolist() if exact else [sum(v * v for v in row) for row in away.tolist()]
                white = (away / n) @ axes
                ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * axes.shape[1])
                listed = pa.ListArray.from_arrays(ends, pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(squares, pa.decimal128(38, 0)), listed], ["id", "deviation", "whitened"])

        return _two(df, id_col, vec_col).mapInArrow(rows, "id long, deviation decimal(38,0), whitened array<double>")


def _two(df: DataFrame, id_col: str | None, vec_col: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    own = F.col(f"`{id_col}`").cast("long") if id_col else F.lit(None).cast("long")
    return df.select(own.alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))


def apart(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact."""
    if n * max(int(np.abs(x).max(initial=0)), 1) >= 2**62:
        raise OverflowError(f"{n} vectors times entries of up to {np.abs(x).max()} don't fit 64 bits")
    return n * x - sums


def _summed(df: DataFrame, vec_col: str, one: Callable[[pa.ListArray], list[np.ndarray]], shapes: list[tuple[int, ...]], kind: str) -> list[np.ndarray]:
    """Arrays that ``one`` makes of each batch, added up: in a task, then element by element by Spark; of fixed size."""
    total = sum(int(np.prod(s)) for s in shapes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = np.zeros(total, np.int64 if kind == "long" else np.float64)
        for batch in batches:
            so_far += np.concatenate([np.ravel(a) for a in one(batch.column(1))])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total, dtype=np.int32)), pa.array(so_far)], ["cell", "v"])

    out = np.zeros(total, np.int64 if kind == "long" else np.float64)
    for cell, v in _two(df, None, vec_col).mapInArrow(rows, f"cell int, v {kind}").groupBy("cell").agg(F.sum("v")).collect():
        out[cell] = v
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    return [a.reshape(s) for a, s in zip(np.split(out, ends[:-1]), shapes, strict=True)]


def fit(df: DataFrame, vec_col: str = "embedding", k: int = 32, scale: float = 64, shift: int = 1_000_000, block: int | None = None) -> Whitening | None:
    """The ``k`` leading components of the vectors' covariance (divisor n), or as many as have variance; None without vectors.

    ``block`` directions are iterated together (twice ``k``, if not given).
    """
    found = df.select(F.size(f"`{vec_col}`").alias("d")).where("d > 0").groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if found is None:
        return None
    levels = Levels(found[0], scale, shift)
    d = levels.dims

    def count(v: pa.ListArray) -> list[np.ndarray]:
        at, x = levels.read(v)
        return [np.array([len(at)]), x.sum(0)]

    (n,), sums = _summed(df, vec_col, count, [(1,), (d,)], "long")
    n = int(n)
    if not n:
        return None

    def centred(v: pa.ListArray) -> np.ndarray:
        return apart(levels.read(v)[1], n, sums) / n

    def product(q: np.ndarray) -> tuple[np.ndarray, float]:
        def one(v: pa.ListArray) -> list[np.ndarray]:
            x = centred(v)
            return [x.T @ (x @ q), (x * x).sum()]

        z, trace = _summed(df, vec_col, one, [q.shape, (1,)], "double")
        return z / n, float(trace[0]) / n

    rng = np.random.default_rng(0)
    width, before = min(d, block or 2 * k), np.inf
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    while True:
        z, trace = product(q)
        h = q.T @ z
        e, w = np.linalg.eigh((h + h.T) / 2)
        e, w = e[::-1], w[:, ::-1]
        u, vu = q @ w, z @ w
        worst = float(np.linalg.norm(vu - u * e, axis=0)[:k].max()) / max(e[0], np.finfo(float).tiny)
        if worst <= CERTAIN or width == d or e[0] <= 0:
            break
        if worst * min(1.0, worst / before) ** PATIENCE > CERTAIN and before < np.inf:
            width, before = min(d, 2 * width), np.inf
            vu = np.hstack([vu, rng.standard_normal((d, width - vu.shape[1])) * max(e[0], 1.0)])
        else:
            before = worst
        q = np.linalg.qr(vu)[0]
    kept = int((e[:k] > NEGLIGIBLE * max(e[0], 0)).sum()) if trace > 0 else 0
    axes = u[:, :kept] / np.sqrt(e[:kept])
    if not kept:
        return Whitening(levels, n, sums, e[:0], axes, trace)

    def check(v: pa.ListArray) -> list[np.ndarray]:
        y = centred(v) @ axes
        return [y.T @ y, y.sum(0)]

    products, means = _summed(df, vec_col, check, [(kept, kept), (kept,)], "double")
    error = products / n - np.outer(means / n, means / n) - np.eye(kept)
    return Whitening(levels, n, sums, e[:kept], axes, trace, float(np.abs(error).max()))


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 32, **parameters) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), one row for each vector and component.

    Vectors that are null, hold null or non-finite entries, have no entries, or
    another length than most vectors of the table (of the longest such length) take no part and give no
    rows.  Repeated rows count, and are given, each; a null id stays null.
    Components without variance are left out, so vectors that are all the same,
    a single vector and an empty table give no rows.  Equal eigenvalues may be
    numbered either way.  Entries so large that their sums don't fit 64 bits are
    an error.  Other columns don't matter, whatever their names.
    """
    model = fit(df, vec_col, k, **parameters)
    schema = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None or not model.explained:
        return df.sparkSession.createDataFrame([], schema)
    share: Column = F.get(F.array(*map(F.lit, model.explained)), F.col("at"))
    rows = model.apply(df, id_col, vec_col).select("id", "deviation", F.posexplode("whitened").alias("at", "w"))
    return rows.select("id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"), share.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
