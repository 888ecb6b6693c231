"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers, `x = floor(64 c) + 1000000`. The fit list is each distinct x-vector once. All sums over it
are exact, and a centred entry is `(n x - S) / n` with the difference taken in whole numbers, so the large offset costs no
digit. Centred rows form a matrix A that stays in Spark as blocks of up to `BLOCK` rows.

A step of the bidiagonalisation multiplies A by a right vector v (a distributed product, a number a row), makes the
result u orthogonal to all earlier left vectors, and multiplies the transpose of A by u (a sum over rows). Left vectors
are as long as the table, so they are not stored: u_j = A w_j with a short w_j, and each task computes them anew from
the rows that it reads. One pass over the blocks gives the products with all earlier left vectors, the norm and the
transposed product; a second one follows where the first correction was not small. Right vectors are made orthogonal
on the driver, twice. Only sums of that size (vectors of the table's dimension) reach the driver, one a partition.

The bidiagonal matrix, at most dimension by dimension, is decomposed on the driver: its right singular vectors give the
components, its singular values the deviations. Steps go on to the full dimension, where nothing is left to find; beyond
`FULL_STEPS` dimensions they end when the wanted components have converged, and again from a new start vector, so that
repeated values are seen. A vector that ends the chain early (fewer directions than dimensions) is replaced by a new one.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries are dropped, as are rows whose
length is not the table's commonest one (of equally common ones the longest); entries beyond 64-bit whole numbers
saturate. Components without variance (up to rounding) have no whitened value and are left out, so a table of one
distinct vector gives no rows, as an empty one does. Repeated rows and null ids give rows like any other. A deviation
beyond 64 bits is null. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.operators.ordered import cut_lineage

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Rows of a block of the fit list.
BLOCK = 4_096
#: Cells of the fit list in one task of a pass, about.
TASK_CELLS = 1 << 20
FULL_STEPS = 512
#: Relative size below which a singular value is rounding.
RANK_TOLERANCE = 1e-11


def quantised(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`vec_id, x` (array of whole numbers) of the rows whose vector can be used, all of one length."""
    v = f"`{vector}`"
    usable = f"{v} is not null and size({v}) > 0 and forall({v}, c -> c is not null and not isnan(c) and abs(cast(c as double)) < double('inf'))"
    rows = embeddings.where(usable).selectExpr(f"`{vec_id}` as vec_id", f"{v} as v")
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    top = 1 << 62
    whole = f"cast(least(greatest(floor(cast(c as double) * {SCALE}), -{top}D), {top}D) as bigint) + {OFFSET}"
    return rows.where(f"size(v) = {length.d if length else 0}").selectExpr("vec_id", f"transform(v, c -> {whole}) as x")


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def blocked(rows: DataFrame, d: int) -> DataFrame:
    """The vectors in blocks: `kind` (the narrowest number type that holds them less the offset) and `cells`."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d) - OFFSET
            for at in range(0, len(x), BLOCK):
                part = x[at : at + BLOCK]
                kind = next(k for k in ("int16", "int32", "int64") if k == "int64" or np.abs(part).max() < np.iinfo(k).max)
                yield pa.RecordBatch.from_pydict({"kind": [kind], "cells": pa.array([part.astype(kind).tobytes()], pa.binary())})

    return rows.select("x").mapInArrow(pack, "kind string, cells binary")


def _dealt(blocks: DataFrame, d: int) -> DataFrame:
    """The blocks in as many partitions as their size asks for: every pass starts a task for each, however small it is."""
    each = "octet_length(cells) div case kind when 'int16' then 2 when 'int32' then 4 else 8 end"
    cells = blocks.agg(F.expr(f"sum({each})")).first()[0] or 0
    return cut_lineage(blocks.coalesce(max(1, -(-cells // TASK_CELLS))))


def _unpacked(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for kind, cells in zip(batch.column("kind").to_pylist(), batch.column("cells")):
            yield np.frombuffer(cells.as_buffer(), kind).reshape(-1, d).astype(np.int64)


class Fit:
    """The fit list as blocks, with its exact sums: `n`, and `sums` by dimension, less the offset."""

    def __init__(self, blocks: DataFrame, d: int):
        self.blocks, self.d = blocks, d

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s = 0, [0] * d
            for x in _unpacked(batches, d):
                n += len(x)
                # halves of 31 bits cannot overflow within a block
                high, low = (x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0)
                s = [a + (int(h) << 31) + int(w) for a, h, w in zip(s, high, low)]
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [[str(v) for v in s]]})

        parts = blocks.mapInArrow(sums, "n bigint, s array<string>").collect()
        self.n = sum(p.n for p in parts)
        self.sums = [sum(int(p.s[k]) for p in parts) for k in range(d)]

    def total(self, of) -> np.ndarray:
        """The sum over the fit list of `of(centred rows)`, an array of any shape; parts are added in a fixed order."""
        d, n, sums = self.d, self.n, self.sums

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for x in _unpacked(batches, d):
                part = of(centred(x, n, sums))
                out = part if out is None else out + part
            if out is not None:
                yield pa.RecordBatch.from_pydict({"v": [out.ravel().tolist()]})

        parts = [p.v for p in self.blocks.mapInArrow(run, "v array<double>").collect()]
        return np.sum(np.array(parts), axis=0)


def _numerator(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly; as objects where 64 bits may not do."""
    most = max(int(np.abs(x).max(initial=0)), 1)
    if n * most + max(abs(s) for s in sums) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _numerator(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2 of each row, exactly."""
    a = _numerator(x, n, sums)
    if a.dtype != object and (int(np.abs(a).max(initial=0)) ** 2) * a.shape[1] >= 1 << 62:
        a = a.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (a * a).sum(axis=1)]


def _orthogonal(r: np.ndarray, to: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        if to:
            q = np.array(to)
            r = r - q.T @ (q @ r)
    return r


def bidiagonalise(fit: Fit, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors (rows) of the centred fit list, largest first."""
    rng = np.random.default_rng(0)
    d = fit.d
    v, w, back, alphas, betas = [], [], [], [], []
    top, done, again = 0.0, False, 0

    def start() -> np.ndarray | None:
        r = _orthogonal(rng.standard_normal(d), v)
        size = np.linalg.norm(r)
        return None if size < 1e-8 else _orthogonal(r / size, v)

    following, beta = start(), 0.0
    while following is not None and len(v) < d and not done:
        now = following / np.linalg.norm(following)
        step = now - (beta * w[-1] if beta else 0.0)
        for _ in range(2):
            basis = np.array(w).reshape(-1, d)

            def products(a: np.ndarray, basis=basis, step=step) -> np.ndarray:
                u = a @ step
                return np.concatenate([(a @ basis.T).T @ u, [u @ u], a.T @ u])

            found = fit.total(products)
            c, norm, g = found[: len(w)], found[len(w)], found[len(w) + 1 :]
            if len(w):
                step = step - basis.T @ c
                g = g - np.array(back).T @ c
            if c @ c <= 1e-16 * norm:
                break
        alpha = float(np.sqrt(max(norm - c @ c, 0.0)))
        v.append(now)
        if alpha <= RANK_TOLERANCE * max(top, 1e-300):  # no variance along it
            alphas.append(0.0), w.append(np.zeros(d)), back.append(np.zeros(d))
            betas.append(0.0)
            following, beta = start(), 0.0
            continue
        alphas.append(alpha), w.append(step / alpha), back.append(g / alpha)
        top = max(top, alpha)
        following = _orthogonal(back[-1] - alpha * now, v)
        beta = float(np.linalg.norm(following))
        if beta <= RANK_TOLERANCE * top:
            following, beta = start(), 0.0
        if d > FULL_STEPS and len(v) >= 2 * wanted and _converged(alphas, betas, beta, wanted):
            done, again = again >= wanted, again + 1
            if again == 1:  # once more from elsewhere: a repeated value shows itself only there
                following, beta = start(), 0.0
        betas.append(beta)
    if not v:
        return np.zeros(0), np.zeros((0, d))
    _, s, q = np.linalg.svd(_bidiagonal(alphas, betas))
    return s, q @ np.array(v)


def _bidiagonal(alphas: list[float], betas: list[float]) -> np.ndarray:
    return np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1)


def _converged(alphas: list[float], betas: list[float], beta: float, wanted: int) -> bool:
    p, s, _ = np.linalg.svd(_bidiagonal(alphas, betas))
    return bool(np.all(np.abs(beta * p[-1, :wanted]) <= 1e-13 * s[0]))


def whiten(
    embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row a vector and component: `vec_id, component, n, deviation, whitened, explained, identity_error`."""
    schema = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    schema = schema.format(embeddings.schema[vec_id].dataType.simpleString())
    rows = quantised(embeddings, vec_id, vector)
    some = rows.select(F.size("x").alias("d")).first()
    d = some.d if some else 0
    blocks = _dealt(cut_lineage(blocked(rows.select("x").distinct(), d)), d) if d else None
    fit = Fit(blocks, d) if d else None
    if not fit or fit.n < 2:
        return embeddings.sparkSession.createDataFrame([], schema)
    n, sums = fit.n, fit.sums
    s, q = bidiagonalise(fit, components)
    held = [k for k in range(min(components, len(s))) if s[k] > RANK_TOLERANCE * max(s[0], 1e-300) and s[k] > 0]
    if not held:
        return embeddings.sparkSession.createDataFrame([], schema)
    to_white = (q[held].T / s[held]) * np.sqrt(n)
    trace = float(fit.total(lambda a: np.array([(a * a).sum()]))[0])
    explained = (s[held] ** 2 / trace).tolist()
    k = len(held)
    covariance = fit.total(lambda a: (a @ to_white).T @ (a @ to_white)).reshape(k, k) / n
    error = float(np.abs(covariance - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part.column("x"), d) - OFFSET
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": part.column("vec_id").take(each),
                        "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        "n": pa.array(np.full(m * k, n, np.int64)),
                        "deviation": pa.array(deviations(x, n, sums), pa.int64()).take(each),
                        "whitened": pa.array((centred(x, n, sums) @ to_white).ravel()),
                        "explained": pa.array(explained * m),
                        "identity_error": pa.array(np.full(m * k, error)),
                    }
                )

    return rows.mapInArrow(project, schema)
