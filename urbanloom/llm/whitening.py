"""Embedding whitening: QDWH spectral divide and conquer of the exact covariance, then broadcast whitening.

The covariance of d-dimensional vectors is a d x d matrix however many rows there are; only it, sums of d entries and
the chosen components pass through the driver. Rows stay in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Entries become floor(SCALE * c) + SHIFT; those beyond LARGEST have no exact long there.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0**46
LONG = 2**63 - 1


def polar(a: np.ndarray, rounds: int = 40) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH: dynamically weighted Halley steps, by QR while the weights are large, by Cholesky after."""
    n = len(a)
    x, low = a / (np.linalg.norm(a) or 1.0), 2.0**-52
    for _ in range(rounds):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        weight = math.sqrt(1 + d) + 0.5 * math.sqrt(8 - 4 * d + 8 * (2 - square) / (square * math.sqrt(1 + d)))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([math.sqrt(c) * x, np.eye(n)]))
            new = (b / c) * x + (weight - b / c) / math.sqrt(c) * q[:n] @ q[n:].T
        else:
            lower = np.linalg.cholesky(np.eye(n) + c * x.T @ x)
            half = np.linalg.solve(lower, x.T)
            new = (b / c) * x + (weight - b / c) * np.linalg.solve(lower.T, half).T
        low = min(1.0, low * (weight + b * square) / (1 + c * square))
        moved, x = np.linalg.norm(new - x), (new + new.T) / 2
        if low > 1 - 1e-15 and moved < 1e-10:
            break
    return x


def components(a: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    The polar factor of the shifted matrix is its sign, which gives the projector onto the eigenvectors above the shift;
    an orthonormal basis of its range and one of the rest split the matrix in two, which are split in turn down to
    single components. A split whose off-diagonal block is not negligible, as when the shift meets an eigenvalue, is
    tried again with another shift. A block that is a multiple of the identity to rounding needs no split.
    """
    rng, size, whole = np.random.default_rng(seed), len(a), np.linalg.norm(a)
    basis, work = np.zeros((size, 0)), [(a, np.eye(size))]
    while work:
        block, frame = work.pop()
        n = len(block)
        middle = np.trace(block) / n if n else 0.0
        if n <= 1 or np.linalg.norm(block - middle * np.eye(n)) <= 1e-15 * whole:
            basis = np.hstack([basis, frame])
            continue
        best, diagonal = None, np.sort(np.diag(block))
        for attempt in range(12):
            shift = np.median(diagonal) if not attempt else middle if attempt == 1 else rng.uniform(diagonal[0], diagonal[-1])
            if n == 2:
                shift = middle
            projector = (polar(block - shift * np.eye(n)) + np.eye(n)) / 2
            k = round(float(np.trace(projector)))
            if not 0 < k < n:
                continue
            mixed = rng.standard_normal((n, n))
            q, _ = np.linalg.qr(np.hstack([projector @ mixed[:, :k], mixed[:, k:] - projector @ mixed[:, k:]]))
            turned = q.T @ block @ q
            left = np.linalg.norm(turned[k:, :k])
            if best is None or left < best[0]:
                best = (left, k, q, turned)
            if left <= 1e-14 * whole:
                break
        if best is None:  # no shift separates the block: its eigenvalues agree to rounding
            basis = np.hstack([basis, frame])
            continue
        _, k, q, turned = best
        for part in (slice(0, k), slice(k, n)):
            inner = turned[part, part]
            work.append(((inner + inner.T) / 2, frame @ q[:, part]))
    basis, _ = np.linalg.qr(basis) if size else (basis, None)
    values = np.einsum("ij,ij->j", basis, a @ basis)
    order = np.argsort(-values, kind="stable")
    return values[order], basis[:, order]


def whole_entries(vector: Column) -> Column:
    """The vector as longs floor(64 c) + 1000000; null where the vector is null or has a null, non-finite or too large entry."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) > LARGEST))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _products(y: np.ndarray) -> list[np.ndarray]:
    """Exact sums of the outer products of the rows of ``y``, in pieces whose entries a double or a long holds."""
    top = int(np.abs(y).max(initial=0)) or 1
    step = max(1, min(len(y) or 1, 2**53 // (top * top)))
    if top * top < 2**53:
        return [(part.T.astype(np.float64) @ part.astype(np.float64)).astype(np.int64).astype(object) for part in (y[i : i + step] for i in range(0, len(y), step))]
    wide = y.astype(object)
    return [wide.T.dot(wide)]


def exact_covariance(distinct: DataFrame, x: str, n: int, sums: list[int]) -> np.ndarray:
    """The covariance, divisor n, of the distinct long vectors: each entry is the double nearest to the exact value.

    Entries are centred on the whole part of their mean before they are multiplied; the fraction that is left is
    corrected in whole numbers, so no order of summation shows.
    """
    d = len(sums)
    middle = np.array([s // n for s in sums], np.int64)
    rest = [s - int(m) * n for s, m in zip(sums, middle, strict=True)]  # sums of the centred entries
    rows, cols = np.triu_indices(d)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            if batch.num_rows:
                for piece in _products(_matrix(batch.column(0)) - middle):
                    total = total + piece
        texts = [str(v) for v in total[rows, cols]]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(texts, pa.string())], ["i", "j", "s"])

    parts = distinct.select(x).mapInArrow(moments, "i int, j int, s string")
    summed = parts.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect()
    out = np.zeros((d, d))
    for r in summed:
        i, j = r["i"], r["j"]
        out[i, j] = out[j, i] = float(Fraction(int(r["s"]) * n - rest[i] * rest[j], n * n))
    return out


def whiten(rows: DataFrame, keep: int = 16, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): the whitened coordinates of each usable row.

    Rows whose vector is null or has null or non-finite entries, or entries of 2^46 and more, are left out, as are those
    of another length than the most common one (ties: the shorter) and empty vectors. Components come from the distinct
    vectors alone, so copies do not weigh; there are at most ``keep``, and only those whose variance is above 1e-13 of the
    largest, so a table of one distinct vector gives no rows. deviation is null beyond the range of a long. Repeated
    rows and null ids are whitened as others are; other columns are not read; an empty table gives no rows.
    """
    spark = rows.sparkSession
    id_kind = rows.schema[id_col].dataType.simpleString()
    good = rows.select(F.col(id_col).alias("_id"), whole_entries(F.col(vector)).alias("x")).where(F.col("x").isNotNull() & (F.size("x") > 0))
    common = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = common["d"] if common else 1
    good = good.where(F.size("x") == d)
    distinct = written(good.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit")
    entries = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("s")).collect()
    out = f"{id_col} {id_kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, sums = (entries[0]["n"], [int(r["s"]) for r in sorted(entries, key=lambda r: r["i"])]) if entries else (0, [0] * d)
    values, vectors = components(exact_covariance(distinct, "x", n, sums)) if n else (np.zeros(0), np.zeros((d, 0)))
    share = values / values.sum() if values.sum() > 0 else values
    held = int((values > 1e-13 * max(values.max(initial=0), 0)).sum()) if values.max(initial=0) > 0 else 0
    held = min(held, keep)
    turn = vectors[:, :held] / np.sqrt(values[:held])
    safe = n * max((abs(s) // n + 1 for s in sums), default=1) < 2**62 if n else True
    model = spark.sparkContext.broadcast((turn, np.array(sums, np.int64 if safe else object), share[:held]))

    def numerators(x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: as longs where they fit."""
        fits = safe and n * int(np.abs(x).max(initial=0)) < 2**62
        return n * x - model.value[1] if fits else n * x.astype(object) - model.value[1].astype(object)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((held, held)), np.zeros(held)
        for batch in batches:
            if batch.num_rows:
                w = (numerators(_matrix(batch.column(0))) / n).astype(np.float64) @ model.value[0]
                total, first = total + w.T @ w, first + w.sum(axis=0)
        at = [(i, j, float(total[i, j])) for i in range(held) for j in range(held)] + [(i, -1, float(first[i])) for i in range(held)]
        yield pa.RecordBatch.from_arrays([pa.array([a[k] for a in at], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], ["i", "j", "s"])

    error = 0.0
    if held:
        sums_of = {(r["i"], r["j"]): r["s"] for r in distinct.mapInArrow(gram, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
        error = max(abs(sums_of[i, j] / n - sums_of[i, -1] * sums_of[j, -1] / n / n - (i == j)) for i in range(held) for j in range(held))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, _, share = model.value
        for whole in batches:
            for start in range(0, whole.num_rows if held else 0, 4096):
                batch = whole.slice(start, 4096)
                m, k = numerators(_matrix(batch.column(1))), batch.num_rows
                whitened = (m / n).astype(np.float64) @ turn
                top = float(np.abs(m.astype(np.float64)).max(initial=0))
                square = (m * m).sum(axis=1) if top * top * d < 2.0**62 and m.dtype != object else (m.astype(object) ** 2).sum(axis=1)
                deviation = pa.array([int(v) if v <= LONG else None for v in square], pa.int64())
                at = pa.array(np.repeat(np.arange(k), held), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array(np.tile(np.arange(1, held + 1), k), pa.int32()), pa.array(np.full(k * held, n), pa.int64()), deviation.take(at), pa.array(whitened.ravel()), pa.array(np.tile(share, k)), pa.array(np.full(k * held, error))],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return good.select("_id", "x").mapInArrow(project, out)
