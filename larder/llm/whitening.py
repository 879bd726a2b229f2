"""Embedding whitening on principal components.

The covariance of all vectors is summed in two passes: exact sums, then products of centred vectors, one
small matrix per task. Its eigenvectors come from spectral divide and conquer: the polar factor of the
covariance less a shift (by QDWH iteration) is a projector onto the eigenvectors beyond the shift, an
orthonormal basis of its range splits the matrix in two, and so on down to single components. Only
matrices of dimension x dimension reach the driver; the components go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.vectors import matrix
from larder.runtime import materialize

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
EPS = float(np.finfo(float).eps)
LONGEST = 1 << 63
CHUNK = 1 << 12  # vectors worked on at once


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by dynamically weighted Halley steps in QR form.

    low bounds the singular values from below and chooses the weights; where it is no bound, more steps follow.
    """
    size = len(a)
    norm = np.linalg.norm(a)
    if not norm:
        return np.eye(size)
    x, low = a / norm, EPS
    for _ in range(60):
        square = low * low
        d = (4 * (1 - square) / square**2) ** (1 / 3)
        root = np.sqrt(1 + d)
        alpha = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(gamma) * x, np.eye(size)]))
        after = beta / gamma * x + (alpha - beta / gamma) / np.sqrt(gamma) * (q[:size] @ q[size:].T)
        after = (after + after.T) / 2
        moved = np.linalg.norm(after - x)
        x, low = after, min(1 - EPS, low * (alpha + beta * square) / (1 + gamma * square))
        if moved <= 4 * EPS * size and low > 0.9:
            break
    return x


def _basis(projector: np.ndarray, rank: int, draw: np.random.Generator) -> np.ndarray:
    """An orthonormal basis of a projector's range: two steps of subspace iteration from random vectors."""
    q = draw.standard_normal((len(projector), rank))
    for _ in range(2):
        q, _ = np.linalg.qr(projector @ q)
    return q


def _split(a: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the two invariant subspaces beyond and below a shift; None if no shift tells any apart."""
    size, scale = len(a), np.linalg.norm(a)
    diagonal = np.sort(np.diag(a))
    middles = (diagonal[1:] + diagonal[:-1]) / 2
    # The median first; the means of neighbouring diagonal entries, widest gap first, where it falls on an eigenvalue.
    shifts = [float(np.median(diagonal)), *middles[np.argsort(diagonal[:-1] - diagonal[1:], kind="stable")], float(diagonal.mean())]
    best = None
    for shift in shifts:
        factor = polar(a - shift * np.eye(size))
        rank = round((np.trace(factor) + size) / 2)
        if not 0 < rank < size:
            continue
        over, under = _basis((np.eye(size) + factor) / 2, rank, draw), _basis((np.eye(size) - factor) / 2, size - rank, draw)
        whole, _ = np.linalg.qr(np.hstack([over, under]))
        over, under = whole[:, :rank], whole[:, rank:]
        leak = np.linalg.norm(under.T @ a @ over)
        if best is None or leak < best[0]:
            best = leak, over, under
        if leak <= 8 * EPS * np.sqrt(size) * scale:
            break
    return None if best is None else best[1:]


def spectral(a: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    draw = np.random.default_rng(seed)
    whole = np.linalg.norm(a)
    found: list[tuple[float, np.ndarray]] = []
    open_ = [((a + a.T) / 2, np.eye(len(a)))] if len(a) else []
    while open_:
        part, basis = open_.pop()
        beside = part - np.diag(np.diag(part))
        halves = None if np.linalg.norm(beside) <= EPS * whole else _split(part, draw)
        if halves is None:  # single, or equal to rounding: any basis will do
            found += list(zip(np.diag(part), basis.T, strict=True))
            continue
        for half in halves:
            inner = half.T @ part @ half
            open_.append(((inner + inner.T) / 2, basis @ half))
    if not found:
        return np.zeros(0), np.zeros((0, 0))
    vectors = np.stack([v / np.linalg.norm(v) for _, v in found], axis=1)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def quantised(component: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    return F.floor(component.cast("double") * scale).cast("long") + F.lit(offset).cast("long")


def whole_numbers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id and x, the components as whole numbers, of every row that takes part.

    Null and empty vectors and those with a null or non-finite component take none. Nor do those that are not as
    long as most (of equally common lengths the greatest counts). Repeated rows and null ids all take part.
    """
    v = F.col("v")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("v"))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & ~bad)
    common = rows.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size(v) == F.lit(common["size"] if common else 0))
    return rows.select("vec_id", F.transform(v, lambda c: quantised(c, scale, offset)).alias("x"))


def _integers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    """How many vectors, and their exact sums by dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                part = _integers(batch.column(0)).sum(axis=0)
                n, total = n + batch.num_rows, part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "total": pa.array([total.tolist()], pa.list_(pa.int64()))})

    parts = rows.select("x").mapInArrow(add, "n long, total array<long>")
    by_place = parts.select("n", F.posexplode("total").alias("at", "total")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    by_place.sort(key=lambda r: r.at)
    return (by_place[0].n if by_place else 0), np.array([r.total for r in by_place], np.int64)


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x less the mean: the difference is taken in whole numbers, n times as great."""
    return (n * x - total) / n


def products(rows: DataFrame, of_batch, size: int) -> np.ndarray:
    """The sum of y'y over all rows, y being the matrix of_batch makes of some of them.

    Each task sends one matrix, by rows; these are summed by place. size x size numbers reach the driver.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                y = of_batch(batch.slice(at, CHUNK))
                out += y.T @ y
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(size), pa.int32()), "row": pa.array(out.tolist(), pa.list_(pa.float64()))})

    parts = rows.mapInArrow(multiply, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((size, size))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return out


@dataclass
class Whitening:
    """n vectors with sums `total`; eigenvalues, falling, and eigenvectors (columns) of their covariance."""

    n: int
    total: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def first(self, components: int) -> np.ndarray:
        """Columns that whiten a centred vector. Components without variance beyond rounding can't be whitened."""
        kept = self.values[:components] > EPS * len(self.values) * max(self.trace, 0.0)
        taken = int(np.argmin(kept)) if not kept.all() else len(kept)
        return self.vectors[:, :taken] / np.sqrt(self.values[:taken])


def fit(rows: DataFrame) -> Whitening:
    """Components of rows with a column x of whole numbers, all of one length."""
    n, total = sums(rows)
    if not n:
        return Whitening(0, total, np.zeros(0), np.zeros((0, 0)), 0.0)
    covariance = products(rows.select("x"), lambda batch: centred(_integers(batch.column(0)), n, total), len(total)) / n
    values, vectors = spectral(covariance)
    return Whitening(n, total, values, vectors, float(np.trace(covariance)))


def whiten(rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """vec_id, deviation and whitened (one number per component) of every row.

    deviation is the squared distance to the mean, n times as great in each dimension, exactly; null if beyond a long.
    """
    n, total, weights = model.n, model.total, model.first(components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                away = n * _integers(part.column(1)) - total
                fits = (away.astype(float) ** 2).sum(axis=1) < LONGEST * (1 - 1e-9)
                deviation = (away * away).sum(axis=1)
                made = away / n @ weights
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(deviation, pa.int64(), mask=~fits), pa.array(made.tolist(), pa.list_(pa.float64()))],
                    ["vec_id", "deviation", "whitened"],
                )

    return rows.select("vec_id", "x").mapInArrow(project, "vec_id long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, n: int, components: int) -> float:
    """The largest absolute entry of the covariance of the whitened vectors less the identity."""
    if not components:
        return 0.0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(components)
        for batch in batches:
            total += matrix(batch.column(0), components).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"total": pa.array([total.tolist()], pa.list_(pa.float64()))})

    given = whitened.select("whitened")
    parts = given.mapInArrow(add, "total array<double>").select(F.posexplode("total").alias("at", "total"))
    mean = np.zeros(components)
    for r in parts.groupBy("at").agg(F.sum("total").alias("total")).collect():
        mean[r["at"]] = r["total"] / n
    covariance = products(given, lambda batch: matrix(batch.column(0), components) - mean, components) / n
    return float(np.abs(covariance - np.eye(components)).max())


def whitened_components(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET
) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of every row that takes part.

    See whole_numbers for the rows that do. An empty table, one vector, or vectors that are all equal have no
    component with variance, and give no rows; so do components beyond those that have some.
    """
    rows = whole_numbers(vectors, vec_id, vector, scale, offset)
    model = fit(rows)
    taken = model.first(components).shape[1]
    # Written once: the error is a sum over what is returned.
    made = materialize(whiten(rows, model, components))
    error = identity_error(made, model.n, taken)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values[:taken]]).cast("array<double>")
    return made.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_whitening": op13_whitening}
SQL: dict[str, str] = {}
