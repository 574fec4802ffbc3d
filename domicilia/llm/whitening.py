"""Whitened embeddings from an exact covariance by polarisation.

Entries are taken as integers, so sums of squares are exact in any order. One pass counts
the vectors and sums each dimension. The next sums the squares of the centred values of
every dimension and of the sum of every two dimensions. The variance of a sum less the two
variances is twice the covariance, so differences of these few exact numbers give the whole
matrix, which is decomposed once. What is collected grows with the square of the dimension
and not with the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domicilia.llm.tables import own, store

SCALE, SHIFT = 64.0, 1_000_000
LIMIT = 1 << 40
_LIMB = 48
_EXACT = 1 << 53  # integers below are exact in double precision
_BLOCK = 1024


def integers(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) for each length of vectors, or for one: x = floor(64 * entry) + 1000000 as integers.

    Vectors that are NULL or empty, hold NULL or non-finite entries, or entries that have no exact
    integer (2^34 and more in size) are left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths[lengths > 0]).tolist() if dim is None else [dim]:
        rows = np.flatnonzero(lengths == size)
        matrix = values[starts[rows][:, None] + np.arange(size)]
        # NaN compares false.
        good = (np.abs(matrix) < LIMIT / SCALE).all(1)
        if good.any():
            yield rows[good], np.floor(SCALE * matrix[good]).astype(np.int64) + SHIFT


def limbs(totals: np.ndarray) -> list[np.ndarray]:
    """Integers of any size as three summable long columns."""
    mask = (1 << _LIMB) - 1
    return [np.array([(int(t) >> (k * _LIMB)) & mask if k < 2 else int(t) >> (2 * _LIMB) for t in totals], np.int64) for k in range(3)]


def joined(low: int, middle: int, high: int) -> int:
    return low + (middle << _LIMB) + (high << (2 * _LIMB))


def pair_squares(z: np.ndarray) -> np.ndarray:
    """Exact sums over rows of z_i^2 for each dimension, then of (z_i + z_j)^2 for each i < j, as Python integers.

    Squares and their sums over a block stay below 2^53, where doubles are exact; larger values go in two halves.
    """
    dim = z.shape[1]
    total = np.zeros(dim * (dim + 1) // 2, object)
    for low in range(0, len(z), _BLOCK):
        block = z[low : low + _BLOCK]
        wide = int(np.abs(block).max(initial=0)) * 2
        if wide * wide * len(block) < _EXACT:
            total += _squares(block.astype(np.float64))
        else:
            total += _wide_squares(block)
    return total


def _squares(block: np.ndarray) -> np.ndarray:
    parts = [np.einsum("ij,ij->j", block, block)]
    for i in range(block.shape[1] - 1):
        sums = block[:, i, None] + block[:, i + 1 :]
        parts.append(np.einsum("ij,ij->j", sums, sums))
    return np.concatenate(parts).astype(np.int64).astype(object)


def _wide_squares(block: np.ndarray) -> np.ndarray:
    total = np.zeros(block.shape[1] * (block.shape[1] + 1) // 2, object)
    half = 21
    for low in range(0, len(block), 256):  # 2^44 a product, 2^52 a sum
        part = block[low : low + 256]
        columns = [part, *[part[:, i, None] + part[:, i + 1 :] for i in range(part.shape[1] - 1)]]
        at = 0
        for c in columns:
            high, rest = (c >> half).astype(np.float64), (c & ((1 << half) - 1)).astype(np.float64)
            sums = [np.einsum("ij,ij->j", a, b).astype(np.int64).astype(object) for a, b in ((high, high), (high, rest), (rest, rest))]
            total[at : at + c.shape[1]] += sums[0] * (1 << 2 * half) + sums[1] * (1 << half + 1) + sums[2]
            at += c.shape[1]
    return total


@dataclass(frozen=True)
class Centre:
    """n vectors of `dim` entries with sums `sums`; `mean` is the nearest integer and n * mean + rest the sum."""

    dim: int
    n: int
    sums: tuple[int, ...]

    @property
    def mean(self) -> list[int]:
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def rest(self) -> list[int]:
        return [s - self.n * m for s, m in zip(self.sums, self.mean, strict=True)]


def covariance(centre: Centre, squares: list[int]) -> np.ndarray:
    """Covariance matrix, divisor n, from the sums of `pair_squares` of x - mean.

    With r the rest of a dimension, or of two, the squares of n * x - sum add up to n^2 * squares - n * r^2, exactly.
    """
    n, rest, dim = centre.n, centre.rest, centre.dim
    single = [n * n * squares[i] - n * rest[i] ** 2 for i in range(dim)]
    matrix = np.empty((dim, dim))
    at = dim
    for i in range(dim):
        matrix[i, i] = single[i] / n**3
        for j in range(i + 1, dim):
            both = n * n * squares[at] - n * (rest[i] + rest[j]) ** 2
            matrix[i, j] = matrix[j, i] = (both - single[i] - single[j]) / (2 * n**3)
            at += 1
    return matrix


def deviations(z: np.ndarray, centre: Centre) -> pa.Array:
    """Sum over dimensions of (n * x - sum)^2 for each row of z = x - mean; NULL where a long cannot hold it."""
    rest = np.array(centre.rest, np.float64)
    about = ((float(centre.n) * z - rest) ** 2).sum(1)
    found = np.zeros(len(z), object)
    small = about < 2.0**60
    y = centre.n * z[small] - np.array(centre.rest, np.int64) if small.any() else np.zeros((0, centre.dim), np.int64)
    found[small] = (y * y).sum(1)
    for row in np.flatnonzero(~small).tolist():
        exact = sum((centre.n * int(v) - r) ** 2 for v, r in zip(z[row], centre.rest, strict=True)) if about[row] < 2.0**64 else None
        found[row] = exact if exact is not None and exact < 1 << 63 else None
    return pa.array(found.tolist(), pa.int64())


@dataclass(frozen=True)
class Model:
    """`axes`: a column for each component, already divided by its standard deviation; `explained`: shares of the trace."""

    centre: Centre
    axes: np.ndarray
    explained: np.ndarray

    def whitened(self, z: np.ndarray) -> np.ndarray:
        return (z - np.array(self.centre.rest, np.float64) / self.centre.n) @ self.axes


@dataclass(frozen=True)
class Whitening:
    """`components`: how many at most; `least`: variance, as a share of the largest, below which a
    component counts as constant and is left out, since it has nothing to scale.
    """

    components: int = 32
    least: float = 1e-11

    def centre(self, vectors: DataFrame) -> Centre | None:
        """Counts and sums of the length that most vectors have, ties to the shortest; None without vectors."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple[int, np.ndarray]] = {}
            for batch in batches:
                for rows, x in integers(batch.column("embedding")):
                    n, total = held.get(x.shape[1], (0, np.zeros(x.shape[1], object)))
                    held[x.shape[1]] = (n + len(rows), total + x.sum(0))
            for dim, (n, total) in held.items():
                columns = [np.full(dim, dim), np.arange(dim), np.full(dim, n), *limbs(total)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["dim", "i", "n", "a", "b", "c"])

        partial = vectors.mapInArrow(add, "dim long, i long, n long, a long, b long, c long")
        sums = store(partial.groupBy("dim", "i").agg(*[F.sum(c).alias(c) for c in "nabc"]))
        best = sums.filter("i = 0").orderBy(F.desc("n"), "dim").first()
        if best is None:
            return None
        rows = sorted(sums.filter(F.col("dim") == best["dim"]).select("i", *"abc").collect())  # a row for each dimension
        return Centre(best["dim"], best["n"], tuple(joined(*row[1:]) for row in rows))

    def squares(self, vectors: DataFrame, centre: Centre) -> list[int]:
        """Exact sums of squares of x - mean, in the order of `pair_squares`."""
        mean = np.array(centre.mean, np.int64)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for _, x in integers(batch.column("embedding"), centre.dim):
                    part = pair_squares(x - mean)
                    total = part if total is None else total + part
            if total is not None:
                columns = [np.arange(len(total)), *limbs(total)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["pair", "a", "b", "c"])

        partial = vectors.mapInArrow(add, "pair long, a long, b long, c long")
        rows = partial.groupBy("pair").agg(*[F.sum(c).alias(c) for c in "abc"]).collect()  # dim * (dim + 1) / 2 rows
        return [joined(*row[1:]) for row in sorted(rows)]

    def model(self, vectors: DataFrame, embedding: str = "embedding") -> Model | None:
        """Axes of the components, by falling variance; None without vectors."""
        vectors = own(vectors, embedding=embedding)
        centre = self.centre(vectors)
        if centre is None:
            return None
        matrix = covariance(centre, self.squares(vectors, centre))
        values, axes = np.linalg.eigh(matrix)
        values, axes = values[::-1], axes[:, ::-1]
        kept = values[: self.components] > max(self.least * values[0], 0.0)
        count = int(kept.sum())
        trace = float(np.trace(matrix))
        return Model(centre, axes[:, :count] / np.sqrt(values[:count]), values[:count] / trace if trace else values[:count])

    def identity_error(self, vectors: DataFrame, model: Model) -> float:
        """Largest entry of the whitened vectors' covariance less the identity, measured over all of them."""
        centre, size = model.centre, model.axes.shape[1]
        if not size:
            return 0.0
        shared = vectors.sparkSession.sparkContext.broadcast(model)  # dim * components doubles
        mean = np.array(centre.mean, np.int64)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size + 1, size))
            for batch in batches:
                for _, x in integers(batch.column("embedding"), centre.dim):
                    white = shared.value.whitened(x - mean)
                    total += np.vstack([white.T @ white, white.sum(0)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "total"])

        cells = vectors.mapInArrow(add, "cell long, total double").groupBy("cell").agg(F.sum("total")).collect()
        total = np.array([t for _, t in sorted(cells)]).reshape(size + 1, size) / centre.n
        # The vectors are centred already; what rounding left of their mean is taken out as well.
        return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(size)).max())

    def run(self, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
        """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

        Vectors that are NULL, empty or hold NULL or non-finite entries take no part, nor do those of
        another length than most. NULL and repeated ids count each for itself. Without any
        variance, as for one vector or equal ones, there is no component and the result is empty, as it is for an empty
        table. deviation is exact, and NULL where it exceeds a long.
        """
        vectors = own(vectors, vec_id=vec_id, embedding=embedding).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        model = self.model(vectors)
        if model is None:
            return vectors.sparkSession.createDataFrame([], schema)
        error = self.identity_error(vectors.select("embedding"), model)
        shared = vectors.sparkSession.sparkContext.broadcast(model)
        mean = np.array(model.centre.mean, np.int64)
        size = model.axes.shape[1]
        names = [c.split()[0] for c in schema.split(", ")]

        def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                for rows, x in integers(batch.column("embedding"), known.centre.dim):
                    z, every = x - mean, pa.array(np.repeat(np.arange(len(rows)), size))
                    total = len(rows) * size
                    columns = [
                        batch.column("vec_id").take(pa.array(rows)).take(every),
                        pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(total, known.centre.n)),
                        deviations(z, known.centre).take(every),
                        pa.array(known.whitened(z).ravel()),
                        pa.array(np.tile(known.explained, len(rows))),
                        pa.array(np.full(total, error)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)

        return vectors.mapInArrow(convert, schema)
