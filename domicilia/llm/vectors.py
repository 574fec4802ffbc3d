"""Embedding columns as numpy matrices, and fast random rotations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def usable(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each dimension that occurs, in double precision.

    Vectors that are NULL, empty or zero, or hold NULL, NaN or infinite components are left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        matrix = values[starts[rows][:, None] + np.arange(dim)]
        good = np.isfinite(matrix).all(1) & (matrix != 0).any(1)
        if good.any():
            yield rows[good], matrix[good]


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that no square overflows or vanishes."""
    matrix = matrix / np.abs(matrix).max(1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True))


def hadamard(matrix: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, a power of two wide, keeping lengths."""
    n, width = matrix.shape
    out, step = matrix.copy(), 1
    while step < width:
        pairs = out.reshape(n, -1, 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, width)
        step *= 2
    return out / np.sqrt(width)


def padded(matrix: np.ndarray) -> np.ndarray:
    width = 1 << max(int(matrix.shape[1]) - 1, 0).bit_length()
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def rotated(matrix: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and Hadamard transforms, the same for one seed and width."""
    signs = np.random.Generator(np.random.PCG64([seed, matrix.shape[1]])).choice([-1.0, 1.0], (3, matrix.shape[1]))
    for row in signs:
        matrix = hadamard(matrix * row)
    return matrix
