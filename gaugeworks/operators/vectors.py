"""Columns of equally long vectors as matrices, some rows at once."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a matrix: a batch has 10,000 vectors, and a copy of them for every step would be 31 MB each for windows.
MATRIX_BYTES = 2 << 20


def matrices(vectors: pa.Array, most: int = MATRIX_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors that are not NULL, a few at once, read from Arrow's memory; missing entries are NaN."""
    rows = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    if not len(rows):
        return
    width = len(vectors[int(rows[0])])
    step = max(1, most // (8 * max(width, 1)))
    for at in range(0, len(rows), step):
        own = rows[at : at + step]
        first, last = int(own[0]), int(own[-1]) + 1
        some = vectors.slice(first, last - first)
        # flatten() leaves out vectors that are NULL.
        yield own, some.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False).reshape(len(own), width)


def projected(vectors: pa.Array, function: Callable[[np.ndarray], np.ndarray], accepted: np.ufunc | None = None) -> pa.Array:
    """`function` of the vectors whose entries are all `accepted` (else: not NaN), row by row a vector; NULL for the others."""
    found = []
    for rows, points in matrices(vectors):
        good = (~np.isnan(points) if accepted is None else accepted(points)).all(axis=1)
        if good.any():
            found.append((rows[good], function(points if good.all() else points[good])))
    if not found:
        return pa.nulls(len(vectors), pa.list_(pa.float64()))
    values = np.concatenate([points for _, points in found])
    known = np.zeros(len(vectors), bool)
    known[np.concatenate([rows for rows, _ in found])] = True
    offsets = np.concatenate(([0], np.cumsum(known) * values.shape[1]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.ravel()), mask=pa.array(~known))
