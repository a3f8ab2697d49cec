"""Parts of Arrow batches, so that what is made of a batch in Python is there for one part at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes and values of one part.
BYTES, VALUES = 1 << 20, 1_000


def ranges(load: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` whose loads are at most ``most`` together, or of a single one."""
    total, a = np.concatenate([[0], np.cumsum(load)]), 0
    while a < len(load):
        b = int(np.searchsorted(total, total[a] + most, side="right")) - 1
        b = min(max(b, a + 1), a + rows, len(load))
        yield a, b
        a = b


def parts(column: pa.Array) -> Iterator[pa.Array]:
    """A column of texts in parts of at most BYTES, or of one text."""
    for a, b in ranges(pc.binary_length(column).fill_null(0).to_numpy(), BYTES, VALUES):
        yield column[a:b]


def each(column: pa.Array, work: Callable[[str | None], object], kind: pa.DataType) -> pa.Array:
    """``work`` on each text of a column, whose Python objects are there for one part at a time."""
    done = [pa.array([work(t) for t in part.to_pylist()], type=kind) for part in parts(column)]
    return pa.concat_arrays(done) if done else pa.array([], type=kind)
