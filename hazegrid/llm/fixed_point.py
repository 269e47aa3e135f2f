"""Vectors as integers: each component ``c`` becomes ``floor(256 * c)``.

A vector is packed with the fewest bytes that hold its largest entry, so equal vectors
are equal bytes, and what is shuffled is smaller than the floats were.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SCALE = 256
#: Integers beyond this stay here; a double has no fraction left there.
MOST = 2**53

_KINDS = (np.dtype("<i1"), np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))
_BY_WIDTH = {kind.itemsize: kind for kind in _KINDS}


def integers(vector) -> np.ndarray | None:
    """``floor(256 * c)`` of each component; ``None`` for null, or with a null or non-finite component."""
    if vector is None:
        return None
    values = np.array(vector, np.float64)  # None becomes NaN
    if not np.isfinite(values).all():
        return None
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * SCALE), -MOST, MOST).astype(np.int64)


def pack(x: np.ndarray) -> bytes:
    """Width of an entry in bytes, then the entries."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    kind = next(k for k in _KINDS if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, _BY_WIDTH[packed[0]], offset=1).astype(np.int64)


def packed_batches(batches, target: pa.Schema):
    """Arrow batches ``(id, vector)`` to ``(id, dim, x)``; vectors that take no part are left out."""
    from hazegrid.llm.common import pieces, strings

    for batch in batches:
        for part in pieces(batch, 4096):
            ids, dims, rows = [], [], []
            for key, vector in zip(strings(part, "id"), strings(part, "vector"), strict=True):
                x = integers(vector)
                if x is not None:
                    ids.append(key)
                    dims.append(len(x))
                    rows.append(pack(x))
            arrays = [pa.array(c, f.type) for c, f in zip((ids, dims, rows), target, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)
