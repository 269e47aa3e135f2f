"""Embedding whitening with exact moments from bit-sliced scatter.

Vectors are integers ``x = floor(256 * c)``. In each block of distinct vectors the
dimensions are shifted to start at zero and cut into bit planes, and a plane's bits
across the block's rows are packed into 64-bit words. The cross-product of two
dimensions is the sum over their planes of ``2^(a + b)`` times the number of bits that
the planes share, an AND and a population count; the shift is undone in integers. Sums
over blocks are exact, and the scatter is centred as integers (``n * sum(xy) - SxSy``)
before it is divided once and handed to ``eigh``.

Only moments, one number for each pair of dimensions, reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.llm.common import field, map_arrow, staged
from hazegrid.llm.fixed_point import packed_batches, unpack

COMPONENTS = 4
#: Rows of a block; 64 words of each plane.
BLOCK = 4096
#: Moments are summed in two parts, so that no sum leaves 38 digits.
LOW_BITS = 60


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shift of each dimension, and the non-empty planes: words, dimension and bit of each."""
    shift = x.min(axis=0)
    up = (x - shift).T.astype(np.uint64)
    words, dims, bits = [], [], []
    pad = -x.shape[0] % 64
    for bit in range(int(up.max()).bit_length()):
        ones = ((up >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        there = np.flatnonzero(ones.any(axis=1))
        packed = np.packbits(np.pad(ones[there], ((0, 0), (0, pad))), axis=1)
        words.append(packed.view(np.uint64))
        dims.append(there)
        bits.append(np.full(len(there), bit))
    if not words:
        none = np.empty(0, np.int64)
        return shift, np.empty((0, 1), np.uint64), none, none
    dims, bits = np.concatenate(dims), np.concatenate(bits)
    order = np.lexsort((bits, dims))
    return shift, np.concatenate(words)[order], dims[order], bits[order]


def scatter(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums of the columns and of the products of columns ``i <= j``, as integers."""
    n, d = x.shape
    shift, words, dims, bits = planes(x)
    wide = bool(len(bits)) and n.bit_length() + 2 * (int(bits.max()) + 1) > 62
    kind = object if wide else np.int64
    weight = np.array([1 << int(b) for b in bits], kind)
    sums, cross = np.zeros(d, kind), np.zeros((d, d), kind)
    for k in range(len(words)):
        shared = np.bitwise_count(words[k] & words[k:]).sum(axis=1, dtype=np.int64).astype(kind) * weight[k:]
        sums[dims[k]] += shared[0]  # a plane shares all its bits with itself
        # Two planes of one dimension meet in both orders.
        shared[1:][dims[k + 1 :] == dims[k]] *= 2
        starts = np.flatnonzero(np.diff(dims[k:], prepend=-1))
        cross[dims[k], dims[k:][starts]] += np.add.reduceat(shared, starts) * weight[k]
    up, low = [int(v) for v in sums], [int(v) for v in shift]
    products = [
        [int(cross[i, j]) + low[i] * up[j] + low[j] * up[i] + n * low[i] * low[j] if i <= j else 0 for j in range(d)]
        for i in range(d)
    ]
    return [up[i] + n * low[i] for i in range(d)], products


def _moments(batches, block: int, target: pa.Schema):
    """Exact moments of a task's vectors, for each length of vector."""
    waiting: dict[int, list[bytes]] = {}
    done: dict[int, list] = {}

    def add(dim):
        x = np.stack([unpack(b) for b in waiting.pop(dim)])
        sums, products = scatter(x)
        rows = done.setdefault(dim, [0, np.zeros(dim, object), np.zeros((dim, dim), object)])
        rows[0] += len(x)
        rows[1] += np.array(sums, object)
        rows[2] += np.array(products, object)

    for batch in batches:
        for dim, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = waiting.setdefault(dim, [])
            rows.append(packed)
            if len(rows) == block:
                add(dim)
    for dim in list(waiting):
        add(dim)
    for dim, (n, sums, products) in done.items():
        # -1, -1 holds the count; -1, j the sum of j.
        cells = [(-1, -1, n), *((-1, j, int(s)) for j, s in enumerate(sums))]
        for i in range(dim):
            cells += [(i, j, int(products[i, j])) for j in range(i, dim)]
            yield _cells(dim, cells, target)
            cells = []


def _cells(dim: int, cells: list, target: pa.Schema) -> pa.RecordBatch:
    columns = (
        [dim] * len(cells),
        [c[0] for c in cells],
        [c[1] for c in cells],
        [Decimal(c[2] >> LOW_BITS) for c in cells],
        [Decimal(c[2] & ((1 << LOW_BITS) - 1)) for c in cells],
    )
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)


@dataclass
class Whitener:
    """What one length of vector is whitened with: distinct vectors, their sums, components and eigenvalues."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @classmethod
    def of(cls, n: int, sums: list[int], products: dict[tuple[int, int], int], components: int) -> Whitener:
        d = len(sums)
        v = np.empty((d, d))
        for i in range(d):
            for j in range(i, d):
                # Dividing two integers rounds once, however large they are.
                v[i, j] = v[j, i] = (n * products[i, j] - sums[i] * sums[j]) / (n * n)
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        # The sign is free; the largest entry is made positive, the same in every run.
        signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
        trace = float(np.trace(v))
        values = np.where(values > d * np.finfo(float).eps * trace, values, 0.0)
        return cls(n, sums, vectors * signs, values, trace)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; NaN where the eigenvalue is zero."""
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.array([s / self.n for s in self.sums])
            return np.where(self.values > 0, (x - mean) @ self.vectors / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of ``(n * x - S)^2``, exact."""
        top = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if top * top * max(1, x.shape[1]) < 2**63:
            apart = self.n * x - np.array(self.sums, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        apart = self.n * x.astype(object) - np.array(self.sums, object)
        return [int(v) for v in (apart * apart).sum(axis=1)]


def fit(distinct: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> dict[int, Whitener]:
    """A whitener for each length of the distinct packed vectors ``(dim, x)``.

    The moments, one number for each pair of dimensions, come to the driver.
    """
    schema = T.StructType([field("dim", "int"), field("i", "int"), field("j", "int"),
                           field("high", "decimal(38,0)"), field("low", "decimal(38,0)")])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _moments(batches, block, to_arrow_schema(schema))

    parts = map_arrow(distinct.select("dim", "x"), run, schema)
    rows = parts.groupBy("dim", "i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    found: dict[int, dict] = {}
    for r in rows:
        found.setdefault(r.dim, {})[r.i, r.j] = (int(r.high) << LOW_BITS) + int(r.low)
    return {
        dim: Whitener.of(m[-1, -1], [m[-1, j] for j in range(dim)], m, components) for dim, m in found.items()
    }


def _identity_errors(distinct: DataFrame, models: dict[int, Whitener], components: int) -> dict[int, float]:
    """Largest entry of the whitened distinct vectors' covariance minus the identity."""
    names = [f"w{i}" for i in range(components)]
    schema = T.StructType([field("dim", "int"), *[field(n, "double") for n in names]])

    def run(batches):
        for batch in batches:
            for dim, rows in _by_dim(batch):
                made = models[dim].whiten(np.stack([unpack(p) for p in rows]))
                made = np.pad(made, ((0, 0), (0, components - made.shape[1])), constant_values=np.nan)
                columns = [pa.array(c, pa.float64(), from_pandas=True) for c in made.T]
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(made), pa.int32()), *columns], ["dim", *names])

    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    apart = [F.abs(F.covar_pop(names[i], names[j]) - float(i == j)) for i, j in pairs]
    rows = map_arrow(distinct.select("dim", "x"), run, schema).groupBy("dim").agg(F.greatest(F.lit(None).cast("double"), *apart).alias("e"))
    return {r.dim: r.e for r in rows.collect()}


def _by_dim(batch: pa.RecordBatch):
    groups: dict[int, list[bytes]] = {}
    for dim, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        groups.setdefault(dim, []).append(packed)
    return groups.items()


def whiten(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, block: int = BLOCK
) -> DataFrame:
    """One row for each vector and component: ``id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    The fit takes each distinct integer vector once. Components are numbered from 1 by
    falling eigenvalue of the covariance. ``deviation`` is the exact squared distance
    of ``n * x`` from the sums, as decimal(38,0); null where it has more digits.

    Vectors that are null, empty, or hold a null or non-finite component have no row.
    Repeated rows and rows of one id, null ids too, are rows each. Vectors of another length are
    fitted for themselves, and a vector shorter than ``components`` has as many as it is
    long. Where all vectors are equal along a component, ``whitened`` is null and the
    component is left out of ``identity_error``; ``explained`` is null when the trace is
    zero. Integers beyond 2^53 stay there. An empty table gives no rows.
    """
    packed = T.StructType([T.StructField("id", vectors.schema[id].dataType), field("dim", "int"), field("x", "binary")])

    def pack_rows(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from packed_batches(batches, to_arrow_schema(packed))

    source = vectors.select(F.col(id).alias("id"), F.col(vector).alias("vector"))
    rows = staged(map_arrow(source, pack_rows, packed).where("dim > 0"), "integer-vectors")
    distinct = staged(rows.select("dim", "x").distinct(), "distinct-vectors")
    models = fit(distinct, components, block)
    errors = _identity_errors(distinct, models, components)
    schema = T.StructType(
        [T.StructField(id, vectors.schema[id].dataType), field("component", "int"), field("n", "bigint"),
         field("deviation", "decimal(38,0)"), field("whitened", "double"), field("explained", "double"),
         field("identity_error", "double")]
    )

    def project(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), object)
            dims = np.array(batch.column(1).to_pylist())
            packed_rows = batch.column(2).to_pylist()
            for dim in np.unique(dims):
                model = models[int(dim)]
                at = np.flatnonzero(dims == dim)
                x = np.stack([unpack(packed_rows[k]) for k in at])
                made, apart = model.whiten(x), model.deviations(x)
                c, error = made.shape[1], errors[int(dim)]
                shares = [float(v) / model.trace if model.trace > 0 else None for v in model.values]
                columns = (
                    [i for i in ids[at] for _ in range(c)],
                    np.tile(np.arange(1, c + 1, dtype=np.int32), len(at)),
                    np.full(len(at) * c, model.n),
                    [Decimal(v) if v < 10**38 else None for v in apart for _ in range(c)],
                    pa.array(made.ravel(), pa.float64(), from_pandas=True),
                    shares * len(at),
                    [error] * (len(at) * c),
                )
                arrays = [v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(columns, target, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return map_arrow(rows, project, schema)
