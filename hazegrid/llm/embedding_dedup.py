"""Embedding near-dedup by counting collisions of one-dimensional projections.

Vectors are scaled to length one. Two of them with cosine ``t`` are ``sqrt(2 - 2t)``
apart, and their projections on a direction differ by less. Many random directions
are sorted; a pair collides in one when the other value lies in the window around
the query's. A pair within the distance collides in each with a known probability,
so the count of collisions that it reaches but for a chance of ``MISS`` can be worked
out beforehand. Pairs that reach it are verified by their cosine in double precision.

Not every pair is counted. Classes of equal vectors are dealt to cells by the projections
on a few further directions, cut at randomly shifted bounds, in several tables, each
with directions and shifts of its own. Near vectors share a cell of some table
but for a chance of ``LOST``; others hardly ever do, since the number of
directions and tables follows the size and the spread of each label. A small label is one cell. A pair
that shares several cells counts in the first table only, so nothing counts twice.

Projections for the cells are sums of integers, exact in doubles, so every task finds the
same cells. Small cells are packed into pieces of bounded size, a large one is cut into
blocks that meet by two. A piece returns for each class the weight of its links and the
root of its components, never the pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.llm.common import field, map_arrow, pieces, staged, strings
from hazegrid.llm.components import components
from hazegrid.llm.shingles import mix

THRESHOLD = 0.98
DIRECTIONS = 32
#: Share of pairs at the threshold that may fall below the count.
MISS = 1e-7
#: A window holds this share of the differences of pairs at the threshold.
WINDOW_SHARE = 0.955
#: Share of pairs at the threshold that may share no cell of any table.
LOST = 1e-4
#: Width of a cell, in standard deviations of what a pair at the threshold differs by on a direction.
CELL = 8.0
#: Most directions of a table.
MOST_KEYS = 24
BLOCK = 2048
#: Window entries that a piece counts at once.
ENTRIES = 4_000_000
SEED = 20_240_229
#: Integers that stand for 1 where cells are found: products of unit vectors stay below 2^53.
ONE = 2**25


@lru_cache(8)
def directions(dim: int, n: int) -> np.ndarray:
    """Random unit vectors, the same in every task."""
    drawn = np.random.default_rng([SEED, dim]).normal(size=(n, dim))
    return drawn / np.linalg.norm(drawn, axis=1, keepdims=True)


@lru_cache(8)
def calibrated(dim: int, distance: float, n: int, share: float = WINDOW_SHARE, miss: float = MISS) -> tuple[float, int]:
    """Half width of the windows, and the count that a pair at ``distance`` reaches but for ``miss``."""
    # A unit vector's first coordinate, squared, is beta(1/2, (dim - 1)/2).
    squared = np.random.default_rng([SEED, dim, 1]).beta(0.5, (dim - 1) / 2, 400_000) if dim > 1 else np.ones(1)
    width = distance * float(np.sqrt(np.quantile(squared, share)))
    tail, need = 0.0, 0
    for hits in range(n + 1):
        tail += math.comb(n, hits) * share**hits * (1 - share) ** (n - hits)
        if tail > miss:
            break
        need = hits + 1
    return width, need


def same_cell(spread: float) -> float:
    """Chance that two values whose difference has this standard deviation, in widths of a cell, share one."""
    if not spread:
        return 1.0
    inner = math.erf(1 / (spread * math.sqrt(2)))
    return inner - spread * math.sqrt(2 / math.pi) * (1 - math.exp(-1 / (2 * spread * spread)))


NEAR = same_cell(1 / CELL)
#: Tables that lose no more than ``LOST`` of the near pairs, by the directions of a table.
TABLES = [1] + [math.ceil(math.log(LOST) / math.log1p(-(NEAR**k))) for k in range(1, MOST_KEYS + 1)]


def _plan(n: str, far: str) -> str:
    """SQL of the directions and tables of a label with ``n`` classes, of which two share a cell by chance ``far``.

    It weighs a row's keys, the rows that have company in a cell and are sent with their
    vectors, and the comparisons there.
    """
    choices = []
    for k, tables in enumerate(TABLES):
        met = f"{n} * pow({far}, {k})"
        choices.append(f"named_struct('cost', {tables} * (1 + 8 * least(1, {met}) + {met} / 100), 'keys', {k}, 'tables', {tables})")
    return f"array_min(array({', '.join(choices)}))"


@lru_cache(4)
def _cells_of(dim: int, distance: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Integer directions and shifts of the tables, and the width of a cell."""
    rng = np.random.default_rng([SEED, dim, 2])
    width = max(1, int(CELL * distance / math.sqrt(dim) * ONE * ONE))
    most = max(t * k for k, t in enumerate(TABLES))
    lines = rng.normal(size=(most, dim))
    lines = np.rint(lines / np.linalg.norm(lines, axis=1, keepdims=True) * ONE)
    return lines, rng.integers(0, width, most), width


def cells(vecs: np.ndarray, distance: float, keys: int, tables: int) -> np.ndarray:
    """Hash of each vector's cell in each table."""
    if not keys:
        return np.zeros((len(vecs), tables), np.int64)
    lines, shifts, width = _cells_of(vecs.shape[1], distance)
    used = keys * tables
    # Both sides are integers, and no partial sum reaches 2^53: exact in any order.
    ahead = (np.rint(vecs * ONE) @ lines[:used].T).astype(np.int64) + shifts[:used]
    steps = (ahead // width).reshape(len(vecs), tables, keys).astype(np.uint64)
    out = np.zeros((len(vecs), tables), np.uint64)
    for k in range(keys):
        out = mix(out * np.uint64(3) + steps[:, :, k])
    return out.view(np.int64)


def _classes(vectors: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """Valid rows: ``id``, ``label``, ``dim``, the scaled vector as bytes, and its first coordinate on a direction."""
    schema = T.StructType(
        [T.StructField("id", vectors.schema[id].dataType), T.StructField("label", vectors.schema[label].dataType),
         field("dim", "int"), field("vec", "binary"), field("seen", "double")]
    )

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for part in pieces(batch):
                rows = [], [], [], [], []
                for key, lab, values in zip(*(strings(part, c) for c in ("id", "label", "vector")), strict=True):
                    if values is None or not values or any(v is None for v in values):
                        continue
                    values = np.asarray(values, np.float64)
                    top = np.abs(values).max()
                    if not np.isfinite(values).all() or top == 0:
                        continue
                    values = values / top
                    values = values / np.linalg.norm(values)
                    made = key, lab, len(values), values.tobytes(), float(values @ directions(len(values), DIRECTIONS)[0])
                    for column, v in zip(rows, made, strict=True):
                        column.append(v)
                arrays = [pa.array(c, t.type) for c, t in zip(rows, target, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    rows = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    return map_arrow(rows.where("id IS NOT NULL AND label IS NOT NULL"), run, schema)


def _planned(classes: DataFrame, gap: float) -> DataFrame:
    """``keys`` and ``tables`` for each label and length of vector, from the number and spread of its classes."""
    spread = F.coalesce(F.stddev_pop("seen"), F.lit(0.0))
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"), spread.alias("spread"))
    width = F.lit(CELL * gap) / F.sqrt("dim")
    # Cells per standard deviation; an upper bound of the chance, since more keys only cost.
    far = F.least(F.lit(0.95), width / (2 * math.sqrt(math.pi) * F.greatest("spread", F.lit(1e-9))))
    plan = sizes.withColumn("far", far).withColumn("plan", F.expr(_plan("n", "far")))
    return plan.select("label", "dim", "plan.keys", "plan.tables")


def _members(classes: DataFrame, gap: float) -> DataFrame:
    """``number``, ``label``, ``dim``, ``keys``, ``tables``, ``turn`` (the table), ``cell``, ``size`` of the classes in cells of two and more, staged."""
    label = classes.schema["label"]
    planned = classes.join(_planned(classes, gap), ["label", "dim"])
    schema = T.StructType([field("number", "bigint"), label, field("dim", "int"), field("keys", "int"), field("tables", "int"),
                           field("turn", "int"), field("cell", "bigint")])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for part in pieces(batch):
                shape = [part.column(c).to_numpy() for c in ("dim", "keys", "tables")]
                for dim, keys, tables in np.unique(np.stack(shape, axis=1), axis=0):
                    at = np.flatnonzero((shape[0] == dim) & (shape[1] == keys) & (shape[2] == tables))
                    some = part.take(pa.array(at))
                    vecs = np.frombuffer(b"".join(some.column("vec").to_pylist()), np.float64).reshape(-1, dim)
                    found = cells(vecs, gap, int(keys), int(tables))
                    rows = pa.array(np.repeat(np.arange(len(at)), tables))
                    columns = [some.column(c).take(rows) for c in ("number", "label", "dim", "keys", "tables")]
                    columns += [pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), pa.array(found.ravel())]
                    columns = [c.cast(f.type) for c, f in zip(columns, target, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=target)

    entries = staged(map_arrow(planned.select("number", "label", "dim", "keys", "tables", "vec"), run, schema), "vector-cells")
    where = ["label", "dim", "turn", "cell"]
    crowded = entries.groupBy(*where).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return staged(entries.join(crowded, where), "vector-members")


def _pieces(members: DataFrame, block: int) -> DataFrame:
    """The members with what makes up a piece of work: ``pack`` of small cells, or ``cut`` (two blocks of one) and ``second``."""
    packs = max(1, -(-members.count() // block))
    cell = F.struct("label", "turn", "cell")
    whole = members.where(f"size <= {block}").select(
        "*", F.pmod(F.xxhash64("label", "dim", "turn", "cell"), F.lit(packs)).alias("pack"),
        F.lit(None).cast("struct<low:int,high:int>").alias("cut"), F.when(F.lit(False), cell).alias("of"), F.lit(False).alias("second"),
    )
    parts = F.ceil(F.col("size") / block).cast("int")
    large = members.where(f"size > {block}").withColumn("part", F.pmod(F.xxhash64("number"), parts).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cut = F.struct(F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    return whole.union(
        large.select(*members.columns, F.lit(None).cast("bigint").alias("pack"), cut.alias("cut"), cell.alias("of"), (F.col("part") > F.col("other")).alias("second"))
    )


def _counted(queries: np.ndarray, others: np.ndarray, width: float, need: int, same: bool):
    """Pairs (query, other) that collide in at least ``need`` of the directions, a run of queries at a time.

    Rows are projections, a column for each direction.
    """
    n, m = len(queries), len(others)
    order = np.argsort(others, axis=0, kind="stable")
    ranked = np.take_along_axis(others, order, axis=0)
    lows = np.stack([np.searchsorted(ranked[:, i], queries[:, i] - width, "left") for i in range(queries.shape[1])])
    highs = np.stack([np.searchsorted(ranked[:, i], queries[:, i] + width, "right") for i in range(queries.shape[1])])
    step = max(1, ENTRIES // m)
    for at in range(0, n, step):
        rows = np.arange(at, min(at + step, n))
        codes = []
        for i in range(queries.shape[1]):
            reach = highs[i, rows] - lows[i, rows]
            # Positions in the sorted list, window after window.
            flat = np.arange(reach.sum()) + np.repeat(lows[i, rows] - np.cumsum(reach) + reach, reach)
            codes.append(np.repeat((rows - at) * m, reach) + order[flat, i])
        if sum(map(len, codes)) < len(rows) * m // 4:
            code, count = np.unique(np.concatenate(codes), return_counts=True)
            code = code[count >= need]
        else:
            counts = np.zeros(len(rows) * m, np.uint8)
            for c in codes:
                counts[c] += 1  # an other is once in a window
            code = np.flatnonzero(counts >= need)
        a, b = code // m + at, code % m
        if same:
            a, b = a[b > a], b[b > a]
        yield a, b


def _piece(vecs: np.ndarray, cell: np.ndarray, second: np.ndarray, threshold: float, n: int):
    """Pairs of rows of one cell, with a cosine of ``threshold`` and more, found by counting collisions.

    If any row is ``second``, those meet the others only.
    """
    dim = vecs.shape[1]
    width, need = calibrated(dim, math.sqrt(2 - 2 * threshold), n)
    # Cells lie so far apart on every direction that no window reaches another one.
    placed = vecs @ directions(dim, n).T + 2 * (2 + width) * cell[:, None]
    first, other = np.flatnonzero(~second), np.flatnonzero(second)
    same = not len(other)
    if same:
        other = first
    left, right = [], []
    for a, b in _counted(placed[first], placed[other], width, need, same):
        a, b = first[a], other[b]
        for at in range(0, len(a), 65_536):
            x, y = a[at : at + 65_536], b[at : at + 65_536]
            near = np.einsum("ij,ij->i", vecs[x], vecs[y]) >= threshold
            left.append(x[near])
            right.append(y[near])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _first_met(vecs: np.ndarray, left: np.ndarray, right: np.ndarray, turn: np.ndarray, plan: np.ndarray, gap: float) -> np.ndarray:
    """Which pairs share no cell of a table before the one that they are in."""
    fresh = np.ones(len(left), bool)
    for keys, tables in np.unique(plan[left], axis=0):
        at = np.flatnonzero((plan[left] == (keys, tables)).all(axis=1) & (turn[left] > 0))
        if len(at):
            rows, place = np.unique(np.concatenate([left[at], right[at]]), return_inverse=True)
            found = cells(vecs[rows], gap, int(keys), int(tables))
            a, b = place[: len(at)], place[len(at) :]
            for some in range(0, len(at), 65_536):
                part = slice(some, some + 65_536)
                shared = found[a[part]] == found[b[part]]
                fresh[at[part]] = shared.argmax(axis=1) == turn[left[at[part]]]
    return fresh


def near_vectors(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    n_directions: int = DIRECTIONS,
    block: int = BLOCK,
) -> DataFrame:
    """``id``, ``n_links`` and ``component_id`` for every row.

    Rows link when their labels are equal and their cosine is at least ``threshold``;
    a pair at the threshold is missed with a chance of ``LOST``, a nearer one with less,
    equal vectors never.
    A null label, and a vector that is null, empty, zero or has a null or non-finite
    component, links with nothing; neither do vectors of different length. A row with
    a null id has no links and a null component. Rows of one id are vectors each, and
    one node of the components.
    """
    gap = math.sqrt(2 - 2 * threshold)
    rows = staged(_classes(vectors, id, vector, label), "vectors")
    key = ["label", "dim", "vec"]
    found = rows.groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("seen").alias("seen"))
    classes = staged(found.withColumn("number", F.monotonically_increasing_id()), "vector-classes")
    members = _members(classes, gap)
    work = _pieces(members, block).join(classes.select("number", "rep", "weight", "vec"), "number")

    def compare(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        ids, weights = group.column("rep").to_numpy(), group.column("weight").to_numpy()
        vecs = np.frombuffer(b"".join(group.column("vec").to_pylist()), np.float64).reshape(-1, dim)
        turn = group.column("turn").to_numpy()
        labels = group.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        _, cell = np.unique(np.stack([labels, turn, group.column("cell").to_numpy()], axis=1), axis=0, return_inverse=True)
        second = group.column("second").to_numpy(zero_copy_only=False)
        left, right = _piece(vecs, cell.ravel(), second, threshold, n_directions)
        plan = np.stack([group.column(c).to_numpy() for c in ("keys", "tables")], axis=1)
        fresh = _first_met(vecs, left, right, turn, plan, gap)
        left, right = left[fresh], right[fresh]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, left, weights[right])
        np.add.at(links, right, weights[left])
        root = ids.copy()
        while len(left):
            low = np.minimum(root[left], root[right])
            before = root.copy()
            np.minimum.at(root, left, low)
            np.minimum.at(root, right, low)
            if (root == before).all():
                break
        linked = np.zeros(len(ids), bool)
        linked[left] = linked[right] = True
        numbers = group.column("number").to_numpy()
        return pa.table({"number": numbers[linked], "rep": ids[linked], "links": links[linked], "root": root[linked]})

    kind = "number bigint, rep bigint, links bigint, root bigint"
    met = staged(work.groupBy("dim", "pack", "of", "cut").applyInArrow(compare, kind), "vector-links")
    degree = met.groupBy("number").agg(F.sum("links").alias("links"))
    named = classes.join(degree, "number", "left").select(*key, "rep", "weight", F.coalesce("links", F.lit(0)).alias("links"))
    copies = staged(rows.join(named, key).select("id", "rep", "weight", "links"), "vector-copies")
    edges = met.select(F.col("rep").alias("a"), F.col("root").alias("b"))
    edges = edges.union(copies.where("id <> rep").select("id", "rep"))
    groups = components(edges)
    linked = copies.select("id", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    valid = linked.join(groups, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias(id), "n_links", F.coalesce("component", "id").alias("component_id")
    )
    counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("good"))
    every = vectors.groupBy(F.col(id).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    left = every.join(counts, "id", "left").select("id", F.expr("n - coalesce(good, 0)").alias("rest")).where("rest > 0")
    alone = left.join(groups, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias(id), F.lit(0).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component_id"),
        F.explode(F.expr("sequence(1, rest)")).alias("k"),
    )
    return valid.unionByName(alone.drop("k"))
