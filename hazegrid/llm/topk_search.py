"""Exact top-k search by inner product, with no random access to the lists.

Vectors are integers ``x = floor(256 * c)``. Candidates stay where they lie: each task
cuts its rows into blocks and sorts, for every dimension, a list of the block's entries.
A query reads all lists together, best contributions first, to the same depth. What it
has not read of a candidate lies between the list's last entry and the last one read,
which gives a lower and an upper bound of its score. Reading stops when no candidate
outside the survivors can reach the k-th lower bound (or the k-th score that the task
has from earlier blocks); then only the survivors' entries are taken from the rest of
the lists, in order, which makes their scores exact.

Queries are taken in blocks of a fixed number of entries. A block is sent to all
executors and meets every candidate in one job; the best ``k`` of each task are merged by
a shuffle on the query. Neither queries nor pairs ever meet as a whole.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.llm.common import field, map_arrow, staged
from hazegrid.llm.fixed_point import packed_batches, unpack

K = 5
#: Rows of a candidate block.
BLOCK = 4096
#: Entries of a query block, 8 bytes each at most.
QUERY_ENTRIES = 2_000_000
#: Depth of the first reading, as a share of the block, and how much deeper each next one reaches.
FIRST, STEP = 0.25, 0.125


class Lists:
    """One block's sorted lists: for each dimension the entries in rising order, and whose they are.

    A query reads a list from its end where its own entry is positive, from its start
    where that is negative, and not at all where it is zero.
    """

    def __init__(self, ids: list, x: np.ndarray):
        self.n, self.dim = x.shape
        self.ids = ids
        # Equal scores go to the smaller id, so ranks stand for ids; null comes last.
        order = sorted(range(self.n), key=lambda k: (ids[k] is None, ids[k]))
        self.rank = np.empty(self.n, np.int64)
        self.rank[order] = np.arange(self.n)
        self.owner = np.argsort(x, axis=0, kind="stable").T.copy()
        self.place = np.empty((self.dim, self.n), np.int32)
        np.put_along_axis(self.place, self.owner, np.arange(self.n, dtype=np.int32)[None], axis=1)
        self.entry = np.take_along_axis(x.T, self.owner, axis=1)
        self.most = int(np.abs(x).max(initial=0))
        self.doubles = self.entry.astype(np.float64)
        self.held: dict = {}
        for k, key in enumerate(ids):
            self.held.setdefault(key, []).append(k)

    def read(self, sides, first: int, last: int):
        """Owners and contributions above the list's worst, from depth ``first`` to ``last``, side by side."""
        for lists, query, worst, up in sides:
            part = slice(self.n - last, self.n - first) if up else slice(first, last)
            entry = self.doubles if query.dtype == np.float64 else self.entry
            yield self.owner[lists, part], (entry[lists, part] - worst) * query

    def search(self, query: np.ndarray, own, k: int, floor=None) -> list[tuple[int, int]]:
        """``(score, position)`` of the best ``k`` candidates, of those with at least ``floor``.

        Candidates whose id is ``own`` take no part.
        """
        n = self.n
        exact = self.dim * max(1, self.most) * max(1, int(np.abs(query).max(initial=0))) < 2**52
        # Doubles hold these integers exactly; larger ones are Python's.
        kind = np.float64 if exact else object
        entry = self.doubles if exact else self.entry
        sides = []
        for up, lists in ((True, np.flatnonzero(query > 0)), (False, np.flatnonzero(query < 0))):
            worst = entry[lists, 0 if up else n - 1].astype(kind)[:, None]
            sides.append((lists, query[lists, None].astype(kind), worst, up))
        base = sum((worst * part).sum() for _, part, worst, _ in sides)
        read = np.zeros(n, kind)  # what was read of each candidate, above the worst
        out = np.zeros(n, bool)
        out[self.held.get(own, [])] = own is not None
        free = n - int(out.sum())
        depth, cut, alive = 0, floor, ~out
        while depth < n:
            first, depth = depth, min(n, depth + max(1, int(n * (STEP if depth else FIRST))))
            for owners, gains in self.read(sides, first, depth):
                if exact:
                    read += np.bincount(owners.ravel(), gains.ravel(), n)
                else:
                    np.add.at(read, owners.ravel(), gains.ravel())
            if depth == n:
                break
            if free >= k:
                low = read[~out]
                kth = (np.partition(low, free - k) if exact else np.sort(low))[free - k] + base
                cut = kth if cut is None else max(cut, kth)
            if cut is None:
                continue
            high = read + base
            for lists, part, worst, up in sides:
                # Unread entries give no more than the last one read of their list.
                edge = n - depth if up else depth - 1
                more = ((entry[lists, edge].astype(kind)[:, None] - worst) * part)[:, 0]
                unread = self.place[lists] < n - depth if up else self.place[lists] >= depth
                high = high + more @ unread.astype(kind)
            alive = ~out & (high >= cut)
            if alive.sum() <= max(4 * k, n // 64):
                break
        kept = np.flatnonzero(alive)
        if not len(kept):
            return []
        if depth < n:
            for owners, gains in self.read(sides, depth, n):
                rest = alive[owners]
                np.add.at(read, owners[rest], gains[rest])
        scores = [int(s) for s in read[kept] + base]
        best = sorted(zip((-s for s in scores), self.rank[kept].tolist(), kept.tolist(), strict=True))[:k]
        return [(-s, p) for s, _, p in best if floor is None or -s >= floor]


def _best(batches, queries, k: int, block: int, target: pa.Schema):
    """The best ``k`` of this task's rows for each query, over its blocks."""
    waiting: dict[int, tuple[list, list]] = {}
    best: list[list[tuple]] = [[] for _ in queries]

    def meet(dim):
        ids, rows = waiting.pop(dim)
        lists = Lists(ids, np.stack([unpack(b) for b in rows]))
        for q, (own, packed) in enumerate(queries):
            query = unpack(packed)
            if len(query) != dim:
                continue
            top = best[q]
            found = lists.search(query, own, k, -top[-1][0] if len(top) == k else None)
            if found:
                merged = [*top, *((-s, lists.ids[p] is None, lists.ids[p]) for s, p in found)]
                best[q] = sorted(merged)[:k]

    for batch in batches:
        for key, dim, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids, rows = waiting.setdefault(dim, ([], []))
            ids.append(key)
            rows.append(packed)
            if len(ids) == block:
                meet(dim)
    for dim in list(waiting):
        meet(dim)
    for at in range(0, len(best), 4096):
        rows = [(q, queries[q][0], Decimal(-s), key) for q in range(at, min(at + 4096, len(best))) for s, _, key in best[q]]
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    id: str = "vec_id",
    vector: str = "embedding",
    block: int = BLOCK,
    query_entries: int = QUERY_ENTRIES,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``id`` and ``score`` of the ``k`` best rows of ``vectors`` for each row of ``queries``.

    The score is the inner product of the integer vectors, exact, as decimal(38,0); equal
    scores go to the smaller id, a null id after all others. A row is no candidate for a
    query of the same id. Ids are integers, or of another type that Python orders and that is not mixed.

    Vectors that are null or hold a null or non-finite component are neither queries nor
    candidates; candidates of another length than the query's are passed over, and an empty
    vector is a vector of its length, with score 0. Rows with a null id are candidates, and as queries
    have no row of their own. Repeated rows, and rows of one id, are candidates each, and queries each, whose
    results stand side by side. Integers beyond 2^53 stay there. Fewer candidates than
    ``k`` give fewer rows; empty tables give none.
    """
    kind = vectors.schema[id].dataType
    packed = T.StructType([T.StructField("id", kind), field("dim", "int"), field("x", "binary")])
    found = T.StructType([field("q", "int"), T.StructField("query_id", kind), field("score", "decimal(38,0)"), T.StructField("id", kind)])

    def pack_rows(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from packed_batches(batches, to_arrow_schema(packed))

    def integer_rows(df):
        return map_arrow(df.select(F.col(id).alias("id"), F.col(vector).alias("vector")), pack_rows, packed)

    spark = vectors.sparkSession
    rows = staged(integer_rows(vectors), "integer-vectors")
    # A query's place in its file deals out equal rows too; it is written, so that it never changes.
    dealt = F.xxhash64("id", "x", F.monotonically_increasing_id())
    asked = staged(integer_rows(queries).withColumn("dealt", dealt), "integer-queries")
    entries = asked.agg(F.sum(F.greatest("dim", F.lit(1)))).first()[0] or 0
    parts = -(-entries // query_entries)
    made = []
    for part in range(parts):
        mine = asked.where(F.pmod("dealt", F.lit(parts)) == part).select("id", "x")
        sent = spark.sparkContext.broadcast([(r.id, bytes(r.x)) for r in mine.collect()])

        def run(batches, sent=sent):
            from pyspark.sql.pandas.types import to_arrow_schema

            yield from _best(batches, sent.value, k, block, to_arrow_schema(found))

        first = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        merged = map_arrow(rows, run, found).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        made.append(staged(merged.select("query_id", "rank", F.col("id").alias(id), "score"), "best-rows"))
        sent.unpersist()
    if made:
        return reduce(DataFrame.union, made)
    out = [T.StructField("query_id", kind), field("rank", "int"), T.StructField(id, kind), field("score", "decimal(38,0)")]
    return spark.createDataFrame([], T.StructType(out))
