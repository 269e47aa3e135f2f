"""N-gram Jaccard join in the metric space of the documents' shingle sets.

``1 - Jaccard`` is a metric. Documents are assigned to regions around pivots, boundary
documents to several, and each region is joined exactly; a region too large for a task
is cut again by its documents' distance to the pivot.

In this space nearly all distances are 1, so plain Voronoi cells of random pivots
would need every document in every cell. Which pivots a document can be near to is
therefore found by signatures. Sets with ``J >= t`` and sizes ``a <= b`` differ in at
most ``k = (a + b)(1 - t)/(1 + t)`` shingles. The space of hashes is cut into more than
``k`` parts. If more than ``k`` parts of one set have shingles, one of these holds the
same of both; the digest of each such part is a key, and empty parts are none. A set
that fills ``k`` parts or fewer is cut into twice as many parts as well, until it fills
more: of two sets, the one that does so first has the other's keys of that cut too. The
number of parts follows a size class; a document that can be near one of the next class
has keys for that as well.

1. Documents of one key form a bucket. Its pivot is the document that shares the most
   keys with any others, the centre of most copies, and all its members belong to the
   pivot's region. Two documents that link share a key, so some region has both.
2. A region of bounded size is joined in one task, which counts the intersections of
   its sets exactly and returns the components of its links, not the pairs.
3. The documents of a larger region are first compared with their pivot alone. Those
   that link to it need no comparison with each other. By the triangle inequality,
   distances to the pivot of two that link differ by no more than ``1 - t``, so the
   others are cut into rings of that width and meet those of their own and the next
   ring only, two bounded blocks in a task.
4. A ring of more than a few blocks is a region again, with a pivot of its own, as long
   as that takes documents out of it. Only its meeting with the next ring stays one of
   blocks.

Buckets stream through the tasks in sorted order and are never collected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.llm.common import field, map_arrow, pieces, staged, strings
from hazegrid.llm.components import components
from hazegrid.llm.shingles import mix, shingle_set

#: Documents, and shingles, of a region or of two blocks that one task joins.
REGION_DOCS, REGION_SHINGLES = 4096, 3_000_000
#: Blocks of a ring that is not cut again, and how often a region is cut. What is left meets by blocks.
RING_BLOCKS, LEVELS = 4, 8
#: A pivot of its own that leaves more of a ring than this in one ring again is the last.
LEFT_IN_RING = 0.95
#: Ids (8 bytes each) up to which the documents to compare are found by broadcast.
BROADCAST_IDS = 1_000_000
#: Sets a task remembers to skip the keys of exact copies.
REMEMBERED = 200_000
STEP = 1.5


class SizeClasses:
    """``(first size, first size beyond, differences allowed, parts)`` of each class, as far as needed."""

    def __init__(self, percent: int):
        self.percent = percent
        self.classes: list[tuple[int, int, int, int]] = []
        self.low = math.ceil(percent / (100 - percent))

    def of(self, size: int) -> list[int]:
        """The class of a size, and the next one if a near set can be in it."""
        while self.low * self.percent <= size * 100:
            high = max(self.low + 1, math.ceil(self.low * STEP))
            # A class also has documents of the class before, so pairs have at most twice its largest size.
            k = 2 * (high - 1) * (100 - self.percent) // (100 + self.percent)
            self.classes.append((self.low, high, k, k + 2 + math.ceil(0.15 * k)))
            self.low = high
        return [
            i
            for i, (low, high, _, _) in enumerate(self.classes)
            if low <= size < high or size < low and low * self.percent <= size * 100
        ]


def keys_of(hashes: np.ndarray, classes: SizeClasses) -> tuple[np.ndarray, int]:
    """Keys of a set, and how many of them it shares at least with any that it links to.

    A key is the digest of a filled part of the set, for its size class and perhaps the
    next, and for each number of parts up to the first that it fills more than ``k`` of.
    Smaller sets than the first class link with equal ones only and have no key.
    """
    size, out, least = len(hashes), [], len(hashes)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes), dtype=np.uint64)))
    for number in classes.of(size):
        _, _, k, parts = classes.classes[number]
        first = None
        while True:
            cuts = (np.arange(1, parts, dtype=np.float64) / parts * 2.0**64).astype(np.uint64)
            bounds = np.concatenate(([0], np.searchsorted(hashes, cuts), [size]))
            filled = np.flatnonzero(bounds[1:] > bounds[:-1])
            digests = sums[bounds[filled + 1]] - sums[bounds[filled]]
            out.append(mix(digests + mix(filled.astype(np.uint64) + np.uint64((number << 40) + (parts << 20 if first is not None else 0)))))
            first = len(filled) if first is None else first
            # Distinct hashes are apart in some cut; a set has more of them than ``k``.
            if len(filled) > k or parts > 2**16 * (k + 1):
                break
            parts *= 2
        least = min(least, max(1, first - k))
    return np.concatenate(out) if out else np.empty(0, np.uint64), least


def _sizes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``id``, ``n``, the digest of its set and its least shared keys for every row.

    A row without shingles has no digest.
    """
    schema = T.StructType([docs.schema["id"], field("n", "bigint"), field("digest", "binary"), field("least", "int")])

    def run(batches):
        import hashlib

        from pyspark.sql.pandas.types import to_arrow_schema

        target, classes = to_arrow_schema(schema), SizeClasses(percent)
        for batch in batches:
            for part in pieces(batch):
                sets = [shingle_set(v, width) for v in strings(part, "text")]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                least = pa.array([keys_of(s, classes)[1] for s in sets], pa.int32())
                sizes = pa.array([len(s) for s in sets], pa.int64())
                columns = [part.column(0), sizes, pa.array(digests, pa.binary()), least]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return map_arrow(docs, run, schema)


def _keys(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``key, id`` for every key of a document; exact copies that meet in a task count once."""

    def run(batches):
        seen: set[bytes] = set()
        classes = SizeClasses(percent)
        for batch in batches:
            for part in pieces(batch, 128):
                keys, ids = [], []
                for id, text in zip(strings(part, "id"), strings(part, "text"), strict=True):
                    hashes = shingle_set(text, width)
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    copy = hashes[:8].tobytes() + mix(hashes).sum(dtype=np.uint64).tobytes()
                    if id is None or copy in seen:
                        continue
                    seen.add(copy)
                    made, _ = keys_of(hashes, classes)
                    keys.append(made.view(np.int64))
                    ids.append(np.full(len(made), id, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], names=["key", "id"]
                    )

    return map_arrow(docs, run, "key bigint, id bigint")


def _buckets(entries: DataFrame) -> DataFrame:
    """``key, id`` of buckets of two documents and more.

    A bucket's rows pass in the order of ``key, id``; only the last row of a batch is
    carried on.
    """

    def run(batches):
        before = held = None  # the key before the held row's, and the held row
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = (batch.column(i).to_numpy() for i in (0, 1))
            if held is not None:
                keys, ids = np.append(held[0], keys), np.append(held[1], ids)
            fresh = np.append(True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))
            keys, ids = keys[fresh], ids[fresh]
            near = keys[1:] == keys[:-1]
            shared = np.append(before is not None and keys[0] == before, near)
            shared[:-1] |= near
            if shared[:-1].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[:-1][shared[:-1]]) for x in (keys, ids)], names=["key", "id"]
                )
            if len(keys) > 1:
                before = keys[-2]
            held = keys[-1], ids[-1]
        if held is not None and before is not None and held[0] == before:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held], names=["key", "id"])

    # Sorted by a shuffle on the key alone, so that equal keys are in one task.
    dealt = entries.repartition(F.col("key")).sortWithinPartitions("key", "id")
    return map_arrow(dealt, run, "key bigint, id bigint")


def _few(df: DataFrame) -> DataFrame:
    """Broadcast a staged table of few rows of numbers; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def _regions(shared: DataFrame, least: DataFrame) -> DataFrame:
    """``pivot, id`` of the staged members (key, id) of buckets, without the pivots themselves.

    A document that shares fewer keys with all others than it would with one that it
    links to (``id, least``) is left out.
    """
    counted = shared.groupBy("id").agg(F.count(F.lit(1)).alias("shares")).join(least, "id")
    rank = F.col("shares") * 2**20 + F.expr(f"pmod(xxhash64(id), {2**20})")
    known = staged(counted.where("shares >= least").select("id", rank.alias("rank")), "jaccard-ranks")

    def run(batches):
        key = pivot = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = (batch.column(i).to_numpy() for i in (0, 1))
            fresh = np.concatenate(([keys[0] != key], keys[1:] != keys[:-1]))
            at = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), -1))
            pivots = np.where(at >= 0, ids[np.maximum(at, 0)], 0 if pivot is None else pivot)
            key, pivot = keys[-1], pivots[-1]
            pairs = np.unique(np.stack([pivots, ids], axis=1)[ids != pivots], axis=0)
            if len(pairs):
                columns = [pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["pivot", "id"])

    # A bucket's rows pass in order, its pivot first; only the last pivot is carried on.
    rated = shared.join(_few(known), "id").select("key", "id", "rank")
    dealt = rated.repartition(F.col("key")).sortWithinPartitions("key", F.desc("rank"), "id")
    return map_arrow(dealt, run, "pivot bigint, id bigint").distinct()


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``id, hashes, row``: the shingle sets of the rows with the staged distinct ``ids``, staged.

    ``row`` tells the sets of one id apart.
    """
    schema = T.StructType([field("id", "bigint"), field("hashes", "binary")])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for part in pieces(batch, 128):
                made = [shingle_set(v, width).tobytes() for v in strings(part, "text")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(strings(part, "id"), pa.int64()), pa.array(made, pa.binary())], schema=target
                )

    found = docs.join(_few(ids), "id", "left_semi").select("id", "text")
    return staged(map_arrow(found, run, schema).withColumn("row", F.xxhash64("hashes")), "jaccard-sets")


def _chosen(sets: DataFrame, listed: DataFrame) -> DataFrame:
    """The sets with the ids of ``listed`` (id, only): the set of that ``row``, or all if ``only`` is null."""
    return sets.join(listed, "id").where("only IS NULL OR only = row")


def _links(a: np.ndarray, b: np.ndarray, both, percent: int):
    union = a + b - both
    return (union > 0) & (100 * both >= percent * union)


def _to_pivots(members: DataFrame, centers: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``region, id, row, n, pivot, distance, linked`` of each set of the staged ``members``, staged.

    ``members`` and the pivots ``centers`` are ``region, id, only``. The documents of a
    region stream past its pivot's sets. A region of many is dealt to several tasks, each
    of which gets them.
    """
    counts = members.groupBy("region").agg(F.least(F.ceil(F.count(F.lit(1)) / 512), F.lit(4096)).alias("salts"))
    salted = members.join(counts, "region").withColumn("salt", F.expr("pmod(xxhash64(id, only), salts)"))
    left = _chosen(sets, salted).select("region", "salt", F.lit(1).alias("turn"), "id", "row", "hashes")
    right = _chosen(sets, centers.join(counts, "region")).select(
        "region", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"), F.lit(0).alias("turn"), "id", "row", "hashes"
    )
    names = ["region", "id", "row", "n", "pivot", "distance", "linked"]
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()

    def run(batches):
        group, own = None, []
        for batch in batches:
            out = [[] for _ in names]
            for region, salt, turn, id, row, hashes in zip(*(strings(batch, c) for c in batch.schema.names), strict=True):
                hashes = np.frombuffer(hashes, np.uint64)
                if (region, salt) != group:
                    group, own = (region, salt), []
                if turn == 0:
                    own.append((id, hashes))
                    continue
                for pivot, other in own:
                    both = len(np.intersect1d(hashes, other, assume_unique=True))
                    union = len(hashes) + len(other) - both
                    # A set without shingles, of an id that has others, is as far as can be.
                    distance = 1 - both / union if union else 1.0
                    made = region, id, row, len(hashes), pivot, distance, union > 0 and 100 * both >= percent * union
                    for column, v in zip(out, made, strict=True):
                        column.append(v)
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    dealt = left.union(right).repartition(F.col("region"), F.col("salt")).sortWithinPartitions("region", "salt", "turn")
    kind = "region bigint, id bigint, row bigint, n bigint, pivot bigint, distance double, linked boolean"
    return staged(map_arrow(dealt, run, kind), "jaccard-distances")


def join_block(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a bounded block that have links, and the smallest id of their component in it."""
    sizes = np.array([len(s) for s in sets], np.int64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    holders, counts = doc[order], np.bincount(token)
    starts = np.cumsum(counts) - counts
    label, linked = ids.copy(), np.zeros(len(ids), bool)
    at = 0
    for i, size in enumerate(sizes):
        own = token[at : at + size]
        at += size
        own = own[counts[own] > 1]
        if len(own) * 100 < percent * size or not size:
            continue  # too few of its shingles are anywhere else in the block
        reach = counts[own]
        flat = np.repeat(starts[own] - np.cumsum(reach) + reach, reach) + np.arange(reach.sum())
        both = np.bincount(holders[flat], minlength=len(ids))
        near = _links(sizes, size, both, percent)
        near[i] = False
        if near.any():
            near[i] = True
            linked |= near
            label[np.isin(label, label[near])] = label[near].min()
    return ids[linked], label[linked]


def _join_units(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of components in each unit of ``unit, id, hashes``; a unit's size is bounded."""

    def run(batches):
        unit, ids, sets = None, [], []

        def joined():
            if len(ids) < 2:
                return
            a, b = join_block(np.array(ids, np.int64), sets, percent)
            keep = a != b
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

        for batch in batches:
            for part in pieces(batch):
                for u, id, hashes in zip(*(strings(part, c) for c in ("unit", "id", "hashes")), strict=True):
                    if u != unit:
                        yield from joined()
                        unit, ids, sets = u, [], []
                    ids.append(id)
                    sets.append(np.frombuffer(hashes, np.uint64))
        yield from joined()

    dealt = rows.repartition(F.col("unit")).sortWithinPartitions("unit")
    return map_arrow(dealt, run, "a bigint, b bigint")


def jaccard_groups(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    width: int = 4,
    percent: int = 85,
    region_docs: int = REGION_DOCS,
    region_shingles: int = REGION_SHINGLES,
) -> DataFrame:
    """``id``, ``n_shingles`` and ``component_id`` for every row.

    A document's set holds its distinct ``width``-word shingles, or its whole sequence
    of words when that is shorter. Two documents link when
    ``100 * intersection >= percent * union``; a document without words links with
    nothing. ``component_id`` is the smallest id reachable by links, itself included.
    Rows of one id are one node that has the links of each; a null id takes no part and
    has a null component. Only ``id`` and ``text`` of the input are used.
    """
    docs = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    sizes = staged(_sizes(docs, width, percent), "jaccard-sizes")
    known = sizes.where("id IS NOT NULL AND digest IS NOT NULL")
    first = known.groupBy("digest").agg(F.min("id").alias("b"), F.max("id").alias("top")).where("b < top")
    copies = known.join(staged(first, "jaccard-copies"), "digest").where("id <> b").select(F.col("id").alias("a"), "b")

    # Regions: each pivot with the members of its buckets.
    shared = staged(_buckets(_keys(docs, width, percent)), "jaccard-buckets")
    least = known.groupBy("id").agg(F.min("least").alias("least"))
    pairs = staged(_regions(shared, least), "jaccard-regions")
    pivots = pairs.select("pivot", F.col("pivot").alias("id")).distinct()
    every = F.lit(None).cast("bigint").alias("only")
    n = known.groupBy("id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    members = staged(pairs.union(pivots).join(n, "id"), "jaccard-members")
    region = members.groupBy("pivot").agg(F.sum("rows").alias("docs"), F.sum("n").alias("shingles"))
    large = (F.col("docs") > region_docs) | (F.col("shingles") > region_shingles)
    region = staged(region.withColumn("large", large), "jaccard-sizes-of-regions")
    sets = _sets(docs, staged(members.select("id").distinct(), "jaccard-ids"), width)

    whole = members.join(region.where("NOT large").select("pivot"), "pivot", "left_semi")
    units = whole.select(F.xxhash64("pivot").alias("unit"), "id", every)
    crowded = members.join(region.where("large").select("pivot"), "pivot", "left_semi")
    crowded = staged(crowded.select(F.col("pivot").alias("region"), "id", every), "jaccard-crowded")
    centers = region.where("large").select(F.col("pivot").alias("region"), F.col("pivot").alias("id"), every)
    links = copies
    for level in range(LEVELS):
        near = _to_pivots(crowded, centers, sets, percent)
        links = links.union(near.where("linked AND id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")))
        made, left = _ring_units(near, percent, region_docs, region_shingles, level)
        units = units.union(made)
        if left is None:
            break
        crowded = staged(left, "jaccard-crowded")
        own = F.min_by(F.struct("id", "only"), F.xxhash64("id", "only")).alias("own")
        centers = staged(crowded.groupBy("region").agg(own).select("region", "own.*"), "jaccard-centers")
    units = staged(units, "jaccard-units")
    inner = _join_units(_chosen(sets, _few(units)).select("unit", "id", "hashes"), percent)

    groups = components(links.union(inner))
    return sizes.join(groups, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def _ring_units(
    near: DataFrame, percent: int, region_docs: int, region_shingles: int, level: int
) -> tuple[DataFrame, DataFrame | None]:
    """``unit, id, only`` of pairs of blocks in the rings of large regions, and ``region, id, only`` of rings to cut again.

    Ring 0 holds what links to the pivot. A set outside of it has the ring of its
    distance, to the nearest one where the pivot has several.
    """
    step = (100 - percent) / 100 + 1e-9
    ring = F.when(F.max("linked"), 0).otherwise(F.greatest(F.floor(F.min("distance") / step), F.lit(1)))
    placed = near.groupBy("region", "id", "row").agg(
        ring.cast("int").alias("ring"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")
    )
    blocks = placed.groupBy("region", "ring").agg(
        F.ceil(F.greatest(F.sum("rows") * 2 / region_docs, F.sum("n") * 2 / region_shingles)).cast("int").alias("parts"),
        F.sum("rows").alias("rows"),
    )
    # The first pivot was chosen for its whole region; one of the ring's own may take more out of it.
    share = F.col("rows") / F.sum("rows").over(Window.partitionBy("region"))  # one row a ring
    again = (F.col("ring") > 0) & (F.col("parts") > RING_BLOCKS) & (F.lit(level == 0) | (share <= LEFT_IN_RING))
    blocks = staged(blocks.withColumn("again", again & F.lit(level + 1 < LEVELS)).drop("rows"), "jaccard-rings")
    placed = placed.join(blocks, ["region", "ring"]).withColumn("part", F.expr("pmod(xxhash64(id, row), parts)"))
    every = blocks.select("region", "ring", "again", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    ahead = every.withColumn("to", F.explode(F.array(F.col("ring"), F.col("ring") + 1)))
    others = every.select("region", F.col("ring").alias("to"), F.col("part").alias("to_part"))
    met = ahead.join(others, ["region", "to"]).where("to > 0 AND (ring < to OR part <= to_part AND NOT again)")
    met = met.withColumn("unit", F.xxhash64("region", "ring", "part", "to", "to_part"))
    sides = met.select("region", "ring", "part", "unit").union(
        met.where("ring <> to OR part <> to_part").select("region", F.col("to").alias("ring"), F.col("to_part").alias("part"), "unit")
    )
    only = F.col("row").alias("only")
    units = placed.join(sides, ["region", "ring", "part"]).select("unit", "id", only)
    if blocks.where("again").isEmpty():
        return units, None
    return units, placed.where("again").select(F.xxhash64("region", "ring").alias("region"), "id", only)


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without all but one document of each group, the one with the smallest id.

    Documents with a null id or without words take no part and stay. Rows that share an id
    are documents each: those whose texts link to no other stay, of equal ones one stays.
    """
    key = F.col(id).cast("bigint")
    known = docs.where(key.isNotNull())
    repeated = staged(known.groupBy(key.alias("__id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "jaccard-repeated")
    top = None if repeated.isEmpty() else known.agg(F.max(key)).first()[0]
    if top is None:
        groups = jaccard_groups(known, id, text, width, percent)
        dropped = groups.where(F.col("component_id") != F.col(id).cast("bigint")).select(F.col(id).cast("bigint").alias("__drop"))
        return docs.join(_few(staged(dropped, "jaccard-dropped")), key == F.col("__drop"), "left_anti")
    # Rows of a repeated id are numbered beyond all ids, and written so that they keep their numbers.
    again = docs.join(_few(repeated.select("__id")), key == F.col("__id"), "left_semi")
    again = staged(again.withColumn("__node", F.monotonically_increasing_id() + F.lit(max(top, 0) + 1)), "jaccard-rows")
    single = docs.join(_few(repeated.select("__id")), key == F.col("__id"), "left_anti").withColumn("__node", key)
    every = single.unionByName(again)
    nodes = every.where(F.col("__node").isNotNull()).select("__node", text)
    groups = jaccard_groups(nodes, "__node", text, width, percent)
    owner = again.select("__node", key.alias("__own"))
    owned = staged(groups.join(owner, "__node", "left").select("__node", "component_id", F.coalesce("__own", "__node").alias("__own")), "jaccard-groups")
    kept = owned.groupBy("component_id").agg(F.min(F.struct("__own", "__node")).alias("kept"))
    dropped = owned.join(kept, "component_id").where(F.col("kept.__node") != F.col("__node")).select(F.col("__node").alias("__drop"))
    left = every.join(_few(staged(dropped, "jaccard-dropped")), F.col("__node") == F.col("__drop"), "left_anti")
    return left.select(*docs.columns)
