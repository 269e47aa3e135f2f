"""Removal of repeated byte strings by a sparse suffix order with a difference cover.

Every byte inside a string of ``length`` bytes that also starts anywhere else goes.
Strings never cross documents.

*Names.* The suffix at a position is known by the names of its first 3, 9, 27 and 81
bytes: the name of a width is that of the triple of names of a third of it, and three
overlapping names of 81 make the name of a whole string. Names are 64-bit hashes
instead of ranks. They need no global sort on each level, and since the length of the
strings is bounded, the recursion ends there.

*Sampled suffixes.* Of the 27-byte names in each string the smallest, leftmost one is
its anchor. Two equal strings have their anchor at the same offset, so the anchors are
a difference cover, chosen by content and not by residues: one position in ninety, not
two in three. An anchor stands for the run of strings that it is the anchor of.

1. Anchors are sorted by (27-byte name, name of their whole run). Adjacent equal ones
   settle their runs: all strings in them repeat. A 27-byte name that occurs once
   settles its run as well: none of them does.
2. The rest lie at the edges of repeated passages. Only a run that shares a half of a
   string to one side of the anchor with another one can still have a repeated
   string. The remaining suffixes, the strings of such runs, are merged by their
   name, and adjacent ones are compared.

Equal texts are one text with a count. Sorted rows stream through the tasks, and a
name that is very frequent is never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.llm.common import add_columns, field, map_arrow, pieces, small, staged, strings
from hazegrid.llm.shingles import mix

LENGTH = 200
GRAM = 27
#: Texts a task remembers to skip exact copies.
REMEMBERED = 500_000
#: Anchors that a task folds at once, 40 bytes each.
HELD_ANCHORS = 1_000_000

_RNG = np.random.default_rng(104_729)
_BYTE = _RNG.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _triples(names: np.ndarray, step: int, gap: int | None = None, count: int | None = None) -> np.ndarray:
    """Name of each triple of names that lie ``step`` (and then ``gap``) apart."""
    last = step + (gap or step)
    count = len(names) - last if count is None else count
    out = names[:count] * _A
    out += names[step : step + count] * _B
    out ^= out >> np.uint64(29)
    out += names[last : last + count]
    out *= _C
    out ^= out >> np.uint64(32)
    return out


class Names:
    """Names of all 27-byte strings and of all strings of ``length`` bytes of one text."""

    def __init__(self, text: str, length: int):
        data = np.frombuffer(text.encode(), np.uint8)
        names = _BYTE[data]
        for width in (1, 3, 9):
            names = _triples(names, width)
        self.grams = names
        wide = _triples(names, GRAM)
        self.wide = wide
        count = len(data) - length + 1
        middle = (length - 3 * GRAM) // 2
        self.strings = mix(_triples(wide, middle, length - 3 * GRAM - middle, count))


def anchors(grams: np.ndarray, count: int, window: int) -> np.ndarray:
    """For each of ``count`` strings the place of the smallest, leftmost of its ``window`` names."""
    size = -(-len(grams) // window) * window + window
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(grams)] = grams
    rows = padded.reshape(-1, window)
    index = np.arange(size).reshape(-1, window)
    low = np.minimum.accumulate(rows, axis=1)
    fresh = np.ones_like(rows, bool)
    fresh[:, 1:] = low[:, 1:] < low[:, :-1]
    head = np.maximum.accumulate(np.where(fresh, index, -1), axis=1).reshape(-1)
    back = rows[:, ::-1]
    low = np.minimum.accumulate(back, axis=1)
    fresh = back == low  # from the right, an equal name further left replaces
    tail = np.minimum.accumulate(np.where(fresh, index[:, ::-1], size), axis=1)[:, ::-1].reshape(-1)
    starts = np.arange(count)
    right, left = head[starts + window - 1], tail[starts]
    return np.where(padded[left] <= padded[right], left, right)


def _runs(names: Names, length: int):
    """Runs of strings with one anchor: the anchors, first and last string."""
    count = len(names.strings)
    at = anchors(names.grams, count, length - GRAM + 1)
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    return at[np.append(0, cut)], np.append(0, cut), np.append(cut, count) - 1


def _half(names: np.ndarray, first: np.ndarray, half: int) -> np.ndarray:
    """A 31-bit name of the ``half`` bytes from ``first`` on; where they leave the text, one by place."""
    last = first + half - 3 * GRAM
    inside = (first >= 0) & (last < len(names))
    a, b = names[np.where(inside, first, 0)], names[np.where(inside, last, 0)]
    return np.where(inside, mix(a * _A + b) >> np.uint64(33), np.uint64(0))


def _folded(columns: list[np.ndarray]) -> pa.RecordBatch:
    """Anchors of one task, the first of each name and run marked as the one that is compared."""
    order = np.lexsort((columns[1], columns[0]))
    columns = [c[order] for c in columns]
    grams, runs = columns[:2]
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (runs[1:] != runs[:-1])
    starts = np.flatnonzero(first)
    many = np.repeat(np.diff(np.append(starts, len(grams))) > 1, np.diff(np.append(starts, len(grams))))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, first, many)], names=ANCHOR)


#: ``first`` stands for its name and run in a task; ``many`` where the task has it more than once.
ANCHOR = ["gram", "run", "sides", "t", "place", "first", "many"]


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """One row for each anchor: its 27-byte name, the name of its run, halves, text and place."""
    half = length // 2

    def run(batches):
        seen: set[tuple] = set()
        held, n = [], 0
        for batch in batches:
            for part in pieces(batch, 64):
                for key, text in zip(strings(part, "t"), strings(part, "text"), strict=True):
                    if (key, len(text)) in seen:
                        continue
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen.add((key, len(text)))
                    names = Names(text, length)
                    if not len(names.strings):
                        continue
                    at, first, last = _runs(names, length)
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(names.strings, dtype=np.uint64)))
                    shape = ((at - first) << 10 | (last - first)).astype(np.uint64)
                    whole = mix(sums[last + 1] - sums[first] + shape * _B)
                    right = _half(names.wide, np.where(at - last <= length - half, at, -1), half)
                    left = _half(names.wide, np.where(at - first > length - half, at - half, -1), half)
                    sides = right << np.uint64(32) | left
                    place = first << 20 | (at - first) << 10 | (last - first)
                    made = names.grams[at], whole, sides, np.full(len(at), key, np.int64), place
                    held.append([v.view(np.int64) for v in made])
                    n += len(at)
                if n > HELD_ANCHORS:
                    yield _folded([np.concatenate(c) for c in zip(*held, strict=True)])
                    held, n = [], 0
        if held:
            yield _folded([np.concatenate(c) for c in zip(*held, strict=True)])

    kinds = ", ".join(f"{c} bigint" for c in ANCHOR[:5])
    return map_arrow(docs, run, f"{kinds}, first boolean, many boolean")


def _met_anchors(rows: DataFrame) -> DataFrame:
    """Anchors whose name occurs more than once; ``same`` where name and run do.

    Only one row of each name and run of a task is dealt by its name, so a passage that a
    third of all texts hold brings no more rows together than there are tasks. The others
    are settled by that row, and dealt anywhere.
    """
    deal = F.when(F.col("first"), F.col("gram")).otherwise(F.xxhash64("t", "place"))
    return _repeated(rows, ["gram"], ["run"], ["many"], deal).drop("first", "many")


def _repeated(rows: DataFrame, keys: list[str], within: list[str], several: Sequence[str] = (), deal: Column | None = None) -> DataFrame:
    """Rows whose ``keys`` occur more than once; ``same`` where ``keys`` and ``within`` do.

    A row that a column of ``several`` marks stands for more than one. Rows are dealt by
    ``deal``, if not by ``keys``. They stream in sorted order; the last row of a batch waits for the next one.
    """
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, field("same", "boolean")])
    order = [names.index(c) for c in keys + within]
    marked = [names.index(c) for c in several]

    def run(batches):
        before, held = None, None  # the row before the held one, and the held row

        def judged(columns, after):
            """All rows but what follows them; ``after`` is the next row or None."""
            n = len(columns[0])
            key, both = np.zeros(n + 1, bool), np.zeros(n + 1, bool)  # equal to the row before
            for c, which in zip(order, [True] * len(keys) + [False] * len(within), strict=True):
                values = columns[c]
                near = np.empty(n + 1, bool)
                near[1:n] = values[1:] == values[:-1]
                near[0] = before is not None and before[c] == values[0]
                near[n] = after is not None and after[c] == values[-1]
                both = near if c == order[0] else both & near
                if which:
                    key = near if c == order[0] else key & near
            keep, same = key[:-1] | key[1:], both[:-1] | both[1:]
            for c in marked:
                keep, same = keep | columns[c], same | columns[c]
            if keep.any():
                arrays = [pa.array(v[keep]) for v in columns]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(same[keep])], names=[*names, "same"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(([h], c)) for h, c in zip(held, columns, strict=True)]
            if len(columns[0]) > 1:
                yield from judged([c[:-1] for c in columns], [c[-1] for c in columns])
                before = [c[-2] for c in columns]
            held = [c[-1] for c in columns]
        if held is not None:
            yield from judged([np.array([h]) for h in held], None)

    dealt = rows.repartition(*[F.col(c) for c in keys] if deal is None else [deal]).sortWithinPartitions(*keys, *within)
    return map_arrow(dealt, run, schema)


def _strings(docs: DataFrame, length: int) -> DataFrame:
    """Name, anchor's name, text and place of each string of the runs asked for in ``places``."""

    def run(batches):
        half, seen = length // 2, set()
        for batch in batches:
            for part in pieces(batch, 64):
                out = [], [], [], []
                for key, text, places in zip(*(strings(part, c) for c in ("t", "text", "places")), strict=True):
                    if key in seen:
                        continue
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    names = Names(text, length)
                    for p in places:
                        right, left, place = p & 1, p & 2, p >> 2
                        first, ahead, more = place >> 20, place >> 10 & 1023, place & 1023
                        at = first + ahead
                        which = np.arange(first, first + more + 1)
                        # Up to half a string before the anchor, the half behind the anchor is all inside.
                        near = at - which <= length - half
                        which = which[near & bool(right) | ~near & bool(left)]
                        made = names.strings[which], np.full(len(which), names.grams[at]), np.full(len(which), key, np.int64), which
                        for column, v in zip(out, made, strict=True):
                            column.append(v.view(np.int64))
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c)) for c in out], names=["name", "gram", "t", "first"]
                    )

    return map_arrow(docs, run, "name bigint, gram bigint, t bigint, first bigint")


def _merged(marks: DataFrame, length: int) -> DataFrame:
    """``t, first, last`` of strings to those of maximal runs whose strings overlap or touch.

    Rows stream in sorted order; the open run of a batch is carried to the next.
    """

    def run(batches):
        def out(t, first, last):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (t, first, last)], names=["t", "first", "last"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t, first, last = (c.to_numpy() for c in batch.columns)
            if held is not None:
                t, first, last = (np.concatenate((h, c)) for h, c in zip(held, (t, first, last), strict=True))
            other = np.concatenate(([False], t[1:] != t[:-1]))
            group = np.cumsum(other) << 40  # larger than any place, so that the maximum starts anew
            reach = np.maximum.accumulate(group + last) - group
            new = np.concatenate(([True], other[1:] | (first[1:] > reach[:-1] + length)))
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(t)) - 1
            t, first, last = t[starts], first[starts], reach[ends]
            held = t[-1:], first[-1:], last[-1:]
            if len(t) > 1:
                yield out(t[:-1], first[:-1], last[:-1])
        if held is not None:
            yield out(*held)

    dealt = marks.repartition(F.col("t")).sortWithinPartitions("t", "first")
    return map_arrow(dealt, run, "t bigint, first bigint, last bigint")


def with_identity(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with a number that equal texts share and different ones do not.

    It is a 64-bit hash. Where two texts of one hash differ in size or in a second hash,
    both get another number, made from all of these: 160 bits tell texts apart, but only
    64 are sent along.
    """
    first = F.xxhash64(text)
    rest = F.struct(F.octet_length(text).alias("size"), F.xxhash64(F.lit(2), F.col(text)).alias("second"))
    seen = docs.where(F.col(text).isNotNull()).select(first.alias("__first"), rest.alias("rest"))
    spans = seen.groupBy("__first").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
    shared = staged(spans.where("low <> high").select("__first"), "suffix-hashes")
    if shared.isEmpty():
        return docs.withColumn(name, first)
    marked = docs.withColumn("__hash", first).join(shared.withColumn("__shared", F.lit(True)), F.col("__hash") == F.col("__first"), "left")
    own = F.xxhash64("__hash", rest["size"], rest["second"])
    return marked.withColumn(name, F.when(F.col("__shared"), own).otherwise(F.col("__hash"))).drop("__hash", "__first", "__shared")


def repeated_spans(docs: DataFrame, text: str, length: int) -> DataFrame:
    """``t`` (the text's number, a column of ``docs``) and its ``runs``: first and last places of strings that repeat."""
    if not 3 * GRAM <= length <= 9 * GRAM:
        raise ValueError(f"length must be from {3 * GRAM} to {9 * GRAM} bytes")
    keyed = docs.where(F.col(text).isNotNull()).select("t", F.octet_length(text).alias("size"), F.col(text).alias("text"))
    keyed = keyed.where(F.col("size") >= length)
    copied = keyed.groupBy("t", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copied = copied.select("t", F.lit(0).cast("bigint").alias("first"), (F.col("size") - length).cast("bigint").alias("last"))

    first = F.shiftright("place", 20)
    last = first + F.col("place").bitwiseAND(F.lit(1023))
    found = staged(_met_anchors(_anchor_rows(keyed, length)), "suffix-anchors")
    settled = found.where("same").select("t", first.alias("first"), last.alias("last"))

    # One run of each kind, to be compared with those that are not settled.
    kinds = found.groupBy("gram", "run").agg(
        F.min(F.struct("t", "place")).alias("at"), F.first("sides").alias("sides"), F.max("same").alias("same")
    )
    kinds = staged(
        kinds.select("gram", "run", "at.t", "at.place", "same", F.shiftrightunsigned("sides", 32).alias("right"),
                     F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF)).alias("left")), "suffix-kinds"
    )
    sides = []
    for side in ("right", "left"):
        shared = kinds.where(f"{side} <> 0").groupBy("gram", side).agg(F.count(F.lit(1)).alias("n"), F.min("same").alias("all"))
        shared = staged(shared.where("n > 1 AND NOT all").select("gram", side), f"suffix-{side}")
        sides.append(kinds.join(shared, ["gram", side], "left_semi").select("t", "place", F.lit(side).alias("side")))
    flag = F.when(F.col("side") == "right", 1).otherwise(2)
    asked = sides[0].union(sides[1]).groupBy("t", "place").agg(F.sum(flag).alias("flags"))
    packed = F.col("place") * 4 + F.col("flags")
    asked = staged(asked.groupBy("t").agg(F.collect_list(packed).alias("places")), "suffix-asked")
    rows = _strings(keyed.join(small(asked, "places"), "t"), length)
    merged = staged(_repeated(rows, ["name"], ["gram"]), "suffix-strings")
    remaining = merged.where("same").select("t", "first", F.col("first").alias("last"))
    runs = _merged(settled.union(remaining).union(copied), length)
    spans = runs.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))
    return staged(spans, "suffix-spans")


def dedup_bytes(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``spans`` of removed bytes, and ``kept`` bytes.

    A null text is empty; texts shorter than ``length`` stay whole. Rows of equal text
    are copies of each other, whatever their ids. Input columns of the four names are
    replaced, all others kept.
    """
    names = ["n_bytes", "n_removed", "spans", "kept"]
    own = with_identity(docs.drop(*[n for n in names if n != text]), text, "__t")
    runs = small(repeated_spans(own.select(F.col("__t").alias("t"), F.col(text).alias("__text")), "__text", length), "runs")
    met = own.join(runs.withColumnsRenamed({"t": "__t", "runs": "__runs"}), "__t", "left").drop("__t")

    def make():
        def per_batch(batch):
            out = [], [], [], []
            for value, found in zip(strings(batch, text), strings(batch, "__runs"), strict=True):
                data = (value or "").encode()
                spans = [(r["first"], r["last"] + length) for r in found or ()]
                cuts = [0, *[x for s in spans for x in s], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                made = len(data), len(data) - len(kept), [{"first": a, "beyond": b} for a, b in spans], kept
                for column, v in zip(out, made, strict=True):
                    column.append(v)
            return out

        return per_batch

    kinds = ["bigint", "bigint", "array<struct<first:bigint,beyond:bigint>>", "binary"]
    return add_columns(met, make, list(zip(names, kinds, strict=True))).drop("__runs")

