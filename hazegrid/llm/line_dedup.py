"""Line dedup: windows of three consecutive lines that occur before are removed.

Lines are split at ``\\n``; blank lines take part in no window and always stay. Every
window of three consecutive lines that are not blank is hashed to 128 bits. One
aggregation finds the windows that occur more than once with their first place in
the order of (id, text hash, position). All later occurrences cover their three
lines; overlapping ones merge, and the covered lines go.

Only hashes and positions are shuffled for the search: copies meet in a count and a
minimum, combined map-side, so a window that holds a third of all rows is no group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.llm.common import add_columns, field, map_arrow, pieces, small, staged, strings

WIDTH = 3


def window_hashes(text: str | None, width: int) -> np.ndarray:
    """128 bits, as two numbers, for each window of lines that are not blank."""
    lines = [hashlib.blake2b(x.encode(), digest_size=16).digest() for x in (text or "").split("\n") if x.strip(" ")]
    found = [
        hashlib.blake2b(b"".join(lines[i : i + width]), digest_size=16).digest() for i in range(len(lines) - width + 1)
    ]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """``id, text`` (its hash), place and hash of every window."""
    schema = T.StructType(
        [docs.schema["id"], field("t", "bigint"), field("at", "int"), field("a", "bigint"), field("b", "bigint")]
    )

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for part in pieces(batch):
                found = [window_hashes(v, width) for v in strings(part, "text")]
                sizes = [len(f) for f in found]
                if not sum(sizes):
                    continue
                which = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                hashes = np.concatenate(found)
                columns = [
                    part.column(0).take(which),
                    part.column(1).take(which),
                    pa.array(np.concatenate([np.arange(n) for n in sizes]), pa.int32()),
                    pa.array(np.ascontiguousarray(hashes[:, 0])),
                    pa.array(np.ascontiguousarray(hashes[:, 1])),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return map_arrow(docs.select("id", "t", "text"), run, schema)


def later_windows(docs: DataFrame, width: int) -> DataFrame:
    """``id, t, starts``: places of the windows of ``docs`` (id, t, text) that occur before, by document."""
    windows = _windows(docs, width)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "t", "at")
    first = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    # Read apart from the count, so that adaptive execution can split a hot window.
    first = staged(first.select("a", "b", "first"), "line-windows")
    later = windows.join(first, ["a", "b"]).where(place != F.col("first"))
    return later.groupBy("id", "t").agg(F.array_sort(F.collect_set("at")).alias("starts"))


def without(text: str, starts: list[int], width: int) -> tuple[str, int]:
    """The text without the lines of the windows at ``starts``, and their number."""
    lines = text.split("\n")
    filled = [i for i, x in enumerate(lines) if x.strip(" ")]
    gone = {i for s in starts for i in filled[s : s + width]}
    return "\n".join([x for i, x in enumerate(lines) if i not in gone]), len(gone)


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with the lines removed from ``text``, plus ``n_lines`` and ``n_removed``.

    Null and empty texts stay as they are (a null text has no line, an empty one has
    one), as do texts of fewer lines than a window. Blank lines hold nothing but
    spaces. Rows equal in id and text count as one document and get the same result; a
    null id comes last. Input columns called ``n_lines`` or ``n_removed`` are replaced.
    """
    keyed = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    covered = staged(later_windows(keyed, width), "line-covered").withColumnsRenamed({"id": "__cid", "t": "__ct"})
    own = docs.drop("n_lines", "n_removed").withColumn("__t", F.xxhash64(text)).withColumn("__id", F.col(id))
    same = F.col("__id").eqNullSafe(F.col("__cid")) & (F.col("__t") == F.col("__ct"))
    met = own.join(small(covered, "starts"), same, "left").withColumnRenamed("starts", "__starts")
    met = met.drop("__t", "__id", "__cid", "__ct")

    def make():
        def per_batch(batch):
            texts, counts, removed = [], [], []
            for value, starts in zip(strings(batch, text), strings(batch, "__starts"), strict=True):
                counts.append(0 if value is None else value.count("\n") + 1)
                n = 0
                if starts:
                    value, n = without(value, starts, width)
                texts.append(value)
                removed.append(n)
            return texts, counts, removed

        return per_batch

    made = add_columns(met, make, [(text, "string"), ("n_lines", "bigint"), ("n_removed", "bigint")])
    return made.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
