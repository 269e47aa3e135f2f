"""Benchmark decontamination: hash set of normalised test n-grams against training windows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A window is
``n`` consecutive words of an item; an item of fewer words, but not none, is one
window. The windows of the benchmark are a hash set that every task gets, and each
document is scanned once; a hit of the hash is verified word by word.

The set is broadcast while the benchmark has at most ``BROADCAST_WORDS`` words.
A larger one is joined: both sides emit their windows' 128-bit hashes and meet in a
shuffle join. An item's window brings its words along, and what has met is compared with
the document's words, so no hit rests on a hash alone.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import add_columns, strings

N = 10
#: Words of the benchmark up to which its windows are broadcast (about 100 bytes each).
BROADCAST_WORDS = 2_000_000
#: Bytes of the hash by which the windows of a larger one meet.
HASH_BYTES = 16

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWERED = {c: c + 32 for c in range(65, 91)}
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
HITS = [("n_words", "bigint"), ("n_hit", "bigint"), ("items", "array<bigint>"),
        ("spans", "array<struct<first:int,last:int>>")]


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class WindowSet:
    """Windows of a block of items, by length: sorted hashes, and the exact windows."""

    def __init__(self, items: list[tuple[int | None, str | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        exact: dict[int, dict[bytes, set]] = {}
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int64)
            size = min(n, len(ids))
            if size:
                for row in np.lib.stride_tricks.sliding_window_view(ids, size):
                    exact.setdefault(size, {}).setdefault(row.tobytes(), set()).add(item)
        self.by_size = {}
        for size, windows in exact.items():
            powers = np.array([pow(0x9E3779B97F4A7C15, size - 1 - k, 1 << 64) for k in range(size)], np.uint64)
            rows = np.frombuffer(b"".join(windows), np.int64).reshape(-1, size).astype(np.uint64)
            self.by_size[size] = powers, np.unique((rows * powers).sum(axis=1, dtype=np.uint64)), windows

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set]:
        """Positions inside occurring windows (None when there are none), and their items."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        hit, found = None, set()
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for size, (powers, hashes, windows) in self.by_size.items():
            if len(ids) < size:
                continue
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            for at in range(0, len(starts), 65_536):
                some = starts[at : at + 65_536]
                rows = ids[some[:, None] + np.arange(size)]
                sums = (rows.astype(np.uint64) * powers).sum(axis=1, dtype=np.uint64)
                place = np.minimum(np.searchsorted(hashes, sums), len(hashes) - 1)
                for i in np.flatnonzero(hashes[place] == sums):
                    items = windows.get(rows[i].tobytes())
                    if items is not None:
                        found |= items
                        if hit is None:
                            hit = np.zeros(len(ids), bool)
                        hit[some[i] : some[i] + size] = True
        return hit, found


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and last position of every run of set positions."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    n: int = N,
    broadcast_words: int = BROADCAST_WORDS,
    hash_bytes: int = HASH_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (ascending) and ``spans`` of word positions.

    Null and empty texts have no words and no hits. Items without words have no
    windows. An item without an id marks words but is not listed; items of one id
    count once. Input columns of the four names are replaced, all others kept;
    repeated documents are scanned each.
    """
    items = benchmark.select(F.col(item).cast("bigint").alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > 2 * broadcast_words:  # a word and its separator have two characters at least
        return _find_by_join(docs, items, text, n, hash_bytes)
    block = [(r.item, r.text) for r in items.collect()]
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def make():
        windows = WindowSet(shared.value, n)

        def per_batch(batch):
            out = [], [], [], []
            for value in strings(batch, text):
                words = words_of(value)
                hit, found = windows.scan(words)
                made = len(words), 0, [], []
                if hit is not None:
                    ids = sorted(i for i in found if i is not None)
                    made = len(words), int(hit.sum()), ids, [{"first": a, "last": b} for a, b in spans_of(hit)]
                for column, v in zip(out, made, strict=True):
                    column.append(v)
            return out

        return per_batch

    return add_columns(docs, make, HITS)


def _windows(df: DataFrame, text: str, n: int, sizes, hash_bytes: int, with_words: bool = False) -> DataFrame:
    """Adds ``windows``: the hash, size and position, or the words, of every window of ``sizes``."""

    def make():
        import hashlib

        def per_batch(batch):
            counts, out = [], []
            for value in strings(batch, text):
                words = words_of(value)
                rows = []
                for size in sizes(len(words)) if callable(sizes) else sizes:
                    for at in range(len(words) - size + 1):
                        window = b" ".join(words[at : at + size])
                        digest = hashlib.blake2b(window, digest_size=hash_bytes).digest()
                        rows.append({"size": size, "hash": digest, **({"words": window} if with_words else {"at": at})})
                counts.append(len(words))
                out.append(rows)
            return counts, out

        return per_batch

    kind = "words:binary" if with_words else "at:int"
    return add_columns(df, make, [("n_words", "bigint"), ("windows", f"array<struct<size:int,hash:binary,{kind}>>")])


def _find_by_join(docs: DataFrame, items: DataFrame, text: str, n: int, hash_bytes: int) -> DataFrame:
    """The way for a benchmark too large to broadcast; hits are kept by the text they are in."""
    listed = _windows(items, "text", n, lambda m: [min(m, n)] if m else [], hash_bytes, True)
    listed = listed.select("item", F.inline("windows")).groupBy("size", "hash", "words").agg(F.collect_set("item").alias("its"))
    sizes = sorted(r.size for r in listed.select(F.col("size").alias("size")).distinct().collect())
    names = [f[0] for f in HITS]
    kept = docs.drop(*names).withColumn("__key", F.md5(text))
    texts = kept.groupBy("__key").agg(F.first(text).alias("__text"))
    scanned = _windows(texts, "__text", n, sizes, hash_bytes).select("__key", F.inline("windows"))
    met = scanned.join(listed, ["size", "hash"])
    # A text's hits are no more than its windows.
    hits = met.groupBy("__key").agg(F.collect_list(F.struct("at", "size", "words", "its")).alias("__met"))

    def make():
        def per_batch(batch):
            out = [], [], [], []
            for value, rows in zip(strings(batch, "__text"), strings(batch, "__met"), strict=True):
                words = words_of(value)
                hit, found = np.zeros(len(words), bool), set()
                for r in rows or ():
                    if b" ".join(words[r["at"] : r["at"] + r["size"]]) == r["words"]:
                        hit[r["at"] : r["at"] + r["size"]] = True
                        found |= set(r["its"])
                made = len(words), int(hit.sum()), sorted(found), [{"first": a, "last": b} for a, b in spans_of(hit)]
                for column, v in zip(out, made, strict=True):
                    column.append(v)
            return out

        return per_batch

    checked = add_columns(texts.join(hits, "__key", "left"), make, HITS).select("__key", *names)
    found = kept.join(checked, "__key", "left")
    none = {"n_words": F.lit(0).cast("bigint"), "n_hit": F.lit(0).cast("bigint"), "items": F.array(), "spans": F.array()}
    return found.select(
        *[c for c in kept.columns if c != "__key"],
        *[F.coalesce(F.col(c), none[c].cast(kind)).alias(c) for c, kind in HITS],
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", action: str = "documents", **how) -> DataFrame:
    """Documents without their leaks: whole documents go, or only the words of the spans."""
    names = [f[0] for f in HITS]
    clash = [c for c in docs.columns if c in names]
    safe = docs.withColumnsRenamed({c: f"__in_{c}" for c in clash})
    found = find_leaks(safe, benchmark, text, **how)
    if action == "documents":
        out = found.where("n_hit = 0")
    elif action == "spans":

        def make():
            def per_batch(batch):
                cleaned = []
                for value, spans in zip(strings(batch, text), strings(batch, "spans"), strict=True):
                    if spans:
                        at = [m.span() for m in WORD.finditer(value.translate(_LOWERED))]
                        for s in reversed(spans):
                            value = value[: at[s["first"]][0]] + value[at[s["last"]][1] :]
                    cleaned.append(value)
                return (cleaned,)

            return per_batch

        out = add_columns(found, make, [(text, "string")])
    else:
        raise ValueError(f"action is documents or spans, not {action!r}")
    return out.drop(*names).withColumnsRenamed({f"__in_{c}": c for c in clash}).select(*docs.columns)
