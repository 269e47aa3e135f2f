"""Spelling variants: each word of a vocabulary and the words one edit away from it.

The search is a bit-sliced position index. For each (position, letter) a bitset over the
words of a unit says which have that letter there. A query reads its letters once and
carries four bitsets side by side: the words that match so far without an error, and
those with one replaced, one inserted or one left-out letter. One step advances each by
ANDs and ORs of whole machine words; an inserted or left-out letter reads the index at
the next or the previous position.

A unit does not hold the whole vocabulary. Two words one edit apart, the shorter of
length ``s``, share their first ``s // 2`` letters or their last ``s - s // 2``. So words
are dealt by length and by such a half; a half that many words share is cut into blocks,
and each two blocks are one unit. What returns is a count and the best neighbour for each
word, never the pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.llm.common import ASCII_LOWER, field, map_arrow, pieces, staged, strings

LETTERS = "a-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, MIN_RATIO = 7, 2, 10
#: A run whose checksum this divides loses a letter.
DROP_EVERY = 31
#: Words of a unit, and letters; long words share a unit with fewer others.
BLOCK, BLOCK_LETTERS = 2048, 2**17
#: Queries whose bitsets are held at once.
QUERIES = 256
#: Distinct words that a task holds before it sends their counts.
HELD = 200_000


def count_words(
    docs: DataFrame, id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, drop_every: int = DROP_EVERY
) -> DataFrame:
    """``word`` and ``n``, its occurrences, of the words with at least ``min_length`` code points.

    A word is a maximal run of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased. Where
    ``drop_every`` divides the unsigned crc32 ``h`` of UTF-8 ``<id>:<run>``, the code
    point at ``h`` modulo the run's length is left out (0: never). A null text has no
    words; a null id counts as the text ``null``.
    """
    schema = T.StructType([field("word", "string"), field("n", "bigint")])

    def run(batches):
        # A run that is too short cannot become a word.
        found, counts = re.compile(f"[{LETTERS}]{{{max(1, min_length)},}}").findall, Counter()

        def made():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for part in pieces(batch):
                for key, body in zip(strings(part, "id"), strings(part, "text"), strict=True):
                    if not body:
                        continue
                    own = Counter(found(body.encode().translate(ASCII_LOWER).decode()))
                    if drop_every:
                        start = zlib.crc32(f"{'null' if key is None else key}:".encode())
                        for word in [w for w in own if zlib.crc32(w.encode(), start) % drop_every == 0]:
                            at = zlib.crc32(word.encode(), start) % len(word)
                            n, less = own.pop(word), word[:at] + word[at + 1 :]
                            if len(less) >= min_length:
                                counts[less] += n
                    counts.update(own)
                    if len(counts) > HELD:
                        yield made()
                        counts.clear()
        if counts:
            yield made()

    parts = map_arrow(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), run, schema)
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Positions:
    """Bitsets over the rows of a unit, whose words have ``short`` or ``short + 1`` letters."""

    def __init__(self, words: list[str], short: int):
        self.n, self.words64 = len(words), -(-len(words) // 64)
        lengths = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        letters, codes = np.unique(points, return_inverse=True)
        self.codes = np.full((self.n, short + 1), -1)
        places = np.arange(short + 1) < lengths[:, None]
        self.codes[places] = codes
        rows, at = np.nonzero(places)
        slots, slot = np.unique(at * len(letters) + codes, return_inverse=True)
        # Row of each (position, letter) that occurs; the last row is empty.
        self.slots = np.full((short + 2, len(letters) + 1), len(slots))
        self.slots[slots // len(letters), slots % len(letters)] = np.arange(len(slots))
        self.sets = bitsets(slot, rows, len(slots) + 1, self.n)
        self.of_length = {k: bitsets(np.zeros((lengths == k).sum(), int), np.flatnonzero(lengths == k), 1, self.n)[0] for k in (short, short + 1)}
        self.short, self.lengths = short, lengths

    def at(self, position: int, codes: np.ndarray) -> np.ndarray:
        """The bitset of each query's letter at a position; empty before the first."""
        if position < 0:
            return np.zeros((len(codes), self.words64), np.uint64)
        return self.sets[self.slots[position, codes]]

    def near(self, queries: np.ndarray, codes: np.ndarray, length: int) -> np.ndarray:
        """Words exactly one edit from queries of one length, whose letters are ``codes``."""
        none = np.zeros((len(queries), self.words64), np.uint64)
        exact, replaced, longer, shorter = ~none, none.copy(), none.copy(), none.copy()
        for i in range(length):
            letter = codes[:, i]
            here = self.at(i, letter)
            if length == self.short:
                longer = (longer | exact) & self.at(i + 1, letter)
                replaced = (replaced & here) | (exact & ~here)
            else:
                shorter = (shorter & self.at(i - 1, letter)) | exact
            exact &= here
        if length == self.short:
            return ((longer | exact) & self.of_length[self.short + 1]) | (replaced & self.of_length[self.short])
        return shorter & self.of_length[self.short]


def bitsets(group: np.ndarray, member: np.ndarray, groups: int, n: int) -> np.ndarray:
    """A bitset over ``n`` rows for each group, from (group, member) pairs."""
    out = np.zeros((groups, -(-n // 64)), np.uint64)
    np.bitwise_or.at(out, (group, member // 64), np.uint64(1) << (member % 64).astype(np.uint64))
    return out


def set_bits(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bit number of every bit that is set."""
    rows, words = np.nonzero(sets)
    bits = np.unpackbits(sets[rows, words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, bit = np.nonzero(bits)
    return rows[which], words[which] * 64 + bit


def near_in_unit(words: list[str], counts: np.ndarray, keys: np.ndarray, suffix: np.ndarray, second: np.ndarray | None, short: int):
    """Row, number of near words and row of the best one, for the rows that have any.

    Rows are near when one edit apart and of one key. Rows of a suffix key leave out
    those that share the prefix too, which the prefix's unit counts. With ``second``,
    only rows of different sides meet.
    """
    index = Positions(words, short)
    n = len(words)
    _, key = np.unique(keys, return_inverse=True)
    same_key = bitsets(key, np.arange(n), key.max() + 1, n)
    _, prefix = np.unique([w[: short // 2] for w in words], return_inverse=True)
    same_prefix = bitsets(prefix, np.arange(n), prefix.max() + 1, n)
    sides = None if second is None else bitsets(second.astype(int), np.arange(n), 2, n)
    # Best: the most frequent, of equal ones the first in code-point order.
    order = sorted(range(n), key=lambda k: (-counts[k], words[k]))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    total, best = np.zeros(n, np.int64), np.full(n, n)
    for length in (short, short + 1):
        of = np.flatnonzero(index.lengths == length)
        for at in range(0, len(of), QUERIES):
            q = of[at : at + QUERIES]
            met = index.near(q, index.codes[q], length) & same_key[key[q]]
            met &= np.where(suffix[q, None], ~same_prefix[prefix[q]], ~np.uint64(0))
            if sides is not None:
                met &= sides[1 - second[q].astype(int)]
            a, b = set_bits(met)
            np.add.at(total, q[a], 1)
            np.minimum.at(best, q[a], rank[b])
    have = np.flatnonzero(total)
    return have, total[have], np.array(order)[best[have]]


def _units(vocabulary: DataFrame, block: int, block_letters: int) -> DataFrame:
    """Each word in the units that it belongs to: ``short``, ``unit``, ``second``, ``suffix``, ``half``, ``word``, ``n``.

    ``second`` is null in a unit that holds whole keys, else the side of its two blocks.
    """
    length = F.length("word")
    roles = F.explode(F.array(length, length - 1)).alias("short")
    kinds = F.explode(F.array(F.lit(False), F.lit(True))).alias("suffix")
    rows = vocabulary.select("word", "n", roles).where("short > 0").select("word", "n", "short", kinds)
    front = F.expr("substring(word, 1, int(short / 2))")
    # A longer word's last letters start one later.
    back = F.expr("substring(word, int(short / 2) + 1 + (length(word) - short))")
    keyed = rows.withColumn("half", F.when(F.col("suffix"), back).otherwise(front))
    keyed = staged(keyed, "word-halves")
    room = F.greatest(F.lit(64), F.least(F.lit(block), F.floor(F.lit(block_letters) / F.col("short"))))
    sizes = staged(keyed.groupBy("short", "suffix", "half").agg(F.count(F.lit(1)).alias("size")).withColumn("room", room), "half-sizes")
    per_length = sizes.groupBy(F.col("short").alias("s")).agg(F.ceil(F.sum("size") / F.first("room")).alias("units"))
    packs = staged(per_length, "units-of-lengths")
    hot = sizes.where("size > room").select("short", "suffix", "half", F.ceil(F.col("size") / F.col("room")).cast("int").alias("parts"))
    dealt = keyed.join(hot, ["short", "suffix", "half"], "left").join(packs, F.col("short") == F.col("s")).drop("s")
    key = F.xxhash64("suffix", "half")
    whole = dealt.where("parts IS NULL").select(
        "short", F.concat_ws("-", F.lit("w"), F.pmod(key, F.col("units"))).alias("unit"), F.lit(None).cast("boolean").alias("second"),
        "suffix", "half", "word", "n",
    )
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    cut = dealt.where("parts IS NOT NULL").withColumn("part", part)
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = F.concat_ws("-", F.lit("p"), F.col("suffix"), F.col("half"), F.least("part", "other"), F.greatest("part", "other"))
    side = F.when(F.col("part") != F.col("other"), F.col("part") > F.col("other"))
    return whole.union(cut.select("short", pair.alias("unit"), side.alias("second"), "suffix", "half", "word", "n"))


def near_words(vocabulary: DataFrame, block: int = BLOCK, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (a struct of ``n`` and ``word``) of every word with a word one edit away.

    ``vocabulary`` has ``word`` and ``n``, each word once.
    """
    schema = "word string, n_near bigint, best_n bigint, best_word string"

    def compare(group: pa.Table) -> pa.Table:
        words = group.column("word").to_pylist()
        short = group.column("short")[0].as_py()
        suffix = group.column("suffix").to_numpy(zero_copy_only=False).astype(bool)
        halves = group.column("half").to_pylist()
        keys = np.array([f"{s:d}{h}" for s, h in zip(suffix, halves, strict=True)])
        counts = group.column("n").to_numpy()
        sides = group.column("second")
        second = None if sides.null_count else sides.to_numpy(zero_copy_only=False).astype(bool)
        rows, totals, best = near_in_unit(words, counts, keys, suffix, second, short)
        return pa.table(
            {"word": pa.array([words[k] for k in rows], pa.string()), "n_near": pa.array(totals, pa.int64()),
             "best_n": pa.array(counts[best], pa.int64()), "best_word": pa.array([words[k] for k in best], pa.string())}
        )

    met = _units(vocabulary, block, block_letters).groupBy("short", "unit").applyInArrow(compare, schema)
    found = met.groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best_word").alias("word"))).alias("best"),
    )
    return found.select("word", "n_near", F.struct((-F.col("best.less")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of its chain of forms, for each ``(word, form)``.

    A form is at least ten times as frequent, so chains end, after few steps. Each round
    doubles the steps that a row has taken.
    """
    roots = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        roots = moved.select("word", "root")


def group_variants(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    min_ratio: int = MIN_RATIO,
    drop_every: int = DROP_EVERY,
    block: int = BLOCK,
) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` for each word of the texts.

    Words are those of ``count_words`` with at least ``min_count`` occurrences. ``form`` is
    the near word with the largest count, of equal ones the first in code-point order, if
    its count is at least ``min_ratio`` (more than 1) times the word's; ``root`` is where the
    forms end, the word itself without one. Null and empty texts have no words; repeated
    rows, and rows of one id, count each. An empty table gives no rows.
    """
    vocabulary = staged(count_words(docs, id, text, min_length, drop_every).where(F.col("n") >= min_count), "vocabulary")
    near = near_words(vocabulary, block)
    every = vocabulary.join(near, "word", "left")
    is_form = F.col("best.n") >= min_ratio * F.col("n")
    every = staged(
        every.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                     F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, F.col("best.n")).alias("form_n")),
        "near-words",
    )
    roots = _roots(every.where("form IS NOT NULL").select("word", "form"))
    named = every.join(roots, "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
