"""SentencePiece encoding and decoding by a table of distinct chunks.

A chunk is a run of white-space markers and the characters up to the next marker.
When no piece of the model has a marker behind another character, no merge crosses a
chunk's border, so a text's ids are its chunks' ids one after the other. Each
distinct marked word is segmented once in a task's table; ids, their printed form
and the decoded text are joined back by position. Models whose pieces cross markers,
or that rewrite their input, are refused.

Each Python worker has a table of its own, which its tasks share and which starts anew
after ``TABLE_CHUNKS`` chunks: memory stays bounded, and no position of the text has to
be shuffled to meet a global table.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from hazegrid.llm.common import add_columns, strings

#: Distinct chunks a worker keeps (about 300 bytes each).
TABLE_CHUNKS = 250_000
#: Longer chunks are segmented where they stand and not kept.
LONGEST_KEPT = 64
MARK = "▁"
_CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")


class ChunkTable:
    """Ids and decoded text of marked words, each segmented once by ``model``."""

    def __init__(self, model: str, size: int = TABLE_CHUNKS):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = size
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("pieces of this model cross white-space markers")
        probe = "  a  Ａ "
        if self.lib.decode(self.lib.encode(probe)) != probe or self.lib.encode("a")[0] != self.lib.piece_to_id(MARK + "a"):
            raise ValueError("this model rewrites its input or marks no first word")
        self.end = self.lib.eos_id()
        self.known: dict[str, tuple] = {}

    def _entry(self, chunk: str, ids: list[int]) -> tuple[int, str, str]:
        # The library drops one leading space of what it decodes, the one it has added.
        text = " " + self.lib.decode(ids)
        return len(ids), " ".join(map(str, ids)), chunk if text == chunk else text

    def _learn(self, chunks) -> None:
        """Segment the chunks that are new; a chunk's first marker is the one the model adds."""
        new = [c for c in set(chunks) if c not in self.known]
        if len(self.known) + len(new) > self.size:
            self.known.clear()
            new = list(set(chunks))
        found = self.lib.encode([c[1:] for c in new], num_threads=1)
        for chunk, ids in zip(new, found, strict=True):
            if len(chunk) == 1:  # a marker at the end of a text: the library adds none to an empty one
                ids = [self.lib.piece_to_id(MARK)]
            self.known[chunk] = self._entry(chunk, ids)

    def entries(self, text: str | None) -> list[tuple[int, str, str]]:
        """Entries of the text's chunks in order: number of ids, the printed ids, the decoded text."""
        if not text:
            return []
        if MARK in text or "  " in text:
            chunks = _CHUNK.findall(" " + text)
        else:
            chunks = [" " + w for w in text.split(" ")]
            if text[0] == " ":  # the added marker and the text's own are one run
                chunks[:2] = [" " + chunks[1]] if len(chunks) > 1 else chunks
        known = self.known
        try:
            return [known[c] for c in chunks]
        except KeyError:
            self._learn([c for c in chunks if len(c) <= LONGEST_KEPT])
        return [known[c] if c in known else self._entry(c, self.lib.encode(c[1:], num_threads=1)) for c in chunks]


@lru_cache(2)
def chunk_table(model: str) -> ChunkTable:
    return ChunkTable(model)


def encode(docs: DataFrame, model: str, text: str = "text", column: str = "ids") -> DataFrame:
    """``docs`` with the array of ids, the end id last; a null or empty text has only that."""

    def make():
        chunks = chunk_table(model)

        def per_batch(batch):
            out = []
            for value in strings(batch, text):
                printed = " ".join([e[1] for e in chunks.entries(value)])
                out.append(np.array([*map(int, printed.split()), chunks.end], np.int32))
            return (out,)

        return per_batch

    return add_columns(docs, make, [(column, "array<int>")])


def decode(docs: DataFrame, model: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``docs`` with the text of an array of ids; null for a null array.

    Pieces that start with a marker begin a chunk; each distinct chunk is decoded
    once. Control ids print nothing.
    """

    def make():
        chunks = chunk_table(model)
        lib, known = chunks.lib, {}
        size = lib.get_piece_size()
        starts = np.array([lib.id_to_piece(i).startswith(MARK) for i in range(size)])
        blank = np.array([set(lib.id_to_piece(i)) == {MARK} for i in range(size)])
        silent = np.array([lib.is_control(i) for i in range(size)])

        def text_of(values) -> str:
            values = np.asarray(values, np.int64)
            values = values[~silent[values]]
            if not len(values):
                return ""
            # A run of markers belongs to the chunk behind it: only a marker after another piece begins one.
            begin = starts[values]
            begin[1:] &= ~blank[values[:-1]]
            begin[0] = True
            bounds = [*np.flatnonzero(begin), len(values)]
            out = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                key = values[a:b].tobytes()
                if (word := known.get(key)) is None:
                    if len(known) >= TABLE_CHUNKS:
                        known.clear()
                    # The library drops one leading space of what it decodes.
                    word = " " * bool(starts[values[a]]) + lib.decode([int(i) for i in values[a:b]])
                    known[key] = word
                out.append(word)
            joined = "".join(out)
            return joined[1:] if starts[values[0]] else joined

        def per_batch(batch):
            return ([None if v is None else text_of(v) for v in strings(batch, ids)],)

        return per_batch

    return add_columns(docs, make, [(column, "string")])


def encode_decode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (the end id last) and ``decoded``, both from one look at the table."""

    def make():
        chunks = chunk_table(model)

        def per_batch(batch):
            ids, texts = [], []
            for value in strings(batch, text):
                entries = chunks.entries(value)
                printed = " ".join([e[1] for e in entries])
                ids.append(np.array([*map(int, printed.split()), chunks.end], np.int32))
                texts.append("".join([e[2] for e in entries])[1:])
            return ids, texts

        return per_batch

    return add_columns(docs, make, [("ids", "array<int>"), ("decoded", "string")])


def round_trip(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; nothing longer leaves the task.

    The printed ids (one space between, the end id last) and the decoded text are put
    together from the table of chunks. Null and empty texts have the end id alone and
    decode to an empty text. Input columns of the three names are replaced.
    """

    def make():
        chunks = chunk_table(model)
        end = str(chunks.end)

        def per_batch(batch):
            counts, prints, texts = [], [], []
            for value in strings(batch, text):
                entries = chunks.entries(value)
                counts.append(sum([e[0] for e in entries]) + 1)
                printed = " ".join([e[1] for e in entries if e[1]] + [end])
                prints.append(hashlib.sha256(printed.encode()).hexdigest())
                decoded = "".join([e[2] for e in entries])[1:]
                texts.append(hashlib.sha256(decoded.encode()).hexdigest())
            return counts, prints, texts

        return per_batch

    return add_columns(docs, make, [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")])
