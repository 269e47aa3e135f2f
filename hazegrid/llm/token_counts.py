"""Token counts by a linear longest-match automaton.

Greedy word-piece segmentation takes the longest vocabulary entry at every point of a
word. A trie of the vocabulary gets, for each node, a failure link to the node where
matching goes on once the node's greedy pieces are popped, and the number of those
pieces. One pass over a word's bytes then gives the number of its pieces; the pieces
themselves are never built.

The vocabulary is that of a ``tokenizers`` file whose entries mark a word's end with
``</w>``. The mark is one more symbol at the end of each word.
"""

from __future__ import annotations

import json
import unicodedata

import regex
from pyspark.sql import DataFrame

from hazegrid.llm.common import add_columns, strings

END = 256
#: Distinct words whose count a task remembers.
REMEMBERED = 500_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class LongestMatch:
    """Trie with failure links; ``count`` gives the number of greedy pieces of a word."""

    def __init__(self, entries: list[tuple[int, ...]]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for symbols in entries:
            node = 0
            for s in symbols:
                if s not in children[node]:
                    children[node][s] = len(children)
                    children.append({})
                    final.append(False)
                node = children[node][s]
            final[node] = True
        self.children = children
        #: Where to go on when no child fits, and how many pieces are popped; None: no piece fits here.
        self.failure: list[int | None] = [None] * len(children)
        self.popped = [0] * len(children)
        level = [(0, s, n) for s, n in children[0].items()]
        while level:
            deeper = []
            for parent, s, node in level:
                if final[node]:
                    self.failure[node], self.popped[node] = 0, 1
                else:
                    at, pops = self.failure[parent], self.popped[parent]
                    while at is not None and s not in children[at]:
                        pops += self.popped[at]
                        at = self.failure[at]
                    if at is not None:
                        self.failure[node], self.popped[node] = children[at][s], pops
                deeper += [(node, t, n) for t, n in children[node].items()]
            level = deeper

    def count(self, symbols) -> int | None:
        """Pieces of one word; None when the greedy way meets a point where no entry fits."""
        children, failure, popped = self.children, self.failure, self.popped
        node = pieces = 0
        for s in symbols:
            while s not in children[node]:
                pieces += popped[node]
                node = failure[node]
                if node is None:
                    return None
            node = children[node][s]
        while node:
            pieces += popped[node]
            node = failure[node]
            if node is None:
                return None
        return pieces


class WordCounter:
    """Words of a text and their pieces, by the file's own normal form and splitting pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        mark = spec["model"]["end_of_word_suffix"]
        entries = []
        for entry in spec["model"]["vocab"]:
            ended = entry.endswith(mark)
            body = entry.removesuffix(mark) if ended else entry
            entries.append((*[alphabet[c] for c in body], *([END] if ended else [])))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        normalizer = spec.get("normalizer") or {}
        self.composed = any(n["type"] == "NFC" for n in normalizer.get("normalizers", [normalizer]) if n)
        self.automaton = LongestMatch(entries)
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> tuple[int, int]:
        if not text:
            return 0, 0
        if self.composed and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        words = self.find(text.lower())
        known = self.known
        try:
            return len(words), sum([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        total = 0
        for w in words:
            if (n := known.get(w)) is None:
                n = self.automaton.count([*w.encode(), END])
                n = 1 if n is None else n  # the whole word is one unknown piece
                if len(w) <= 64:
                    known[w] = n
            total += n
        return len(words), total


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``n_tokens``.

    Texts are composed (NFC) if the vocabulary file lists that, lower-cased and split by
    its pattern, white space is dropped; a word that the greedy way cannot segment counts
    as one piece. The strings of added tokens (``<|endoftext|>``) are ordinary text. Null
    and empty texts have no words. Input columns of the two names are replaced.
    """

    def make():
        counter = WordCounter(vocabulary)

        def per_batch(batch):
            counts = [counter(v) for v in strings(batch, text)]
            return [c[0] for c in counts], [c[1] for c in counts]

        return per_batch

    return add_columns(docs, make, [("n_words", "bigint"), ("n_tokens", "bigint")])
