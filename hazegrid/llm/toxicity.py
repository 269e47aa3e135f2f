"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text.

Folding takes away case and accents of the marks below, maps homoglyphs (Cyrillic,
Greek, full-width) to Latin letters and digit substitutions inside words to the letters they stand
for, and drops zero-width characters. Entries are beginnings of words; each has the
weight that labelled rows give it. A match inside an exception phrase counts nothing:
two words, one of them an entry's, that clean training rows use and toxic ones do not, or
phrases that the caller names.
The sum of the weights is normalised by the text's length in words; a logistic
function, fitted on the same labelled rows, makes a score from 0 to 1.

``fit`` learns from at most ``SAMPLE_ROWS`` labelled rows, taken by a hash of the id;
``score_texts`` scores any table with the model.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field as member

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import add_columns, map_arrow, pieces, staged, strings

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 40_000
#: Lengths of word beginnings that can become entries.
SHORTEST, LONGEST = 4, 8
#: An entry occurs in so many toxic documents and such a share of them, and is so many times likelier there.
LEAST_DOCS, LEAST_SHARE, LEAST_RATIO = 3, 0.005, 8.0
#: Phrases that speak for no toxic text whatever the labelled rows hold.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "scum of the pond", "sore loser bracket")
#: A learnt exception occurs in so many clean documents, and is so many times likelier there.
EXCEPTION_DOCS, EXCEPTION_RATIO = 3, 8.0

# Look-alikes and what they stand for.
_CYRILLIC = dict(zip("асеоркхуіјѕвнмтг", "aceopkxyijsbhmtr", strict=True))
_GREEK = dict(zip("αεικνορτυχ", "aeiknoptux", strict=True))
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_FOLD = {ord(k): v for k, v in (_CYRILLIC | _GREEK).items()}
_FOLD |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_FOLD |= dict.fromkeys((0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
_INSIDE = re.compile(r"(?<=[^\W\d_])[013457@$]+(?=[^\W\d_])|(?<![\w@$])[013457@$]+(?=[^\W\d_])")
_OTHER = re.compile(r"[\W_]+")
_DIGIT = re.compile("[0-9@$]")
# Outside of ASCII and the letters of Latin-1 and Latin Extended-A and -B.
_FOREIGN = re.compile("[\x80-\xbf\xd7\xf7\u0250-\U0010ffff]")
_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def fold(text: str) -> str:
    """Lower case, look-alikes mapped, words separated and enclosed by one space."""
    text = text.lower()
    foreign = _FOREIGN.search(text)
    if foreign:
        text = unicodedata.normalize("NFC", text).translate(_FOLD)
    if _DIGIT.search(text):
        previous = None
        while previous != text:
            previous = text
            text = _INSIDE.sub(lambda m: "".join(_DIGITS[c] for c in m[0]), text)
    if foreign:
        return f" {_OTHER.sub(' ', text).strip()} "
    # What is left beside ASCII are letters.
    return f" {' '.join(text.encode().translate(_BLANK).decode().split())} "


@dataclass
class Lexicon:
    """Entries with their weights, exception phrases, and the logistic function."""

    weights: dict[str, float] = member(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    intercept: float = -4.0
    per_hit: float = 0.0
    per_density: float = 0.0

    def matcher(self):
        """Function from a text to its features: log of the weights' sum, sum per square root of words."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            automaton.add_word(f" {entry}", (len(entry) + 1, weight))
        for phrase in self.exceptions:
            folded = fold(phrase)
            automaton.add_word(folded, (len(folded), None))
        if len(automaton):
            automaton.make_automaton()

        def features(text: str | None) -> tuple[float, float]:
            if not text or not len(automaton):
                return 0.0, 0.0
            folded = fold(text)
            best: dict[int, float] = {}
            excused: list[tuple[int, int]] = []
            for last, (size, weight) in automaton.iter(folded):
                start = last - size + 1
                if weight is None:
                    excused.append((start, last))
                else:
                    best[start] = max(weight, best.get(start, 0.0))
            if not best:
                return 0.0, 0.0
            total = sum(w for s, w in best.items() if not any(a <= s < b for a, b in excused))
            return math.log1p(total), total / math.sqrt(folded.count(" ") - 1)

        return features

    def score(self, features: tuple[float, float]) -> float:
        z = self.intercept + self.per_hit * features[0] + self.per_density * features[1]
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def in_training(id: Column) -> Column:
    """Rows that labels may be learnt from: crc32 of the id as text, modulo 5, is not 0."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 != 0, F.lit(False))


def _beginnings(text: str | None) -> set[str]:
    found = set()
    for word in set(fold(text or "").split()):
        for size in range(SHORTEST, min(LONGEST, len(word)) + 1):
            found.add(word[:size])
    return found


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
    exceptions: Sequence[str] = EXCEPTIONS,
) -> Lexicon:
    """Learn entries, weights, exceptions and the logistic function from labelled training rows.

    ``exceptions`` are phrases beside those that are learnt.
    Rows with a null id, text or label and labels other than 0 and 1 are left out; a
    document with several labels takes the largest, documents of one id are each a
    row. Without rows of both labels the lexicon is empty and every score the same.
    Beginnings of words are counted in each task before they meet; no text moves.
    """
    known = labels.where(F.col(label).isin(0, 1) & in_training(F.col(id)))
    known = known.groupBy(F.col(id).alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    total = known.count()
    if total > sample_rows:
        share = int(sample_rows / total * 2**31)
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(2**31)) < share)
    rows = docs.select(F.col(id).alias("__id"), F.col(text).alias("text"))
    rows = rows.where("text IS NOT NULL").join(F.broadcast(known), "__id").select("text", "__y")

    def count(batches):
        import pyarrow as pa

        counts: dict[str, list[int]] = {}
        seen = [0, 0]

        def flushed():
            tokens = [*counts, ""]
            pairs = [*counts.values(), seen]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())],
                names=["token", "clean", "toxic"],
            )
            counts.clear()
            seen[:] = 0, 0

        for batch in batches:
            for value, y in zip(strings(batch, "text"), strings(batch, "__y"), strict=True):
                seen[y] += 1
                for token in _beginnings(value):
                    counts.setdefault(token, [0, 0])[y] += 1
                if len(counts) > 500_000:
                    yield from flushed()
        yield from flushed()

    counted = map_arrow(rows, count, "token string, clean bigint, toxic bigint")
    counted = counted.groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = staged(counted.where(f"token = '' OR toxic >= {LEAST_DOCS}"), "toxic-words")
    ends = counted.where("token = ''").first()
    if ends is None or not ends.clean or not ends.toxic:
        return Lexicon()
    rate = f"((toxic + 0.5) / {ends.toxic + 1}) / ((clean + 0.5) / {ends.clean + 1})"
    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * ends.toxic))
    found = counted.where(f"token <> '' AND toxic >= {least} AND {rate} >= {LEAST_RATIO}")
    found = found.withColumn("weight", F.expr(f"ln({rate})"))
    # Each entry needs its share of a bounded sample's toxic rows, so their number is bounded.
    entries = {r.token: (r.weight, r.toxic) for r in found.collect()}
    lexicon = Lexicon({t: w for t, (w, n) in entries.items() if not _implied(t, w, entries)})
    lexicon.exceptions = (*exceptions, *_learnt_exceptions(lexicon, rows, ends.clean, ends.toxic))
    return _calibrated(lexicon, rows)


def _learnt_exceptions(lexicon: Lexicon, rows: DataFrame, clean: int, toxic: int) -> list[str]:
    """Pairs of neighbouring words, one of them an entry's, that speak for a clean text.

    Pairs are counted once a document. They are those of a bounded sample's clean rows, so
    their number is bounded.
    """
    entries = frozenset(lexicon.weights)

    def run(batches):
        import pyarrow as pa

        sizes = sorted({len(e) for e in entries})
        for batch in batches:
            for part in pieces(batch):
                found, labels = [], []
                for value, y in zip(strings(part, "text"), strings(part, "__y"), strict=True):
                    words = fold(value).split()
                    met = {w for w in set(words) if any(w[:n] in entries for n in sizes)}
                    at = [k for k, w in enumerate(words) if w in met] if met else ()
                    pairs = {(k - 1, k) for k in at if k} | {(k, k + 1) for k in at if k + 1 < len(words)}
                    phrases = {f"{words[a]} {words[b]}" for a, b in pairs}
                    found += phrases
                    labels += [y] * len(phrases)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(labels, pa.int32())], ["phrase", "y"])

    met = map_arrow(rows, run, "phrase string, y int")
    counts = met.groupBy("phrase").agg(F.count_if(F.col("y") == 0).alias("clean"), F.count_if(F.col("y") == 1).alias("toxic"))
    rate = f"((clean + 0.5) / {clean + 1}) / ((toxic + 0.5) / {toxic + 1})"
    kept = counts.where(f"clean >= {EXCEPTION_DOCS} AND {rate} >= {EXCEPTION_RATIO}")
    return sorted(r.phrase for r in kept.collect())


def _implied(token: str, weight: float, entries: dict) -> bool:
    """A shorter beginning says as much."""
    shorter = (entries.get(token[:size]) for size in range(SHORTEST, len(token)))
    return any(e is not None and e[0] >= weight - 0.5 for e in shorter)


def _calibrated(lexicon: Lexicon, rows: DataFrame) -> Lexicon:
    """Fit the logistic function on the sampled rows' two features by Newton's method."""

    def make():
        features = lexicon.matcher()

        def per_batch(batch):
            made = [features(v) for v in strings(batch, "text")]
            return [m[0] for m in made], [m[1] for m in made]

        return per_batch

    found = add_columns(rows, make, [("hit", "double"), ("density", "double")]).select("hit", "density", "__y")
    data = np.array([tuple(r) for r in found.collect()], float)  # at most the sample's rows, three numbers each
    x, y = np.column_stack([np.ones(len(data)), data[:, :2]]), data[:, 2]
    beta, keep = np.zeros(3), np.diag([0.0, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (p - y) + keep @ beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(3), slope)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    lexicon.intercept, lexicon.per_hit, lexicon.per_density = map(float, beta)
    return lexicon


def score_texts(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts get the score of a text without a match. Input columns of
    the two names are replaced; repeated rows are scored each.
    """

    def make():
        features = lexicon.matcher()

        def per_batch(batch):
            scores = [lexicon.score(features(v)) for v in strings(batch, text)]
            return scores, [int(s >= threshold) for s in scores]

        return per_batch

    return add_columns(docs, make, [("score", "double"), ("predicted", "int")])


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with the columns they came with."""
    clash = {c: f"__in_{c}" for c in docs.columns if c in ("score", "predicted")}
    scored = score_texts(docs.withColumnsRenamed(clash), lexicon, clash.get(text, text))
    kept = scored.where("predicted = 0").drop("score", "predicted")
    return kept.withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)
