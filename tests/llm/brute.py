"""Plain computations of the operators' results over small tables."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Groups:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def repeated_bytes(texts, length):
    data = {i: t.encode() for i, t in texts.items()}
    seen = Counter(b[k : k + length] for b in data.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        mark = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mark[k : k + length] = b"\1" * length
        kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        out[i] = len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest()
    return out


def shingles(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def jaccard_components(texts, width, percent):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    lists = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            lists[g].append(i)
    both = Counter((a, b) for ids in lists.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    groups = Groups(sets)
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            groups.join(a, b)
    return {i: (len(sets[i]), groups.find(i)) for i in sets}


def cosine_links(rows, threshold):
    """rows: ``(id, vector, label)``."""
    good = [r for r in rows if r[1] and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    groups, links = Groups([r[0] for r in rows]), Counter()
    for k, (a, x, label) in enumerate(good):
        x = np.array(x, float)
        for b, y, other in good[k + 1 :]:
            if label == other and len(x) == len(y):
                y = np.array(y, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    groups.join(a, b)
    return {r[0]: (links[r[0]], groups.find(r[0]), groups.find(r[0]) == r[0]) for r in rows}


@lru_cache(1)
def _vocabulary(path):
    from hazegrid.llm.token_counts import byte_alphabet

    alphabet = byte_alphabet()
    entries = set()
    for entry in json.load(open(path))["model"]["vocab"]:
        body = entry.removesuffix("</w>")
        entries.add((*[alphabet[c] for c in body], *([256] if body != entry else [])))
    return entries, max(map(len, entries))


def greedy_pieces(path, word):
    entries, longest = _vocabulary(path)
    symbols, at, n = (*word.encode(), 256), 0, 0
    while at < len(symbols):
        size = next((s for s in range(longest, 0, -1) if symbols[at : at + s] in entries and at + s <= len(symbols)), None)
        if size is None:
            return 1
        at, n = at + size, n + 1
    return n


def line_dedup(texts, width=3):
    lines = {i: t.split("\n") for i, t in texts.items()}
    filled = {i: [k for k, x in enumerate(ls) if x.strip(" ")] for i, ls in lines.items()}
    first, gone = {}, defaultdict(set)
    for i in sorted(texts):
        for p in range(len(filled[i]) - width + 1):
            places = filled[i][p : p + width]
            key = tuple(lines[i][k] for k in places)
            if key in first:
                gone[i].update(places)
            else:
                first[key] = i
    return {i: "\n".join(x for k, x in enumerate(ls) if k not in gone[i]) if gone[i] else texts[i] for i, ls in lines.items()}


def _leak_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def leaks(text, items, n):
    """Numbers of the items with an occurring window, and the positions hit."""
    words, found, hit = _leak_words(text), set(), set()
    for k, item in enumerate(items):
        own = _leak_words(item)
        size = min(n, len(own))
        windows = {tuple(own[a : a + size]) for a in range(len(own) - size + 1)} if size else set()
        for a in range(len(words) - size + 1 if size else 0):
            if tuple(words[a : a + size]) in windows:
                found.add(k)
                hit.update(range(a, a + size))
    return (found, hit) if found else ()


def fixed(vector):
    """``floor(256 * c)`` of each component, or None."""
    if vector is None or any(c is None or not math.isfinite(c) for c in vector):
        return None
    return [math.floor(256 * float(c)) for c in vector]


def top_scores(rows, queries, k):
    """rows, queries: ``(id, vector)``; for each query its ``k`` best ``(score, id)``."""
    good = [(i, x) for i, v in rows if (x := fixed(v)) is not None]
    out = []
    for own, v in queries:
        if (x := fixed(v)) is not None:
            met = [(-sum(a * b for a, b in zip(x, y)), i is None, i) for i, y in good if len(y) == len(x) and (own is None or i != own)]
            out.append((own, [(-s, i) for s, _, i in sorted(met, key=lambda t: (t[0], t[1], t[2] or 0))[:k]]))
    return out


def whitened(rows, components):
    """rows: ``(id, vector)`` of one length; ``id -> (n, deviation, whitened, explained)`` and the eigenvalues."""
    from fractions import Fraction

    good = [(i, x) for i, v in rows if (x := fixed(v))]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    mean = [Fraction(s, n) for s in sums]
    v = np.array([[float(sum((x[a] - mean[a]) * (x[b] - mean[b]) for x in fit) / n) for b in range(d)] for a in range(d)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = []
    for i, x in good:
        apart = np.array([float(c - m) for c, m in zip(x, mean)])
        out.append((i, n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), apart @ vectors / np.sqrt(values), values / np.trace(v)))
    return out, values


def variants(docs, min_length=7, min_count=2, ratio=10, drop_every=31):
    """docs: ``(id, text)``; ``word -> (form, root, n, n_near, form_n)``."""
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if key is None else key}:{run}".encode())
            if h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    near = {w: [] for w in words}
    # One edit apart: one of the two without a letter, or both without the same one.
    holes = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].add(w)
    for w in words:
        met = {x for k in range(len(w)) for x in holes[w[:k], w[k + 1 :]]}
        met |= {w[:k] + w[k + 1 :] for k in range(len(w))} & words.keys()
        met.discard(w)
        for x in met:
            near[w].append(x)
            if len(x) < len(w):
                near[x].append(w)
    near = {w: set(xs) for w, xs in near.items()}
    forms = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = forms[w], root, words[w], len(near[w]), words.get(forms[w])
    return out


def toxic_features(text, lexicon, fold):
    """The two features by looking for every entry and phrase at every place."""
    folded = fold(text or "")
    phrases = [fold(p) for p in lexicon.exceptions]
    excused = [(k, k + len(p) - 1) for p in phrases for k in range(len(folded)) if folded.startswith(p, k)]
    total = 0.0
    for k, c in enumerate(folded):
        if c == " ":
            met = [w for e, w in lexicon.weights.items() if folded.startswith(" " + e, k)]
            if met and not any(a <= k < b for a, b in excused):
                total += max(met)
    if not total:
        return 0.0, 0.0
    return math.log1p(total), total / math.sqrt(folded.count(" ") - 1)
