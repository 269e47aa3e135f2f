"""Spelling variants against a plain computation."""

import random

import pyarrow.parquet as pq
import pytest

from hazegrid.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_queries import SF_DIR


def rows_of(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query(spark):
    docs = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = rows_of(QUERIES["op12_spelling_variants"](spark, SF_DIR))
    assert got == brute.variants([(d["doc_id"], d["text"]) for d in docs])
    assert any(form for form, *_ in got.values())


def made_docs(seed=1, n=400):
    """Words of few letters and many lengths, so that most have near words."""
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abÿÀ") for _ in range(rng.randint(6, 10))) for _ in range(40)]
    docs = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = rng.choice(bases)
            if rng.random() < 0.4:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abÿ") + w[k + 1 :], w[:k] + "b" + w[k:]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        docs.append((i, rng.choice([" ", "-", "1", "ß? "]).join(words)))
    return docs


@pytest.mark.parametrize("block", [2048, 64])
def test_variants(spark, frame, block):
    """Small blocks cut the halves that many words share."""
    from hazegrid.llm.spelling import group_variants

    docs = made_docs()
    got = rows_of(group_variants(frame(docs, "word"), block=block))
    assert len(got) > 500 and got == brute.variants(docs)


def test_chains_and_ties(spark, frame):
    from hazegrid.llm.spelling import group_variants

    counts = {"abcdefgh": 2, "abcdefg": 20, "abcdefx": 200, "abcdeyx": 2000, "zzzzzzz": 5, "zzzzzza": 50, "zzzzzzb": 50, "short": 99, "singles": 1}
    docs = [(1, " ".join(w for w, n in counts.items() for _ in range(n)))]
    got = rows_of(group_variants(frame(docs), drop_every=0))
    assert got["abcdefgh"] == ("abcdefg", "abcdeyx", 2, 1, 20)
    assert got["abcdefg"] == ("abcdefx", "abcdeyx", 20, 2, 200) and got["abcdeyx"] == (None, "abcdeyx", 2000, 1, None)
    assert got["zzzzzzz"] == ("zzzzzza", "zzzzzza", 5, 2, 50) and got["zzzzzza"] == (None, "zzzzzza", 50, 2, None)
    assert "short" not in got and "singles" not in got


def test_edges(spark, frame):
    from hazegrid.llm.spelling import group_variants

    long = "x" * 3000
    docs = [(1, None), (2, ""), (3, " 12 "), (None, "Straßen straßen Äpfeläpfel äpfeläpfel"), (5, "twice twicefold"), (5, "twice twicefold"),
            (6, f"{long} {long} {long}y {long}y Ünïcödé Ünïcödé ünïcödé ünïcödé 日本語日本語日本語")]
    got = rows_of(group_variants(frame(docs, "n"), min_length=5, drop_every=0))
    assert got["twicefold"][2] == 2 and got["twice"][2] == 2
    assert got["straßen"][2] == 2 and "äpfeläpfel" not in got
    assert got["Ünïcödé"][3] == 1 and got["ünïcödé"][3] == 1
    assert got[long][3] == 1 and got[long + "y"][3] == 1
    assert rows_of(group_variants(frame(docs).limit(0))) == {}
    # A dropped letter, by the checksum of id and run.
    docs = [(i, "Remember") for i in range(400)]
    got = rows_of(group_variants(frame(docs)))
    assert got == brute.variants(docs) and len(got) > 1
    docs = [(None, "remember remembers remembers") for _ in range(3)]
    assert rows_of(group_variants(frame(docs))) == brute.variants(docs)


def test_single_letters(spark):
    from hazegrid.llm.spelling import near_words

    words = ["a", "b", "ab", "abc", "xyz"]
    got = {r.word: r.n_near for r in near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")).collect()}
    assert got == {"a": 2, "b": 2, "ab": 3, "abc": 1}
