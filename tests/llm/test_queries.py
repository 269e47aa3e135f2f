"""Registered queries against their SQL, and against the libraries or brute force where SQL has none."""

import hashlib
import os
import zlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest

from hazegrid.llm.queries import ORACLES, QUERIES
from tests.oracle_check import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def texts():
    rows = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) == []


def test_sentencepiece(spark, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = QUERIES["op7_sentencepiece"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id]) + [lib.eos_id()]
        made = len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == made


def test_token_files(spark, texts):
    import numpy as np
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True  # as the operator does
    rows = {r.doc_id: r for r in QUERIES["op8_token_files"](spark, SF_DIR).collect()}
    start = 0
    for doc_id in sorted(texts):
        ids = lib.encode(texts[doc_id], add_special_tokens=False).ids + [0]
        r = rows.pop(doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not rows


def test_suffix_dedup(spark, texts):
    from tests.llm.brute import repeated_bytes

    want = repeated_bytes(texts, 200)
    rows = QUERIES["op4_suffix_dedup"](spark, SF_DIR).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want
    assert len(rows) == len(texts)


def test_jaccard_join(spark, texts):
    from tests.llm.brute import jaccard_components

    want = jaccard_components(texts, 4, 85)
    rows = QUERIES["op5_jaccard_join"](spark, SF_DIR).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert len(rows) == len(texts)


def test_toxicity(spark):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scored = QUERIES["op6_toxicity"](spark, SF_DIR)
    assert scored.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    met = scored.join(labels, "doc_id")
    row = met.agg(
        F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"),
        F.min("score").alias("low"),
        F.max("score").alias("high"),
    ).first()
    assert row.right > 0.97 and 0 <= row.low < row.high <= 1
    held = met.where("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert held > 0.97


def test_toxicity_scores(spark, texts):
    """Each score against one computed by looking for every entry at every place."""
    from hazegrid.llm.common import table
    from hazegrid.llm.toxicity import fit, fold
    from tests.llm.brute import toxic_features

    docs = table(spark, SF_DIR, "documents")
    lexicon = fit(docs, table(spark, SF_DIR, "labels"))
    assert lexicon.weights
    rows = QUERIES["op6_toxicity"](spark, SF_DIR).collect()
    short = [r for r in rows if len(texts[r.doc_id]) < 4000]
    assert len(short) > 0.8 * len(rows) and any(r.predicted for r in short)
    for r in short:
        assert abs(r.score - lexicon.score(toxic_features(texts[r.doc_id], lexicon, fold))) < 1e-12
        assert r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_embeddings(spark):
    from tests.llm.brute import cosine_links

    rows = pq.read_table(f"{SF_DIR}/embeddings.parquet").to_pylist()
    want = cosine_links([(r["vec_id"], r["embedding"], r["label"]) for r in rows], 0.98)
    got = QUERIES["op9_embedding_dedup"](spark, SF_DIR).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want


def test_token_counts(spark, texts):
    from hazegrid.llm.token_counts import WordCounter
    from tests.llm.brute import greedy_pieces

    path = public_tokenizers.path("word_bpe_49k.json")
    counter = WordCounter(path)
    rows = {r.doc_id: r for r in QUERIES["op10_token_counts"](spark, SF_DIR).collect()}
    known = {}
    for doc_id, text in texts.items():
        words = counter.find(text.lower())
        for w in words:
            if w not in known:
                known[w] = greedy_pieces(path, w)
        assert (rows[doc_id].n_words, rows[doc_id].n_tokens) == (len(words), sum(known[w] for w in words))
    assert len(rows) == len(texts)


def test_pipeline(spark):
    """Each stage against a plain computation of its rule over the rows it gets."""
    import sentencepiece
    import corpus_pipeline as cp
    from hazegrid.llm.common import staged, table
    from tests.llm import brute

    docs = table(spark, SF_DIR, "documents")
    columns = docs.columns
    seen = []
    for name, stage in cp.STAGES:
        before = {r.doc_id: r.text or "" for r in docs.collect()}
        docs = staged(stage(spark, docs, SF_DIR), "test-stage")
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
        seen.append(name)
        if name == "toxicity":
            toxic = {r.doc_id for r in QUERIES["op6_toxicity"](spark, SF_DIR).where("predicted = 1").collect()}
            assert set(after) == set(before) - toxic and all(after[i] == before[i] for i in after)
        elif name == "line dedup":
            want = brute.line_dedup(before)
            assert after == {i: t for i, t in want.items() if t.strip(" ") or t == before[i]}
        elif name == "n-gram Jaccard join":
            want = brute.jaccard_components(before, 5, 80)
            assert set(after) == {i for i in before if want[i][1] == i}
        elif name == "benchmark decontamination":
            items = [r.text for r in table(spark, SF_DIR, "benchmark").collect()]
            assert set(after) == {i for i, t in before.items() if not brute.leaks(t, items, 10)}
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = docs.collect()
    assert len(rows) == len(before)
    for r in rows:
        ids = lib.encode(before[r.doc_id])
        assert list(r.ids) == ids + [lib.eos_id()] and r.decoded == lib.decode(ids)
    assert len(seen) == 5
