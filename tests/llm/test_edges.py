"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import public_tokenizers
import pytest

from tests.llm import brute

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 977} Zahl{i % 31}" for i in range(30_000))
ODD = [
    (1, None),
    (2, ""),
    (3, "   "),
    (4, "\n\n\t\x0b"),
    (5, LONG),
    (5, LONG),
    (None, "a null id with some words in it"),
    (7, "  two  spaces, ▁marks▁ and others 　 日本語 \U0001f600 "),
    (8, "</s><s><unk><|endoftext|> as text"),
    (9, "x" * 5_000),
]


# -- URL filter

RULES = [("org", "/", "allow"), ("a.org", "/x", "block"), ("b.org", "/", "block"), ("b.org", "/", "allow"), (None, "/", "block")]


def judged(spark, urls, rules=RULES, extra=""):
    from hazegrid.llm.url_filter import judge_urls

    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    for c in extra.split():
        from pyspark.sql import functions as F

        pages = pages.withColumn(c, F.lit("clash"))
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r.page_id: r for r in judge_urls(pages, listed).collect()}


def test_url_rules(spark):
    urls = [
        "http://A.org/x/1", "https://sub.a.org/y", "http://aa.org/x", "http://b.org/", "http://b.org", None, "", "nothing",
        "HTTP://Ä.ORG/Q?x=http://a.org/x", "ftp://org/", "http://xorg/", "http://a.org/x/1", "://a.org/x#y", "http://a.org?/x",
    ]
    rows = judged(spark, urls, extra="rule host")
    assert [rows[i].rule for i in range(len(urls))] == [
        "a.org/x", "org/", "org/", "b.org/", None, None, None, None, "org/", "org/", None, "a.org/x", "a.org/x", None,
    ]
    assert [rows[i].verdict for i in (0, 1, 3, 4, 5)] == ["block", "allow", "block", "allow", "allow"]
    assert (rows[8].host, rows[8].path) == ("Ä.org", "/Q") and (rows[5].host, rows[5].path) == ("", "")


def test_url_empty(spark):
    assert judged(spark, []) == {}
    assert judged(spark, ["http://a.org/"], [])[0].verdict == "allow"


def test_url_many_rules(spark):
    """Beyond the broadcast bounds; false positives of a tiny filter change nothing."""
    from hazegrid.llm import url_filter

    rules = [(f"h{i}.net", f"/p{i % 7}", "block") for i in range(300)]
    urls = [f"http://www.h{i}.net/p{i % 5}/q" for i in range(400)]
    old = url_filter.BROADCAST_RULES, url_filter.BROADCAST_EXACT, url_filter.BITS_PER_KEY
    url_filter.BROADCAST_RULES = url_filter.BROADCAST_EXACT = 0
    url_filter.BITS_PER_KEY = 1
    try:
        rows = judged(spark, urls, rules)
    finally:
        url_filter.BROADCAST_RULES, url_filter.BROADCAST_EXACT, url_filter.BITS_PER_KEY = old
    for i, r in rows.items():
        assert r.rule == (f"h{i}.net/p{i % 7}" if i < 300 and i % 5 == i % 7 else None)


# -- decontamination


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_leaks(spark, frame, bound):
    from hazegrid.llm.decontaminate import find_leaks

    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short, item!"), (3, None), (4, " ."),
             (None, "no id here"), (2, "another one of two"), (5, "x y x y x y x y x y x y")]
    docs = [(1, "Zero ONE two-three four/five six seven eight nine ten; end. SHORT item"), (2, None), (3, ""),
            (4, "x y " * 9), (5, "no id here and another one of two"), (6, "short items"), (6, "short items"),
            (None, "short item"), (8, LONG + " short item " + LONG)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = find_leaks(frame(docs, "n_hit"), bench, broadcast_words=bound).collect()
    assert len(rows) == len(docs)
    by = {(r.doc_id, r.text): r for r in rows}
    for key, text in docs:
        r, want = by[key, text], brute.leaks(text, [i[1] for i in items], 10)
        hit = want[1] if want else set()
        assert r.n_hit == len(hit) and r.n_words == len(brute._leak_words(text))
        assert r["items"] == sorted({items[k][0] for k in want[0]} - {None}) if want else r["items"] == []
        assert {p for s in r.spans for p in range(s["first"], s["last"] + 1)} == hit


def test_leaks_beyond_the_broadcast_are_verified(spark, frame):
    """A hash that many windows share proves nothing."""
    from hazegrid.llm.decontaminate import find_leaks

    items = [f"item{k} has words{k} of its own" for k in range(300)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = [(i, f"document {i} item{i} has words{i} of its own and goes on" if i % 5 == 0 else f"document {i} has words of its own") for i in range(200)]
    rows = find_leaks(frame(docs), bench, broadcast_words=0, hash_bytes=1).collect()
    assert len(rows) == 200
    for r in rows:
        want = (6, [r.doc_id], [(2, 7)]) if r.doc_id % 5 == 0 else (0, [], [])
        assert (r.n_hit, r["items"], [tuple(s) for s in r.spans]) == want and r.n_words == len(r.text.split())


def test_leaks_removed(spark, frame):
    from hazegrid.llm.decontaminate import remove_leaks

    bench = spark.createDataFrame([(1, "bad words here")], "item_id bigint, text string")
    docs = frame([(1, "Keep this. Bad, words here! And this."), (2, None), (3, "clean")], "spans")
    assert {r.doc_id for r in remove_leaks(docs, bench).collect()} == {2, 3}
    rows = {r.doc_id: r for r in remove_leaks(docs, bench, action="spans").collect()}
    assert rows[1].text == "Keep this. ! And this." and rows[2].text is None and rows[3].spans == "x"
    assert remove_leaks(docs.limit(0), bench).count() == 0
    assert remove_leaks(docs, bench.limit(0)).count() == 3


# -- line dedup


def test_lines(spark, frame):
    from hazegrid.llm.line_dedup import dedup_lines

    three = "a line\nb line\nc line"
    docs = [(1, three), (2, f"top\n\na line\nb line\n \nc line\nend"), (3, f"{three}\nd line\n{three}"), (4, None), (5, ""),
            (6, "a line\nb line"), (7, "q\nq\nq\nq"), (9, three), (9, three), (None, three), (10, "\n\n\n\n")]
    rows = dedup_lines(frame(docs, "n_lines")).collect()
    got = sorted(((r.doc_id or 99, r.text) for r in rows), key=str)
    assert got == sorted(
        [(1, three), (2, "top\n\n \nend"), (3, "d line"), (4, None), (5, ""), (6, "a line\nb line"), (7, "q"), (9, ""), (9, ""),
         (99, ""), (10, "\n\n\n\n")], key=str
    )
    by = {r.doc_id: r for r in rows}
    assert (by[2].n_lines, by[2].n_removed, by[4].n_lines, by[5].n_lines) == (7, 3, 0, 1)
    assert dedup_lines(frame([])).count() == 0


def test_lines_in_pipeline(spark, frame):
    """A copy whose paragraphs are parted by empty lines goes as a whole; texts that lost nothing stay."""
    from corpus_pipeline import line_dedup

    apart = "a line\n\n \nb line\n\nc line"
    docs = [(1, apart), (2, apart), (3, f"\n{apart}\n  \n"), (4, f"{apart}\n\nan end"), (5, "a line\nb line\nc line"), (6, None),
            (7, ""), (8, " \n\n"), (9, f"{apart}\n\t"), (10, f"q\n\n{apart}")]
    rows = line_dedup(spark, frame(docs, "lang"), "").collect()
    assert {(r.doc_id, r.text, r.lang) for r in rows} == {
        (1, apart, "x"), (4, "\n \n\n\nan end", "x"), (6, None, "x"), (7, "", "x"), (8, " \n\n", "x"), (9, "\n \n\n\t", "x"),
        (10, "q\n\n\n \n", "x"),
    }


# -- suffix dedup


def test_bytes(spark, frame):
    from hazegrid.llm.suffix_dedup import dedup_bytes

    import random

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij é☃\n") for _ in range(n))
    p, q = word(400), word(205)
    docs = {
        1: word(300) + p + word(50), 2: p[100:] + word(220), 3: word(10) + p[:199], 4: None, 5: "", 6: word(500), 7: q + q,
        8: "z" * 450, 9: word(199), 10: word(600), 12: p[7:] + q[3:] + word(90), 13: q[:-1] + "!", 14: LONG,
    }
    docs[11] = docs[10]
    want = brute.repeated_bytes({i: t or "" for i, t in docs.items()}, 200)
    import hashlib

    rows = dedup_bytes(frame(list(docs.items()), "kept")).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows}
    assert got == want and len(rows) == len(docs)
    assert dedup_bytes(frame([])).count() == 0


def test_bytes_large_side(spark, frame, monkeypatch):
    from hazegrid.llm import common, suffix_dedup

    monkeypatch.setattr(common, "BROADCAST_ITEMS", -1)
    docs = {i: f"{i} " + "the same passage of words " * 3 + "abc" * 60 + str(i) for i in range(20)}
    rows = suffix_dedup.dedup_bytes(frame(list(docs.items()))).collect()
    want = brute.repeated_bytes(docs, 200)
    assert {r.doc_id: (r.n_bytes, r.n_removed) for r in rows} == {i: w[:2] for i, w in want.items()}


# -- Jaccard join


@pytest.mark.parametrize("bound", [4, 1024])
def test_jaccard(spark, frame, bound):
    """Chains and large groups whose members are partly too far from each other."""
    import random

    from hazegrid.llm.jaccard_join import jaccard_groups

    rng = random.Random(3)
    texts = {}
    for group in range(4):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 30, 90]))]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randrange(1 + len(base) // 25)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(5000)}"
            texts[len(texts) + 1] = " ".join(words)
            base = words if rng.random() < 0.5 else base
    for t in ["A b c", "a B c", "a b", "one", "one", "", None, LONG, LONG + " more", "a b c d e f g h i", "a b c d e f g h i j"]:
        texts[len(texts) + 1] = t
    rows = jaccard_groups(frame([*texts.items(), (None, "a b c")], "n_shingles"), region_docs=bound).collect()
    want = brute.jaccard_components(texts, 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id} == want
    assert [r.component_id for r in rows if r.doc_id is None] == [None] and len(rows) == len(texts) + 1


def test_jaccard_unrelated_sets_share_no_bucket():
    """Keys of random sets, whose filled parts may be few."""
    import numpy as np

    from hazegrid.llm.jaccard_join import SizeClasses, keys_of

    rng = np.random.default_rng(3)
    for percent, low, high in ((80, 60, 300), (85, 6, 60)):
        classes, seen, least = SizeClasses(percent), {}, 0
        for k in range(6_000):
            hashes = np.sort(rng.integers(0, 2**63, rng.integers(low, high), np.uint64) * np.uint64(2))
            keys, need = keys_of(hashes, classes)
            least = max(least, need)
            for key in keys.tolist():
                seen.setdefault(key, set()).add(k)
        assert max(map(len, seen.values())) == 1 and least > 1


def test_jaccard_linked_sets_share_a_key():
    """Whichever parts the differing shingles fall in, and however few are filled."""
    import numpy as np

    from hazegrid.llm.jaccard_join import SizeClasses, keys_of

    rng = np.random.default_rng(4)
    for percent in (80, 85):
        classes = SizeClasses(percent)
        for _ in range(4_000):
            union = rng.integers(5, 90)
            both = -(-percent * union // 100)
            shared = rng.integers(0, 2**63, both, np.uint64)
            if rng.random() < 0.5:  # crowded into few parts
                shared = shared >> np.uint64(int(rng.integers(1, 40)))
            rest = rng.integers(0, 2**63, union - both, np.uint64)
            cut = rng.integers(0, len(rest) + 1)
            a, b = (np.unique(np.concatenate([shared, r])) for r in (rest[:cut], rest[cut:]))
            (keys_a, need_a), (keys_b, need_b) = keys_of(a, classes), keys_of(b, classes)
            if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) and (len(a) != len(b) or (a != b).any()):
                met = len(np.intersect1d(keys_a, keys_b))
                assert met >= max(need_a, need_b, 1)


def test_keep_one_of_repeated_ids(spark, frame):
    """Rows of one id are documents each: unrelated texts stay, whatever their ids."""
    from hazegrid.llm.jaccard_join import keep_one

    texts = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(6)]
    near = texts[0].replace("w0x39", "other")
    docs = [(1, texts[0]), (2, texts[1]), (2, near), (3, texts[2]), (3, texts[3]), (3, texts[3]), (4, texts[2]), (None, texts[0]), (5, None), (5, "")]
    kept = keep_one(frame(docs, "__node")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted(
        [(1, texts[0]), (2, texts[1]), (3, texts[2]), (3, texts[3]), (0, texts[0]), (5, ""), (5, "")]
    )


def test_jaccard_small(spark, frame, monkeypatch):
    from hazegrid.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    assert jaccard_join.jaccard_groups(frame([])).count() == 0
    words = " ".join(f"w{i}" for i in range(100))
    docs = frame([(3, words), (3, words), (5, words + " end"), (6, None), (7, ""), (None, words), (8, "other")], "lang")
    kept = jaccard_join.keep_one(docs).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 3, 6, 7, 8] and kept[0].lang == "x"


def in_one_region(monkeypatch):
    """All ids belong to the region of document 1; returns where the units of the joins are counted."""
    from pyspark.sql import functions as F

    from hazegrid.llm import jaccard_join

    join, counts = jaccard_join._join_units, []

    def counted(rows, percent):
        counts.append(rows.select("unit").distinct().count())
        return join(rows, percent)

    def regions(shared, least):
        return least.where("id <> 1").select(F.lit(1).cast("bigint").alias("pivot"), "id")

    monkeypatch.setattr(jaccard_join, "_join_units", counted)
    monkeypatch.setattr(jaccard_join, "_regions", regions)
    return counts


@pytest.mark.parametrize("empty", [[], [(7, None), (1, "")]])
def test_jaccard_repeated_id_in_rings(spark, frame, monkeypatch, empty):
    """One text of document 7 links to the pivot, the other is far from it and links to document 9."""
    from hazegrid.llm.jaccard_join import jaccard_groups

    in_one_region(monkeypatch)
    near = [f"w{i}" for i in range(100)]
    far = near[:40] + [f"v{i}" for i in range(60)]
    docs = [(1, near), (7, [*near, "x"]), (7, far), (9, [*far, "y"]), (10, far[30:]), (11, far[40:] + near[:9])]
    rows = jaccard_groups(frame([*[(i, " ".join(t)) for i, t in docs], *empty]), region_docs=2).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(1, 1), (7, 1), (9, 1), (10, 10), (11, 11)}
    assert len(rows) == len(docs) + len(empty)


def test_jaccard_far_ring(spark, frame, monkeypatch):
    """Groups far from the pivot are parted by pivots of their own, not by pairs of all blocks."""
    import random
    from itertools import combinations

    from hazegrid.llm.jaccard_join import jaccard_groups

    counts, rng = in_one_region(monkeypatch), random.Random(4)
    docs = [(1, " ".join(f"p{i}" for i in range(60)))]
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(60)]
        for _ in range(14):
            words = list(base)
            words[rng.randrange(60)] = f"n{rng.randrange(5000)}"
            docs.append((2 + len(docs), " ".join(words)))
            base = words if rng.random() < 0.3 else base
    docs += [(docs[k][0], docs[k + 14][1] + " end") for k in (3, 17)]  # ids of two groups each
    rows = jaccard_groups(frame(docs), region_docs=4).collect()
    groups, sets = brute.Groups([i for i, _ in docs]), [(i, brute.shingles(t, 4)) for i, t in docs]
    for (i, a), (j, b) in combinations(sets, 2):
        if 100 * len(a & b) >= 85 * len(a | b):
            groups.join(i, j)
    assert {(r.doc_id, r.component_id) for r in rows} == {(i, groups.find(i)) for i, _ in docs}
    assert len(rows) == len(docs) and len({r.component_id for r in rows}) > 3
    assert counts[0] < 150  # 56 documents in blocks of two: some 300 pairs of blocks


# -- toxicity


def test_toxicity(spark, frame):
    from hazegrid.llm.toxicity import Lexicon, drop_toxic, fit, fold, score_texts

    assert fold("Ｉdіоt, 1D10T! a 100 m0ron") == " idiot idiot a 100 moron "
    lexicon = Lexicon({"idiot": 5.0, "trash": 4.0}, intercept=-2.0, per_hit=2.0)
    docs = frame([(1, "you 1di0t"), (2, "the trash can"), (3, None), (4, ""), (5, LONG), (6, "TRASH"), (6, "TRASH")], "score")
    rows = score_texts(docs, lexicon).collect()
    assert {(r.doc_id, r.predicted) for r in rows} == {(1, 1), (2, 0), (3, 0), (4, 0), (5, 0), (6, 1)} and len(rows) == 7
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in drop_toxic(docs, lexicon).collect()} == {2, 3, 4, 5}
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id bigint, toxic int")
    assert fit(docs, labels).weights == {} and fit(docs.limit(0), labels.limit(0)).weights == {}


def test_toxicity_learns(spark, frame):
    from hazegrid.llm.toxicity import fit, score_texts

    docs = [(i, f"plain words number{i % 9} here" + (" Dummkopf" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    lexicon = fit(frame(docs), labels)
    assert list(lexicon.weights) == ["dumm"]
    rows = score_texts(frame(docs), lexicon).collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in rows)
    sampled = fit(frame(docs), labels, sample_rows=150)
    assert "dumm" in sampled.weights


def test_toxicity_learns_exceptions(spark, frame):
    """A toxic word beside one that only clean texts put there counts nothing."""
    from hazegrid.llm.toxicity import fit, score_texts

    docs = [(i, ("you dummkopf" if i % 4 else f"dummkopf {['du', 'er', 'so'][i % 3]}") + " there") for i in range(200)]
    docs += [(i, "the dummkopf museum is open" if i % 40 == 0 else f"plain words number{i % 9} here") for i in range(200, 1800)]
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in docs], "doc_id bigint, toxic int")
    lexicon = fit(frame(docs), labels)
    assert "dumm" in lexicon.weights and "dummkopf museum" in lexicon.exceptions and "you dummkopf" not in lexicon.exceptions
    rows = score_texts(frame([(1, "see the dummkopf museum"), (2, "see the Dummkopf there")]), lexicon).collect()
    assert {r.doc_id: r.predicted for r in rows} == {1: 0, 2: 1}
    assert "of the day" in fit(frame(docs), labels, exceptions=["of the day"]).exceptions


def test_toxicity_null_ids_and_threshold(spark, frame):
    from hazegrid.llm.toxicity import Lexicon, drop_toxic, fit, score_texts

    lexicon = Lexicon({"idiot": 5.0}, intercept=0.0)
    docs = frame([(None, "an idiot"), (1, "fine"), (None, None)])
    # A score at the threshold itself is toxic.
    assert [(r.score, r.predicted) for r in score_texts(docs, lexicon).collect()] == [(0.5, 1)] * 3
    assert drop_toxic(docs, lexicon).count() == 0
    labels = spark.createDataFrame([(None, 1), (None, 0)], "doc_id bigint, toxic int")
    assert fit(docs, labels).weights == {}


# -- SentencePiece


def test_encode_decode_clashing_columns(spark, frame):
    import sentencepiece

    from hazegrid.llm.sentencepiece_codec import encode_decode

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = frame([(1, "some text"), (None, None), (3, "")], "decoded").withColumnRenamed("doc_id", "ids")
    rows = encode_decode(docs, PIECES).collect()
    assert sorted((r.text or "", r.decoded, tuple(r.ids)) for r in rows) == sorted(
        (t, lib.decode(lib.encode(t)), (*lib.encode(t), lib.eos_id())) for t in ("some text", "", "")
    )


def test_pieces(spark, frame):
    import hashlib

    import sentencepiece

    from hazegrid.llm.sentencepiece_codec import decode, encode, round_trip

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = decode(encode(frame(ODD, "ids"), PIECES), PIECES).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        ids = lib.encode(r.text or "")
        assert list(r.ids) == ids + [lib.eos_id()] and r.decoded == lib.decode(ids)
    for r in round_trip(frame(ODD, "n_tokens"), PIECES).collect():
        ids = lib.encode(r.text or "") + [lib.eos_id()]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert round_trip(frame([]), PIECES).count() == 0


def test_piece_table_bound():
    from hazegrid.llm.sentencepiece_codec import ChunkTable

    table = ChunkTable(PIECES, size=3)
    for text in ("one two three four five", "five six", "one"):
        assert [int(i) for e in table.entries(text) for i in e[1].split()] == table.lib.encode(text)


# -- token files


def test_files(spark, frame, tmp_path):
    import numpy as np
    from tokenizers import Tokenizer

    from hazegrid.llm.token_file import SequenceFile, read_token_files, write_token_files

    lib = Tokenizer.from_file(BYTES)
    lib.encode_special_tokens = True
    manifest = write_token_files(frame(ODD, "start"), BYTES, public_tokenizers.PATTERN, length=64, folder=str(tmp_path / "f"))
    rows = read_token_files(manifest).collect()
    assert len(rows) == len(ODD)
    texts = {i: t or "" for i, t in ODD}
    rows.sort(key=lambda r: r.start)
    assert [r.id for r in rows] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i))
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(lib.encode(texts[r.id], add_special_tokens=False).ids) + 1)
        at += r.n_tokens
    total, offset = 0, 0
    for row in sorted(manifest.collect(), key=lambda r: r.part):
        with SequenceFile(row.file) as f:
            masks = [f.sequence(i)[1] for i in range(len(f))]
            assert sum(int(m.sum()) for m in masks) == row.n_ids and all(len(m) == 64 for m in masks)
            assert not f.sequence(0)[0].flags.owndata
            flat = np.concatenate([f.sequence(i)[0] for i in range(len(f))])[: row.n_ids]
            for r in rows:
                if offset <= r.start < offset + row.n_ids:
                    ids = lib.encode(texts[r.id], add_special_tokens=False).ids + [0]
                    assert flat[r.start - offset :][: len(ids)].tolist() == ids
        total, offset = total + row.n_docs, offset + row.n_ids
    assert total == len(ODD)
    empty = write_token_files(frame([]), BYTES, public_tokenizers.PATTERN, folder=str(tmp_path / "g"))
    assert empty.count() == 0 and read_token_files(empty).count() == 0


def test_masks_take_little_room(tmp_path):
    """Full sequences share their mask in the file; ends that fill a sequence, a batch or neither."""
    import numpy as np
    import pyarrow as pa

    from hazegrid.llm.token_file import BATCH_SEQUENCES, SequenceFile, _Sequences

    batch = 64 * BATCH_SEQUENCES
    for n in (1, 63, 64, 65, 128, batch - 1, batch, batch + 1, 2 * batch + 70):
        path = tmp_path / f"{n}"
        with pa.OSFile(f"{path}.arrow", "wb") as sink:
            sequences = _Sequences(sink, "<u2", 64)
            for at in range(0, n, 1000):
                sequences.add(np.arange(at, min(n, at + 1000)).astype("<u2"))
            sequences.close()
        with SequenceFile(f"file:{path}") as f:
            assert len(f) == -(-n // 64)
            ids, masks = (np.concatenate(x) for x in zip(*[f.sequence(i) for i in range(len(f))], strict=True))
            assert masks.tolist() == [1] * n + [0] * (-n % 64)
            assert ids[:n].tolist() == (np.arange(n) % 65536).tolist() and not ids[n:].any()
            assert all(not x.flags.owndata for x in f.sequence(len(f) - 1))
        # Two bytes an id; before, a third went to the mask.
        assert path.with_suffix(".arrow").stat().st_size < 2 * len(masks) + 4096


def test_files_in_the_default_file_system(spark, frame, tmp_path):
    """A folder without a scheme is one of Hadoop's default file system, not of each machine."""
    from hazegrid.llm.token_file import SequenceFile, read_token_files, write_token_files
    from hazegrid.session import qualified

    manifest = write_token_files(frame([(1, "a b"), (2, None)]), BYTES, public_tokenizers.PATTERN, folder=f"{tmp_path}/my files")
    assert read_token_files(manifest).count() == 2
    files = [r.file for r in manifest.collect()]
    assert all(f.startswith("file:/") for f in files)
    with SequenceFile(files[0]) as f:
        ids, mask = f.sequence(0)
        assert not mask.flags.owndata and mask.dtype == "uint8" and len(ids) == len(mask)
    default = spark._jsc.hadoopConfiguration().get("fs.defaultFS")
    spark._jsc.hadoopConfiguration().set("fs.defaultFS", "viewfs://store/")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    try:
        assert qualified(spark, "/in/x") == "viewfs://store/in/x"
    finally:
        spark._jsc.hadoopConfiguration().set("fs.defaultFS", default)


def test_files_where_only_spark_has_access(spark, frame, tmp_path):
    """Arrow cannot open viewfs; the files are the same as those of a local folder."""
    from hazegrid.llm.token_file import SequenceFile, read_token_files, write_token_files

    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tokens.link./in", f"file://{tmp_path}")

    def made(rows, folder):
        manifest = write_token_files(frame(rows), BYTES, public_tokenizers.PATTERN, length=64, folder=folder, files=3)
        read = read_token_files(manifest)
        return read.dtypes, sorted(map(repr, read.collect())), sorted(manifest.drop("file").collect(), key=lambda r: r.part)

    rows = [(i, f"{i} words and \u00e4\u4e16 " * (i % 50)) for i in range(300)] + [(None, "no id"), (7, None)]
    want = made(rows, f"file:{tmp_path}/local")
    (tmp_path / "store").mkdir()
    (tmp_path / "store/part-000009.arrow").write_text("not of this run")
    for _ in range(2):  # the second run replaces the files of the first
        assert made(rows, "viewfs://tokens/in/store") == want
    files = [f"part-{r.part:06d}.{kind}" for r in want[2] for kind in ("arrow", "docs")]
    found = {f.name for f in (tmp_path / "store").iterdir() if not f.name.endswith(".crc")}
    assert found == {*files, "part-000009.arrow"} and len(files) == 6
    for name in files:
        assert (tmp_path / "store" / name).read_bytes() == (tmp_path / "local" / name).read_bytes()
    with SequenceFile(f"file:{tmp_path}/store/part-000000") as f:
        assert not f.sequence(0)[0].flags.owndata
    assert made([], "viewfs://tokens/in/none") == (want[0], [], [])


def test_files_below_the_shared_folder_of_a_cluster(spark, frame, tmp_path, monkeypatch):
    """What everything else is staged in serves the files too; another folder of one machine is refused."""
    from hazegrid.llm.token_file import read_token_files, write_token_files

    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr("hazegrid.session.shared_folder", lambda spark: f"{tmp_path}/shared")
    manifest = write_token_files(frame([(1, "a b"), (2, None)]), BYTES, public_tokenizers.PATTERN)
    assert read_token_files(manifest).count() == 2
    with pytest.raises(RuntimeError, match="one machine"):
        write_token_files(frame([(1, "a b")]), BYTES, public_tokenizers.PATTERN, folder=f"{tmp_path}/own")


# -- embeddings


def near_pairs(n, dim, seed):
    """Random unit vectors; every tenth has a partner with a cosine from 0.98 to 0.99."""
    import numpy as np

    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    k = n // 10
    away = rng.normal(size=(k, dim))
    away -= (away * x[:k]).sum(axis=1, keepdims=True) * x[:k]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cos = rng.uniform(0.9801, 0.99, k)[:, None]
    x[k : 2 * k] = cos * x[:k] + np.sqrt(1 - cos**2) * away
    return x


def vector_frame(spark, x):
    import pandas as pd

    rows = pd.DataFrame({"vec_id": range(len(x)), "embedding": list(x)})
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS label")


@pytest.mark.parametrize("dim", [64, 256])
def test_vectors_recall(spark, dim):
    import numpy as np

    from hazegrid.llm.embedding_dedup import near_vectors

    x = near_pairs(6_000, dim, 5)
    near = np.triu(x @ x.T >= 0.98, 1)
    want = near.sum()
    got = near_vectors(vector_frame(spark, x)).agg({"n_links": "sum"}).first()[0] / 2
    assert want >= 600 and 0.99 * want <= got <= want


@pytest.mark.parametrize("dim", [64, 256])
def test_vectors_met_fall_with_the_rows(spark, dim):
    """The share of a label's pairs that share a cell."""
    import math

    from pyspark.sql import functions as F

    from hazegrid.llm import embedding_dedup as E

    gap, shares = math.sqrt(2 - 2 * E.THRESHOLD), []
    for n in (1_000, 4_000, 16_000):
        rows = E._classes(vector_frame(spark, near_pairs(n, dim, 6)), "vec_id", "embedding", "label")
        classes = rows.withColumn("number", F.monotonically_increasing_id())
        cells = E._members(classes, gap).select("turn", "cell", "size").distinct()
        shares.append(cells.agg(F.sum(F.expr("size * (size - 1) / 2"))).first()[0] / (n * (n - 1) / 2))
    assert shares[0] == 1 and shares[1] < 0.2 and shares[2] < 0.5 * shares[1]


def test_vectors_in_a_crowd(spark):
    """A cell of many near vectors is cut into blocks; each pair counts once, whatever tables it meets in."""
    import numpy as np

    from hazegrid.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(8)
    x = near_pairs(3_000, 32, 7)
    x[2000:2400] = x[0] + rng.normal(size=(400, 32)) * 0.01
    near = x @ x.T / np.linalg.norm(x, axis=1) / np.linalg.norm(x, axis=1)[:, None] >= 0.98
    want = near.sum(axis=1) - 1
    rows = near_vectors(vector_frame(spark, x), block=128).collect()
    got = {r.vec_id: r.n_links for r in rows}
    missed = sum(int(w) - got[i] for i, w in enumerate(want))
    assert 0 <= missed <= 0.001 * want.sum() and all(got[i] <= w for i, w in enumerate(want))


def test_vectors(spark, monkeypatch):
    import numpy as np

    from hazegrid.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(11)
    base = rng.normal(size=(12, 16))
    rows = []
    for k in range(240):
        v = base[k % 12] + rng.normal(size=16) * (0.02 if k % 3 else 0.12)
        rows.append((k, [float(x) for x in v * rng.uniform(0.1, 50)], k % 2 if k % 17 else None))
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [float("inf")] * 16, 1),
             (305, rows[1][1], 1), (306, rows[1][1], 1), (307, rows[1][1], 0), (308, [1.0, None], 1), (309, rows[1][1][:8], 1)]
    want = brute.cosine_links(rows, 0.98)
    for block in (2048, 7):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
        got = near_vectors(df, block=block).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.component_id == r.vec_id) for r in got} == want
        assert len(got) == len(rows)
    df = spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1)], "vec_id bigint, embedding array<float>, label int")
    assert sorted((r.vec_id or 0, r.n_links) for r in near_vectors(df).collect()) == [(0, 0), (1, 0)]
    assert near_vectors(df.limit(0)).count() == 0


def test_components(spark):
    from hazegrid.llm.components import components

    links = [(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 100), (7, 7), (None, 3), (200, 201), (201, 202), (202, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 90: 90, 100: 90, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- token counts


def test_counts(spark, frame):
    from hazegrid.llm.token_counts import LongestMatch, WordCounter, count_tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    counter = WordCounter(path)
    for r in count_tokens(frame(ODD, "n_words"), path).collect():
        words = counter.find((r.text or "").lower())
        assert (r.n_words, r.n_tokens) == (len(words), sum(brute.greedy_pieces(path, w) for w in words))
    assert count_tokens(frame([]), path).count() == 0
    small = LongestMatch([tuple(b"abc"), tuple(b"ab"), tuple(b"c"), tuple(b"b"), tuple(b"cde"), (*b"d", 256)])
    assert small.count([*b"abcd", 256]) == 2 and small.count([*b"abz"]) is None and small.count([*b"abcde"]) is None
    assert small.count([*b"abb"]) == 2 and small.count([]) == 0


def test_counts_composed(spark, frame):
    """Letters with combining marks count as the composed ones do; strings of added tokens are ordinary text."""
    import unicodedata

    from hazegrid.llm.token_counts import WordCounter, count_tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Café Été naïve Ångström", "Tiếng Việt", "한국어", "a <|endoftext|> b"]
    docs = [(2 * i + k, unicodedata.normalize(form, t)) for i, t in enumerate(texts) for k, form in enumerate(("NFC", "NFD"))]
    rows = {r.doc_id: (r.n_words, r.n_tokens) for r in count_tokens(frame(docs), path).collect()}
    find = WordCounter(path).find
    for i, t in enumerate(texts):
        words = find(t.lower())
        assert rows[2 * i] == rows[2 * i + 1] == (len(words), sum(brute.greedy_pieces(path, w) for w in words))
    assert rows[0][0] == 4 and rows[6][0] == 5
