"""Top-k search and whitening of integer vectors against plain computations."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hazegrid.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_queries import SF_DIR

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id bigint, embedding array<float>, score string, rank string, dim string"


def table(spark, rows, schema=SCHEMA):
    extra = schema.count(",") - 1
    return spark.createDataFrame([(*r, *["clash"] * extra) for r in rows], schema)


def drawn(n, dim, seed=0, spread=0.2):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(c)) for c in row]) for i, row in enumerate(rng.normal(size=(n, dim)) * spread)]


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], int(r.score), r.vec_id))
    return {q: sorted(rows) for q, rows in out.items()}


def expected(rows, queries, k=5):
    return {own: [(j + 1, s, i) for j, (s, i) in enumerate(best)] for own, best in brute.top_scores(rows, queries, k) if best}


ODD = [
    (1, None), (2, []), (3, [1.0, NAN]), (4, [INF, 0.0]), (5, [0.0, None]), (6, [0.0, 0.0]), (7, [-0.001, 0.5]),
    (8, [0.5, -0.5]), (9, [0.5, -0.5]), (10, [0.5, -0.5]), (None, [2.0, 2.0]), (12, [1.0, 1.0, 1.0]), (13, [0.25]), (14, []),
]


@pytest.mark.parametrize("block,entries", [(4096, 2_000_000), (64, 500), (7, 130)])
def test_top_k(spark, block, entries):
    from hazegrid.llm.topk_search import top_k

    rows = drawn(400, 16) + [(1000 + i, [0.5] * 16) for i in range(90)]
    df = table(spark, rows)
    asked = [r for r in rows if r[0] % 20 == 0]
    got = found(top_k(df, df.where("vec_id % 20 = 0"), block=block, query_entries=entries))
    assert got == expected(rows, asked)


def test_top_k_edges(spark):
    from hazegrid.llm.topk_search import top_k

    df = table(spark, ODD)
    got = found(top_k(df, df.where("vec_id IS NOT NULL"), k=3, block=4))
    assert got == expected(ODD, [r for r in ODD if r[0] is not None], 3)
    assert got[6] == [(1, 0, 7), (2, 0, 8), (3, 0, 9)] and 12 not in got
    assert 2 in got and got[2] == [(1, 0, 14)] and 1 not in got and 3 not in got
    # A query of a null id has no row of its own.
    own = found(top_k(df, df.where("vec_id IS NULL"), k=1))
    assert own == {None: [(1, 524288, None)]}


def test_top_k_repeats(spark):
    from hazegrid.llm.topk_search import top_k

    rows = [(1, [0.5, 0.5]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [0.25, 0.25]), (3, [0.75, 0.0])]
    df = table(spark, rows)
    got = top_k(df, df.where("vec_id = 1"), k=9).collect()
    assert sorted((r["rank"], r.vec_id, int(r.score)) for r in got) == [(1, 2, 65536), (2, 2, 65536), (3, 3, 24576), (4, 2, 16384)]
    assert top_k(df, df.where("vec_id = 2"), k=9).count() == 6  # three queries, each met by rows 1 and 3
    assert top_k(df.limit(0), df).count() == 0 and top_k(df, df.limit(0)).count() == 0


def test_top_k_large_values(spark):
    """Beyond what doubles hold exactly."""
    from hazegrid.llm.topk_search import top_k

    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.integers(-(2**40), 2**40, 8)]) for i in range(150)]
    df = table(spark, rows, "vec_id bigint, embedding array<double>")
    got = found(top_k(df, df.where("vec_id % 30 = 0"), block=32))
    assert got == expected(rows, [r for r in rows if r[0] % 30 == 0])


def test_top_k_stops_early():
    """Lists are not read to their ends, and the survivors are few."""
    from hazegrid.llm.topk_search import Lists

    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    lists = Lists(list(range(2000)), x)
    depths = []
    read = lists.read
    lists.read = lambda sides, first, last: (depths.append((first, last)), read(sides, first, last))[1]
    want = sorted(((-int(x[7] @ x[i]), i) for i in range(2000) if i != 7))[:5]
    floor = -want[-1][0]
    assert [(-s, p) for s, p in lists.search(x[7], 7, 5, floor)] == [(s, p) for s, p in want]
    assert depths[-2][1] <= 0.75 * 2000 and depths[-1] == (depths[-2][1], 2000)


# -- whitening


def check_whitened(rows, got, components=4):
    want, values = brute.whitened(rows, components)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert len(got) == sum(min(components, len(values)) for _ in want)
    plus = None
    for i, n, apart, made, share in want:
        mine = sorted(by[i], key=lambda r: r.component)[: len(made)]
        assert [r.component for r in mine] == list(range(1, len(made) + 1))
        assert {(r.n, int(r.deviation)) for r in mine} == {(n, apart)}
        assert np.allclose([r.explained for r in mine], share, rtol=1e-9)
        assert all(r.identity_error < 1e-8 for r in mine)
        mine = np.array([r.whitened for r in mine])
        if plus is None and (np.abs(made) > 1e-3).all():
            plus = np.sign(made) * np.sign(mine)
        if plus is not None:
            assert np.allclose(mine * plus, made, atol=1e-8)
    assert plus is not None


def test_whitening_query(spark):
    rows = pq.read_table(f"{SF_DIR}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pylist()
    got = QUERIES["op13_embedding_whitening"](spark, SF_DIR)
    assert dict(got.dtypes)["deviation"] == "bigint"
    check_whitened([(r["vec_id"], r["embedding"]) for r in rows], got.collect())


@pytest.mark.parametrize("block", [4096, 50])
def test_whitening(spark, block):
    from hazegrid.llm.whitening import whiten

    rows = [(i, [3 * c for c in v[:2]] + [10 * v[2], *v[3:]]) for i, v in drawn(300, 5)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # copies count once
    df = table(spark, rows)
    check_whitened([(i, [float(np.float32(c)) for c in v]) for i, v in rows], whiten(df, block=block).collect())


def test_whitening_edges(spark):
    from hazegrid.llm.whitening import whiten

    got = whiten(table(spark, ODD)).collect()
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == {6, 7, 8, 9, 10, None, 12, 13}
    assert [len(by[i]) for i in (6, 8, None, 12, 13)] == [2, 2, 2, 3, 1]
    assert {r.n for r in by[8]} == {4} and {r.n for r in by[12]} == {1}
    # One vector alone: nothing to scale by.
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in by[13]} == {(0, None, None, None)}
    again = table(spark, [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [0.0, 3.0]), (2, [1.0, -3.0])])
    assert whiten(again).count() == 8 and {r.n for r in whiten(again).collect()} == {3}
    assert whiten(again.limit(0)).count() == 0
    same = whiten(table(spark, [(i, [0.5, float(i)]) for i in range(5)])).collect()
    flat = [r for r in same if r.component == 2]
    assert all(r.whitened is None and r.explained == 0 for r in flat) and all(r.identity_error < 1e-9 for r in same)


def test_scatter_is_exact():
    from hazegrid.llm.whitening import scatter

    rng = np.random.default_rng(1)
    for top in (3, 200, 2**40, 2**53):
        x = rng.integers(-top, top, size=(130, 6))
        x[:, 2] = -5
        sums, products = scatter(x)
        big = x.astype(object)
        assert sums == [int(s) for s in big.sum(axis=0)]
        assert all(products[i][j] == int(big[:, i] @ big[:, j]) for i in range(6) for j in range(i, 6))


def test_whitening_large_values(spark):
    from hazegrid.llm.whitening import whiten

    rows = [(i, [c * 2.0**30 for c in v]) for i, v in drawn(60, 3)]
    got = whiten(table(spark, rows, "vec_id bigint, embedding array<double>")).collect()
    want, _ = brute.whitened(rows, 4)
    apart = {i: d for i, _, d, _, _ in want}
    assert all(int(r.deviation) == apart[r.vec_id] for r in got)
    assert all(r.identity_error < 1e-8 for r in got)
    narrow = whiten(table(spark, rows, "vec_id bigint, embedding array<double>")).select(F.col("deviation").try_cast("bigint"))
    assert narrow.where("deviation IS NOT NULL").count() == 0
