import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import vafile
from tallyspark.llm.vafile import Grid, Search, best_in_order, exact_vectors, op3_exact_top_k, products, scaled, top_k


def brute(rows, every, k):
    v = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            w = [math.floor(256 * float(np.float32(x))) for x in e]
            v[i] = min(v[i], w) if i in v else w
    out = []
    for q in v:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v[q], w, strict=False)), i) for i, w in v.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def table(seed=1, n=400, d=8):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(size=d).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(5000, None), (5050, [1.0, None] * 4), (5100, [math.nan] * d), (5150, [math.inf] + [0.0] * 7), (5200, []), (5250, [1.0, 2.0]), (None, [1.0] * d), (50, rows[50][1]), (5300, [0.0] * d), (5350, [3e4, -2e4] * 4), (5400, [30_000.5] * d)]
    return rows


@pytest.mark.parametrize("blocks", [(64, 16_384, 2_048), (3, 50, 4)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, blocks):
    for name, value in zip(("LEAST_BLOCKS", "BLOCK_ROWS", "QUERY_ROWS"), blocks, strict=True):
        monkeypatch.setattr(vafile, name, value)
    rows = table()
    spark.createDataFrame([(e, i, 1) for i, e in rows], "embedding array<float>, vec_id long, score int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in op3_exact_top_k(spark, str(tmp_path)).collect())
    assert got == brute(rows, 50, 5)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    exact = np.floor(256 * rng.normal(size=(3000, 64))).astype(np.int64)
    grid = Grid(exact.min(axis=0), exact.max(axis=0))
    queries = exact[::100]
    middle, slack = grid.bounds(grid.codes(exact), queries)
    assert (products(exact, queries) == exact @ queries.T).all()
    assert (np.abs(exact @ queries.T - middle) <= slack).all()
    large = exact * 2**24
    assert (products(large, large[:5]) == large @ large[:5].T).all()


def test_few_vectors_are_read(spark):
    """Through the query's own steps on sf0.1: 2,000 vectors and 40 queries; the first step reads READ vectors a query."""
    vectors = exact_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    queries = vectors.where("vec_id % 50 = 0")
    search = Search(vectors, queries, 5)
    assert search.floors().count() == queries.count() == 40
    read = search.open_vectors(search.floored()).count() / search.query_blocks
    # Once for all 40 queries together: 262 vectors, under seven a query.
    assert 5 <= read <= 1.1 * 262


def test_vectors_are_scored_in_the_order_of_their_bounds():
    """A query stops once its k-th score is above every bound that is left, and finds what scoring all of them finds."""
    rng = np.random.default_rng(6)
    exact = np.floor(256 * rng.normal(size=(4000, 16))).astype(np.int64)
    exact[::7] = exact[3]
    ids = rng.permutation(4000)
    grid = Grid(exact.min(axis=0), exact.max(axis=0))
    for query in exact[1:4000:399]:
        middle, slack = grid.bounds(grid.codes(exact), query[None])
        rows, scores, read = best_in_order(exact, ids, query, middle[:, 0] + slack[0], 5)
        best = np.lexsort((ids, -(exact @ query)))[:5]
        assert ids[rows].tolist() == ids[best].tolist() and scores.tolist() == (exact @ query)[best].tolist()
        assert read < 1000


def test_components_beyond_exact_longs(spark):
    """Components up to the largest double: scores are exact, and count as the ends of a long beyond it."""
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.choice([0, 3, 8, 12, 16, 30, 300])).tolist()) for i in range(300)]
    rows += [(300, [1e16, 1e16, 0.0, 0.0]), (350, [1e16, -1e16, 1.0, 0.0]), (400, [0.0, 0.0, 3.0, 0.0]), (450, [1.7e308] * 4), (500, [-1.7e308] * 4)]
    df = spark.createDataFrame([(i, e, "x", 3) for i, e in rows], "vec_id long, embedding array<double>, block string, v int")
    end = 2**63 - 1
    ints = {i: [max(-end - 1, min(end, math.floor(256 * x) if abs(x) < 1e300 else int(math.copysign(end + 1, x)))) for x in e] for i, e in rows}
    expected = []
    for q in (i for i in ints if i % 50 == 0):
        scores = {i: max(-end - 1, min(end, sum(a * b for a, b in zip(ints[q], w, strict=True)))) for i, w in ints.items() if i != q}
        expected += [(q, n + 1, i, scores[i]) for n, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:5])]
    v = exact_vectors(df.drop("v")).withColumn("block", F.lit("b")).withColumn("query_id", F.lit(1))
    assert sorted(tuple(r) for r in top_k(v, v.where("vec_id % 50 = 0")).collect()) == sorted(expected)


def test_many_equal_vectors(spark):
    """A third of the rows are one vector: ties go to the smallest ids, and each block sends k rows a query."""
    rng = np.random.default_rng(3)
    rows = [(i, [2.0] * 6 if i % 3 == 0 else rng.normal(size=6).tolist()) for i in range(900)]
    v = scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted(tuple(r) for r in top_k(v, v.where("vec_id % 50 = 0")).collect())
    assert got == brute(rows, 50, 5)


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<float>")
    v = scaled(df)
    assert sorted(tuple(r) for r in top_k(v, v).collect()) == [(0, 1, 50, 256 * 512), (50, 1, 0, 256 * 512)]
    assert top_k(v.limit(0), v.limit(0)).count() == 0
    assert top_k(v.where("vec_id = 0"), v.where("vec_id = 0")).count() == 0
    assert scaled(df.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0
