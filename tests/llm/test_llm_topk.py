import math

import numpy as np
import pytest
from oracle import same

from quarrydf.llm import topk


def test_query_matches_sql(spark, sf):
    same(topk.op6_topk(spark, sf), topk.OP6_SQL, sf)


def brute(rows, k, queries):
    fit = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in fit:
        if q in queries:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fit if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_blocks_shards_ties_and_odd_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "BLOCK", 5)
    monkeypatch.setattr(topk, "SHARDS", 2)
    monkeypatch.setattr(topk, "PILOT", 7)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(600)]
    rows[3] = (3, None)
    rows[50] = (50, [float("nan")] * 6)
    rows[51] = (51, [1.0, None, 0.0, 0.0, 0.0, 0.0])
    rows[52] = (52, [1.0, 2.0])
    rows[100] = (100, [3.0, -1.0])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    df.selectExpr("*", "1 AS v", "2 AS score").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in topk.op6_topk(spark, str(tmp_path)).collect()]
    assert sorted((q, r, i, s) for q, r, i, s in got) == brute(rows, 5, set(range(0, 600, 50)))


def test_pruning_leaves_rows_out():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (40, 16))
    vectors = np.repeat(centres, 60, 0) + rng.integers(-3, 4, (2400, 16))
    ids = np.arange(2400)
    queries = np.arange(0, 2400, 97)
    best, seen = topk.Best(len(queries), 5), []
    topk.BallTree(ids, vectors).search(ids[queries], vectors[queries], best, seen)
    scores = vectors[queries] @ vectors.T
    scores[np.arange(len(queries)), queries] = np.iinfo(np.int64).min
    order = np.lexsort((np.broadcast_to(ids, scores.shape), ~scores), axis=1)[:, :5]
    assert (best.ids == order).all() and (best.scores == np.take_along_axis(scores, order, 1)).all()
    assert sum(seen) < 0.3 * len(queries) * 2400


def test_repeated_and_few_rows(spark):
    df = spark.createDataFrame([(0, [1, 1]), (0, [1, 1]), (7, [2, 0]), (7, [2, 0])], "vec_id long, v array<long>")
    got = [tuple(r) for r in topk.search(df, df.filter("vec_id = 0"), 5).collect()]
    assert sorted(got) == [(0, 1, 7, 2), (0, 2, 7, 2)]
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
    assert topk.search(df, df.limit(0)).count() == 0


def test_large_components_are_exact_or_an_error():
    """Queries larger than the vectors, partial sums beyond 64 bits, and scores beyond them."""
    vectors = np.array([[3, 1], [3, 2], [-(2**40), 2**40]])
    queries = np.array([[2**60 + 1, 5], [2**40, 2**40]])
    for asked, rows in ((queries[:1], vectors[:2]), (queries[1:], vectors)):
        best = topk.Best(1, 2)
        topk.BallTree(np.arange(len(rows)), rows).search(np.array([9]), asked, best)
        true = sorted(((sum(int(a) * int(b) for a, b in zip(asked[0], v)), -i) for i, v in enumerate(rows)), reverse=True)[:2]
        assert list(zip(best.scores[0].tolist(), (-best.ids[0]).tolist())) == true
    with pytest.raises(OverflowError):
        topk.BallTree(np.arange(1), vectors[2:]).search(np.array([9]), np.array([[-(2**40), 2**40]]), topk.Best(1, 1))
    # a query's own row is no candidate, however large
    topk.BallTree(np.arange(1), vectors[2:]).search(np.array([0]), vectors[2:], best := topk.Best(1, 1))
    assert best.scores[0, 0] == topk._LOW
