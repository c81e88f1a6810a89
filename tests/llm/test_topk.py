import math

import numpy as np
import pytest

from folioforge.llm import topk


@pytest.mark.parametrize("blocks", [(1024, 16384), (3, 50)])
def test_against_brute_force_with_ties(spark, blocks, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 40)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 64]) for i in range(300)] + [(1000 + i, [0.5, 0.25, 0.0, 0.0, -0.5, 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.exact_top_k(df, df.filter("vec_id % 20 = 0"), k=7, query_block=blocks[0], candidate_block=blocks[1]).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ints = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    for q in (i for i in ints if i % 20 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q))[:7]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(scores, 1)]


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [1.0]), (7, [1.0, 1.0, 9.0]), (7, [1.0, 1.0, 9.0]), (None, [1.0, 1.0]), (20, [3e38, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS v", "3 AS qb", "4 AS score")
    got = topk.exact_top_k(df, df.filter("vec_id % 20 = 0")).collect()
    mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == 0)
    huge = 64 * math.floor(64 * float(np.float32(3e38))) + 128 * 64
    assert huge > 2**63 and mine == [(1, 20, 2**63 - 1), (2, 7, 64 * 64 * 3), (3, 7, 64 * 64 * 3), (4, 6, 64 * 64), (5, 5, 0)]
    assert {r.query_id for r in got} == {0, 20}
    assert topk.exact_top_k(df.filter("false"), df.filter("false")).count() == 0
    assert topk.exact_top_k(df.filter("vec_id = 0"), df.filter("vec_id = 0")).count() == 0


def brute(rows, k, every=20):
    """{query: [(rank, id, score)]} in integers of any size."""
    ints = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    out = {}
    for q in (i for i in ints if i % every == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:k]
        out[q] = [(n, i, max(min(-s, 2**63 - 1), -(2**63))) for n, (s, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("size", [2.0**15, 2.0**16, 1e6, 2.0**24, 3e9, 1e14, 3e38])
def test_large_components_are_exact(spark, size):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.uniform(-1, 1, 9) * size * (1 if i % 3 else 0.01)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.exact_top_k(df, df.filter("vec_id % 20 = 0"), k=6, candidate_block=30).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: sorted(x) for q, x in got.items()} == brute(rows, 6)


def test_wide_vectors_of_equal_scores_go_by_id(spark):
    rows = [(i, [32768.0] * 4096) for i in range(0, 1100, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.rank, r.vec_id, r.score) for r in topk.exact_top_k(df, df.filter("vec_id = 0")).collect())
    assert got == [(k, 2 * k, 4096 * 2**42) for k in range(1, 21)]


def test_selection_keeps_ties_of_the_smaller_ids():
    rng = np.random.default_rng(2)
    for kind in (np.int64, object):
        scores = rng.integers(-3, 4, (200, 30)).astype(kind)
        ids = np.broadcast_to(np.arange(200)[:, None], scores.shape)
        kept, at = topk._select(scores, ids, 20)
        for q in range(30):
            assert at[:, q].tolist() == sorted(sorted(range(200), key=lambda i: (-scores[i, q], i))[:20]) and kept[:, q].tolist() == scores[at[:, q], q].tolist()


def test_sort_keys_ascend_as_integers_do():
    values = sorted([0, 1, -1, 255, 256, -255, -256, 2**63, -(2**63), 2**64, 10**40, -(10**40), 3**500, -(3**500)])
    assert [topk.sort_key(v) for v in values] == sorted(topk.sort_key(v) for v in values)
