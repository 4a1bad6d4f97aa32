import math
from itertools import groupby

import numpy as np
import pytest

from eventskim.llm import ann, knn_join
from eventskim.llm.ann import collision_rule, op7_ann
from eventskim.llm.knn_join import op6_topk

SCHEMA = "vec_id long, embedding array<float>, label int, vector int, square int, cell int"


def rows_of(seed, n=700, dim=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, dim))
    x = (centre[rng.integers(0, 5, n)] + 0.3 * rng.normal(size=(n, dim))) * rng.choice([0.5, 1.0, 2.0], size=(n, 1))
    x[n // 3 : n // 2] = x[0]  # a hot vector
    x = x.astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], 0, None, None, None) for i in range(n)]
    rows += [(rows[9][0], rows[9][1], 1, None, None, None)] * 2  # repeated
    odd = [None, [], [None] * dim, [float("nan")] * dim, [float("inf")] * dim, [1.0] * (dim + 1), [0.0] * dim]
    rows += [(50 * (n + i), e, 0, None, None, None) for i, e in enumerate(odd)]
    return rows + [(None, rows[5][1], 0, None, None, None)]


def valid(rows, dim, zero):
    kept = {}
    for i, e, *_ in rows:
        if i is not None and e is not None and len(e) == dim and all(v is not None and math.isfinite(v) for v in e) and (zero or any(e)):
            kept[i] = np.array(e, np.float64)
    return kept


def by_query(out):
    out = sorted(out, key=lambda r: (r.query_id, r.rank))
    return {q: [(r.rank, r.vec_id, r.score) for r in found] for q, found in groupby(out, key=lambda r: r.query_id)}


@pytest.mark.parametrize("seed", range(3))
def test_exact_join(spark, seed, monkeypatch):
    monkeypatch.setattr(knn_join, "GROUP_QUERIES", 3)
    monkeypatch.setattr(knn_join, "SLICE_ROWS", 64)
    rows = rows_of(seed)
    out = by_query(op6_topk(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())
    x = {i: np.floor(256 * e).astype(int) for i, e in valid(rows, 6, True).items()}
    queries = [i for i in x if i % 50 == 0]
    assert sorted(out) == sorted(queries)
    for q in queries:
        best = sorted(((-int(x[q] @ e), i) for i, e in x.items() if i != q))[:5]
        assert out[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def wanted(rows, query_every, k, scale, zero):
    """All pairs, by id and distinct vector, within each length."""
    kept = {}
    for i, e, *_ in rows:
        if i is not None and e and all(v is not None and math.isfinite(v) for v in e) and (zero or any(e)):
            v = tuple(math.floor(256 * x) for x in e) if scale else tuple(e)
            kept[i, v] = v
    out = {}
    for (q, u) in kept:
        if q % query_every == 0:
            out.setdefault(q, []).extend((-sum(a * b for a, b in zip(u, v)), i) for (i, _), v in kept.items() if i != q and len(v) == len(u))
    return {q: [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])] for q, found in out.items() if found}


def test_exact_join_of_few(spark):
    out = by_query(op6_topk(spark.createDataFrame([(0, [1.0], 0, None, None, None), (7, [2.0], 0, None, None, None)], SCHEMA)).collect())
    assert out == {0: [(1, 7, 256 * 512)]}


@pytest.mark.parametrize("most", [2.0**14, 2.0**20, 2.0**25, 2.0**27, 2.0**40, 1e30, 1e200])
def test_exact_join_of_large_components(spark, most):
    """Products from 2^45 to far beyond 64 bits; ranks are exact, and scores the nearest longs."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.uniform(-most, most, size=(600, 8))) / 256
    x[50:60] = x[50]
    rows = [(int(i), [float(v) for v in e], 0, None, None, None) for i, e in enumerate(x)]
    out = by_query(op6_topk(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).collect())
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert out == {q: [(r, i, clamp(s)) for r, i, s in found] for q, found in wanted(rows, 50, 5, True, True).items()}


def test_many_rows_of_large_components(spark):
    """A slice of thousands of vectors whose products just fit in doubles."""
    rng = np.random.default_rng(5)
    x = rng.integers(-20_000, 20_000, size=(8000, 64)) / 1.0
    rows = [(int(i), [float(v) for v in e], 0, None, None, None) for i, e in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA).filter("vec_id % 50 <> 0 OR vec_id IN (0, 50, 100, 150)")
    out = by_query(op6_topk(df).collect())
    products = (x * 256).astype(object)
    kept = [i for i in range(8000) if i % 50 or i <= 150]
    ints = np.array([[int(v) for v in products[i]] for i in kept], np.int64)
    for q in (0, 50, 100, 150):
        scores = ints @ ints[kept.index(q)]
        best = sorted((-int(s), i) for s, i in zip(scores, kept) if i != q)[:5]
        assert out[q] == [(r + 1, i, -s) for r, (s, i) in enumerate(best)]


@pytest.mark.parametrize("ids", [1, 90])
def test_lengths_and_vectors_of_one_id(spark, ids):
    """Two lengths, and different vectors under one id; an id with a third of all vectors."""
    rng = np.random.default_rng(6)
    rows = [(i if i % 3 else 100, rng.normal(size=3 if i % 5 else 4).round(2).tolist(), 0, None, None, None) for i in range(3 * ids + 110)]
    rows += [(20 * i, rng.normal(size=4).round(2).tolist(), 0, None, None, None) for i in range(30)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double")).repartition(3)
    assert by_query(op6_topk(df).collect()) == wanted(rows, 50, 5, True, True)
    found, want = by_query(op7_ann(df).collect()), wanted(rows, 20, 20, False, False)
    assert found.keys() == want.keys()
    hit = total = 0
    for q in want:
        assert len(found[q]) == len(want[q])
        total += len(want[q])
        hit += len({(i, round(s, 6)) for _, i, s in want[q]} & {(i, round(s, 6)) for _, i, s in found[q]})
    assert hit / total > 0.9


def test_bound_holds():
    rng = np.random.default_rng(3)
    data, queries, pivots = rng.normal(size=(400, 3)), rng.normal(size=(50, 3)), rng.normal(size=(8, 3))
    d, q = knn_join._distances(data, pivots), knn_join._distances(queries, pivots)
    reach = np.array([q[q.argmin(1) == i, i].max(initial=-1.0) for i in range(8)])
    near = [sorted(d[d.argmin(1) == j, j])[:4] for j in range(8)]
    bound = knn_join._bounds(knn_join._distances(pivots, pivots), reach, near, 4)
    fourth = np.sort(knn_join._distances(queries, data), axis=1)[:, 3]
    assert (fourth <= bound[q.argmin(1)] + 1e-9).all()


@pytest.mark.parametrize("slice_rows", [200, 8192])
def test_collision_counting(spark, slice_rows, monkeypatch):
    monkeypatch.setattr(ann, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    rows = rows_of(5, n=900)
    out = by_query(op7_ann(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())
    x = valid(rows, 6, False)
    queries = [i for i in x if i % 20 == 0]
    assert sorted(out) == sorted(queries)
    hit = 0
    for q in queries:
        best = sorted(((-float((x[q] * e).sum()), i) for i, e in x.items() if i != q))[:20]
        found = out[q]
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(s == float((x[q] * x[i]).sum()) for _, i, s in found)
        hit += sum(-s >= b[0] for b, (_, _, s) in zip(best, found, strict=True)) and len({-b[0] for b in best} & {s for _, _, s in found}) / len({b[0] for b in best})
    assert hit / len(queries) > 0.9


def test_recall_on_the_table(small):
    out = by_query(op7_ann(small("embeddings")).collect())
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in small("embeddings").collect()}
    hit = 0
    for q, found in out.items():
        best = sorted(((-float(x[q] @ e), i) for i, e in x.items() if i != q))[:20]
        hit += len({i for _, i in best} & {i for _, i, _ in found})
    assert hit / (20 * len(out)) >= 0.9


def test_rule():
    needed, half = collision_rule(48, 0.95)
    rng = np.random.default_rng(0)
    inside = (np.abs(rng.standard_normal((20_000, 48))) <= half).sum(axis=1)
    assert (inside >= needed).mean() >= 0.94


def test_no_vectors(spark):
    for rows in ([], [(0, None, 0, None, None, None)]):
        assert op6_topk(spark.createDataFrame(rows, SCHEMA)).collect() == []
        assert op7_ann(spark.createDataFrame(rows, SCHEMA)).collect() == []
