"""Search kernels, the graph index, lists and cache lookups against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluation, search
from quarry.operators.kernels import Graph, TopK


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def clusters(seed, n, dims=48, centres=60, spread=0.5):
    """Unit vectors about random centres; a vector's own part is `spread` times as long as its centre."""
    rng = np.random.default_rng(seed)
    own = unit(rng.normal(size=(n, dims)))
    return unit(unit(rng.normal(size=(centres, dims)))[rng.integers(0, centres, n)] + spread * own)


def brute(q_ids, q, ids, x, k, own=False):
    scores = np.round(q @ x.T, 6)
    out = []
    for i, row in zip(q_ids, scores):
        found = sorted((-s, j) for s, j in zip(row.tolist(), ids.tolist()) if own or i != j)[:k]
        out += [(int(i), j, -s) for s, j in found]
    return sorted(out)


def listed(batch):
    return sorted(zip(*(c.to_pylist() for c in batch.columns)))


def frame(spark, ids, x, names):
    return spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist())], f"{names[0]} long, {names[1]} array<double>")


@pytest.mark.parametrize("k", [1, 3, 50])
def test_running_top_k(k, monkeypatch):
    from quarry.operators import kernels

    monkeypatch.setattr(kernels, "SCORES_AT_ONCE", 64)
    rng = np.random.default_rng(k)
    x = np.round(unit(rng.normal(size=(200, 4))), 1)  # with many ties
    ids = rng.permutation(200)
    q_ids, q = np.arange(0, 60, 3), x[np.argsort(ids)[np.arange(0, 60, 3)]]
    for own in (False, True):
        best = TopK(q_ids, k, own)
        for a in range(0, 200, 30):
            best.add(q, ids[a : a + 30], x[a : a + 30])
        best.add(q, ids[:0], x[:0])
        assert listed(best.batch()) == brute(q_ids, q, ids, x, k, own)


def test_graph_walks_reach_recall_at_a_fifth_of_the_work():
    x = clusters(1, 4000)
    graph = Graph.build(x[:-200], 32, 64)
    q = x[-200:]  # not in the graph
    truth = np.argsort(-(q @ x[:-200].T), axis=1)[:, :10]
    recalls = []
    for ef in (10, 20, 40):
        places, scores, work = graph.search(q, ef)
        assert (np.diff(scores, axis=1) <= 0).all()
        recalls.append(np.mean([len(set(t) & set(p[:10])) / 10 for t, p in zip(truth.tolist(), places.tolist())]))
        assert work.mean() <= 0.2 * len(graph.x)
    assert recalls == sorted(recalls) and recalls[-1] >= 0.9, recalls
    for n in (1, 2, 20):
        tiny = Graph.build(x[:n], 32, 64)
        assert set(tiny.search(x[:3], 30)[0][0].tolist()) == {-1, *range(n)}
    apart = np.repeat(np.eye(48)[:40], 30, axis=0)  # copies that are linked among themselves only
    places, _, _ = Graph.build(apart, 8, 16).search(np.eye(48)[:40], 10)
    assert (places[:, 0] // 30 == np.arange(40)).all()


def test_graph_index_over_parts(spark):
    x = clusters(2, 1500)
    vectors, questions = frame(spark, range(1500), x, ("id", "vec")), frame(spark, range(0, 1500, 50), x[::50], ("q_id", "q_vec"))
    truth = search.search_exact(vectors, questions, 10)
    index = search.GraphIndex(vectors.unionByName(spark.createDataFrame([(None, x[0].tolist()), (9999, None)], "id long, vec array<double>")), part=400)
    assert index.indexed.count() >= 3
    found = index.search(questions, 10, 40)
    assert evaluation.recall_at(found, truth, 10).first()["recall"] >= 0.9
    work = index.work(questions, 40).agg(F.count(F.lit(1)).alias("n"), F.min("vectors").alias("of"), F.avg("scored").alias("scored")).first()
    assert (work["n"], work["of"]) == (30, 1500) and work["scored"] < 1500
    exact = {(r["q_id"], r["id"]): r["score"] for r in search.search_exact(vectors, questions, 1499).collect()}
    rows = found.collect()
    assert all(abs(exact[r["q_id"], r["id"]] - r["score"]) < 1e-5 for r in rows)
    # Many questions, in tiles, find the same.
    limit, block = search.MAX_BROADCAST, search.BLOCK
    search.MAX_BROADCAST, search.BLOCK = 4, 7
    try:
        assert sorted(map(tuple, index.search(questions, 10, 40).collect())) == sorted(map(tuple, rows))
    finally:
        search.MAX_BROADCAST, search.BLOCK = limit, block


def test_lists_with_hot_ones_find_all_and_few_find_most(spark):
    x = clusters(3, 900, centres=6, spread=0.2)
    vectors, questions = frame(spark, range(900), x, ("id", "vec")), frame(spark, range(0, 900, 30), x[::30], ("q_id", "q_vec"))
    truth = search.search_exact(vectors, questions, 5)
    block = search.BLOCK
    search.BLOCK = 64
    try:
        index = search.InvertedLists(vectors, lists=6)
        assert index.indexed.groupBy("g").count().agg(F.max("count")).first()[0] > 1
        recalls = [evaluation.recall_at(index.search(questions, 5, n), truth, 5).first()["recall"] for n in (1, 2, 6)]
    finally:
        search.BLOCK = block
    assert recalls[0] >= 0.9 and recalls == sorted(recalls) and recalls[-1] == 1.0


def test_cache_lookups_in_blocks(spark):
    """A scope of most rows, small ones, one without stored questions, and rows without a scope or a vector."""
    x = clusters(4, 600, dims=8, centres=20)
    scope = ["hot" if i % 10 else f"s{i % 7}" for i in range(600)]
    rows = [(i, scope[i], x[i].tolist()) for i in range(600)]
    schema = "id long, scope string, vec array<double>"
    lookups = spark.createDataFrame([r for r in rows if r[0] % 2] + [(1000, "none", x[0].tolist()), (1001, None, x[0].tolist()), (1002, "hot", None)], schema)
    stored = spark.createDataFrame([r for r in rows if r[0] % 2 == 0], schema)
    want = {}
    for i in range(1, 600, 2):
        best = max(((round(float(x[i] @ x[j]), 6), -j) for j in range(0, 600, 2) if scope[j] == scope[i]), default=(0, 0))
        if best[0] >= 0.8:
            want[i] = (-best[1], best[0])
    block = search.BLOCK
    search.BLOCK = 50
    try:
        got = {r["id"]: (r["hit"], r["score"]) for r in search.cache_hits(lookups, stored, 0.8).collect()}
    finally:
        search.BLOCK = block
    assert {i: h for i, (h, _) in got.items()} == {i: h for i, (h, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 2e-6 for i in want)
