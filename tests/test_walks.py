from itertools import permutations
from statistics import stdev

import pytest
from pyspark.sql import functions as F

from urbanloom.operators import aggregates as A
from urbanloom.operators import metrics as M
from urbanloom.operators import paths as P
from urbanloom.operators import walks as W


def ring(spark, n=8):
    rows = [(i, (i + k) % n, t, float(i + k)) for i in range(n) for k, t in ((1, "a"), (2, "b"), (3, "a"))]
    return spark.createDataFrame(rows, "id1 long, id2 long, type string, distance double")


def test_strategy_walks(spark):
    edges = ring(spark)
    nodes = spark.createDataFrame([(i, f"n{i}", i / 10, 0.0) for i in range(8)], "node long, name string, lon double, lat double")
    starts = spark.createDataFrame([(w, w % 8, (w + 4) % 8) for w in range(24)] + [(99, 0, 77)], "walk long, source long, target long")
    run = lambda: sorted(map(tuple, W.strategy_walks(starts, edges, nodes, attempts=2, steps=4, min_hops=2, seed=1).collect()))
    got = run()
    assert got and got == run()
    least = {}
    for a, b, _, d in edges.collect():
        key = frozenset((a, b))
        least[key] = min(d, least.get(key, d))
    for walk, source, target, _, path, names, distance in got:
        assert path[0] == source and path[-1] == target and len(set(path)) == len(path) > 2 and walk != 99
        assert names == [f"n{i}" for i in path] and distance == sum(least[frozenset(p)] for p in zip(path, path[1:]))


def test_step_score(spark):
    def score(strategy, times=0, equal=False, used=0, first=True, near=True):
        c = W.step_score(F.lit(strategy), F.lit(0.5), F.lit(times), F.lit(equal), F.lit(used), F.lit(first), F.lit(near))
        return spark.range(1).select(c.alias("s")).first().s

    assert (score(0), score(0, times=1), score(0, first=False)) == (5.0, 1.0, None)
    assert score(1) > score(1, times=1) == score(1, times=3, equal=True)
    assert (score(2), score(2, near=False), score(3, used=4), score(4)) == (0.5, None, -4.0, 0.5)
    assert score(5, used=9) > score(5, equal=True)
    assert (score(6, times=2), score(7, equal=True), score(8), score(8, times=1), score(8, times=2)) == (-15.0, 0.1, 15.0, 5.0, 0.1)


def test_visit_order_against_all_orders(spark):
    hops = {(g, a, b): (a * 7 + b * 5 + g * abs(a - b)) % 6 + 1 for g in range(3) for a in range(5) for b in range(5) if a != b}
    for b in range(5):  # graph 2: no way to or from node 4
        hops.pop((2, 4, b), None), hops.pop((2, b, 4), None)
    images = spark.createDataFrame([(g, a) for g in range(3) for a in range(5)] + [(5, 1), (6, 1), (6, 2)], "graph long, node long")
    got = {r.graph: (r.stops, r.total) for r in W.visit_order(spark.createDataFrame([(*k, v) for k, v in hops.items()], "graph long, a long, b long, hops long"), images, 4).collect()}
    for g in range(3):
        cost = lambda p: sum(hops.get((g, a, b), 999) for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = min(permutations(range(5), 4), key=lambda p: (cost(p), p))  # noqa: B023
        assert got[g] == (list(best), cost(best))
    assert got[5] == ([1], 0) and got[6] == ([1, 2], None)


def test_paths_through_and_lengths(spark):
    orders = spark.createDataFrame([(1, [0, 4, 2]), (2, [3])], "graph long, stops array<long>")
    rows = W.paths_through(orders, ring(spark), 3, 3)
    assert sorted((r.source, r.target, r["rank"]) for r in rows.collect()) == [(0, 4, 1), (0, 4, 2), (0, 4, 3), (4, 2, 1), (4, 2, 2), (4, 2, 3)]
    stats = W.path_lengths(rows).first()
    assert (stats.n_paths, stats.least) == (6, 1) and stats.most <= 3


def test_cap_graph(spark):
    nodes = spark.createDataFrame([(g, n) for g in (1, 2) for n in range(6)], "graph long, node long")
    edges = spark.createDataFrame([(g, n, n + 1) for g in (1, 2) for n in range(4)] + [(2, 2, 0)], "graph long, id1 long, id2 long")
    centres = spark.createDataFrame([(1, 0)], "graph long, node long")
    got = sorted(map(tuple, W.cap_graph(nodes, edges, centres, 3).collect()))
    assert got == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 0, 1), (2, 1, 1), (2, 2, 0)]
    everything = W.cap_graph(nodes, edges, centres, 9, seed=4).where("graph = 1").collect()
    assert {r.node: r.hop for r in everything} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: None}


def test_turns(spark):
    rows = [("p", 1, "m", "e", "x", "N", "s"), ("p", 2, "m", "e", "decision_point", "S", "t"), ("p", 3, "k", "e", "x", "S", "t"), ("p", 4, "m", "e", "decision_point", "S", "t"), ("p", 5, "k", None, "x", "N", "t")]
    df = spark.createDataFrame(rows, "path string, pos int, middle string, edge string, kind string, compass string, street string")
    assert [r.change for r in P.direction_changes(df).orderBy("pos").collect()] == [0, 0, 0, 1, 1]


def test_lengths_correlation_and_whitening(spark):
    lists = spark.createDataFrame([([1, 2],), ([3],), ([],)], "length array<int>")
    assert tuple(A.length_stats(lists).first()) == (2.0, pytest.approx(2**0.5), 0, 3, 3)
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (float("inf"), 0.0)], "distance double, score double")
    assert A.decay_correlation(rows).first().r == pytest.approx(1.0) and A.decay_correlation(rows.limit(0)).first().r == 0.0
    rewards = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "prompt_id long, reward double")
    got = sorted(r.advantage for r in M.whitened_advantages(rewards).collect())
    assert got == pytest.approx([-1 / (2 + 1e-4), 0.0, 1 / (2 + 1e-4)])
    got = sorted(r.advantage for r in M.whitened_advantages(rewards, base="rloo", by="advantages").collect())
    assert got == pytest.approx([x / (stdev([-2, 2, 0]) + 1e-4) for x in (-2, 0, 2)])
