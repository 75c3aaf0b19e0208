from pyspark.sql import functions as F

from urbanloom.operators import graph as G


def edges(spark):
    return spark.createDataFrame([(1, 2, "a", 1.0), (2, 3, "a", 1.0), (3, 4, "b", 1.0), (1, 4, "b", 5.0), (4, 4, "c", 0.0), (2, 1, "z", 0.5)], "id1 long, id2 long, type string, distance double")


def test_hops_and_cap(spark):
    seeds = spark.createDataFrame([(1, 1), (9, 9)], "seed long, node long")
    got = {(r.seed, r.node): r.hop for r in G.hops_from(seeds, edges(spark), 2).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 4): 1, (1, 3): 2, (9, 9): 0}
    assert {r.seed for r in G.hops_from(seeds, edges(spark), 2, max_nodes=2).collect()} == {9}


def test_paths(spark):
    pairs = spark.createDataFrame([(1, 3), (1, 8)], "source long, target long")
    assert [(r.path, r.hops) for r in G.shortest_paths(pairs, edges(spark), 4).collect()] == [([1, 2, 3], 2)]
    paths = G.simple_paths(pairs, edges(spark), 3)
    assert sorted(r.path for r in paths.collect()) == [[1, 2, 3], [1, 4, 3]]
    assert sorted(G.diverse_paths(paths, 5).first().paths) == [[1, 2, 3], [1, 4, 3]]
    assert G.path_set_diversity(paths).first().diversity == 0.5


def test_lightest_and_lookup(spark):
    e = G.lightest_edges(edges(spark).withColumn("seed", F.lit(0)), ["seed"])
    assert {(r.id1, r.id2): r.type for r in e.collect()} == {(1, 2): "z", (2, 3): "a", (3, 4): "b", (1, 4): "b"}
    q = spark.createDataFrame([(3, 2), (7, 8)], "a long, b long")
    assert {(r.a, r.b): (r.type, r.distance) for r in G.edge_lookup(q, edges(spark)).collect()} == {(3, 2): ("a", 1.0), (7, 8): ("unknown", None)}


def test_walks_and_spread(spark):
    starts = spark.createDataFrame([(1, 1, 3)], "walk long, source long, target long")
    path = G.random_walks(starts, edges(spark), 4).first().path
    assert path[0] == 1 and len(set(path)) == len(path)
    items = spark.createDataFrame([("x", 1, 0.0, 0.0), ("x", 2, 1.0, 0.0), ("x", 3, 5.0, 0.0), ("y", 4, 0.0, 0.0)], "cell string, id long, lon double, lat double")
    got = {(r.cell, r["round"]): r.id for r in G.spread_sample(items, 3).collect()}
    assert got == {("x", 1): 1, ("x", 2): 3, ("x", 3): 2, ("y", 1): 4}


def test_path_predicates(spark):
    a = lambda *n: F.array(*map(F.lit, n))
    r = spark.range(1).select(G.path_quality(a("x", "y", "z")).alias("ok"), G.no_there_and_back(a("x", "y", "x")).alias("back"), G.unique_names(a("x", "x")).alias("u"), G.most_repeated(a("x", "x", "Node_1", "Node_1")).alias("m")).first()
    assert tuple(r) == (True, False, False, 2)


def _brute(edges, source, target, longest, slack, most, least, searched=None, per_length=None):
    """The search as defined, by listing all simple paths."""
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    paths, open_ = [], [[source]]
    while open_:
        grown = [p + [n] for p in open_ for n in sorted(near.get(p[-1], ())) if n not in p and len(p) <= longest]
        paths += [p for p in grown if p[-1] == target]
        open_ = [p for p in grown if p[-1] != target]
    paths.sort(key=lambda p: (len(p), p))
    if not paths:
        return None
    paths = [p for p in paths if len(p) <= len(paths[0]) + slack]
    if per_length:
        paths = [p for i, p in enumerate(paths) if sum(len(q) == len(p) for q in paths[:i]) < per_length]
    kept = []
    for p in paths[:searched]:
        if len(kept) < most and (least is None or all(len(set(p) & set(q)) / len(set(p) | set(q)) <= 1 - least for q in kept)):
            kept.append(p)
    return kept


def test_goal_directed_search(spark):
    """A ladder with chords, on which four edges are too few, against all simple paths."""
    rows = [(i, i + 2) for i in range(14)] + [(i, i + 1) for i in range(0, 15, 2)] + [(0, 5), (3, 8), (20, 21), (7, 7)]
    e = spark.createDataFrame([(a, b, "t", 1.0) for a, b in rows], "id1 long, id2 long, type string, distance double")
    asked = [(0, 13), (1, 12), (2, 3), (0, 21), (4, 4), (99, 0), (15, 0)]
    pairs = spark.createDataFrame(asked + asked[:1], "source long, target long")
    for run, kind in (
        (G.find_diverse_paths, {"longest": 12, "slack": 5, "most": 5, "least": 0.3, "searched": 50}),
        (G.find_paths_of_all_lengths, {"longest": 15, "slack": 8, "most": 5, "least": 0.2, "per_length": 3}),
        (lambda p, e: G.goal_directed_paths(p, e, 7, 2, 9, None, radius=1), {"longest": 7, "slack": 2, "most": 9, "least": None}),
    ):
        got = {(r.source, r.target): r.paths for r in run(pairs, e).collect()}
        want = {q: _brute(rows, *q, **kind) for q in asked if q[0] != q[1]}
        assert got == {q: p for q, p in want.items() if p} and len(got) >= 3 and (kind["least"] is None or max(len(p) for ps in got.values() for p in ps) > 6)


def test_paths_between_and_hops(spark):
    chosen = spark.createDataFrame([(1, 4, [[1, 4], [1, 2, 3, 4], [1, 3, 4]])], "source long, target long, paths array<array<long>>")
    nodes = spark.createDataFrame([(2, "cafe"), (3, "cafe"), (3, "cafe"), (4, None)], "node long, category string")
    assert [(r.path_id, r.path, r.category_nodes) for r in G.paths_between(chosen, nodes, "cafe").orderBy("path_id").collect()] == [(0, [1, 3, 4], [3]), (1, [1, 2, 3, 4], [2, 3])]
    assert [(r.path_id, r.length, r.category_nodes) for r in G.paths_between(chosen).orderBy("path_id").collect()] == [(0, 1, None), (1, 2, None), (2, 3, None)]
    pairs = spark.createDataFrame([(1, 3), (1, 1), (1, 8)], "source long, target long")
    assert {(r.source, r.target): r.hops for r in G.hop_distances(pairs, edges(spark), 3).collect()} == {(1, 3): 2.0, (1, 1): 0.0, (1, 8): float("inf")}
