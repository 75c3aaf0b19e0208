"""Names, house numbers, node caps, subgraphs of a radius and shortest paths with their text."""

from pyspark.sql import functions as F

from urbanloom.functions import records as R
from urbanloom.operators import paths as P
from urbanloom.operators import spatial_joins as J


def test_names_and_numbers(spark):
    rows = spark.createDataFrame([(None, "", "b", 5, None), ("", "a", "b", None, "7"), (" ", "a", None, None, ""), (None, None, None, None, None)], "name string, official_name string, name_zh string, number int, addr_housenumber string")
    got = [(r.name, r.housenumber) for r in R.with_housenumber(R.coalesce_name(rows)).collect()]
    assert got == [("b", "5"), ("a", "7"), (" ", None), (None, None)]
    bare = spark.createDataFrame([("", 1), (None, 2)], "name string, x int")
    assert [tuple(r) for r in R.with_housenumber(R.coalesce_name(bare)).collect()] == [("", 1, None), (None, 2, None)]
    caps = spark.createDataFrame([("NewYork",), ("singapore",), ("paris",), (None,)], "p string").select(R.node_cap(F.col("p")).alias("c"))
    assert [r.c for r in caps.collect()] == [2000, 500, 2000, 2000]


def test_radius_subgraph(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.001, 0.0), (3, 0.01, 0.0)], "id long, lon double, lat double")
    edges = spark.createDataFrame([(1, 2, 5.0, None), (2, 3, 6.0, 2.0), (2, 1, None, 3.0), (1, 1, 1.0, 1.0)], "id1 long, id2 long, distance double, crossing_distance_meters double")
    centres = spark.createDataFrame([(9, 0.0, 0.0), (8, 50.0, 50.0)], "id long, lon double, lat double")
    near, inside = J.radius_subgraph(centres, nodes, edges)
    assert sorted((r.centre_id, r.id) for r in near.collect()) == [(9, 1), (9, 2)]
    assert sorted((r.id1, r.id2, r.weight) for r in inside.collect()) == [(1, 1, 1.0), (1, 2, 100.0), (2, 1, 3.0)]
    assert sorted(r.weight for r in J.radius_subgraph(centres, nodes, edges.drop("crossing_distance_meters"))[1].collect()) == [1.0, 5.0, 100.0]


def test_shortest_paths_to(spark):
    step = 1e-3
    nodes = spark.createDataFrame([(1, "A", "point", 0.0, 0.0), (1, "A", "point", 0.0, 0.0), (2, "B", "line", step, 0.0), (3, "C", "point", step, step)], "node long, name string, kind string, lon double, lat double")
    edges = spark.createDataFrame([(2, 1, "nearest"), (1, 2, "walk"), (2, 3, "nearest"), (3, 4, "x"), (5, 6, "x")], "id1 long, id2 long, type string")
    pairs = spark.createDataFrame([(1, 3), (1, 4), (1, 6), (2, 2)], "source long, target long")
    got = {(r.source, r.target): r for r in P.shortest_paths_to(pairs, edges, nodes, 4).collect()}
    assert set(got) == {(1, 3), (1, 4), (2, 2)}
    one = got[1, 3]
    assert (one.path, one.hops, round(one.length, 1)) == ([1, 2, 3], 2, 222.4)
    assert one.text == "(A, nearest, B) (111.2m, 90°(E)) -> (111.2m, 0°(N)) -> (B, near, C) (111.2m, 0°(N))"
    assert (got[1, 4].text, got[1, 4].length, got[2, 2].text) == ("1 → 2 → 3 → 4", 0.0, "")
