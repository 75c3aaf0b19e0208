"""Geometries of all kinds from WKT and GeoJSON: golden centres, lengths, areas, ends and containment."""

import pytest
from pyspark.sql import functions as F

from urbanloom.functions import geometry as G

SQUARE = "(0 0, 4 0, 4 4, 0 4, 0 0)"
HOLE = "(0 0, 2 0, 2 2, 0 2, 0 0)"
WKT = {
    "point": "POINT (3 -1.5)", "points": "MULTIPOINT ((0 0), (4 2))", "bare points": "multipoint(0 0,4 2)", "line": "LINESTRING (0 0, 3 0, 3 1)", "lines": "MULTILINESTRING ((0 0, 1 0), (5 5, 5 8))",
    "polygon": f"SRID=4326;POLYGON ({SQUARE})", "hole": f"POLYGON ({SQUARE}, {HOLE})", "polygons": "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((10 0, 10 1, 11 1, 11 0, 10 0)))", "z": "POINT Z (1 2 3)", "flat": "POLYGON ((0 0, 4 0, 0 0))", "still": "LINESTRING (7 7, 7 7)",
    "empty": "POLYGON EMPTY", "broken": "LINESTRING (1 2, x)", "other": "CIRCLE (1 2)", "null": None, "exp": "POINT (1e2 -2.5E-1)",
}


@pytest.fixture(scope="module")
def read(spark):
    rows = spark.createDataFrame(list(WKT.items()), "name string, text string").withColumn("g", G.geometry_of_wkt(F.col("text")))
    g = F.col("g")
    return {r.name: r for r in rows.select("name", "g", G.centroid(g).alias("all"), G.center(g).alias("first"), G.length_m(g, lambda a, b, c, d: F.abs(c - a) + F.abs(d - b)).alias("m"), G.area(g).alias("area"), G.contains(g, F.lit(1.0), F.lit(1.5)).alias("a"), G.contains(g, F.lit(3.0), F.lit(3.5)).alias("b"), G.endpoints(g).alias("e")).collect()}


def near(point, x, y):
    return abs(point.lon - x) < 1e-12 and abs(point.lat - y) < 1e-12


def test_centres(read):
    assert near(read["point"]["all"], 3, -1.5) and near(read["points"]["all"], 2, 1) and near(read["points"]["first"], 0, 0) and near(read["bare points"]["all"], 2, 1)
    assert near(read["line"]["all"], (3 * 1.5 + 1 * 3) / 4, 0.5 / 4) and near(read["lines"]["all"], (1 * 0.5 + 3 * 5) / 4, 3 * 6.5 / 4) and near(read["lines"]["first"], 0.5, 0)
    assert near(read["polygon"]["all"], 2, 2) and near(read["hole"]["all"], (16 * 2 - 4 * 1) / 12, (16 * 2 - 4 * 1) / 12)
    assert near(read["polygons"]["all"], (4 * 1 + 1 * 10.5) / 5, (4 * 1 + 1 * 0.5) / 5) and near(read["polygons"]["first"], 1, 1)
    assert near(read["z"]["all"], 1, 2) and near(read["flat"]["all"], 2, 0) and near(read["still"]["all"], 7, 7) and near(read["exp"]["all"], 100, -0.25)


def test_measures(read):
    assert (read["line"].m, read["lines"].m, read["polygon"].m, read["point"].m) == (4, 4, 0, 0)
    assert (read["polygon"].area, read["hole"].area, read["polygons"].area, read["line"].area) == (16, 12, 5, 0)
    assert [read[n].a for n in ("polygon", "hole", "polygons", "line")] == [True, False, True, False] and [read[n].b for n in ("polygon", "hole", "polygons")] == [True, True, False]
    e = read["lines"].e
    assert (e.start_x, e.start_y, e.end_x, e.end_y, e.line_length, e.x, e.polygon_area) == (0, 0, 5, 8, 4, None, None)
    assert (read["point"].e.x, read["point"].e.y, read["point"].e.start_x) == (3, -1.5, None) and (read["hole"].e.polygon_area, round(read["hole"].e.x, 9)) == (12, round(28 / 12, 9))


def test_unreadable(read):
    for name in ("empty", "broken", "other", "null"):
        assert tuple(read[name])[1:] == (None,) * 8


def test_geojson(spark):
    texts = {
        "point": ('{"type": "Point", "coordinates": [1, 2.5]}', (1, 2.5)), "poly": ('{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[0,0],[2,0],[2,2],[0,2],[0,0]]]}', (28 / 12, 28 / 12)),
        "multi": ('{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,2],[0,2],[0,0]]]]}', (1, 1)), "lines": ('{"type":"MultiLineString","coordinates":[[[0,0],[2,0]]]}', (1, 0)), "points": ('{"type":"MultiPoint","coordinates":[[0,0],[2,4]]}', (1, 2)),
        "bad": ('{"type":"Point","coordinates":[]}', None), "collection": ('{"type":"GeometryCollection","geometries":[]}', None), "none": ("x", None)}
    rows = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "name string, text string")
    got = {r.name: r.c for r in rows.select("name", G.centroid(G.geometry_of_geojson(F.col("text"))).alias("c")).collect()}
    assert all((got[k] is None) if want is None else near(got[k], *want) for k, (_, want) in texts.items())
    far = spark.createDataFrame([("POLYGON ((103.8 1.3, 103.8001 1.3, 103.8001 1.3001, 103.8 1.3001, 103.8 1.3))",)], "t string").select(G.centroid(G.geometry_of_wkt(F.col("t"))).alias("c")).first().c
    assert abs(far.lon - 103.80005) < 1e-12 and abs(far.lat - 1.30005) < 1e-12
