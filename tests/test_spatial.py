import pytest
from pyspark.sql import functions as F

from urbanloom.functions import spatial as S
from urbanloom.operators import spatial_joins as J


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_s2_cells(spark):
    rows = spark.createDataFrame([(49.703498679, 11.770681595), (1.3, 103.85), (-33.9, -70.6), (None, 1.0)], "lat double, lon double")
    got = [r[0] for r in rows.select(F.hex(S.s2_leaf(F.col("lat"), F.col("lon")))).collect()]
    assert got == ["47A1CBD595522B39", "31DA19BC9A5B89A3", "966330B825DF4A61", None]
    t = S.s2_tokens(F.col("lat"), F.col("lon"), 6)
    for r in rows.limit(3).select(t.alias("t"), S.ungroup_tokens(S.group_tokens(t)).alias("u")).collect():
        assert r.t == r.u and len(r.t) == 7


def test_distances(spark):
    r = one(spark, S.geodesic_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), S.geodesic_m(F.lit(3.0), F.lit(4.0), F.lit(3.0), F.lit(4.0)), S.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), S.haversine_edge(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    assert r.c0 == pytest.approx(111319.491, abs=0.01) and r.c1 == 0
    assert r.c2 == pytest.approx(111194.927, abs=0.01) and r.c3 == pytest.approx(r.c2, rel=1e-6)


def test_lines_and_rings(spark):
    line = S.points((0, 0), (1, 0), (1, 1))
    ring = S.points((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0))
    r = one(spark, S.turn_count(line), S.straightness(line), S.line_length_m(F.slice(line, 1, 1)), S.point_in_ring(F.lit(0.5), F.lit(1.5), ring), S.point_in_ring(F.lit(1.5), F.lit(1.5), ring), S.ring_centroid(ring), S.project_on_line(F.lit(0.5), F.lit(0.25), line))
    assert (r.c0, r.c2, r.c3, r.c4) == (1, 0.0, True, False) and r.c1 == pytest.approx(0.7071, abs=1e-3)
    assert r.c5.lon == pytest.approx(5 / 6) and r.c6.lon == pytest.approx(0.5) and r.c6.lat == 0


def test_compass(spark):
    r = one(spark, S.compass16(F.lit(11.25)), S.compass16(F.lit(350.0), long=True), S.compass8_label(F.lit(94.0)), S.compass8_name(F.lit(None).cast("double")), S.reverse_bearing(F.lit(200.0)), S.cardinal_to_bearing(F.lit("sw")))
    assert list(r) == ["N", "North", "94°(E)", "north", 20.0, 225.0]


def test_crossings_and_merge(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.01, 0.01), (2, 0, 0.0, 0.01, 0.01, 0.0), (3, 0, 0.0, 0.005, 0.01, 0.005), (4, 0, 1.0, 1.0, 1.01, 1.0)], "id long, seg int, x1 double, y1 double, x2 double, y2 double")
    c = J.street_crossings(seg)
    assert sorted((r.line1, r.line2) for r in c.collect()) == [(1, 2), (1, 3), (2, 3)]
    m = J.merge_crossings(c).collect()
    assert [(r.type, r.streets) for r in m] == [("complex_crossing", [1, 2, 3])]


def test_nearest_line_ties_and_misses(spark):
    seg = spark.createDataFrame([(2, 0, 0.0, 0.0001, 0.001, 0.0001), (1, 0, 0.0, -0.0001, 0.001, -0.0001)], "id long, seg int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(7, 0.0005, 0.0), (8, 5.0, 5.0), (9, None, None)], "id long, lon double, lat double")
    got = J.nearest_line(pts, seg, 50.0).collect()
    assert [(r.point_id, r.line_id) for r in got] == [(7, 1)]


def test_numbering(spark):
    rows = J.number_rows(spark.range(1000).select(F.col("id").alias("k")), ["k"], 5).agg(F.min("id"), F.max("id"), F.countDistinct("id")).first()
    assert tuple(rows) == (5, 1004, 1000)
