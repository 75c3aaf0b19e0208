"""Operators whose intermediate rows must not outgrow their input: results against plain counterparts, and what their plans move."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.operators import graph as G
from urbanloom.operators import spatial_joins as J
from urbanloom.operators import subgraphs as B

SEGMENT = "id long, name string, seg int, x1 double, y1 double, x2 double, y2 double"


def some_segments(spark):
    rows = []
    for k in range(60):
        p = [(0.0005 * ((k * 7 + i * 13) % 29), 0.0005 * ((k * 11 + i * 5) % 23)) for i in range(4)]
        rows += [(k, f"s{k % 7}" if k % 5 else None, i, *p[i], *p[i + 1]) for i in range(3)]
    star = [(70, "s0", 0, 0.03, 0.03, 0.04, 0.04), (71, "s1", 0, 0.03, 0.04, 0.04, 0.03), (72, "s2", 0, 0.03, 0.035, 0.04, 0.035)]
    return spark.createDataFrame(rows + star, SEGMENT)


def exchanges(df):
    """Lines of the plan that shuffle."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]


def test_crossings_move_only_segments(spark):
    seg = some_segments(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c = J.street_crossings(seg, size=0.0015, name_col="name")
        merged = J.merge_crossings(c)
        assert len(exchanges(c)) == len(exchanges(merged)) == 2 and all("cx" in e for e in exchanges(merged))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows, wide = c.collect(), J.street_crossings(seg, size=1.0).collect()
    at = lambda r: (r.line1, r.line2, round(r.lon, 7), round(r.lat, 7))
    assert sorted(map(at, rows)) == sorted(map(at, wide)) and len(set(map(at, rows))) == len(rows) > 500  # no crossing is lost or doubled at a cell's edge
    key = lambda v: math.floor(v * 1e8 + 0.5)
    places: dict = {}
    for r in rows:
        places.setdefault((key(r.lon), key(r.lat)), set()).update((r.line1, r.line2))
    found = merged.collect()
    assert sorted(sorted(s) for s in places.values()) == sorted(r.streets for r in found) and max(r.n_streets for r in found) > 2
    told = {k: f"s{k % 7}" if k % 5 else str(k) for k in range(60)} | {70: "s0", 71: "s1", 72: "s2"}
    own = {(r.kx, r.ky): (r.name, r.address) for r in J.named_crossings(merged).collect()}
    for r in found:
        names = [told[s] for s in r.streets]
        assert own[r.kx, r.ky] == (("Crossing_" if len(names) == 2 else "Complex_Crossing_") + "_".join(names[:3]), "Intersection of " + " and ".join(names))
    joined = J.crossing_nodes(merged.drop("names"), seg.select("id", "name").distinct(), 5).collect()
    assert sorted(r.id for r in joined) == list(range(5, 5 + len(found))) and sorted(own.values()) == sorted((r.name, r.address) for r in joined)


def test_pair_totals_equal_pairs(spark):
    c = J.street_crossings(some_segments(spark)).withColumn("id", F.col("line1") * 1000 + F.col("line2"))
    want = {r.street: r for r in J.crossing_pairs_on_street(c).groupBy("street").agg(F.count(F.lit(1)).alias("pairs"), F.sum("distance_m").alias("metres")).collect()}
    for batch in ("10000", "7"):  # rows of a street in several batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {r.street: r for r in J.crossing_pair_totals(c).collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got.keys() == want.keys() and all(got[k].pairs == want[k].pairs and got[k].metres == pytest.approx(want[k].metres) for k in want)
    many = spark.range(3000).select(F.lit(1).alias("line1"), (F.col("id") + 2).alias("line2"), "id", (F.col("id") * 1e-6).alias("lon"), F.lit(0.0).alias("lat"))
    r = J.crossing_pair_totals(many.unionByName(many.where("id = 5"))).collect()
    n, doubled = 3000, sum(abs(i - 5) for i in range(3000))  # the point that is there twice is no pair with itself
    assert [x.street for x in r] == [1] and r[0].pairs == n * (n - 1) // 2 + n - 1
    assert r[0].metres == pytest.approx((sum(j - i for i, j in itertools.combinations(range(n), 2)) + doubled) * 1e-6 * 111320, rel=1e-9) and math.isfinite(r[0].metres)


def test_nearest_line_by_growing_radii(spark, monkeypatch):
    seg = some_segments(spark).withColumns({k: F.col(k) / 3 for k in ("x1", "x2", "y1", "y2")})
    pts = spark.range(300).select("id", (F.col("id") * 37 % 101 * 5e-5).alias("lon"), (F.col("id") * 53 % 97 * 4e-5 + F.when(F.col("id") > 270, 0.012).otherwise(0.0)).alias("lat"))
    rounds = []
    whole = J._nearest_within
    monkeypatch.setattr(J, "_nearest_within", lambda p, s, r, n: rounds.append(r) or whole(p, s, r, n))
    monkeypatch.setattr(J, "PAIRS_A_CELL", 0.01)
    monkeypatch.setattr(J, "PAIRS_A_TASK", 100)
    got = {r.point_id: r for r in J.nearest_line(pts, seg, 400.0).collect()}
    assert len(rounds) == 2 and rounds[0] < rounds[1] == 400.0
    lines, want = seg.collect(), {}
    for p in pts.collect():
        for s in lines:
            dx, dy = s.x2 - s.x1, s.y2 - s.y1
            n = dx * dx + dy * dy
            t = min(max(((p.lon - s.x1) * dx + (p.lat - s.y1) * dy) / n, 0.0), 1.0) if n else 0.0
            a, b = math.radians(p.lat), math.radians(s.y1 + t * dy)
            h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(s.x1 + t * dx - p.lon) / 2) ** 2
            m = 2 * 6371000.0 * math.asin(math.sqrt(h))
            if m <= 400:
                want[p.id] = min(want.get(p.id, m), m)
    assert got.keys() == want.keys() and 0 < 300 - len(want) < 300 and all(got[k].distance_m == pytest.approx(want[k], abs=1e-6) for k in want)


def test_outlook_reaches_half_of_what_the_shortest_path_allows(spark, monkeypatch):
    rows = [(i, i + 2) for i in range(20)] + [(i, i + 1) for i in range(0, 21, 2)]
    e = spark.createDataFrame(rows, "id1 long, id2 long")
    radii = []
    whole = G._outlook
    monkeypatch.setattr(G, "_outlook", lambda targets, step, radius: radii.append(radius) or whole(targets, step, radius))
    found = G.goal_directed_paths(spark.createDataFrame([(8, 12), (9, 12), (40, 12)], "source long, target long"), e, 12, 3, 5, 0.2)
    assert radii[:2] == [2, 2]  # shortest paths of 2 and 3 edges, so 5 and 6 in all, of which 3 and 4 are gone; by longest alone it would be 6
    got = {(r.source, r.target): [len(p) - 1 for p in r.paths] for r in found.collect()}
    assert got.keys() == {(8, 12), (9, 12)} and got[8, 12][0] == 2 and max(got[9, 12]) <= 6


def test_nearest_join_moves_each_item_once_a_round(spark, monkeypatch):
    rng = np.random.default_rng(2)
    spot = lambda n, w: [(1, i, float(103.8 + rng.uniform(0, w)), float(1.3 + rng.uniform(0, w))) for i in range(n)]
    items, places = spot(300, 0.002), spot(400, 0.002)
    rounds = []
    whole = B.settled
    monkeypatch.setattr(B, "settled", lambda df: rounds.append(df) or whole(df))
    a = spark.createDataFrame(items, "g int, item long, lon double, lat double")
    found = B.nearest_join(a, spark.createDataFrame(places, "g int, place long, lon double, lat double"), "g", "item", "place")
    first = next(r for r in rounds if "_ok" in r.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert first.count("Generate explode") == 1 and B._columns_for(rounds[0], "g") > 20  # only places go to nine cells, and of these few are in one
    want = {i: min((math.hypot((x - u) * math.cos(math.radians(1.3)), y - v), p) for _, p, u, v in places)[1] for _, i, x, y in items}
    assert {r.item: r.place for r in found.collect()} == want


def test_adjacent_pairs_are_not_grouped(spark):
    rng = np.random.default_rng(4)
    at = [(i, None if i % 17 == 0 else "n", float(103.8 + rng.uniform(0, 0.02)), float(1.3 + rng.uniform(0, 0.02))) for i in range(300)]
    at += [(5, "n", 103.805, 1.305), (20, "n", 103.806, 1.306), (400, "n", 150.0, -40.0), at[7]]  # ids with several places, a far one, an equal row
    links = [(0, 1), (20, 3), (5, 20), (40, 400), (60, 61), (61, 60), (80, 80), (40, 41)]
    nodes = spark.createDataFrame(at, "id long, name string, lon double, lat double")
    edges = spark.createDataFrame(links, "id1 long, id2 long")
    out = B.adjacent_nodes(nodes.where("id % 20 = 0").select(F.col("id").alias("centre"), "lon", "lat"), nodes, edges)
    pairs = {frozenset(p) for p in links}
    want: dict = {}
    for c, _, x, y in at:
        for i, name, u, v in at:
            if c % 20 or name is None or c == i:
                continue
            h = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
            m = 12742000.0 * math.asin(math.sqrt(h))
            if m <= 200 or frozenset((c, i)) in pairs:
                want[c, i] = min(want.get((c, i), m), m)
    rows = out.collect()
    assert len(rows) == len(want) > 50 and all(r.distance == pytest.approx(want[r.centre, r.id], abs=1e-6) for r in rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union") and "Aggregate" not in plan.splitlines()[1]


def test_points_are_dealt_by_their_number(spark, monkeypatch):
    ring = [(1, [(0.0, 0.0), (0.02, 0.0), (0.02, 0.02), (0.0, 0.02), (0.0, 0.0)]), (2, [(0.01, 0.0), (0.03, 0.0), (0.03, 0.02), (0.01, 0.02), (0.01, 0.0)])]
    rings = spark.createDataFrame(ring, "id long, line array<struct<lon:double,lat:double>>")
    pts = spark.range(500).select("id", (F.col("id") % 31 * 0.001 + 0.00037).alias("lon"), (F.col("id") % 19 * 0.001 + 0.00041).alias("lat")).coalesce(1)
    whole = {tuple(r) for r in J.filter_points_in_areas(J.points_in_areas(pts, rings), 0, 1e9, only_one=True).collect()}
    monkeypatch.setattr(J, "POINTS_A_TASK", 20)
    found = J.points_in_areas(pts, rings)
    assert "RepartitionByExpression" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) or "Repartition 26" in plan
    kept = J.filter_points_in_areas(found, 0, 1e9, only_one=True)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # the areas are met once
    inside = lambda k, x, y: (0.0, 0.01)[k] < x < (0.02, 0.03)[k] and 0 < y < 0.02
    want = {(r.id, [k + 1 for k in (0, 1) if inside(k, r.lon, r.lat)][0]) for r in pts.collect() if sum(inside(k, r.lon, r.lat) for k in (0, 1)) == 1}
    assert {(r.point_id, r.area_id) for r in kept.collect()} == want == {t[:2] for t in whole}


def test_radius_search_deals_tasks_by_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    at = [(i, float(103.8 + rng.uniform(0, 0.03)), float(lat + rng.uniform(0, 0.03))) for lat in (1.3, 60.0) for i in range(int(lat) * 10, int(lat) * 10 + 150)]
    nodes = spark.createDataFrame(at, "id long, lon double, lat double")
    monkeypatch.setattr(J, "PAIRS_A_TASK", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = J.radius_nodes(nodes.where("id % 20 = 0"), nodes, 500.0)
        tasks = [int(re.search(r", (\d+)\), REPARTITION_BY_NUM", e).group(1)) for e in exchanges(found)]
        rows = {(r.centre_id, r.id): r.distance_m for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(tasks) == 2 and min(tasks) > 4 and len(rows) == found.count()
    want = {}
    for c, x, y in at:
        for i, u, v in at if c % 20 == 0 else ():
            h = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
            if (m := 12742000.0 * math.asin(math.sqrt(h))) <= 500:
                want[c, i] = m
    assert rows.keys() == want.keys() and all(rows[k] == pytest.approx(want[k], abs=1e-6) for k in want)
