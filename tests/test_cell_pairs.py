"""Crossings in blocks of pairs against those of a row a pair."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from urbanloom.operators import cell_pairs as K
from urbanloom.operators import spatial_joins as J


def streets(n=150):
    """Random walks around a corner of four cells, a long street, one there and back, one without length, and several through one place."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(n):
        p = np.round(np.cumsum(np.vstack([rng.uniform(-0.003, 0.003, 2), rng.uniform(-0.0015, 0.0015, (1 + k % 4, 2))]), 0), 4)
        rows += [(k, f"s{k % 7}" if k % 5 else None, i, *map(float, (*p[i], *p[i + 1]))) for i in range(1 + k % 4)]
    rows += [(900, "long", 0, -0.02, -0.011, 0.03, 0.012), (901, "back", 0, -0.004, 0.0, 0.004, 0.001), (901, "back", 1, 0.004, 0.001, -0.004, 0.0), (902, "none", 0, 0.001, 0.001, 0.001, 0.001)]
    rows += [(910 + k, "star", 0, 0.02, 0.02, 0.02 + 0.001 * np.cos(k).item(), 0.02 + 0.001 * np.sin(k).item()) for k in range(6)]
    return rows


def rounded(rows):
    return Counter((r.line1, r.line2, round(r.lon, 10), round(r.lat, 10)) for r in rows)


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame(streets(), "id long, name string, seg int, x1 double, y1 double, x2 double, y2 double")


@pytest.mark.parametrize("size", [0.002, 0.0007, 1.0])
def test_crossings_of_blocks(segments, size):
    want = J.street_crossings(segments)
    rows = want.collect()
    assert rounded(J.crossings(segments, size=size).collect()) == rounded(rows) and len(rows) > 1000
    each = Counter(s for r in rows for s in (r.line1, r.line2))
    assert {r.street: r.crossings for r in J.crossings_per_street(segments, size=size).collect()} == each
    place = lambda r: (r.kx, r.ky, r.type, r.n_streets, tuple(r.streets))
    merged = J.merge_crossings(want).collect()
    assert Counter(map(place, J.merged_crossings(segments, size=size).collect())) == Counter(map(place, merged)) and max(r.n_streets for r in merged) > 4
    assert J.crossings(segments.where("false")).count() == 0


def test_names_of_blocks(segments):
    named = J.named_crossings(J.merge_crossings(J.street_crossings(segments, name_col="name")))
    assert Counter({(r["name"], r.address): r.n for r in J.crossing_name_counts(segments).collect()}) == Counter((r["name"], r.address) for r in named.collect())


@pytest.mark.parametrize("at_once", [200_000, 40])
def test_a_part_of_more_pairs_than_fit(monkeypatch, at_once):
    monkeypatch.setattr(K, "PAIRS_AT_ONCE", at_once)
    monkeypatch.setattr(K, "MOST_PARTS", 1)
    ends = [(np.cos(k).item() / 2000, np.sin(k).item() / 2000) for k in range(60)]
    rows = [(0, 0, k, f"s{k}", 0.001 - x, 0.001 - y, 0.001 + x, 0.001 + y) for k, (x, y) in enumerate(ends)] + [(0, 1, 99, "t", 0.0, 0.0021, 0.001, 0.0021)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("cx", "cy", "line", "name", "x1", "y1", "x2", "y2"), r, strict=True)) for r in rows])
    found = [r for b in K.merged_rows(0.002)(iter(batch.slice(k, 7) for k in range(0, 61, 7))) for r in b.to_pylist()]
    assert [r["streets"] for r in found] == [list(range(60))] and (found[0]["kx"], found[0]["ky"]) == (0.001, 0.001)
    pairs = [p for b in K.crossing_rows(0.002)([batch]) for p in zip(*b.to_pydict().values(), strict=True)]
    assert sorted(p[:2] for p in pairs) == [(i, j) for i in range(60) for j in range(i + 1, 60)]


def test_nearest_within_blocks(spark):
    rng = np.random.default_rng(3)
    lines, pts = [], []
    for k in range(240):
        x, y, w = ((0.0, 0.0, 0.006), (103.8, 60.0, 0.01), (20.0, 89.9995, 0.1))[k % 3]
        a, b = rng.uniform(-w, w, 2), rng.uniform(-w, w, 2) * (1.0 if k % 11 else 8.0)
        lines.append((k, x + a[0], min(y + a[1] / 4, 90.0), x + b[0], min(y + b[1] / 4, 90.0)))
        pts += [(3 * k + i, x + rng.uniform(-w, w), min(y + rng.uniform(-w, w) / 4, 90.0)) for i in range(3)]
    lines += [(500, 0.001, 0.001, 0.001, 0.001), (501, -0.05, -0.03, 0.05, 0.03), (499, -0.05, -0.03, 0.05, 0.03)]
    tidy = lambda rows: [(r[0], *map(float, r[1:])) for r in rows]
    seg, points = spark.createDataFrame(tidy(lines), "line_id long, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(tidy(pts), "point_id long, lon double, lat double")
    _, x1, y1, x2, y2 = np.array(lines).T
    for radius in (40.0, 300.0):
        found = J._nearest_within(points, seg, radius, 0.0)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row a pair
        got, want = {r.point_id: (r.distance_m, r.line_id) for r in found.collect()}, {}
        for i, lon, lat in pts:
            dx, dy = x2 - x1, y2 - y1
            n = dx * dx + dy * dy
            t = np.clip(((lon - x1) * dx + (lat - y1) * dy) / np.where(n > 0, n, 1), 0, 1)
            a, b = np.radians(lat), np.radians(y1 + t * dy)
            h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(x1 + t * dx - lon) / 2) ** 2
            m = 12742000.0 * np.arcsin(np.sqrt(h))
            if m.min() <= radius:
                want[i] = (m.min(), lines[int(np.lexsort((np.array(lines)[:, 0], np.round(m, 9)))[0])][0])
        assert got.keys() == want.keys() and len(want) > 50
        assert all(abs(got[i][0] - want[i][0]) < 1e-5 and (got[i][1] == want[i][1] or abs(pts[i][2]) > 80) for i in want)


@pytest.mark.parametrize("size", [0.005, 0.0011])
def test_totals_of_streets_without_their_crossings(segments, size):
    c = J.street_crossings(segments).withColumn("id", F.col("line1") * 10000000 + F.col("line2"))
    want = {r.street: (r.pairs, r.metres) for r in J.crossing_pair_totals(c).collect()}
    found = J.street_pair_totals(segments, size=size).collect()
    got = {r.street: (r.pairs, r.metres) for r in found}
    assert len(found) == len(got) and got.keys() == want.keys() and len(want) > 100
    assert all(got[s][0] == want[s][0] and got[s][1] == pytest.approx(want[s][1], rel=1e-9, abs=1e-6) for s in want)
