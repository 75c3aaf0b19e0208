"""Nearest places and farthest pairs against all pairs."""

import numpy as np
import pytest

from urbanloom.operators import aggregates as A
from urbanloom.operators import subgraphs as B


def metres(lon1, lat1, lon2, lat2):
    lon1, lat1, lon2, lat2 = (np.radians(v) for v in (lon1, lat1, lon2, lat2))
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 12742000.0 * np.arcsin(np.sqrt(np.minimum(1, h)))


def scattered(rng, n, first):
    """Near each other, over the date line, at the poles and far apart, with equal places."""
    spots = [(103.8, 1.3, 0.01), (179.999, 10.0, 0.005), (20.0, 89.99, 0.02), (-60.0, -89.5, 0.4), (0.0, 0.0, 60.0)]
    rows = []
    for i in range(n):
        x, y, w = spots[i % 5]
        lon = (x + rng.uniform(-w, w) * (40 if abs(y) > 80 else 1) + 180) % 360 - 180
        rows.append(("k" if i % 3 else "m", first + i, float(lon), float(np.clip(y + rng.uniform(-w, w), -90, 90))))
    return rows + [(rows[0][0], first + n, *rows[0][2:])]


@pytest.mark.parametrize("finest", [18, 9, 1])
def test_nearest_join(spark, finest):
    rng = np.random.default_rng(finest)
    items, places = scattered(rng, 120, 0), scattered(rng, 60, 1000)
    extra = [("k", 900, None, 1.0), ("none", 901, 1.0, 1.0)]
    a = spark.createDataFrame(items + extra, "g string, item long, lon double, lat double")
    b = spark.createDataFrame([*places, ("k", 2000, None, None), ("other", 2001, 0.0, 0.0)], "g string, place long, lon double, lat double")
    got = {r.item: (r.place, r.distance) for r in B.nearest_join(a, b, "g", "item", "place", finest).collect()}
    assert set(got) == {i for _, i, *_ in items}
    for g, i, x, y in items:
        far = {p: float(metres(x, y, u, v)) for h, p, u, v in places if h == g}
        assert abs(got[i][1] - min(far.values())) < 1e-6 and far[got[i][0]] <= min(far.values()) + 1e-6
    assert B.nearest_join(a.where("false"), b, "g", "item", "place").count() == 0 and B.nearest_join(a, b.where("false"), "g", "item", "place").count() == 0


@pytest.mark.parametrize("per_part", [100_000, 7])
def test_spread(spark, monkeypatch, per_part):
    monkeypatch.setattr(A, "HULL_ROWS", per_part)
    rng = np.random.default_rng(3)
    rows = [(c, i, *p) for c in range(4) for i, p in enumerate(zip((103 + c + rng.normal(0, 0.01, 200)).tolist(), (1.3 + rng.normal(0, 0.01, 200)).tolist(), strict=True))]
    rows += [(9, i, float(rng.uniform(-180, 180)), float(rng.uniform(-90, 90))) for i in range(60)] + [(10, 1, 5.0, 5.0)]
    rows += [(11, i, 5.0, 5.0) for i in range(4)] + [(12, i, 100.0 + i / 100, 0.0) for i in range(30)] + [(12, 99, None, None)] + [(13, i, 100.0 + i % 5 / 100, i // 5 / 100) for i in range(25)]
    got = {r.cell: (r.spread_m, r.skip) for r in A.cell_spread(spark.createDataFrame(rows, "cell int, id int, lon double, lat double"), 5000.0).collect()}
    assert set(got) == {0, 1, 2, 3, 9, 11, 12, 13}
    for c, (spread, skip) in got.items():
        x, y = np.array([[r[2], r[3]] for r in rows if r[0] == c and r[2] is not None]).T
        want = max(float(metres(x[i], y[i], x, y).max()) for i in range(len(x)))
        assert abs(spread - want) < 1e-6 * max(1, want) and skip == (spread > 5000)
