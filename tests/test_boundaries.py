"""Streets along the ring of an area: golden metres and classes, and clipping against many small steps."""

import numpy as np
from pyspark.sql import functions as F

from urbanloom.operators import spatial_joins as J

PLANE = lambda x1, y1, x2, y2: F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2))


def test_golden_square(spark):
    """A square of side 10 with a buffer of 1, measured in its own plane."""
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    streets = {
        1: [(2.0, -0.5), (8.0, -0.5)],  # along the ring, outside
        2: [(5.0, 5.0), (5.0, 15.0)],  # crosses: y from 9 to 11
        3: [(2.0, 2.0), (8.0, 2.0)],  # inside, out of the buffer
        4: [(1.5, 0.5), (8.5, 0.5)],  # inside the buffer and the square
        5: [(-5.0, -0.5), (15.0, -0.5)],  # round ends: x from -sqrt(0.75) to 10 + sqrt(0.75)
        6: [(20.0, 20.0), (30.0, 20.0)],
        7: [(5.0, 0.0), (5.0, 4.0)],  # touches from inside
        8: [(2.0, -0.5), (5.0, -0.5), (5.0, -0.5), (5.0, -9.5)],  # a corner and a step without length
        9: [(4.0, 4.0), (4.0, 4.0)],
    }
    rows = [(k, i, *p) for k, line in streets.items() for i, p in enumerate(line)]
    segs = J.segments_of(spark.createDataFrame(rows, "id int, pos int, lon double, lat double"))
    area = spark.createDataFrame([(7, i, *p) for i, p in enumerate(ring)], "id int, pos int, lon double, lat double")
    got = {r.street_id: r for r in J.boundary_streets(segs, J.segments_of(area), J.lines_of(area, ("id",)), 1.0, 0.0, metric=PLANE).collect()}
    want = {1: (6, "boundary_adjacent"), 2: (2, "boundary_crossing"), 4: (7, "internal"), 5: (10 + 2 * 0.75**0.5, "boundary_adjacent"), 7: (1, "internal"), 8: (3.5, "boundary_adjacent")}
    assert {k: (round(r.overlap_m, 9), r.boundary_type) for k, r in got.items()} == {k: (round(m, 9), t) for k, (m, t) in want.items()}
    assert round(got[2].ratio, 9) == 0.2 and got[1].ratio == 1.0
    assert {r.street_id for r in J.boundary_streets(segs, J.segments_of(area), J.lines_of(area, ("id",)), 1.0, 0.3, metric=PLANE).collect()} == {1, 4, 5}
    assert J.boundary_streets(segs.where("false"), J.segments_of(area), J.lines_of(area, ("id",))).count() == 0


def test_spans_against_steps(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(map(float, rng.uniform(0, 4, 8).round(int(rng.integers(0, 3))))) for _ in range(300)]
    cols = ["x1", "y1", "x2", "y2", "u1", "v1", "u2", "v2"]
    got = J.with_capsule_spans(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)), 0.7).collect()
    t = np.linspace(0, 1, 4001)
    for r in got:
        x, y = r.x1 + t * (r.x2 - r.x1), r.y1 + t * (r.y2 - r.y1)
        ex, ey = r.u2 - r.u1, r.v2 - r.v1
        k = np.clip(((x - r.u1) * ex + (y - r.v1) * ey) / ((ex * ex + ey * ey) or 1), 0, 1)
        near = np.flatnonzero(np.hypot(x - r.u1 - k * ex, y - r.v1 - k * ey) <= 0.7)
        if (r.x1, r.y1) == (r.x2, r.y2) or len(near) < 2:
            assert r.a is None or r.b - r.a < 1e-3
        else:
            assert abs(r.a - t[near[0]]) < 3e-4 and abs(r.b - t[near[-1]]) < 3e-4
