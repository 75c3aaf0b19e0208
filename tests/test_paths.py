"""Texts of paths: own legs, transitions and crossing flags, with golden rows."""

from urbanloom.operators import paths as P

NODES = "path long, pos long, node long, name string, kind string, edge string, lon double, lat double, street string, crossing string, crossing_id long"


def walk(path, names, edges, at, flags=None):
    flags = flags or [None] * len(names)
    return [(path, i, 10 + i, n, "point", e, x, y, None, None, f) for i, (n, e, (x, y), f) in enumerate(zip(names, [*edges, None], at, flags, strict=True))]


STEP = 1e-3  # along the equator about 111.2 m


def test_own_leg_and_transition_differ(spark):
    at = [(0.0, 0.0), (STEP, 0.0), (STEP, -2 * STEP), (4 * STEP, -2 * STEP)]
    rows = walk(1, "ABCD", ["nearest", "near", "walkway"], at) + walk(2, "ABCD", ["walkway", "near", "walkway"], at) + walk(3, "AB", ["near"], at[:2]) + walk(4, "A", [], at[:1])
    rows += walk(5, "ABC", ["near", "near"], [(0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]) + walk(6, "ABC", ["near", "near"], [(0.0, 0.0), (None, None), (0.0, 0.0)])
    text = {r.path: r.text for r in P.paths_as_text(P.path_triples(spark.createDataFrame(rows, NODES))).collect()}
    assert text[1] == "(A, nearest, B) (111.2m, 90°(E)) -> (222.4m, 180°(S)) -> (B, near, C) (222.4m, 180°(S)) -> (333.6m, 90°(E)) -> (C, walkway, D) (333.6m, 90°(E))"
    assert text[2] == "(A, walkway, B) -> (222.4m, 180°(S)) -> (B, near, C) (222.4m, 180°(S)) -> (C, walkway, D) (333.6m, 90°(E))"
    assert text[3] == "(A, near, B) (111.2m, 90°(E))" and 4 not in text
    assert text[5] == "(A, near, B) (0.0m, 0°(N)) -> (B, near, C)"  # no distance: no transition, no last leg
    assert text[6] == "(A, near, B) () -> (B, near, C)"


def test_recorded_coordinates(spark):
    rows = [(*r, *((STEP, STEP) if r[1] == 0 else (None, None))) for r in walk(1, "ABC", ["near", "near"], [(0.0, 0.0), (STEP, 0.0), (STEP, 3 * STEP)])]
    got = {r.pos: r for r in P.path_triples(spark.createDataFrame(rows, f"{NODES}, reached_lon double, reached_lat double")).collect()}
    assert round(got[0].length, 1) == 111.2 and round(got[0].next_length, 1) == 222.4 and got[0].next_direction == "0°(N)"
    assert got[1].next_length is None and got[1].next_direction is None


def test_crossing_flags_reach_the_type(spark):
    rows = walk(1, "ABCDE", ["walkway", "walkway", "crossing", "on_same_street"], [(0.0, 0.0)] * 5, [1, 2, None, 4, 5])
    got = [r.type for r in P.path_triples(spark.createDataFrame(rows, NODES)).orderBy("pos").collect()]
    assert got == ["street_segment", None, "decision_point", "street_segment"]


PLACES = "node long, name string, class string, lon double, lat double"
RING = [(1, 2), (2, 3), (3, 4), (1, 5), (5, 6), (6, 4), (4, 4), (2, 1), (1, 7), (1, 8)]  # 7 has no row, 9 no edge


def found(spark, images, nodes, edges, **more):
    rows = [spark.createDataFrame(images, "image long"), spark.createDataFrame(nodes, PLACES), spark.createDataFrame(edges, "id1 long, id2 long")]
    said = {"classes": ("point",), "min_hops": 1, "max_hops": 3, "near_m": 250.0, "min_paths": 9} | more
    return [(r.image, r.target, r.path, r.near, r["rank"]) for r in P.paths_for_images(*rows, **said).orderBy("image", "rank").collect()]


def test_paths_for_images(spark):
    nodes = [(1, "A", "point", 0.0, 0.0), (2, " ", "point", 9 * STEP, 0.0), (3, "A", "point", STEP, 0.0), (4, "D", "point", None, 0.0), (5, None, "point", 2 * STEP, 0.0), (6, "F", "line", STEP, 0.0), (8, "H", "point", STEP, 0.0)]
    nodes += [nodes[3], (9, "I", "point", 0.0, 0.0)]
    images = [(1,), (1,), (8,), (9,), (99,)]
    # from 1: 8 is an image, 2 is far, 3 repeats A and 4 is reached over it; from 8, 1 is an image, 5 and 2 lie two steps off, 3 repeats A;
    # 9 reaches nothing and 99 is unknown
    want = [(1, 5, [1, 5], True, 1), (1, 2, [1, 2], False, 2), (8, 5, [8, 1, 5], True, 1), (8, 2, [8, 1, 2], False, 2)]
    assert found(spark, images, nodes, RING) == want
    assert [r[1:] for r in found(spark, [(1,)], nodes, RING, tries=3, min_paths=2)] == [(5, [1, 5], True, 1), (8, [1, 8], True, 2)]
    assert found(spark, [(1,)], nodes, RING, classes=("line",), seed=4) == [(1, 6, [1, 5, 6], True, 1)]
    assert found(spark, images, nodes, []) == []
