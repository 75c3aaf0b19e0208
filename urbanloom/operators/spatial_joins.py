"""Spatial joins as equi-joins on grid cells, refined by exact column expressions. No cross join, no geometry library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urbanloom.functions import spatial as S

from . import cell_pairs as K
from .graph import induced_edges
from .rounds import settled

from .rounds import numbered


def _axis(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))


def in_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    """The rows once for each grid cell of ``size`` degrees that their box touches: columns cx, cy."""
    return df.withColumn("cx", F.explode(_axis(x0, x1, size))).withColumn("cy", F.explode(_axis(y0, y1, size)))


def lines_of(vertices: DataFrame, keys: tuple[str, ...] = ("id", "name")) -> DataFrame:
    """(keys, line) from one row a vertex (pos, lon, lat)."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.struct("lon", "lat").alias("p"))))
    return vertices.groupBy(*keys).agg(F.transform(ordered, lambda v: v.p).alias("line"))


def segments_of(vertices: DataFrame, id_col: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, the kept columns of the first vertex, seg, x1, y1, x2, y2) of neighbouring vertices."""
    w = Window.partitionBy(id_col).orderBy("pos")
    rows = vertices.select(id_col, *keep, F.col("pos").alias("seg"), F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.lead("lon").over(w).alias("x2"), F.lead("lat").over(w).alias("y2"))
    return rows.where(F.col("x2").isNotNull())


#: No degree of latitude has fewer metres.
LEAST_PER_DEGREE = 111_000.0


def _longitude_reach(reach: float, lat: Column) -> Column:
    """Degrees of longitude that so many of latitude are at most, up to a latitude and what is reached beyond it."""
    return F.lit(reach) / F.greatest(F.cos(F.radians(F.least(F.abs(lat) + reach, F.lit(90.0)))), F.lit(1e-3))


#: Pairs that one task of a spatial join tests.
PAIRS_A_TASK = 20_000_000


def _cells_along(segments: DataFrame, wide: Column, reach: float, size: float) -> DataFrame:
    """The rows (x1, y1, x2, y2) once for each cell that their line touches when it is grown by ``wide`` and ``reach`` degrees: column by column, the rows of what runs there."""
    c, slack = F.col, 1e-7
    x0, x1, y0, y1 = F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = segments.withColumn("_w", wide + slack).withColumn("cx", F.explode(_axis(x0 - c("_w"), x1 + c("_w"), size)))
    slope = F.when(x1 - x0 > size, (c("y2") - c("y1")) / F.nullif(c("x2") - c("x1"), F.lit(0.0)))  # null for a line that is in few columns: it takes its whole height
    at = lambda x, short: F.when(c("_s").isNull(), short).otherwise(F.least(F.greatest(c("y1") + (F.least(F.greatest(x, x0), x1) - c("x1")) * c("_s"), y0), y1))
    rows = rows.withColumn("_s", slope).withColumns({"_a": at(c("cx") * size - c("_w"), y0), "_b": at((c("cx") + 1) * size + c("_w"), y1)})
    return rows.withColumn("cy", F.explode(_axis(F.least("_a", "_b") - (reach + slack), F.greatest("_a", "_b") + (reach + slack), size))).drop("_w", "_s", "_a", "_b")


#: Degrees of the least cell that points and segments are dealt by; tasks divide it.
NEAR_CELL = 0.002


def _nearest_within(points: DataFrame, segments: DataFrame, radius_m: float, pairs: float) -> DataFrame:
    """(point_id, line_id, distance_m, foot_lon, foot_lat) of the points (point_id, lon, lat) with a segment within the radius.

    Points and segments meet in cells that each task divides; of the pairs of a part only those leave it that may be the
    nearest by their planar square, and their distance is measured.
    """
    c, reach = F.col, radius_m / LEAST_PER_DEGREE
    size = max(2 * reach, NEAR_CELL)
    wide = _longitude_reach(reach, F.greatest(F.abs("y1"), F.abs("y2")))
    seg = _cells_along(segments.where("x1 + y1 + x2 + y2 is not null"), wide, reach, size)
    seg = seg.select("cx", "cy", F.lit(1).alias("kind"), c("line_id").alias("id"), "x1", "y1", "x2", "y2", wide.alias("wide"), F.lit(reach).alias("reach"))
    none = F.lit(0.0)
    pts = points.select(F.floor(c("lon") / size).cast("long").alias("cx"), F.floor(c("lat") / size).cast("long").alias("cy"), F.lit(0).alias("kind"), c("point_id").alias("id"), c("lon").alias("x1"), c("lat").alias("y1"), none.alias("x2"), none.alias("y2"), none.alias("wide"), none.alias("reach"))
    rows = pts.unionByName(seg)
    if pairs > PAIRS_A_TASK:  # a stated number of tasks, as the sizes of what is shuffled don't tell how many pairs it makes
        rows = rows.repartition(min(8192, max(int(pairs / PAIRS_A_TASK), int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "cx", "cy")
    else:
        rows = rows.repartition("cx", "cy")
    close = rows.sortWithinPartitions("cx", "cy").mapInArrow(K.near_pairs(size, reach), "point_id long, lon double, lat double, line_id long, foot_lon double, foot_lat double")
    close = close.withColumn("distance_m", S.haversine_m(c("lon"), c("lat"), c("foot_lon"), c("foot_lat"))).where(c("distance_m") <= radius_m)
    best = close.groupBy("point_id").agg(F.min(F.struct("distance_m", "line_id", "foot_lon", "foot_lat")).alias("b"))
    return best.select("point_id", "b.line_id", "b.distance_m", "b.foot_lon", "b.foot_lat")


#: Pairs that weigh as much as filing a segment under one more cell.
PAIRS_A_CELL = 2


def nearest_line(points: DataFrame, segments: DataFrame, radius_m: float = 100.0, point_id: str = "id", line_id: str = "id") -> DataFrame:
    """(point_id, line_id, distance_m, foot_lon, foot_lat): the nearest line of each point within a radius; others are left out.

    Segments go to the cells along them grown by the radius, in longitude by what it is at their own latitude; points go to
    their own cell. Each pair is measured at the foot of the planar projection. Ties go to the smaller line id. Where segments
    lie close, a smaller radius is searched first: it halves until pairs and cells balance, and what finds nothing goes on to the
    full one. A line within a radius is nearer than any beyond it, so the result is the same.
    """
    c = F.col
    seg = segments.select(c(line_id).cast("long").alias("line_id"), "x1", "y1", "x2", "y2")
    pts = points.select(c(point_id).cast("long").alias("point_id"), "lon", "lat").where("lon is not null and lat is not null")
    reach = radius_m / LEAST_PER_DEGREE
    filed = _cells_along(seg, _longitude_reach(reach, F.greatest(F.abs("y1"), F.abs("y2"))), reach, 2 * reach).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("s"))
    standing = pts.groupBy(F.floor(c("lon") / (2 * reach)).cast("long").alias("cx"), F.floor(c("lat") / (2 * reach)).cast("long").alias("cy")).agg(F.count(F.lit(1)).alias("p"))
    crowd = filed.join(standing, ["cx", "cy"], "left").agg(F.sum(c("s") * c("p").cast("double")).alias("pairs"), F.sum("s").alias("cells")).first()
    first, pairs, cells = radius_m, crowd.pairs or 0.0, crowd.cells or 0
    while pairs > PAIRS_A_CELL * cells and first > radius_m / 64:
        first, pairs, cells = first / 2, pairs / 2, cells * 2
    if first == radius_m:
        return _nearest_within(pts, seg, radius_m, pairs)
    found = settled(_nearest_within(pts, seg, first, pairs))
    left = pts.join(found.select("point_id"), "point_id", "left_anti")
    return found.unionByName(_nearest_within(left, seg, radius_m, pairs))


def _key(degrees: Column) -> Column:
    """Degrees rounded to 8 decimals, halves away from zero."""
    return F.signum(degrees) * F.floor(F.abs(degrees) * 1e8 + 0.5) / 1e8


def street_crossings(segments: DataFrame, id_col: str = "id", size: float = 0.002, name_col: str | None = None) -> DataFrame:
    """(line1, line2, lon, lat, cx, cy), line1 < line2: one row for each point where two lines cross; overlapping stretches yield nothing.

    Segments of both lines meet in the cells of their boxes, and a crossing counts in the cell (cx, cy) of its place rounded to
    8 decimals, which both reach: so what shares a place is together without a shuffle. Only the segments move; the number of
    tasks follows the pairs to test. ``name_col``: the lines' names come along as name1 and name2. End points count as crossings.
    """
    c, names = F.col, [] if name_col is None else [F.col(name_col).alias("name")]
    cut = in_cells(segments.select(c(id_col).alias("line"), *names, "x1", "y1", "x2", "y2"), F.least("x1", "x2") - 1e-8, F.least("y1", "y2") - 1e-8, F.greatest("x1", "x2") + 1e-8, F.greatest("y1", "y2") + 1e-8, size)
    tests = cut.groupBy("cx", "cy").count().agg(F.sum(c("count").cast("double") * c("count")) / 2).first()[0] or 0.0
    if tests > PAIRS_A_TASK:  # a stated number of tasks, as the sizes of the shuffled segments don't tell what comes of them
        cut = cut.repartition(min(8192, max(int(tests / PAIRS_A_TASK), int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "cx", "cy")
    a, b = cut.alias("a"), cut.alias("b")
    d = (c("a.x2") - c("a.x1")) * (c("b.y2") - c("b.y1")) - (c("a.y2") - c("a.y1")) * (c("b.x2") - c("b.x1"))
    pairs = a.join(b, (c("a.cx") == c("b.cx")) & (c("a.cy") == c("b.cy")) & (c("a.line") < c("b.line")))
    told = [c(f"{s}.name").alias(f"name{k}") for k, s in ((1, "a"), (2, "b")) if names]
    pairs = pairs.select(c("a.cx").alias("cx"), c("a.cy").alias("cy"), c("a.line").alias("line1"), c("b.line").alias("line2"), *told, d.alias("d"), *[c(f"{s}.{n}").alias(s + n) for s in "ab" for n in ("x1", "y1", "x2", "y2")])
    t = ((c("bx1") - c("ax1")) * (c("by2") - c("by1")) - (c("by1") - c("ay1")) * (c("bx2") - c("bx1"))) / F.nullif(c("d"), F.lit(0.0))
    u = ((c("bx1") - c("ax1")) * (c("ay2") - c("ay1")) - (c("by1") - c("ay1")) * (c("ax2") - c("ax1"))) / F.nullif(c("d"), F.lit(0.0))
    hits = pairs.where("abs(d) > 1e-18").withColumn("t", t).withColumn("u", u).where("t between 0 and 1 and u between 0 and 1")
    told = ["name1", "name2"] if names else []
    hits = hits.select("cx", "cy", "line1", "line2", *told, (c("ax1") + c("t") * (c("ax2") - c("ax1"))).alias("lon"), (c("ay1") + c("t") * (c("ay2") - c("ay1"))).alias("lat"))
    hits = hits.withColumns({"kx": _key(c("lon")), "ky": _key(c("lat"))}).where((F.floor(c("kx") / size) == c("cx")) & (F.floor(c("ky") / size) == c("cy")))
    return hits.groupBy("kx", "ky", "line1", "line2", *told, "cx", "cy").agg(F.min(F.struct("lon", "lat")).alias("p")).select("line1", "line2", *told, "p.lon", "p.lat", "cx", "cy")


def _dealt_by_pairs(rows: DataFrame, cells: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by their keys; the number of tasks follows the pairs of segments in ``cells`` (cx, cy)."""
    tests = cells.groupBy("cx", "cy").count().agg(F.sum(F.col("count").cast("double") * F.col("count")) / 2).first()[0] or 0.0
    if tests > PAIRS_A_TASK:  # a stated number of tasks, as the sizes of the shuffled segments don't tell what comes of them
        return rows.repartition(min(8192, max(int(tests / PAIRS_A_TASK), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))), *keys)
    return rows.repartition(*keys)


def _crossed(segments: DataFrame, id_col: str, size: float, *names: Column) -> DataFrame:
    """(cx, cy, line, the names, x1, y1, x2, y2): segments by the cells along them, each cell in one task in the order of the lines."""
    cut = _cells_along(segments.select(F.col(id_col).cast("long").alias("line"), *names, "x1", "y1", "x2", "y2"), F.lit(0.0), 0.0, size)
    cut = cut.select("cx", "cy", "line", *(["name"] if names else []), "x1", "y1", "x2", "y2")
    return _dealt_by_pairs(cut, cut, "cx", "cy").sortWithinPartitions("cx", "cy", "line")


def crossings(segments: DataFrame, id_col: str = "id", size: float = 0.002) -> DataFrame:
    """(line1, line2, lon, lat): the rows of :func:`street_crossings`, found in blocks of pairs instead of a row a pair. Ids are whole numbers.

    Only the segments move; each task divides its cells as finely as they are crowded.
    """
    return _crossed(segments, id_col, size).mapInArrow(K.crossing_rows(size), "line1 long, line2 long, lon double, lat double")


def crossings_per_street(segments: DataFrame, id_col: str = "id", size: float = 0.002) -> DataFrame:
    """(street, crossings): how many rows of :func:`crossings` each street has, counted where they are found."""
    return _crossed(segments, id_col, size).mapInArrow(K.crossings_a_line(size), "street long, crossings long").groupBy("street").agg(F.sum("crossings").alias("crossings"))


def merged_crossings(segments: DataFrame, id_col: str = "id", size: float = 0.002) -> DataFrame:
    """(kx, ky, type, n_streets, streets, lon, lat): the rows of :func:`merge_crossings`, merged where the crossings are found."""
    rows = _crossed(segments, id_col, size).mapInArrow(K.merged_rows(size), "kx double, ky double, streets array<bigint>, lon double, lat double")
    n = F.size("streets")
    return rows.select("kx", "ky", F.when(n > 2, "complex_crossing").otherwise("crossing").alias("type"), n.alias("n_streets"), "streets", "lon", "lat")


def crossing_name_counts(segments: DataFrame, id_col: str = "id", name_col: str = "name", size: float = 0.002) -> DataFrame:
    """(name, address, n): how many of :func:`named_crossings` have a name and address, without a row for each. A street has one name, or none: then it is its id."""
    name = F.coalesce(F.col(name_col), F.col(id_col).cast("string")).alias("name")
    counts = _crossed(segments, id_col, size, name).mapInArrow(K.merged_names(size), "names array<string>, n long").groupBy("names").agg(F.sum("n").alias("n"))
    label, address = _label(F.size("names") > 2, F.col("names"))
    return counts.groupBy(label.alias("name"), address.alias("address")).agg(F.sum("n").alias("n"))


def street_pair_totals(segments: DataFrame, id_col: str = "id", size: float = 0.005) -> DataFrame:
    """(street, pairs, metres): what :func:`crossing_pair_totals` gives for the crossings of the segments, of which none is shuffled.

    A street is at home in the tile of its middle. To each tile go the segments that touch the cells and boxes of the streets that
    live there; its task finds these streets' crossings, each at both of its streets, and measures their pairs in blocks.
    """
    c = F.col
    of = Window.partitionBy("line")
    x0, x1, y0, y1 = F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = segments.select(c(id_col).alias("line"), "x1", "y1", "x2", "y2").where("x1 + x2 + y1 + y2 is not null")
    middle = lambda low, high: F.floor((F.min(low).over(of) + F.max(high).over(of)) / 2 / size)
    rows = rows.withColumns({"ux": middle(x0, x1), "uy": middle(y0, y1)}).withColumn("line", c("line").cast("long"))
    filed = _cells_along(rows, F.lit(0.0), 0.0, size)
    lived = filed.groupBy("cx", "cy", "ux", "uy").agg(F.min(x0).alias("bx0"), F.max(x1).alias("bx1"), F.min(y0).alias("by0"), F.max(y1).alias("by1")).withColumnsRenamed({"ux": "hx", "uy": "hy"})
    touch = (x0 <= c("bx1") + K.SLACK) & (x1 >= c("bx0") - K.SLACK) & (y0 <= c("by1") + K.SLACK) & (y1 >= c("by0") - K.SLACK)
    near = filed.join(lived, ["cx", "cy"]).where(touch)
    near = near.select("hx", "hy", "line", "x1", "y1", "x2", "y2", ((c("ux") == c("hx")) & (c("uy") == c("hy"))).cast("int").alias("home"))
    dealt = _dealt_by_pairs(near, filed, "hx", "hy").sortWithinPartitions("hx", "hy", "line", "x1", "y1", "x2", "y2")
    return dealt.mapInArrow(K.street_totals, "street long, pairs long, metres double").withColumn("metres", c("metres") * S.METRES_PER_DEGREE)


def merge_crossings(crossings: DataFrame) -> DataFrame:
    """(kx, ky, type, n_streets, streets, lon, lat): crossings at one place rounded to 8 decimals; over two streets make it complex.

    With the cells of :func:`street_crossings` they merge where they were found. With name1 and name2 there is ``names``, one for each street.
    """
    cell = [n for n in ("cx", "cy") if n in crossings.columns]
    named = "name1" in crossings.columns
    ends = [F.struct(F.col(f"line{k}").alias("s"), F.col(f"name{k}").alias("n")) if named else F.col(f"line{k}") for k in (1, 2)]
    at = crossings.groupBy(_key(F.col("lon")).alias("kx"), _key(F.col("lat")).alias("ky"), *cell)
    both = at.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(*ends))))).alias("streets"), F.min(F.struct("line1", "line2", "lon", "lat")).alias("first"))
    n = F.size("streets")
    streets = [F.transform("streets", lambda x: x.s).alias("streets"), F.transform("streets", lambda x: x.n).alias("names")] if named else ["streets"]
    return both.select("kx", "ky", F.when(n > 2, "complex_crossing").otherwise("crossing").alias("type"), n.alias("n_streets"), *streets, "first.lon", "first.lat")


def _label(complex_: Column, names: Column) -> tuple[Column, Column]:
    """Name and address of a crossing of so named streets."""
    label = F.concat(F.when(complex_, "Complex_Crossing_").otherwise("Crossing_"), F.array_join(F.slice(names, 1, 3), "_"))
    return label, F.concat(F.lit("Intersection of "), F.array_join(names, " and "))


def named_crossings(merged: DataFrame) -> DataFrame:
    """(kx, ky, name, type, address, lon, lat) of merged crossings with ``names``; names join up to three streets, a missing one is the street's id."""
    names = F.zip_with("names", "streets", lambda n, s: F.coalesce(n, s.cast("string")))
    label, address = _label(F.col("type") != "crossing", names)
    return merged.select("kx", "ky", label.alias("name"), "type", address.alias("address"), "lon", "lat")


def crossing_nodes(merged: DataFrame, names: DataFrame, first_id: int) -> DataFrame:
    """(id, name, type, address, lon, lat): new nodes numbered from ``first_id`` in the order of their places; names join up to three streets.

    ``names``: (id, name) of the streets, unless the crossings bring their own.
    """
    if "names" not in merged.columns:
        keys = ["kx", "ky"]
        exploded = merged.select("*", F.posexplode("streets").alias("k", "street")).join(names.select(F.col("id").alias("street"), F.col("name").alias("street_name")), "street", "left")
        listed = F.array_sort(F.collect_list(F.struct("k", "street", F.col("street_name").alias("n"))))
        merged = exploded.groupBy(*keys, "type", "n_streets", "lon", "lat").agg(F.transform(listed, lambda s: s.n).alias("names"), F.transform(listed, lambda s: s.street).alias("streets"))
    return numbered(named_crossings(merged), ["kx", "ky"], "id", first_id).drop("kx", "ky")


def number_rows(df: DataFrame, order: list[str], first: int, buckets: int = 64) -> DataFrame:
    """The rows with gapless ``id`` from ``first``, by hash bucket and then ``order``: no task sees more than a bucket."""
    rows = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_s"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return rows.withColumn("_p", place).join(F.broadcast(starts), "_b").withColumn("id", F.col("_s") + F.col("_p") - 1 + first).drop("_b", "_p", "_s")


def crossing_pairs_on_street(crossings: DataFrame) -> DataFrame:
    """(street, crossing1, crossing2, other1, other2, distance_m): unordered pairs of crossings on one street; planar degrees times 111320."""
    side = lambda s, o: crossings.select(F.col(s).alias("street"), F.col("id"), F.col(o).alias("other"), "lon", "lat")
    on = side("line1", "line2").unionByName(side("line2", "line1"))
    a, b = on.alias("a"), on.alias("b")
    pairs = a.join(b, (F.col("a.street") == F.col("b.street")) & (F.col("a.id") < F.col("b.id")))
    d = F.sqrt(F.pow(F.col("a.lon") - F.col("b.lon"), 2) + F.pow(F.col("a.lat") - F.col("b.lat"), 2)) * S.METRES_PER_DEGREE
    return pairs.select(F.col("a.street").alias("street"), F.col("a.id").alias("crossing1"), F.col("b.id").alias("crossing2"), F.col("a.other").alias("other1"), F.col("b.other").alias("other2"), d.alias("distance_m"))


def _pair_totals(batches):
    """(street, pairs, metres) from Arrow batches in the order of the street; a street's rows may go on in the next batch."""
    import numpy as np
    import pyarrow as pa

    def distances(x, y, block: int = 512) -> float:
        total = 0.0
        for i in range(0, len(x), block):
            p, q = x[i : i + block, None], y[i : i + block, None]
            own = np.sqrt((p - x[None, i : i + block]) ** 2 + (q - y[None, i : i + block]) ** 2).sum() / 2
            total += own + sum(np.sqrt((p - x[None, j : j + 8192]) ** 2 + (q - y[None, j : j + 8192]) ** 2).sum() for j in range(i + block, len(x), 8192))
        return total

    def of_street(ids, x, y):
        pairs, metres = len(ids) * (len(ids) - 1) // 2, distances(x, y)
        order = np.argsort(ids, kind="stable")
        edges = np.flatnonzero(np.diff(ids[order])) + 1
        for same in np.split(order, edges) if len(edges) + 1 < len(ids) else ():  # crossings of one id are no pair
            if len(same) > 1:
                pairs, metres = pairs - len(same) * (len(same) - 1) // 2, metres - distances(x[same], y[same])
        return pairs, metres * S.METRES_PER_DEGREE

    def rows(cols, ends):
        found = [(int(cols[0][a]), *of_street(*(c[a:b] for c in cols[1:]))) for a, b in zip(ends[:-1], ends[1:])]
        found = [f for f in found if f[1]]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], ["street", "pairs", "metres"])

    held: list = []  # columns of the last street so far
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        starts = np.flatnonzero(np.diff(cols[0])) + 1
        if held and held[0][0][0] == cols[0][0] and not len(starts):
            held.append(cols)
            continue
        if held:
            cols = [np.concatenate(parts) for parts in zip(*held, cols)]
            starts = np.flatnonzero(np.diff(cols[0])) + 1
        if len(starts):
            yield rows(cols, [0, *starts.tolist()])
            cols = [c[starts[-1] :] for c in cols]
        held = [cols]
    if held:
        cols = [np.concatenate(parts) for parts in zip(*held)]
        yield rows(cols, [0, len(cols[0])])


def crossing_pair_totals(crossings: DataFrame) -> DataFrame:
    """(street, pairs, metres): number and summed distance of what :func:`crossing_pairs_on_street` gives, without a row for each pair.

    A street's crossings meet in one task, in the order of the street, and their pairs are measured in blocks.
    """
    side = lambda s: F.struct(F.col(s).cast("long").alias("street"), F.col("id").cast("long").alias("id"), "lon", "lat")
    on = crossings.select(F.explode(F.array(side("line1"), side("line2"))).alias("c")).select("c.*")
    return on.repartition("street").sortWithinPartitions("street").mapInArrow(_pair_totals, "street long, pairs long, metres double")


#: Points that one task tests against the areas.
POINTS_A_TASK = 50_000


def points_in_areas(points: DataFrame, rings: DataFrame, buffer_m: float = 0.0, size: float = 0.01) -> DataFrame:
    """(point_id, area_id, containment, boundary_m): each point inside an area's ring, or within a buffer of it, with its distance to the ring.

    ``rings``: (id, line). Rings go to the cells of their box (grown by the buffer), points to their own.
    """
    grow = buffer_m / S.METRES_PER_DEGREE * 2
    lon, lat = F.transform("line", lambda p: p.lon), F.transform("line", lambda p: p.lat)
    boxed = in_cells(rings.select(F.col("id").alias("area_id"), "line"), F.array_min(lon) - grow, F.array_min(lat) - grow, F.array_max(lon) + grow, F.array_max(lat) + grow, size)
    pts = points.select(F.col("id").alias("point_id"), "lon", "lat")
    n = pts.count()
    if n > POINTS_A_TASK:  # dealt by their number: the files of a few million points are small, and one task would read them all
        pts = pts.repartition(min(8192, max(n // POINTS_A_TASK + 1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    pts = pts.withColumn("cx", F.floor(F.col("lon") / size).cast("long")).withColumn("cy", F.floor(F.col("lat") / size).cast("long"))
    both = pts.join(boxed, ["cx", "cy"]).withColumn("inside", S.point_in_ring(F.col("lon"), F.col("lat"), F.col("line"))).withColumn("boundary_m", S.distance_to_ring_m(F.col("lon"), F.col("lat"), F.col("line")))
    return both.where(F.col("inside") | (F.col("boundary_m") <= buffer_m) & F.lit(buffer_m > 0)).select("point_id", "area_id", F.when(F.col("inside"), "inside").otherwise("buffer").alias("containment"), "boundary_m")


def filter_points_in_areas(found: DataFrame, low: float = 0.0, high: float = float("inf"), kinds: tuple[str, ...] = ("inside",), only_one: bool = False) -> DataFrame:
    """Pairs with a distance in the range and a listed containment; ``only_one``: of points that are then in exactly one area."""
    kept = found.where(F.col("boundary_m").between(low, high) & F.col("containment").isin(*kinds))
    if not only_one:
        return kept
    alone = kept.groupBy("point_id").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*kept.columns)).alias("_r"))
    return alone.where("_n = 1").select("_r.*")


def _span(k0: Column, k1: Column, low: Column, high: Column) -> Column:
    """struct(a, b): the t at which ``low <= k0 + k1 t <= high``; null where there is none."""
    slope = F.nullif(k1, F.lit(0.0))
    x, y = (low - k0) / slope, (high - k0) / slope
    always = F.when((k0 >= low) & (k0 <= high), F.struct(F.lit(-1e300).alias("a"), F.lit(1e300).alias("b")))
    return F.when(F.abs(k1) < 1e-300, always).otherwise(F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))


def with_capsule_spans(pairs: DataFrame, radius: float) -> DataFrame:
    """The rows (x1, y1, x2, y2, u1, v1, u2, v2) with ``a`` and ``b``: the part of the segment from 0 to 1 that lies within ``radius`` of the edge u, v; nulls where none does.

    What lies within a distance of an edge is convex, so it is one part: that of the two discs at the edge's ends
    and of the strip between them, together.
    """
    c = F.col
    dx, dy, ex, ey = c("x2") - c("x1"), c("y2") - c("y1"), c("u2") - c("u1"), c("v2") - c("v1")
    rows = pairs.withColumns({"_dx": dx, "_dy": dy, "_ex": ex, "_ey": ey}).withColumns({"_q": c("_dx") * c("_dx") + c("_dy") * c("_dy"), "_l": c("_ex") * c("_ex") + c("_ey") * c("_ey")})

    def disc(u: str, v: str) -> Column:
        q = F.nullif(c("_q"), F.lit(0.0))
        half = (c("_dx") * (c("x1") - c(u)) + c("_dy") * (c("y1") - c(v))) / q
        rest = half * half - (F.pow(c("x1") - c(u), 2) + F.pow(c("y1") - c(v), 2) - radius * radius) / q
        return F.when((c("_q") > 0) & (rest >= 0), F.struct((-half - F.sqrt(F.greatest(rest, F.lit(0.0)))).alias("a"), (-half + F.sqrt(F.greatest(rest, F.lit(0.0)))).alias("b")))

    wide = radius * F.sqrt("_l")
    across = _span(c("_ex") * (c("y1") - c("v1")) - c("_ey") * (c("x1") - c("u1")), c("_ex") * c("_dy") - c("_ey") * c("_dx"), -wide, wide)
    along = _span(c("_ex") * (c("x1") - c("u1")) + c("_ey") * (c("y1") - c("v1")), c("_ex") * c("_dx") + c("_ey") * c("_dy"), F.lit(0.0), c("_l"))
    rows = rows.withColumns({"_1": disc("u1", "v1"), "_2": disc("u2", "v2"), "_3": across, "_4": F.when(c("_l") > 0, along)})
    strip = F.when(F.greatest("_3.a", "_4.a") <= F.least("_3.b", "_4.b"), F.struct(F.greatest("_3.a", "_4.a").alias("a"), F.least("_3.b", "_4.b").alias("b")))
    rows = rows.withColumn("_5", F.when(c("_3").isNotNull() & c("_4").isNotNull(), strip))
    start, end = F.greatest(F.least("_1.a", "_2.a", "_5.a"), F.lit(0.0)), F.least(F.greatest("_1.b", "_2.b", "_5.b"), F.lit(1.0))
    some = (c("_q") > 0) & (c("_1").isNotNull() | c("_2").isNotNull() | c("_5").isNotNull()) & (start < end)
    return rows.withColumns({"a": F.when(some, start), "b": F.when(some, end)}).select(*pairs.columns, "a", "b")


def boundary_streets(segments: DataFrame, rings: DataFrame, areas: DataFrame, buffer_deg: float = 1e-4, share: float = 0.3, id_col: str = "id", metric=S.haversine_m) -> DataFrame:
    """(street_id, area_id, overlap_m, ratio, boundary_type): streets of which at least a share of their metres runs within a buffer of an area's ring.

    ``segments`` (id, seg, x1, y1, x2, y2) of streets, ``rings`` the same of areas, ``areas`` (id, line). The buffer is in degrees,
    its ends are round. Each segment is clipped exactly by the buffers of the ring edges near it, and the parts are united, so
    none counts twice. A street is ``internal`` if no piece of it lies outside, else ``boundary_crossing`` if it meets the
    ring, else ``boundary_adjacent``; what keeps out of the buffer is ``external`` and has no row. Pieces that run
    along the ring itself may fall on either side. Streets without length have no row.
    """
    c, size = F.col, 50 * buffer_deg
    segs = segments.select(c(id_col).alias("street_id"), "seg", "x1", "y1", "x2", "y2")
    edges = rings.select(c("id").alias("area_id"), c("x1").alias("u1"), c("y1").alias("v1"), c("x2").alias("u2"), c("y2").alias("v2"))
    low = lambda p, q, pad=0.0: F.least(p, q) - pad
    left = in_cells(segs, low("x1", "x2"), low("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2"), size)
    right = in_cells(edges, low("u1", "u2", buffer_deg), low("v1", "v2", buffer_deg), F.greatest("u1", "u2") + buffer_deg, F.greatest("v1", "v2") + buffer_deg, size)
    once = (F.floor(F.greatest(low("x1", "x2"), low("u1", "u2", buffer_deg)) / size) == c("cx")) & (F.floor(F.greatest(low("y1", "y2"), low("v1", "v2", buffer_deg)) / size) == c("cy"))  # of the cells that both touch, the first
    beside = settled(left.join(right, ["cx", "cy"]).where(once).drop("cx", "cy"))  # written first, else the clipping is worked out inside the join's condition
    near = settled(with_capsule_spans(beside, buffer_deg).where("a is not null"))

    key = ["street_id", "area_id", "seg"]
    w = Window.partitionBy(*key).orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = near.withColumn("_new", F.when(reach.isNull() | (c("a") > reach), 1).otherwise(0)).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = islands.groupBy(*key, "_i", "x1", "y1", "x2", "y2").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    at = lambda t: (c("x1") + c(t) * (c("x2") - c("x1")), c("y1") + c(t) * (c("y2") - c("y1")))
    overlap = parts.groupBy("street_id", "area_id").agg(F.sum(metric(*at("a"), *at("b"))).alias("overlap_m"))
    total = segs.groupBy("street_id").agg(F.sum(metric(c("x1"), c("y1"), c("x2"), c("y2"))).alias("total_m"))
    kept = overlap.join(total, "street_id").withColumn("ratio", F.least(F.lit(1.0), c("overlap_m") / F.nullif("total_m", F.lit(0.0)))).where(c("ratio") >= share).drop("total_m")

    dx, dy, ex, ey = c("x2") - c("x1"), c("y2") - c("y1"), c("u2") - c("u1"), c("v2") - c("v1")
    turn = dx * ey - dy * ex
    t = ((c("u1") - c("x1")) * ey - (c("v1") - c("y1")) * ex) / F.nullif(turn, F.lit(0.0))
    u = ((c("u1") - c("x1")) * dy - (c("v1") - c("y1")) * dx) / F.nullif(turn, F.lit(0.0))
    cuts = near.withColumns({"t": t, "u": u}).where("t between 0 and 1 and u between 0 and 1").groupBy(*key).agg(F.array_sort(F.collect_set("t")).alias("cuts"))
    ends = F.concat(F.array(F.lit(0.0)), F.coalesce("cuts", F.array().cast("array<double>")), F.array(F.lit(1.0)))
    pieces = kept.select("street_id", "area_id").join(segs, "street_id").join(cuts, key, "left").withColumn("ends", ends)
    middle = F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda i: F.when(F.get("ends", i) - F.get("ends", i - 1) > 1e-12, (F.get("ends", i) + F.get("ends", i - 1)) / 2))
    pieces = pieces.select("street_id", "area_id", "x1", "y1", "x2", "y2", c("cuts").isNotNull().alias("meets"), F.explode(F.array_compact(middle)).alias("t"))
    told = pieces.join(areas.select(c("id").alias("area_id"), "line"), "area_id").withColumn("inside", S.point_in_ring(*at("t"), c("line")))
    kind = told.groupBy("street_id", "area_id").agg(F.when(F.bool_and("inside"), "internal").when(F.bool_or("meets"), "boundary_crossing").otherwise("boundary_adjacent").alias("boundary_type"))
    return kept.join(kind, ["street_id", "area_id"])


def radius_subgraph(centres: DataFrame, nodes: DataFrame, edges: DataFrame, radius_m: float = 500.0, default: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """The nodes (centre_id, id, distance_m) within a radius of each centre, and the edges (centre_id, edge columns, weight) with both ends among them.

    The weight is the crossing's distance where the edges have that column, else their distance; a missing one is ``default``.
    """
    near = radius_nodes(centres, nodes, radius_m)
    inside = induced_edges(near.select(F.col("centre_id").alias("seed"), F.col("id").alias("node")), edges).withColumnRenamed("seed", "centre_id")
    kept = [F.col(c).cast("double") for c in ("crossing_distance_meters", "distance") if c in edges.columns][:1]
    return near, inside.withColumn("weight", F.coalesce(*kept, F.lit(default)))


def radius_nodes(centres: DataFrame, nodes: DataFrame, radius_m: float = 500.0) -> DataFrame:
    """(centre_id, id, distance_m): nodes within a radius of each centre, by a cell join and the exact distance.

    Cells are half a radius high, and what lies outside a centre's box is dropped before its distance is worked out. The number
    of tasks follows the pairs to test.
    """
    reach = radius_m / LEAST_PER_DEGREE
    size = reach / 2
    c = centres.select(F.col("id").alias("centre_id"), F.col("lon").alias("clon"), F.col("lat").alias("clat")).withColumn("_w", _longitude_reach(reach, F.col("clat")))
    c = in_cells(c, F.col("clon") - F.col("_w"), F.col("clat") - reach, F.col("clon") + F.col("_w"), F.col("clat") + reach, size)
    n = nodes.select("id", "lon", "lat").withColumn("cx", F.floor(F.col("lon") / size).cast("long")).withColumn("cy", F.floor(F.col("lat") / size).cast("long"))
    crowd = c.groupBy("cx", "cy").agg(F.count(F.lit(1)).cast("double").alias("a")).join(n.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("b")), ["cx", "cy"])
    tests = crowd.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0.0
    if tests > PAIRS_A_TASK:
        tasks = min(8192, max(int(tests / PAIRS_A_TASK), int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        c, n = c.repartition(tasks, "cx", "cy"), n.repartition(tasks, "cx", "cy")
    boxed = c.join(n, ["cx", "cy"]).where((F.abs(F.col("lon") - F.col("clon")) <= F.col("_w")) & (F.abs(F.col("lat") - F.col("clat")) <= reach))
    pairs = boxed.withColumn("distance_m", S.haversine_m(F.col("clon"), F.col("clat"), F.col("lon"), F.col("lat")))
    return pairs.where(F.col("distance_m") <= radius_m).select("centre_id", "id", "distance_m")
