"""Geometries of all kinds as one nested column: struct(kind, parts), parts of rings of points.

A point is a part of one ring of one point, a line a part of one ring, a polygon a part whose further rings are holes;
the multi kinds have several parts. Shapes are planar in degrees, lengths in metres by a metric.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spatial import haversine_m, let, line_length_m

NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
KINDS = ("POINT", "MULTIPOINT", "LINESTRING", "MULTILINESTRING", "POLYGON", "MULTIPOLYGON")


def _parts(kind: Column, coordinates: Column) -> Column:
    """Parts of the coordinates as JSON text: a list of points for points and lines, of rings or lines for the next two kinds."""
    flat, lists, nested = (F.from_json(coordinates, t) for t in ("array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"))
    found = (
        F.when(kind.isin("POINT", "LINESTRING"), F.array(F.array(flat))).when(kind == "MULTIPOINT", F.transform(flat, lambda p: F.array(F.array(p))))
        .when(kind == "MULTILINESTRING", F.transform(lists, lambda line: F.array(line))).when(kind == "POLYGON", F.array(lists)).when(kind == "MULTIPOLYGON", nested)
    )
    return F.transform(found, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat")))))


def _checked(kind: Column, parts: Column) -> Column:
    """struct(kind, parts), or null where a part or ring is empty or a coordinate unknown."""
    whole = lambda ring: F.coalesce((F.size(ring) > 0) & F.forall(ring, lambda p: p.lon.isNotNull() & p.lat.isNotNull()), F.lit(False))
    full = lambda part: F.coalesce((F.size(part) > 0) & F.forall(part, whole), F.lit(False))
    return let(F.struct(kind.alias("kind"), parts.alias("parts")), lambda g: F.when(F.coalesce((F.size(g.parts) > 0) & F.forall(g.parts, full), F.lit(False)), g))


def geometry_of_wkt(text: Column) -> Column:
    """A geometry from WKT, with or without SRID and further dimensions (which are dropped); null for empty, other and broken texts."""
    shape = r"(?is)^\s*(?:SRID=[0-9]+;)?\s*([A-Z]+?)\s*(?:ZM?|M)?\s*(\(.*\))\s*$"
    kind = F.upper(F.regexp_extract(text, shape, 1))
    body = F.regexp_replace(F.regexp_extract(text, shape, 2), rf"({NUMBER})\s+({NUMBER})(?:\s+{NUMBER})*", "[$1,$2]")
    loose = F.concat(F.lit("("), F.regexp_replace(body, r"[()]", ""), F.lit(")"))  # the points of a MULTIPOINT may have brackets of their own
    lists = F.translate(F.when(kind == "MULTIPOINT", loose).otherwise(body), "()", "[]")
    return F.when(kind.isin(*KINDS), _checked(kind, _parts(kind, F.regexp_replace(lists, r"(?<=[\[,])\+", ""))))


def geometry_of_geojson(text: Column) -> Column:
    """A geometry from a GeoJSON geometry; null for collections, empty and broken texts."""
    kind, at = F.upper(F.get_json_object(text, "$.type")), F.get_json_object(text, "$.coordinates")
    return F.when(kind.isin(*KINDS), _checked(kind, _parts(kind, F.when(kind == "POINT", F.concat(F.lit("["), at, F.lit("]"))).otherwise(at))))


def _moments(ring: Column) -> Column:
    """struct(area2, x, y, length, mx, my): twice the signed area and its centre, the length and the centre of the outline, from the ring's first point."""
    first = F.get(ring, 0)
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("a", "x", "y", "l", "mx", "my")], F.lit(0.0).alias("px"), F.lit(0.0).alias("py"))

    def step(s: Column, p: Column) -> Column:
        x, y = p.lon - first.lon, p.lat - first.lat
        cross, long = s.px * y - x * s.py, F.sqrt(F.pow(x - s.px, 2) + F.pow(y - s.py, 2))
        return F.struct(
            (s.a + cross).alias("a"), (s.x + (s.px + x) * cross).alias("x"), (s.y + (s.py + y) * cross).alias("y"), (s.l + long).alias("l"),
            (s.mx + long * (s.px + x) / 2).alias("mx"), (s.my + long * (s.py + y) / 2).alias("my"), x.alias("px"), y.alias("py"))

    centre = lambda s: F.struct(
        s.a.alias("a"), s.l.alias("l"),
        (first.lon + F.coalesce(F.try_divide(s.x, 3 * s.a), F.lit(0.0))).alias("x"), (first.lat + F.coalesce(F.try_divide(s.y, 3 * s.a), F.lit(0.0))).alias("y"),
        (first.lon + F.coalesce(F.try_divide(s.mx, s.l), F.lit(0.0))).alias("mx"), (first.lat + F.coalesce(F.try_divide(s.my, s.l), F.lit(0.0))).alias("my"))
    return F.aggregate(ring, zero, step, centre)


def _weighted(items: Column) -> Column:
    """struct(lon, lat): the mean of items struct(w, x, y); null where the weights are nothing."""
    total = F.aggregate(items, F.struct(*[F.lit(0.0).alias(c) for c in "wxy"]), lambda s, i: F.struct((s.w + i.w).alias("w"), (s.x + i.w * i.x).alias("x"), (s.y + i.w * i.y).alias("y")))
    return let(total, lambda t: F.when(t.w != 0, F.struct((t.x / F.nullif(t.w, F.lit(0.0))).alias("lon"), (t.y / F.nullif(t.w, F.lit(0.0))).alias("lat"))))


def _item(w: Column, x: Column, y: Column) -> Column:
    return F.struct(w.cast("double").alias("w"), x.alias("x"), y.alias("y"))


def _areas(part: Column) -> Column:
    """The rings of a polygon as weighted items: the outline's area, less those of the holes."""
    return F.transform(part, lambda ring, i: let(_moments(ring), lambda m: _item(F.abs(m.a) * F.when(i == 0, 1.0).otherwise(-1.0), m.x, m.y)))


def _outlines(parts: Column) -> Column:
    return F.transform(F.flatten(parts), lambda ring: let(_moments(ring), lambda m: _item(m.l, m.mx, m.my)))


def _points(parts: Column) -> Column:
    return F.transform(F.flatten(F.flatten(parts)), lambda p: _item(F.lit(1.0), p.lon, p.lat))


def centroid(geometry: Column) -> Column:
    """struct(lon, lat) of all parts (C15): points alike, lines by length, polygons by area without holes; what has no area counts as its outline, what has no length as its points."""
    parts = geometry.parts
    area = F.when(geometry.kind.contains("POLYGON"), _weighted(F.flatten(F.transform(parts, _areas))))
    line = F.when(~geometry.kind.contains("POINT"), _weighted(_outlines(parts)))
    return F.coalesce(area, line, _weighted(_points(parts)))


def center(geometry: Column) -> Column:
    """struct(lon, lat) of the first part alone (C14)."""
    return centroid(F.when(geometry.isNotNull(), F.struct(geometry.kind.alias("kind"), F.slice(geometry.parts, 1, 1).alias("parts"))))


def length_m(geometry: Column, metric=haversine_m) -> Column:
    """Metres of all lines; 0 for points and polygons (C17)."""
    return F.when(geometry.kind.contains("LINE"), F.aggregate(F.transform(F.flatten(geometry.parts), lambda line: line_length_m(line, metric)), F.lit(0.0), lambda a, x: a + x)).when(geometry.isNotNull(), 0.0)


def area(geometry: Column) -> Column:
    """Planar area of all polygons without their holes, in square degrees; 0 for points and lines."""
    items = F.flatten(F.transform(geometry.parts, _areas))
    return F.when(geometry.kind.contains("POLYGON"), F.aggregate(items, F.lit(0.0), lambda a, x: a + x.w) / 2).when(geometry.isNotNull(), 0.0)


def contains(geometry: Column, lon: Column, lat: Column) -> Column:
    """Whether a point lies in a polygon and in none of its holes, by the even-odd rule over all rings; points on a ring may fall either way; false for points and lines."""

    def crossings(ring: Column) -> Column:
        def step(s: Column, p: Column) -> Column:
            q = s.q
            hit = ((p.lat > lat) != (q.lat > lat)) & (lon < (q.lon - p.lon) * (lat - p.lat) / F.nullif(q.lat - p.lat, F.lit(0.0)) + p.lon)
            return F.struct(p.alias("q"), (s.n + F.coalesce(hit.cast("int"), F.lit(0))).alias("n"))

        return F.aggregate(ring, F.struct(F.get(ring, F.size(ring) - 1).alias("q"), F.lit(0).alias("n")), step, lambda s: s.n)

    total = F.aggregate(F.transform(F.flatten(geometry.parts), crossings), F.lit(0), lambda a, x: a + x)
    return F.when(geometry.kind.contains("POLYGON"), total % 2 == 1).when(geometry.isNotNull(), False)


def endpoints(geometry: Column) -> Column:
    """struct(x, y, start_x, start_y, end_x, end_y, line_length, polygon_area) (C26): a point's place, a polygon's centroid and area, the first and last point and the planar length of lines; what does not apply is null."""
    parts, kind = geometry.parts, geometry.kind
    line, polygon = kind.contains("LINE"), kind.contains("POLYGON")
    first = F.get(F.get(F.get(parts, 0), 0), 0)
    last = F.element_at(F.element_at(F.element_at(parts, -1), -1), -1)
    long = F.aggregate(_outlines(parts), F.lit(0.0), lambda a, x: a + x.w)
    at = F.when(polygon, centroid(geometry)).when(kind == "POINT", F.struct(first.lon.alias("lon"), first.lat.alias("lat")))
    ends = {"start_x": first.lon, "start_y": first.lat, "end_x": last.lon, "end_y": last.lat, "line_length": long}
    fields = [at.lon.alias("x"), at.lat.alias("y"), *[F.when(line, c).alias(n) for n, c in ends.items()], F.when(polygon, area(geometry)).alias("polygon_area")]
    return F.when(geometry.isNotNull(), F.struct(*fields))
