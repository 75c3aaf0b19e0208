"""Spatial column functions: distances, bearings, compass names, lines, rings and S2 cells.

A point is two double columns (lon, lat) or struct<lon,lat>; a line is array<struct<lon,lat>>; a ring the same, closed.
All functions return null for null input unless they say otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0

# Names of the compass points, clockwise from north.
COMPASS16_SHORT = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()
COMPASS16_LONG = (
    "North North-Northeast Northeast East-Northeast East East-Southeast Southeast South-Southeast "
    "South South-Southwest Southwest West-Southwest West West-Northwest Northwest North-Northwest"
).split()
COMPASS8_SHORT = "N NE E SE S SW W NW".split()
COMPASS8_NAMES = "north northeast east southeast south southwest west northwest".split()


def let(value: Column, body) -> Column:
    """``body(x)`` with x bound to a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _half_chord(lon1, lat1, lon2, lat2) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    return F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres on a sphere, by the arc sine; coordinates must be known."""
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), _half_chord(lon1, lat1, lon2, lat2))))


def haversine_edge(lon1: Column, lat1: Column, lon2: Column, lat2: Column, km: bool = False) -> Column:
    """Great-circle distance by atan2 with 1e-8 beside the cosine's square."""
    a = _half_chord(lon1, lat1, lon2, lat2)
    return F.lit(2 * EARTH_M / (1000 if km else 1)) * F.atan2(F.sqrt(a), F.sqrt(1 - a + 1e-8))


def equirectangular_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, km_per_degree: float = 111.32) -> Column:
    """Planar distance in degrees times a constant."""
    return F.sqrt(F.pow(lon2 - lon1, 2) + F.pow(lat2 - lat1, 2)) * km_per_degree


def geodesic_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 12) -> Column:
    """WGS-84 metres by Vincenty's inverse formula in a fixed number of rounds; coincident points 0, antipodal ones may stop short."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2, dl = F.atan((1 - f) * F.tan(F.radians(lat1))), F.atan((1 - f) * F.tan(F.radians(lat2))), F.radians(lon2 - lon1)
    su1, cu1, su2, cu2 = F.sin(u1), F.cos(u1), F.sin(u2), F.cos(u2)
    start = F.struct(*[c.alias(n) for n, c in (("l", dl), ("ss", F.lit(0.0)), ("cs", F.lit(1.0)), ("s", F.lit(0.0)), ("c2a", F.lit(1.0)), ("c2m", F.lit(0.0)), ("su1", su1), ("cu1", cu1), ("su2", su2), ("cu2", cu2), ("dl", dl))])

    def turn(x: Column, _: Column) -> Column:
        sl, cl = F.sin(x.l), F.cos(x.l)
        ss = F.sqrt(F.pow(x.cu2 * sl, 2) + F.pow(x.cu1 * x.su2 - x.su1 * x.cu2 * cl, 2))
        cs = x.su1 * x.su2 + x.cu1 * x.cu2 * cl
        s = F.atan2(ss, cs)
        sa = F.when(ss == 0, 0.0).otherwise(x.cu1 * x.cu2 * sl / F.nullif(ss, F.lit(0.0)))
        c2a = 1 - sa * sa
        c2m = F.when(c2a < 1e-15, 0.0).otherwise(cs - 2 * x.su1 * x.su2 / F.nullif(c2a, F.lit(0.0)))
        c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
        lam = x.dl + (1 - c) * f * sa * (s + c * ss * (c2m + c * cs * (-1 + 2 * c2m * c2m)))
        kept = [x[n].alias(n) for n in ("su1", "cu1", "su2", "cu2", "dl")]
        return F.struct(lam.alias("l"), ss.alias("ss"), cs.alias("cs"), s.alias("s"), c2a.alias("c2a"), c2m.alias("c2m"), *kept)

    def length(x: Column) -> Column:
        q = x.c2a * ((a * a - b * b) / (b * b))
        big = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q)))
        small = q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
        ds = small * x.ss * (x.c2m + small / 4 * (x.cs * (-1 + 2 * x.c2m * x.c2m) - small / 6 * x.c2m * (-3 + 4 * x.ss * x.ss) * (-3 + 4 * x.c2m * x.c2m)))
        return b * big * (x.s - ds)

    return F.when((lon1 == lon2) & (lat1 == lat2), 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn, length))


def bearing_rad(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing from north, -pi to pi."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing from north, 0 to 360."""
    return (F.degrees(bearing_rad(lon1, lat1, lon2, lat2)) + 360) % 360


def _nth(names: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))


def compass16(bearing: Column, long: bool = False) -> Column:
    """One of 16 names; halves round to even."""
    return _nth(COMPASS16_LONG if long else COMPASS16_SHORT, F.rint(bearing / 22.5) % 16)


def compass8_label(bearing: Column) -> Column:
    """``94°(E)``: whole degrees, half to even, and the nearest of 8 points; ties go to the point first in the list."""
    gap = F.array(*[F.least(F.abs(bearing - 45.0 * k), 360 - F.abs(bearing - 45.0 * k)) for k in range(8)])
    nearest = F.array_position(gap, F.array_min(gap)) - 1
    return F.concat(F.rint(bearing).cast("int").cast("string"), F.lit("°("), _nth(COMPASS8_SHORT, nearest), F.lit(")"))


def compass8_name(bearing: Column) -> Column:
    """Lower-case name of the nearest of 8 points; null is ``north``."""
    return F.coalesce(_nth(COMPASS8_NAMES, F.rint(bearing / 45) % 8), F.lit("north"))


def reverse_bearing(bearing: Column) -> Column:
    return (bearing + 180) % 360


def cardinal_to_bearing(name: Column) -> Column:
    """Degrees of a short compass name, any case; unknown names are null."""
    pairs = [F.lit(x) for k, n in enumerate(COMPASS16_SHORT) for x in (n, k * 22.5)]
    return F.try_element_at(F.create_map(*pairs), F.upper(name))


def metres_to_degrees(metres: Column, lat: Column) -> Column:
    """The larger of the latitude's and the longitude's degrees."""
    return F.greatest(metres / METRES_PER_DEGREE, metres / (METRES_PER_DEGREE * F.cos(F.radians(lat))))


def _segments(line: Column, value) -> Column:
    """``value(p, q)`` of each pair of neighbouring vertices; an empty array below two vertices."""
    n = F.size(line)
    pairs = F.when(n >= 2, F.arrays_zip(F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(1))).alias("p"), F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(1))).alias("q"))).otherwise(F.slice(F.arrays_zip(line.alias("p"), line.alias("q")), 1, 0))
    return F.transform(pairs, lambda z: value(z.p, z.q))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def line_length_m(line: Column, metric=haversine_m) -> Column:
    """Sum of segment lengths, 0 below two vertices."""
    return _sum(_segments(line, lambda p, q: metric(p.lon, p.lat, q.lon, q.lat)))


def multiline_length_m(lines: Column, metric=haversine_m) -> Column:
    """Sum over the parts."""
    return _sum(F.transform(lines, lambda line: line_length_m(line, metric)))


def _ends(line: Column, of) -> Column:
    p, q = F.get(line, 0), F.get(line, F.size(line) - 1)
    return of(p.lon, p.lat, q.lon, q.lat)


def straightness(line: Column, metric=haversine_m) -> Column:
    """End-to-end distance over length, 0 for lines without length."""
    return let(line_length_m(line, metric), lambda length: F.when(length > 0, _ends(line, metric) / F.nullif(length, F.lit(0.0))).otherwise(0.0))


def turn_count(line: Column, over: float = 30.0) -> Column:
    """Inner vertices where the bearing changes by more than ``over`` degrees either way."""
    change = lambda b: _segments(b, lambda p, q: F.abs(p - q))
    return let(_segments(line, lambda p, q: bearing_deg(p.lon, p.lat, q.lon, q.lat)), lambda b: F.size(F.filter(change(b), lambda d: F.least(d, 360 - d) > over)))


def line_bearing(line: Column) -> Column:
    """Bearing from the first to the last vertex."""
    return _ends(line, bearing_deg)


def project_on_line(lon: Column, lat: Column, line: Column) -> Column:
    """struct(d, lon, lat): the nearest point of a line by planar projection in degrees, and its distance in metres; first segment on ties."""

    def foot(p: Column, q: Column) -> Column:
        dx, dy = q.lon - p.lon, q.lat - p.lat
        norm = dx * dx + dy * dy
        t = F.when(norm > 0, F.least(F.greatest(((lon - p.lon) * dx + (lat - p.lat) * dy) / F.nullif(norm, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        x, y = p.lon + t * dx, p.lat + t * dy
        return F.struct((F.pow(lon - x, 2) + F.pow(lat - y, 2)).alias("k"), x.alias("lon"), y.alias("lat"))

    return let(F.array_min(_segments(line, foot)), lambda f: F.struct(haversine_m(lon, lat, f.lon, f.lat).alias("d"), f.lon.alias("lon"), f.lat.alias("lat")))


def distance_to_ring_m(lon: Column, lat: Column, ring: Column) -> Column:
    """Metres to the nearest point of a ring."""
    return project_on_line(lon, lat, ring).d


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule; points on the ring itself may fall either way."""
    crossing = _segments(ring, lambda p, q: F.when((p.lat > lat) != (q.lat > lat), F.when(lon < (q.lon - p.lon) * (lat - p.lat) / F.nullif(q.lat - p.lat, F.lit(0.0)) + p.lon, 1).otherwise(0)).otherwise(0))
    return F.aggregate(crossing, F.lit(0), lambda a, x: a + x) % 2 == 1


def line_centroid(line: Column) -> Column:
    """struct(lon, lat) weighted by planar segment length; the first vertex of a line without length."""
    w = _segments(line, lambda p, q: F.struct(F.sqrt(F.pow(q.lon - p.lon, 2) + F.pow(q.lat - p.lat, 2)).alias("w"), ((p.lon + q.lon) / 2).alias("x"), ((p.lat + q.lat) / 2).alias("y")))
    total = _sum(F.transform(w, lambda s: s.w))
    mean = lambda axis: _sum(F.transform(w, lambda s: s.w * s[axis])) / F.nullif(total, F.lit(0.0))
    return F.when(total > 0, F.struct(mean("x").alias("lon"), mean("y").alias("lat"))).otherwise(F.struct(F.get(line, 0).lon.alias("lon"), F.get(line, 0).lat.alias("lat")))


def ring_centroid(ring: Column) -> Column:
    """struct(lon, lat) weighted by area; the centroid of the outline where the area is zero."""
    w = _segments(ring, lambda p, q: F.struct((p.lon * q.lat - q.lon * p.lat).alias("w"), (p.lon + q.lon).alias("x"), (p.lat + q.lat).alias("y")))
    area = _sum(F.transform(w, lambda s: s.w))
    mean = lambda axis: _sum(F.transform(w, lambda s: s.w * s[axis])) / F.nullif(area * 3, F.lit(0.0))
    return F.when(area != 0, F.struct(mean("x").alias("lon"), mean("y").alias("lat"))).otherwise(line_centroid(ring))


# Fixed values of the S2 curve: position of cell (i, j) by orientation, and what each position does to the orientation.
S2_POSITION = (0, 1, 3, 2, 0, 3, 1, 2, 2, 3, 1, 0, 2, 1, 3, 0)
S2_TURN = (1, 0, 0, 3)


def _s2_face(c: Column) -> Column:
    """struct(face, u, v) of a unit vector struct(x, y, z): the cube side of the largest component and the place on it."""
    n = lambda a: F.nullif(a, F.lit(0.0))
    side = lambda f, u, v: F.struct(F.lit(f).alias("face"), u.alias("u"), v.alias("v"))
    x, y, z = c.x, c.y, c.z
    by_x = F.when(x < 0, side(3, z / n(x), y / n(x))).otherwise(side(0, y / n(x), z / n(x)))
    by_y = F.when(y < 0, side(4, z / n(y), -x / n(y))).otherwise(side(1, -x / n(y), z / n(y)))
    by_z = F.when(z < 0, side(5, -y / n(z), -x / n(z))).otherwise(side(2, -x / n(z), -y / n(z)))
    return F.when((F.abs(x) > F.abs(y)) & (F.abs(x) > F.abs(z)), by_x).when(F.abs(y) > F.abs(z), by_y).otherwise(by_z)


def s2_leaf(lat: Column, lon: Column) -> Column:
    """S2 leaf cell id as a signed long."""
    phi, theta = F.radians(lat), F.radians(lon)
    unit = F.struct((F.cos(phi) * F.cos(theta)).alias("x"), (F.cos(phi) * F.sin(theta)).alias("y"), F.sin(phi).alias("z"))
    at, turn = F.array(*map(F.lit, S2_POSITION)), F.array(*map(F.lit, S2_TURN))

    def ij(w: Column) -> Column:
        st = F.when(w >= 0, 0.5 * F.sqrt(1 + 3 * w)).otherwise(1 - 0.5 * F.sqrt(1 - 3 * w))
        return F.greatest(F.lit(0), F.least(F.lit((1 << 30) - 1), F.floor(st * (1 << 30)))).cast("long")

    def walk(s: Column, k: Column) -> Column:
        bit = lambda w: (F.floor(w / F.pow(F.lit(2.0), k)) % 2).cast("int")
        return let(F.get(at, s.o * 4 + bit(s.i) * 2 + bit(s.j)), lambda pos: F.struct(s.o.bitwiseXOR(F.get(turn, pos)).alias("o"), (s.pos * 4 + pos).alias("pos"), s.i.alias("i"), s.j.alias("j")))

    def leaf(f: Column) -> Column:
        start = F.struct((f.face % 2).cast("int").alias("o"), F.lit(0).cast("long").alias("pos"), ij(f.u).alias("i"), ij(f.v).alias("j"))
        pos = F.aggregate(F.sequence(F.lit(29), F.lit(0), F.lit(-1)), start, walk, lambda s: s.pos)
        return F.shiftleft(f.face.cast("long"), 61).bitwiseOR(F.shiftleft(pos, 1)).bitwiseOR(F.lit(1).cast("long"))

    return F.when(lat.isNotNull() & lon.isNotNull(), let(let(unit, _s2_face), leaf))


def s2_parent(leaf: Column, level: int) -> Column:
    """The cell of a level that holds a leaf."""
    lsb = 1 << (2 * (30 - level))
    return leaf.bitwiseAND(F.lit(-lsb)).bitwiseOR(F.lit(lsb))


def s2_cell(lat: Column, lon: Column, level: int) -> Column:
    """Cell id as unsigned decimal text."""
    return F.conv(F.hex(s2_parent(s2_leaf(lat, lon), level)), 16, 10)


def s2_tokens(lat: Column, lon: Column, level: int) -> Column:
    """The face, then one base-4 digit of the curve position for each level."""
    digit = lambda leaf, k: F.shiftrightunsigned(leaf, 61 - 2 * k).bitwiseAND(F.lit(3 if k else 7)).cast("int")
    return let(s2_leaf(lat, lon), lambda leaf: F.array(*[digit(leaf, k) for k in range(level + 1)]))


def group_tokens(tokens: Column, size: int = 2) -> Column:
    """Face, then digits packed ``size`` at a time in base 4; an error if their number does not divide."""

    def packed(t: Column) -> Column:
        n = F.size(t) - 1
        each = F.transform(F.sequence(F.lit(0), (n / size).cast("int") - 1), lambda k: F.aggregate(F.slice(t, k * size + 2, F.lit(size)), F.lit(0), lambda a, x: a * 4 + x))
        return F.when(n % size != 0, F.raise_error(F.lit("digits do not divide into groups"))).when(n > 0, F.concat(F.slice(t, 1, 1), each)).otherwise(t)

    return let(tokens, packed)


def ungroup_tokens(groups: Column, size: int = 2) -> Column:
    """The inverse of :func:`group_tokens`."""
    digits = lambda g: F.array(*[(F.floor(g / 4**k) % 4).cast("int") for k in range(size - 1, -1, -1)])
    return let(groups, lambda t: F.concat(F.slice(t, 1, 1), F.flatten(F.transform(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), digits))))


def position_features(values: list[Column], scales: int = 4, low: float = 1.0, high: float = 1000.0) -> Column:
    """sin and cos of each coordinate at geometrically spaced frequencies, interleaved: sin at even places, cos at odd ones."""
    steps = [low * (high / low) ** (k / max(scales - 1, 1)) for k in range(scales)]
    return F.array(*[f(v / s) for v in values for s in steps for f in (F.sin, F.cos)])


def edge_features(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """log(1 + metres), sine and cosine of the bearing, difference of longitude and latitude."""
    b = bearing_rad(lon1, lat1, lon2, lat2)
    return F.array(F.log1p(haversine_edge(lon1, lat1, lon2, lat2)), F.sin(b), F.cos(b), lon2 - lon1, lat2 - lat1)


def points(*coordinates: tuple[float, float]) -> Column:
    """A literal line."""
    return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in coordinates])
