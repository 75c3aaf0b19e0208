"""Column functions that turn nodes, edges and paths into records and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spatial as S
from .text import blank_to_null, display_name

#: Road categories by highway tag.
HIGHWAYS = {
    "motorway": "motorway", "trunk": "major_road", "primary": "major_road", "secondary": "major_road", "tertiary": "major_road", "residential": "residential", "service": "service_road",
    "unclassified": "minor_road", "living_street": "residential", "pedestrian": "pedestrian", "footway": "pedestrian", "path": "path", "track": "track", "bridleway": "path", "steps": "pedestrian",
}
#: Categories of places by the tag they have; later tags win.
PLACE_TAGS = {
    "leisure": "leisure", "school": "education", "police": "emergency", "community_centre": "community", "car_rental": "transport", "parking": "transport", "museum": "culture", "healthcare": "healthcare",
    "shop": "commercial", "amenity": "amenity", "tourism": "tourism", "office": "business", "historic": "historic", "building": "building", "natural": "natural", "sport": "sport", "emergency": "emergency",
    "public_transport": "transport", "railway": "transport", "aeroway": "transport", "military": "military", "craft": "craft", "emergency_shelter": "emergency", "zoo": "tourism",
    "hospital_level_CN": "healthcare", "cemetery": "funeral", "place": "place", "government": "government", "diplomatic": "diplomatic", "embassy": "diplomatic", "consulate": "diplomatic",
    "castle_type": "historic", "heritage": "historic", "archaeological_site": "historic", "memorial": "historic", "tomb": "historic", "ruins": "historic", "theatre": "culture", "theatre_genre": "culture",
    "theatre_type": "culture", "cinema": "culture", "library": "education", "university": "education", "college": "education", "kindergarten": "education", "preschool": "education", "bank": "financial",
    "atm": "financial", "post_office": "service", "fire_station": "emergency", "ambulance": "emergency", "pharmacy": "healthcare", "clinic": "healthcare", "dentist": "healthcare", "veterinary": "healthcare",
    "restaurant": "food", "cafe": "food", "bar": "food", "pub": "food", "fast_food": "food", "cuisine": "food", "hotel": "accommodation", "hostel": "accommodation", "motel": "accommodation",
    "guest_house": "accommodation", "camp_site": "accommodation", "caravan_site": "accommodation", "club": "recreation",
}
#: Phrases for edge types that need no more than the type.
RELATIONS = {
    "pedestrian-crossing": "has a pedestrian crossing to", "complex-roundabout": "connects via a complex roundabout to", "highway-t-junction": "meets at a highway T-junction with",
    "major-complex-junction": "meets at a major complex junction with", "major-roundabout": "connects via a major roundabout to", "service-connection": "has a service connection to",
    "street-change": "connects to", "continuation": "continues as", "major-road-end": "ends at", "simple-roundabout": "connects via a simple roundabout to", "path-connection": "has a path connecting to",
    "three-way": "meets at a three-way intersection with", "four-way": "meets at a four-way intersection with", "complex-intersection": "has a complex intersection with", "bridge-intersection": "intersects with",
    "overlap": "overlaps with", "bridge-continuation": "continues across a bridge to", "highway-crossing": "crosses", "highway-interchange": "connects through a highway interchange to",
    "major-t-junction": "meets at a major T-junction with", "three-way-bend": "connects to", "highway-ramp": "has a highway ramp connecting to", "side-connection": "has a side connection to",
    "driveway-connection": "connects to",
}
#: Which node classes each named selection takes; ``None`` is the default selection.
SELECTIONS = {
    "no_intersection_nodes": ("point", "area"), "no_intersection": ("point", "area", "line"), "polygon_nodes": ("area",), "linestring_nodes": ("crossing_point", "line"),
    "with_intersection": ("crossing_point", "area", "line"), "all_point": ("point", "crossing_point", "area"), "all_nodes": ("point", "crossing_point", "area", "line", "other"), None: ("point", "area", "line", "other"),
}


def _mapped(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def road_category(highway: Column, bicycle: Column, cycleway: Column, sidewalk: Column, railway: Column, foot: Column) -> Column:
    """Category by highway, overridden in this order by bicycle, cycleway, sidewalk, railway and foot; else ``other``."""
    allowed = ("yes", "designated", "permitted")
    return (
        F.when(foot.isin(*allowed), "foot_path").when(railway.isNotNull(), "railway").when(sidewalk.isin("both", "left", "right", "separate"), "sidewalk")
        .when(cycleway.isNotNull(), "cycleway").when(bicycle.isin(*allowed), "bicycle_road").otherwise(F.coalesce(_mapped(HIGHWAYS, highway), F.lit("other")))
    )


def place_category(tags: dict[str, Column], category: Column | None = None) -> Column:
    """Category of the last listed tag that is filled. A category that is given is filled only where blank; without one the default is ``other``."""
    found = F.coalesce(*[F.when(tags[t] != "", F.lit(PLACE_TAGS[t])) for t in reversed(PLACE_TAGS) if t in tags], F.lit(None).cast("string"))
    if category is None:
        return F.coalesce(found, F.lit("other"))
    return F.when(F.coalesce(category, F.lit("")) == "", F.coalesce(found, category)).otherwise(category)


#: Other columns that may hold a name, those that may hold a house number, and the node caps of places.
NAME_COLUMNS = (
    "official_name", "alt_name", "short_name", "loc_name", "name_en", "name_zh", "name_de", "name_fr", "name_es", "name_it", "name_pt", "name_ko", "name_ru", "name_ja", "name_zh_Hans",
    "name_zh_Hant")
HOUSENUMBER_COLUMNS = ("addr_housenumber", "addr_housename", "housenumber", "house_number", "building_number", "number", "addr_number")
NODE_CAPS = {"newyork": 2000, "singapore": 500}


def _first_filled(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """The first of the columns that the table has that is neither null nor empty, as text; blanks count as filled."""
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns if c in df.columns], F.lit(None).cast("string"))


def coalesce_name(df: DataFrame) -> DataFrame:
    """The rows whose empty ``name`` is filled from the first filled of the other name columns; without any it stays as it is."""
    return df.withColumn("name", F.coalesce(_first_filled(df, ("name", *NAME_COLUMNS)), "name"))


def with_housenumber(df: DataFrame) -> DataFrame:
    """The rows with ``housenumber``, the first filled house number column as text, else null."""
    return df.withColumn("housenumber", _first_filled(df, HOUSENUMBER_COLUMNS))


def node_cap(place: Column, default: int = 2000) -> Column:
    """The most nodes that a graph of a place may have."""
    return F.coalesce(_mapped({k: str(v) for k, v in NODE_CAPS.items()}, F.lower(place)).cast("int"), F.lit(default))


def node_class(kind: Column, name: Column, address: Column) -> Column:
    """``area``, ``line``, ``point``, ``crossing_point`` (a point whose name or address tells of a crossing) or ``other``."""
    crossing = F.coalesce(name.rlike("(?i)crossing|intersection"), F.lit(False)) | F.coalesce(address.rlike("(?i)crossing|intersection"), F.lit(False))
    return F.when(kind == "area", "area").when(kind == "line", "line").when(kind == "point", F.when(crossing, "crossing_point").otherwise("point")).otherwise("other")


def relation_phrase(edge_type: Column, kind: Column, other_kind: Column, name: Column, other_name: Column) -> Column:
    """The words between two node names for an edge; null types are near, equal names continue. A boundary seen from no line has none."""
    t = F.lower(edge_type)
    through = (
        F.when(kind == "line", F.when(other_kind == "area", "passes through").otherwise("intersects with"))
        .when(kind == "area", F.when(other_kind == "line", "is very near to").otherwise("overlaps with")).otherwise("intersects with")
    )
    plain = {"contains": "contains", "within": "is within", "connects": "connects to"}
    return (
        F.when(t.isNull(), "is near").when(F.coalesce(name, F.lit("Unknown")) == F.coalesce(other_name, F.lit("Unknown")), "continues as").when(_mapped(RELATIONS, t).isNotNull(), _mapped(RELATIONS, t))
        .when(t.contains("crossing") & (t != "boundary_crossing"), "crosses").when(t.contains("boundary"), F.when(kind == "line", F.when(other_kind == "area", "bounds").otherwise("is bounded by")))
        .when(t == "nearest", "is near to").when(t.contains("intersects"), through).otherwise(F.coalesce(_mapped(plain, t), F.lit("is connected to")))
    )


def nearest_relation(kind: Column, other_kind: Column) -> Column:
    """``near`` from what is no point to a point, else ``nearest``."""
    return F.when((other_kind == "point") & (kind != "point"), "near").otherwise("nearest")


def middle_component(edge_type: Column, kind: Column, other_kind: Column, other_id: Column, street: Column, crossing: Column) -> Column:
    """What stands between source and target in a triple: the common street's or crossing's name where known, else the relation."""
    long_number = other_id.cast("string").rlike("^[0-9]{11,}$")
    return (
        F.when((edge_type == "on_same_street") & street.isNotNull(), street).when((edge_type == "crossing") & crossing.isNotNull(), crossing).when(edge_type == "nearest", nearest_relation(kind, other_kind))
        .when(edge_type.contains("boundary"), F.when((kind == "line") & (other_kind == "area"), "near").otherwise("bounds")).when((edge_type == "near") | long_number, "near").otherwise(edge_type)
    )


def triple_type(edge_type: Column, from_crossing: Column, to_crossing: Column) -> Column:
    t = F.lower(edge_type)
    return F.when(t.contains("on_same_street"), "street_segment").when(t.contains("crossing"), "decision_point").when(from_crossing & to_crossing, "street_segment")


def leg(lon1: Column, lat1: Column, lon2: Column, lat2: Column, metric=S.haversine_m) -> Column:
    """struct(length, direction) from one coordinate to the next; nulls where one is missing."""
    known = lon1.isNotNull() & lat1.isNotNull() & lon2.isNotNull() & lat2.isNotNull()
    return F.struct(F.when(known, metric(lon1, lat1, lon2, lat2)).alias("length"), S.compass8_label(S.bearing_deg(lon1, lat1, lon2, lat2)).alias("direction"))


def triple_diversity(sources: Column, targets: Column) -> Column:
    """Distinct (source, target) names of a path's triples as a share; 0.1 more for varied long paths, a fifth less for short ones, at most 1."""
    pairs = F.transform(F.arrays_zip(sources.alias("s"), targets.alias("t")), lambda z: F.concat_ws("->", F.coalesce(z.s, F.lit("unknown")), F.coalesce(z.t, F.lit("unknown"))))
    n = F.size(pairs)
    share = F.size(F.array_distinct(pairs)) / n
    lifted = F.when((share > 0.7) & (n + 1 > 5), share + 0.1).when(n + 1 < 4, share * 0.8).otherwise(share)
    return F.when(n > 0, F.least(lifted, F.lit(1.0))).otherwise(F.lit(0.0))


def duplicate_names(nodes: Column, names: Column) -> Column:
    """Names that a path meets more than once, sorted; missing and blank names count as ``Node_<id>``."""
    told = F.transform(F.arrays_zip(nodes.alias("i"), names.alias("n")), lambda z: F.coalesce(F.nullif(F.trim(z.n), F.lit("")), F.concat(F.lit("Node_"), z.i.cast("string"))))
    return F.array_sort(F.array_distinct(F.filter(told, lambda x: F.size(F.filter(told, lambda y: y == x)) > 1)))


def valid_endpoints(first_name: Column, first_kind: Column, last_name: Column, last_kind: Column) -> Column:
    """Whether both ends of a path are named; names of digits alone count for images only."""
    ok = lambda n, k: (F.coalesce(n, F.lit("")) != "") & (~F.coalesce(n, F.lit("")).rlike("^[0-9]+$") | (F.coalesce(k, F.lit("")) == "mapillary"))
    return ok(first_name, first_kind) & ok(last_name, last_kind)


def endpoint_name(name: Column, address: Column, street: Column, kind: Column, category: Column, node_id: Column, triple_name: Column) -> Column:
    """An image keeps its id; else the display name, the name in the path's triple, or ``Node_<id>``."""
    shown = display_name(name, address, street, kind, category, F.lit(None).cast("string"))
    return F.when(kind == "mapillary", node_id.cast("string")).otherwise(F.coalesce(shown, F.nullif(F.trim(triple_name), F.lit("")), F.concat(F.lit("Node_"), node_id.cast("string"))))


def node_description(node_id: Column, name: Column, category: Column, kind: Column, coordinates: Column, extra: dict[str, Column]) -> Column:
    """JSON of name, category, coordinates and the place fields that are filled."""
    fields = {"name": F.coalesce(blank_to_null(name), node_id.cast("string")), "category": F.coalesce(blank_to_null(category), kind, F.lit("unknown")), "coordinates": coordinates}
    return F.to_json(F.struct(*[c.alias(k) for k, c in (fields | {k: blank_to_null(c) for k, c in extra.items()}).items()]))


def enrich_message(content: Column, image_id: Column, coordinates: Column, facing: Column, path: Column, entities: Column) -> Column:
    """A user message with the image's coordinates and facing after its id, its path replaced by the cleaned one, and the place entities at the end.

    Coordinates that are there already are not added again; without the id's phrase they go to the end.
    """
    phrase = F.concat(F.lit("image with id "), image_id)
    face = F.coalesce(F.concat(F.lit(". When you face "), facing, F.lit(", you can see the scene in the image")), F.lit(""))
    at = F.concat(F.lit(" at "), coordinates)
    fresh = F.when(content.contains(phrase), F.replace(content, phrase, F.concat(phrase, at, face))).otherwise(F.concat(content, at, face))
    again = F.when((face == "") | content.contains("When you face"), content).when(content.contains(phrase), F.replace(content, coordinates, F.concat(coordinates, face))).otherwise(F.concat(content, face))
    placed = F.when(content.contains(at), again).otherwise(fresh)
    mark, based = "Spatial Reasoning Path:", "Based on"
    before, after = F.split_part(placed, F.lit(mark), F.lit(1)), F.substr(placed, F.instr(placed, mark) + len(mark))
    tail = F.when(F.instr(after, based) > 0, F.concat(F.lit(". "), F.substr(after, F.instr(after, based)))).otherwise(F.lit(""))
    pathed = F.when((F.coalesce(path, F.lit("")) != "") & placed.contains(mark), F.concat(before, F.lit(mark + " "), path, tail)).otherwise(placed)
    return F.concat(pathed, F.lit("\n"), entities)


def training_example(user: Column, answer: Column, image: Column, graph: Column, label: float = 1.0) -> Column:
    """struct(messages, images, graphs, label): a user turn that shows a graph and an image, and its answer."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(turn("user", F.concat(F.lit("<graph><image>"), user)), turn("assistant", answer))
    return F.struct(messages.alias("messages"), F.array(image).alias("images"), F.array(graph).alias("graphs"), F.lit(label).alias("label"))


def direction_from_image(lon: Column, lat: Column, image_lon: Column, image_lat: Column) -> Column:
    """``, North, 120m from image location``; empty under 0.1 m."""
    d = S.haversine_m(image_lon, image_lat, lon, lat)
    name = S.compass16(S.bearing_deg(image_lon, image_lat, lon, lat), long=True)
    return F.when(d < 0.1, "").otherwise(F.concat(F.lit(", "), name, F.lit(", "), F.rint(d).cast("long").cast("string"), F.lit("m from image location")))


def numbers_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"[-+]?\d*\.?\d+"), F.lit(0)), lambda x: x.cast("double"))


def geometry_text(wkt: Column) -> Column:
    """Coordinates of a geometry's text with 8 decimals: a point, the ends of lines, the first point of rings; empty without numbers."""
    kind, xy = F.upper(wkt), numbers_in(wkt)
    at = lambda i: F.format_string("%.8f", F.get(xy, F.lit(i)) if i >= 0 else F.get(xy, F.size(xy) + i))
    one = lambda name: F.when(F.size(xy) >= 2, F.concat(F.lit(f"{name}(lon: "), at(0), F.lit(", lat: "), at(1), F.lit(")")))
    two = lambda name: F.when(F.size(xy) >= 4, F.concat(F.lit(f"{name}(lon: "), at(0), F.lit(", lat: "), at(1), F.lit(" to lon: "), at(-2), F.lit(", lat: "), at(-1), F.lit(")")))
    told = (
        F.when(kind.contains("POINT"), one("POINT")).when(kind.contains("MULTILINESTRING"), F.coalesce(two("MULTILINE"), F.lit("MULTILINE(complex)"))).when(kind.contains("LINESTRING"), two("LINE"))
        .when(kind.contains("MULTIPOLYGON"), F.coalesce(one("MULTI_APPROX"), F.lit("MULTIPOLYGON(complex)"))).when(kind.contains("POLYGON"), F.coalesce(one("APPROX"), F.lit("POLYGON(complex)")))
    )
    return F.coalesce(told, F.lit(""))


def geometry_lonlat(text: Column) -> Column:
    """struct(lon, lat) of WKT or GeoJSON text: the first two numbers of it; null without them."""
    xy = numbers_in(text)
    return F.when(F.size(xy) >= 2, F.struct(xy[0].alias("lon"), xy[1].alias("lat")))


def coordinates_of(text: Column, node_lon: Column, node_lat: Column, lon: Column, lat: Column) -> Column:
    """struct(lon, lat) from ``(lon, lat)`` text, else the node's place, else the columns; null with none."""
    part = lambda k: F.nullif(F.regexp_extract(text, r"\(\s*([-+0-9.eE]+)\s*,\s*([-+0-9.eE]+)\s*\)", k), F.lit("")).try_cast("double")
    told = F.when(part(1).isNotNull() & part(2).isNotNull(), F.struct(part(1).alias("lon"), part(2).alias("lat")))
    pair = lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("lon"), y.alias("lat")))
    return F.coalesce(told, pair(node_lon, node_lat), pair(lon, lat))


def parse_node_text(text: Column) -> Column:
    """struct(lon, lat, category, name, area, district) read from a node text, case-insensitively; nulls for what is not there."""
    field = lambda names: F.nullif(F.trim(F.regexp_extract(text, rf"(?i)(?:{names}): ([^,(]*)", 1)), F.lit(""))
    xy = lambda k: F.nullif(F.regexp_extract(text, r"(?i)Coordinates: \(\s*([-0-9.]+)\s*,\s*([-0-9.]+)\s*\)", k), F.lit("")).cast("double")
    return F.struct(xy(1).alias("lon"), xy(2).alias("lat"), field("Category").alias("category"), field("Name").alias("name"), field("Planning area|Neighborhood").alias("area"), field("District|Borough").alias("district"))


def normalise_path(path: Column, data_root: str, out_root: str, old_roots: dict[str, str], homes: tuple[str, ...] = ()) -> Column:
    """A path under the data or output root: ``./`` goes, what follows a known old root or a ``data/`` beginning is put under its new root; others stay.

    ``old_roots`` maps a marker within paths of ``homes`` to the root that takes its place, tried in order.
    """
    p = F.regexp_replace(path, r"^\./", "")
    known = F.lit(False)
    for home in homes:
        known = known | p.contains(home)
    out = F.when(p.startswith("data/"), F.concat(F.lit(data_root + "/"), F.substr(p, F.lit(6))))
    for mark, root in old_roots.items():
        out = out.when(known & p.contains(mark), F.concat(F.lit(root + "/"), F.element_at(F.split(p, mark), -1)))
    return out.otherwise(p)
