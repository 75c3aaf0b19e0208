"""Queries that turn paths, nodes and edges into triples, texts and training records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urbanloom.functions import records as R
from urbanloom.functions import spatial as S
from urbanloom.functions import text as T
from urbanloom.operators import paths as P
from urbanloom.operators import training_records as Tr
from urbanloom.sources.fixtures import table

from .registry import bear, hav, query

POINTS8 = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def label8(bearing: str) -> str:
    """The eight-point label of a bearing of 0 to 360 as SQL text."""
    gaps = ", ".join(f"least(abs({bearing} - {45 * k}), 360 - abs({bearing} - {45 * k}))" for k in range(8))
    return f"(CAST(CAST(round_even({bearing}, 0) AS BIGINT) AS VARCHAR) || '°(' || ['{"', '".join(POINTS8)}'][list_position([{gaps}], list_min([{gaps}]))] || ')')"


def cases(values: dict[str, str], key: str, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {other} END"


DEG = f"((degrees({bear('lon', 'lat', 'lon2', 'lat2')}) + 360) % 360)"
TRIPLES = f"""w AS (SELECT *, lead(name) OVER p AS name2, lead(node) OVER p AS node2, lead(kind) OVER p AS kind2, lead(lon) OVER p AS lon2, lead(lat) OVER p AS lat2 FROM walks WINDOW p AS (PARTITION BY path ORDER BY pos)),
t AS (SELECT *, {hav('lon', 'lat', 'lon2', 'lat2')} AS len, {DEG} AS deg,
  CASE WHEN edge = 'nearest' THEN CASE WHEN kind2 = 'point' AND kind <> 'point' THEN 'near' ELSE 'nearest' END WHEN edge = 'area_boundary' THEN CASE WHEN kind = 'line' AND kind2 = 'area' THEN 'near' ELSE 'bounds' END ELSE 'near' END AS fallback,
  CASE WHEN edge IN ('on_same_street', 'crossing') THEN 'Way ' || CAST(node % 7 AS VARCHAR) END AS via FROM w WHERE node2 IS NOT NULL),
x AS (SELECT path, pos, name AS source, coalesce(via, fallback) AS middle, name2 AS target, edge, len, deg,
  CASE WHEN edge = 'on_same_street' THEN 'street_segment' WHEN edge = 'crossing' THEN 'decision_point' WHEN node % 3 <> 0 AND node2 % 3 <> 0 THEN 'street_segment' END AS type, lon2, lat2 FROM t)"""


def _triples(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "walks").withColumn("crossing_id", F.when(F.col("node") % 3 != 0, F.col("node")))
    via = F.concat(F.lit("Way "), (F.col("node") % 7).cast("string"))
    return P.path_triples(w.withColumn("street", F.when(F.col("edge") == "on_same_street", via)).withColumn("crossing", F.when(F.col("edge") == "crossing", via)))


@query(f"WITH {TRIPLES} SELECT path, pos, source, middle, target, edge, type, round(len, 4) AS length, {label8('deg')} AS direction FROM x")
def h1_path_triples(spark: SparkSession, d: str) -> DataFrame:
    """Triples of every path with middle, type, length and direction (H1, H2, H3, H4, H5)."""
    return _triples(spark, d).select("path", "pos", "source", "middle", "target", "edge", "type", F.round("length", 4).alias("length"), "direction")


@query(f"WITH {TRIPLES} SELECT path, count(*) AS triples, round(sum(len), 3) AS length, round(avg(len), 3) AS mean_length, sum(CASE WHEN edge = 'crossing' THEN 1 ELSE 0 END) AS crossings FROM x GROUP BY path")
def h13_path_characteristics(spark: SparkSession, d: str) -> DataFrame:
    return P.path_characteristics(_triples(spark, d)).select("path", "triples", F.round("length", 3).alias("length"), F.round("mean_length", 3).alias("mean_length"), "crossings")


#: What a path's text says, from the wording of the survey: legs of near triples, transitions between the coordinates reached.
SPOKEN = f"""n AS (SELECT *, edge IN ('nearest', 'near', 'boundary', 'boundary_intersects', 'boundary_crossing') OR middle IN ('nearest', 'near', 'bounds', 'intersects') AS is_near,
  row_number() OVER (PARTITION BY path ORDER BY pos) AS i, count(*) OVER (PARTITION BY path) AS m FROM x),
g AS (SELECT a.*, floor(a.len) AS own_m, {label8('a.deg')} AS own_d, CASE WHEN b.i IS NOT NULL THEN floor({hav('a.lon2', 'a.lat2', 'b.lon2', 'b.lat2')}) END AS trans_m, {label8(f"((degrees({bear('a.lon2', 'a.lat2', 'b.lon2', 'b.lat2')}) + 360) % 360)")} AS trans_d, z.is_near AS was, b.is_near AS will
  FROM n a LEFT JOIN n b ON a.path = b.path AND b.i = a.i + 1 LEFT JOIN n z ON a.path = z.path AND z.i = a.i - 1),
k AS (SELECT path, i, '(' || concat_ws(', ', source, middle, target) || ')' AS triple, CASE
    WHEN is_near AND (i < m OR m = 1) THEN ' (' || printf('%.1f', own_m) || 'm, ' || own_d || ')' WHEN i = m AND own_m > 0 THEN ' (' || printf('%.1f', own_m) || 'm, ' || own_d || ')' ELSE '' END AS leg,
  CASE WHEN i = m OR trans_m = 0 THEN '' WHEN is_near AND i > 1 AND NOT was AND NOT will THEN '' ELSE ' -> (' || printf('%.1f', trans_m) || 'm, ' || trans_d || ')' END AS onward FROM g)"""


@query(f"WITH {TRIPLES}, {SPOKEN} SELECT path, string_agg(triple || leg || onward, ' -> ' ORDER BY i) AS text FROM k GROUP BY path")
def h9_format_path_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Paths as text whose near triples carry their own leg, with the transitions between recorded coordinates."""
    return P.paths_as_text(_triples(spark, d).withColumns({c: F.floor(c).cast("double") for c in ("length", "next_length")}))


@query(f"WITH {TRIPLES} SELECT a.path, a.pos, round({hav('a.lon2', 'a.lat2', 'b.lon2', 'b.lat2')}, 4) AS length, {label8(f"((degrees({bear('a.lon2', 'a.lat2', 'b.lon2', 'b.lat2')}) + 360) % 360)")} AS direction FROM x a JOIN x b ON a.path = b.path AND b.pos = a.pos + 1")
def g2_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Distance and direction between the coordinates that consecutive triples reach."""
    return _triples(spark, d).where("next_length is not null").select("path", "pos", F.round("next_length", 4).alias("length"), F.col("next_direction").alias("direction"))


@query(f"SELECT path, pos, {label8(DEG)} AS direction, round({hav('lon', 'lat', 'lon2', 'lat2')}, 4) AS length FROM (SELECT path, pos, lon AS lon2, lat AS lat2, lag(lon) OVER w AS lon, lag(lat) OVER w AS lat FROM walks WINDOW w AS (PARTITION BY path ORDER BY pos)) WHERE lon IS NOT NULL")
def g3_direction_from_previous(spark: SparkSession, d: str) -> DataFrame:
    """Bearing and distance from the coordinate before."""
    w = Window.partitionBy("path").orderBy("pos")
    rows = table(spark, d, "walks").select("path", "pos", R.leg(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")).alias("l"))
    return rows.where("l.length is not null").select("path", "pos", "l.direction", F.round("l.length", 4).alias("length"))


@query(f"""WITH {TRIPLES}, n AS (SELECT path, count(*) AS n, count(DISTINCT source || '->' || target) AS u FROM x GROUP BY path)
SELECT path, round(least(CASE WHEN u * 1.0 / n > 0.7 AND n + 1 > 5 THEN u * 1.0 / n + 0.1 WHEN n + 1 < 4 THEN u * 0.8 / n ELSE u * 1.0 / n END, 1.0), 6) AS diversity FROM n""")
def e28_path_triple_diversity(spark: SparkSession, d: str) -> DataFrame:
    t = _triples(spark, d).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "source", "target"))).alias("t"))
    return t.select("path", F.round(R.triple_diversity(F.col("t.source"), F.col("t.target")), 6).alias("diversity"))


@query(f"WITH {TRIPLES} SELECT path, source, middle, target, count(*) AS times FROM x GROUP BY ALL HAVING count(*) > 1")
def e29_triple_repeats(spark: SparkSession, d: str) -> DataFrame:
    return P.repeated(_triples(spark, d), ["path", "source", "middle", "target"])


@query("SELECT path, CASE WHEN trim(name) = '' THEN 'Node_' || CAST(node AS VARCHAR) ELSE trim(name) END AS name, count(*) AS times FROM walks GROUP BY ALL HAVING count(*) > 1")
def e27_duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "walks")
    return P.repeated(w.select("path", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("Node_"), F.col("node").cast("string"))).alias("name")), ["path", "name"])


@query("""WITH e AS (SELECT path, arg_min(name, pos) AS a, arg_max(name, pos) AS b, arg_max(kind, pos) AS k FROM walks GROUP BY path)
SELECT path FROM e WHERE a <> '' AND NOT regexp_full_match(a, '[0-9]+') AND b <> '' AND (NOT regexp_full_match(b, '[0-9]+') OR k = 'point')""")
def b24_valid_endpoint_names(spark: SparkSession, d: str) -> DataFrame:
    """Paths whose ends are named; a last node of kind point stands for an image, which may have digits."""
    e = table(spark, d, "walks").groupBy("path").agg(F.min_by("name", "pos").alias("a"), F.max_by("name", "pos").alias("b"), F.max_by("kind", "pos").alias("k"))
    return e.where(R.valid_endpoints(F.col("a"), F.lit(None).cast("string"), F.col("b"), F.when(F.col("k") == "point", "mapillary"))).select("path")


@query("SELECT path, pos, CASE WHEN kind = 'point' AND node % 5 = 0 THEN CAST(node AS VARCHAR) WHEN trim(name) <> '' THEN trim(name) WHEN node % 2 = 0 THEN category ELSE 'Node_' || CAST(node AS VARCHAR) END AS shown FROM walks")
def h17_endpoint_names(spark: SparkSession, d: str) -> DataFrame:
    none, w = F.lit(None).cast("string"), table(spark, d, "walks")
    image = F.when((F.col("kind") == "point") & (F.col("node") % 5 == 0), "mapillary")
    return w.select("path", "pos", R.endpoint_name(F.col("name"), none, none, image, F.when(F.col("node") % 2 == 0, F.col("category")), F.col("node"), none).alias("shown"))


@query(f"SELECT id, {cases(R.HIGHWAYS, 'highway', chr(39) + 'other' + chr(39))} AS base, CASE WHEN foot IN ('yes', 'designated', 'permitted') THEN 'foot_path' WHEN railway IS NOT NULL THEN 'railway' WHEN sidewalk IN ('both', 'left', 'right', 'separate') THEN 'sidewalk' WHEN cycleway IS NOT NULL THEN 'cycleway' WHEN bicycle IN ('yes', 'designated', 'permitted') THEN 'bicycle_road' ELSE {cases(R.HIGHWAYS, 'highway', chr(39) + 'other' + chr(39))} END AS category FROM roads")
def b2_road_category(spark: SparkSession, d: str) -> DataFrame:
    c, none = F.col, F.lit(None).cast("string")
    category = R.road_category(c("highway"), c("bicycle"), c("cycleway"), c("sidewalk"), c("railway"), c("foot"))
    return table(spark, d, "roads").select("id", R.road_category(c("highway"), none, none, none, none, none).alias("base"), category.alias("category"))


PLACE = "CASE WHEN cafe <> '' THEN 'food' WHEN bank <> '' THEN 'financial' WHEN amenity <> '' THEN 'amenity' WHEN shop <> '' THEN 'commercial' WHEN leisure <> '' THEN 'leisure' END"


@query(f"SELECT id, coalesce({PLACE}, 'other') AS category, coalesce(given, {PLACE}) AS filled FROM places")
def b3_poi_category(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "places")
    tags = {t: F.col(t) for t in ("leisure", "shop", "amenity", "bank", "cafe")}
    return p.select("id", R.place_category(tags).alias("category"), R.place_category(tags, F.col("given")).alias("filled"))


@query("SELECT path, pos, CASE WHEN kind = 'area' THEN 'area' WHEN kind = 'line' THEN 'line' WHEN regexp_matches(replace(name, 'view', 'Crossing'), '(?i)crossing|intersection') THEN 'crossing_point' ELSE 'point' END AS class, kind <> 'line' AND NOT (kind = 'point' AND regexp_matches(replace(name, 'view', 'Crossing'), '(?i)crossing|intersection')) AS picked FROM walks")
def b25_classify_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Node classes and whether the selection ``no_intersection_nodes`` takes them; names with "view" are made crossings."""
    w = table(spark, d, "walks").withColumn("class", R.node_class(F.col("kind"), F.replace(F.col("name"), F.lit("view"), F.lit("Crossing")), F.lit(None).cast("string")))
    return w.select("path", "pos", "class", F.col("class").isin(*R.SELECTIONS["no_intersection_nodes"]).alias("picked"))


@query("""SELECT path, pos, CASE WHEN edge IS NULL THEN 'is near' WHEN name = name2 THEN 'continues as' WHEN edge = 'crossing' THEN 'crosses' WHEN edge = 'area_boundary' THEN CASE WHEN kind = 'line' AND kind2 = 'area' THEN 'bounds' WHEN kind = 'line' THEN 'is bounded by' END
  WHEN edge = 'nearest' THEN 'is near to' WHEN edge = 'walkway' THEN 'has a path connecting to' ELSE 'is connected to' END AS phrase FROM (SELECT *, lead(name) OVER w AS name2, lead(kind) OVER w AS kind2 FROM walks WINDOW w AS (PARTITION BY path ORDER BY pos)) WHERE name2 IS NOT NULL""")
def c37_relation_phrase(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("path").orderBy("pos")
    rows = table(spark, d, "walks").select("*", F.lead("name").over(w).alias("name2"), F.lead("kind").over(w).alias("kind2")).where("name2 is not null")
    edge = F.when(F.col("edge") == "walkway", "path-connection").otherwise(F.col("edge"))
    return rows.select("path", "pos", R.relation_phrase(edge, F.col("kind"), F.col("kind2"), F.col("name"), F.col("name2")).alias("phrase"))


@query("""SELECT id, CASE id % 3 WHEN 0 THEN 'POINT(lon: ' || printf('%.8f', lon) || ', lat: ' || printf('%.8f', lat) || ')' WHEN 1 THEN 'LINE(lon: 103.50000000, lat: 1.25000000 to lon: ' || printf('%.8f', lon) || ', lat: ' || printf('%.8f', lat) || ')' ELSE '' END AS told,
  CASE WHEN id % 3 = 1 THEN 103.5 WHEN id % 3 = 0 THEN lon END AS x, CASE WHEN id % 3 = 1 THEN 1.25 WHEN id % 3 = 0 THEN lat END AS y FROM points""")
def c27_geometry_text(spark: SparkSession, d: str) -> DataFrame:
    """Geometry texts to coordinates as text and as numbers."""
    lon, lat = F.col("lon").cast("string"), F.col("lat").cast("string")
    wkt = F.when(F.col("id") % 3 == 0, F.concat(F.lit("POINT ("), lon, F.lit(" "), lat, F.lit(")"))).when(F.col("id") % 3 == 1, F.concat(F.lit("LINESTRING (103.5 1.25, "), lon, F.lit(" "), lat, F.lit(")"))).otherwise("nan")
    rows = table(spark, d, "points").select("id", wkt.alias("g"))
    return rows.select("id", R.geometry_text(F.col("g")).alias("told"), R.geometry_lonlat(F.col("g")).lon.alias("x"), R.geometry_lonlat(F.col("g")).lat.alias("y"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN lon WHEN id % 3 = 1 THEN 103.7 ELSE 103.6 END AS x, CASE WHEN id % 3 = 0 THEN lat WHEN id % 3 = 1 THEN 1.3 ELSE 1.2 END AS y FROM points WHERE id % 7 <> 0 OR id % 3 <> 2")
def b30_coords_from_text_or_table(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates from text for a third, from the node for a third, else from columns, which a seventh lacks."""
    p = table(spark, d, "points")
    told = F.when(F.col("id") % 3 == 0, F.concat(F.lit("("), F.col("lon").cast("string"), F.lit(", "), F.col("lat").cast("string"), F.lit(")")))
    node = lambda v: F.when(F.col("id") % 3 == 1, F.lit(v))
    column = lambda v: F.when(F.col("id") % 7 != 0, F.lit(v))
    found = p.select("id", R.coordinates_of(told, node(103.7), node(1.3), column(103.6), column(1.2)).alias("c")).where("c is not null")
    return found.select("id", F.col("c.lon").alias("x"), F.col("c.lat").alias("y"))


@query("SELECT id, name, category, CAST(printf('%.6f', lon) AS DOUBLE) AS x, CAST(printf('%.6f', lat) AS DOUBLE) AS y FROM points")
def b31_parse_node_text(spark: SparkSession, d: str) -> DataFrame:
    """Node texts read back."""
    text = T.node_text({"Name": F.col("name"), "Category": F.col("category")}, F.col("lon"), F.col("lat"))
    return table(spark, d, "points").select("id", R.parse_node_text(text).alias("n")).select("id", "n.name", "n.category", F.col("n.lon").alias("x"), F.col("n.lat").alias("y"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/srv/data/' || CAST(page_id AS VARCHAR) || '.pkl' WHEN 1 THEN '/srv/data/geo/' || CAST(page_id AS VARCHAR) WHEN 2 THEN '/srv/out/x' || CAST(page_id AS VARCHAR) ELSE 'other/' || CAST(page_id AS VARCHAR) END AS path FROM pages")
def b21_normalise_path(spark: SparkSession, d: str) -> DataFrame:
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("./data/"), i, F.lit(".pkl"))).when(k == 1, F.concat(F.lit("/home/old/kg/data/geo/"), i)).when(k == 2, F.concat(F.lit("/home/old/run/mydata/x"), i)).otherwise(F.concat(F.lit("other/"), i))
    return table(spark, d, "pages").select("page_id", R.normalise_path(raw, "/srv/data", "/srv/out", {"/kg/data/": "/srv/data", "/mydata/": "/srv/out"}, ("/home/old/",)).alias("path"))


@query("""SELECT id, '{"name":"' || CASE WHEN id % 4 = 0 THEN CAST(id AS VARCHAR) ELSE name END || '","category":"' || CASE WHEN id % 5 = 0 THEN type ELSE category END || '","coordinates":"(' || printf('%.4f', lon) || ', ' || printf('%.4f', lat) || ')"' || CASE WHEN id % 3 = 0 THEN ',"district":"D' || CAST(nation AS VARCHAR) || '"' ELSE '' END || '}' AS described FROM points""")
def h19_node_description(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "points")
    where = F.concat(F.lit("("), F.format_string("%.4f", "lon"), F.lit(", "), F.format_string("%.4f", "lat"), F.lit(")"))
    district = F.when(F.col("id") % 3 == 0, F.concat(F.lit("D"), F.col("nation").cast("string"))).otherwise("nan")
    return p.select("id", R.node_description(F.col("id"), F.when(F.col("id") % 4 == 0, "None").otherwise(F.col("name")), F.when(F.col("id") % 5 == 0, "").otherwise(F.col("category")), F.col("type"), where, {"district": district}).alias("described"))


@query("""SELECT path, 'Here are relevant place entities informations: {' || string_agg('"' || name || '": "' || said || '"', ', ' ORDER BY name) || '}' AS told FROM (SELECT path, name, arg_max(category || ' at ' || CAST(pos AS VARCHAR), pos) AS said FROM walks WHERE name <> '' GROUP BY path, name) GROUP BY path""")
def h20_place_entities(spark: SparkSession, d: str) -> DataFrame:
    """The named nodes of each path with their text, later ones of a name win."""
    w = table(spark, d, "walks").where("name <> ''").withColumn("said", F.concat(F.col("category"), F.lit(" at "), F.col("pos").cast("string")))
    return P.place_entities(w, "path", "name", "said", "pos")


@query("""SELECT path, pos, CASE WHEN pos % 3 = 0 THEN 'See image with id ' || CAST(node AS VARCHAR) || ' at (1, 2). When you face North, you can see the scene in the image now. Spatial Reasoning Path: A -> B. Based on it' WHEN pos % 3 = 1 THEN 'See image with id ' || CAST(node AS VARCHAR) || ' at (1, 2) well' ELSE 'No phrase at (1, 2). When you face North, you can see the scene in the image' END || chr(10) || 'E' AS told FROM walks""")
def h21_enrich_user_message(spark: SparkSession, d: str) -> DataFrame:
    node, k = F.col("node").cast("string"), F.col("pos") % 3
    raw = F.when(k == 0, F.concat(F.lit("See image with id "), node, F.lit(" now. Spatial Reasoning Path: old path. Based on it"))).when(k == 1, F.concat(F.lit("See image with id "), node, F.lit(" at (1, 2) well"))).otherwise("No phrase")
    face = F.when(k != 1, "North")
    return table(spark, d, "walks").select("path", "pos", R.enrich_message(raw, node, F.lit("(1, 2)"), face, F.when(k == 0, "A -> B"), F.lit("E")).alias("told"))


@query("""SELECT path, '{"messages":[{"role":"user","content":"<graph><image>Path ' || CAST(path AS VARCHAR) || '"},{"role":"assistant","content":"' || CAST(n AS VARCHAR) || ' steps"}],"images":["i' || CAST(path AS VARCHAR) || '.jpg"],"graphs":["g' || CAST(path AS VARCHAR) || '.pkl"],"label":1.0}' AS record FROM (SELECT path, count(*) AS n FROM walks GROUP BY path)""")
def h22_training_example(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path").cast("string")
    n = table(spark, d, "walks").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return n.select("path", F.to_json(R.training_example(F.concat(F.lit("Path "), p), F.concat(F.col("n").cast("string"), F.lit(" steps")), F.concat(F.lit("i"), p, F.lit(".jpg")), F.concat(F.lit("g"), p, F.lit(".pkl")))).alias("record"))


@query("""WITH e AS (SELECT path, arg_min(name, pos) AS a, arg_max(name, pos) AS b, arg_min(kind, pos) AS j, arg_max(kind, pos) AS k, min(node) AS n FROM walks GROUP BY path),
v AS (SELECT *, a <> '' AND (NOT regexp_full_match(a, '[0-9]+') OR j = 'point') AND b <> '' AND (NOT regexp_full_match(b, '[0-9]+') OR k = 'point') AS named, path % 40 AS text FROM e),
r AS (SELECT v.path, CASE WHEN NOT named THEN 'unnamed_ends' WHEN path > min(path) FILTER (WHERE named) OVER (PARTITION BY text) THEN 'duplicate_path' WHEN path % 7 = 0 AND n % 2 = 0 THEN 'no_coordinates' WHEN path % 5 = 0 THEN 'graph_not_finished' WHEN path % 6 = 1 THEN 'no_messages' ELSE 'kept' END AS reason, path % 7 = 0 AS filled FROM v)
SELECT reason, count(*) AS lines FROM r GROUP BY reason UNION ALL SELECT 'filled', count(*) FROM r WHERE reason = 'kept' AND filled HAVING count(*) > 0""")
def h23_skip_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of a training-record job are kept, and why the others are not (H23, H12, H18-H21); points stand for images."""
    w = table(spark, d, "walks").withColumn("kind", F.when(F.col("kind") == "point", "mapillary").otherwise(F.col("kind")))
    p, i = F.col("line"), F.col("line").cast("string")
    turns = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("See image with id "), F.col("image").cast("string")).alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("Go.").alias("content")))
    jobs = w.groupBy(F.col("path").alias("line")).agg(F.min("node").alias("image")).select(
        "line", "image", F.when(p % 6 != 1, turns).alias("messages"), F.concat(i, F.lit(".jpg")).alias("image_path"), F.concat(i, F.lit(".pkl")).alias("graph_path"), F.lit("s").alias("summarization"),
        F.when(p % 7 != 0, "(103.8, 1.3)").otherwise("unknown coordinates").alias("coordinates"), F.concat(F.lit("path "), (p % 40).cast("string")).alias("path_text"))
    nodes = w.where("node % 2 = 1").select("node", "lon", "lat", F.col("category").alias("said"))
    records = Tr.compose_records(jobs, w.select(F.col("path").alias("line"), "pos", "node", "name", "kind"), nodes, finished=jobs.where("line % 5 <> 0").select("graph_path"))
    return Tr.skip_counts(records)


NAMES16 = "['North', 'North-Northeast', 'Northeast', 'East-Northeast', 'East', 'East-Southeast', 'Southeast', 'South-Southeast', 'South', 'South-Southwest', 'Southwest', 'West-Southwest', 'West', 'West-Northwest', 'Northwest', 'North-Northwest']"


@query(f"SELECT id, CASE WHEN dd < 0.1 THEN '' ELSE ', ' || {NAMES16}[CAST(round_even(b / 22.5, 0) AS BIGINT) % 16 + 1] || ', ' || CAST(CAST(round_even(dd, 0) AS BIGINT) AS VARCHAR) || 'm from image location' END AS told FROM (SELECT id, {hav('103.9', '1.3', 'lon', 'lat')} AS dd, (degrees({bear('103.9', '1.3', 'lon', 'lat')}) + 360) % 360 AS b FROM points)")
def h27_direction_from_image(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "points").select("id", R.direction_from_image(F.col("lon"), F.col("lat"), F.lit(103.9), F.lit(1.3)).alias("told"))


@query("SELECT DISTINCT path, name FROM walks WHERE kind = 'point' AND name <> ''")
def h31_images_in_cell(spark: SparkSession, d: str) -> DataFrame:
    """Distinct image names over the lists of each path; points stand for images."""
    lists = table(spark, d, "walks").where("kind = 'point'").groupBy("path").agg(F.collect_set("name").alias("names"))
    return lists.select("path", F.explode("names").alias("name")).where("name <> ''").distinct()


@query("SELECT DISTINCT page_id, split_part(split_part(url, '/', -1), '.', 1) AS image FROM pages WHERE url IS NOT NULL AND regexp_matches(split_part(url, '/', -1), '^[^./]+$')")
def b23_image_ids_from_paths(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").where(F.split_part("url", F.lit("/"), F.lit(-1)).rlike("^[^./]+$"))
    return p.select("page_id", F.explode(F.array("url", "url")).alias("u")).select("page_id", T.image_id(F.col("u")).alias("image")).distinct()


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/g/' || CAST(page_id AS VARCHAR) || '.pkl' WHEN page_id % 3 = 1 THEN 'a/' || CAST(page_id AS VARCHAR) || '.txt' ELSE '/g/' || CAST(page_id AS VARCHAR) || '.pickle' END AS graph, '/g/c' || CAST(page_id AS VARCHAR) AS candidate FROM pages")
def b19_rewrite_graph_paths(spark: SparkSession, d: str) -> DataFrame:
    """Graph paths rewritten when they name pickles, candidates always."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 3
    raw = F.concat(F.lit("a/"), i, F.when(k == 0, ".pkl").when(k == 1, ".txt").otherwise(".pickle"))
    out = P.rewrite_graphs(table(spark, d, "pages").select("page_id", raw.alias("graphs"), F.array(F.concat(F.lit("x/c"), i)).alias("candidate_graphs")), "/g/")
    return out.select("page_id", F.col("graphs").alias("graph"), F.col("candidate_graphs")[0].alias("candidate"))


@query("SELECT page_id, '/i/' || CAST(page_id AS VARCHAR) || '.jpg' AS image, '/i/t.jpg' AS truth FROM pages")
def b20_rewrite_benchmark_images(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", F.array(F.concat(F.lit("old/"), F.col("page_id").cast("string"), F.lit(".jpg"))).alias("images"), F.lit("z/t.jpg").alias("ground_truth"))
    return P.rewrite_images(rows, "/i/").select("page_id", F.col("images")[0].alias("image"), F.col("ground_truth").alias("truth"))
