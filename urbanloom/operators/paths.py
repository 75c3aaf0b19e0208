"""Operators that turn tables of path nodes into triples, texts and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urbanloom.functions import records as R
from urbanloom.functions import spatial as S
from urbanloom.functions import text as T

from .graph import shortest_paths, smallest_paths

#: Edge types and middle parts of triples that carry their own leg in a path's text.
NEAR_EDGES = ("nearest", "near", "boundary", "boundary_intersects", "boundary_crossing")
NEAR_MIDDLES = ("nearest", "near", "bounds", "intersects")


def path_triples(nodes: DataFrame, metric=S.haversine_m) -> DataFrame:
    """(path, pos, source, middle, target, edge, type, length, direction, next_length, next_direction) of every step of a path.

    ``nodes``: (path, pos, node, name, kind, edge, lon, lat, street, crossing), ``edge`` the type of the edge to the next
    node, ``street`` and ``crossing`` the names that it goes by; with a column ``crossing_id``, other edges between two
    nodes that have one are street segments. Each step records the coordinate that it reaches: ``reached_lon``,
    ``reached_lat`` where there are such columns and they are filled, else that of its target. The last two columns are the
    transition, from this step's recorded coordinate to the next one's: null for the last step and where a coordinate is unknown.
    Paths of one node give no triples.
    """
    w = Window.partitionBy("path").orderBy("pos")
    ahead = lambda c: F.lead(c).over(w)
    none = F.lit(None)
    told = nodes.withColumns({c: none.cast(t) for c, t in (("crossing_id", "long"), ("reached_lon", "double"), ("reached_lat", "double")) if c not in nodes.columns})
    rows = told.select("*", *[ahead(c).alias(f"{c}_2") for c in ("node", "name", "kind", "lon", "lat", "crossing_id")]).where("node_2 is not null")
    rows = rows.withColumns({"at_lon": F.coalesce("reached_lon", "lon_2"), "at_lat": F.coalesce("reached_lat", "lat_2")})
    middle = R.middle_component(F.col("edge"), F.col("kind"), F.col("kind_2"), F.col("node_2"), F.col("street"), F.col("crossing"))
    rows = rows.withColumn("leg", R.leg(F.col("lon"), F.col("lat"), F.col("lon_2"), F.col("lat_2"), metric))
    rows = rows.withColumn("next", R.leg(F.col("at_lon"), F.col("at_lat"), ahead("at_lon"), ahead("at_lat"), metric))
    kind = R.triple_type(F.col("edge"), F.col("crossing_id").isNotNull(), F.col("crossing_id_2").isNotNull())
    return rows.select("path", "pos", F.col("name").alias("source"), middle.alias("middle"), F.col("name_2").alias("target"), "edge", kind.alias("type"), "leg.length", "leg.direction", F.col("next.length").alias("next_length"), F.col("next.direction").alias("next_direction"))


def path_characteristics(triples: DataFrame) -> DataFrame:
    """(path, triples, length, mean_length, crossings) of each path."""
    return triples.groupBy("path").agg(F.count(F.lit(1)).alias("triples"), F.sum("length").alias("length"), F.avg("length").alias("mean_length"), F.sum((F.col("edge") == "crossing").cast("long")).alias("crossings"))


def paths_as_text(triples: DataFrame) -> DataFrame:
    """(path, text): triples in order with their own legs and the transitions between them, joined by arrows.

    Near triples (by edge type or middle part) carry their own leg, as ``()`` where it is unknown unless they are the last
    of several; of the others only the last does, where both parts are known. After each triple but the last comes the
    transition to the next, if its distance is not zero and its direction known; a near triple between two others that are
    not near has none. Paths without triples have no row.
    """
    w = Window.partitionBy("path").orderBy("pos")
    near = F.coalesce(F.col("edge").isin(*NEAR_EDGES), F.lit(False)) | F.coalesce(F.col("middle").isin(*NEAR_MIDDLES), F.lit(False))
    rows = triples.withColumn("near", near).select("*", F.lag("near").over(w).alias("before"), F.lead("near").over(w).alias("after"))
    known = lambda length, direction: F.coalesce((F.col(length) > 0) & F.col(direction).isNotNull(), F.lit(False))
    first, last = F.col("before").isNull(), F.col("after").isNull()
    step = T.format_step(F.col("length"), F.col("direction"))
    own = F.when(last & ~first | ~F.col("near"), last & known("length", "direction")).otherwise(True)
    onward = ~last & known("next_length", "next_direction") & (~F.col("near") | first | F.col("before") | F.col("after"))
    part = F.concat(
        T.format_triple(F.col("source"), F.col("middle"), F.col("target")), F.when(own, F.concat(F.lit(" "), step)).otherwise(""),
        F.when(onward, F.concat(F.lit(" -> "), T.format_step(F.col("next_length"), F.col("next_direction")))).otherwise(""))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "part")))
    return rows.withColumn("part", part).groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x.part), " -> ").alias("text"))


def shortest_paths_to(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, max_hops: int, metric=S.haversine_m) -> DataFrame:
    """(source, target, path, hops, length, text): one shortest path of each pair in reach, with its metres and its text.

    ``edges``: (id1, id2, type), of parallel ones the first type counts; ``nodes``: (node, name, kind, lon, lat). A path with a node
    that the table lacks is told as its node ids joined by arrows, with a length of 0.
    """
    found = shortest_paths(pairs, edges, max_hops)
    steps = found.select(F.concat_ws(">", "source", "target").alias("path"), F.posexplode("path").alias("pos", "node"))
    ahead = F.lead("node").over(Window.partitionBy("path").orderBy("pos"))
    steps = steps.withColumn("_2", ahead).join(nodes.select("node", "name", "kind", "lon", "lat", F.lit(True).alias("_known")).dropDuplicates(["node"]), "node", "left")
    types = edges.groupBy(F.least("id1", "id2").alias("_a"), F.greatest("id1", "id2").alias("_b")).agg(F.min("type").alias("edge"))
    steps = steps.withColumns({"_a": F.least("node", "_2"), "_b": F.greatest("node", "_2")}).join(types, ["_a", "_b"], "left")
    whole = steps.groupBy("path").agg(F.bool_and(F.coalesce("_known", F.lit(False))).alias("_whole"))
    none = F.lit(None).cast("string")
    triples = path_triples(steps.join(whole.where("_whole"), "path", "left_semi").withColumns({"street": none, "crossing": none}), metric)
    told = paths_as_text(triples).join(triples.groupBy("path").agg(F.sum("length").alias("length")), "path").withColumnRenamed("path", "_k")
    ids = F.array_join(F.transform("path", lambda n: n.cast("string")), " → ")
    joined = found.withColumn("_k", F.concat_ws(">", "source", "target")).join(told, "_k", "left")
    return joined.select("source", "target", "path", "hops", F.coalesce("length", F.lit(0.0)).alias("length"), F.when(F.size("path") > 1, F.coalesce("text", ids)).otherwise("").alias("text"))


def paths_for_images(
    images: DataFrame, nodes: DataFrame, edges: DataFrame, classes: tuple[str, ...], min_hops: int, max_hops: int, near_m: float,
    min_paths: int, tries: int = 2, seed: int | None = None, with_images: bool = False, metric=S.haversine_m,
) -> DataFrame:
    """(image, target, path, hops, distance, near, rank): up to ``min_paths`` shortest paths from each image to nodes at chosen hop distances.

    ``images``: (image); ``nodes``: (node, name, class, lon, lat), of rows with one id the smallest counts; ``edges``: (id1, id2).
    Targets have one of ``classes`` and are no images themselves, unless ``with_images``. Of each image's levels from ``min_hops``
    to ``max_hops`` the first ``tries`` targets are tried, those within ``near_m`` metres before those beyond or of unknown place.
    A path with a repeated name does not count; blank or missing names are ``Node_<id>``. Levels and targets come in the order of a seeded hash, or of
    their numbers without a seed. All images are searched at once; one that ``nodes`` lacks gives no rows.
    """
    place = nodes.groupBy("node").agg(F.min(F.struct("name", "class", "lon", "lat")).alias("v")).select("node", "v.*")
    starts = images.select(F.col("image").alias("node")).distinct().join(place, "node").select(F.col("node").alias("image"), F.col("lon").alias("_x"), F.col("lat").alias("_y"))
    goals = place.where(F.col("class").isin(*classes)).select(F.col("node").alias("target"), "lon", "lat")
    if not with_images:
        goals = goals.join(images.select(F.col("image").alias("target")).distinct(), "target", "left_anti")
    reached = smallest_paths(starts.select(F.col("image").alias("source")), edges, max_hops)
    reached = reached.select(F.col("source").alias("image"), F.col("node").alias("target"), "path", (F.size("path") - 1).alias("hops")).where((F.col("hops") >= max(min_hops, 1)))
    found = reached.join(goals, "target").join(starts, "image").withColumn("distance", metric(F.col("_x"), F.col("_y"), F.col("lon"), F.col("lat")))
    found = found.withColumn("near", F.coalesce(F.col("distance") <= near_m, F.lit(False)))
    level, one = (F.col("hops"), F.col("target")) if seed is None else (F.xxhash64("image", "hops", F.lit(seed)), F.xxhash64("image", "target", F.lit(seed)))
    tried = found.withColumn("_t", F.row_number().over(Window.partitionBy("image", "hops").orderBy(F.desc("near"), one, "target"))).where(F.col("_t") <= tries)
    steps = tried.select("image", "target", F.explode("path").alias("node")).join(place.select("node", "name"), "node", "left")
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("Node_"), F.col("node").cast("string")))
    sound = steps.groupBy("image", "target").agg((F.count_distinct(name) == F.count(F.lit(1))).alias("_sound")).where("_sound")
    order = Window.partitionBy("image").orderBy(level, "hops", "_t")
    kept = tried.join(sound, ["image", "target"], "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min_paths)
    return kept.select("image", "target", "path", "hops", "distance", "near", "rank")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, times) of what occurs more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def place_entities(nodes: DataFrame, key: str, name: str, said: str, order: str) -> DataFrame:
    """(key, told): the names of each example with their texts; of equal names the last by ``order`` wins."""
    last = nodes.groupBy(key, name).agg(F.max_by(said, order).alias("_s"))
    entry = F.concat(F.lit('"'), F.col(name), F.lit('": "'), F.col("_s"), F.lit('"'))
    listed = F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), entry.alias("e"))))
    return last.groupBy(key).agg(F.concat(F.lit("Here are relevant place entities informations: {"), F.array_join(F.transform(listed, lambda x: x.e), ", "), F.lit("}")).alias("told"))


def rewrite_graphs(rows: DataFrame, prefix: str) -> DataFrame:
    """``graphs`` text that names a pickle, and all of ``candidate_graphs``, get a prefix for their folder."""
    out = rows
    if "graphs" in rows.columns:
        named = F.col("graphs").endswith(".pkl") | F.col("graphs").endswith(".pickle")
        out = out.withColumn("graphs", F.when(named, T.rewrite_paths(F.array("graphs"), prefix)[0]).otherwise(F.col("graphs")))
    return out.withColumn("candidate_graphs", T.rewrite_paths(F.col("candidate_graphs"), prefix)) if "candidate_graphs" in rows.columns else out


def rewrite_images(rows: DataFrame, prefix: str) -> DataFrame:
    """``images``, ``candidates`` and ``candidate_images`` lists, and ``ground_truth``, get a prefix for their folder."""
    out = rows
    for c in ("images", "candidates", "candidate_images"):
        if c in rows.columns:
            out = out.withColumn(c, T.rewrite_paths(F.col(c), prefix))
    return out.withColumn("ground_truth", T.rewrite_paths(F.array("ground_truth"), prefix)[0]) if "ground_truth" in rows.columns else out


def top_by(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def direction_changes(triples: DataFrame, decision: str = "decision_point") -> DataFrame:
    """The rows with ``change``, 0 or 1: how a triple (path, pos, middle, edge, kind, compass, street) turns from the one before it.

    The first triple of a path, and one of the same middle part and edge type as before, does not turn; else one at a
    decision point, in another compass direction or on another street does. Nulls equal each other.
    """
    w = Window.partitionBy("path").orderBy("pos")
    was = F.lag(F.struct("middle", "edge", "compass", "street")).over(w)
    same = lambda c: F.col(c).eqNullSafe(F.col(f"_was.{c}"))
    turns = F.col("_was").isNotNull() & ~(same("middle") & same("edge")) & (F.col("kind").eqNullSafe(F.lit(decision)) | ~same("compass") | ~same("street"))
    return triples.withColumn("_was", was).withColumn("change", turns.cast("int")).drop("_was")
