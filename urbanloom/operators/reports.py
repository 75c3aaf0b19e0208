"""Reports over matched streets, areas, runs and scores, and the bookkeeping of resumable jobs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from urbanloom.functions import spatial as S
from urbanloom.functions.spatial import let

# Street words that a name may end with.
SUFFIXES = ("street", "st", "avenue", "ave", "road", "rd", "drive", "dr", "boulevard", "blvd", "lane", "ln", "court", "ct", "place", "pl")


def plain_name(name: Column) -> Column:
    """Lower case, trimmed, without one street word at the end."""
    words = F.split(F.trim(F.lower(name)), r"\s+")
    return F.when(F.element_at(words, -1).isin(*SUFFIXES), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise(F.trim(F.lower(name)))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def name_similarity(rows: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    """The rows with the similarity of two names, 0 where one is null; worked out once for each distinct pair of plain names."""
    named = rows.withColumn("_a", plain_name(F.col(a))).withColumn("_b", plain_name(F.col(b)))
    pairs = named.where("_a <> _b").select("_a", "_b").distinct()
    rated = pairs.select("_a", "_b", _ratio("_a", "_b").alias("_r"))
    same = F.when(F.col("_a") == F.col("_b"), 1.0)
    return named.join(rated, ["_a", "_b"], "left").withColumn(out, F.coalesce(same, "_r", F.lit(0.0))).drop("_a", "_b", "_r")


def difference_class(own: Column, found: Column, similarity: Column, distance: Column, threshold: float = 0.8) -> Column:
    """How a street's own name and the nearest street's name differ, by similarity and metres."""
    banded = (
        F.when(distance <= 50, F.when(similarity >= 0.5, "close_location_similar_name").otherwise("close_location_different_name"))
        .when(distance <= 200, F.when(similarity >= 0.3, "nearby_location_somewhat_similar").otherwise("nearby_location_different_name"))
        .otherwise(F.when(similarity >= 0.3, "distant_location_similar_name").otherwise("distant_location_different_name"))
    )
    return (
        F.when(own.isNull() & found.isNull(), "both_missing").when(own.isNull(), "original_missing").when(found.isNull(), "nearest_missing")
        .when(F.lower(F.trim(own)) == F.lower(F.trim(found)), "exact_match").when(similarity >= threshold, "high_similarity_match").otherwise(banded)
    )


def attach_names(matches: DataFrame, points: DataFrame, lines: DataFrame) -> DataFrame:
    """(point, line, distance, own, found, poi, similarity, class) of matched points. ``points``: (point, own, poi); ``lines``: (line, found)."""
    named = matches.join(points, "point", "left").join(lines, "line", "left")
    rated = name_similarity(named, "own", "found")
    return rated.select("point", "line", "distance", "own", "found", "poi", "similarity", difference_class(F.col("own"), F.col("found"), F.col("similarity"), F.col("distance")).alias("class"))


def match_report(rows: DataFrame) -> DataFrame:
    """(class, n, share, mean_m, median_m, most_m, mean_similarity, attention) of each class; ``attention``: over 100 m or under 0.5."""
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    odd = ((F.col("distance") > 100) | (F.col("similarity") < 0.5)).cast("long")
    g = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_m"), F.percentile("distance", 0.5).alias("median_m"), F.max("distance").alias("most_m"), F.avg("similarity").alias("mean_similarity"), F.sum(odd).alias("attention"))
    return g.join(F.broadcast(total)).select("class", "n", (F.col("n") / F.col("_n")).alias("share"), "mean_m", "median_m", "most_m", "mean_similarity", "attention")  # one row


def location_or_name(rows: DataFrame) -> DataFrame:
    """One row: how many matches are driven by place, by name, are exact, or similar."""
    n = lambda *names: F.sum(F.col("class").isin(*names).cast("long"))
    return rows.agg(n("close_location_different_name", "nearby_location_different_name").alias("by_place"), n("distant_location_similar_name").alias("by_name"), n("exact_match").alias("exact"), n("high_similarity_match", "close_location_similar_name", "nearby_location_somewhat_similar").alias("similar"))


def boundary_stats(rows: DataFrame) -> DataFrame:
    """(area, streets, mean_share, metres) of (area, street, share, metres), rounded to 2 digits."""
    return rows.groupBy("area").agg(F.countDistinct("street").alias("streets"), F.round(F.avg("share"), 2).alias("mean_share"), F.round(F.sum("metres"), 2).alias("metres"))


def filter_boundary(rows: DataFrame, least_share: float = 0.5, least_m: float = 50.0, kinds: tuple[str, ...] = ("boundary", "partial_boundary")) -> DataFrame:
    return rows.where((F.col("share") >= least_share) & (F.col("metres") >= least_m) & F.col("kind").isin(*kinds))


def area_point_stats(found: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(area, points, mean, least, most) of distances in areas, and the most frequent point types, as many as the report shows."""
    stats = found.groupBy("area").agg(F.count(F.lit(1)).alias("points"), F.round(F.avg("distance"), 1).alias("mean"), F.round(F.min("distance"), 1).alias("least"), F.round(F.max("distance"), 1).alias("most"))
    kinds = found.where("type is not null").groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(top)
    return stats, kinds


def type_counts(nodes: DataFrame, keys: list[str], kind: str) -> DataFrame:
    return nodes.where(F.col(kind).isNotNull()).groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n"))


def resume_position(order: DataFrame, seen: DataFrame, key: str, position: str) -> DataFrame:
    """One row: the largest position, in the original order, of what the output has."""
    return order.join(seen.select(key).distinct(), key, "left_semi").agg(F.max(position).alias(position), F.max_by(key, position).alias(key))


def resume_line(lines: DataFrame, done: DataFrame, line: str, job: str) -> DataFrame:
    """One row ``line``: the first line whose job is not done; lines without a job do not count; null if all are done."""
    return lines.where(F.col(job).isNotNull()).join(done.select(job).distinct(), job, "left_anti").agg(F.min(line).alias("line"))


def score_summary(rows: DataFrame, key: str, scores: list[str]) -> DataFrame:
    """Mean and population deviation of the scores by key, and over all (null key)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for s in scores:
        aggs += [F.avg(s).alias(f"{s}_mean"), F.stddev_pop(s).alias(f"{s}_std")]
    return rows.rollup(key).agg(*aggs)


def throughput(log: DataFrame, start: str, end: str, tokens: str) -> DataFrame:
    """(samples, tokens, seconds, per second) of a log of calls, from the first start to the last end."""
    seconds = F.max(F.col(end)) - F.min(F.col(start))
    g = log.agg(F.count(F.lit(1)).alias("samples"), F.sum(tokens).alias("tokens"), seconds.alias("seconds"))
    return g.select("samples", "tokens", "seconds", F.try_divide("samples", "seconds").alias("samples_per_second"), F.try_divide("tokens", "seconds").alias("tokens_per_second"))


def runs_in_order(names: DataFrame, name: str) -> DataFrame:
    """(name, step) of those that end in ``checkpoint-N``, by N."""
    step = F.regexp_extract(name, r"checkpoint-(\d+)$", 1)
    return names.select(name, F.nullif(step, F.lit("")).cast("long").alias("step")).where("step is not null").orderBy("step", name)


def cached_choices(rows: DataFrame, key: str, order: str, content: str) -> DataFrame:
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, content))), lambda x: x[content]).alias("choices"))


def pending_batches(rows: DataFrame, number: str, batch: int, done: DataFrame, piece: int = 0, pieces: int = 1) -> DataFrame:
    """The rows of one piece of the dataset with ``batch_id``, those of finished batches left out; ``number`` counts rows from 0."""
    mine = rows.where(F.col(number) % pieces == piece).withColumn("batch_id", F.floor(F.col(number) / (batch * pieces)))
    return mine.join(done.select("batch_id").distinct(), "batch_id", "left_anti")


def position_accuracy(rows: DataFrame, predicted: str, target: str, ignore: int = -100) -> DataFrame:
    """(pos, n, accuracy) of predicted token lists by position; ignored targets do not count."""
    at = rows.select(F.posexplode(F.arrays_zip(F.col(predicted).alias("p"), F.col(target).alias("t"))).alias("pos", "x")).where(F.col("x.t") != ignore)
    return at.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("x.p") == F.col("x.t")).cast("double")).alias("accuracy"))


def agreement(rows: DataFrame, predicted: str, true: str) -> DataFrame:
    """One row: n, mse, mae and correlation of predictions."""
    e = F.col(predicted) - F.col(true)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.corr(predicted, true).alias("corr"))


def fixed_negatives(negatives: Column, n: int, key: Column, seed: int = 0) -> Column:
    """Exactly n negatives: the first n, or all and then repeats picked by a hash of the key; null of none."""
    m = F.size(negatives)
    pick = lambda i: F.get(negatives, F.pmod(F.xxhash64(F.lit(seed), key, i), F.greatest(m, F.lit(1))).cast("int"))
    return F.when(m > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i < m, F.get(negatives, i)).otherwise(pick(i))))


def action_score(predicted: Column, wanted: Column, given: Column, reference: Column) -> Column:
    """F1 of the arguments of an action: 0 if actions differ, or if one of the arguments is JSON and the other is not.

    Arguments that are JSON objects: an equal value counts 1, another value under the same key 1/2. Two empty objects
    agree. Two texts that are no JSON give null, to be scored by their overlap.
    """
    kind = "map<string,string>"
    both = F.struct(F.from_json(given, kind).alias("a"), F.from_json(reference, kind).alias("b"), predicted.alias("p"), wanted.alias("w"))
    return let(both, lambda x: _argument_score(x.a, x.b, x.p, x.w))


def _argument_score(a: Column, b: Column, predicted: Column, wanted: Column) -> Column:
    full = F.size(F.map_filter(b, lambda k, v: F.coalesce(F.try_element_at(a, k) == v, F.lit(False))))
    half = F.size(F.map_filter(b, lambda k, v: F.map_contains_key(a, k))) - full
    hit = full + 0.5 * half
    recall, precision = hit / F.size(b), F.try_divide(hit, F.size(a))
    f1 = F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0))
    empty = F.when(F.size(a) == 0, 1.0).otherwise(0.0)
    return F.when((predicted != wanted) | (a.isNull() != b.isNull()), 0.0).when(a.isNotNull(), F.when(F.size(b) == 0, empty).otherwise(f1))


def trip_edges(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """(id1, id2, trips, lon, lat): zone codes of trips as node ids, counted, with the origin's place. ``zones``: (zone, id, lon, lat)."""
    n = trips.groupBy("origin", "destination").agg(F.count(F.lit(1)).alias("trips"))
    a = zones.select(F.col("zone").alias("origin"), F.col("id").alias("id1"), "lon", "lat")
    b = zones.select(F.col("zone").alias("destination"), F.col("id").alias("id2"))
    return n.join(a, "origin", "left").join(b, "destination", "left").select("id1", "id2", "trips", "lon", "lat")


def named_nodes(nodes: DataFrame, unwanted: tuple[str, ...] = ("bike parking", "seating")) -> DataFrame:
    """Nodes with a category (their type where it is null) that have a name or are images; unwanted names go."""
    out = nodes.withColumn("category", F.coalesce("category", "type"))
    return out.where((F.col("name").isNotNull() | (F.col("type") == "mapillary")) & ~F.coalesce(F.lower("name").isin(*unwanted), F.lit(False)))


def image_graph_pairs(rows: DataFrame, key: str, images: list[Column], graphs: Column) -> DataFrame:
    """(key, place, image, graph): distinct image paths of several fields in order, each with the row's first graph."""
    all_ = F.array_distinct(F.array_compact(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in images])))
    return rows.select(key, F.posexplode(all_).alias("place", "image"), F.get(graphs, F.lit(0)).alias("graph"))


def caption_jobs(images: DataFrame, done: DataFrame, texts: DataFrame, prompt: str) -> DataFrame:
    """(image, graph, prompt) of images that are not captioned yet, the graph's text in the prompt. ``texts``: (graph, text)."""
    todo = images.select("image", "graph").distinct().join(done.select("image").distinct(), "image", "left_anti")
    return todo.join(texts, "graph").select("image", "graph", F.concat(F.lit(prompt), F.col("text")).alias("prompt"))


def pair_bearing(kind: Column, lon: Column, lat: Column, other_kind: Column, other_lon: Column, other_lat: Column, foot: Column) -> Column:
    """Bearing between two features by their places; from a point to a line, and back, by the foot point struct(lon, lat)."""
    to_foot, back = S.bearing_deg(lon, lat, foot.lon, foot.lat), S.bearing_deg(foot.lon, foot.lat, other_lon, other_lat)
    return F.when((kind == "point") & (other_kind == "line"), to_foot).when((kind == "line") & (other_kind == "point"), back).otherwise(S.bearing_deg(lon, lat, other_lon, other_lat))


def pair_distance(kind: Column, lon: Column, lat: Column, other_kind: Column, other_lon: Column, other_lat: Column, foot: Column) -> Column:
    """Metres between two features, as :func:`pair_bearing`."""
    to_foot, back = S.haversine_m(lon, lat, foot.lon, foot.lat), S.haversine_m(foot.lon, foot.lat, other_lon, other_lat)
    return F.when((kind == "point") & (other_kind == "line"), to_foot).when((kind == "line") & (other_kind == "point"), back).otherwise(S.haversine_m(lon, lat, other_lon, other_lat))


def boundary_record(kind: Column, other_kind: Column, bearing: Column, distance: Column, crossing_distance: Column) -> Column:
    """struct(relation, direction, length) of an area and a street: bounds from the area, near from the street."""
    relation = F.when((kind == "line") & (other_kind == "area"), "near").otherwise("bounds")
    letter = F.regexp_extract(S.compass8_label(bearing), r"\((\w+)\)", 1)
    return F.struct(relation.alias("relation"), F.coalesce(letter, F.lit("boundary_unknown")).alias("direction"), F.coalesce(distance, crossing_distance, F.lit(0.0)).alias("length"))
