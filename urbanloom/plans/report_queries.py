"""Queries for reports, bookkeeping and the metrics that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urbanloom.functions import spatial as S
from urbanloom.operators import reports as R
from urbanloom.sources.fixtures import table

from .registry import bear, hav, query

#: Matches made from edges: street names with exact, near and missing ones.
MATCHES = """m AS (SELECT id1 * 100000 + id2 AS point, distance * 6 AS distance, CASE WHEN id1 % 11 = 0 THEN NULL ELSE 'Oak ' || CAST(id1 % 5 AS STRING) || ' Street' END AS own,
  CASE WHEN id1 % 13 = 0 THEN NULL WHEN id1 % 3 = 0 THEN 'Oak ' || CAST(id1 % 5 AS STRING) || ' Street' WHEN id1 % 3 = 1 THEN 'Oak ' || CAST(id1 % 5 AS STRING) || ' Rd' ELSE 'Elm ' || CAST(id2 % 7 AS STRING) || ' Lane' END AS found FROM edges)"""
PLAIN = "regexp_replace(lower({0}), ' (street|rd|lane)$', '')"
CLASS = f"""r AS (SELECT *, CASE WHEN own IS NULL OR found IS NULL THEN 0.0 WHEN {PLAIN.format('own')} = {PLAIN.format('found')} THEN 1.0 ELSE CASE WHEN substr(own, 5, 1) = substr(found, 5, 1) THEN 0.4 ELSE 0.2 END END AS similarity FROM m),
c AS (SELECT *, CASE WHEN own IS NULL AND found IS NULL THEN 'both_missing' WHEN own IS NULL THEN 'original_missing' WHEN found IS NULL THEN 'nearest_missing' WHEN lower(own) = lower(found) THEN 'exact_match' WHEN similarity >= 0.8 THEN 'high_similarity_match'
  WHEN distance <= 50 THEN CASE WHEN similarity >= 0.5 THEN 'close_location_similar_name' ELSE 'close_location_different_name' END WHEN distance <= 200 THEN CASE WHEN similarity >= 0.3 THEN 'nearby_location_somewhat_similar' ELSE 'nearby_location_different_name' END
  ELSE CASE WHEN similarity >= 0.3 THEN 'distant_location_similar_name' ELSE 'distant_location_different_name' END END AS class FROM r)"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    m = spark.sql(f"WITH {MATCHES.replace('FROM edges', 'FROM {edges}')} SELECT * FROM m", edges=table(spark, d, "edges"))
    points = m.select("point", "own", F.lit("poi").alias("poi"))
    lines = m.select("found").distinct().where("found is not null").select(F.md5("found").alias("line"), "found")
    return R.attach_names(m.select("point", F.md5("found").alias("line"), "distance"), points, lines)


@query()
def c35_name_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Names of brands against types by sequence matching; tested against the ratio itself."""
    p = table(spark, d, "part").select("p_partkey", "p_name", F.concat(F.col("p_brand"), F.lit(" street")).alias("b"), F.concat(F.lit("Brand "), F.col("p_type")).alias("t"))
    return R.name_similarity(p, "b", "t").select("p_partkey", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {MATCHES}, {CLASS} SELECT point, class, round(similarity, 4) AS similarity FROM c")
def d9_classify_name_match(spark: SparkSession, d: str) -> DataFrame:
    """Named and classified matches (D8, D9). The ratio of what is left of the two names is 0.4 or 0.2."""
    return _classified(spark, d).select("point", "class", F.round("similarity", 4).alias("similarity"))


@query(f"WITH {MATCHES}, {CLASS} SELECT class, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM c), 6) AS share, round(avg(distance), 4) AS mean_m, median(distance) AS median_m, max(distance) AS most_m, round(avg(similarity), 5) AS mean_similarity, count(*) FILTER (WHERE distance > 100 OR similarity < 0.5) AS attention FROM c GROUP BY class")
def f6_match_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole comparison's report."""
    r = R.match_report(_classified(spark, d))
    return r.select("class", "n", F.round("share", 6).alias("share"), F.round("mean_m", 4).alias("mean_m"), "median_m", "most_m", F.round("mean_similarity", 5).alias("mean_similarity"), "attention")


@query(f"WITH {MATCHES}, {CLASS} SELECT count(*) FILTER (WHERE class IN ('close_location_different_name', 'nearby_location_different_name')) AS by_place, count(*) FILTER (WHERE class = 'distant_location_similar_name') AS by_name, count(*) FILTER (WHERE class = 'exact_match') AS exact, count(*) FILTER (WHERE class IN ('high_similarity_match', 'close_location_similar_name', 'nearby_location_somewhat_similar')) AS similar FROM c")
def f7_location_vs_name(spark: SparkSession, d: str) -> DataFrame:
    return R.location_or_name(_classified(spark, d))


BOUNDARY = "b AS (SELECT l_suppkey AS area, l_partkey AS street, CAST(l_discount AS DOUBLE) * 10 AS share, CAST(l_quantity AS DOUBLE) * 3 AS metres, CASE WHEN l_returnflag = 'A' THEN 'boundary' WHEN l_returnflag = 'N' THEN 'partial_boundary' ELSE 'crossing' END AS kind FROM lineitem)"


def _boundary(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"WITH {BOUNDARY.replace('FROM lineitem', 'FROM {lineitem}')} SELECT * FROM b", lineitem=table(spark, d, "lineitem"))


@query(f"WITH {BOUNDARY} SELECT area, count(DISTINCT street) AS streets, round(avg(share), 2) AS mean_share, round(sum(metres), 2) AS metres FROM b GROUP BY area")
def f8_boundary_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.boundary_stats(_boundary(spark, d))


@query(f"WITH {BOUNDARY} SELECT * FROM b WHERE share >= 0.5 AND metres >= 50 AND kind IN ('boundary', 'partial_boundary')")
def d16_filter_boundary_streets(spark: SparkSession, d: str) -> DataFrame:
    return R.filter_boundary(_boundary(spark, d))


@query("SELECT l_suppkey AS area, count(*) AS points, round(avg(CAST(l_quantity AS DOUBLE)), 1) AS mean, round(min(CAST(l_quantity AS DOUBLE)), 1) AS least, round(max(CAST(l_quantity AS DOUBLE)), 1) AS most FROM lineitem GROUP BY l_suppkey")
def f9_area_point_stats(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("area"), F.col("l_quantity").cast("double").alias("distance"), F.lit("x").alias("type"))
    return R.area_point_stats(found)[0]


@query("SELECT kind AS type, category, count(*) AS n FROM walks GROUP BY ALL")
def f10_node_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.type_counts(table(spark, d, "walks").withColumnRenamed("kind", "type"), ["category"], "type").select("type", "category", "n")


@query("SELECT path, list(node ORDER BY pos) AS images FROM walks WHERE kind = 'point' GROUP BY path")
def f13_images_by_cell(spark: SparkSession, d: str) -> DataFrame:
    """The images of each path with their lines in order."""
    return R.cached_choices(table(spark, d, "walks").where("kind = 'point'"), "path", "pos", "node").withColumnRenamed("choices", "images")


@query("SELECT max(conv_id) AS position, max(conv_id) * 7 % 101 AS cell FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id * 7 % 101 < 50)")
def f15_resume_position(spark: SparkSession, d: str) -> DataFrame:
    order = table(spark, d, "conversations").select(F.col("conv_id").alias("position"), (F.col("conv_id") * 7 % 101).alias("cell")).distinct()
    return R.resume_position(order, order.where("cell < 50"), "cell", "position")


@query("SELECT min(page_id) AS line FROM pages WHERE page_id % 4 <> 0 AND page_id >= 25")
def f16_resume_line(spark: SparkSession, d: str) -> DataFrame:
    """The first page that is not done; the first 25 are, and every fourth has no job (F16)."""
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 4 != 0, F.col("page_id").cast("string")).alias("job"))
    return R.resume_line(p, p.where("page_id < 25"), "page_id", "job")


@query("SELECT event_type, count(*) AS n, round(avg(value), 5) AS value_mean, round(stddev_pop(value), 5) AS value_std FROM events GROUP BY ROLLUP (event_type)")
def f20_score_summary(spark: SparkSession, d: str) -> DataFrame:
    """Scores by type and over all."""
    s = R.score_summary(table(spark, d, "events"), "event_type", ["value"])
    return s.select("event_type", "n", F.round("value_mean", 5).alias("value_mean"), F.round("value_std", 5).alias("value_std"))


@query("WITH x AS (SELECT count(*) AS samples, sum(user_id) AS tokens, max(event_id * 2 + 1) - min(event_id * 2) AS seconds FROM events) SELECT samples, CAST(tokens AS BIGINT) AS tokens, seconds, round(samples * 1.0 / seconds, 8) AS sps, round(tokens * 1.0 / seconds, 8) AS tps FROM x")
def f25_throughput_stats(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select((F.col("event_id") * 2).alias("s"), (F.col("event_id") * 2 + 1).alias("e"), F.col("user_id").cast("long").alias("t"))
    r = R.throughput(log, "s", "e", "t")
    return r.select("samples", "tokens", "seconds", F.round("samples_per_second", 8).alias("sps"), F.round("tokens_per_second", 8).alias("tps"))


@query("SELECT 'run/checkpoint-' || CAST(page_id AS VARCHAR) AS name, page_id AS step FROM pages WHERE page_id % 2 = 0")
def f27_runs_in_order(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    i = F.col("page_id").cast("string")
    return R.runs_in_order(p.select(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("run/checkpoint-"), i)).otherwise(F.concat(F.lit("run/other-"), i)).alias("name")), "name")


@query("SELECT doc_id, CAST(floor(doc_id / 300) AS BIGINT) AS batch_id FROM documents WHERE doc_id % 3 = 1 AND floor(doc_id / 300) <> 1")
def k25_piece_of_dataset(spark: SparkSession, d: str) -> DataFrame:
    """The second of three pieces in batches of 100, the second batch done."""
    docs = table(spark, d, "documents").select("doc_id")
    return R.pending_batches(docs, "doc_id", 100, spark.range(1, 2).select(F.col("id").alias("batch_id")), 1, 3)


@query("SELECT CAST(p AS INT) AS pos, count(*) AS n, round(avg(CASE WHEN (event_id + p) % 5 = user_id % 5 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM events, (VALUES (0), (1), (2)) v(p) WHERE NOT (p = 2 AND event_id % 4 = 0) GROUP BY p")
def k26_position_accuracy(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    predicted = F.array(*[((F.col("event_id") + p) % 5).cast("int") for p in range(3)])
    u = (F.col("user_id") % 5).cast("int")
    rows = e.select(predicted.alias("p"), F.array(u, u, F.when(F.col("event_id") % 4 == 0, -100).otherwise(u)).alias("t"))
    return R.position_accuracy(rows, "p", "t").withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT count(*) AS n, round(avg(pow(value - user_id, 2)), 4) AS mse, round(avg(abs(value - user_id)), 5) AS mae, round(corr(value, user_id), 8) AS corr FROM events")
def k27_morans_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two columns of numbers."""
    r = R.agreement(table(spark, d, "events").select("value", F.col("user_id").cast("double").alias("u")), "value", "u")
    return r.select("n", F.round("mse", 4).alias("mse"), F.round("mae", 5).alias("mae"), F.round("corr", 8).alias("corr"))


@query("SELECT conv_id, 4 AS n, list_slice(list(turn ORDER BY turn), 1, 4) AS first FROM conversations GROUP BY conv_id")
def k8_fix_negative_count(spark: SparkSession, d: str) -> DataFrame:
    """Turns as negatives, cut or filled to four; the first ones of those that have them are compared, the others' repeats left out (K8)."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    fixed = R.fixed_negatives(F.col("t"), 4, F.col("conv_id"))
    return g.select("conv_id", F.size(fixed).alias("n"), F.slice(fixed, F.lit(1), F.least(F.size("t"), F.lit(4))).alias("first"))


@query("SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 0.0 WHEN event_id % 2 = 0 THEN 1.0 WHEN event_id % 3 = 0 THEN 0.5 ELSE round(2 * 0.5 * 1.0 / 1.5, 6) END AS score FROM events")
def k16_action_f1(spark: SparkSession, d: str) -> DataFrame:
    """Actions whose arguments are equal, differ in value, or lack one of two (K16); a quarter names another action."""
    e = table(spark, d, "events")
    wanted = F.when((F.col("event_id") % 2 == 0) | (F.col("event_id") % 3 == 0), F.col("props")).otherwise(F.concat(F.lit('{"z": 1, '), F.substr("props", F.lit(2))))
    given = F.when((F.col("event_id") % 2 != 0) & (F.col("event_id") % 3 == 0), '{"k": -1}').otherwise(F.col("props"))
    score = R.action_score(F.when(F.col("user_id") % 4 == 0, "other").otherwise("go"), F.lit("go"), given, wanted)
    return e.select("event_id", F.round(score, 6).alias("score"))


@query("SELECT 3000000 + origin AS id1, 3000000 + destination AS id2, count(*) AS trips, 103.0 + origin AS lon, 1.0 + origin AS lat FROM trips GROUP BY origin, destination")
def d17_trip_edges(spark: SparkSession, d: str) -> DataFrame:
    z = table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"), (F.col("n_nationkey") + 3000000).alias("id"), (F.col("n_nationkey") + 103.0).alias("lon"), (F.col("n_nationkey") + 1.0).alias("lat"))
    return R.trip_edges(table(spark, d, "trips"), z)


@query("SELECT id, CASE WHEN id % 2 = 0 THEN category ELSE type END AS category FROM (SELECT id, category, CASE WHEN id % 6 = 0 THEN 'mapillary' ELSE type END AS type FROM points) WHERE (id % 3 <> 0 OR type = 'mapillary') AND NOT (id % 3 <> 0 AND id % 5 = 0)")
def b8_filter_named_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with names or images; a third lacks names, a fifth of the named ones is called seating."""
    name = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 5 == 0, "Seating").otherwise(F.col("name"))
    p = table(spark, d, "points").select("id", name.alias("name"), F.when(F.col("id") % 6 == 0, "mapillary").otherwise(F.col("type")).alias("type"), F.when(F.col("id") % 2 == 0, F.col("category")).alias("category"))
    return R.named_nodes(p).select("id", "category")


@query("SELECT page_id, 0 AS place, url AS image, 'g' AS graph FROM pages WHERE url IS NOT NULL UNION ALL SELECT page_id, 1, 'extra', 'g' FROM pages WHERE url IS NOT NULL AND page_id % 2 = 0")
def b22_image_graph_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").where("url is not null")
    return R.image_graph_pairs(p, "page_id", [F.array("url"), F.when(F.col("page_id") % 2 == 0, F.array(F.col("url"), F.lit("extra")))], F.array(F.lit("g"), F.lit("h")))


@query("SELECT node AS image, path AS graph, 'Describe: path ' || CAST(path AS VARCHAR) AS prompt FROM walks WHERE kind = 'point' AND node % 4 <> 0")
def h28_caption_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Images without a caption with their path's text as prompt; every fourth is captioned."""
    w = table(spark, d, "walks").where("kind = 'point'").select(F.col("node").alias("image"), F.col("path").alias("graph"))
    texts = table(spark, d, "walks").select(F.col("path").alias("graph")).distinct().withColumn("text", F.concat(F.lit("path "), F.col("graph").cast("string")))
    return R.caption_jobs(w, w.where("image % 4 = 0"), texts, "Describe: ")


def _legs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("path").orderBy("pos")
    return table(spark, d, "walks").select("*", *[F.lead(c).over(w).alias(c + "2") for c in ("kind", "lon", "lat")]).where("kind2 is not null").withColumn("foot", F.struct((F.col("lon2") + 0.001).alias("lon"), (F.col("lat2") + 0.002).alias("lat")))


LEGS = "l AS (SELECT * FROM (SELECT *, lead(kind) OVER w AS kind2, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM walks WINDOW w AS (PARTITION BY path ORDER BY pos)) WHERE kind2 IS NOT NULL), f AS (SELECT *, CASE WHEN kind = 'line' AND kind2 = 'point' THEN lon2 + 0.001 ELSE lon END AS x1, CASE WHEN kind = 'line' AND kind2 = 'point' THEN lat2 + 0.002 ELSE lat END AS y1, CASE WHEN kind = 'point' AND kind2 = 'line' THEN lon2 + 0.001 ELSE lon2 END AS x2, CASE WHEN kind = 'point' AND kind2 = 'line' THEN lat2 + 0.002 ELSE lat2 END AS y2 FROM l)"


@query(f"WITH {LEGS} SELECT path, pos, round({hav('x1', 'y1', 'x2', 'y2')}, 3) AS metres, round((degrees({bear('x1', 'y1', 'x2', 'y2')}) + 360) % 360, 4) AS bearing FROM f")
def c23_geometry_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distances and bearings between features, over foot points for points and lines."""
    c = F.col
    args = (c("kind"), c("lon"), c("lat"), c("kind2"), c("lon2"), c("lat2"), c("foot"))
    return _legs(spark, d).select("path", "pos", F.round(R.pair_distance(*args), 3).alias("metres"), F.round(R.pair_bearing(*args), 4).alias("bearing"))


@query(f"WITH {LEGS}, g AS (SELECT path, pos, kind, kind2, value_ AS v, CAST(floor(((degrees({bear('lon', 'lat', 'lon2', 'lat2')}) + 360) % 360 + 22.5) / 45) AS BIGINT) % 8 AS o FROM (SELECT *, node % 3 AS value_ FROM l)) SELECT path, pos, CASE WHEN kind = 'line' AND kind2 = 'area' THEN 'near' ELSE 'bounds' END AS relation, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][o + 1] AS direction, CASE v WHEN 0 THEN 5.0 WHEN 1 THEN 7.0 ELSE 0.0 END AS length FROM g")
def h35_boundary_record(spark: SparkSession, d: str) -> DataFrame:
    """Relations of areas and streets with direction and length."""
    v = F.col("node") % 3
    record = R.boundary_record(F.col("kind"), F.col("kind2"), S.bearing_deg(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), F.when(v == 0, 5.0), F.when(v == 1, 7.0))
    return _legs(spark, d).select("path", "pos", record.alias("r")).select("path", "pos", "r.relation", "r.direction", "r.length")
