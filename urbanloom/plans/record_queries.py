"""Queries on nodes, cells, run logs and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.functions import spatial as S
from urbanloom.functions import text as T
from urbanloom.operators import aggregates as A
from urbanloom.operators import spatial_joins as J
from urbanloom.sources.fixtures import table

from .registry import CROSSINGS, SEGMENTS, hav, query

CELL = "CAST(floor(lon * 200) AS BIGINT) * 100000 + CAST(floor(lat * 200) AS BIGINT)"


def _cells(df: DataFrame) -> DataFrame:
    return df.select((F.floor(F.col("lon") * 200).cast("long") * 100000 + F.floor(F.col("lat") * 200).cast("long")).alias("cell"), "id", "lon", "lat")


@query(f"WITH c AS (SELECT {CELL} AS cell FROM points) SELECT cell, count(*) AS n, (SELECT count(DISTINCT cell) FROM c) AS cells, (SELECT count(*) FROM c) AS features FROM c GROUP BY cell ORDER BY n DESC, cell LIMIT 10")
def f2_cell_split_stats(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest cells, which is the report (F2)."""
    return A.cell_stats(_cells(table(spark, d, "points")))


@query(f"WITH c AS (SELECT {CELL} AS cell, id, lon, lat FROM points) SELECT a.cell, round(max({hav('a.lon', 'a.lat', 'b.lon', 'b.lat')}), 2) AS spread_m, max({hav('a.lon', 'a.lat', 'b.lon', 'b.lat')}) > 500 AS skip FROM c a JOIN c b ON a.cell = b.cell AND a.id < b.id GROUP BY a.cell")
def f12_cell_image_spread(spark: SparkSession, d: str) -> DataFrame:
    return A.cell_spread(_cells(table(spark, d, "points")), 500.0).withColumn("spread_m", F.round("spread_m", 2))


@query(f"""WITH s AS (SELECT {hav('103.9', '1.3', 'lon', 'lat')} AS distance, CAST(nation AS DOUBLE) AS score FROM points), e AS (SELECT unnest([0, 1, 2, 3, 4]) AS bin), b AS (SELECT CASE WHEN distance < 1000 THEN 0 WHEN distance < 3000 THEN 1 WHEN distance < 6000 THEN 2 WHEN distance < 50000 THEN 3 END AS bin, score FROM s)
SELECT CAST(e.bin AS INT) AS bin, count(score) AS n, round(coalesce(avg(score), 0), 5) AS mean, round(coalesce(stddev_pop(score), 0), 5) AS std, coalesce(max(score), 0) AS most, coalesce(min(score), 0) AS least FROM e LEFT JOIN b ON b.bin = e.bin GROUP BY e.bin""")
def f18_distance_decay(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "points").select(S.haversine_m(F.lit(103.9), F.lit(1.3), F.col("lon"), F.col("lat")).alias("distance"), F.col("nation").cast("double").alias("score"))
    out = A.distance_decay(rows, [0, 1000, 3000, 6000, 50000, 100000])
    return out.select("bin", "n", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "most", "least")


@query("SELECT arg_min(p_partkey, (-p_retailprice, p_partkey)) AS p_partkey, CAST(max(p_retailprice) AS DOUBLE) AS score FROM part")
def f26_best_run(spark: SparkSession, d: str) -> DataFrame:
    return A.best_run(table(spark, d, "part"), F.col("p_retailprice"), "p_partkey")


@query(f"WITH seg AS ({SEGMENTS}), c AS ({CROSSINGS}), n AS (SELECT street, count(*) AS crossings FROM (SELECT line1 AS street FROM c UNION ALL SELECT line2 FROM c) GROUP BY street) SELECT street, crossings FROM n WHERE crossings = (SELECT max(crossings) FROM n)")
def f5_crossing_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.most_crossed(J.crossings_per_street(J.segments_of(table(spark, d, "street_vertices"))))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN name WHEN id % 3 = 1 THEN category ELSE CAST(id AS VARCHAR) END AS display FROM points")
def b11_display_name(spark: SparkSession, d: str) -> DataFrame:
    """Names with their fallbacks, where two thirds of the names and a third of the categories are taken away."""
    p = table(spark, d, "points").withColumn("name", F.when(F.col("id") % 3 == 0, F.col("name"))).withColumn("category", F.when(F.col("id") % 3 == 1, F.col("category")))
    none = F.lit(None).cast("string")
    return p.select("id", T.display_name(F.col("name"), none, none, none, F.col("category"), F.col("id")).alias("display"))


@query("WITH p AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'two_words' ELSE category END || '_' || name AS x FROM points) SELECT id, 'Intersection of ' || split_part(x, '_', 1) || ' and ' || substr(x, instr(x, '_') + 1) AS label FROM p")
def b12_crossing_rename(spark: SparkSession, d: str) -> DataFrame:
    """Names of crossings; those of even ids have underscores of their own."""
    p = table(spark, d, "points").withColumn("category", F.when(F.col("id") % 2 == 0, "two_words").otherwise(F.col("category")))
    return p.select("id", T.crossing_name(F.concat_ws("_", F.lit("Crossing"), "category", "name")).alias("label"))


@query("SELECT id, name, category FROM points WHERE lower(name) NOT IN (SELECT lower(s_name) FROM supplier)")
def d20_new_by_name(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "supplier").select(F.lower("s_name").alias("k"))
    p = table(spark, d, "points")
    return p.join(known, F.lower(p.name) == known.k, "left_anti").select("id", "name", "category")


@query("SELECT id FROM images WHERE CAST(id AS VARCHAR) NOT IN (SELECT CAST(10000000000 + event_id AS VARCHAR) FROM events WHERE event_type = 'error')")
def d22_skip_processed(spark: SparkSession, d: str) -> DataFrame:
    """Images whose id is not among the processed ones, compared as text."""
    done = table(spark, d, "events").where("event_type = 'error'").select((F.col("event_id") + 10000000000).cast("string").alias("k"))
    i = table(spark, d, "images").select("id")
    return i.join(done, i.id.cast("string") == done.k, "left_anti")


@query("SELECT id1, id2, type, 'a' AS src FROM edges_sparse WHERE type = 'crossing' UNION ALL SELECT id1, id2, type, 'b' FROM edges_sparse WHERE type <> 'crossing'")
def d29_unify_edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges_sparse").select("id1", "id2", "type")
    return e.where("type = 'crossing'").withColumn("src", F.lit("a")).unionByName(e.where("type <> 'crossing'").withColumn("src", F.lit("b")), allowMissingColumns=True)


@query("SELECT id1, id2, type FROM edges_sparse WHERE id1 NOT IN (SELECT 2000000 + p_partkey FROM part WHERE p_size = 7) AND id2 NOT IN (SELECT 2000000 + p_partkey FROM part WHERE p_size = 7)")
def b33_drop_edges_of_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Edges that touch no marked node."""
    gone = table(spark, d, "part").where("p_size = 7").select((F.col("p_partkey") + 2000000).alias("n"))
    e = table(spark, d, "edges_sparse").select("id1", "id2", "type")
    return e.join(gone, e.id1 == gone.n, "left_anti").join(gone, e.id2 == gone.n, "left_anti")


@query("""SELECT e.id1, e.id2, e.type FROM edges_sparse e LEFT JOIN part a ON 2000000 + a.p_partkey = e.id1 AND a.p_size % 5 <> 0 LEFT JOIN part b ON 2000000 + b.p_partkey = e.id2 AND b.p_size % 5 <> 0 WHERE NOT coalesce(e.type = 'crossing' AND a.p_brand = b.p_brand, false)""")
def b34_drop_same_name_crossings(spark: SparkSession, d: str) -> DataFrame:
    """Crossing edges between equal names removed; other types and missing names, here a fifth, stay."""
    names = lambda c: table(spark, d, "part").where("p_size % 5 <> 0").select((F.col("p_partkey") + 2000000).alias(c), F.col("p_brand").alias(f"{c}_name"))
    e = table(spark, d, "edges_sparse").join(names("id1"), "id1", "left").join(names("id2"), "id2", "left")
    same = (F.col("type") == "crossing") & T.blank_to_null(F.col("id1_name")).isNotNull() & (F.col("id1_name") == F.col("id2_name"))
    return e.where(~F.coalesce(same, F.lit(False))).select("id1", "id2", "type")
