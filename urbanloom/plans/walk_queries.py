"""Queries on walks, visit orders, turns, spreads of lengths and whitened rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.functions import spatial as S
from urbanloom.operators import aggregates as A
from urbanloom.operators import graph as G
from urbanloom.operators import metrics as M
from urbanloom.operators import paths as P
from urbanloom.operators import searches as X
from urbanloom.operators import walks as W
from urbanloom.sources.fixtures import table

from .graph_queries import HOPS, SEEDS, STEP, _hops, _pairs, _seeds
from .metric_queries import CONTRAST, RANKED, _search
from .registry import hav, query


@query()
def e20_strategy_walks(spark: SparkSession, d: str) -> DataFrame:
    """Accepted walks of nine ways of stepping, with their distances."""
    starts = _pairs(spark, d).select(F.col("source").alias("walk"), "source", "target")
    names = table(spark, d, "part").select((F.col("p_partkey") + 2000000).alias("node"), F.concat_ws(" ", "p_brand", "p_size").alias("name"))
    nodes = names.join(table(spark, d, "street_vertices").where("pos = 0").select(F.col("id").alias("node"), "lon", "lat"), "node")
    out = W.strategy_walks(starts, table(spark, d, "edges_sparse"), nodes, attempts=3, steps=5, seed=3)
    return out.select("walk", "attempt", F.array_join("path", "-").alias("path"), F.array_join("names", ", ").alias("names"), "distance")


#: The image nodes of a seed are its neighbours; two of them are one step apart if they have an edge, else two.
ORDERS = f"""WITH {STEP}, {SEEDS}, i AS (SELECT DISTINCT seed.id AS graph, dst AS node FROM seed JOIN step ON src = seed.id),
leg AS (SELECT x.graph, x.node AS a, y.node AS b, CASE WHEN e.src IS NULL THEN 2 ELSE 1 END AS hops FROM i x JOIN i y ON x.graph = y.graph AND x.node <> y.node LEFT JOIN step e ON e.src = x.node AND e.dst = y.node),
s2 AS (SELECT graph, [a, b] AS stops, hops AS total FROM leg), s3 AS (SELECT s2.graph, list_append(stops, b) AS stops, total + hops AS total FROM s2 JOIN leg ON leg.graph = s2.graph AND a = stops[-1] WHERE NOT list_contains(stops, b)),
s4 AS (SELECT s3.graph, list_append(stops, b) AS stops, total + hops AS total FROM s3 JOIN leg ON leg.graph = s3.graph AND a = stops[-1] WHERE NOT list_contains(stops, b)),
s AS (SELECT graph, [node] AS stops, 0 AS total FROM i UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4),
n AS (SELECT graph, least(count(*), 4) AS n FROM i GROUP BY graph),
o AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.graph ORDER BY total, stops) AS r FROM s JOIN n ON n.graph = s.graph AND n = len(stops)) WHERE r = 1)
"""


def _orders(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges_sparse")
    images = G.hops_from(_seeds(spark, d), edges, 1).where("hop = 1").select(F.col("seed").alias("graph"), "node")
    reach = G.hops_from(images.select(F.col("node").alias("seed"), "node").distinct(), edges, 2).select(F.col("seed").alias("a"), F.col("node").alias("b"), F.col("hop").alias("hops"))
    legs = images.withColumnRenamed("node", "a").join(reach, "a").join(images.withColumnRenamed("node", "b"), ["graph", "b"])
    return W.visit_order(legs, images, 4)


@query(ORDERS + "SELECT graph, list_aggregate(stops, 'string_agg', '-') AS stops, CAST(total AS BIGINT) AS total FROM o")
def e40_visit_order(spark: SparkSession, d: str) -> DataFrame:
    """The shortest order of four neighbours of each seed."""
    return _orders(spark, d).select("graph", F.array_join("stops", "-").alias("stops"), "total")


@query(ORDERS + """, leg2 AS (SELECT graph, stops[k] AS source, stops[k + 1] AS target FROM o, (VALUES (1), (2), (3)) AS v(k) WHERE k < len(stops)), pair AS (SELECT DISTINCT source, target FROM leg2),
p1 AS (SELECT source, target, [source, dst] AS path FROM pair JOIN step ON src = source),
p2 AS (SELECT source, target, list_append(path, dst) AS path FROM p1 JOIN step ON src = path[-1] WHERE path[-1] <> target AND NOT list_contains(path, dst)),
p3 AS (SELECT source, target, list_append(path, dst) AS path FROM p2 JOIN step ON src = path[-1] WHERE path[-1] <> target AND NOT list_contains(path, dst)),
f AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY len(path), path) AS rank FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) WHERE path[-1] = target)
SELECT graph, count(*) AS n_paths, round(avg(len(path) - 1), 6) AS mean, CAST(min(len(path)) - 1 AS INT) AS least, CAST(max(len(path)) - 1 AS INT) AS most, CAST(median(len(path) - 1) AS DOUBLE) AS median FROM leg2 JOIN f ON f.source = leg2.source AND f.target = leg2.target WHERE rank <= 3 GROUP BY graph""")
def e41_paths_through_images(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of up to three paths of at most three edges between neighbouring stops."""
    p = W.paths_through(_orders(spark, d), table(spark, d, "edges_sparse"), 3, 3)
    return W.path_lengths(p).withColumn("mean", F.round("mean", 6))


@query(HOPS + "SELECT seed, node, hop FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, node) AS r FROM h) WHERE r <= 12")
def e37_cap_graph(spark: SparkSession, d: str) -> DataFrame:
    """Each two-hop neighbourhood cut to the twelve nodes nearest to its centre."""
    nodes = _hops(spark, d)
    inside = G.induced_edges(nodes, table(spark, d, "edges_sparse")).withColumnRenamed("seed", "graph")
    seeds = _seeds(spark, d).select(F.col("seed").alias("graph"), "node")
    return W.cap_graph(nodes.withColumnRenamed("seed", "graph"), inside, seeds, 12).withColumnRenamed("graph", "seed")


TURNS = "SELECT path, pos, name AS middle, edge, kind, CASE WHEN lon > 103.9 THEN 'E' ELSE 'W' END AS compass, category AS street FROM walks"


@query(f"""SELECT path, pos, CASE WHEN pe IS NULL OR (pm = middle AND pe = edge) THEN 0 WHEN kind = 'point' OR pc <> compass OR ps <> street THEN 1 ELSE 0 END AS change FROM (
SELECT *, lag(middle) OVER w AS pm, lag(edge) OVER w AS pe, lag(compass) OVER w AS pc, lag(street) OVER w AS ps FROM ({TURNS}) WINDOW w AS (PARTITION BY path ORDER BY pos))""")
def g1_direction_changes(spark: SparkSession, d: str) -> DataFrame:
    """The fuller rule of turns; points stand for decision points (G1)."""
    w = table(spark, d, "walks").select("path", "pos", F.col("name").alias("middle"), "edge", "kind", F.when(F.col("lon") > 103.9, "E").otherwise("W").alias("compass"), F.col("category").alias("street"))
    return P.direction_changes(w, "point").select("path", "pos", "change")


@query("SELECT round(avg(s), 5) AS mean, round(stddev_pop(s), 5) AS std, CAST(min(s) AS BIGINT) AS least, CAST(max(s) AS BIGINT) AS most, count(*) AS n FROM (SELECT sum(length(text)) AS s FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)")
def f17_nested_length_stats(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of conversations, given as lists of their turns' lengths."""
    lists = table(spark, d, "conversations").where("text is not null").groupBy("conv_id").agg(F.collect_list(F.length("text").cast("long")).alias("length"))
    return A.length_stats(lists).withColumn("mean", F.round("mean", 5)).withColumn("std", F.round("std", 5))


@query(f"SELECT round(corr({hav('103.9', '1.3', 'lon', 'lat')}, CAST(nation AS DOUBLE)), 6) AS r FROM points")
def f18_decay_correlation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "points").select(S.haversine_m(F.lit(103.9), F.lit(1.3), F.col("lon"), F.col("lat")).alias("distance"), F.col("nation").cast("double").alias("score"))
    return A.decay_correlation(rows).select(F.round("r", 6).alias("r"))


@query("""WITH a AS (SELECT prompt_id, request_id, reward, reward - avg(reward) OVER w AS c, count(*) OVER w AS n FROM rewards WINDOW w AS (PARTITION BY prompt_id)),
b AS (SELECT *, CASE WHEN n > 1 THEN c * n / (n - 1) ELSE 0 END AS l FROM a)
SELECT prompt_id, request_id, round(c / (stddev_samp(reward) OVER () + 1e-4), 5) + 0.0 AS by_batch, round(l / (stddev_samp(l) OVER () + 1e-4), 5) + 0.0 AS by_advantages FROM b""")
def k18_whitened_advantages(spark: SparkSession, d: str) -> DataFrame:
    """Advantages over the deviation of all rewards, and leave-one-out ones over that of all advantages."""
    rows = table(spark, d, "rewards")
    a = M.whitened_advantages(rows).withColumnRenamed("advantage", "by_batch")
    a = M.whitened_advantages(a, base="rloo", by="advantages").withColumnRenamed("advantage", "by_advantages")
    return a.select("prompt_id", "request_id", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("by_batch", "by_advantages")])


MASKED = CONTRAST.replace("l AS (", "k AS (SELECT * FROM n WHERE score <= p + 0.1), h AS (SELECT p.query, p.p, greatest(p.p, coalesce(max(k.score), p.p)) AS m FROM p LEFT JOIN k ON k.query = p.query GROUP BY p.query, p.p), l AS (", 1)
MASKED = MASKED[: MASKED.index("l AS (")] + "l AS (SELECT h.query, (any_value(h.m) - any_value(h.p)) / 0.01 + ln(coalesce(sum(exp((score - h.m) / 0.01)), 0) + exp((any_value(h.p) - any_value(h.m)) / 0.01)) AS v FROM h LEFT JOIN k ON k.query = h.query GROUP BY h.query)\nSELECT count(*) AS queries, round(avg(v), 4) AS infonce FROM l"


@query(RANKED.replace("% 50", "% 20") + MASKED)
def k3_masked_infonce(spark: SparkSession, d: str) -> DataFrame:
    """The value at temperature 0.01 without negatives that beat the positive by more than 0.1, of the ids divisible by 20 (K3)."""
    m = X.search_infonce(*_search(spark, d), 0.01, 0.1)
    return m.select("queries", F.round("infonce", 4).alias("infonce"))
