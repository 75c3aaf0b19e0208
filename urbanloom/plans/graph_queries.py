"""Graph queries over the made node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.operators import graph as G
from urbanloom.operators import paths as P
from urbanloom.sources.fixtures import table

from .registry import hav, query

STEP = "step AS (SELECT DISTINCT src, dst FROM (SELECT id1 AS src, id2 AS dst FROM edges_sparse UNION ALL SELECT id2, id1 FROM edges_sparse) WHERE src <> dst)"
SEEDS = "seed AS (SELECT 2000000 + p_partkey AS id FROM part WHERE p_partkey % 10 = 0)"
#: Seeds are the parts whose key is divisible by ten, against the whole edge table.
HOPS = f"""WITH {STEP}, {SEEDS}, h0 AS (SELECT id AS seed, id AS node, 0 AS hop FROM seed),
h1 AS (SELECT DISTINCT seed, dst AS node, 1 AS hop FROM h0 JOIN step ON node = src),
h2 AS (SELECT DISTINCT h1.seed, dst AS node, 2 AS hop FROM h1 JOIN step ON node = src),
h AS (SELECT seed, node, CAST(min(hop) AS INT) AS hop FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL)
"""


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    key = (F.col("p_partkey") + 2000000).alias("node")
    return table(spark, d, "part").where("p_partkey % 10 = 0").select(key).withColumn("seed", F.col("node"))


def _hops(spark: SparkSession, d: str) -> DataFrame:
    return G.hops_from(_seeds(spark, d), table(spark, d, "edges_sparse"), 2)


@query("SELECT src, count(*) AS degree, CAST(sum(dst) AS BIGINT) AS total FROM (SELECT id1 AS src, id2 AS dst FROM edges UNION ALL SELECT id2, id1 FROM edges) GROUP BY src")
def e1_adjacency(spark: SparkSession, d: str) -> DataFrame:
    a = G.adjacency(table(spark, d, "edges"))
    return a.select("src", "degree", F.aggregate("neighbours", F.lit(0).cast("long"), lambda x, y: x + y).alias("total"))


@query(HOPS + "SELECT seed, node, hop FROM h")
def e6_nodes_by_hop(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within two hops with the fewest hops."""
    return _hops(spark, d)


@query(HOPS + "SELECT a.seed, e.id1, e.id2, e.type, e.distance FROM edges_sparse e JOIN h a ON a.node = e.id1 JOIN h b ON b.node = e.id2 AND a.seed = b.seed")
def e2_khop_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Edges with both ends within two hops of each seed."""
    return G.induced_edges(_hops(spark, d), table(spark, d, "edges_sparse"))


@query(HOPS + """SELECT seed, a AS id1, b AS id2, min(struct_pack(w := distance, t := type)).t AS type, min(distance) AS distance FROM (
SELECT DISTINCT h.seed, least(id1, id2) AS a, greatest(id1, id2) AS b, type, distance FROM edges_sparse e JOIN h ON h.node IN (e.id1, e.id2) WHERE id1 <> id2) GROUP BY seed, a, b""")
def e3_cell_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Edges with either end inside, no self-loops, the lighter of parallel ones."""
    return G.lightest_edges(G.induced_edges(_hops(spark, d), table(spark, d, "edges_sparse"), either=True), ["seed"])


@query(HOPS + "SELECT seed, count(*) AS nodes FROM h GROUP BY seed HAVING count(*) <= 17")
def e2_node_cap(spark: SparkSession, d: str) -> DataFrame:
    """Seeds whose two-hop neighbourhood stays under a node cap."""
    return G.hops_from(_seeds(spark, d), table(spark, d, "edges_sparse"), 2, max_nodes=17).groupBy("seed").agg(F.count(F.lit(1)).alias("nodes"))


PAIRS = "pair AS (SELECT id AS source, CAST(2000000 + (id - 2000000 + 2) % (SELECT count(*) FROM part) AS BIGINT) AS target FROM seed)"
PATHS = f"""WITH {STEP}, {SEEDS}, {PAIRS},
p1 AS (SELECT source, target, [source, dst] AS path FROM pair JOIN step ON src = source),
p2 AS (SELECT source, target, list_append(path, dst) AS path FROM p1 JOIN step ON src = path[-1] WHERE path[-1] <> target AND NOT list_contains(path, dst)),
p3 AS (SELECT source, target, list_append(path, dst) AS path FROM p2 JOIN step ON src = path[-1] WHERE path[-1] <> target AND NOT list_contains(path, dst)),
p4 AS (SELECT source, target, list_append(path, dst) AS path FROM p3 JOIN step ON src = path[-1] WHERE path[-1] <> target AND NOT list_contains(path, dst)),
found AS (SELECT * FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4) WHERE path[-1] = target),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY len(path), path) AS rank FROM found)
"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").agg(F.count(F.lit(1)).alias("n"))
    target = 2000000 + (F.col("node") - 2000000 + 2) % n.select("n").scalar()
    return _seeds(spark, d).select(F.col("node").alias("source"), target.cast("long").alias("target"))


def _paths(spark: SparkSession, d: str, most: int | None = None) -> DataFrame:
    return G.simple_paths(_pairs(spark, d), table(spark, d, "edges_sparse"), 4, most)


@query(PATHS + "SELECT source, target, list_aggregate(path, 'string_agg', '-') AS path, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5")
def e12_simple_paths(spark: SparkSession, d: str) -> DataFrame:
    """The five shortest simple paths of at most four edges of each pair."""
    return _paths(spark, d, 5).select("source", "target", F.array_join("path", "-").alias("path"), "rank")


@query(PATHS + "SELECT source, target, list_aggregate(path, 'string_agg', '-') AS path, CAST(len(path) - 1 AS INT) AS hops FROM ranked WHERE rank = 1")
def e7_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    found = G.shortest_paths(_pairs(spark, d), table(spark, d, "edges_sparse"), 4)
    return found.select("source", "target", F.array_join("path", "-").alias("path"), "hops")


@query(PATHS + f""", n AS (SELECT 2000000 + p_partkey AS id, 103.80e0 + (p_partkey * 7919 % 10007) / 10007.0e0 * 0.20e0 AS lon, 1.25e0 + (p_partkey * 104729 % 10009) / 10009.0e0 * 0.15e0 AS lat FROM part),
l AS (SELECT source, target, path[i] AS a, path[i + 1] AS b, len(path) - 1 AS hops FROM (SELECT *, unnest(range(1, len(path))) AS i FROM ranked WHERE rank = 1))
SELECT source, target, CAST(any_value(hops) AS INT) AS hops, round(sum({hav('x.lon', 'x.lat', 'y.lon', 'y.lat')}), 2) AS length FROM l JOIN n x ON x.id = a JOIN n y ON y.id = b GROUP BY source, target""")
def h15_shortest_paths_to(spark: SparkSession, d: str) -> DataFrame:
    """One shortest path of each pair, with its metres (H15); its text is tested by hand-made rows."""
    nodes = table(spark, d, "street_vertices").where("pos = 0").select(F.col("id").alias("node"), "name", F.lit("line").alias("kind"))
    key = F.col("node") - 2000000
    nodes = nodes.withColumns({"lon": 103.80 + (key * 7919 % 10007) / 10007.0 * 0.20, "lat": 1.25 + (key * 104729 % 10009) / 10009.0 * 0.15})
    found = P.shortest_paths_to(_pairs(spark, d), table(spark, d, "edges_sparse"), nodes, 4)
    return found.select("source", "target", "hops", F.round("length", 2).alias("length"))


@query(PATHS + """, f AS (SELECT * FROM ranked WHERE rank <= 5), s AS (SELECT a.source, a.target, avg(len(list_intersect(a.path, b.path)) * 1.0 / len(list_distinct(list_concat(a.path, b.path)))) AS s FROM f a JOIN f b ON a.source = b.source AND a.target = b.target AND a.rank < b.rank GROUP BY ALL)
SELECT f.source, f.target, count(*) AS n_paths, round(coalesce(1 - any_value(s.s), 1.0), 6) AS diversity, CAST(min(len(path)) AS INT) AS min_len, CAST(max(len(path)) AS INT) AS max_len FROM f LEFT JOIN s ON f.source = s.source AND f.target = s.target GROUP BY f.source, f.target""")
def e18_path_set_diversity(spark: SparkSession, d: str) -> DataFrame:
    """One less the mean similarity of each pair's paths."""
    return G.path_set_diversity(_paths(spark, d, 5)).withColumn("diversity", F.round("diversity", 6))


#: Places of the parts as SQL text, in the square of the made points.
PLACES = "pl AS (SELECT 2000000 + p_partkey AS node, p_brand AS name, CASE p_size % 3 WHEN 0 THEN 'point' WHEN 1 THEN 'area' ELSE 'line' END AS class, 103.80 + (p_partkey * 7919 % 10007) / 10007.0 * 0.20 AS lon, 1.25 + (p_partkey * 104729 % 10009) / 10009.0 * 0.15 AS lat FROM part)"


@query(HOPS + f""", {PLACES}, p AS (SELECT seed, dst AS node, [seed, dst] AS path FROM h0 JOIN step ON node = src UNION ALL SELECT h1.seed, dst, [h1.seed, h1.node, dst] FROM h1 JOIN step ON node = src),
f AS (SELECT h.seed AS image, h.node AS target, h.hop AS hops, min(path) AS path FROM h JOIN p ON p.seed = h.seed AND p.node = h.node AND len(path) = hop + 1 WHERE hop > 0 GROUP BY ALL),
t AS (SELECT f.*, {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS m FROM f JOIN pl a ON a.node = image JOIN pl b ON b.node = target WHERE b.class IN ('point', 'area') AND target NOT IN (SELECT id FROM seed)),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, hops ORDER BY m > 8000, target) AS t FROM t) WHERE t <= 2),
s AS (SELECT image, target FROM (SELECT image, target, unnest(path) AS node FROM r) JOIN pl USING (node) GROUP BY ALL HAVING count(DISTINCT name) = count(*))
SELECT image, target, list_aggregate(path, 'string_agg', '-') AS path, hops, round(m, 2) AS distance, m <= 8000 AS near, CAST(rank AS INT) AS rank FROM (SELECT r.*, row_number() OVER (PARTITION BY image ORDER BY hops, t) AS rank FROM r JOIN s USING (image, target)) WHERE rank <= 3""")
def e30_paths_for_images(spark: SparkSession, d: str) -> DataFrame:
    """Three paths of at most two edges from every seed to points and areas, near ones first."""
    kind = F.when(F.col("p_size") % 3 == 0, "point").when(F.col("p_size") % 3 == 1, "area").otherwise("line")
    k = F.col("p_partkey")
    nodes = table(spark, d, "part").select((k + 2000000).alias("node"), F.col("p_brand").alias("name"), kind.alias("class"), (103.80 + (k * 7919 % 10007) / 10007.0 * 0.20).alias("lon"), (1.25 + (k * 104729 % 10009) / 10009.0 * 0.15).alias("lat"))
    found = P.paths_for_images(_seeds(spark, d).select(F.col("node").alias("image")), nodes, table(spark, d, "edges_sparse"), ("point", "area"), 1, 2, 8000.0, 3)
    return found.select("image", "target", F.array_join("path", "-").alias("path"), "hops", F.round("distance", 2).alias("distance"), "near", "rank")


@query()
def e13_diverse_paths(spark: SparkSession, d: str) -> DataFrame:
    """Greedy choice of dissimilar paths up to min(shortest + 5, 12) edges (E13, E16); tested against a brute-force search."""
    return G.find_diverse_paths(_pairs(spark, d), table(spark, d, "edges_sparse"))


@query()
def e14_length_diverse_paths(spark: SparkSession, d: str) -> DataFrame:
    """Dissimilar paths of all lengths up to min(shortest + 8, 15) (E14); tested against a brute-force search."""
    return G.find_paths_of_all_lengths(_pairs(spark, d), table(spark, d, "edges_sparse"))


@query(PATHS + """, f AS (SELECT * FROM ranked WHERE rank <= 5), c AS (SELECT source, target, path, rank, [x for x in path if x % 3 = 0] AS touched FROM f)
SELECT source, target, row_number() OVER (PARTITION BY source, target ORDER BY rank) - 1 AS path_id, list_aggregate(path, 'string_agg', '-') AS path, CAST(len(path) - 1 AS INT) AS length, list_aggregate(touched, 'string_agg', '-') AS nodes FROM c WHERE len(touched) > 0""")
def e32_paths_between(spark: SparkSession, d: str) -> DataFrame:
    """Of each pair's five paths those that touch a node of a category, with these nodes."""
    chosen = G.goal_directed_paths(_pairs(spark, d), table(spark, d, "edges_sparse"), 4, most=5)
    nodes = table(spark, d, "part").select((F.col("p_partkey") + 2000000).alias("node")).withColumn("category", F.when(F.col("node") % 3 == 0, "stop").otherwise("other"))
    out = G.paths_between(chosen, nodes, "stop")
    return out.select("source", "target", F.col("path_id").cast("long").alias("path_id"), F.array_join("path", "-").alias("path"), "length", F.array_join("category_nodes", "-").alias("nodes"))


@query(HOPS + """, q AS (SELECT id AS source, CAST(2000000 + (id - 2000000 + k) % (SELECT count(*) FROM part) AS BIGINT) AS target FROM seed, (VALUES (2), (50)) AS v(k))
SELECT source, target, coalesce(CAST(hop AS DOUBLE), CAST('Infinity' AS DOUBLE)) AS hops FROM q LEFT JOIN h ON seed = source AND node = target""")
def e8_hop_distances(spark: SparkSession, d: str) -> DataFrame:
    """Hops of pairs within two steps, infinity beyond."""
    near = _pairs(spark, d)
    n = table(spark, d, "part").agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    far = near.select("source", (2000000 + (F.col("source") - 2000000 + 50) % n).cast("long").alias("target"))
    return G.hop_distances(near.unionByName(far), table(spark, d, "edges_sparse"), 2)


@query()
def e19_random_walks(spark: SparkSession, d: str) -> DataFrame:
    """Seeded self-avoiding walks."""
    starts = _pairs(spark, d).select(F.col("source").alias("walk"), "source", "target")
    return G.random_walks(starts, table(spark, d, "edges_sparse"), 8, seed=3)


MORAN = """WITH v AS (SELECT p_partkey % 20 AS graph, 2000000 + p_partkey AS node, CAST(p_size AS DOUBLE) AS value FROM part),
z AS (SELECT graph, node, coalesce((value - avg(value) OVER (PARTITION BY graph)) / nullif(stddev_samp(value) OVER (PARTITION BY graph), 0), 0) AS z FROM v),
e AS (SELECT a.p_partkey % 20 AS graph, 2000000 + a.p_partkey AS src, 2000000 + b.p_partkey AS dst FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 20),
l AS (SELECT e.graph, src, sum(z.z) AS lag FROM e JOIN z ON z.graph = e.graph AND z.node = dst GROUP BY ALL)
SELECT z.graph, z.node, round(coalesce((count(*) OVER (PARTITION BY z.graph) - 1) * z * coalesce(lag, 0) / nullif(sum(z * z) OVER (PARTITION BY z.graph), 0), 0), 6) AS moran FROM z LEFT JOIN l ON l.graph = z.graph AND l.src = z.node"""


@query(MORAN)
def e42_local_morans(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    values = p.select((F.col("p_partkey") % 20).alias("graph"), (F.col("p_partkey") + 2000000).alias("node"), F.col("p_size").cast("double").alias("value"))
    edges = p.join(p.select((F.col("p_partkey") - 20).alias("p_partkey")), "p_partkey").select((F.col("p_partkey") % 20).alias("graph"), (F.col("p_partkey") + 2000000).alias("src"), (F.col("p_partkey") + 2000020).alias("dst"), F.lit(1.0).alias("w"))
    return G.local_morans(values, edges).withColumn("moran", F.round("moran", 6))


@query("SELECT id1, id2, type, distance, round((max(distance) OVER (PARTITION BY type) - distance) / (max(distance) OVER (PARTITION BY type) - min(distance) OVER (PARTITION BY type) + 1e-8), 6) AS weight FROM edges_sparse")
def e43_distance_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights within each edge type."""
    return G.distance_weights(table(spark, d, "edges_sparse"), "type").withColumn("weight", F.round("weight", 6))


@query("""WITH k AS (SELECT least(id1, id2) AS x, greatest(id1, id2) AS y, min(struct_pack(t := type, d := distance)) AS e FROM edges_sparse GROUP BY ALL),
q AS (SELECT 2000000 + p_partkey + 1 AS a, 2000000 + p_partkey AS b FROM part)
SELECT a, b, coalesce(e.t, 'unknown') AS type, e.d AS distance FROM q LEFT JOIN k ON x = least(a, b) AND y = greatest(a, b)""")
def d23_edge_lookup(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "part").select((F.col("p_partkey") + 2000001).alias("a"), (F.col("p_partkey") + 2000000).alias("b"))
    return G.edge_lookup(pairs, table(spark, d, "edges_sparse"))


@query("SELECT type, count(*) AS n FROM edges_sparse GROUP BY type")
def f11_edge_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges_sparse").groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH i AS (SELECT CAST(CAST(floor(lon * 100) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(floor(lat * 100) AS BIGINT) AS VARCHAR) AS cell, id, lon, lat FROM images),
a AS (SELECT cell, min(id) AS id, arg_min(lon, id) AS x, arg_min(lat, id) AS y FROM i GROUP BY cell), r1 AS (SELECT i.cell, i.id, lon, lat, sqrt(pow(lon - x, 2) + pow(lat - y, 2)) AS far FROM i JOIN a ON a.cell = i.cell AND a.id <> i.id),
b AS (SELECT cell, arg_min(id, (-far, id)) AS id, arg_min(lon, (-far, id)) AS x, arg_min(lat, (-far, id)) AS y FROM r1 GROUP BY cell), r2 AS (SELECT r1.cell, r1.id, least(far, sqrt(pow(lon - x, 2) + pow(lat - y, 2))) AS far FROM r1 JOIN b ON b.cell = r1.cell AND b.id <> r1.id),
c AS (SELECT cell, arg_min(id, (-far, id)) AS id FROM r2 GROUP BY cell) SELECT cell, id, 1 AS round FROM a UNION ALL SELECT cell, id, 2 FROM b UNION ALL SELECT cell, id, 3 FROM c""")
def e33_spread_sample(spark: SparkSession, d: str) -> DataFrame:
    """Three images spread over each grid cell."""
    cell = F.concat_ws(":", F.floor(F.col("lon") * 100), F.floor(F.col("lat") * 100))
    return G.spread_sample(table(spark, d, "images").select(cell.alias("cell"), "id", "lon", "lat"), 3)
