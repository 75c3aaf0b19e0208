"""Queries that build, extend and check subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.operators import graph as G
from urbanloom.operators import subgraphs as B
from urbanloom.sources.fixtures import table

from .registry import hav, query

#: Graphs of the queries: one a nation, its nodes the streets whose part has its number in the size.
GRAPHS = "g AS (SELECT CAST(p_size % 10 AS BIGINT) AS graph, 2000000 + p_partkey AS id, p_brand AS name, split_part('point,line,area', ',', CAST(1 + p_partkey % 3 AS INT)) AS kind, 103.80e0 + (p_partkey * 7919 % 10007) / 10007.0e0 * 0.20e0 AS lon, 1.25e0 + (p_partkey * 104729 % 10009) / 10009.0e0 * 0.15e0 AS lat FROM part)"
EDGES = "ge AS (SELECT a.graph, e.id1, e.id2, e.type FROM edges_sparse e JOIN g a ON a.id = e.id1 JOIN g b ON b.id = e.id2 AND a.graph = b.graph)"


def _graphs(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"WITH {GRAPHS.replace('FROM part', 'FROM {part}')} SELECT * FROM g", part=table(spark, d, "part"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    g = _graphs(spark, d)
    of = lambda c: g.select("graph", F.col("id").alias(c))
    return table(spark, d, "edges_sparse").select("id1", "id2", "type").join(of("id1"), "id1").join(of("id2"), ["graph", "id2"]).select("graph", "id1", "id2", "type")


@query(f"WITH {GRAPHS} SELECT id, graph, CASE WHEN id % 4 = 0 THEN 'table ' || name ELSE 'own' END AS name FROM g")
def d24_node_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Node names, where a quarter of the nodes is in the table, whose values win."""
    g = _graphs(spark, d)
    known = g.where("id % 4 = 0").select("id", F.concat(F.lit("table "), F.col("name")).alias("name"))
    return B.node_lookup(g.select("id", "graph", F.lit("own").alias("name")), known, "id", ["name"])


@query(f"WITH {GRAPHS}, i AS (SELECT user_id % 10 AS graph, id AS image, lon, lat FROM images), f AS (SELECT i.graph, i.image, g.id, {hav('i.lon', 'i.lat', 'g.lon', 'g.lat')} AS dd FROM i JOIN g ON i.graph = g.graph) SELECT graph, image, arg_min(id, (dd, id)) AS node, round(min(dd), 4) AS distance, 'mapillary_connection' AS type FROM f GROUP BY graph, image")
def d25_attach_image_to_nearest_node(spark: SparkSession, d: str) -> DataFrame:
    """All images at the nearest node of their graph."""
    images = table(spark, d, "images").select((F.col("user_id") % 10).alias("graph"), F.col("id").alias("image"), "lon", "lat")
    return B.attach_nearest(images, _graphs(spark, d)).withColumn("distance", F.round("distance", 4))


@query(f"WITH {GRAPHS} SELECT graph, id FROM g UNION SELECT user_id % 10, id FROM images")
def d26_attach_image_nodes(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "images").select((F.col("user_id") % 10).alias("graph"), F.col("id").alias("image"), "lon", "lat")
    return B.attach_image_nodes(images, _graphs(spark, d).select("graph", "id", "lon", "lat")).select("graph", "id")


REACHED = """s AS (SELECT id1 AS a, id2 AS b FROM edges_sparse WHERE id1 <> id2 UNION SELECT id2, id1 FROM edges_sparse WHERE id1 <> id2),
c AS (SELECT graph, min(id) AS id FROM g GROUP BY graph), r AS (SELECT graph, id FROM c UNION SELECT c.graph, s.b FROM c JOIN s ON s.a = c.id UNION SELECT c.graph, t.b FROM c JOIN s ON s.a = c.id JOIN s t ON t.a = s.b)"""


@query(f"WITH {GRAPHS}, {REACHED} SELECT graph, id FROM g UNION SELECT graph, id FROM r")
def d27_attach_and_expand(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of each graph with those two steps around its first node."""
    g = _graphs(spark, d)
    centres = g.groupBy("graph").agg(F.min("id").alias("node"))
    return B.expand_graphs(centres, g, _edges(spark, d), table(spark, d, "edges_sparse"))[0]


@query(f"WITH {GRAPHS}, {EDGES}, {REACHED}, n AS (SELECT DISTINCT x.graph, e.id1, e.id2, e.type FROM edges_sparse e JOIN r x ON x.id = e.id1 JOIN r y ON y.id = e.id2 AND y.graph = x.graph), u AS (SELECT graph, id1, id2, min(type) AS type, 0 AS o FROM ge GROUP BY ALL UNION ALL SELECT graph, id1, id2, min(type), 1 FROM n GROUP BY graph, id1, id2) SELECT graph, id1, id2, arg_min(type, (o, type)) AS type FROM u GROUP BY graph, id1, id2")
def d28_expand_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Edges of each graph with those among the nodes around its first node; its own win."""
    g = _graphs(spark, d)
    centres = g.groupBy("graph").agg(F.min("id").alias("node"))
    return B.expand_graphs(centres, g, _edges(spark, d), table(spark, d, "edges_sparse"))[1]


@query(f"WITH {GRAPHS}, {EDGES}, p AS (SELECT graph, id FROM g WHERE id % 40 = 0), u AS (SELECT graph, id1 AS a, id2 AS b FROM ge WHERE id1 <> id2 UNION SELECT graph, id2, id1 FROM ge WHERE id1 <> id2) SELECT graph, id FROM p UNION SELECT p.graph, u.b FROM p JOIN u ON u.graph = p.graph AND u.a = p.id UNION SELECT p.graph, v.b FROM p JOIN u ON u.graph = p.graph AND u.a = p.id JOIN u v ON v.graph = p.graph AND v.a = u.b")
def e35_path_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """Path nodes and two steps around them within their graph; every fortieth node is on a path."""
    path = _graphs(spark, d).where("id % 40 = 0").select("graph", F.col("id").alias("node"))
    return B.path_neighbourhood(path, _edges(spark, d))[0]


@query(f"""WITH {GRAPHS}, s AS (SELECT id1 AS a, id2 AS b FROM edges_sparse WHERE id1 <> id2 UNION SELECT id2, id1 FROM edges_sparse WHERE id1 <> id2), m AS (SELECT (id % 10) AS graph, id FROM g WHERE id % 50 = 1 EXCEPT SELECT graph, id FROM g),
h AS (SELECT graph, id, 0 AS hop FROM m UNION ALL SELECT m.graph, s.b, 1 FROM m JOIN s ON s.a = m.id UNION ALL SELECT m.graph, t.b, 2 FROM m JOIN s ON s.a = m.id JOIN s t ON t.a = s.b),
l AS (SELECT graph, id, min(hop) AS hop FROM h WHERE (graph, id) NOT IN (SELECT (graph, id) FROM g) GROUP BY graph, id), q AS (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY hop, id) AS r FROM l)
SELECT q.graph, q.id, q.hop FROM q LEFT JOIN (SELECT graph, count(*) AS n FROM g GROUP BY graph) k ON k.graph = q.graph WHERE r <= 230 - coalesce(n, 0)""")
def e36_add_missing_path_nodes(spark: SparkSession, d: str) -> DataFrame:
    """What graphs lack of their paths and two steps around, up to 230 nodes a graph, which is the operator's cap."""
    g = _graphs(spark, d)
    path = g.where("id % 50 = 1").select((F.col("id") % 10).alias("graph"), F.col("id").alias("node"))
    return B.add_missing_nodes(path, g, table(spark, d, "edges_sparse"), 230)


@query(f"WITH {GRAPHS} SELECT graph AS cell, list(id ORDER BY id) AS members FROM g WHERE id IN (SELECT id1 FROM edges_sparse WHERE type = 'crossing') AND id % 3 = 0 GROUP BY graph")
def d30_valid_cell_members(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "edges_sparse").where("type = 'crossing' and id1 % 3 = 0").select(F.col("id1").alias("id"))
    return B.valid_members(_graphs(spark, d).select(F.col("graph").alias("cell"), "id"), known)


@query("SELECT DISTINCT p_size AS cell FROM part WHERE 2000000 + p_partkey IN (SELECT 2000000 + event_id FROM events WHERE event_type = 'error')")
def d21_cells_with_images(spark: SparkSession, d: str) -> DataFrame:
    """Cells that hold an image."""
    images = table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("p_partkey"))
    return table(spark, d, "part").select(F.col("p_size").alias("cell"), "p_partkey").join(images, "p_partkey", "left_semi").select("cell").distinct()


@query("SELECT DISTINCT id1 AS id, 'missing' AS problem FROM edges_sparse WHERE type = 'crossing' AND id1 NOT IN (SELECT 2000000 + p_partkey FROM part WHERE p_size > 5) UNION ALL SELECT 2000000 + p_partkey, 'not_a_crossing' FROM part WHERE p_size > 5 AND p_size % 2 = 1 AND 2000000 + p_partkey IN (SELECT id1 FROM edges_sparse WHERE type = 'crossing')")
def d5_verify_id_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Crossings without a node, and nodes of another type; small parts have no node and odd sizes another type."""
    crossings = table(spark, d, "edges_sparse").where("type = 'crossing'").select(F.col("id1").alias("id"))
    nodes = table(spark, d, "part").where("p_size > 5").select((F.col("p_partkey") + 2000000).alias("id"), F.when(F.col("p_size") % 2 == 0, "Crossing").otherwise("street").alias("type"))
    return B.verify_mapping(crossings, nodes)


@query(f"WITH {GRAPHS}, k AS (SELECT graph, count(*) AS n FROM g WHERE id % 7 <> 0 GROUP BY graph) SELECT node FROM walks WHERE node % 12 IN (SELECT graph FROM k) AND node % 11 IN (SELECT graph FROM k)")
def b32_valid_graph_reference(spark: SparkSession, d: str) -> DataFrame:
    """Nodes both of whose graphs exist; numbers 10 and 11 do not."""
    graphs = _graphs(spark, d).where("id % 7 <> 0").groupBy("graph").agg(F.count(F.lit(1)).alias("nodes"))
    rows = table(spark, d, "walks").select(F.col("node").alias("key"), F.array(F.col("node") % 12, F.col("node") % 11).alias("graphs"))
    return B.valid_references(rows, graphs).select(F.col("key").alias("node"))


@query(f"WITH {GRAPHS} SELECT graph, count(*) AS before, count(*) FILTER (WHERE kind <> 'line') AS after FROM g GROUP BY graph")
def e39_essential_subgraph(spark: SparkSession, d: str) -> DataFrame:
    g = _graphs(spark, d)
    return B.essential_nodes(g, g.where("kind <> 'line'"))


@query(f"WITH {GRAPHS}, c AS (SELECT id AS centre, lon AS x, lat AS y FROM g WHERE id % 20 = 0), a AS (SELECT centre, id, {hav('x', 'y', 'lon', 'lat')} AS dd, false AS linked FROM c JOIN g ON abs(y - lat) < 0.003 AND abs(x - lon) < 0.003 UNION ALL SELECT centre, g.id, {hav('x', 'y', 'g.lon', 'g.lat')}, true FROM c JOIN edges_sparse e ON e.id1 = c.centre OR e.id2 = c.centre JOIN g ON g.id = CASE WHEN e.id1 = c.centre THEN e.id2 ELSE e.id1 END) SELECT centre, id, round(min(dd), 3) AS distance FROM a WHERE (linked OR dd <= 200) AND centre <> id GROUP BY centre, id")
def h32_adjacent_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of the nodes whose id is divisible by 20, over edges or within 200 m."""
    g = _graphs(spark, d)
    out = B.adjacent_nodes(g.where("id % 20 = 0").select(F.col("id").alias("centre"), "lon", "lat"), g, table(spark, d, "edges_sparse"))
    return out.withColumn("distance", F.round("distance", 3))


@query("WITH r AS (SELECT id1 AS centre, id2 AS id, type AS name, distance FROM edges), k AS (SELECT *, row_number() OVER (PARTITION BY centre, name ORDER BY distance, id) AS i FROM r), gg AS (SELECT centre, name, count(*) AS n, min(distance) AS distance, list(id ORDER BY i) FILTER (WHERE i <= 5) AS ids FROM k GROUP BY centre, name) SELECT centre, name, n, distance, ids FROM (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY distance, name) AS r FROM gg) WHERE r <= 2")
def h33_grouped_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The two nearest groups of neighbours of each street with five ids."""
    rows = table(spark, d, "edges").select(F.col("id1").alias("centre"), F.col("id2").alias("id"), F.col("type").alias("name"), "distance")
    return B.grouped_neighbours(rows, "centre", ["name"], 2)


@query("WITH l AS (SELECT id2 AS centre, id1 AS node, min(distance) AS distance FROM edges GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY distance, node) AS place, greatest(count(*) OVER (PARTITION BY centre) - 13, 0) AS more FROM l) SELECT centre, node, distance, place, more FROM p WHERE place <= 13")
def g6_top_k_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 13 nearest streets of each point and how many more there are."""
    rows = table(spark, d, "edges").select(F.col("id2").alias("centre"), F.col("id1").alias("node"), "distance")
    return B.nearest_first(rows, "centre", "node", 13)


@query("SELECT id1, id2, type, CASE (id1 % 5 = 0)::INT + (id2 % 5 = 0)::INT WHEN 2 THEN 'centre-centre' WHEN 1 THEN 'centre-neighbour' ELSE 'neighbour-neighbour' END AS class FROM edges_sparse")
def g8_edge_classes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges_sparse").select("id1", "id2", "type")
    centres = table(spark, d, "part").select((F.col("p_partkey") + 2000000).alias("id")).where("id % 5 = 0").unionByName(e.select(F.col("id2").alias("id")).where("id % 5 = 0"))
    return B.edge_classes(e, centres)


@query(f"WITH {GRAPHS}, s AS (SELECT id1 AS a, id2 AS b FROM edges_sparse WHERE id1 <> id2 UNION SELECT id2, id1 FROM edges_sparse WHERE id1 <> id2), c AS (SELECT id AS graph FROM g WHERE id % 20 = 0), h1 AS (SELECT graph, b AS n FROM c JOIN s ON a = graph), h2 AS (SELECT DISTINCT graph, s.b AS n FROM h1 JOIN s ON s.a = h1.n), r AS (SELECT graph, graph AS n, 0 AS hop FROM c UNION ALL SELECT DISTINCT graph, n, 1 FROM h1 UNION ALL SELECT graph, n, 2 FROM h2), d AS (SELECT graph, n, min(hop) AS hop FROM r GROUP BY ALL), p AS (SELECT d.graph, d.graph AS a, d.n AS b, d.hop, {hav('x.lon', 'x.lat', 'y.lon', 'y.lat')} / 1000 * (1 + d.hop / 10.0) AS score FROM d JOIN g x ON x.id = d.graph JOIN g y ON y.id = d.n WHERE d.hop >= 2 AND d.graph < d.n AND (x.kind <> 'line' OR y.kind <> 'line')) SELECT graph, arg_min(a, (-score, a, b)) AS a, arg_min(b, (-score, a, b)) AS b, arg_min(hop, (-score, a, b)) AS hops, round(max(score), 6) AS score FROM p GROUP BY graph")
def e31_farthest_pair(spark: SparkSession, d: str) -> DataFrame:
    """The best pair around each node whose id is divisible by 20, two steps at least apart."""
    g = _graphs(spark, d)
    seeds = g.where("id % 20 = 0").select(F.col("id").alias("seed"), F.col("id").alias("node"))
    hops = G.hops_from(seeds, table(spark, d, "edges_sparse"), 2).select(F.col("seed").alias("graph"), F.col("seed").alias("a"), F.col("node").alias("b"), "hop")
    return B.farthest_pairs(hops, g.select("id", "kind", "lon", "lat"), 2).withColumn("score", F.round("score", 6))


@query("WITH s AS (SELECT id1 AS a, id2 AS b FROM edges_sparse WHERE id1 <> id2 UNION SELECT id2, id1 FROM edges_sparse WHERE id1 <> id2), n AS (SELECT DISTINCT a FROM s), h AS (SELECT a AS seed, a AS node, 0 AS hop FROM n UNION ALL SELECT a, b, 1 FROM s UNION ALL SELECT s.a, t.b, 2 FROM s JOIN s t ON t.a = s.b) SELECT hop, count(*) AS pairs FROM (SELECT seed, node, min(hop) AS hop FROM h GROUP BY ALL) GROUP BY hop")
def e9_all_pairs_hops(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs of all nodes are so many steps apart, up to two."""
    e = table(spark, d, "edges_sparse")
    seeds = G.doubled(e.select("id1", "id2")).where("src <> dst").select(F.col("src").alias("seed"), F.col("src").alias("node")).distinct()
    return G.hops_from(seeds, e, 2).groupBy("hop").agg(F.count(F.lit(1)).alias("pairs"))


@query("SELECT split_part(url, '/', -1) AS job, min(page_id) AS first FROM pages WHERE split_part(url, '/', -1) <> '' GROUP BY 1 HAVING split_part(url, '/', -1) NOT IN (SELECT split_part(url, '/', -1) FROM pages WHERE page_id % 10 = 0)")
def e44_dedupe_graph_jobs(spark: SparkSession, d: str) -> DataFrame:
    """One job for each base name; those of every tenth page are done."""
    p = table(spark, d, "pages")
    done = p.where("page_id % 10 = 0").select(F.element_at(F.split("url", "/"), -1).alias("job"))
    return B.first_jobs(p, done, F.col("url"), "page_id")


@query("WITH r AS (SELECT id, lon, lat FROM points), m AS (SELECT avg(lon) AS x, avg(lat) AS y FROM r) SELECT id, round(sqrt(pow(lon - x, 2) + pow(lat - y, 2)), 8) AS priority FROM r, m WHERE id % 3 = 0 AND id % 9 <> 0 ORDER BY sqrt(pow(lon - x, 2) + pow(lat - y, 2)), id LIMIT 100")
def b7_geocode_queue(spark: SparkSession, d: str) -> DataFrame:
    """The 100 requests of the budget: a third of the points lack a street, a ninth are done."""
    p = table(spark, d, "points").select("id", "lon", "lat", F.lit("c").alias("city"), F.when(F.col("id") % 3 != 0, "s").alias("street"))
    return B.geocode_queue(p, p.where("id % 9 = 0"), 100).withColumn("priority", F.round("priority", 8))
