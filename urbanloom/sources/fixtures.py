"""City tables made from the supplied star schema by one SQL text that Spark and DuckDB both run.

Integer arithmetic only, so both engines give equal rows. Each entry is a query over the named base tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

TABLES = {
    "points": """
        SELECT s_suppkey AS id, s_name AS name, 'poi' AS type, 'commercial' AS category, s_nationkey AS nation,
               103.80e0 + (s_suppkey * 7919 % 10007) / 10007.0e0 * 0.20e0 AS lon,
               1.25e0 + (s_suppkey * 104729 % 10009) / 10009.0e0 * 0.15e0 AS lat FROM supplier
        UNION ALL
        SELECT 1000000 + c_custkey, c_name, 'poi', lower(c_mktsegment), c_nationkey,
               103.80e0 + (c_custkey * 6971 % 10007) / 10007.0e0 * 0.20e0,
               1.25e0 + (c_custkey * 15485863 % 10009) / 10009.0e0 * 0.15e0 FROM customer""",
    "images": """
        SELECT 10000000000 + event_id AS id, user_id, ts, 'mapillary' AS type,
               CAST(round(value * 100) AS BIGINT) % 360 AS compass_angle,
               103.80e0 + (event_id * 5417 % 10007) / 10007.0e0 * 0.20e0 AS lon,
               1.25e0 + (event_id * 7573 % 10009) / 10009.0e0 * 0.15e0 AS lat FROM events""",
    "street_vertices": """
        SELECT 2000000 + p_partkey AS id, p_brand AS name, i AS pos,
               103.80e0 + (p_partkey * 7919 % 10007) / 10007.0e0 * 0.20e0
                 + i * (p_partkey * 31 % 21 - 10) * 0.0002e0 + (p_partkey + i * 17) % 7 * 0.0002e0 AS lon,
               1.25e0 + (p_partkey * 104729 % 10009) / 10009.0e0 * 0.15e0
                 + i * (p_partkey * 37 % 21 - 10) * 0.0002e0 + (p_partkey + i * 13) % 5 * 0.0002e0 AS lat
        FROM part, (VALUES (0), (1), (2), (3), (4)) AS v(i) WHERE i < 2 + p_partkey % 4""",
    "area_rings": """
        SELECT CAST(3000000 + n_nationkey AS BIGINT) AS id, n_name AS name, pos,
               103.81e0 + (n_nationkey % 5) * 0.037e0 + dx * 0.01e0 AS lon,
               1.26e0 + CAST(floor(n_nationkey / 5) AS BIGINT) * 0.027e0 + dy * 0.01e0 AS lat
        FROM nation, (VALUES (0,0,0),(1,2,0),(2,2,1),(3,1,1),(4,1,2),(5,0,2),(6,0,0)) AS r(pos, dx, dy)""",
    "edges": """
        SELECT 2000000 + l_partkey AS id1, l_suppkey AS id2,
               CASE min(l_returnflag) WHEN 'A' THEN 'nearest' WHEN 'N' THEN 'on_same_street' ELSE 'crossing' END AS type,
               CAST(min(l_quantity) AS DOUBLE) AS distance FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "edges_sparse": """
        SELECT 2000000 + p_partkey AS id1, 2000000 + (p_partkey + 1) % n AS id2, 'on_same_street' AS type,
               CAST(10 + p_partkey % 90 AS DOUBLE) AS distance FROM part, (SELECT count(*) AS n FROM part) AS c
        UNION ALL
        SELECT 2000000 + p_partkey, 2000000 + (p_partkey * 7 + 3) % n, 'crossing',
               CAST(10 + p_partkey % 70 AS DOUBLE) FROM part, (SELECT count(*) AS n FROM part) AS c""",
    "trips": """
        SELECT c_nationkey AS origin, s_nationkey AS destination FROM orders
        JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""",
    "steps": """
        SELECT user_id AS path, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS pos,
               event_type AS name, value FROM events""",
    "walks": """
        SELECT user_id AS path, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS pos, 10000000000 + event_id AS node,
               CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN CAST(event_id AS STRING) ELSE event_type || ' ' || CAST(event_id % 40 AS STRING) END AS name,
               split_part('point,line,area', ',', CAST(1 + event_id % 3 AS INT)) AS kind, event_type AS category,
               split_part('on_same_street,crossing,nearest,near,area_boundary,walkway', ',', CAST(1 + event_id % 6 AS INT)) AS edge,
               103.80e0 + (event_id * 5417 % 10007) / 10007.0e0 * 0.20e0 AS lon, 1.25e0 + (event_id * 7573 % 10009) / 10009.0e0 * 0.15e0 AS lat FROM events""",
    "roads": """
        SELECT 2000000 + p_partkey AS id, p_brand AS name, split_part('motorway,trunk,primary,secondary,tertiary,residential,service,unclassified,living_street,pedestrian,footway,path,track,bridleway,steps,raceway', ',', CAST(1 + p_partkey % 16 AS INT)) AS highway,
               nullif(split_part('yes,no,,,,,', ',', CAST(1 + p_partkey % 7 AS INT)), '') AS bicycle, nullif(split_part('lane,,,,,,,,', ',', CAST(1 + p_partkey % 9 AS INT)), '') AS cycleway,
               nullif(split_part('both,left,none,,,,,,,,', ',', CAST(1 + p_partkey % 11 AS INT)), '') AS sidewalk, nullif(split_part('rail,,,,,,,,,,,,', ',', CAST(1 + p_partkey % 13 AS INT)), '') AS railway,
               nullif(split_part('designated,no,,,,,,,,,,,,,,,', ',', CAST(1 + p_partkey % 17 AS INT)), '') AS foot FROM part""",
    "places": """
        SELECT id, name, nullif(split_part('park,,,', ',', CAST(1 + id % 4 AS INT)), '') AS leisure, nullif(split_part('mall,,,,', ',', CAST(1 + id % 5 AS INT)), '') AS shop,
               split_part('x,,,,,', ',', CAST(1 + id % 6 AS INT)) AS amenity, nullif(split_part('y,,,,,,', ',', CAST(1 + id % 7 AS INT)), '') AS bank, nullif(split_part('z,,,,,,,,', ',', CAST(1 + id % 9 AS INT)), '') AS cafe,
               nullif(split_part('commercial,,', ',', CAST(1 + id % 3 AS INT)), '') AS given FROM points""",
    "scored": """
        SELECT event_id AS pos, user_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label, value AS score FROM events""",
    "rewards": """
        SELECT l_orderkey AS prompt_id, l_linenumber AS request_id, CAST(l_discount AS DOUBLE) * 10 AS reward FROM lineitem""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied or a made table as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = TABLES[name]
    used = {b: table(spark, sf_dir, b) for b in (*BASE, *TABLES) if b != name and re.search(rf"\b(FROM|JOIN) {b}\b", sql)}
    for b in used:
        sql = re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{{b}}}", sql)
    return spark.sql(sql, **used)


def with_tables(sql: str) -> str:
    """DuckDB SQL with the made tables that it names defined in front."""
    used: dict[str, None] = {}

    def need(text: str) -> None:
        for name in TABLES:
            if re.search(rf"\b{name}\b", text) and name not in used:
                need(TABLES[name].replace(name, ""))
                used[name] = None

    need(sql)
    defined = ", ".join(f"{n} AS ({TABLES[n]})" for n in used)
    if not defined:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {defined}, {body[len('WITH RECURSIVE'):]}"
    return f"WITH {defined}, {body[len('WITH'):]}" if body.upper().startswith("WITH ") else f"WITH {defined} {body}"
