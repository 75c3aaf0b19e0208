"""Where registered queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from urbanloom.sources.fixtures import with_tables

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with DuckDB SQL that may name the made tables."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_tables(sql)
        return f

    return add


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Great-circle metres as SQL text."""
    return f"(12742000.0 * asin(sqrt(least(1.0, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2)))))"


def bear(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Bearing from north as SQL text, -pi to pi."""
    d = f"radians(({lon2}) - ({lon1}))"
    return f"atan2(sin({d}) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({d}))"


#: Segments of the made streets as SQL text.
SEGMENTS = "SELECT * FROM (SELECT id, pos AS seg, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM street_vertices WINDOW w AS (PARTITION BY id ORDER BY pos)) WHERE x2 IS NOT NULL"
#: Crossings of the made streets as SQL text (needs the CTE seg).
CROSSINGS = """SELECT line1, line2, min(struct_pack(lon := lon, lat := lat)).lon AS lon, min(struct_pack(lon := lon, lat := lat)).lat AS lat FROM (
    SELECT line1, line2, ax1 + t * (ax2 - ax1) AS lon, ay1 + t * (ay2 - ay1) AS lat FROM (
      SELECT *, ((bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1)) / d AS t, ((bx1 - ax1) * (ay2 - ay1) - (by1 - ay1) * (ax2 - ax1)) / d AS u FROM (
        SELECT a.id AS line1, b.id AS line2, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2,
          (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) AS d FROM seg a JOIN seg b ON a.id < b.id
          AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2))
      WHERE abs(d) > 1e-18) WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1) GROUP BY line1, line2, round(lon, 8), round(lat, 8)"""
