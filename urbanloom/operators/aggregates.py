"""Aggregations over nodes, cells, scores and run logs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.functions import spatial as S

from .rounds import settled


def cell_stats(cells: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` cells with most members, ties to the smaller cell: (cell, n, cells, features), the last two over all cells."""
    totals = cells.agg(F.countDistinct("cell").alias("cells"), F.count(F.lit(1)).alias("features"))
    counted = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cell").limit(top)
    return counted.withColumn("cells", totals.select("cells").scalar()).withColumn("features", totals.select("features").scalar())


#: Points of a cell that one task reduces to their hull.
HULL_ROWS = 100_000


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row numbers of the corners of the convex hull of points, by a monotone chain; points on an edge may stay."""
    order = np.lexsort((y, x))
    keep: set[int] = set()
    for rows in (order, order[::-1]):
        chain: list[int] = []
        for r in rows.tolist():
            while len(chain) > 1 and (x[chain[-1]] - x[chain[-2]]) * (y[r] - y[chain[-2]]) - (y[chain[-1]] - y[chain[-2]]) * (x[r] - x[chain[-2]]) < 0:
                chain.pop()
            chain.append(r)
        keep.update(chain)
    return np.array(sorted(keep), np.int64)


def cell_spread(items: DataFrame, limit_m: float = 2000.0) -> DataFrame:
    """(cell, spread_m, skip): the largest distance of two items of a cell, and whether it is over the limit; cells of one item have no row.

    Seen from a cell's middle (gnomonic), great circles are straight lines, and of points within 45 degrees of it the two
    farthest are corners of their convex hull. Each cell is dealt to parts of about 100,000 points, each part is
    reduced to the corners of its hull, and these meet. A cell that reaches over 30 degrees of longitude or latitude from it keeps all its points. Equal
    coordinates count once for the hull; items without coordinates are left out.
    """
    known = items.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    ends = known.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.avg("lon").alias("_x"), F.avg("lat").alias("_y"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("lon", "lat")]).where("n > 1")
    ends = ends.withColumn("wide", F.greatest(F.col("max_lon") - F.col("_x"), F.col("_x") - F.col("min_lon"), F.col("max_lat") - F.col("_y"), F.col("_y") - F.col("min_lat")) > 30)
    rad = {c: F.radians(c) for c in ("lon", "lat", "_x", "_y")}
    turn = rad["lon"] - rad["_x"]
    cosine = F.sin(rad["_y"]) * F.sin(rad["lat"]) + F.cos(rad["_y"]) * F.cos(rad["lat"]) * F.cos(turn)
    flat = known.select("cell", "lon", "lat").distinct().join(ends, "cell").withColumns({
        "px": F.cos(rad["lat"]) * F.sin(turn) / cosine, "py": (F.cos(rad["_y"]) * F.sin(rad["lat"]) - F.sin(rad["_y"]) * F.cos(rad["lat"]) * F.cos(turn)) / cosine})
    part = F.pmod(F.xxhash64("lon", "lat"), F.ceil(F.col("n") / HULL_ROWS)).cast("int")
    kind = f"cell {items.schema['cell'].dataType.simpleString()}, lon double, lat double, wide boolean, px double, py double"

    def corners(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[["cell", "lon", "lat", "wide", "px", "py"]]
        return rows if rows["wide"].iloc[0] else rows.iloc[hull(rows["px"].to_numpy(), rows["py"].to_numpy())]

    def farthest(rows: pd.DataFrame) -> pd.DataFrame:
        rows = corners(rows)
        lon, lat = np.radians(rows["lon"].to_numpy()), np.radians(rows["lat"].to_numpy())
        best = 0.0
        for at in range(len(lon)):  # one corner with all later ones
            h = np.sin((lat[at:] - lat[at]) / 2) ** 2 + np.cos(lat[at]) * np.cos(lat[at:]) * np.sin((lon[at:] - lon[at]) / 2) ** 2
            best = max(best, float(h.max()))
        return pd.DataFrame({"cell": rows["cell"].iloc[:1], "spread_m": [2 * S.EARTH_M * float(np.arcsin(np.sqrt(min(1.0, best))))]})

    few = flat.withColumn("_b", part).select("cell", "lon", "lat", "wide", "px", "py", "_b").groupBy("cell", "_b").applyInPandas(corners, kind)
    spread = few.groupBy("cell").applyInPandas(farthest, f"cell {items.schema['cell'].dataType.simpleString()}, spread_m double")
    return spread.withColumn("skip", F.col("spread_m") > limit_m)


def distance_decay(rows: DataFrame, edges: list[float], distance: str = "distance", score: str = "score") -> DataFrame:
    """(bin, n, mean, std, most, least) for every bin [edge, next edge); empty bins are zero; infinite distances are left out."""
    spark = rows.sparkSession
    bins = spark.createDataFrame([(i,) for i in range(len(edges) - 1)], "bin int")
    at = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        at = F.when((F.col(distance) >= edges[i]) & (F.col(distance) < edges[i + 1]), i).otherwise(at)
    stats = rows.withColumn("bin", at).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.max(score).alias("most"), F.min(score).alias("least"))
    return bins.join(F.broadcast(stats), "bin", "left").select("bin", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "mean", "std", "most", "least")])


def best_run(runs: DataFrame, metric: Column, key: str) -> DataFrame:
    """One row: the run of the largest metric over -1; runs without it are passed over; ties to the smaller key."""
    scored = runs.select(key, metric.cast("double").alias("score")).where("score > -1")
    return scored.agg(F.min(F.struct((-F.col("score")).alias("m"), key)).alias("b")).select(f"b.{key}", (-F.col("b.m")).alias("score"))


def crossing_summary(crossings: DataFrame) -> DataFrame:
    """(street, crossings) of the streets with the most crossings, all that tie."""
    return most_crossed(crossings.select(F.explode(F.array("line1", "line2")).alias("street")).groupBy("street").agg(F.count(F.lit(1)).alias("crossings")))


def most_crossed(per: DataFrame) -> DataFrame:
    """Of (street, crossings) the rows with the most, all that tie."""
    per = settled(per)  # both uses need all crossings
    return per.where(F.col("crossings") == per.agg(F.max("crossings").alias("m")).scalar())


def match_class(exact: Column, similarity: Column, distance_m: Column, own: Column, found: Column) -> Column:
    """Nine classes of a street name against the nearest street's: missing ones, exact, similar, then distance bands."""
    return (
        F.when(own.isNull() & found.isNull(), "both_missing").when(own.isNull(), "own_missing").when(found.isNull(), "found_missing").when(exact, "exact").when(similarity >= 0.8, "similar")
        .when(distance_m <= 50, F.when(similarity >= 0.5, "near_partial").otherwise("near_different")).when(distance_m <= 200, F.when(similarity >= 0.3, "medium_partial").otherwise("medium_different")).otherwise(F.when(similarity >= 0.3, "far_partial").otherwise("far_different"))
    )


def length_stats(rows: DataFrame, length: str = "length") -> DataFrame:
    """One row (mean, std, least, most, n) of lengths, std of the population; a list of lengths counts as its sum."""
    n = F.col(length)
    if rows.schema[length].dataType.typeName() == "array":
        n = F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.agg(F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"), F.min(n).alias("least"), F.max(n).alias("most"), F.count(n).alias("n"))


def decay_correlation(rows: DataFrame, distance: str = "distance", score: str = "score") -> DataFrame:
    """One row: Pearson's correlation of distance and score; infinite distances are left out, and 0 stands for undefined."""
    r = rows.where(~F.col(distance).isin(float("inf"), float("-inf"))).agg(F.corr(distance, score).alias("r"))
    return r.select(F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0)).alias("r"))
