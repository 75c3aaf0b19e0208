"""Self-avoiding walks by nine ways of stepping, and orders in which to visit the image nodes of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import doubled, node_edge_similarity, path_quality, simple_paths
from .rounds import settled

STRATEGIES = 9


def _count(items: Column, x: Column) -> Column:
    return F.size(F.filter(items, lambda y: y == x))


def step_score(strategy: Column, u: Column, times: Column, equal: Column, used: Column, first_of_type: Column, nearer_half: Column) -> Column:
    """How good a neighbour is under a way of stepping, 0 to 8; null rules it out.

    ``u``: a seeded number in (0, 1); ``times``: how often its name is in the walk; ``equal``: whether the last name is its
    own; ``used``: how often earlier paths have it.
    """
    new = times == 0
    weight = F.greatest(1.0 + F.when(new, 5.0).otherwise(0.0) - 5.0 * times - F.when(equal, 8.0).otherwise(0.0), F.lit(0.1))
    return (
        F.when(strategy == 0, F.when(first_of_type, F.when(new, 5.0).otherwise(1.0)))  # one candidate an edge type, new names first
        .when(strategy == 1, F.log(u) / weight)  # weighted random
        .when(strategy == 2, F.when(nearer_half, u))  # random among the half nearest the target
        .when(strategy == 3, -used.cast("double"))  # least used before
        .when(strategy == 4, u)  # random
        .when(strategy == 5, -used - F.when(equal, 1e6).otherwise(0.0))  # least used with another name
        .when(strategy == 6, 1.0 - 8.0 * times)  # repeats are dear
        .when(strategy == 7, F.when(equal, 0.1).otherwise(1.0))
        .otherwise(F.when(new, 15.0).when(times == 1, 5.0).otherwise(0.1))
    )


def strategy_walks(starts: DataFrame, edges: DataFrame, nodes: DataFrame, attempts: int = 3, steps: int = 8, min_hops: int = 2, similar: float = 0.7, seed: int = 0) -> DataFrame:
    """(walk, source, target, attempt, path, names, distance): the accepted paths of up to ``attempts`` walks of each start.

    ``starts``: (walk, source, target), ``nodes``: (node, name, lon, lat). The way of stepping is (attempt + paths so far +
    a hash of the walk) mod 9; draws are seeded hashes, so a lost task gives the same walk. A walk ends at its target or
    where no neighbour is left. It is accepted if it has reached the target in at least ``min_hops`` steps, its names pass
    :func:`path_quality`, and it is at most ``similar`` to each path accepted before. Of parallel edges the lightest counts.
    Nodes without a record have a null name, which equals none, and are never nearer.
    """
    flat = edges.where("id1 <> id2").groupBy(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).agg(F.min(F.struct(F.col("distance").alias("w"), F.col("type").alias("t"))).alias("e"))
    places = nodes.groupBy(F.col("node").alias("dst")).agg(F.min(F.struct("name", "lon", "lat")).alias("at"))
    step = settled(doubled(flat.select("id1", "id2", "e")).join(places, "dst", "left"))
    goal = places.select(F.col("dst").alias("target"), F.col("at").alias("goal"))
    begin = places.select(F.col("dst").alias("source"), F.array("at.name").alias("first"))
    none = F.array().cast("array<struct<attempt:int,path:array<bigint>,names:array<string>,distance:double>>")
    walks = starts.select("walk", F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target")).join(goal, "target", "left").join(begin, "source", "left")
    walks = settled(walks.withColumn("kept", none).withColumn("first", F.coalesce("first", F.array(F.lit(None).cast("string")))))
    for a in range(attempts):
        mode = F.pmod(a + F.size("kept") + F.pmod(F.xxhash64("walk", F.lit(seed)), F.lit(STRATEGIES)), F.lit(STRATEGIES))
        live = walks.select("*", mode.alias("mode"), F.array("source").alias("path"), F.col("first").alias("names"), F.lit(0.0).alias("d"))
        for k in range(steps):
            options = live.where(F.element_at("path", -1) != F.col("target")).join(step, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
            name, h = F.col("at.name"), F.xxhash64("walk", "dst", F.lit(a), F.lit(k), F.lit(seed))
            far = F.pow(F.col("at.lon") - F.col("goal.lon"), 2) + F.pow(F.col("at.lat") - F.col("goal.lat"), 2)
            options = options.select("walk", "mode", "dst", "e", name.alias("name"), h.alias("h"), far.alias("far"), _count(F.col("names"), name).alias("times"), F.coalesce(F.element_at("names", -1) == name, F.lit(False)).alias("equal"), _count(F.flatten(F.transform("kept", lambda p: p.path)), F.col("dst")).alias("used"))
            w = Window.partitionBy("walk")
            options = options.withColumn("r_far", F.row_number().over(w.orderBy(F.col("far").asc_nulls_last(), "dst"))).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r_type", F.row_number().over(Window.partitionBy("walk", "e.t").orderBy("h", "dst")))
            u = (F.pmod("h", F.lit(1 << 31)) + 0.5) / float(1 << 31)
            score = step_score(F.col("mode"), u, F.col("times"), F.col("equal"), F.col("used"), F.col("r_type") == 1, 2 * F.col("r_far") <= F.col("n") + 1)
            pick = options.withColumn("score", score).where("score is not null").groupBy("walk").agg(F.max(F.struct("score", "h", "dst", "name", F.col("e.w").alias("w"))).alias("p"))
            moved = F.col("p").isNotNull()
            live = live.join(pick, "walk", "left").select(
                *walks.columns, "mode", F.when(moved, F.concat("path", F.array("p.dst"))).otherwise(F.col("path")).alias("path"),
                F.when(moved, F.concat("names", F.array("p.name"))).otherwise(F.col("names")).alias("names"), (F.col("d") + F.coalesce("p.w", F.lit(0.0))).alias("d"),
            )
            live = settled(live)
        made = F.struct(F.lit(a).alias("attempt"), "path", "names", F.col("d").alias("distance"))
        good = (F.element_at("path", -1) == F.col("target")) & (F.size("path") > min_hops) & F.coalesce(path_quality(F.col("names")), F.lit(False))
        good = good & F.forall("kept", lambda p: node_edge_similarity(F.col("path"), p.path) <= similar)
        walks = live.withColumn("kept", F.when(good, F.concat("kept", F.array(made))).otherwise(F.col("kept"))).select(walks.columns)
    return walks.select("walk", "source", "target", F.explode("kept").alias("k")).select("walk", "source", "target", "k.*")


def visit_order(hops: DataFrame, images: DataFrame, k: int = 4) -> DataFrame:
    """(graph, stops, total): of all orders of min(k, images) image nodes of each graph, the one with the fewest hops in all, ties to the smaller.

    ``hops``: (graph, a, b, hops) of ordered pairs; ``images``: (graph, node). Where no order is linked, the first k nodes
    by number, with a null total. Of partial orders over the same nodes with the same end only the best goes on.
    """
    legs = settled(hops.where("a <> b").groupBy("graph", "a", "b").agg(F.min("hops").alias("hops")))
    nodes = settled(images.select("graph", "node").distinct())
    count = nodes.groupBy("graph").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n"))
    best = nodes.select("graph", F.array("node").alias("stops"), F.lit(0).cast("long").alias("total"))
    done = best
    for _ in range(k - 1):
        grown = best.join(legs.withColumnRenamed("graph", "g"), (F.col("graph") == F.col("g")) & (F.element_at("stops", -1) == F.col("a"))).where(~F.array_contains("stops", F.col("b")))
        grown = grown.select("graph", F.concat("stops", F.array("b")).alias("stops"), (F.col("total") + F.col("hops")).alias("total"), F.col("b").alias("end"))
        best = settled(grown.groupBy("graph", "end", F.array_sort("stops").alias("set")).agg(F.min(F.struct("total", "stops")).alias("m")).select("graph", "m.stops", "m.total"))
        done = done.unionByName(best)
    chosen = done.join(count, "graph").where(F.size("stops") == F.col("n")).groupBy("graph").agg(F.min(F.struct("total", "stops")).alias("m"))
    place = F.row_number().over(Window.partitionBy("graph").orderBy("node"))
    first = nodes.withColumn("r", place).where(F.col("r") <= k).groupBy("graph").agg(F.array_sort(F.collect_list("node")).alias("first"))
    return first.join(chosen, "graph", "left").select("graph", F.coalesce("m.stops", "first").alias("stops"), F.col("m.total").alias("total"))


def paths_through(orders: DataFrame, edges: DataFrame, per_pair: int = 3, cutoff: int = 10) -> DataFrame:
    """(graph, source, target, path, rank): up to ``per_pair`` simple paths between neighbouring stops of each graph's order."""
    at = F.sequence(F.lit(1), F.size("stops") - 1)
    pair = lambda i: F.struct(F.get("stops", i - 1).alias("source"), F.get("stops", i).alias("target"))
    legs = settled(orders.where(F.size("stops") > 1).select("graph", F.explode(F.transform(at, pair)).alias("leg")).select("graph", "leg.*"))
    return legs.join(simple_paths(legs.select("source", "target").distinct(), edges, cutoff, per_pair), ["source", "target"]).select("graph", "source", "target", "path", "rank")


def path_lengths(paths: DataFrame) -> DataFrame:
    """(graph, n_paths, mean, least, most, median) of the numbers of edges."""
    n = F.size("path") - 1
    return paths.groupBy("graph").agg(F.count(F.lit(1)).alias("n_paths"), F.avg(n).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"), F.median(n).alias("median"))


def cap_graph(nodes: DataFrame, edges: DataFrame, centres: DataFrame, max_nodes: int, seed: int | None = None) -> DataFrame:
    """(graph, node, hop) of at most ``max_nodes`` nodes of each graph: nearest to the centre first, then those out of reach (null hop).

    ``nodes``: (graph, node), ``edges``: (graph, id1, id2), ``centres``: (graph, node). A graph without a centre of its own
    starts at its node with most edges, ties to the smaller. Equally near nodes come in the order of a seeded hash, or of
    their numbers without a seed. The search ends for a graph that has enough, so there are at most ``max_nodes`` rounds.
    """
    nodes = settled(nodes.select("graph", "node").distinct())
    step = doubled(edges.select("graph", "id1", "id2")).where("src <> dst").select("graph", "src", "dst").distinct()
    step = settled(step.join(nodes.select("graph", F.col("node").alias("dst")), ["graph", "dst"], "left_semi"))
    degree = step.groupBy("graph", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    given = centres.select("graph", "node", F.lit(True).alias("given"))
    ranked = nodes.join(degree, ["graph", "node"], "left").join(given, ["graph", "node"], "left")
    first = ranked.groupBy("graph").agg(F.min_by("node", F.struct(F.col("given").isNull(), -F.coalesce("d", F.lit(0)), "node")).alias("node"))
    reached = frontier = settled(first.withColumn("hop", F.lit(0)))
    for hop in range(1, max_nodes):
        short = reached.groupBy("graph").count().where(F.col("count") < max_nodes).select("graph")
        new = frontier.join(short, "graph", "left_semi").withColumnRenamed("node", "src").join(step, ["graph", "src"]).select("graph", F.col("dst").alias("node")).distinct()
        frontier = settled(new.join(reached, ["graph", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    order = F.col("node") if seed is None else F.xxhash64("graph", "node", F.lit(seed))
    place = F.row_number().over(Window.partitionBy("graph").orderBy(F.col("hop").asc_nulls_last(), order, "node"))
    return nodes.join(reached, ["graph", "node"], "left").withColumn("_r", place).where(F.col("_r") <= max_nodes).select("graph", "node", "hop")
