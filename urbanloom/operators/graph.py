"""Graph operators on node and edge tables: bounded rounds of frontier joins; from the second round on each is written and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rounds import settled


def doubled(edges: DataFrame, a: str = "id1", b: str = "id2") -> DataFrame:
    """(src, dst, type, distance) in both directions; duplicates stay and a self-loop appears twice."""
    cols = [c for c in edges.columns if c not in (a, b)]
    forward = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), *cols)
    return forward.unionByName(edges.select(F.col(b).alias("src"), F.col(a).alias("dst"), *cols))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, neighbours sorted, degree)."""
    return doubled(edges).groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbours"), F.count(F.lit(1)).alias("degree"))


def hops_from(seeds: DataFrame, edges: DataFrame, max_hops: int, max_nodes: int | None = None) -> DataFrame:
    """(seed, node, hop): the fewest steps from each seed to the nodes within ``max_hops``.

    ``seeds``: (seed, node). Every round joins the frontier with the undirected, distinct edges and drops what was
    reached before. ``max_nodes``: seeds whose nodes exceed it give no rows.
    """
    step = doubled(edges.select("id1", "id2")).where("src <> dst").distinct()
    reached = seeds.select("seed", "node").distinct().withColumn("hop", F.lit(0))
    frontier = reached
    for hop in range(1, max_hops + 1):
        new = frontier.join(step, frontier.node == step.src).select("seed", F.col("dst").alias("node")).distinct()
        frontier = new.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop))
        if hop > 1:
            frontier = settled(frontier)
        reached = reached.unionByName(frontier)
    if max_nodes is not None:
        few = reached.groupBy("seed").count().where(F.col("count") <= max_nodes).select("seed")
        reached = reached.join(few, "seed", "left_semi")
    return reached


def induced_edges(nodes: DataFrame, edges: DataFrame, either: bool = False) -> DataFrame:
    """(seed, edge columns): edges with both ends (or either end) among each seed's nodes, once each."""
    of = lambda c: nodes.select("seed", F.col("node").alias(c))
    if either:
        touched = edges.join(of("id1"), "id1").unionByName(edges.join(of("id2"), "id2"))
        return touched.distinct()
    return edges.join(of("id1"), "id1").join(of("id2"), ["seed", "id2"]).select("seed", *edges.columns)


def lightest_edges(edges: DataFrame, keys: list[str], weight: str = "distance") -> DataFrame:
    """Of parallel edges, whichever way round, the lighter one (ties: smaller type); self-loops go."""
    rows = edges.where("id1 <> id2").withColumn("a", F.least("id1", "id2")).withColumn("b", F.greatest("id1", "id2"))
    best = rows.groupBy(*keys, "a", "b").agg(F.min(F.struct(F.col(weight).alias("w"), "type")).alias("e"))
    return best.select(*keys, F.col("a").alias("id1"), F.col("b").alias("id2"), F.col("e.type").alias("type"), F.col("e.w").alias(weight))


def smallest_paths(sources: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """(source, node, path): one unweighted shortest path from each source to every node within ``max_hops``, the smallest by its node ids.

    Each round keeps one path for each (source, node): the smallest, which extends to the smallest longer ones.
    """
    step = doubled(edges.select("id1", "id2")).where("src <> dst").distinct()
    reached = sources.select("source").distinct().select("source", F.col("source").alias("node"), F.array("source").alias("path"))
    frontier = reached
    for _ in range(max_hops):
        new = frontier.join(step, frontier.node == step.src).select("source", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        new = new.groupBy("source", "node").agg(F.min("path").alias("path"))
        frontier = settled(new.join(reached.select("source", "node"), ["source", "node"], "left_anti"))
        reached = reached.unionByName(frontier)
    return reached


def shortest_paths(pairs: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """(source, target, path, hops): the path of :func:`smallest_paths` of each pair; pairs out of reach are left out."""
    reached = smallest_paths(pairs, edges, max_hops)
    found = pairs.join(reached.withColumnRenamed("node", "target"), ["source", "target"])
    return found.select("source", "target", "path", (F.size("path") - 1).alias("hops"))


def _outlook(targets: DataFrame, step: DataFrame, radius: int) -> DataFrame:
    """(target, dst, hop): the fewest steps from each node within a target's ``radius`` to it; ``targets``: (target, radius), ``radius`` beside it the largest of them."""
    edge = targets.select("target", F.col("target").alias("dst"), "radius").withColumn("hop", F.lit(0))
    reached, before = edge.drop("radius"), None
    for hop in range(1, radius + 1):
        new = edge.where(F.col("radius") >= hop).select("target", "radius", F.col("dst").alias("src")).join(step, "src").select("target", "dst", "radius").distinct()
        near = edge if before is None else edge.unionByName(before)  # a neighbour's hop differs by one at most
        before, edge = edge, settled(new.join(near.select("target", "dst"), ["target", "dst"], "left_anti").withColumn("hop", F.lit(hop)))
        reached = reached.unionByName(edge.drop("radius"))
    return reached


def goal_directed_paths(
    pairs: DataFrame, edges: DataFrame, longest: int, slack: int | None = None, most: int | None = None, least: float | None = None, searched: int | None = None, per_length: int | None = None, radius: int | None = None
) -> DataFrame:
    """(source, target, paths): simple paths of each pair with at most ``longest`` edges, and at most ``slack`` more than its shortest.

    Paths are met in the order of their length and then of their node ids. A path is taken if it is diverse from all taken
    before (``least``, see :func:`is_diverse`; null: always); a pair is done once it has ``most``, or has met ``searched``
    paths; of each length at most ``per_length`` are met. All three limits are the search's own definition and optional.
    Pairs without a path give no row, as do pairs of one node.

    Every round makes all paths one edge longer, so it finds exactly those of its length, and a pair that is done leaves.
    From the middle of a pair's limit on, paths that cannot reach the target in the edges that are left are dropped. The hop
    distances for that are measured then, back from the targets as far as is left, so with a known shortest path no farther than
    half of what it allows; ``radius`` bounds them, and paths are dropped later. Rounds end when no path is open.
    """
    step = settled(doubled(edges.select("id1", "id2")).where("src <> dst").distinct())
    pairs = pairs.select("source", "target").where("source <> target").distinct()
    radius = longest if radius is None else radius
    back = None
    none = F.array().cast(f"array<array<{step.schema['dst'].dataType.simpleString()}>>")
    state = pairs.select("source", "target", F.lit(None).cast("int").alias("first"), F.lit(0).alias("met"), none.alias("paths"), F.lit(longest).alias("limit"), F.lit(False).alias("done"), F.lit(False).alias("due"))
    live = pairs.select("source", "target", F.array("source").alias("path"), F.lit(longest).alias("limit"))
    for k in range(1, longest + 1):
        grown = live.join(step, F.element_at("path", -1) == step.src).where(~F.array_contains("path", F.col("dst"))).select("source", "target", "limit", F.concat("path", F.array("dst")).alias("path"), "dst")
        due = (F.col("limit") <= 2 * k) & (F.col("limit") <= k + radius)
        fresh = state.where(~F.col("done") & ~F.col("due") & due).groupBy("target").agg((F.max("limit") - k).alias("radius"))
        far = fresh.agg(F.max("radius")).first()[0]
        if far is not None:
            told = _outlook(settled(fresh), step, far)
            back = told if back is None else settled(back.unionByName(told).groupBy("target", "dst").agg(F.min("hop").alias("hop")))
        if back is not None:
            grown = grown.join(back.where(F.col("hop") <= longest - k), ["target", "dst"], "left").where(~due | (F.col("hop") <= F.col("limit") - k))
        grown = settled(grown.select("source", "target", "path", (F.col("dst") == F.col("target")).alias("hit")))
        cap = min((x for x in (per_length, searched) if x is not None), default=most if least is None else None)
        hits = grown.where("hit")
        if cap is not None:
            hits = hits.withColumn("_r", F.row_number().over(Window.partitionBy("source", "target").orderBy("path"))).where(F.col("_r") <= cap)
        new = hits.groupBy("source", "target").agg(F.array_sort(F.collect_list("path")).alias("new"))
        joined = state.join(new, ["source", "target"], "left").withColumn("new", F.coalesce("new", none))
        if searched is not None:
            joined = joined.withColumn("new", F.slice("new", F.lit(1), F.greatest(F.lit(searched) - F.col("met"), F.lit(0))))
        full = lambda kept: F.lit(False) if most is None else F.size(kept) >= most
        fits = lambda kept, p: F.lit(True) if least is None else is_diverse(p, kept, least)
        taken = F.aggregate("new", F.col("paths"), lambda kept, p: F.when(~full(kept) & fits(kept, p), F.concat(kept, F.array(p))).otherwise(kept))
        state = joined.select("source", "target", F.coalesce("first", F.when(F.size("new") > 0, F.lit(k))).alias("first"), (F.col("met") + F.size("new")).alias("met"), taken.alias("paths"), (F.col("due") | due).alias("due"))
        limit = F.least(F.lit(longest), F.coalesce(F.col("first") + slack, F.lit(longest))) if slack is not None else F.lit(longest)
        done = full(F.col("paths")) | (F.lit(False) if searched is None else F.col("met") >= searched) | (limit <= k)
        state = settled(state.withColumns({"limit": limit, "done": done}))
        live = grown.where("not hit").join(state.where(~F.col("done")).select("source", "target", "limit"), ["source", "target"]).select("source", "target", "path", "limit")
        if k == longest or live.isEmpty():
            break
    return state.where(F.size("paths") > 0).select("source", "target", "paths")


def simple_paths(pairs: DataFrame, edges: DataFrame, cutoff: int, max_paths: int | None = None) -> DataFrame:
    """(source, target, path, rank): paths without repeated nodes of at most ``cutoff`` edges, shorter and smaller first."""
    found = goal_directed_paths(pairs, edges, cutoff, most=max_paths)
    return found.select("source", "target", F.posexplode("paths").alias("rank", "path")).select("source", "target", "path", (F.col("rank") + 1).alias("rank"))


def find_diverse_paths(pairs: DataFrame, edges: DataFrame, max_paths: int = 5, least: float = 0.3, searched: int = 50, slack: int = 5, longest: int = 12) -> DataFrame:
    """(source, target, paths): up to ``max_paths`` paths, each at most ``1 - least`` similar to those before, among the first ``searched`` of at most min(shortest + slack, longest) edges."""
    return goal_directed_paths(pairs, edges, longest, slack, max_paths, least, searched=searched)


def find_paths_of_all_lengths(pairs: DataFrame, edges: DataFrame, max_paths: int = 5, per_length: int = 3, least: float = 0.2, slack: int = 8, longest: int = 15) -> DataFrame:
    """As :func:`find_diverse_paths`, from the first ``per_length`` paths of each length to min(shortest + slack, longest)."""
    return goal_directed_paths(pairs, edges, longest, slack, max_paths, least, per_length=per_length)


def paths_between(paths: DataFrame, nodes: DataFrame | None = None, category: str | None = None) -> DataFrame:
    """(source, target, path_id, path, length, category_nodes) of chosen (source, target, paths), shorter first, numbered from 0.

    With a category only paths that touch one of its ``nodes`` (node, category) stay, with those nodes in path order, so fewer
    may remain than were chosen; without one ``category_nodes`` is null.
    """
    rows = paths.select("source", "target", F.posexplode("paths").alias("at", "path"))
    if category is None:
        rows = rows.withColumn("category_nodes", F.lit(None).cast(rows.schema["path"].dataType))
    else:
        steps = rows.select("source", "target", "at", F.posexplode("path").alias("pos", "node"))
        met = steps.join(nodes.where(F.col("category") == category).select("node").distinct(), "node").groupBy("source", "target", "at")
        found = met.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x.node).alias("category_nodes"))
        rows = rows.join(found, ["source", "target", "at"])
    place = F.row_number().over(Window.partitionBy("source", "target").orderBy(F.size("path"), "at")) - 1
    return rows.select("source", "target", place.alias("path_id"), "path", (F.size("path") - 1).alias("length"), "category_nodes")


def hop_distances(pairs: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """The pairs (source, target) with ``hops``, the fewest steps between them; infinity where there are none within ``max_hops``."""
    reached = hops_from(pairs.select(F.col("source").alias("seed"), F.col("source").alias("node")), edges, max_hops)
    found = reached.select(F.col("seed").alias("source"), F.col("node").alias("target"), F.col("hop").cast("double").alias("hops"))
    return pairs.join(found, ["source", "target"], "left").withColumn("hops", F.coalesce("hops", F.lit(float("inf"))))


def path_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the node sets."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def is_diverse(path: Column, others: Column, least: float = 0.3) -> Column:
    """Whether a path is at most ``1 - least`` similar to every one of an array of paths."""
    return F.forall(others, lambda o: path_similarity(path, o) <= 1 - least)


def node_edge_similarity(a: Column, b: Column) -> Column:
    """0.6 of the nodes' and 0.4 of the edges' Jaccard similarity; edges are neighbouring nodes, either way round."""
    pairs = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda k: F.struct(F.least(F.get(p, k - 1), F.get(p, k)).alias("x"), F.greatest(F.get(p, k - 1), F.get(p, k)).alias("y")))
    return 0.6 * path_similarity(a, b) + 0.4 * path_similarity(pairs(a), pairs(b))


def diverse_paths(paths: DataFrame, max_paths: int = 5, least: float = 0.3) -> DataFrame:
    """(source, target, paths): greedily, in rank order, those at most ``1 - least`` similar to all taken before; ``paths`` ranked and bounded per pair."""
    ordered = paths.groupBy("source", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda r: r.path).alias("all"))
    none = F.slice("all", 1, 0)
    take = lambda kept, p: F.when((F.size(kept) < max_paths) & is_diverse(p, kept, least), F.concat(kept, F.array(p))).otherwise(kept)
    return ordered.select("source", "target", F.aggregate("all", none, take).alias("paths"))


def length_diverse_paths(paths: DataFrame, max_paths: int = 5, per_length: int = 3, least: float = 0.2) -> DataFrame:
    """As :func:`diverse_paths`, from at most ``per_length`` paths of each length."""
    few = paths.withColumn("_k", F.row_number().over(Window.partitionBy("source", "target", F.size("path")).orderBy("path"))).where(F.col("_k") <= per_length).drop("_k")
    return diverse_paths(few, max_paths, least)


def path_set_diversity(paths: DataFrame, keys: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """(keys, n_paths, diversity, min_len, max_len): one less the mean similarity of all pairs; a single path has 1."""
    a, b = paths.alias("a"), paths.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    pairs = a.join(b, cond & (F.col("a.rank") < F.col("b.rank"))).groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(F.avg(path_similarity(F.col("a.path"), F.col("b.path"))).alias("s"))
    base = paths.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_paths"), F.min(F.size("path")).alias("min_len"), F.max(F.size("path")).alias("max_len"))
    return base.join(pairs, list(keys), "left").select(*keys, "n_paths", F.coalesce(1 - F.col("s"), F.lit(1.0)).alias("diversity"), "min_len", "max_len")


def random_walks(starts: DataFrame, edges: DataFrame, steps: int, seed: int = 0) -> DataFrame:
    """(walk, target, path): self-avoiding walks; each step takes the neighbour of the smallest seeded hash, and a walk ends at its target or when stuck."""
    step = doubled(edges.select("id1", "id2")).where("src <> dst").distinct()
    walks = starts.select("walk", "target", F.array("source").alias("path"))
    for k in range(steps):
        live = walks.where(F.element_at("path", -1) != F.col("target"))
        options = live.join(step, F.element_at("path", -1) == step.src).where(~F.array_contains("path", F.col("dst")))
        pick = options.groupBy("walk").agg(F.min(F.struct(F.xxhash64("walk", F.lit(k), F.lit(seed), "dst").alias("h"), "dst")).alias("p")).select("walk", "p.dst")
        walks = settled(walks.join(pick, "walk", "left").select("walk", "target", F.when(F.col("dst").isNotNull(), F.concat("path", F.array("dst"))).otherwise(F.col("path")).alias("path")))
    return walks


def unique_names(names: Column) -> Column:
    return F.size(F.array_distinct(names)) == F.size(names)


def no_equal_neighbours(names: Column) -> Column:
    return F.forall(F.sequence(F.lit(0), F.size(names) - 2), lambda k: F.get(names, k) != F.get(names, k + 1)) | (F.size(names) < 2)


def no_there_and_back(names: Column) -> Column:
    """No name equals the one two places on, unless it looks like an id."""
    return F.when(F.size(names) < 3, True).otherwise(F.forall(F.sequence(F.lit(0), F.size(names) - 3), lambda k: (F.get(names, k) != F.get(names, k + 2)) | F.get(names, k).rlike("^(Node_)?[0-9]+$")))


def most_repeated(names: Column) -> Column:
    """How often the most frequent street name occurs; ``Node_*``, digits and intersections do not count."""
    real = F.filter(names, lambda n: ~(n.startswith("Node_") | n.rlike("^[0-9]+$") | n.contains("Intersection")))
    return F.coalesce(F.array_max(F.transform(F.array_distinct(real), lambda n: F.size(F.filter(real, lambda m: m == n)))), F.lit(0))


def path_quality(names: Column, repetitions: int = 1) -> Column:
    return unique_names(names) & no_equal_neighbours(names) & no_there_and_back(names) & (most_repeated(names) <= F.least(F.lit(repetitions), F.lit(2)))


def local_morans(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, node, moran): (n-1) z_i sum_j w_ij z_j / sum z^2 over directed edges (graph, src, dst, w), z by the sample deviation; undefined is 0."""
    of = values.groupBy("graph").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("_m"), F.nullif(F.stddev_samp("value"), F.lit(0.0)).alias("_s"))
    z = values.join(of, "graph").withColumn("z", F.coalesce((F.col("value") - F.col("_m")) / F.col("_s"), F.lit(0.0))).drop("_m", "_s")
    z = z.join(z.groupBy("graph").agg(F.sum(F.col("z") * F.col("z")).alias("zz")), "graph")
    lag = edges.join(z.select("graph", F.col("node").alias("dst"), F.col("z").alias("zj")), ["graph", "dst"]).groupBy("graph", F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("zj")).alias("lag"))
    moran = (F.col("n") - 1) * F.col("z") * F.coalesce("lag", F.lit(0.0)) / F.nullif(F.col("zz"), F.lit(0.0))
    return z.join(lag, ["graph", "node"], "left").select("graph", "node", F.coalesce(moran, F.lit(0.0)).alias("moran"))


def distance_weights(edges: DataFrame, key: str = "graph", distance: str = "distance") -> DataFrame:
    """The edges with ``weight``: (max - d) / (max - min + 1e-8) in each graph."""
    ends = edges.groupBy(key).agg(F.max(distance).alias("_hi"), F.min(distance).alias("_lo"))
    return edges.join(ends, key).withColumn("weight", (F.col("_hi") - F.col(distance)) / (F.col("_hi") - F.col("_lo") + 1e-8)).drop("_hi", "_lo")


def edge_lookup(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs (a, b) with the type and distance of their edge in either order, the first by (type, distance); ``unknown`` and null where there is none."""
    key = lambda x, y: F.struct(F.least(x, y), F.greatest(x, y))
    best = edges.groupBy(key("id1", "id2").alias("k")).agg(F.min(F.struct("type", "distance")).alias("e"))
    return pairs.withColumn("k", key("a", "b")).join(best, "k", "left").select("a", "b", F.coalesce("e.type", F.lit("unknown")).alias("type"), F.col("e.distance").alias("distance"))


def spread_sample(items: DataFrame, k: int = 3) -> DataFrame:
    """(cell, id, round) of up to k items spread over each cell: the first by id, then always the one farthest from those chosen (planar; ties to the smaller id).

    ``items``: (cell, id, lon, lat); at most k bounded rounds of one aggregate and one join each.
    """
    rest = items.select("cell", "id", "lon", "lat").withColumn("far", F.lit(float("inf")))
    out = None
    for r in range(k):
        rank = F.struct(F.col("far"), (-F.col("id")).alias("m"), "id", "lon", "lat")
        pick = rest.groupBy("cell").agg(F.max(rank).alias("p")).select("cell", "p.id", F.col("p.lon").alias("plon"), F.col("p.lat").alias("plat"))
        chosen = pick.select("cell", "id", F.lit(r + 1).alias("round"))
        out = chosen if out is None else out.unionByName(chosen)
        d = F.sqrt(F.pow(F.col("lon") - F.col("plon"), 2) + F.pow(F.col("lat") - F.col("plat"), 2))
        rest = rest.join(pick.withColumnRenamed("id", "pid"), "cell").where("id <> pid").select("cell", "id", "lon", "lat", F.least("far", d).alias("far"))
    return out
