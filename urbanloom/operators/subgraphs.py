"""Joins that build, extend and check subgraphs: tables of nodes and edges with a graph column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urbanloom.functions import spatial as S

from .graph import doubled, hops_from, induced_edges
from .rounds import settled


def node_lookup(nodes: DataFrame, known: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The nodes with their columns; values of the known table win over those that the nodes carry."""
    renamed = known.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    rest = [c for c in nodes.columns if c not in columns]
    return nodes.join(renamed, key, "left").select(*rest, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


#: Places in the cell of a place, on the average of all places, in the grid that a nearest search begins with; and the coarsest and finest of these.
PLACES_A_CELL, COARSE, FINE = 2, 18, 28
#: Items of one task of a nearest search, and pairs of nodes that one task of a radius search tests.
ITEMS_A_TASK, PAIRS_A_TASK = 250_000, 20_000_000


def _tasks(df: DataFrame, asked: float) -> int:
    return min(8192, max(int(asked), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _columns_for(places: DataFrame, key: str) -> int:
    """The power of two of grid columns at which a place has few others in its cell; it decides about the work, not about the result."""
    size = 360.0 / (1 << COARSE)
    held = places.groupBy(key, F.floor(F.col("_x") / size), F.floor(F.col("_y") / size)).agg(F.count(F.lit(1)).cast("double").alias("n"))
    crowd, level = held.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0, COARSE
    while crowd > 2 * PLACES_A_CELL and level < FINE:
        crowd, level = crowd / 4, level + 1
    return level


def nearest_join(items: DataFrame, places: DataFrame, key: str, item: str, place: str, finest: int | None = None) -> DataFrame:
    """(key, item, place, distance) of the place nearest to each item among those of its key, by great circle, ties to the smaller place.

    ``items``: (key, item, lon, lat); ``places``: (key, place, lon, lat). An item is compared with the places of its own and
    the eight neighbouring cells of a grid of 2^``finest`` columns around the globe, by default so many that few places share a
    cell. Places are filed under all nine, so an item moves once a round and is settled where it meets them. Whatever lies outside
    them is farther than the item's distance to the block's edge (a parallel, or the nearest point of a meridian), so a place within
    that distance is the nearest. Items without one go on to a grid of half as many columns, at last to one cell, so there are at most
    ``finest + 1`` rounds, and all ends once no item is left. Equal coordinates count once. Items or places
    without coordinates, and items of keys without places, give no row.
    """
    known = lambda df: df.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    there = settled(known(places).groupBy(key, "lon", "lat").agg(F.min(place).alias("_p")).select(key, "_p", F.col("lon").alias("_x"), F.col("lat").alias("_y")))
    finest = _columns_for(there, key) if finest is None else finest
    left = settled(known(items).where(F.col(key).isNotNull()).select(key, item, "lon", "lat"))
    n, found = left.count(), None
    for level in range(finest, -1, -1):
        columns, size = 1 << level, 360.0 / (1 << level)
        cell = lambda lon, lat: (F.pmod(F.floor((F.col(lon) + 180) / size), F.lit(columns)).alias("_i"), F.floor((F.col(lat) + 90) / size).alias("_j"))  # noqa: E731, B023
        steps = range(-1, 2) if columns > 2 else range(columns)
        around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in steps for j in (-1, 0, 1)])
        filed = there.select("*", *cell("_x", "_y")).withColumn("_d", F.explode(around)).withColumns({"_i": F.pmod(F.col("_i") + F.col("_d.i"), F.lit(columns)), "_j": F.col("_j") + F.col("_d.j")}).drop("_d")
        at = (_tasks(left, n / ITEMS_A_TASK), key, "_i", "_j")  # a stated number, as the rows' sizes don't tell how many pairs they make
        met = left.select("*", *cell("lon", "lat")).repartition(*at).join(filed.repartition(*at), [key, "_i", "_j"], "left")
        d = F.when(F.col("_p").isNotNull(), F.struct(S.haversine_m(F.col("lon"), F.col("lat"), F.col("_x"), F.col("_y")).alias("d"), F.col("_p").alias("p")))
        best = met.groupBy(key, "_i", "_j", item, "lon", "lat").agg(F.min(d).alias("b")).drop("_i", "_j")
        if columns > 2:
            margin = lambda at, origin: F.least(F.pmod(F.col(at) + origin, F.lit(size)), size - F.pmod(F.col(at) + origin, F.lit(size))) + size  # noqa: E731, B023
            east = F.lit(S.EARTH_M) * F.asin(F.cos(F.radians("lat")) * F.sin(F.radians(F.least(margin("lon", 180), F.lit(90.0)))))
            proven = F.col("b.d") <= F.least(F.lit(S.EARTH_M) * F.radians(margin("lat", 90)), east) * (1 - 1e-9)
        else:
            proven = F.lit(True)
        told = settled(best.withColumn("_ok", F.coalesce(proven & F.col("b").isNotNull(), F.lit(False))))
        sure = told.where("_ok").select(key, item, F.col("b.p").alias(place), F.col("b.d").alias("distance"))
        found = sure if found is None else found.unionByName(sure)
        left = told.where("not _ok").select(key, item, "lon", "lat")
        if level == finest:  # few are left: of these the ones whose key has no place go
            left = left.join(there.select(key).distinct(), key, "left_semi")
        n = left.count()
        if columns <= 2 or not n:
            break
    return found


def attach_nearest(images: DataFrame, nodes: DataFrame, graph: str = "graph") -> DataFrame:
    """(graph, image, node, distance, type): one edge from each image that its graph lacks to the graph's nearest node, ties to the smaller.

    ``images``: (graph, image, lon, lat); ``nodes``: (graph, id, lon, lat). See :func:`nearest_join`.
    """
    new = images.join(nodes.select(graph, F.col("id").alias("image")), [graph, "image"], "left_anti")
    near = nearest_join(new, nodes.select(graph, F.col("id").alias("node"), "lon", "lat"), graph, "image", "node")
    return near.select(graph, "image", "node", "distance", F.lit("mapillary_connection").alias("type"))


def attach_image_nodes(images: DataFrame, nodes: DataFrame, graph: str = "graph") -> DataFrame:
    """The nodes with each image as a node of its graph, once."""
    new = images.select(graph, F.col("image").alias("id"), "lon", "lat").distinct().join(nodes.select(graph, "id"), [graph, "id"], "left_anti")
    return nodes.unionByName(new, allowMissingColumns=True)


def expand_graphs(centres: DataFrame, nodes: DataFrame, edges: DataFrame, all_edges: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Each graph's nodes and edges with those up to ``hops`` steps around its centre from the whole edge table.

    ``centres``: (graph, node); ``nodes``: (graph, id); ``edges``: (graph, id1, id2, type). Edges are added among the centre and the
    nodes that the expansion reached; an edge that a graph has already wins over an added one.
    """
    reached = hops_from(centres.select(F.col("graph").alias("seed"), "node"), all_edges, hops)
    more = induced_edges(reached.select("seed", "node"), all_edges.select("id1", "id2", "type").distinct()).withColumnRenamed("seed", "graph")
    out_nodes = nodes.select("graph", "id").unionByName(reached.select(F.col("seed").alias("graph"), F.col("node").alias("id"))).distinct()
    both = edges.select("graph", "id1", "id2", "type", F.lit(0).alias("_o")).unionByName(more.select("graph", "id1", "id2", "type", F.lit(1).alias("_o")))
    first = both.groupBy("graph", "id1", "id2").agg(F.min(F.struct("_o", "type")).alias("e")).select("graph", "id1", "id2", F.col("e.type").alias("type"))
    return out_nodes, first


def path_neighbourhood(path_nodes: DataFrame, edges: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """(graph, id) within ``hops`` of each graph's path nodes over the graph's own edges, and the edges among them.

    ``path_nodes``: (graph, node); ``edges``: (graph, id1, id2).
    """
    step = doubled(edges.select("graph", "id1", "id2")).where("src <> dst").select("graph", F.col("src").alias("id"), "dst").distinct()
    reached = path_nodes.select("graph", F.col("node").alias("id")).distinct()
    for _ in range(hops):
        new = reached.join(step, ["graph", "id"]).select("graph", F.col("dst").alias("id"))
        reached = reached.unionByName(new).distinct()
    kept = edges.join(reached.select("graph", F.col("id").alias("id1")), ["graph", "id1"], "left_semi").join(reached.select("graph", F.col("id").alias("id2")), ["graph", "id2"], "left_semi")
    return reached, kept


def add_missing_nodes(path_nodes: DataFrame, nodes: DataFrame, edges: DataFrame, most: int, hops: int = 2) -> DataFrame:
    """(graph, id, hop) that graphs lack of their paths and of what is near these, path nodes first, up to ``most`` nodes in all."""
    lacking = path_nodes.select("graph", F.col("node")).distinct().join(nodes.select("graph", F.col("id").alias("node")), ["graph", "node"], "left_anti")
    near = hops_from(lacking.select(F.col("graph").alias("seed"), "node"), edges, hops).select(F.col("seed").alias("graph"), F.col("node").alias("id"), "hop")
    near = near.groupBy("graph", "id").agg(F.min("hop").alias("hop")).join(nodes.select("graph", "id"), ["graph", "id"], "left_anti")
    held = nodes.groupBy("graph").agg(F.countDistinct("id").alias("_n"))
    place = F.row_number().over(Window.partitionBy("graph").orderBy("hop", "id"))
    return near.withColumn("_r", place).join(held, "graph", "left").where(F.col("_r") <= most - F.coalesce("_n", F.lit(0))).select("graph", "id", "hop")


def valid_members(cells: DataFrame, known: DataFrame) -> DataFrame:
    """(cell, members): member lists restricted to known ids, sorted; empty cells go. ``cells``: (cell, id); ``known``: (id)."""
    return cells.join(known.select("id").distinct(), "id", "left_semi").groupBy("cell").agg(F.array_sort(F.collect_list("id")).alias("members"))


def verify_mapping(crossings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, problem): crossing ids that no node has, and mapped nodes whose type tells of no crossing."""
    missing = crossings.select("id").distinct().join(nodes.select("id"), "id", "left_anti").withColumn("problem", F.lit("missing"))
    wrong = nodes.join(crossings.select("id").distinct(), "id", "left_semi").where(~F.coalesce(F.lower("type"), F.lit("")).contains("crossing")).select("id", F.lit("not_a_crossing").alias("problem"))
    return missing.unionByName(wrong)


def valid_references(rows: DataFrame, graphs: DataFrame, name: str = "graphs") -> DataFrame:
    """Rows whose every referenced graph exists and has nodes. ``graphs``: (graph, nodes). Rows without references stay."""
    used = rows.select("key", F.explode(name).alias("graph"))
    bad = used.join(graphs.where("nodes > 0").select("graph"), "graph", "left_anti").select("key").distinct()
    return rows.join(bad, "key", "left_anti")


def essential_nodes(nodes: DataFrame, categories: DataFrame) -> DataFrame:
    """(graph, before, after): how many nodes each graph has, and has left with only its categorised nodes."""
    kept = nodes.join(categories.select("graph", "id").distinct(), ["graph", "id"], "left_semi").groupBy("graph").agg(F.count(F.lit(1)).alias("after"))
    return nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("before")).join(kept, "graph", "left").select("graph", "before", F.coalesce("after", F.lit(0)).cast("long").alias("after"))


def _split(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The distinct rows (key, lon, lat) with known coordinates, of keys with one place and of keys with several."""
    rows = df.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(key, "lon", "lat").distinct()
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    return counted.where("_n = 1").drop("_n"), counted.where("_n > 1").drop("_n")


def adjacent_nodes(centres: DataFrame, nodes: DataFrame, edges: DataFrame, radius_m: float = 200.0, size: float = 0.002) -> DataFrame:
    """(centre, id, distance): named nodes that share an edge with a centre or lie within the radius of it, with the least distance.

    ``centres``: (centre, lon, lat); ``nodes``: (id, name, lon, lat). Near ones meet on grid cells of ``size`` degrees of latitude,
    and as many of longitude as the radius needs there. A node stands in one cell, so its pairs are final where they are found: they
    are not grouped, and only nodes and centres move. Only pairs of an id with several places, and linked ones, are.
    """
    reach = F.lit(radius_m / 111_000.0)
    wide = reach / F.greatest(F.cos(F.radians(F.col("lat"))), F.lit(0.01))
    cells = lambda v, r: F.explode(F.sequence(F.floor((v - r) / size), F.floor((v + r) / size)))
    spread = lambda df: df.select("centre", F.col("lon").alias("_x"), F.col("lat").alias("_y"), cells(F.col("lon"), wide).alias("cx"), "lat").select("centre", "_x", "_y", "cx", cells(F.col("lat"), reach).alias("cy"))
    placed = lambda df: df.select("id", "lon", "lat", F.floor(F.col("lon") / size).alias("cx"), F.floor(F.col("lat") / size).alias("cy"))
    d = S.haversine_m(F.col("_x"), F.col("_y"), F.col("lon"), F.col("lat"))
    within = lambda rows: rows.where("centre <> id").select("centre", "id", d.alias("distance")).where(F.col("distance") <= radius_m)
    named = nodes.where("name is not null")
    (lone, many), (one, several) = _split(centres, "centre"), _split(named, "id")

    asked, there = spread(lone), placed(one)
    crowd = asked.groupBy("cx", "cy").agg(F.count(F.lit(1)).cast("double").alias("a")).join(there.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("b")), ["cx", "cy"])
    tasks = _tasks(nodes, (crowd.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0.0) / PAIRS_A_TASK)
    near = within(asked.repartition(tasks, "cx", "cy").join(there.repartition(tasks, "cx", "cy"), ["cx", "cy"]))

    rest = within(spread(many).join(placed(one.unionByName(several)), ["cx", "cy"])).unionByName(within(asked.join(placed(several), ["cx", "cy"])))
    ends = doubled(edges.select("id1", "id2")).where("src <> dst").distinct()
    linked = centres.select("centre", F.col("lon").alias("_x"), F.col("lat").alias("_y")).join(ends, F.col("centre") == F.col("src")).select("centre", "_x", "_y", F.col("dst").alias("id"))
    apart = F.lit(radius_m / 111_000.0) / F.greatest(F.cos(F.radians(F.col("_y"))), F.lit(0.01))
    beside = lambda v, w, r: F.floor(F.col(v) / size).between(F.floor((F.col(w) - r) / size), F.floor((F.col(w) + r) / size))
    linked = linked.join(named.select("id", "lon", "lat"), "id").withColumn("distance", d)
    linked = linked.select("centre", "id", "distance", F.coalesce((F.col("distance") <= radius_m) & beside("lon", "_x", apart) & beside("lat", "_y", reach), F.lit(False)).alias("_met"))
    least = rest.withColumn("_met", F.lit(False)).unionByName(linked).groupBy("centre", "id").agg(F.min("distance").alias("distance"), F.bool_and("_met").alias("_met"))
    # a linked pair that met in a cell is among the near ones already, unless an end has several places
    twice = many.select("centre").distinct().withColumn("_c", F.lit(True)), several.select("id").distinct().withColumn("_i", F.lit(True))
    told = least.join(twice[0], "centre", "left").join(twice[1], "id", "left")
    return near.unionByName(told.where(~F.col("_met") | F.col("_c").isNotNull() | F.col("_i").isNotNull()).select("centre", "id", "distance"))


def grouped_neighbours(rows: DataFrame, key: str, names: list[str], groups: int = 10, ids: int = 5) -> DataFrame:
    """(key, names, n, distance, ids): neighbours grouped by their names, nearest groups first, so many groups and ids of each shown."""
    w = Window.partitionBy(key, *names)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy("distance", "id")))
    g = ranked.groupBy(key, *names).agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("distance"), F.array_sort(F.collect_list(F.when(F.col("_i") <= ids, F.struct("_i", "id")))).alias("_l"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("distance", *names))
    return g.withColumn("_r", place).where(F.col("_r") <= groups).select(key, *names, "n", "distance", F.transform("_l", lambda x: x.id).alias("ids"))


def nearest_first(rows: DataFrame, key: str, node: str, k: int | None = None) -> DataFrame:
    """(key, node, distance, place, more) of each neighbour by its least distance to any centre; the first k are shown, ``more`` counts the rest."""
    least = rows.groupBy(key, node).agg(F.min("distance").alias("distance"))
    of = Window.partitionBy(key)
    placed = least.withColumn("place", F.row_number().over(of.orderBy("distance", node))).withColumn("more", F.greatest(F.count(F.lit(1)).over(of) - F.lit(k or 0), F.lit(0)))
    return placed.where(F.col("place") <= k) if k else placed.withColumn("more", F.lit(0).cast("long"))


def edge_classes(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """The edges with ``class``: between centres, from a centre to a neighbour, or among neighbours."""
    c = centres.select("id").distinct()
    a, b = c.select(F.col("id").alias("id1"), F.lit(1).alias("_a")), c.select(F.col("id").alias("id2"), F.lit(1).alias("_b"))
    n = F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))
    marked = edges.join(a, "id1", "left").join(b, "id2", "left")
    return marked.withColumn("class", F.when(n == 2, "centre-centre").when(n == 1, "centre-neighbour").otherwise("neighbour-neighbour")).drop("_a", "_b")


def farthest_pairs(hops: DataFrame, places: DataFrame, least_hops: int = 3) -> DataFrame:
    """(graph, a, b, hops, score): the best pair of each graph, score = km * (1 + hops / 10); one end at least is no line.

    ``hops``: (graph, a, b, hop); ``places``: (id, kind, lon, lat).
    """
    end = lambda c: places.select(F.col("id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("kind", "lon", "lat")])
    rows = hops.where((F.col("hop") >= least_hops) & (F.col("a") < F.col("b"))).join(end("a"), "a").join(end("b"), "b").where("a_kind <> 'line' or b_kind <> 'line'")
    km = S.haversine_m(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat")) / 1000
    score = km * (1 + F.col("hop") / 10)
    best = rows.select("graph", "a", "b", "hop", score.alias("score")).groupBy("graph").agg(F.min(F.struct((-F.col("score")).alias("s"), "a", "b", "hop")).alias("m"))
    return best.select("graph", "m.a", "m.b", F.col("m.hop").alias("hops"), (-F.col("m.s")).alias("score"))


def first_jobs(rows: DataFrame, done: DataFrame, path: Column, order: str) -> DataFrame:
    """(job, first): one job for each base name, at the first line that names it; done ones and blank paths go."""
    jobs = rows.select(F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")).alias("job"), order).where("job is not null")
    return jobs.groupBy("job").agg(F.min(order).alias("first")).join(done.select("job").distinct(), "job", "left_anti")


def geocode_queue(rows: DataFrame, done: DataFrame, most: int) -> DataFrame:
    """(id, priority): rows without city or street that are not done, nearest to the layer's middle first, up to the budget of requests."""
    middle = rows.agg(F.avg("lon").alias("_x"), F.avg("lat").alias("_y"))
    open_ = rows.where("city is null or street is null").join(done.select("id").distinct(), "id", "left_anti").join(F.broadcast(middle))  # one row
    far = F.sqrt(F.pow(F.col("lon") - F.col("_x"), 2) + F.pow(F.col("lat") - F.col("_y"), 2))
    return open_.select("id", far.alias("priority")).orderBy("priority", "id").limit(most)
