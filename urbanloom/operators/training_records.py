"""Training records from path jobs: which lines are kept, why others are not, and the enriched messages of those kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.functions import records as R
from urbanloom.functions import text as T

from .paths import place_entities

#: Why a line is left out, in the order in which the reasons are looked at; the first that holds counts.
REASONS = ("unnamed_ends", "duplicate_path", "no_coordinates", "graph_not_finished", "no_messages")
MARK, BASED = "Spatial Reasoning Path:", "Based on"


def _path_of(content: Column) -> Column:
    """The cleaned path in a user message: between its mark and what it is based on, without the last full stop; empty without the mark."""
    rest = F.substr(content, F.instr(content, MARK) + len(MARK))
    part = F.regexp_replace(F.trim(F.split_part(rest, F.lit(BASED), F.lit(1))), r"\.$", "")
    return F.when(content.contains(MARK), T.clean_path_text(part)).otherwise("")


def compose_records(jobs: DataFrame, steps: DataFrame, nodes: DataFrame, compass: DataFrame | None = None, finished: DataFrame | None = None) -> DataFrame:
    """(line, reason, filled, messages, images, graphs, summarization, image_coordinates, image) of every job; reason is null for those kept.

    ``jobs``: (line, messages, image_path, graph_path, summarization, coordinates, image, path_text); ``steps``: (line, pos, node,
    name, kind) of the jobs' paths; ``nodes``: (node, lon, lat, said) with the text of each place; ``compass``: (image, facing);
    ``finished``: (graph_path) of the graphs that are ready, null if all are.

    A line goes if an end of its path has no name; if an earlier line with named ends has the same path text, kept or not (a null
    path text is no path); if neither its own coordinates nor its image's node say where it is; if its graph is not
    finished; or if it has no messages. ``filled`` marks places that came from the node. Of the kept lines every user message
    gets coordinates, facing, cleaned path and the places of the path that are known; in the summarization the last node's name
    stands for its id. Columns of lines that go are null but for the first two. Lines are told apart by ``line``.
    """
    ends = steps.groupBy("line").agg(*[f(c, "pos").alias(f"_{k}_{c}") for k, f in (("a", F.min_by), ("b", F.max_by)) for c in ("node", "name", "kind")])
    rows = jobs.join(ends, "line", "left").withColumn("_named", F.coalesce(R.valid_endpoints(F.col("_a_name"), F.col("_a_kind"), F.col("_b_name"), F.col("_b_kind")), F.lit(False)))
    first = rows.where("_named and path_text is not null").groupBy("path_text").agg(F.min("line").alias("_first"))
    at = nodes.select(F.col("node").alias("image"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).dropDuplicates(["image"])
    rows = rows.join(first, "path_text", "left").join(at, "image", "left")
    none = F.lit(None).cast("double")
    told = R.coordinates_of(F.col("coordinates"), none, none, none, none)
    rows = rows.withColumn("_at", R.coordinates_of(F.col("coordinates"), F.col("_lon"), F.col("_lat"), none, none)).withColumn("filled", told.isNull())
    ready = F.lit(True)
    if finished is not None:
        rows = rows.join(finished.select("graph_path", F.lit(True).alias("_ready")).distinct(), "graph_path", "left")
        ready = F.coalesce("_ready", F.lit(False))
    tests = (~F.col("_named"), F.col("_first") < F.col("line"), F.col("_at").isNull(), ~ready, F.coalesce(F.size("messages"), F.lit(0)) <= 0)
    reason = F.coalesce(*[F.when(t, r) for t, r in zip(tests, REASONS, strict=True)])
    rows = rows.withColumn("reason", reason)

    known = steps.join(nodes.where("said is not null").select("node", "said").dropDuplicates(["node"]), "node").where(F.coalesce("name", F.lit("")) != "")
    rows = rows.join(place_entities(known, "line", "name", "said", "pos").withColumnRenamed("told", "_told"), "line", "left")
    rows = rows.join(compass.select("image", "facing").dropDuplicates(["image"]), "image", "left") if compass is not None else rows.withColumn("facing", F.lit(None).cast("string"))
    asked = F.element_at(F.concat(F.transform(F.filter("messages", lambda m: m.role == "user"), lambda m: m.content), F.array(F.lit(""))), 1)
    rows = rows.withColumns({"_path": _path_of(asked), "_where": F.format_string("(%.4f, %.4f)", "_at.lon", "_at.lat")})
    enriched = F.transform("messages", lambda m: F.struct(m.role.alias("role"), F.when(m.role == "user", R.enrich_message(m.content, F.col("image").cast("string"), F.col("_where"), F.col("facing"), F.col("_path"), F.coalesce("_told", F.lit("")))).otherwise(m.content).alias("content")))
    last = F.trim("_b_name")
    summary = F.when(F.coalesce(last, F.lit("")) != "", F.replace(F.col("summarization"), F.col("_b_node").cast("string"), last)).otherwise(F.col("summarization"))
    kept = F.col("reason").isNull()
    out = {"filled": F.col("filled"), "messages": enriched, "images": F.array("image_path"), "graphs": F.array("graph_path"), "summarization": summary, "image_coordinates": F.col("_where"), "image": F.col("image")}
    return rows.select("line", "reason", *[F.when(kept, c).alias(n) for n, c in out.items()])


def skip_counts(records: DataFrame) -> DataFrame:
    """(reason, lines) of the composed records, ``kept`` for those that stay and ``filled`` for those of them whose place came from the node."""
    counted = records.select(F.explode(F.array_compact(F.array(F.coalesce("reason", F.lit("kept")), F.when(F.col("filled"), "filled")))).alias("reason"))
    return counted.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))
