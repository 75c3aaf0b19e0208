"""Dataset, window and record queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urbanloom.functions import text as T
from urbanloom.operators import datasets as D
from urbanloom.operators import packing
from urbanloom.sources.fixtures import table

from .registry import query


@query("SELECT conv_id, count(*) AS n, bool_and(role IN ('system','user','assistant','tool_call','tool_response','tool') AND text IS NOT NULL) AS valid, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def i4_normalise_messages(spark: SparkSession, d: str) -> DataFrame:
    """Turns to messages with their checks."""
    m = D.messages_of_turns(table(spark, d, "conversations").dropDuplicates(["conv_id", "turn", "role", "text"]))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("role", "turn").alias("last_role"))
    return m.select("conv_id", D.valid_messages(F.col("messages")).alias("valid")).join(c, "conv_id")


@query("""SELECT a.conv_id, a.turn, length(a.text) AS q, length(b.text) AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant' AND b.text IS NOT NULL AND b.text <> a.text""")
def i6_query_response_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Question and answer pairs whose answer is present and differs."""
    c = table(spark, d, "conversations")
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = c.where("role = 'user'").join(b, ["conv_id", "turn"]).where("answer is not null and answer <> text")
    m = rows.select("conv_id", "turn", D.query_response(F.col("text"), F.col("answer")).alias("m"))
    return m.select("conv_id", "turn", F.length(F.col("m")[0].content).alias("q"), F.length(F.col("m")[1].content).alias("r"))


@query("SELECT doc_id, ['bad', 'good'][quality + 1] AS answer, length('Task: quality' || chr(10) || 'Labels: bad, good' || chr(10) || 'Sentence: ' || text || chr(10) || 'Label:') AS chars FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def i12_classification_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").where("quality is not null")
    prompt = D.classification_prompt("quality", ["bad", "good"], F.col("text"))
    return rows.select("doc_id", F.element_at(F.array(F.lit("bad"), F.lit("good")), F.col("quality") + 1).alias("answer"), F.length(prompt).alias("chars"))


@query("SELECT doc_id, 1 AS copy FROM documents UNION ALL SELECT doc_id, 2 FROM documents UNION ALL (SELECT doc_id, 3 FROM documents ORDER BY doc_id LIMIT (SELECT count(*) * 5 // 2 - 2 * count(*) FROM documents))")
def i32_sample_with_replication(spark: SparkSession, d: str) -> DataFrame:
    """Two copies of a table and its first half (I32); the size is the operator's argument."""
    docs = table(spark, d, "documents").select("doc_id")
    return D.sample_n(docs, docs.count() * 5 // 2, "doc_id")


@query("SELECT CASE WHEN v THEN 'val' ELSE 'train' END AS split, CASE WHEN v THEN count(*) // 10 ELSE count(*) - count(*) // 10 END AS count FROM documents, (VALUES (true), (false)) s(v) GROUP BY v")
def i33_train_val_split(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each part has (I33); the rows themselves are picked by a hash and tested."""
    return D.train_val_split(table(spark, d, "documents").select("doc_id"), 0.1, "doc_id").groupBy("split").count()


@query()
def i37_pack_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed by length (I37); tested for its invariants."""
    return packing.pack_sequences(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 8192)


@query()
def i17_sample_negatives(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("answer"))
    return D.sample_negatives(rows, "doc_id", "answer", 3, buckets=4)


@query("SELECT doc_id, coalesce(lag(lang) OVER (PARTITION BY source ORDER BY doc_id), last_value(lang) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS other FROM documents")
def i39_mismatched_pairs(spark: SparkSession, d: str) -> DataFrame:
    return D.mismatched_pairs(table(spark, d, "documents").select("doc_id", "source", "lang"), "source", "doc_id", "lang").select("doc_id", "other")


@query("SELECT event_id, CAST(sum(CASE WHEN event_type = 'login' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS dialogue FROM events")
def i31_web_action_dialogues(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return D.windowed_dialogues(rows, "user_id", "o", F.col("event_type") == "login").select("event_id", "dialogue")


@query("SELECT path, pos, CASE WHEN p IS NOT NULL AND (p <> name OR name = 'purchase') THEN 1 ELSE 0 END AS change FROM (SELECT *, lag(name) OVER (PARTITION BY path ORDER BY pos) AS p FROM steps)")
def g14_edge_type_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes of kind along a path; a purchase stands for a crossing."""
    p = F.lag("name").over(Window.partitionBy("path").orderBy("pos"))
    return table(spark, d, "steps").withColumn("p", p).select("path", "pos", F.when(F.col("p").isNotNull() & ((F.col("p") != F.col("name")) | (F.col("name") == "purchase")), 1).otherwise(0).alias("change"))


@query("WITH s AS (SELECT path, list(value ORDER BY pos) AS v FROM steps GROUP BY path) SELECT path, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * pow(0.9, len(v) - i))) / list_sum(list_transform(range(1, len(v) + 1), lambda i: pow(0.9, len(v) - i))), 5) AS ema FROM s")
def g4_ema_debiased(spark: SparkSession, d: str) -> DataFrame:
    """Last value of the debiased moving average of each series."""
    s = table(spark, d, "steps").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x.value).alias("v"))
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("n"))
    last = F.aggregate("v", zero, lambda a, v: F.struct((a.x * 0.9 + v).alias("x"), (a.n * 0.9 + 1).alias("n")), lambda a: a.x / a.n)
    return s.select("path", F.round(last, 5).alias("ema"))


@query("WITH t AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN text END AS text FROM documents) SELECT min(doc_id) AS doc_id, count(*) AS copies FROM t WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT doc_id, 1 FROM t WHERE text IS NULL")
def g9_dedupe_by_text(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each text; rows without text, here a ninth, all stay."""
    t = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("text"))
    return D.first_of_text(t, "doc_id", "text")


@query("SELECT user_id AS path, name, min(pos) AS first_pos FROM (SELECT path AS user_id, name, pos FROM steps) GROUP BY ALL")
def g10_distinct_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "steps").groupBy("path", "name").agg(F.min("pos").alias("first_pos"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def g13_missing_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").distinct().join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT id, any_value(src) AS src FROM (SELECT id, 'points' AS src FROM points UNION ALL SELECT id, 'images' FROM images) GROUP BY id")
def g12_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "points").select("id", F.lit("points").alias("src")).unionByName(table(spark, d, "images").select("id", F.lit("images").alias("src")))
    return both.groupBy("id").agg(F.max("src").alias("src"))


@query("SELECT event_type AS status, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def f14_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT lang, round(avg(length(text)), 4) AS mean, round(stddev_pop(length(text)), 4) AS std, min(length(text)) AS lo, max(length(text)) AS hi, count(*) AS n FROM documents GROUP BY lang")
def f17_length_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.round(F.avg(n), 4).alias("mean"), F.round(F.stddev_pop(n), 4).alias("std"), F.min(n).alias("lo"), F.max(n).alias("hi"), F.count(F.lit(1)).alias("n"))


@query("SELECT path, pos, round(value * exp(-pow(1 - (r - 1) / greatest(n - 1, 1), 2) / (2 * 0.25)), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY value, pos) AS r, count(*) OVER (PARTITION BY path) AS n FROM steps)")
def f21_rank_weighted_scores(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("path")
    s = table(spark, d, "steps").withColumn("r", F.row_number().over(w.orderBy("value", "pos"))).withColumn("n", F.count(F.lit(1)).over(w))
    rank = (F.col("r") - 1) / F.greatest(F.col("n") - 1, F.lit(1))
    return s.select("path", "pos", F.round(F.col("value") * F.exp(-F.pow(1 - rank, 2) / 0.5), 6).alias("score"))


@query("SELECT path, round(avg(value), 6) AS mean, max(value) AS most, round(sum(value), 4) AS total FROM steps GROUP BY path")
def f22_aggregate_steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "steps").groupBy("path").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT greatest(sum(quality), 1) AS good, greatest(count(*) - sum(quality), 1) AS bad, round(greatest(count(*) - sum(quality), 1) * 1.0 / greatest(sum(quality), 1), 2) AS low, round(greatest(count(*) - sum(quality), 1) * 1.33 / greatest(sum(quality), 1), 2) AS high FROM labels")
def f23_label_weight_bounds(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "labels").agg(F.greatest(F.sum("quality"), F.lit(1)).alias("good"), F.greatest(F.count(F.lit(1)) - F.sum("quality"), F.lit(1)).alias("bad"))
    return c.select("good", "bad", F.round(F.col("bad") / F.col("good"), 2).alias("low"), F.round(F.col("bad") * 1.33 / F.col("good"), 2).alias("high"))


@query("SELECT page_id, 'https://data/' || split_part(url, '/', -1) AS path, lower(split_part(trim(url), '/', -1)) AS key FROM pages WHERE split_part(trim(url), '/', -1) <> ''")
def b17_rewrite_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths rewritten to a prefix and their keys."""
    rows = table(spark, d, "pages").where(T.image_key(F.col("url")).isNotNull())
    return rows.select("page_id", T.rewrite_paths(F.array("url"), "https://data/")[0].alias("path"), T.image_key(F.col("url")).alias("key"))


@query("WITH t AS (SELECT p_partkey AS id, p_brand AS name, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS type FROM part), m AS (SELECT name, arg_min(type, (-n, type)) AS mode FROM (SELECT name, type, count(*) AS n FROM t WHERE type IS NOT NULL GROUP BY ALL) GROUP BY name) SELECT id, name, coalesce(type, mode) AS type FROM t LEFT JOIN m USING (name)")
def b13_fill_type_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Missing types, here a quarter, filled with the most frequent one of the name, ties to the smallest."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")).alias("type"))
    return D.fill_by_mode(t, "name", "type").select("id", "name", "type")


@query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 64) AS BIGINT) AS batch_id FROM documents")
def i38_shard_batches(spark: SparkSession, d: str) -> DataFrame:
    return D.shard_batches(table(spark, d, "documents").select("doc_id"), "doc_id", 64)


@query("SELECT 0 AS source, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents UNION ALL SELECT 1, count(*), min(doc_id), max(doc_id) FROM labels")
def i34_interleave(spark: SparkSession, d: str) -> DataFrame:
    """Two sources in seeded turns until all rows are drawn (I34); the draws are tested against brute force."""
    rows = D.interleave([table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")], [0.7, 0.3], "doc_id", 3, "all")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("SELECT cell, least(count(*), 3) AS n FROM (SELECT user_id AS cell FROM events) GROUP BY cell")
def e34_random_k_per_cell(spark: SparkSession, d: str) -> DataFrame:
    """How many images each cell keeps, three at most, which is the feature."""
    return D.random_k(table(spark, d, "events").select(F.col("user_id").alias("cell"), "event_id"), "cell", "event_id").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 0 AS source, doc_id FROM documents UNION ALL SELECT 1, doc_id FROM labels")
def g11_union_all(spark: SparkSession, d: str) -> DataFrame:
    return D.union_all([table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")]).select("source", "doc_id")


@query("SELECT id, 'Name: ' || name || ', Category: ' || category || ', Coordinates: (' || printf('%.6f', lon) || ', ' || printf('%.6f', lat) || ')' AS node_text FROM points")
def h24_node_text(spark: SparkSession, d: str) -> DataFrame:
    """Node texts."""
    return table(spark, d, "points").select("id", T.node_text({"Name": F.col("name"), "Category": F.col("category")}, F.col("lon"), F.col("lat")).alias("node_text"))


@query("SELECT path, string_agg('(' || name || ', ' || nxt || ') -> (' || printf('%.1f', floor(value)) || 'm)', ' -> ' ORDER BY pos) AS text FROM (SELECT *, lead(name) OVER (PARTITION BY path ORDER BY pos) AS nxt FROM steps) WHERE nxt IS NOT NULL GROUP BY path")
def h8_format_path(spark: SparkSession, d: str) -> DataFrame:
    """Paths as text."""
    s = table(spark, d, "steps").withColumn("nxt", F.lead("name").over(Window.partitionBy("path").orderBy("pos"))).where("nxt is not null")
    part = F.concat(F.lit("("), F.col("name"), F.lit(", "), F.col("nxt"), F.lit(") -> "), T.format_step(F.floor("value").cast("double"), F.lit(None).cast("string")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", part.alias("t"))))
    return s.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x.t), " -> ").alias("text"))


@query("SELECT path, count(*) + 2 * sum(CASE WHEN name = 'purchase' THEN 1 ELSE 0 END) AS score FROM steps GROUP BY path")
def h14_complexity_score(spark: SparkSession, d: str) -> DataFrame:
    """Path complexity with purchases as crossings and no directions."""
    g = table(spark, d, "steps").groupBy("path").agg(F.collect_list(F.when(F.col("name") == "purchase", "crossing").otherwise(F.col("name"))).alias("t"))
    return g.select("path", T.complexity(F.col("t"), F.array().cast("array<string>")).cast("long").alias("score"))


@query("SELECT id, md5('{\"category\":\"' || category || '\",\"name\":\"' || name || '\"}') AS fp FROM points")
def c40_row_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "points").select("id", T.fingerprint({"name": F.col("name"), "category": F.col("category")}).alias("fp"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN CAST(p_size AS DOUBLE) WHEN p_retailprice > 0 THEN CAST(p_retailprice AS DOUBLE) ELSE 1.0 END AS weight FROM part")
def b14_edge_weight(spark: SparkSession, d: str) -> DataFrame:
    """The first positive of several weights."""
    return table(spark, d, "part").select("p_partkey", T.edge_weight(F.when(F.col("p_size") > 25, F.col("p_size")), F.col("p_retailprice")).alias("weight"))
