"""Queries that bring rows of several formats to messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.operators import adapters as A
from urbanloom.sources.fixtures import table

from .registry import query


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each user turn with the assistant's next one, if any."""
    c = table(spark, d, "conversations")
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(b, ["conv_id", "turn"], "left")


PAIRS = "p AS (SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user')"
MESSAGES = "md5('user:' || question || '|assistant:' || answer)"


def _digest(messages: Column) -> Column:
    return F.md5(F.array_join(F.transform(messages, lambda m: F.concat(m.role, F.lit(":"), m.content)), "|"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, {MESSAGES} AS qa, CASE WHEN conv_id % 2 = 0 THEN md5('user:' || question || chr(10) || 'Answer.|assistant:' || answer) ELSE md5('user:' || question || '|assistant:' || answer) END AS instructed FROM p")
def i1_auto_preprocess(spark: SparkSession, d: str) -> DataFrame:
    """The query-response and the instruction form of the same rows, chosen by their columns (I1, I2, I3); unanswered rows have no messages."""
    p = _pairs(spark, d)
    first = A.auto_messages(p).select("conv_id", "turn", _digest(F.col("messages")).alias("qa"))
    second = A.auto_messages(p.select("conv_id", "turn", F.col("question").alias("instruction"), F.when(F.col("conv_id") % 2 == 0, "Answer.").otherwise("").alias("input"), F.col("answer").alias("output")))
    return first.join(second.select("conv_id", "turn", _digest(F.col("messages")).alias("instructed")), ["conv_id", "turn"])


@query("SELECT conv_id, md5(string_agg(CASE role WHEN 'assistant' THEN 'assistant' WHEN 'user' THEN 'user' ELSE role END || ':' || text, '|' ORDER BY turn)) AS said FROM (SELECT DISTINCT * FROM conversations) GROUP BY conv_id")
def i1_from_value_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of (from, value) turns with role aliases as messages."""
    c = table(spark, d, "conversations").distinct()
    role = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    listed = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("from"), F.col("text").alias("value")))).alias("conversations"))
    return A.auto_messages(listed).select("conv_id", _digest(F.col("messages")).alias("said"))


@query("SELECT page_id, url AS one, 2 AS two FROM pages")
def i8_normalise_media(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", F.col("url").alias("images"), F.array(F.col("url"), F.lit(None).cast("string"), F.lit("b")).alias("videos"))
    out = A.normalise_media(A.normalise_media(rows, "images"), "videos")
    return out.select("page_id", F.col("images")[0].path.alias("one"), F.size("videos").alias("two"))


@query("SELECT doc_id, CAST(quality AS INT) AS label, 'Answer this: ' || lang || '!' AS prompt FROM documents JOIN labels USING (doc_id)")
def i10_class_label(spark: SparkSession, d: str) -> DataFrame:
    """Integer labels, and a prompt with its query."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", F.col("quality").cast("int").alias("label"), A.text_prompt("Answer this: {{QUERY}}!", F.col("lang")).alias("prompt"))


@query()
def i13_grounding_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Templates picked by a seeded hash; tested for their shares."""
    return table(spark, d, "points").select("id", A.grounding_prompt("grounding", F.col("name"), F.col("id")).alias("prompt"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, md5(question) AS a, md5(answer) AS b, round(length(question) * 1.0 / (length(question) + length(answer)), 6) AS label, printf('%.1f', floor(length(question) * 10.0 / (length(question) + length(answer)))) AS told FROM p WHERE length(question) * 1.0 / (length(question) + length(answer)) >= 0.3")
def i14_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Scored sentence pairs over a threshold, and the score as text."""
    p = _pairs(spark, d).where("answer is not null")
    score = F.length("question") / (F.length("question") + F.length("answer"))
    rows = p.select("conv_id", "turn", A.similarity_pair(F.col("question"), F.col("answer"), score).alias("r"), F.format_string("%.1f", F.floor(F.length("question") * 10.0 / (F.length("question") + F.length("answer"))).cast("double")).alias("told")).where("r.label >= 0.3")
    return rows.select("conv_id", "turn", F.md5(F.col("r.messages")[0].content).alias("a"), F.md5(F.col("r.positive_messages")[0][0].content).alias("b"), F.round("r.label", 6).alias("label"), "told")


@query("SELECT conv_id, md5(min(text)) AS q, sum(CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN role = 'assistant' AND turn % 4 <> 1 THEN 1 ELSE 0 END) AS neg FROM conversations GROUP BY conv_id")
def i16_rerank_groups(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    said = lambda cond: F.collect_list(F.when((F.col("role") == "assistant") & cond, F.col("text")))
    g = c.groupBy("conv_id").agg(F.min("text").alias("q"), said(F.col("turn") % 4 == 1).alias("p"), said(F.col("turn") % 4 != 1).alias("n"))
    r = g.select("conv_id", A.rerank_group(F.col("q"), F.col("p"), F.col("n")).alias("r"))
    return r.select("conv_id", F.md5(F.col("r.messages")[0].content).alias("q"), F.size("r.positive_messages").cast("long").alias("pos"), F.size("r.negative_messages").cast("long").alias("neg"))


@query("SELECT page_id, url AS image, 'caption ' || CAST(page_id AS VARCHAR) AS positive FROM pages WHERE page_id % 5 <> 0")
def i18_image_text_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The first caption of each image that has a file; a fifth has none."""
    captions = F.array(F.concat(F.lit("caption "), F.col("page_id").cast("string")), F.lit("other"))
    return table(spark, d, "pages").where("page_id % 5 <> 0").select("page_id", F.col("url").alias("image"), captions[0].alias("positive"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, md5(question) AS answer, 0 AS label FROM p WHERE question IS NOT NULL UNION ALL SELECT conv_id, turn, md5(answer), 1 FROM p WHERE answer IS NOT NULL")
def i19_one_row_to_two(spark: SparkSession, d: str) -> DataFrame:
    out = A.two_rows(_pairs(spark, d), {"question": 0, "answer": 1})
    return out.select("conv_id", "turn", F.md5("answer").alias("answer"), "label")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('login', 'purchase')")
def i20_allow_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_type").isin("login", "purchase")).select("event_id", "event_type")


@query("SELECT event_id, 'user:first ' || event_type || '|assistant:it is ' || CAST(user_id AS VARCHAR) AS chosen, 'user:first ' || event_type || '|assistant:no' AS rejected FROM events")
def i21_preference_dialogues(spark: SparkSession, d: str) -> DataFrame:
    """Marked dialogues, chosen and rejected; the third turn is unanswered and goes."""
    e = table(spark, d, "events")
    start = F.concat(F.lit("\n\nHuman: first "), F.col("event_type"), F.lit("\n\nAssistant: "))
    chosen, rejected = F.concat(start, F.lit("it is "), F.col("user_id").cast("string"), F.lit("\n\nHuman: more?")), F.concat(start, F.lit("no"))
    said = lambda m: F.array_join(F.transform(m, lambda x: F.concat(x.role, F.lit(":"), x.content)), "|")
    return e.select("event_id", said(A.marked_turns(chosen)).alias("chosen"), said(A.marked_turns(rejected)).alias("rejected"))


@query("WITH c AS (SELECT DISTINCT * FROM conversations) SELECT conv_id, md5('Speakers: ' || (SELECT string_agg(DISTINCT role, ', ' ORDER BY role) FROM c x WHERE x.conv_id = c.conv_id) || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS folded FROM c GROUP BY conv_id")
def i22_multi_speaker_dialogue(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "conversations").distinct().groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"), F.array_sort(F.collect_set("role")).alias("r"))
    return g.select("conv_id", F.md5(A.folded_dialogue(F.col("t"), F.col("r"))).alias("folded"))


@query("SELECT event_id, 'user:' || event_type || '|assistant:yes ' || CAST(user_id AS VARCHAR) AS said FROM events WHERE event_id % 3 = 0")
def i23_role_marked_text(spark: SparkSession, d: str) -> DataFrame:
    """Marked text as turns; two thirds have the wrong first mark or an empty answer and go."""
    k, u = F.col("event_id") % 3, F.col("user_id").cast("string")
    text = F.when(k == 0, F.concat(F.lit("User: "), F.col("event_type"), F.lit(" Assistant: yes "), u)).when(k == 1, F.concat(F.lit("Assistant: x User: "), u)).otherwise("User: x Assistant: ")
    rows = table(spark, d, "events").select("event_id", A.role_marked(text).alias("m")).where("m is not null")
    return rows.select("event_id", F.array_join(F.transform("m", lambda x: F.concat(x.role, F.lit(":"), x.content)), "|").alias("said"))


@query("SELECT event_id, event_type AS passage, CAST(user_id AS VARCHAR) AS answer, '{\"k\":' || regexp_extract(props, '[0-9]+') || '}' AS plain FROM events")
def i24_question_generation(spark: SparkSession, d: str) -> DataFrame:
    """Text split at its separator (I24), and characters stripped."""
    joined = F.concat(F.col("event_type"), F.lit("[SEP]"), F.col("user_id").cast("string"))
    parts = F.split(joined, r"\[SEP\]")
    return table(spark, d, "events").select("event_id", parts[0].alias("passage"), parts[1].alias("answer"), A.without(F.col("props"), (" ",)).alias("plain"))


@query("""SELECT event_id, 'user:' || event_type AS asked, '{"name":"f","arguments":{"k":"' || regexp_extract(props, '[0-9]+') || '"}}' AS call FROM events""")
def i25_tool_call_rows(spark: SparkSession, d: str) -> DataFrame:
    calls = F.concat(F.lit('[{"name": "f", "arguments": '), F.col("props"), F.lit("}]"))
    m = table(spark, d, "events").select("event_id", A.tool_call_messages(F.col("event_type"), calls).alias("m"))
    return m.select("event_id", F.concat(F.col("m")[0].role, F.lit(":"), F.col("m")[0].content).alias("asked"), F.col("m")[1].content.alias("call"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'why' || chr(10) || 'Answer: ' || ['a', 'b', 'c'][event_id % 3 + 1] ELSE ['a', 'b', 'c'][event_id % 3 + 1] END AS answer, ['cat', 'dog', NULL][event_id % 3 + 1] AS target FROM events")
def i28_choice_answer(spark: SparkSession, d: str) -> DataFrame:
    """Indexed choices with a rationale (I28), category numbers as names."""
    k = F.col("event_id") % 3
    choices = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return table(spark, d, "events").select("event_id", A.choice_answer(choices, k, F.when(F.col("event_id") % 2 == 0, "why")).alias("answer"), A.detection_targets(F.array(k), ["cat", "dog"])[0].alias("target"))


@query()
def i27_pick_one_question(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return q.select("conv_id", A.pick_one(F.col("t.turn"), F.col("t.text"), F.col("conv_id")).alias("x")).select("conv_id", F.col("x.question").alias("turn"), F.md5("x.answer").alias("answer"))


@query("SELECT id, '<ref-object>' || substr(name, 1, 3) || '</ref-object><bbox>' || substr(name, 4, 2) || '<ref-object>' || substr(name, 6, 2) || '</ref-object><bbox>' || substr(name, 8) AS told FROM points WHERE id % 2 = 0 AND length(name) >= 7")
def i29_phrase_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Spans of names in marks; those of odd ids overlap and go."""
    span = lambda a, b: F.struct(F.lit(a).alias("begin"), b.alias("end"))
    spans = F.array(span(5, F.lit(7)), span(0, F.when(F.col("id") % 2 == 0, 3).otherwise(6)))
    return table(spark, d, "points").select("id", A.phrase_boxes(F.col("name"), spans).alias("told")).where("told is not null")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 4 END AS parts, CASE WHEN event_type = 'error' THEN 0.5 ELSE 5.0 END AS total FROM events")
def i40_loss_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the parts of a response: text before 1, one mark with 1 and 2; a query rule for errors."""
    text = F.concat(F.lit("Start. Action: "), F.col("event_type"), F.lit(" Observation: "), F.col("user_id").cast("string"))
    w = A.loss_weights(text, {"Action:": (1.0, 2.0), "Observation:": (0.0, 0.0)}, F.col("event_type"), {"error": 0.5})
    rows = table(spark, d, "events").select("event_id", w.alias("w"))
    kept = F.filter("w", lambda x: x.weight > 0)
    return rows.select("event_id", (F.size(kept) + F.when(F.size("w") > 1, 1).otherwise(0)).alias("parts"), (F.aggregate("w", F.lit(0.0), lambda a, x: a + x.weight) + F.when(F.size("w") > 1, 1.0).otherwise(0.0)).alias("total"))


@query("SELECT page_id FROM pages WHERE page_id % 3 <> 0 ORDER BY page_id LIMIT 50")
def i41_graph_free_subset(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 rows without graphs, which is the evaluation's limit."""
    rows = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.array("url")).alias("graphs"))
    return A.graph_free(rows, "page_id", 50).select("page_id")


@query("SELECT doc_id, lang FROM documents")
def b26_keep_standard_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumnRenamed("lang", "label")
    return A.keep_standard(rows, ("doc_id",)).withColumnRenamed("label", "lang")


@query("SELECT 'docs' AS source, count(*) AS n FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'talks', count(*) FROM (SELECT DISTINCT conv_id FROM conversations)")
def i36_load_mix(spark: SparkSession, d: str) -> DataFrame:
    """Two sources of different formats as one mix; train and validation together are all rows."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("key"), F.lit("q").alias("query"), F.col("text").alias("response"))
    talks = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("key")).agg(F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("messages"))
    train, val = A.load_mix({"docs": docs, "talks": talks}, 0.1, "key")
    return train.unionByName(val).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
