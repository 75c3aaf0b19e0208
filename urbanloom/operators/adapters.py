"""Adapters from the row formats of datasets to message rows, and loading of dataset mixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import datasets as D

# Column names that mean a query, a response, a system text.
QUERY_NAMES = ("query", "prompt", "input", "instruction", "question", "problem")
RESPONSE_NAMES = ("response", "answer", "output", "targets", "target", "answer_key", "answers", "solution", "text", "completion", "content")
SYSTEM_NAMES = ("system", "system_prompt")
#: The columns that a prepared row may keep.
STANDARD = ("messages", "rejected_messages", "rejected_response", "positive_messages", "negative_messages", "images", "videos", "audios", "graphs", "tools", "objects", "label", "channel", "margin", "positive", "negative")
#: Grounding templates, English first, by task: {} stands for the object.
GROUNDING = {
    "grounding": ("Find the place of {}.", "Where is {} in the picture?", "Mark {}.", "请找出{}的位置。"),
    "caption": ("Describe this region: {}.", "What is at {}?", "Tell what {} shows.", "请描述{}。"),
}


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _first(df: DataFrame, names: tuple[str, ...]) -> Column | None:
    here = [F.col(c).cast("string") for c in names if c in df.columns]
    return F.coalesce(*here) if here else None


def auto_messages(df: DataFrame) -> DataFrame:
    """``messages`` by the columns present: lists of turns (role/content or from/value), instruction and input, or query and response.

    Rows whose query or response is null have null messages. Other columns stay.
    """
    for name in ("messages", "conversation", "conversations"):
        if name in df.columns:
            fields = df.schema[name].dataType.elementType.fieldNames()
            role, content = ("role", "content") if "role" in fields else ("from", "value")
            kind = lambda m: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in D.ROLE_ALIASES.items() for x in p]), m[role]), m[role])
            return df.withColumn("messages", F.transform(name, lambda m: F.struct(kind(m).alias("role"), m[content].alias("content"))))
    answer, system = _first(df, RESPONSE_NAMES if "instruction" not in df.columns or "input" not in df.columns else ("output", "response")), _first(df, SYSTEM_NAMES)
    asked = D.instruction_input(F.col("instruction"), F.col("input")) if {"instruction", "input"} <= set(df.columns) else _first(df, QUERY_NAMES)
    if asked is None or answer is None:
        raise ValueError(f"no known row format among {df.columns}")
    return df.withColumn("messages", F.when(asked.isNotNull() & answer.isNotNull(), D.query_response(asked, answer, system)))


def keep_standard(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Only the columns that prepared rows may keep, and ``extra`` ones."""
    return df.select(*[c for c in df.columns if c in STANDARD or c in extra])


def normalise_media(df: DataFrame, name: str) -> DataFrame:
    """A column of one path or a list of paths as array<struct<bytes, path>>; null stays null, and lists lose their nulls."""
    kind, one = df.schema[name].dataType, lambda p: F.struct(F.lit(None).cast("binary").alias("bytes"), p.alias("path"))
    if isinstance(kind, StringType):
        return df.withColumn(name, F.when(F.col(name).isNotNull(), F.array(one(F.col(name)))))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
        return df.withColumn(name, F.transform(F.array_compact(name), one))
    return df


def text_prompt(prompt: str, query: Column) -> Column:
    """``{{QUERY}}`` in a prompt replaced by the query."""
    return F.replace(F.lit(prompt), F.lit("{{QUERY}}"), query)


def grounding_prompt(task: str, thing: Column, key: Column, seed: int = 0) -> Column:
    """A template of the task picked by a hash of the key: a Chinese one for a fifth of the keys, else an English one."""
    templates = GROUNDING[task]
    h = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1000))
    english = F.element_at(F.array(*map(F.lit, templates[:-1])), (h % (len(templates) - 1) + 1).cast("int"))
    return F.replace(F.when(h < 800, english).otherwise(F.lit(templates[-1])), F.lit("{}"), thing)


def similarity_pair(a: Column, b: Column, score: Column) -> Column:
    """struct(messages, positive_messages, label) of a scored pair of sentences."""
    return F.struct(F.array(turn("user", a)).alias("messages"), F.array(F.array(turn("user", b))).alias("positive_messages"), score.cast("double").alias("label"))


def rerank_group(query: Column, positives: Column, negatives: Column) -> Column:
    lists = lambda texts: F.transform(texts, lambda t: F.array(turn("assistant", t)))
    return F.struct(F.array(turn("user", query)).alias("messages"), lists(positives).alias("positive_messages"), lists(negatives).alias("negative_messages"))


def two_rows(df: DataFrame, answers: dict[str, int], name: str = "answer", label: str = "label") -> DataFrame:
    """A row for each of the named answer columns, with its class."""
    each = F.array(*[F.struct(F.col(c).alias(name), F.lit(k).alias(label)) for c, k in answers.items()])
    rest = [c for c in df.columns if c not in answers]
    return df.select(*rest, F.explode(each).alias("_x")).select(*rest, f"_x.{name}", f"_x.{label}").where(F.col(name).isNotNull())


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def marked_turns(text: Column) -> Column:
    """Messages of a dialogue in one text with ``Human:`` and ``Assistant:`` marks, taken in turn; an unanswered last turn goes."""
    parts = F.transform(F.split(_strip(text), "\n\nHuman:|\n\nAssistant:|\n\nHum:"), lambda p: _strip(p))
    first = F.transform(parts, lambda p, i: F.when((i == 0) & p.startswith("Human:"), _strip(F.substr(p, F.lit(7)))).otherwise(p))
    whole = F.slice(first, 1, (F.floor(F.size(first) / 2) * 2).cast("int"))
    return F.transform(whole, lambda p, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), p.alias("content")))


def role_marked(text: Column) -> Column:
    """Messages of ``User:``/``Assistant:`` marked text; null unless the marks alternate, user first, all are filled and the last is answered."""
    marks = F.regexp_extract_all(text, F.lit(r"(User|Assistant|Assistent|Assistenz):"), F.lit(1))
    said = F.slice(F.split(text, r"(?:User|Assistant|Assistent|Assistenz):"), 2, 1 << 30)
    right = F.size(F.filter(F.transform(marks, lambda m, i: (i % 2 == 0) == (m == "User")), lambda ok: ~ok)) == 0
    filled = F.forall(said, lambda s: _strip(s) != "")
    turns = F.transform(said, lambda s, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), _strip(s).alias("content")))
    return F.when((F.size(marks) > 0) & (F.size(marks) % 2 == 0) & right & filled & F.split(text, r"(?:User|Assistant|Assistent|Assistenz):")[0].rlike(r"^\s*$"), turns)


def folded_dialogue(turns: Column, roles: Column) -> Column:
    """One text of a dialogue of several speakers: ``name: text`` lines under the list of those who speak."""
    lines = F.transform(turns, lambda t: F.concat(t.role, F.lit(": "), t.content))
    return F.concat(F.lit("Speakers: "), F.array_join(roles, ", "), F.lit("\n"), F.array_join(lines, "\n"))


def tool_call_messages(query: Column, calls: Column) -> Column:
    """Messages of a question and its tool calls, a JSON array of objects; one tool_call message each."""
    each = F.from_json(calls, "array<struct<name:string,arguments:map<string,string>>>")
    asked = F.array(turn("user", query))
    return F.concat(asked, F.transform(each, lambda c: F.struct(F.lit("tool_call").alias("role"), F.to_json(c).alias("content"))))


def without(text: Column, characters: tuple[str, ...]) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def pick_one(questions: Column, answers: Column, key: Column, seed: int = 0) -> Column:
    """struct(question, answer): one of several, by a hash of the key; null where there is none."""
    n = F.least(F.size(questions), F.size(answers))
    at = F.pmod(F.xxhash64(F.lit(seed), key), F.greatest(n, F.lit(1))).cast("int")
    return F.when(n > 0, F.struct(F.get(questions, at).alias("question"), F.get(answers, at).alias("answer")))


def choice_answer(choices: Column, index: Column, rationale: Column) -> Column:
    """The chosen text (numbered from 0), after the rationale where there is one."""
    chosen = F.get(choices, index.cast("int"))
    return F.when(F.coalesce(rationale, F.lit("")) != "", F.concat(rationale, F.lit("\nAnswer: "), chosen)).otherwise(chosen)


def phrase_boxes(caption: Column, spans: Column) -> Column:
    """The caption with each span (begin, end, in characters from 0) in marks; null where spans overlap or leave the text."""
    s = F.array_sort(spans)
    bad = F.exists(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (F.get(s, i)["end"] > F.length(caption)) | (F.get(s, i)["begin"] >= F.get(s, i)["end"]) | ((i > 0) & (F.get(s, i)["begin"] < F.get(s, i - 1)["end"])))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    piece = lambda a, x: F.concat(a.out, F.substr(caption, a["at"] + 1, x.begin - a["at"]), F.lit("<ref-object>"), F.substr(caption, x.begin + 1, x.end - x.begin), F.lit("</ref-object><bbox>"))
    marked = F.aggregate(s, zero, lambda a, x: F.struct(piece(a, x).alias("out"), x.end.cast("int").alias("at")), lambda a: F.concat(a.out, F.substr(caption, a["at"] + 1)))
    return F.when(F.size(s) <= 0, caption).when(~bad, marked)


def detection_targets(categories: Column, names: list[str]) -> Column:
    """Names of category numbers; unknown numbers are null."""
    return F.transform(categories, lambda k: F.try_element_at(F.array(*map(F.lit, names)), F.when(k >= 0, k.cast("int") + 1)))


def loss_weights(response: Column, marks: dict[str, tuple[float, float]], query: Column | None = None, query_rules: dict[str, float] | None = None) -> Column:
    """array<struct<text, weight>>: the response cut before each mark; a mark and what follows it have the mark's two weights, all else 1.

    A query rule whose text the query holds gives the whole response one weight instead.
    """
    escaped = "|".join("".join("\\" + c if not c.isalnum() and c != " " else c for c in m) for m in marks)
    parts = F.regexp_extract_all(response, F.lit(rf"(?s)(?:{escaped})?(?:(?!{escaped}).)+|(?:{escaped})"), F.lit(0))
    one = lambda t, w: F.struct(t.alias("text"), F.lit(float(w)).alias("weight"))
    kind = "array<struct<text:string,weight:double>>"

    def cut(p: Column) -> Column:
        out = F.array(one(p, 1.0))
        for mark, (own, rest) in marks.items():
            out = F.when(p.startswith(mark), F.filter(F.array(one(F.lit(mark), own), one(F.substr(p, F.lit(len(mark) + 1)), rest)), lambda x: x.text != "")).otherwise(out)
        return out.cast(kind)

    out = F.flatten(F.transform(parts, cut))
    for text, weight in (query_rules or {}).items():
        out = F.when(query.contains(text), F.array(one(response, weight)).cast(kind)).otherwise(out)
    return out


def graph_free(df: DataFrame, order: str, limit: int | None = None, graphs: str = "graphs") -> DataFrame:
    """Rows without graphs; with a limit the first ones by ``order``, which is the evaluation's own."""
    free = df.where(F.coalesce(F.size(graphs), F.lit(0)) <= 0)
    return free if limit is None else free.orderBy(order).limit(limit)


def load_mix(sources: dict[str, DataFrame], ratio: float, key: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, val) of several sources: messages of each, split by the share for validation, united with ``source``."""
    train = val = None
    for name, df in sources.items():
        rows = D.train_val_split(keep_standard(auto_messages(df), (key,)).withColumn("source", F.lit(name)), ratio, key, seed)
        parts = rows.where("split = 'train'").drop("split"), rows.where("split = 'val'").drop("split")
        train, val = (p if old is None else old.unionByName(p, allowMissingColumns=True) for old, p in zip((train, val), parts))
    return train, val
