"""Dataset preparation on conversation tables: messages, validation, sampling, mixing, sharding, packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .rounds import numbered, ranged, settled
from .spatial_joins import number_rows

# Role names of the accepted message formats.
ROLE_ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "observation": "tool_response", "function_call": "tool_call"}
ROLES = ("system", "user", "assistant", "tool_call", "tool_response", "tool")


def messages_of_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, messages): turns in order as array<struct<role, content>>, role aliases resolved, a system turn first."""
    role = F.col("role")
    for alias, name in ROLE_ALIASES.items():
        role = F.when(F.col("role") == alias, name).otherwise(role)
    rows = turns.select(key, order, role.alias("role"), F.col("text").alias("content"))
    ordered = F.array_sort(F.collect_list(F.struct((F.col("role") != "system").cast("int").alias("s"), order, "role", "content")))
    return rows.groupBy(key).agg(F.transform(ordered, lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))).alias("messages"))


def valid_messages(messages: Column) -> Column:
    """At least one message, known roles, contents present."""
    return F.coalesce((F.size(messages) > 0) & F.forall(messages, lambda m: m.role.isin(*ROLES) & m.content.isNotNull()), F.lit(False))


def query_response(query: Column, response: Column, system: Column | None = None) -> Column:
    """Messages of one question and its answer, after a system message where there is one."""
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    body = F.array(m("user", query), m("assistant", response))
    return body if system is None else F.when(system.isNotNull() & (system != ""), F.concat(F.array(m("system", system)), body)).otherwise(body)


def instruction_input(instruction: Column, extra: Column) -> Column:
    """``instruction`` and ``input`` on two lines, of those that are filled."""
    return F.concat_ws("\n", F.nullif(instruction, F.lit("")), F.nullif(extra, F.lit("")))


def normalise_box(box: Column) -> Column:
    """Boxes of four numbers with x1 <= x2 and y1 <= y2; points of two stay; others are null."""
    return F.when(F.size(box) == 4, F.array(F.least(box[0], box[2]), F.least(box[1], box[3]), F.greatest(box[0], box[2]), F.greatest(box[1], box[3]))).when(F.size(box) == 2, box)


def classification_prompt(task: str, labels: list[str], text: Column) -> Column:
    return F.concat(F.lit(f"Task: {task}\nLabels: {', '.join(labels)}\nSentence: "), text, F.lit("\nLabel:"))


def seeded_order(df: DataFrame, key: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key))


def sample_n(df: DataFrame, n: int, key: str, seed: int | None = None) -> DataFrame:
    """n rows: whole copies while n is at least the table, then the rows of the smallest keys (or seeded hashes); ``copy`` numbers them."""
    total = df.count()
    if not total:
        return df.withColumn("copy", F.lit(1))
    whole, rest = divmod(n, total)
    first = F.col(key) if seed is None else seeded_order(df, key, seed)
    ranked = numbered(df.withColumn("_h", first), ["_h", key], "_r")
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_r") < rest, whole + 1).otherwise(whole), F.lit(1)))).where(F.col("copy") >= 1).drop("_h", "_r") if whole else ranked.where(F.col("_r") < rest).withColumn("copy", F.lit(1)).drop("_h", "_r")


def train_val_split(df: DataFrame, ratio: float, key: str, seed: int = 0) -> DataFrame:
    """The rows with ``split``: exactly max(1, floor(n * ratio)) rows by seeded hash are val (all if ratio is 1)."""
    ranked = numbered(df.withColumn("_h", seeded_order(df, key, seed)), ["_h", key], "_r")
    n = df.count()
    val = n if ratio >= 1 else max(1, int(n * ratio)) if ratio > 0 else 0
    return ranked.withColumn("split", F.when(F.col("_r") < val, "val").otherwise("train")).drop("_h", "_r")


def interleave(sources: list[DataFrame], shares: list[float], key: str, seed: int = 0, until: str = "first") -> DataFrame:
    """The rows of all sources with ``source`` and ``draw``: each place draws a source by its share; a source's rows come in key order.

    A source's rows arrive with seeded exponential gaps whose rate is its share, so the next arrival over all sources is
    of each with the odds of its share. ``until``: ``first`` ends with the last row of the source that runs out first,
    ``all`` gives every row. Sources of share 0 give none.
    """
    total, united = sum(shares), None
    for i, (df, share) in enumerate(zip(sources, shares)):
        if share <= 0:
            continue
        rows = ranged(df.withColumn("_k", F.col(key)), ["_k"])
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col("_k")), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
        rows = rows.withColumn("_g", -F.log(u) * (total / share))
        held = rows.groupBy("_b").agg(F.sum("_g").alias("_t"))
        starts = held.select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_s"))  # a row a range
        arrived = F.sum("_g").over(Window.partitionBy("_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("_a", arrived).join(F.broadcast(starts), "_b").withColumn("_a", F.col("_a") + F.col("_s")).drop("_b", "_g", "_s", "_k").withColumn("source", F.lit(i))
        united = rows if united is None else united.unionByName(rows, allowMissingColumns=True)
    if united is None:
        return sources[0].where("false").withColumn("source", F.lit(0)).withColumn("draw", F.lit(0).cast("long"))
    united = settled(united)
    if until == "first":
        stop = united.groupBy("source").agg(F.max("_a").alias("last")).agg(F.min("last").alias("stop"))
        united = united.where(F.col("_a") <= stop.select("stop").scalar())
    return numbered(united, ["_a", "source"], "draw").drop("_a")


def shard_batches(df: DataFrame, key: str, batch: int, drop_last: bool = False) -> DataFrame:
    """The rows with ``batch_id``: consecutive batches of ``batch`` rows by key."""
    out = numbered(df, [key], "_r").withColumn("batch_id", F.floor(F.col("_r") / batch)).drop("_r")
    if not drop_last:
        return out
    full = out.groupBy("batch_id").count().where(F.col("count") == batch).select("batch_id")
    return out.join(full, "batch_id", "left_semi")


def mismatched_pairs(df: DataFrame, batch: str, order: str, answer: str) -> DataFrame:
    """The rows with ``other``: the previous row's answer in the batch; the first takes the last one's. Large batches are split into ranges."""
    rows = ranged(df, [batch, order])
    ends = rows.groupBy(batch, "_b").agg(F.max_by(F.struct(F.col(answer).alias("a")), order).alias("_e"))
    w = Window.partitionBy(batch).orderBy("_b")
    ends = ends.select(batch, "_b", F.coalesce(F.lag("_e").over(w), F.last("_e").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_e"))
    before = F.lag(F.struct(F.col(answer).alias("a"))).over(Window.partitionBy(batch, "_b").orderBy(order))
    return rows.withColumn("_l", before).join(ends, [batch, "_b"]).withColumn("other", F.coalesce("_l", "_e").a).drop("_l", "_e", "_b")


def random_k(df: DataFrame, cell: str, key: str, k: int = 3, seed: int = 0) -> DataFrame:
    """At most k rows of each cell, by the seeded hash of the key."""
    place = F.row_number().over(Window.partitionBy(cell).orderBy(seeded_order(df, key, seed), key))
    return df.withColumn("_r", place).where(F.col("_r") <= k).drop("_r")


def union_all(sources: list[DataFrame]) -> DataFrame:
    """All rows of all sources with ``source``, the number of theirs."""
    out = None
    for i, df in enumerate(sources):
        one = df.withColumn("source", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def sample_negatives(df: DataFrame, key: str, answer: str, k: int = 7, buckets: int = 64, seed: int = 0) -> DataFrame:
    """(key, negatives) of every row: k distinct answers of other rows that are not its own, drawn from all of them; no driver list.

    There are fewer where the table has fewer. A null is no answer: it is never drawn, and its row draws from all. Each
    row draws k + 1 numbers of the pool without replacement (Floyd's method); its own answer, or else one of them, goes.
    The pool is numbered in ``buckets`` hash parts.
    """
    total = df.select(F.countDistinct(answer)).first()[0]
    pool = number_rows(df.select(F.col(answer).alias("_n")).where("_n is not null").distinct(), ["_n"], 0, buckets).withColumnRenamed("id", "_p")
    tops = F.array(*[F.lit(j) for j in range(max(0, total - k - 1), total)]).cast("array<long>")

    def draw(drawn: Column, top: Column) -> Column:
        at = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(answer), top), top + 1)
        return F.concat(drawn, F.array(F.when(F.array_contains(drawn, at), top).otherwise(at)))

    asked = df.groupBy(key, answer).agg(F.count(F.lit(1)).alias("_c")).withColumn("_p", F.aggregate(tops, F.array().cast("array<long>"), draw))
    both = asked.select(key, answer, "_c", F.explode_outer("_p").alias("_p")).join(pool, "_p", "left")
    other = F.when(F.col("_n").isNotNull() & ~F.col("_n").eqNullSafe(F.col(answer)), F.struct(F.xxhash64(F.lit(seed + 1), F.col(key), F.col(answer), F.col("_n")).alias("h"), "_n"))
    few = F.slice(F.array_sort(F.collect_list(other)), 1, k)
    rows = both.groupBy(key, answer, "_c").agg(F.array_sort(F.transform(few, lambda x: x["_n"])).alias("negatives"))
    return rows.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), "_c"))).select(key, "negatives")


def map_rows(df: DataFrame, function, schema: str, error: str | None = None) -> DataFrame:
    """A custom function of a row dict that returns a dict, a list of dicts or None.

    Rows at which it raises a KeyError, TypeError or ValueError come back as one row of nulls with what was raised in the column ``error``;
    without such a column they are dropped, as where bad rows are expected.
    """
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[dict] = []
            for row in pdf.to_dict("records"):
                try:
                    got = function(row)
                except (KeyError, TypeError, ValueError) as e:
                    got = {error: f"{type(e).__name__}: {e}"} if error else None
                out += got if isinstance(got, list) else [got] if got is not None else []
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in out], dtype=object) for c in ([*names, error] if error else names)})

    return df.mapInPandas(run, f"{schema}, {error} string" if error else schema)


def windowed_dialogues(rows: DataFrame, key: str, order: str, starts: Column) -> DataFrame:
    """The rows with ``dialogue``: a running count of starts in order within each key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("dialogue", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def first_of_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, copies): the smallest key of each text; rows without text all stay."""
    same = df.where(F.col(text).isNotNull()).groupBy(text).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies")).select(key, "copies")
    return same.unionByName(df.where(F.col(text).isNull()).select(key, F.lit(1).cast("long").alias("copies")))


def fill_by_mode(df: DataFrame, name: str, value: str) -> DataFrame:
    """The rows whose missing values are those that their name has most often, ties to the smallest."""
    n = df.where(F.col(value).isNotNull()).groupBy(name, value).agg(F.count(F.lit(1)).alias("_n"))
    mode = n.groupBy(name).agg(F.min(F.struct((-F.col("_n")).alias("m"), F.col(value).alias("v"))).alias("_m")).select(name, F.col("_m.v").alias("_v"))
    return df.join(mode, name, "left").withColumn(value, F.coalesce(value, "_v")).drop("_v")
