"""Ranking, similarity and reward metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urbanloom.functions.spatial import let


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))))


def paired_similarity(pairs: DataFrame, label: str = "label", buckets: int = 1 << 16) -> DataFrame:
    """One row: Pearson and Spearman of cosine, -Manhattan, -Euclidean and dot of (a, b) with the label.

    Spearman ranks are averages over ties. They come from counts of distinct values, summed over value ranges of fixed
    number, so no task sorts the whole table.
    """
    a, b = F.col("a"), F.col("b")
    kinds = {"cosine": cosine(a, b), "manhattan": -manhattan(a, b), "euclidean": -euclidean(a, b), "dot": dot(a, b)}
    scores = pairs.select(F.monotonically_increasing_id().alias("_row"), F.col(label).cast("double").alias("label"), *[v.alias(k) for k, v in kinds.items()])
    pearson = scores.agg(*[F.corr(k, "label").alias(f"pearson_{k}") for k in kinds])
    long = scores.select("_row", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("v")) for k in (*kinds, "label")])).alias("x")).select("_row", "x.kind", "x.v")
    ranks = average_ranks(long, ["kind"], "v")
    wide = ranks.groupBy("_row").agg(*[F.max(F.when(F.col("kind") == k, F.col("rank"))).alias(k) for k in (*kinds, "label")])
    spearman = wide.agg(*[F.corr(k, "label").alias(f"spearman_{k}") for k in kinds])
    return pearson.withColumn("_k", F.lit(1)).join(spearman.withColumn("_k", F.lit(1)), "_k").drop("_k")


def average_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows with ``rank``, ties sharing their mean rank; distinct values are counted first, and numbered by the width of their order of magnitude."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    bounds = counts.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    placed = counts.join(bounds, keys).withColumn("_b", F.coalesce(F.least(F.lit(1023), F.floor((F.col(value) - F.col("_lo")) / width * 1024)), F.lit(0)).cast("int")).drop("_lo", "_hi")
    totals = placed.groupBy(*keys, "_b").agg(F.sum("_n").alias("_t"))
    before = totals.select(*keys, "_b", (F.sum("_t").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_t")).alias("_before"))
    inside = F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy(value)) - F.col("_n")
    ranked = placed.withColumn("_in", inside).join(before, [*keys, "_b"]).withColumn("rank", F.col("_before") + F.col("_in") + (F.col("_n") + 1) / 2)
    return df.join(ranked.select(*keys, value, "rank"), [*keys, value])


def infonce(scored: DataFrame, temperature: float = 0.01, margin: float | None = None) -> DataFrame:
    """One row: mean positive, mean negative, mean (positive - hardest negative) and the contrastive value.

    ``scored``: (query, positive boolean, score). ``margin``: negatives over the positive by it are left out of the value.
    The value is a stable log-sum-exp of one query at a time.
    """
    pos = scored.where("positive").groupBy("query").agg(F.max("score").alias("p"))
    neg = scored.where("not positive").join(pos, "query")
    per = neg.groupBy("query", "p").agg(F.avg("score").alias("mean_neg"), F.max("score").alias("hard"), F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
    used = neg if margin is None else neg.where(F.col("score") <= F.col("p") + margin)
    top = used.groupBy("query").agg(F.max("score").alias("m"))
    top = pos.join(top, "query", "left").select("query", F.greatest("p", F.coalesce("m", "p")).alias("m"))
    tail = used.join(top, "query").groupBy("query").agg(F.sum(F.exp((F.col("score") - F.col("m")) / temperature)).alias("e"))
    value = top.join(pos, "query").join(tail, "query", "left").select(((F.col("m") - F.col("p")) / temperature + F.log(F.coalesce("e", F.lit(0.0)) + F.exp((F.col("p") - F.col("m")) / temperature))).alias("v"))
    a = per.agg(F.avg("p").alias("mean_pos"), (F.sum("s") / F.sum("n")).alias("mean_neg"), F.avg(F.col("p") - F.col("hard")).alias("mean_margin")).withColumn("_k", F.lit(1))
    return a.join(value.agg(F.avg("v").alias("infonce")).withColumn("_k", F.lit(1)), "_k").drop("_k")


def recall_at_k(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: share of queries with a relevant candidate among the first k, from (query, rank, relevant); mean reciprocal rank of the first."""
    first = ranked.groupBy("query").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("r"))
    return first.agg(*[F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks], F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"))


def query_groups(rows: DataFrame, key: str, order: str = "pos", label: str = "label") -> DataFrame:
    """The rows with ``grp``: a positive label opens the next group, in order within each key; rows before the first belong to group 0."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("grp", F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).over(w))


def rerank_metrics(rows: DataFrame, keys: tuple[str, ...], score: str = "score", label: str = "label", order: str = "pos") -> DataFrame:
    """One row: mean reciprocal rank and NDCG over groups of at least two rows with a relevant one; 0 where there are none."""
    w = Window.partitionBy(*keys)
    r = rows.withColumn("r", F.row_number().over(w.orderBy(F.desc(score), order))).withColumn("i", F.row_number().over(w.orderBy(F.desc(label), order)))
    gain = lambda at: (F.pow(F.lit(2.0), F.col(label)) - 1) / F.log2(F.col(at) + 1)
    g = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col(label) > 0, F.col("r"))).alias("first"), F.sum(gain("r")).alias("dcg"), F.sum(gain("i")).alias("idcg")).where("n >= 2 and first is not null")
    return g.agg(F.coalesce(F.avg(1 / F.col("first")), F.lit(0.0)).alias("mrr"), F.coalesce(F.avg(F.col("dcg") / F.col("idcg")), F.lit(0.0)).alias("ndcg"), F.count(F.lit(1)).alias("groups"))


def contrastive_value(distance: Column, label: Column, margin: float = 0.5) -> Column:
    return 0.5 * (label * distance * distance + (1 - label) * F.pow(F.greatest(F.lit(margin) - distance, F.lit(0.0)), 2))


def hard_pairs(rows: DataFrame, margin: float = 0.5) -> DataFrame:
    """One row: counts and loss sums of negatives closer than the farthest positive and positives farther than the nearest negative; rows (label, distance)."""
    far = rows.where("label = 1").agg(F.max("distance").alias("x"))
    near = rows.where("label = 0").agg(F.min("distance").alias("x"))
    hp = (F.col("label") == 1) & (F.col("distance") > near.scalar())
    hn = (F.col("label") == 0) & (F.col("distance") < far.scalar())
    return rows.agg(F.sum(hp.cast("int")).alias("hard_pos"), F.sum(hn.cast("int")).alias("hard_neg"), F.sum(F.when(hp, F.col("distance") * F.col("distance")).otherwise(0.0)).alias("pos_loss"), F.sum(F.when(hn, F.pow(F.greatest(margin - F.col("distance"), F.lit(0.0)), 2)).otherwise(0.0)).alias("neg_loss"))


def token_accuracy(predicted: Column, labels: Column, ignore: int = -100) -> Column:
    """struct(right, counted, all_right) of labels shifted by one against predictions, ignoring marked ones."""
    shifted = F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0)))
    hits = F.filter(F.zip_with(F.slice(predicted, F.lit(1), F.greatest(F.size(predicted) - 1, F.lit(0))), shifted, lambda p, y: F.when(y != ignore, (p == y).cast("int"))), lambda h: h.isNotNull())
    right = F.aggregate(hits, F.lit(0), lambda a, h: a + h)
    return F.struct(right.alias("right"), F.size(hits).alias("counted"), (right == F.size(hits)).alias("all_right"))


def grams(text: Column, n: int) -> Column:
    """All runs of n white-space words."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    return let(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda k: F.array_join(F.slice(w, k + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>")))


def repetition_penalty(text: Column, n: int = 3, most: float = -1.0) -> Column:
    """``(1 - distinct / total n-grams) * most``; 0 for short or empty texts."""
    return F.coalesce(let(grams(F.lower(text), n), lambda g: F.when(F.size(g) > 0, (1 - F.size(F.array_distinct(g)) / F.nullif(F.size(g), F.lit(0))) * most)), F.lit(0.0))


def overlong_penalty(length: Column, most: int, cache: int) -> Column:
    """min(-(length - (most - cache)) / cache, 0)."""
    return F.least(-(length - (most - cache)) / F.lit(float(cache)), F.lit(0.0))


def cosine_reward(right: Column, length: Column, most: int, low_right: float = 0.5, high_right: float = 1.0, low_wrong: float = 0.0, high_wrong: float = -0.5) -> Column:
    """Reward by a half cosine of the length: right answers gain by being short, wrong ones by being long."""
    c = F.cos(F.least(length / F.lit(float(most)), F.lit(1.0)) * 3.141592653589793)
    between = lambda lo, hi: lo + 0.5 * (hi - lo) * (1 + c)
    return F.when(right, between(low_right, high_right)).otherwise(between(low_wrong, high_wrong))


def think_answer_flag(text: Column) -> Column:
    return text.rlike(r"(?s)^<think>.*?</think>\s*<answer>.*?</answer>(?![\s\S])").cast("int")


def action_format_flag(text: Column) -> Column:
    return text.rlike(r"(?s)^<think>.*?</think>\s*Action:.*?Action Input:.*?$").cast("int")


def bare_answer(text: Column) -> Column:
    """Trimmed lower-case text without the marks of mathematics around it: dollars, brackets, a box, a full stop."""
    out = F.lower(F.trim(text))
    for mark, left in ((r"^\$+|\$+$", ""), (r"^\\[(\[]|\\[)\]]$", ""), (r"(?s)^\\boxed\{(.*)\}$", "$1"), (r"\.$", ""), (r"^\$+|\$+$", "")):
        out = F.trim(F.regexp_replace(out, mark, left))
    return out


def number_of(text: Column) -> Column:
    """The number that a bare answer is: digits with or without thousands' commas, a percentage, ``a/b`` or ``\\frac{a}{b}``; null for other texts and for a division by zero."""
    number = r"(-?[0-9]*\.?[0-9]+(?:e[-+]?[0-9]+)?)"
    plain = F.regexp_replace(text, r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")
    got = lambda pattern, k: F.nullif(F.regexp_extract(plain, pattern, k), F.lit("")).try_cast("double")
    slash, frac, percent = rf"^{number}\s*/\s*{number}$", rf"^(-?)\\[dt]?frac\{{{number}\}}\{{{number}\}}$", rf"^{number}\s*\\?%$"
    sign = F.when(F.regexp_extract(plain, frac, 1) == "-", -1.0).otherwise(1.0)
    return F.coalesce(plain.try_cast("double"), got(percent, 1) / 100, F.try_divide(got(slash, 1), got(slash, 2)), sign * F.try_divide(got(frac, 2), got(frac, 3)))


def answer_right(text: Column, solution: Column) -> Column:
    """Whether the text of ``<answer>``, else of the last box, equals the solution (or its ``<answer>``) as a bare text or as a number to 1e-9 of its size."""
    tagged = lambda t: F.nullif(F.regexp_extract(t, r"(?s)<answer>(.*?)</answer>", 1), F.lit(""))
    boxed = F.nullif(F.regexp_extract(text, r"(?s).*\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}", 1), F.lit(""))
    said, true = bare_answer(F.coalesce(tagged(text), boxed, F.lit(""))), bare_answer(F.coalesce(tagged(solution), solution))
    x, y = number_of(said), number_of(true)
    return F.coalesce((said == true) | (F.abs(x - y) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(y))), said == true)


def group_advantages(rows: DataFrame, group: str = "prompt_id", reward: str = "reward") -> DataFrame:
    """The rows with grpo (less the mean, over std + 1e-4) and rloo (less the mean of the others) advantages."""
    w = Window.partitionBy(group)
    mean, n, std = F.avg(reward).over(w), F.count(reward).over(w), F.coalesce(F.stddev_samp(reward).over(w), F.lit(0.0))
    centred = F.col(reward) - mean
    return rows.withColumn("grpo", centred / (std + 1e-4)).withColumn("rloo", F.when(n > 1, centred * n / F.nullif(n - 1, F.lit(0))).otherwise(0.0))


def whitened_advantages(rows: DataFrame, group: str = "prompt_id", reward: str = "reward", base: str = "grpo", by: str = "batch") -> DataFrame:
    """The rows with ``advantage``: the reward less the group's mean (``grpo``) or the mean of the others (``rloo``), over a deviation + 1e-4.

    ``by``: that of the group's rewards, of all rewards (``batch``), or of all advantages (``advantages``); ``none`` divides by
    nothing. A group of one row has 0 under rloo; an undefined deviation is 0.
    """
    w = Window.partitionBy(group)
    n, centred = F.count(reward).over(w), F.col(reward) - F.avg(reward).over(w)
    rows = rows.withColumn("advantage", centred if base == "grpo" else F.when(n > 1, centred * n / F.nullif(n - 1, F.lit(0))).otherwise(0.0))
    if by == "none":
        return rows
    if by == "group":
        std = F.coalesce(F.stddev_samp(reward).over(w), F.lit(0.0))
    else:
        std = rows.agg(F.coalesce(F.stddev_samp(reward if by == "batch" else "advantage"), F.lit(0.0)).alias("s")).scalar()
    return rows.withColumn("advantage", F.col("advantage") / (std + 1e-4))


def variable_group_advantages(rows: DataFrame, prompt: str = "prompt_id", request: str = "request_id", order: str = "pos", reward: str = "reward") -> DataFrame:
    """Of each request its last row; rewards of a request that differ by more than 1e-6 raise; then advantages by prompt."""
    g = rows.groupBy(prompt, request).agg(F.max_by(reward, order).alias(reward), (F.max(reward) - F.min(reward)).alias("_d"))
    checked = g.withColumn(reward, F.when(F.col("_d") > 1e-6, F.raise_error(F.lit("rewards of a request differ")).cast("double")).otherwise(F.col(reward))).drop("_d")
    return group_advantages(checked, prompt, reward)


def drop_flat_groups(rows: DataFrame, group: str = "prompt_id", reward: str = "reward") -> DataFrame:
    """Rows of groups whose rewards differ."""
    live = rows.groupBy(group).agg(F.stddev_samp(reward).alias("s")).where("s > 0").select(group)
    return rows.join(live, group, "left_semi")


def weighted_reward(columns: list[str], weights: list[float]) -> Column:
    """Sum of columns times weights; nulls count as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in zip(columns, weights)])


def minmax_scores(rows: DataFrame, group: str, score: str) -> DataFrame:
    """The rows with ``scaled``: (x - min) / (max - min + 1e-5) of each group; of a constant group min(1, x), but 0 if that is negative."""
    w = Window.partitionBy(group)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return rows.withColumn("scaled", F.when(hi == lo, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))).otherwise((F.col(score) - lo) / (hi - lo + 1e-5)))


def best_of_n(choices: DataFrame, n: int = 2, weight: float = 10.0) -> DataFrame:
    """(uuid, item, rejected, score): the n best choices by prm + weight * orm as positives, each with the worst as rejected.

    Groups whose choices all score alike are dropped; the worst is never a positive. Ties go to the smaller item.
    """
    s = choices.withColumn("score", F.col("prm") + weight * F.col("orm"))
    w = Window.partitionBy("uuid")
    r = s.withColumn("best", F.row_number().over(w.orderBy(F.desc("score"), "item"))).withColumn("spread", F.max("score").over(w) - F.min("score").over(w)).where("spread > 0")
    worst = r.groupBy("uuid").agg(F.min(F.struct("score", F.col("best").alias("b"), "item")).alias("w")).select("uuid", F.col("w.item").alias("rejected"))
    return r.where(F.col("best") <= n).join(worst, "uuid").where("item <> rejected").select("uuid", "item", "rejected", "score")


def text_overlap(rows: DataFrame, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """The rows with rouge_1, rouge_2, rouge_l (F measures) and bleu_4, times 100, on white-space words; empty sides are skipped.

    The longest common subsequence is one row of its table at a time in an ``aggregate``.
    """
    p, r = F.col(prediction), F.col(reference)
    kept = rows.where((F.trim(p) != "") & (F.trim(r) != "")).withColumns({f"_{side}{n}": grams(c, n) for side, c in (("p", p), ("r", r)) for n in (1, 2, 3, 4)})

    def overlap(a: Column, b: Column) -> Column:
        times = lambda g, x: F.size(F.filter(g, lambda y: y == x))
        return F.aggregate(F.transform(F.array_distinct(a), lambda x: F.least(times(a, x), times(b, x))), F.lit(0), lambda s, v: s + v)

    def f_measure(hit: Column, a: Column, b: Column) -> Column:
        return F.when((F.size(a) > 0) & (F.size(b) > 0), 2 * hit / F.nullif(F.size(a) + F.size(b), F.lit(0))).otherwise(0.0) * 100

    def lcs(a: Column, b: Column) -> Column:
        zero = F.transform(F.concat(F.array(F.lit("")), b), lambda _: F.lit(0))
        row = lambda before, x: F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), lambda now, j: F.concat(now, F.array(F.when(F.get(b, j - 1) == x, F.get(before, j - 1) + 1).otherwise(F.greatest(F.get(before, j), F.get(now, j - 1))))))
        return F.element_at(F.aggregate(a, zero, row), -1)

    g = {n: (F.col(f"_p{n}"), F.col(f"_r{n}")) for n in (1, 2, 3, 4)}
    shares = [(overlap(*g[n]) + (0.1 if n > 1 else 0.0)) / F.nullif(F.greatest(F.size(g[n][0]), F.lit(1)) + (0.1 if n > 1 else 0.0), F.lit(0.0)) for n in g]
    brevity = F.when(F.size(g[1][0]) >= F.size(g[1][1]), 1.0).otherwise(F.exp(1 - F.size(g[1][1]) / F.nullif(F.size(g[1][0]), F.lit(0))))
    bleu = F.when(overlap(*g[1]) > 0, brevity * F.exp(reduce(lambda a, b: a + b, [F.log(s) for s in shares]) / 4)).otherwise(0.0) * 100
    return kept.withColumns({"rouge_1": f_measure(overlap(*g[1]), *g[1]), "rouge_2": f_measure(overlap(*g[2]), *g[2]), "rouge_l": f_measure(lcs(g[1][0], g[1][1]), *g[1]), "bleu_4": bleu}).drop(*[f"_{side}{n}" for side in "pr" for n in g])
