"""Metric queries on embeddings, events, line items and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.operators import metrics as M
from urbanloom.operators import searches as X
from urbanloom.sources.fixtures import table

from .registry import query

COS = "list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))"
PAIRS = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), p AS (SELECT x.vec_id, x.e AS a, y.e AS b, CASE WHEN x.label = y.label THEN 1 ELSE 0 END AS label FROM v x JOIN v y ON y.vec_id = x.vec_id + 1)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    y = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"), F.col("label").alias("l2"))
    return v.join(y, "vec_id").select("vec_id", F.col("embedding").alias("a"), "b", (F.col("label") == F.col("l2")).cast("int").alias("label"))


@query(PAIRS + f""", s AS (SELECT label, {COS} AS c, -list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) AS m, -list_distance(a, b) AS e, list_dot_product(a, b) AS d FROM p),
r AS (SELECT *, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS rc, rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2.0 AS rl FROM s)
SELECT round(corr(c, label), 5) AS pearson_cosine, round(corr(m, label), 5) AS pearson_manhattan, round(corr(e, label), 5) AS pearson_euclidean, round(corr(d, label), 5) AS pearson_dot, round(corr(rc, rl), 5) AS spearman_cosine FROM r""")
def k1_paired_similarity(spark: SparkSession, d: str) -> DataFrame:
    m = M.paired_similarity(_pairs(spark, d))
    return m.select(*[F.round(c, 5).alias(c) for c in ("pearson_cosine", "pearson_manhattan", "pearson_euclidean", "pearson_dot", "spearman_cosine")])


#: Queries are the vectors whose id is divisible by 20, the stated query set; all other vectors are candidates.
RANKED = f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), s AS (SELECT query, cand, relevant, {COS} AS score FROM (
SELECT q.vec_id AS query, c.vec_id AS cand, q.label = c.label AS relevant, q.e AS a, c.e AS b FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id))
"""


def _search(spark: SparkSession, d: str, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """The queries, the ids divisible by ``every``, and the candidates."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("cand"), F.col("embedding").alias("vector"), "label")
    return v.where(F.col("cand") % every == 0).withColumnRenamed("cand", "query"), v


def _recall(spark: SparkSession, d: str) -> DataFrame:
    return X.search_recall(*_search(spark, d)).withColumn("mrr", F.round("mrr", 6))


def _contrast(spark: SparkSession, d: str) -> DataFrame:
    m = X.search_infonce(*_search(spark, d), 0.05)
    return m.select(F.round("mean_pos", 5).alias("mean_pos"), F.round("mean_neg", 5).alias("mean_neg"), F.round("mean_margin", 5).alias("mean_margin"), F.round("infonce", 4).alias("infonce"))


RECALL = """, f AS (SELECT query, min(r) FILTER (WHERE relevant) AS r FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, cand) AS r FROM s) GROUP BY query)
SELECT avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END) AS recall_1, avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END) AS recall_3, avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END) AS recall_5, avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END) AS recall_10, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM f"""


@query(RANKED + RECALL)
def k5_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d)


@query(RANKED + RECALL)
def k5_recall_at_k_20(spark: SparkSession, d: str) -> DataFrame:
    """The same metrics under the name they had while k5_recall_at_k had fewer queries."""
    return _recall(spark, d)


CONTRAST = """, p AS (SELECT query, max(score) AS p FROM s WHERE relevant GROUP BY query), n AS (SELECT s.query, p, score FROM s JOIN p ON p.query = s.query WHERE NOT relevant),
g AS (SELECT query, p, max(score) AS hard, sum(score) AS t, count(*) AS c, greatest(p, max(score)) AS m FROM n GROUP BY query, p),
l AS (SELECT g.query, (any_value(m) - any_value(g.p)) / 0.05 + ln(sum(exp((score - m) / 0.05)) + exp((any_value(g.p) - any_value(m)) / 0.05)) AS v FROM g JOIN n ON n.query = g.query GROUP BY g.query)
SELECT round(avg(p), 5) AS mean_pos, round(sum(t) / sum(c), 5) AS mean_neg, round(avg(p - hard), 5) AS mean_margin, round((SELECT avg(v) FROM l), 4) AS infonce FROM g"""


@query(RANKED + CONTRAST)
def k2_infonce(spark: SparkSession, d: str) -> DataFrame:
    """Contrastive metrics of the query set (K2, K3)."""
    return _contrast(spark, d)


@query(RANKED + CONTRAST)
def k2_infonce_20(spark: SparkSession, d: str) -> DataFrame:
    """The same metrics under the name they had while k2_infonce had fewer queries."""
    return _contrast(spark, d)


@query("""WITH g AS (SELECT *, sum(label) OVER (PARTITION BY user_id ORDER BY pos) AS grp FROM scored), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY score DESC, pos) AS r, row_number() OVER (PARTITION BY user_id, grp ORDER BY label DESC, pos) AS i FROM g),
m AS (SELECT user_id, grp, count(*) AS n, min(CASE WHEN label > 0 THEN r END) AS f, sum((pow(2, label) - 1) / log2(r + 1)) AS d, sum((pow(2, label) - 1) / log2(i + 1)) AS x FROM r GROUP BY ALL HAVING n >= 2 AND f IS NOT NULL)
SELECT round(avg(1.0 / f), 6) AS mrr, round(avg(d / x), 6) AS ndcg, count(*) AS groups FROM m""")
def k4_rerank_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank and NDCG of groups that positive labels open."""
    m = M.rerank_metrics(M.query_groups(table(spark, d, "scored"), "user_id"), ("user_id", "grp"))
    return m.select(F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"), "groups")


@query("SELECT pos, user_id, CAST(sum(label) OVER (PARTITION BY user_id ORDER BY pos) AS BIGINT) AS grp FROM scored")
def g7_group_by_boundary(spark: SparkSession, d: str) -> DataFrame:
    return M.query_groups(table(spark, d, "scored"), "user_id").select("pos", "user_id", "grp")


@query(PAIRS + f"SELECT round(avg(0.5 * (label * (1 - c) * (1 - c) + (1 - label) * pow(greatest(0.5 - (1 - c), 0), 2))), 6) AS contrastive FROM (SELECT label, {COS} AS c FROM p)")
def k6_contrastive_value(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).select("label", (1 - M.cosine(F.col("a"), F.col("b"))).alias("distance"))
    return p.agg(F.round(F.avg(M.contrastive_value(F.col("distance"), F.col("label"))), 6).alias("contrastive"))


@query(PAIRS + f""", d AS (SELECT label, 1 - {COS} AS x FROM p), b AS (SELECT max(x) FILTER (WHERE label = 1) AS far, min(x) FILTER (WHERE label = 0) AS near FROM d)
SELECT sum(CASE WHEN label = 1 AND x > near THEN 1 ELSE 0 END) AS hard_pos, sum(CASE WHEN label = 0 AND x < far THEN 1 ELSE 0 END) AS hard_neg, round(sum(CASE WHEN label = 1 AND x > near THEN x * x ELSE 0 END), 5) AS pos_loss, round(sum(CASE WHEN label = 0 AND x < far THEN pow(greatest(0.5 - x, 0), 2) ELSE 0 END), 5) AS neg_loss FROM d, b""")
def k7_hard_pairs(spark: SparkSession, d: str) -> DataFrame:
    h = M.hard_pairs(_pairs(spark, d).select("label", (1 - M.cosine(F.col("a"), F.col("b"))).alias("distance")))
    return h.select("hard_pos", "hard_neg", F.round("pos_loss", 5).alias("pos_loss"), F.round("neg_loss", 5).alias("neg_loss"))


GRAMS = "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(lower(text), ' \t\n\x0b\f\r'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)"


@query(GRAMS + ", g AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) ELSE [] END AS g FROM w) SELECT doc_id, CASE WHEN len(g) > 0 THEN round((1 - len(list_distinct(g)) * 1.0 / len(g)) * -1, 6) ELSE 0 END + 0.0 AS penalty FROM g")
def k14_repetition_penalty(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", (F.round(M.repetition_penalty(F.col("text")), 6) + F.lit(0.0)).alias("penalty"))


@query("SELECT doc_id, least(-(n_chars - 1000) / 1000.0, 0.0) + 0.0 AS penalty, round(CASE WHEN n_chars % 2 = 0 THEN 0.5 + 0.25 * (1 + cos(least(n_chars / 4000.0, 1.0) * 3.141592653589793)) ELSE -0.25 * (1 + cos(least(n_chars / 4000.0, 1.0) * 3.141592653589793)) END, 6) + 0.0 AS reward FROM documents")
def k13_length_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Length rewards and penalties."""
    n = F.col("n_chars")
    reward = F.round(M.cosine_reward(n % 2 == 0, n, 4000), 6) + F.lit(0.0)
    return table(spark, d, "documents").select("doc_id", (M.overlong_penalty(n, 2000, 1000) + F.lit(0.0)).alias("penalty"), reward.alias("reward"))


ADVANTAGE = "SELECT prompt_id, request_id, reward, avg(reward) OVER w AS m, count(*) OVER w AS n, coalesce(stddev_samp(reward) OVER w, 0) AS s FROM rewards WINDOW w AS (PARTITION BY prompt_id)"


@query(f"SELECT prompt_id, request_id, round((reward - m) / (s + 1e-4), 5) + 0.0 AS grpo, round(CASE WHEN n > 1 THEN (reward - m) * n / (n - 1) ELSE 0 END, 6) + 0.0 AS rloo FROM ({ADVANTAGE})")
def k18_group_advantage(spark: SparkSession, d: str) -> DataFrame:
    a = M.group_advantages(table(spark, d, "rewards"))
    return a.select("prompt_id", "request_id", (F.round("grpo", 5) + F.lit(0.0)).alias("grpo"), (F.round("rloo", 6) + F.lit(0.0)).alias("rloo"))


@query("SELECT prompt_id, request_id FROM rewards WHERE prompt_id IN (SELECT prompt_id FROM rewards GROUP BY prompt_id HAVING stddev_samp(reward) > 0)")
def k20_drop_flat_groups(spark: SparkSession, d: str) -> DataFrame:
    return M.drop_flat_groups(table(spark, d, "rewards")).select("prompt_id", "request_id")


@query("SELECT l_orderkey, l_linenumber, round(coalesce(CAST(l_discount AS DOUBLE) * 0.7, 0) + coalesce(CAST(l_tax AS DOUBLE) * 0.3, 0), 6) AS reward FROM lineitem")
def k21_weighted_reward(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").cast("double"), F.col("l_tax").cast("double"))
    return rows.select("l_orderkey", "l_linenumber", F.round(M.weighted_reward(["l_discount", "l_tax"], [0.7, 0.3]), 6).alias("reward"))


@query("SELECT prompt_id, request_id, round(CASE WHEN hi = lo THEN greatest(0, least(1, reward)) ELSE (reward - lo) / (hi - lo + 1e-5) END, 6) AS scaled FROM (SELECT *, min(reward) OVER w AS lo, max(reward) OVER w AS hi FROM rewards WINDOW w AS (PARTITION BY prompt_id))")
def k22_minmax_scores(spark: SparkSession, d: str) -> DataFrame:
    return M.minmax_scores(table(spark, d, "rewards"), "prompt_id", "reward").select("prompt_id", "request_id", F.round("scaled", 6).alias("scaled"))


@query("""WITH s AS (SELECT l_orderkey AS uuid, l_linenumber AS item, CAST(l_quantity AS DOUBLE) + 10 * CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS score FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY score DESC, item) AS b, max(score) OVER (PARTITION BY uuid) - min(score) OVER (PARTITION BY uuid) AS d FROM s),
w AS (SELECT uuid, arg_min(item, (score, b)) AS rejected FROM r WHERE d > 0 GROUP BY uuid)
SELECT r.uuid, item, rejected, score FROM r JOIN w ON w.uuid = r.uuid WHERE d > 0 AND b <= 2 AND item <> rejected""")
def k23_best_of_n(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("uuid"), F.col("l_linenumber").alias("item"), F.col("l_quantity").cast("double").alias("prm"), F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("orm"))
    return M.best_of_n(c)
