"""Search metrics scored in blocks against the same metrics over a table of all pairs, and what leaves the tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urbanloom.operators import metrics as M
from urbanloom.operators import searches as X


def rows(spark):
    rng = np.random.default_rng(5)
    out = [[i, rng.standard_normal(6).tolist(), int(rng.integers(0, 5))] for i in range(230)]
    for i in range(0, 200, 3):  # copies, so ties decide
        out[i][1] = out[i % 30][1]
    out[7][1], out[11][1], out[40][1], out[44][1], out[60][1] = None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [0.0] * 6, [float("nan")] + [1.0] * 5, [1.0, 2.0]
    out[20][2] = out[21][2] = None
    out[80][2] = 99  # a query alone with its label
    return spark.createDataFrame([*map(tuple, out), (None, [1.0] * 6, 1)], "cand long, vector array<double>, label int")


@pytest.mark.parametrize("block", [(8192, 4096), (7, 50)])
def test_search_metrics_equal_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(X, "QUERIES", block[0])
    monkeypatch.setattr(X, "CANDIDATES", block[1])
    monkeypatch.setattr(X, "TILE", (3, 17))
    v = rows(spark)
    q = v.where("cand % 20 = 0").withColumnRenamed("cand", "query")
    pairs = q.select("query", F.col("vector").alias("a"), F.col("label").alias("l")).crossJoin(v).where("query <> cand").select("query", "cand", (F.col("l") == F.col("label")).alias("relevant"), M.cosine(F.col("a"), F.col("vector")).alias("score"))
    want = M.recall_at_k(pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cand")))).first()
    assert tuple(X.search_recall(q, v).first()) == pytest.approx(tuple(want), abs=1e-12)
    finite = v.where("cand is null or cand <> 44")  # not a number: spreads into every mean
    for t, margin in ((0.05, None), (0.01, 0.1)):
        for vectors, scored in ((finite, pairs.where("cand <> 44")), (v, pairs)):
            want = M.infonce(scored.select("query", F.col("relevant").alias("positive"), "score"), t, margin).first()
            got = X.search_infonce(q, vectors, t, margin).first()
            assert tuple(got)[1:] == pytest.approx(tuple(want), abs=1e-9, nan_ok=True)
            assert got.queries == scored.where("relevant").select("query").distinct().count()


def test_no_pair_leaves_its_task(spark):
    """Only rows a query and block are exchanged after the scoring; joined pairs would be in the plan as a join under the aggregate."""
    v = rows(spark)
    plan = X.best_of_label(v.where("cand % 20 = 0").withColumnRenamed("cand", "query"), v)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "Join" not in plan
    assert X.search_recall(v.where("cand = 20").withColumnRenamed("cand", "query"), v.where("cand = 20")).first().mrr is None
