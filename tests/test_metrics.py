import numpy as np
from pyspark.sql import functions as F

from urbanloom.operators import metrics as M
from urbanloom.plans import metric_queries as Q


def test_query_set_of_searches_against_brute_force(spark, tmp_path):
    """All ids divisible by 20 are queries, not only those divisible by 50; all other rows are candidates."""
    rng = np.random.default_rng(8)
    n = 400
    x, label = rng.standard_normal((n, 8)), rng.integers(0, 4, n)
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    firsts, pos, neg, margin, loss = [], [], [], [], []
    for q in range(0, n, 20):
        others = np.array([c for c in range(n) if c != q])
        s, same = unit[others] @ unit[q], label[others] == label[q]
        firsts.append(1 + np.flatnonzero(same[np.argsort(-s, kind="stable")])[0])
        p, z = s[same].max(), s[~same]
        pos.append(p)
        neg.append(z)
        margin.append(p - z.max())
        loss.append(np.log(np.exp((z - p) / 0.05).sum() + 1))
    firsts = np.array(firsts)
    got = Q.k5_recall_at_k_20(spark, str(tmp_path)).first()
    assert np.allclose([got[f"recall_{k}"] for k in (1, 3, 5, 10)] + [got.mrr], [*((firsts <= k).mean() for k in (1, 3, 5, 10)), (1 / firsts).mean()], atol=1e-6)
    got = Q.k2_infonce_20(spark, str(tmp_path)).first()
    assert np.allclose([got.mean_pos, got.mean_neg, got.mean_margin], [np.mean(pos), np.concatenate(neg).mean(), np.mean(margin)], atol=1e-5)
    assert np.isclose(got.infonce, np.mean(loss), atol=1e-4)


def test_answers_as_numbers(spark):
    cases = [
        ("<answer>1/2</answer>", "0.5", True), ("<answer> 50% </answer>", "1/2", True), (r"so \boxed{\frac{3}{4}}", "0.75", True), (r"<answer>$\boxed{-\dfrac{1}{8}}$</answer>", "-0.125", True),
        ("<answer>1,234,567</answer>", "1234567", True), ("<answer>1,2</answer>", "12", False), ("<answer>x + 1.</answer>", "X + 1", True), ("<answer>1/0</answer>", "0", False), ("12", "12", False),
        (r"\boxed{1} then \boxed{2}", "<answer>2</answer>", True), ("<answer>1e3</answer>", "1000", True), ("<answer></answer>", "3", False), (None, "1", None), ("<answer>1</answer>", None, None), (r"<answer>12\%</answer>", "0.12", True), (r"<answer>\(7\)</answer>", "7", True)]
    rows = spark.createDataFrame(cases, "t string, s string, want boolean")
    got = [(r.t, r.s, r.got) for r in rows.select("t", "s", M.answer_right(F.col("t"), F.col("s")).alias("got")).collect()]
    assert [g or False for *_, g in got] == [w or False for *_, w in cases], [x for x, c in zip(got, cases, strict=True) if (x[2] or False) != (c[2] or False)]
