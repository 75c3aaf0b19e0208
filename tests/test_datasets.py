from pyspark.sql import functions as F

from urbanloom.functions import text as T
from urbanloom.operators import datasets as D
from urbanloom.operators import metrics as M


def test_split_and_sample(spark):
    rows = spark.range(95).select(F.col("id").alias("k"))
    assert {r.split: r["count"] for r in D.train_val_split(rows, 0.1, "k").groupBy("split").count().collect()} == {"val": 9, "train": 86}
    assert D.sample_n(rows, 200, "k", seed=1).count() == 200
    assert D.sample_n(rows.limit(0), 5, "k").count() == 0


def test_negatives_come_from_the_whole_pool(spark):
    answers = [f"a{i}" for i in range(500)] + ["a1", "a2", None, None]
    rows = spark.createDataFrame(list(enumerate(answers)), "id long, answer string")
    got = {r.id: r.negatives for r in D.sample_negatives(rows, "id", "answer", 3, buckets=4).collect()}
    assert set(got) == set(range(len(answers)))
    for i, own in enumerate(answers):
        assert len(set(got[i])) == len(got[i]) == 3 and own not in got[i] and set(got[i]) <= set(answers[:500])
    assert len({n for v in got.values() for n in v}) > 400
    few = {r.id: r.negatives for r in D.sample_negatives(rows.where("id < 2 or id = 502"), "id", "answer", 3).collect()}
    assert few == {0: ["a1"], 1: ["a0"], 502: ["a0", "a1"]}
    assert [r.negatives for r in D.sample_negatives(rows.where("id = 5"), "id", "answer", 3).collect()] == [[]]
    assert D.sample_negatives(rows.where("id = 5").union(rows.where("id = 5")), "id", "answer", 3).count() == 2
    assert D.sample_negatives(rows.where("id = 503"), "id", "answer", 3).count() == 1 and D.sample_negatives(rows.limit(0), "id", "answer", 3).count() == 0
    # every pair out of a small pool is drawn about equally often
    small = spark.range(3000).select("id", F.concat(F.lit("p"), F.col("id") % 5).alias("answer"))
    seen = {tuple(r.negatives): r["count"] for r in D.sample_negatives(small, "id", "answer", 2).groupBy("negatives").count().collect()}
    assert len(seen) == 10 and min(seen.values()) > 220 and max(seen.values()) < 380


def test_map_rows_drops_bad(spark):
    rows = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    got = D.map_rows(rows, lambda r: [{"n": int(r["v"])}, {"n": 0}], "n long").collect()
    assert sorted(r.n for r in got) == [0, 1]


def test_text(spark):
    r = spark.range(1).select(
        T.crossing_name(F.lit("Complex_Crossing_a_b_c")), T.crossing_name(F.lit("Crossing_a_b")), T.clean_path_text(F.lit("(a, b, c) -> (1m, N) -> (2m, S) -> (d, e, f)")), T.format_step(F.lit(12.0), F.lit("94°(E)")),
        T.bracket_contents(F.lit("x [a] y [b]")), T.same_street(F.lit("Main Street"), F.lit("main st")), T.split_caption(F.lit("a **Summarization:** b")),
    ).toDF(*"abcdefg").first()
    assert r.a == "Complex Crossing of a and b c" and r.b == "Intersection of a and b"
    assert r.c == "(a, b, c) -> (2m, S) -> (d, e, f)" and r.d == "(12.0m, 94°(E))"
    assert r.e == ["a", "b"] and r.f and tuple(r.g) == ("a", "b")


def test_overlap_and_flags(spark):
    rows = spark.createDataFrame([("a b c d", "a b c d"), ("a b", "c d"), ("a c b", "a b c"), ("", "x")], "prediction string, reference string")
    got = {r.prediction: (round(r.rouge_1), round(r.rouge_2), round(r.rouge_l), round(r.bleu_4)) for r in M.text_overlap(rows).collect()}
    assert got["a b c d"] == (100, 100, 100, 100) and got["a b"] == (0, 0, 0, 0) and got["a c b"][0] == 100 and got["a c b"][2] == 67 and "" not in got
    r = spark.range(1).select(M.think_answer_flag(F.lit("<think>x</think> <answer>1</answer>")).alias("a"), M.think_answer_flag(F.lit("x")).alias("b"), M.answer_right(F.lit("<answer> 1.0 </answer>"), F.lit("1")).alias("c"), M.token_accuracy(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (9, 1, -100)))).alias("d")).first()
    assert (r.a, r.b, r.c) == (1, 0, True) and tuple(r.d) == (1, 1, True)
