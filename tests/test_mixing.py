"""Sampling, mixing, numbering and user functions against brute force."""

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from urbanloom.operators import adapters, datasets, reports, rounds, spatial_joins, subgraphs, user_functions
from urbanloom.sources import readers
from urbanloom.streaming import jobs


def test_numbered_is_in_order(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("k"))
    got = {r.k: r.n for r in rounds.numbered(df, ["k"], "n", 10).collect()}
    assert got == {k: i + 10 for i, k in enumerate(sorted(got))} and len(got) == 500


def test_interleave(spark):
    a, b = spark.range(300).withColumnRenamed("id", "k").withColumn("id", F.lit("x")), spark.range(900).withColumnRenamed("id", "k")
    rows = datasets.interleave([a, b], [0.5, 0.5], "k", 4, "all").orderBy("draw").collect()
    assert [r.draw for r in rows] == list(range(1200)) and Counter(r.source for r in rows) == {0: 300, 1: 900}
    for s in (0, 1):
        keys = [r.k for r in rows if r.source == s]
        assert keys == sorted(keys)  # each source in its own order
    first = datasets.interleave([a, b], [0.5, 0.5], "k", 4, "first").orderBy("draw").collect()
    assert [(r.source, r.k) for r in first] == [(r.source, r.k) for r in rows][: len(first)]  # the same draws
    assert first[-1].source == 0 and sum(r.source == 0 for r in first) == 300 and 220 < sum(r.source == 1 for r in first) < 390
    assert datasets.interleave([a, b], [1.0, 0.0], "k").count() == 300


def test_batches_samples_and_negatives(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    assert Counter(r.batch_id for r in datasets.shard_batches(df, "k", 10).collect()) == {**{i: 10 for i in range(10)}, 10: 3}
    assert datasets.shard_batches(df, "k", 10, drop_last=True).count() == 100
    assert Counter(r.k for r in datasets.sample_n(df, 150, "k").collect()) == {k: 2 if k < 47 else 1 for k in range(103)}
    assert sorted(r.k for r in datasets.sample_n(df, 5, "k").collect()) == [0, 1, 2, 3, 4] and datasets.sample_n(df, 206, "k").count() == 206
    rows = spark.createDataFrame([(i, f"a{i % 50}" if i % 10 else None) for i in range(200)], "k long, answer string")
    got = datasets.sample_negatives(rows, "k", "answer", 7).collect()
    assert len(got) == 200 and all(len(set(r.negatives)) == 7 and f"a{r.k % 50}" not in (r.negatives if r.k % 10 else []) for r in got)
    assert len({n for r in got for n in r.negatives}) == 45
    assert Counter(r.cell for r in datasets.random_k(df.withColumn("cell", F.col("k") % 4), "cell", "k").collect()) == {i: 3 for i in range(4)}


def test_name_similarity(spark):
    pairs = [("Oak Street", "oak st"), ("Main Rd", "Maine Road"), (None, "x"), ("Elm", "Oak"), ("St", "st")]
    got = {(r.a, r.b): r.similarity for r in reports.name_similarity(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}
    assert got[pairs[0]] == 1.0 and got[pairs[2]] == 0.0 and got[pairs[4]] == 1.0
    assert abs(got[pairs[1]] - SequenceMatcher(None, "main", "maine").ratio()) < 1e-12 and abs(got[pairs[3]] - SequenceMatcher(None, "elm", "oak").ratio()) < 1e-12


def test_lines_and_radius_far_north(spark):
    seg = spark.createDataFrame([(1, 10.0, 80.0, 10.001, 80.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(7, 10.005, 80.0)], "id long, lon double, lat double")  # 77 m east of the end
    assert [r.point_id for r in spatial_joins.nearest_line(pts, seg, 100.0).collect()] == [7]
    near = spark.createDataFrame([(8, 10.0, 80.0)], "id long, lon double, lat double")
    assert [r.id for r in spatial_joins.radius_nodes(near, pts, 100.0).collect()] == [7]


def test_user_functions(spark):
    class Mean(user_functions.Metric):
        zero = {"hits": 0, "n": 0}

        def update(self, state, predicted, true):
            return {"hits": state["hits"] + (predicted == true).sum(), "n": state["n"] + len(true)}

        def compute(self, state):
            return state["hits"] / state["n"]

    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") % 2).alias("p"), (F.col("id") % 4 % 3).alias("t"))
    want = rows.groupBy("g").agg(F.avg((F.col("p") == F.col("t")).cast("double")).alias("v"))
    got = {r.g: r.value for r in user_functions.metric_by(rows, ["g"], Mean(), "p", "t").collect()}
    assert got == pytest.approx({r.g: r.v for r in want.collect()})

    @user_functions.register_reward("length")
    def length(text: pd.Series) -> pd.Series:
        return text.str.len()

    assert [r.x for r in spark.createDataFrame([("abc",)], "t string").select(user_functions.reward("length", "t").alias("x")).collect()] == [3.0]
    with pytest.raises(ValueError):
        user_functions.register_reward("length")(length)


def test_take_split(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        spark.range(i * 40, i * 40 + 40).coalesce(1).write.mode("append").parquet(source)
    stream = jobs.stream_dataset(spark, source, "id long") if False else spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    jobs.take_split(stream, out, str(tmp_path / "check"), "id", 70, 0.1)
    got = Counter(r.split for r in spark.read.parquet(out).collect())
    assert got == {"val": 7, "train": 63}
    with pytest.raises(ValueError):
        jobs.take_split(stream, out, str(tmp_path / "c2"), "id", None, 0.1)


def test_sources(spark, tmp_path):
    base = str(tmp_path)
    spark.range(3).write.parquet(f"{base}/city/roads.parquet")
    layers = readers.read_city_layers(spark, f"{base}/city", "name string")
    assert layers["roads"].count() == 3 and layers["area_pois"] is None
    lines = spark.createDataFrame([(1, '{"image": "a", "angle": 5}'), (2, '{"image": "a", "angle": 9.5}'), (3, '{"image": "a", "angle": null}'), (4, "broken")], "line long, value string")
    assert [(r.image, r.angle) for r in readers.read_side_attributes(lines, "image", "angle", "line").collect()] == [("a", 9.5)]
    spark.createDataFrame([("q", "r")], "ask string, say string").write.json(f"{base}/d.json")
    catalogue = readers.dataset_catalogue(spark, [{"name": "d", "path": f"{base}/d.json", "columns": {"ask": "query", "say": "response"}, "function": "messages"}])
    got = readers.load_registered(spark, catalogue, "d", {"messages": adapters.auto_messages}).first()
    assert [(m.role, m.content) for m in got.messages] == [("user", "q"), ("assistant", "r")]
    with pytest.raises(ValueError):
        readers.dataset_catalogue(spark, [{"name": "d", "path": "x"}] * 2)
    nodes = spark.createDataFrame([(g, i) for g in range(5) for i in range(3)], "graph long, id long")
    readers.write_subgraphs(nodes, nodes.withColumnRenamed("id", "id1"), f"{base}/g", 4)
    assert spark.read.parquet(f"{base}/g/subgraph_nodes").where("graph = 3").count() == 3
    train, val = readers.materialise(spark.range(5), spark.range(2), f"{base}/m")
    assert (train.count(), val.count()) == (5, 2) and readers.materialise(spark.range(50), spark.range(20), f"{base}/m")[0].count() == 5
    assert readers.parse_spec("hub::s3://bucket/a.json:x/y#5") == ("hub", "s3://bucket/a.json", ["x", "y"], 5) and readers.parse_spec("a/b:c")[1:3] == ("a/b", ["c"])


def test_grounding_and_picks(spark):
    rows = spark.range(4000).select("id", adapters.grounding_prompt("grounding", F.lit("car"), F.col("id")).alias("p"))
    n = Counter(r.p for r in rows.collect())
    assert len(n) == 4 and 0.16 < sum(v for k, v in n.items() if "\u8bf7" in k) / 4000 < 0.24
    one = spark.range(300).select(adapters.pick_one(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(1), F.lit(2)), F.col("id")).alias("x")).collect()
    assert {(r.x.question, r.x.answer) for r in one} == {("a", 1), ("b", 2)}
    fixed = spark.range(50).select(reports.fixed_negatives(F.array(F.lit("n1"), F.lit("n2")), 5, F.col("id")).alias("f")).collect()
    assert all(r.f[:2] == ["n1", "n2"] and set(r.f) <= {"n1", "n2"} and len(r.f) == 5 for r in fixed)


def test_attach_and_essential_edges(spark):
    nodes = spark.createDataFrame([(1, 10, 0.0, 0.0), (1, 11, 0.0, 0.001)], "graph long, id long, lon double, lat double")
    images = spark.createDataFrame([(1, 99, 0.0, 0.0009), (1, 10, 0.0, 0.0)], "graph long, image long, lon double, lat double")
    assert [(r.image, r.node) for r in subgraphs.attach_nearest(images, nodes).collect()] == [(99, 11)]
