import json

import pytest
from pyspark.sql import functions as F

from urbanloom.operators import datasets as D
from urbanloom.sources import readers as R
from urbanloom.streaming import jobs


def test_geojson_and_csv(spark, tmp_path):
    p = tmp_path / "a.geojson"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"name": "x"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"properties": {}, "geometry": None}]}))
    rows = R.read_geojson(spark, str(p), "name string").collect()
    assert [r.name for r in rows] == ["x", None] and json.loads(rows[0].geometry)["type"] == "Point"
    c = tmp_path / "a.csv"
    c.write_text("RecordNumber,Title,Longitude,Latitude\n5,a,1.5,2\n6,b,999,2\n7,c,x,2\n")
    assert [tuple(r) for r in R.read_lonlat_csv(spark, str(c)).collect()] == [(5, "a", 1.5, 2.0)]
    t = tmp_path / "t.csv"
    t.write_text('name,coords\na,"[(1.5, 2)]"\nb,none\n')
    assert [tuple(r) for r in R.read_tuple_csv(spark, str(t)).collect()] == [("a", 1.5, 2.0)]


def test_specs_and_lists(spark):
    assert R.parse_spec("hf::a/b:x/y#50") == ("hf", "a/b", ["x", "y"], 50) and R.parse_spec("a") == (None, "a", [], None)
    assert R.select_subsets(["all"], ["a", "b"], ("b",)) == ["a"] and R.select_subsets([], ["a", "default"]) == ["default"]
    with pytest.raises(ValueError):
        R.select_subsets([], ["a", "b"])
    lines = spark.createDataFrame([('{"graphs": ["a", 1]}',), ('{"graphs": "b"}',), ("{}",), ("broken",)], "value string")
    assert [r.graphs for r in R.coerce_list(lines, "graphs").collect()] == [["a", "1"], ["b"], []]
    df = spark.createDataFrame([(1, 2, 3)], "Query int, question int, keep int")
    assert R.safe_rename(df, {"query": "q", "question": "q", "keep": "kept"}).columns == ["Query", "question", "kept"]
    a, b = spark.createDataFrame([("1", "x"), ("y", "z")], "id string, a string"), spark.createDataFrame([(2, 5)], "id long, b long")
    assert sorted(r.id for r in R.union_city_tables([a, b.withColumn("id", F.col("id").cast("string"))]).collect()) == [1, 2]


def test_paths_that_hold_marks(spark, tmp_path):
    assert R.parse_spec("/data/a#1.json") == (None, "/data/a#1.json", [], None) and R.parse_spec("/data/a#1.json#20") == (None, "/data/a#1.json", [], 20)
    assert R.parse_spec("HF::a: x / y #3") == ("hf", "a", ["x", "y"], 3) and R.parse_spec("s3a://b/c:d") == (None, "s3a://b/c", ["d"], None)
    odd = tmp_path / "a#7"
    odd.write_text("x")
    exists = lambda path: R.known_path(spark, path)
    assert exists(str(odd)) and not exists(str(tmp_path / "none"))
    assert R.parse_spec(str(odd), exists) == (None, str(odd), [], None) and R.parse_spec(f"{odd}#2", exists) == (None, str(odd), [], 2)
    assert R.parse_spec("/a:b/c.json#4", lambda p: p == "/a:b/c.json") == (None, "/a:b/c.json", [], 4)


def test_incremental_job_skips_done(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.mode("append").parquet(src)
    for k in range(2):
        jobs.incremental_job(jobs.stream_dataset(spark, src, "id long", 1), lambda df: df.where("id <> 6").withColumn("v", F.col("id") * 2), out, str(tmp_path / "cp"), "id")
        if k == 0:
            spark.range(3, 8).write.mode("append").parquet(src)
    assert sorted(r.id for r in spark.read.parquet(f"{out}/rows").collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert {r.id: r.status for r in spark.read.parquet(f"{out}/status").collect()} == {i: "empty" if i == 6 else "success" for i in range(8)}


def test_incremental_job_that_fails_between_its_writes(spark, tmp_path, monkeypatch):
    """The rows are written, the status is not; the rerun of the batch leaves each row once. Ids are text here."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a",), ("b",)], "id string").coalesce(1).write.parquet(src)
    run = lambda: jobs.incremental_job(jobs.stream_dataset(spark, src, "id string", 1), lambda df: df.withColumn("v", F.length("id")), out, str(tmp_path / "cp"), "id")
    real = type(spark.range(1)).distinct
    monkeypatch.setattr(type(spark.range(1)), "distinct", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        run()
    assert spark.read.parquet(f"{out}/rows").count() == 2
    monkeypatch.setattr(type(spark.range(1)), "distinct", real)
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(f"{out}/rows").collect()) == ["a", "b"] and spark.read.parquet(f"{out}/status").count() == 2


def test_buffer_shuffle(spark, tmp_path):
    rows = spark.range(0, 5000, 1, 2).withColumn("t", F.col("id").cast("string"))
    got = [r.id for r in jobs.buffer_shuffle(rows, 100, seed=3).collect()]
    assert sorted(got) == list(range(5000)) and got != sorted(got) and got == [r.id for r in jobs.buffer_shuffle(rows, 100, seed=3).collect()]
    assert all(v < 2500 and v <= k + 100 for k, v in enumerate(got[:2400]))  # no row goes out before it has come in
    assert jobs.buffer_shuffle(rows.where("id < 3"), 100).count() == 3 and jobs.buffer_shuffle(rows.where("false")).count() == 0
    src = str(tmp_path / "in")
    rows.select("id").write.parquet(src)
    jobs.buffer_shuffle(jobs.stream_dataset(spark, src, "id long", 10), 50).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 5000


def test_preprocess_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("q", "a", "old", 1), (None, "b", "keep", 2)], "query string, response string, label string, id int").write.parquet(src)
    told = lambda df: df.withColumn("messages", D.query_response(F.col("query"), F.col("response"))).where(D.valid_messages(F.col("messages")))
    out = jobs.stream_preprocess(jobs.stream_dataset(spark, src, "query string, response string, label string, id int"), told, ("id",))
    assert out.isStreaming and set(out.columns) == {"messages", "label", "id"}
    out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.id, r.label, r.messages[1].content) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [(1, "old", "a")]
    made = jobs.stream_preprocess(spark.read.parquet(src), lambda df: df.withColumn("label", F.upper("__@label")))
    assert sorted(r.label for r in made.select("label").collect()) == ["KEEP", "OLD"]
