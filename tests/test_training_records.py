"""The training-record job: every reason to skip a line, and the content of those that stay."""

from urbanloom.operators import training_records as Tr

JOB = "line long, messages array<struct<role:string,content:string>>, image_path string, graph_path string, summarization string, coordinates string, image long, path_text string"
ASK = [("system", "s"), ("user", "Look at image with id 70000000001 now. Spatial Reasoning Path: (1.0m, N) -> (2.0m, S) -> (a, b, c). Based on it"), ("assistant", "yes")]


def test_reasons_and_content(spark):
    job = lambda line, text="p", at="(103.85, 1.3)", image=70000000001, messages=ASK, graph="g.pkl": (line, messages, "i.jpg", graph, "to 12 by 12", at, image, text)
    jobs = [job(1), job(2), job(3, "q", None, 5), job(4, "r", "unknown coordinates"), job(5, "q"), job(6, "t", graph="other.pkl"), job(7, "u", messages=[]), job(8, "v", messages=None), job(9, None), job(10, None), job(11, "w"), job(12, "w"), job(13, "x")]
    named = lambda line, last="Cafe": [(line, 0, 11, "Park", "point"), (line, 1, 12, last, "point")]
    steps = [s for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12) for s in named(k)] + named(11, "77")
    nodes = [(11, 1.0, 2.0, "green"), (11, 1.0, 2.0, "green"), (12, 3.0, 4.0, None), (70000000001, 103.9, 1.31, None)]
    made = Tr.compose_records(
        spark.createDataFrame(jobs, JOB), spark.createDataFrame(steps, "line long, pos int, node long, name string, kind string"), spark.createDataFrame(nodes, "node long, lon double, lat double, said string"),
        spark.createDataFrame([(70000000001, "North")], "image long, facing string"), spark.createDataFrame([("g.pkl",), ("g.pkl",)], "graph_path string"))
    got = {r.line: r for r in made.collect()}
    assert {k: r.reason for k, r in got.items()} == {
        1: None, 2: "duplicate_path", 3: "no_coordinates", 4: None, 5: "duplicate_path", 6: "graph_not_finished", 7: "no_messages", 8: "no_messages", 9: None, 10: None, 11: "unnamed_ends", 12: None, 13: "unnamed_ends"}
    one = got[1]
    assert one.messages[1].content == (
        'Look at image with id 70000000001 at (103.8500, 1.3000). When you face North, you can see the scene in the image now. Spatial Reasoning Path: (2.0m, S) -> (a, b, c). Based on it\n'
        'Here are relevant place entities informations: {"Park": "green"}')
    assert [m.content for m in one.messages][::2] == ["s", "yes"] and one.summarization == "to Cafe by Cafe" and not one.filled
    assert (one.images, one.graphs, one.image_coordinates, one.image) == (["i.jpg"], ["g.pkl"], "(103.8500, 1.3000)", 70000000001)
    assert got[4].filled and got[4].image_coordinates == "(103.9000, 1.3100)" and got[2].messages is None
    counts = {r.reason: r.lines for r in Tr.skip_counts(made).collect()}
    assert counts == {"kept": 5, "filled": 1, "duplicate_path": 2, "no_coordinates": 1, "graph_not_finished": 1, "no_messages": 2, "unnamed_ends": 2}
    assert Tr.skip_counts(made.where("false")).count() == 0
