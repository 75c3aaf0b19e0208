"""The stages on a small corpus whose right rows are known, and on odd rows."""

import corpus_pipeline
import pytest
from tests_fixture import corpus


def test_pipeline(spark, tmp_path):
    want = corpus(spark, str(tmp_path))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "byte_bpe"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stages"))
    corpus(spark, path)
    return path


@pytest.fixture(scope="module")
def odd(spark, folder):
    """Null and empty texts, a very long one, repeated rows and ids, a null id, and columns named as the operators name theirs."""
    good = next(r.text for r in spark.read.parquet(f"{folder}/documents.parquet").where("doc_id = 2").collect())
    long = " ".join(good.replace("stone", f"stone{i}") for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, long), (5, good), (5, good), (6, good), (None, "a lone text"), (7, "\u0130 \u1f600 e\u0301")]
    return spark.createDataFrame([(i, t, "en", k, 0.5, [k], "t") for k, (i, t) in enumerate(rows)], "doc_id long, text string, key string, n int, score double, shingles array<int>, _h string")


def test_stages_on_odd_rows(spark, folder, odd):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    far = odd.selectExpr("doc_id + 1000 as doc_id", *odd.columns[1:])
    trained = far.unionByName(docs.select("doc_id", "text"), allowMissingColumns=True)  # the models learn from the corpus
    for name, stage in corpus_pipeline.STAGES:
        learns = name in ("quality", "toxicity")
        out = stage(spark, trained if learns else odd, folder)
        if name != "byte_bpe":
            assert out.columns == odd.columns, name
        rows = [r for r in out.collect() if not learns or r.doc_id is None or r.doc_id >= 1000]
        kept = sorted((r.doc_id is None, (r.doc_id or 0) % 1000) for r in rows)
        if learns:
            assert {4, 5, 6} <= {i for _, i in kept} and kept.count((False, 5)) == 2, name
        elif name == "near_duplicates":
            assert kept == [(False, i) for i in (1, 2, 3, 4, 5, 5, 7)] + [(True, 0)]
        else:
            assert len(rows) == 9
        if name == "byte_bpe":
            assert all(r.lossless for r in rows) and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}


def test_stages_on_empty_tables(spark, folder, odd, tmp_path):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), folder).count() == 0
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        n = stage(spark, odd, str(tmp_path)).count()
        # without labels every quality score is 0.5, under the limit; nothing is toxic, nothing leaks
        assert n == {"quality": 0, "near_duplicates": 8}.get(name, 9), name
