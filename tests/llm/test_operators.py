"""Small fixtures against brute force, exact round trips and the cases every operator must survive."""

import array
import base64
import hashlib
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from urbanloom.llm import byte_bpe, common, decontamination, jaccard_join, language_id, neighbours, quality, sharding, token_file, toxicity, url_filter

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + "."


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long and repeated rows, a clashing extra column, and a repeated id."""
    long = prose(1, 30000)
    rows = [(1, None, "en", 0), (2, "", "en", 1), (3, " \n\t ", None, 2), (4, long, "en", 3), (5, prose(2, 40), "fr", 4), (6, prose(2, 40), "fr", 5), (6, prose(2, 40), "fr", 6), (None, "x", "de", 7), (8, "Σίσυφος İ \x1c a\u0301 😀 |endoftext|", "el", 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key long")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(60)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def marked(spark):
    """Quality and toxicity follow from the text: odd ids are good prose; every second pair holds a rude word."""
    rows = [(i, (prose(i, 60) if i % 2 else "@@@ ### " * 40) + (" grubby" * (1 + i % 5) if (i // 2) % 2 else "")) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_language(spark, odd, empty):
    texts = {"aa": [prose(1, 4000)], "bb": ["".join(reversed(prose(2, 4000)))]}
    parser = language_id.CrossParser(texts, 20000)
    lang, score = parser.predict([prose(7, 100), "".join(reversed(prose(8, 100))), None, "", "12 !!"])
    assert lang == ["aa", "bb", "und", "und", "und"] and score[0] > 0.5 and (score[2:] == 0).all()
    # brute force: longest matches by searching the training text itself
    flat, sizes, _ = parser.symbols([prose(9, 30)])
    train = bytes(parser.symbols(texts["bb"])[0][:20000])
    cost = i = 0
    body = bytes(flat[: language_id.SEGMENT])
    while i < len(body):
        n = 1
        while i + n < len(body) and body[i : i + n + 1] in train:
            n += 1
        i, cost = i + n, cost + 1
    assert parser.phrases(flat[: len(body)], np.array([len(body)]))[0, 1] == cost
    trained = language_id.train(odd)
    got = language_id.identify(odd, trained)
    assert got.count() == 9 and {r.lang_pred for r in got.where("doc_id in (1, 2, 3)").collect()} == {"und"}
    assert language_id.identify(empty, language_id.train(empty)).count() == 0


def test_sharding(spark, odd, empty):
    got = sharding.shard_documents(odd, 3).collect()
    assert len(got) == 9 and sharding.shard_documents(empty, 3).count() == 0
    for k in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 1} == {(8, None)}
    same = [r for r in got if r.doc_id in (5, 6)]
    assert len({r.shard for r in same}) == 1 and {r.text_crc32 for r in same} == {zlib.crc32(prose(2, 40).encode())}


@pytest.mark.parametrize("sizes,shards", [([3, 1, 4, 1, 5, 9, 2, 6], 3), ([1] * 20, 7), ([10], 4), ([2, 2, 100, 1, 1], 3), ([1, 1, 100, 1, 1], 2), ([9, 1, 9, 1, 1, 9], 4)])
def test_minimax_is_the_smallest(spark, sizes, shards):
    def best(rest, k):
        return sum(rest) if k == 1 else min(max(sum(rest[:i]), best(rest[i:], k - 1)) for i in range(len(rest) + 1))

    row = spark.range(1).select(sharding.smallest_capacity(F.array(*[F.lit(s).cast("long") for s in sizes]), F.lit(sum(sizes)), F.lit(shards)).alias("c")).first()
    assert row.c == best(sizes, shards)
    groups = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "cell int, bytes long")
    placed = sharding.partition_groups(groups, shards).join(groups, "cell").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()
    assert max(r.b for r in placed) == best(sizes, shards) and len(placed) <= shards
    order = [r.shard for r in sharding.partition_groups(groups, shards).orderBy("cell").collect()]
    assert order == sorted(order)  # contiguous


def test_shards_against_brute_force(spark, odd):
    """Shards and slots as the cells, their greedy partition and the order within a shard give them."""
    rows = spark.createDataFrame([(i, prose(i % 70, 5 + i % 40)) for i in range(300)], "doc_id long, text string")
    got = {r.doc_id: r for r in sharding.shard_documents(rows, 5).collect()}
    cell = {i: int(__import__("hashlib").md5(prose(i % 70, 5 + i % 40).encode()).hexdigest()[:4], 16) for i in range(300)}
    assert all(got[a].shard <= got[b].shard for a in got for b in got if cell[a] < cell[b])
    total = sum(r.size for r in got.values())
    for k in range(5):
        mine = sorted((r for r in got.values() if r.shard == k), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine))) and [cell[r.doc_id] for r in mine] == sorted(cell[r.doc_id] for r in mine)
        assert abs(sum(r.size for r in mine) - total / 5) < total / 10


@pytest.mark.parametrize("n", [40, 500])
def test_neighbours_of_small_tables(spark, n):
    """Recall against brute force where the table is small: the same share decides, and every query has its five answers."""
    v = np.random.default_rng(n).standard_normal((n, 32)).astype(np.float32)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.search(rows, F.col("vec_id") % 10 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    near = unit @ unit.T
    hits = [len(set(got[q]) & set([int(x) for x in np.argsort(-near[q], kind="stable") if x != q][:5])) for q in range(0, n, 10)]
    assert set(map(len, got.values())) == {5} and sum(hits) / (5 * len(hits)) >= 0.9


def test_neighbours_prunes(spark):
    """Recall against brute force where the forest leaves out about half of the vectors."""
    rng = np.random.default_rng(12)
    v = rng.standard_normal((6000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0, k=5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    hit = 0
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -2
        hit += len(found & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 120 and hit / 600 >= 0.9
    forest = neighbours.Forest(unit[:6000].astype(float), 16, neighbours.LEVELS)
    leaves = forest.leaves(unit.astype(float))
    sizes = np.stack([np.bincount(leaves[:, t], minlength=1 << neighbours.LEVELS) for t in range(16)])
    seen = [len(set(np.concatenate([np.flatnonzero(leaves[:, t] == n) for t, n in forest.search(unit[q].astype(float), sizes, 0.65 * 6000 + 300)]).tolist())) for q in range(0, 6000, 500)]
    assert np.mean(seen) < 0.6 * 6000


def test_language_of_large_scripts(spark):
    """Letters outside the commonest ones still tell languages apart."""
    rng = np.random.default_rng(1)
    han, kana = [chr(0x4E00 + i) for i in range(2000)], [chr(0x5E00 + i) for i in range(2000)]
    text = lambda letters, n: "".join(rng.choice(letters, n, p=1 / np.arange(1, 2001) / (1 / np.arange(1, 2001)).sum()))
    parser = language_id.CrossParser({"aa": [text(han, 9000)], "bb": [text(kana, 9000)]}, 20000)
    lang, _ = parser.predict([text(han, 200), text(kana, 200)])
    assert lang == ["aa", "bb"]


def brute_groups(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_jaccard_join_against_brute_force(spark, odd, empty):
    rng = np.random.default_rng(5)
    texts = [None, "", "One two", "one  TWO", "one three"]
    for family in range(4):
        base = list(rng.choice([f"w{i}" for i in range(400)], 90))
        for k in range(70 if family == 0 else 6):
            copy = list(base)
            for at in rng.choice(len(copy), int(rng.integers(0, 5)), replace=False):
                copy[at] = f"edit{family}-{k}-{at}"
            texts.append(" ".join(copy))
    texts += [prose(100 + i, 50) for i in range(20)] + texts[5:9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts)
    kept = {r.doc_id for r in jaccard_join.keep_first(docs).collect()}
    assert kept == {i for i, (_, root) in enumerate(brute_groups(texts)) if root == i}
    rows = jaccard_join.link_groups(odd)
    assert rows.count() == 9 and {r.component_id for r in rows.where("doc_id in (5, 6)").collect()} == {5}
    assert jaccard_join.link_groups(empty).count() == 0


def test_jaccard_rounds_are_exact(spark, monkeypatch):
    """Regions over two sets go through pivots, Voronoi regions and windows."""
    monkeypatch.setattr(jaccard_join, "FEW", 2)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(70)]
    texts = []
    for k in range(40):
        copy = list(base)
        for at in rng.choice(70, int(rng.integers(0, 6)), replace=False):
            copy[at] = f"e{k}-{at}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts)


def test_jaccard_bounds_hold_inside_the_range_of_sizes(spark):
    """A set of 100 shingles that links with 29 of 109, whose need is less than at both ends of its region's sizes (100 and 110)."""
    base = [f"w{i}" for i in range(97)]
    texts = [" ".join(base + [f"own{k}-{j}" for j in range(n)]) for k, n in enumerate([16] * 29 + [17, 7])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_groups(docs).collect()}
    want = brute_groups(texts)
    assert [got[i] for i in range(len(texts))] == want and want[30] == (100, 0) and want[29] == (110, 29)


def test_jaccard_least_need_is_the_least(spark):
    ranges = spark.range(1, 400).select(F.col("id").alias("n")).join(spark.range(1, 500).select(F.col("id").alias("hi")), F.expr("hi between n and floor(n * 5 / 4)"))
    ranges = ranges.withColumn("lo", F.ceil(F.col("n") * 4 / 5))
    need = lambda m: jaccard_join._need(F.col("n"), F.col(m))
    partners = ranges.withColumn("m", F.explode(F.sequence("lo", "hi"))).groupBy("n", "lo", "hi").agg(F.min(need("m")).alias("least"))
    assert partners.where(F.col("least") != jaccard_join._least_need(F.col("n"), F.col("lo"), F.col("hi"))).count() == 0


def test_jaccard_sketches_bound_the_difference():
    rng = np.random.default_rng(8)
    for n in (1, 60, 400, 3000):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        for share in (0.0, 0.5, 0.8, 0.95, 1.0):
            b = np.unique(np.concatenate([a[: int(len(a) * share)], rng.integers(-(1 << 62), 1 << 62, len(a) // 5)]))
            assert jaccard_join.apart(jaccard_join.sketch(a), jaccard_join.sketch(b)) <= len(np.setxor1d(a, b))
    assert jaccard_join.sketch(np.arange(400) << 32) == b"" and len(jaccard_join.sketch(np.arange(400))) == 512 and jaccard_join.apart(b"", jaccard_join.sketch(a)) == 0


def test_jaccard_very_long_sets_at_the_bound(spark):
    """Sets of 300,000 shingles with exactly 0.8 in common link; with one less they do not."""
    texts = []
    for family, same in (("a", 266_671), ("b", 266_670)):  # words; the shingles in common are 4 fewer
        base = [f"{family}{i}" for i in range(300_004)]
        texts += [" ".join(base), " ".join(base[:same] + [f"{family}x{i}" for i in range(300_004 - same)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_groups(docs).collect()}
    assert got == {0: (300_000, 0), 1: (300_000, 0), 2: (300_000, 2), 3: (300_000, 3)}


def test_byte_bpe_equals_tiktoken(spark, odd, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode_decode(odd, path, public_tokenizers.PATTERN, keep_ids=True).collect()
    texts = [r.text for r in odd.collect()]
    want = sorted(encoding.encode_ordinary(t or "") for t in texts)
    assert sorted(r.ids for r in got) == want and all(r.lossless for r in got)
    assert sorted(r.ids_sha256 for r in got) == sorted(hashlib.sha256(array.array("I", ids).tobytes()).hexdigest() for ids in want)
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for t in texts)
    assert byte_bpe.encode_decode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_quality(spark, marked, labels, odd, empty):
    field = quality.train(marked, labels, per_label=200)
    got = quality.score_documents(marked, field).join(labels, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and all((r.score >= 0.7) == bool(r.quality) for r in held) and all(0 <= r.score <= 1 for r in got)
    # forward-backward marginals against all labellings of a small chain
    x, _, per = quality.line_features(["aa bb\n@@ ##\ncc dd\n||"])
    good, pairs = field.marginals(x, per)
    u = x @ field.w
    total, one, both = 0.0, np.zeros(4), np.zeros((4, 2, 2))
    for code in range(16):
        y = [code >> k & 1 for k in range(4)]
        p = np.exp(sum(u[k] * y[k] for k in range(4)) + sum(field.pair[y[k - 1], y[k]] for k in range(1, 4)))
        total += p
        for k in range(4):
            one[k] += p * y[k]
            if k:
                both[k, y[k - 1], y[k]] += p
    assert np.allclose(good, one / total) and np.allclose(pairs[1:], both[1:] / total)
    assert quality.score_documents(odd, field).count() == 9
    assert quality.score_documents(empty, quality.train(empty, labels.where("false"))).count() == 0


def test_toxicity(spark, marked, labels, odd, empty):
    model = toxicity.train(marked, labels, per_label=200)
    got = toxicity.score_documents(marked, model).join(labels, "doc_id").collect()
    assert all(r.predicted == r.toxic for r in got) and all(0 <= r.severity <= 3 for r in got)
    assert (np.diff(model.threshold) > 0).all()
    above = model.above(["grubby " * 3, None])
    assert (np.diff(above, axis=1) <= 0).all()
    assert {r.predicted for r in toxicity.score_documents(odd, model).collect()} == {0}
    assert toxicity.score_documents(empty, toxicity.train(empty, labels.where("false"))).count() == 0


def brute_tiles(item, text, least):
    """Greedy string tiling by definition: always the longest unmarked match, first in the item, then in the text."""
    a, b, out = [False] * len(item), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        a[i : i + n], b[j : j + n] = [True] * n, [True] * n
        out.append((i, j, n))


def test_tiling_and_leaks(spark, odd, empty):
    rng = np.random.default_rng(3)
    for k in range(120):
        item, text = rng.integers(0, 2 + k % 4, 14 + k % 9).astype(np.uint64), rng.integers(0, 2 + k % 4, 40).astype(np.uint64)
        assert decontamination.tile(item, text, 3) == brute_tiles(item.tolist(), text.tolist(), 3)
    passage = [f"t{i}" for i in range(40)]
    shuffled = passage[20:] + ["and"] + passage[:20]
    bench = spark.createDataFrame([(1, " ".join(passage)), (2, None), (3, ""), (4, "tiny one")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x y " + " ".join(passage).upper() + " z"), (2, " ".join(shuffled)), (3, " ".join(passage[:10])), (4, "a tiny one here"), (5, None), (6, "")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.tiles for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == {(1, 1): 1, (2, 1): 2, (4, 4): 1}
    assert sorted(r.doc_id for r in decontamination.drop_leaks(docs, bench).collect()) == [3, 5, 6]
    texts = bench.selectExpr("concat('item', item_id) as doc_id", "text", "1 as coverage")  # ids are text, names clash
    assert {(r.doc_id, r.item_doc_id) for r in decontamination.find_leaks(docs, texts, item_col="doc_id").collect()} == {(1, "item1"), (2, "item1"), (4, "item4")}
    assert decontamination.find_leaks(odd, bench).count() == 0 and decontamination.drop_leaks(odd, bench).count() == 9
    assert decontamination.find_leaks(docs, bench.where("false")).count() == 0 and decontamination.drop_leaks(empty, bench).count() == 0


@pytest.mark.parametrize("segment,pairs", [(7, 5), (64, 1000)])
def test_tiles_in_parts(monkeypatch, segment, pairs):
    """Small parts and early trimming give the tiles that whole ones do, on texts of few words."""
    rng = np.random.default_rng(segment)
    cases = []
    for _ in range(60):
        cases.append(tuple(rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(1, n))).astype(np.uint64) for n in (25, 90)))
    whole = [decontamination.tile(item, text, 3) for item, text in cases]
    monkeypatch.setattr(decontamination, "SEGMENT", segment)
    monkeypatch.setattr(decontamination, "PAIRS", pairs)
    assert [decontamination.tile(item, text, 3) for item, text in cases] == whole
    monkeypatch.setattr(decontamination, "SPLIT", 40)
    long = "Ein Wort_und noch  eins; " * 30
    hashes = decontamination.WordHashes()
    assert decontamination.word_ids(long, hashes).tolist() == [hashes[w] for w in decontamination.WORDS(long.lower())]


def test_long_repetitive_text():
    """20 MB of one word against an item of fifty of it: one tile, in bounded memory."""
    bench = decontamination.Benchmark([(1, "no " * 50), (2, "no yes " * 20)])
    tracemalloc.start()
    ids = decontamination.word_ids("no " * 6_700_000, decontamination.WordHashes())
    got = list(bench.leaks(ids, 0.6))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(1, 1.0, 1, 50)] and peak < 400e6
    assert decontamination.tile(ids[:50], ids, 4) == [(0, 0, 50)]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((600, 16)).astype(np.float32)
    rows = [(i, v[i].tolist()) for i in range(600)] + [(600 + i, v[3].tolist()) for i in range(30)]
    rows += [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [1.0, None] * 8), (1200, []), (1250, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids = np.array([i for i, _ in rows[:630]])
    x = np.array([e for _, e in rows[:630]], float)
    norm = np.sqrt((x * x).sum(axis=1))
    hit = 0
    assert set(got) == set(range(0, 630, 50))
    for q in got:
        s = x @ x[q] / (norm * norm[q])
        want = [ids[j] for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != q][:5]
        assert len(got[q]) == 5 and all(abs(score - s[i]) < 1e-12 for i, score in got[q])
        hit += len({i for i, _ in got[q]} & set(want))
    assert hit / 5 / len(got) >= 0.9
    assert [i for i, _ in got[600]] == [3, 601, 602, 603, 604]
    few = neighbours.search(df.where("vec_id < 3"), F.col("vec_id") == 0, k=5).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert neighbours.search(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_token_file_round_trip(spark, odd, empty):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(4)
    for ids in (np.zeros(0, int), np.array([5]), rng.integers(0, 65536, 9000), np.zeros(8192, int), rng.integers(0, 9, 12289)):
        assert (token_file.unpack(token_file.pack(ids.astype(np.int64)))[0] == ids).all()
    data = bytearray(token_file.pack(rng.integers(0, 500, 5000).astype(np.int64)))
    data[-9] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_file.unpack(bytes(data))
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    plain = Tokenizer.from_str(spec)
    got = sorted(token_file.read_segments(token_file.write_segments(odd, spec)).collect(), key=lambda r: r.start)
    want = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))  # a null id first; the two rows of id 6 are equal
    start = 0
    for row, r in zip(got, want, strict=True):
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    payload = token_file.write_segments(odd, spec).first().payload
    ids, index = token_file.unpack(payload)  # a file alone names its documents
    assert sum(index["counts"]) == len(ids) and len(index["docs"]) == len(index["counts"])
    named = odd.where("doc_id > 4").selectExpr("cast(doc_id as string) as name", "text", "doc_id as start")
    assert {r.name for r in token_file.read_segments(token_file.write_segments(named, spec, id_col="name"), "name", "string").collect()} == {"5", "6", "8"}
    assert token_file.read_segments(token_file.write_segments(empty, spec)).count() == 0


def test_token_file_matches_added_tokens(spark):
    """Literal special tokens are single ids, as the library has them by default, and later documents start after them."""
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    plain = Tokenizer.from_str(spec)
    texts = ["a cat <|endoftext|> b", "A<|startoftext|>cat<|endoftext|><|endoftext|>", "a <|ENDOFTEXT|> b", "<|endoftext", "a cat", "<|endoftext|>\u03a3 a\u0301"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_file.read_segments(token_file.write_segments(docs, spec)).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = plain.encode(t, add_special_tokens=False).ids + [1]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got[0][1] == 5


def test_token_file_encodes_and_reads_together():
    """Texts encoded in one go equal the library's ids, also with characters newer than Python's Unicode; segments read in one go equal those read alone."""
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    plain, encoder = Tokenizer.from_str(spec), token_file.WordEncoder(spec)
    texts = [None, "", " \n", "It's a cat, isn't it? Nie-da 42.", "a\u1c89b \u0558x\ua7cb", "a\x1cb", "Stra\u00dfe. stra\u00dfe stra\u00dfe;", "x</w>y </w>", "a\u200bb\u00a0c\u3000d"]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [memoryview(ids).cast("H").tolist() for ids in encoder.encode_all(texts)] == want
    assert encoder.encode_all([]) == [] and encoder.encode_all([None]) == [b""]
    rng = np.random.default_rng(5)
    many = [rng.integers(0, 900, n) for n in (5000, 0, 4096, 1, 2047)]
    data = [token_file.pack(ids.astype(np.int64), {"n": len(ids)}) for ids in many]
    for ids, (got, index) in zip(many, token_file.unpack_all(data), strict=True):
        assert (got == ids).all() and index == {"n": len(ids)}


def test_urls(spark):
    urls = ["http://A.example.ORG/es/x?y#z", "https://example.org/en/12", "https://example.org/en/2", "x://shop.com/fr/", "x://com/de/1", "x://notcom.net/de/", "nothing", None, "x://h?q", "x://bad.net/1", "x://org"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([(9, 0)] * 40 + [(5, 1)] * 40 + [(2, None)], "doc_id long, quality int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, outcomes).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block")
    assert got[2][2:] == ("org/", "allow") and got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5] == ("notcom.net", "/de/", None, "allow") and got[6][:2] == ("", "") and got[7][:2] == ("", "") and got[8][:2] == ("h", "")
    assert got[9][3] == "block" and got[10] == ("org", "", None, "allow") and len(got) == len(urls)
    assert url_filter.judge_urls(pages.where("false"), outcomes).count() == 0


def test_url_levels_and_posterior(spark):
    """Suffixes of two labels, ports, user names and addresses; the posterior against its formula."""
    hosts = ["a.b.co.uk", "me@x.co.uk:8080", "shop.com", "10.0.0.1:80", "localhost", "", "co.uk", "x.com.evil.net"]
    suffix, domain = url_filter.name_levels(F.col("host"))
    got = [(r.s, r.d) for r in spark.createDataFrame([(h,) for h in hosts], "host string").select(suffix.alias("s"), domain.alias("d")).collect()]
    assert got == [("co.uk", "b.co.uk"), ("co.uk", "x.co.uk"), ("com", "shop.com"), ("ip", "10.0.0.1"), ("localhost", "localhost"), ("", ""), ("uk", "co.uk"), ("net", "evil.net")]
    rows = [("a.bad.com", 30, 27), ("b.bad.com", 3, 3), ("c.good.com", 40, 2), ("d.good.com", 5, 0), ("e.fair.net", 20, 8), ("new.bad.com", 0, 0), ("new.org", 0, 0)]
    rated = {r.host: r for r in url_filter.host_reputation(spark.createDataFrame(rows, "host string, n long, bad long")).collect()}

    def level(key):
        out: dict = {}
        for h, n, bad in rows:
            if n:
                a = out.setdefault(key(h), [0, 0])
                a[0], a[1] = a[0] + n, a[1] + bad
        n, y = np.array(list(out.values()), float).T
        p = y.sum() / n.sum()
        rho = ((y * y / n).sum() - n.sum() * p * p - p * (1 - p) * (len(n) - 1)) / (p * (1 - p) * (n.sum() - (n * n).sum() / n.sum() - len(n) + 1)) if len(n) > 1 else 0.01
        return {k: tuple(v) for k, v in out.items()}, 1 / min(max(rho, 0.005), 0.9) - 1, p

    sufs, s1, p = level(lambda h: h.rpartition(".")[2])
    doms, s2, _ = level(lambda h: h.partition(".")[2])
    _, s3, _ = level(lambda h: h)
    for h, n, bad in rows:
        a = sufs.get(h.rpartition(".")[2])
        suf = (a[1] + s1 * p) / (a[0] + s1) if a else p
        b = doms.get(h.partition(".")[2])
        dom = (b[1] + s2 * suf) / (b[0] + s2) if b else suf
        rate = (bad + s3 * dom) / (n + s3)
        assert abs(rated[h].rate - rate) < 1e-9 and rated[h].blocked == (rate - 1.645 * np.sqrt(rate * (1 - rate) / (n + s3 + 1)) > 0.35)
    assert rated["a.bad.com"].blocked and not rated["c.good.com"].blocked


def test_toxicity_gradient():
    """The likelihood's slope against differences, by one small step of the fit."""
    rng = np.random.default_rng(0)
    x = (rng.random((60, 5)) < 0.4).astype(float)
    grade = np.clip(np.rint(x[:, 0] + x[:, 1] + rng.normal(0.5, 0.9, 60)), 0, 3).astype(int)
    weight = rng.random(60) + 0.5

    def value(w, t):
        cut = np.r_[-40, t, 40]
        below = 1 / (1 + np.exp(-(cut[None] - (x @ w)[:, None])))
        i = np.arange(60)
        return (weight * np.log(below[i, grade + 1] - below[i, grade])).sum() / weight.sum() - 0.5e-4 * (w**2).sum()

    model = toxicity.Ordinal()
    model.fit(x, grade, weight, rounds=3000, rate=0.02)
    w, t = model.w, model.threshold
    best = value(w, t)
    for k in range(5):
        assert abs(value(w + 1e-4 * np.eye(5)[k], t) - value(w - 1e-4 * np.eye(5)[k], t)) / 2e-4 < 2e-3  # a maximum: no slope is left
    for k in range(3):
        assert abs(value(w, t + 1e-4 * np.eye(3)[k]) - value(w, t - 1e-4 * np.eye(3)[k])) / 2e-4 < 2e-3
    assert best >= value(w * 0.9, t) and best >= value(w, t + 0.2)


def test_keep_rows_keeps_columns(spark, odd):
    kept = common.keep_rows(odd, 3, lambda n, texts: [len(t or "") > n for t in texts])
    assert kept.columns == odd.columns and sorted(r.key for r in kept.collect()) == [2, 3, 4, 5, 6, 8]
