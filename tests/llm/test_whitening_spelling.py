"""Whitening against a dense eigensolver in whole numbers, spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from urbanloom.llm import spelling, whitening


@pytest.mark.parametrize("values", [[3.0, 2.0, 1.0], [1.0] * 5, [2.0, 2.0, 1.0, 1.0, 0.0], list(10.0 ** np.arange(-6, 6)), [0.0, 0.0], [5.0]])
def test_components(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.standard_normal((len(values),) * 2))
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    got, vectors = whitening.components(a)
    top = max(values) or 1
    assert np.abs(got - np.sort(np.linalg.eigvalsh(a))[::-1]).max() < 1e-13 * top
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13 and np.abs(a @ vectors - vectors * got).max() < 1e-13 * top


def test_polar():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((9, 9))
    a = a + a.T
    e, v = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - v @ np.diag(np.sign(e)) @ v.T).max() < 1e-12


def test_whiten(spark):
    rng = np.random.default_rng(8)
    vectors = (rng.standard_normal((90, 6)) @ rng.standard_normal((6, 6))).tolist()
    rows = [(i, v, 7) for i, v in enumerate(vectors)]
    rows += [(200, vectors[3], 1), (200, vectors[3], 1), (None, vectors[4], 1), (201, None, 1), (202, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (203, [float("nan")] + [0.0] * 5, 1), (204, [float("inf")] + [0.0] * 5, 1), (205, [1.0, 2.0], 1), (206, [], 1), (207, [1e30] + [0.0] * 5, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int")
    got = whitening.whiten(table, keep=4).collect()
    x = [[int(np.floor(64 * c)) + 1000000 for c in v] for v in vectors]
    fit = [list(t) for t in {tuple(v) for v in x}]
    n, sums = len(fit), [sum(v[i] for v in fit) for i in range(6)]
    centred = [[Fraction(n * v[i] - sums[i], n) for i in range(6)] for v in fit]
    cov = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(6)] for i in range(6)])
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == 4 * 93 and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    assert {k[0] for k in by} == {*range(90), 200, None}
    for k in range(1, 5):
        mine = np.array([by[i, k].whitened for i in range(90)])
        want = np.array([[(n * v[i] - sums[i]) / n for i in range(6)] for v in x]) @ basis[:, k - 1] / np.sqrt(values[k - 1])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-9
        assert abs(by[0, k].explained - values[k - 1] / values.sum()) < 1e-12
    assert all(by[i, 1].deviation == sum((n * v[j] - sums[j]) ** 2 for j in range(6)) for i, v in enumerate(x))
    assert by[200, 2].whitened == by[3, 2].whitened and by[None, 1].deviation == by[4, 1].deviation
    assert whitening.whiten(table.where("false")).count() == 0
    assert whitening.whiten(table.where("vec_id = 200")).count() == 0  # one distinct vector has no variance


def test_whiten_large_numbers(spark):
    table = spark.createDataFrame([(i, [1e9 * i, float(i * i), -1e11 * (i % 3)]) for i in range(50)], "vec_id long, embedding array<double>")  # the second entry varies by less than 1e-13 of the others
    got = whitening.whiten(table).collect()
    assert len(got) == 100 and max(r.identity_error for r in got) < 1e-4 and sum(r.deviation is None for r in got) > 0


LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(docs, misspelt):
    words = Counter()
    for key, text in docs:
        for run in LETTERS.findall(text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            if h % misspelt == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            words[low] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]])
    return out


@pytest.mark.parametrize("crowd", [0, 2, 10_000])
def test_spelling_against_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    rng = np.random.default_rng(4)
    letters = list("abé×")
    bases = ["".join(rng.choice(letters, rng.integers(6, 9))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "abababab", "babababa", "ÀÉÎõüß", "ÀÉÎõüx"]
    texts = []
    for i in range(60):
        picked = [bases[int(k)] for k in rng.integers(0, len(bases), 120)]
        texts.append((i, " ".join(w[:k] + w[k + 1 :] if k < 6 else w if k < 20 else w.upper() for w, k in zip(picked, rng.integers(0, 22, 120), strict=True))))
    texts += [(None, "aaaaaa Aaaaaa1AAAAAA"), (7, None), (8, ""), (9, "élan" * 5000), (9, "élan" * 5000)]
    texts += [(100 + i, "aaaaab " * 30 ** (i % 3)) for i in range(9)]
    table = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, word string")
    want = brute_variants(brute_words(texts, 3))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(table, misspelt=3).collect()}
    assert got == want and sum(v[0] is not None for v in want.values()) > 5 and len(want) > 60
    assert spelling.spelling_variants(table.where("false")).count() == 0


def test_chains_of_forms(spark):
    chain = spark.createDataFrame([(f"w{i:03d}", f"w{i + 1:03d}" if i < 27 else None) for i in range(28)], "word string, form string")
    assert {r.root for r in spelling.roots(chain).collect()} == {"w027"} and spelling.roots(chain).count() == 27
