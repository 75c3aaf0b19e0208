"""Removal of repeated strings against a count of all strings."""

from collections import Counter

import numpy as np
import pytest

from urbanloom.llm import repeats


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((len(b), [tuple(x) for x in edge.reshape(-1, 2).tolist()], bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def sample(rng, length):
    """Texts over few letters, so that strings just under and just over the length repeat, with copies, edits, long runs of one letter and shared passages."""
    words = [f"{a}{b}" for a in ("ab", "ba", "é", "cc", "dad") for b in ("", "a", "tt")]
    prose = lambda n: " ".join(rng.choice(words, n))
    passage, other = prose(2 * length // 3), prose(length)
    texts = [None, "", "a", prose(300), "x" * (3 * length), "x" * (length + 3), "x" * (length - 1), "xy" * length]
    texts += [prose(30) + passage + prose(30) for _ in range(12)] + [other[: length + k] + prose(20) for k in (-2, -1, 0, 1, 2)]
    base = prose(400)
    for k in range(10):
        at = int(rng.integers(0, len(base)))
        texts.append(base[:at] + "Q" * k + base[at + k // 2 :])
    texts += [base, base, prose(50) + base[100:700] + base[300:900]]
    texts += [prose(int(rng.integers(1, 80))) for _ in range(40)]
    return texts


@pytest.mark.parametrize("length,seed,crowd,block", [(40, 1, 4096, 1_000_000), (40, 2, 3, 700), (53, 3, 1, 211), (200, 4, 4096, 1_000_000), (200, 5, 2, 5000)])
def test_against_all_strings(spark, monkeypatch, length, seed, crowd, block):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "BUCKET", 50)
    rng = np.random.default_rng(seed)
    texts = sample(rng, length)
    table = spark.createDataFrame([(i // 2 if i > 3 else None, t, i, "k") for i, t in enumerate(texts)], "doc_id long, text string, start int, key string").repartition(5)
    got = repeats.remove_repeats(table, length).collect()
    want = brute(texts, length)
    seen = lambda key, n, spans, kept: (-1 if key is None else key, n, spans, bytes(kept))
    mine = sorted(seen(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], r.kept) for r in got)
    assert mine == sorted(seen(i // 2 if i > 3 else None, *w) for i, w in enumerate(want))
    assert sum(bool(w[1]) for w in want) > 20 and any(not w[1] and w[0] > length for w in want)


def test_empty(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(table).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(table, 8)


def test_radix_passes():
    rng = np.random.default_rng(1)
    data = np.frombuffer(bytes(rng.choice(list(b"ab"), 4000).tolist()), np.uint8)
    position = np.arange(4000 - 20)
    order, number = repeats.repeated_windows(data, position, np.zeros(len(position), int), 20)
    body = data.tobytes()
    seen = Counter(body[i : i + 20] for i in position)
    assert sorted(order.tolist()) == [i for i in position.tolist() if seen[body[i : i + 20]] > 1]
    strings = [body[i : i + 20] for i in order]
    assert strings == sorted(strings) and len(set(strings)) == number[-1] + 1
    assert all((number[i] == number[i - 1]) == (strings[i] == strings[i - 1]) for i in range(1, len(strings)))
