"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import labelled_sample, text_runs

#: Own features of a line; the first NEAR of them are also read from the lines before and after.
OWN = ("symbols", "pipes", "upper", "same_word", "few_words", "digits", "short_words", "long_words", "seen_before", "stops", "little", "empty")
NEAR = 6
FEATURES = len(OWN) + 2 * NEAR + 3
SPACE, LOWER, UPPER, DIGIT, STOP, PIPE, OTHER = range(7)


def _classes() -> np.ndarray:
    out = np.full(0x10000, OTHER, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        if c.isspace():
            out[i] = SPACE
        elif c.isalpha():
            out[i] = UPPER if c.isupper() else LOWER
        elif c.isdigit():
            out[i] = DIGIT
    out[[ord(c) for c in ".,;:?'\"()-"]] = STOP
    out[ord("|")] = PIPE
    return out


CLASS = _classes()


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, its length with the line end, lines of each text). Null and empty texts are one empty line."""
    lines: list[str] = []
    counts, same, few, before = [], [], [], []
    for text in texts:
        own = (text or "").split("\n")
        counts.append(len(own))
        seen: set[str] = set()
        for line in own:
            words = line.split()
            n = len(words)
            few.append(1 - len(set(words)) / n if n else 0.0)
            same.append(sum(map(str.__eq__, words, words[1:])) / n if n else 0.0)
            before.append(n > 0 and line in seen)
            seen.add(line)
        lines += own
    long = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("\n".join(lines).encode("utf-32-le", "replace"), np.uint32)
    kinds = CLASS[np.minimum(points, 0xFFFF)]
    kinds = np.append(kinds, SPACE)  # the last line's end, so that every line has a character
    starts = np.cumsum(long + 1) - long - 1
    total = lambda mask: np.add.reduceat(mask, starts, dtype=np.float64)
    space = kinds == SPACE
    ends = space[1:] & ~space[:-1]
    words = np.maximum(total(np.append(ends, False)), 1)
    letters = total(kinds == LOWER)
    upper = total(kinds == UPPER)
    other, pipes, digits, stops = total(kinds == OTHER), total(kinds == PIPE), total(kinds == DIGIT), total(kinds == STOP)
    solid = np.maximum(letters + upper + other + pipes + digits + stops, 1)
    mean = (letters + upper) / words
    own = np.stack([
        np.minimum(other / words, 4) / 2, np.minimum(pipes / words, 1) * 2, upper / np.maximum(letters + upper, 1), np.array(same), np.array(few), digits / solid,
        np.maximum(0, 3 - mean), np.clip(mean - 7, 0, 5), np.array(before, float), np.minimum(stops / words, 2), 1 / (1 + long / 40), long == 0,
    ], axis=1)
    per = np.array(counts)
    first = np.zeros(len(lines), bool)
    first[np.cumsum(per) - per] = True
    last = np.roll(first, -1)
    ahead, behind = np.roll(own[:, :NEAR], -1, axis=0), np.roll(own[:, :NEAR], 1, axis=0)
    ahead[last], behind[first] = 0, 0
    return np.hstack([own, behind, ahead, np.ones((len(lines), 1)), first[:, None], last[:, None]]), (long + 1).astype(float), per


class Crf:
    """Two states a line, bad (0) and good (1): unary scores of good from features, and a score of each pair of neighbours."""

    def __init__(self) -> None:
        self.w, self.pair = np.zeros(FEATURES), np.zeros((2, 2))

    @staticmethod
    def _order(per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts by falling number of lines, their first lines, and how many have a line at each position."""
        order = np.argsort(-per, kind="stable")
        sizes = per[order]
        return order, (np.cumsum(per) - per)[order], len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")

    def marginals(self, x: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and P(state before, state) of each line (zero on first ones); all texts step together."""
        order, first, active = self._order(per)
        score = x @ self.w
        local = np.stack([np.zeros_like(score), score], axis=1)
        local = np.exp(local - local.max(axis=1, keepdims=True))
        move = np.exp(self.pair - self.pair.max())
        forward, backward = np.empty_like(local), np.ones_like(local)
        for t, n in enumerate(active):
            at = first[:n] + t
            a = local[at] if t == 0 else (forward[at - 1] @ move) * local[at]
            forward[at] = a / a.sum(axis=1, keepdims=True)
        for t in range(len(active) - 1, 0, -1):
            at = first[: active[t]] + t
            b = (local[at] * backward[at]) @ move.T
            backward[at - 1] = b / b.sum(axis=1, keepdims=True)
        both = forward * backward
        good = both[:, 1] / both.sum(axis=1)
        pairs = np.zeros((len(x), 2, 2))
        inner = np.ones(len(x), bool)
        inner[np.cumsum(per) - per] = False
        at = np.flatnonzero(inner)
        joint = forward[at - 1][:, :, None] * move[None] * (local[at] * backward[at])[:, None, :]
        pairs[at] = joint / joint.sum(axis=(1, 2), keepdims=True)
        return good, pairs

    def fit(self, x: np.ndarray, per: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 250, rate: float = 0.1, decay: float = 2e-3) -> "Crf":
        """Maximum likelihood by Adam; each line has its text's label, each text its weight shared by its lines."""
        line_y, line_w = np.repeat(y, per).astype(float), np.repeat(weight / per, per)
        inner = np.ones(len(x), bool)
        inner[np.cumsum(per) - per] = False
        seen = np.zeros((2, 2))
        for k in (0, 1):
            seen[k, k] = line_w[inner & (line_y == k)].sum()
        theta = np.zeros(FEATURES + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for i in range(1, rounds + 1):
            self.w, self.pair = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
            good, pairs = self.marginals(x, per)
            slope = np.concatenate([x.T @ (line_w * (line_y - good)), (seen - np.tensordot(line_w, pairs, 1)).ravel()]) / weight.sum() - decay * theta
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
            theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        self.w, self.pair = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted mean of P(good) over the lines of each text."""
        if not texts:
            return np.zeros(0)
        x, long, per = line_features(texts)
        good, _ = self.marginals(x, per)
        start = np.cumsum(per) - per
        return np.add.reduceat(good * long, start) / np.add.reduceat(long, start)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = 1500, id_col: str = "doc_id", text: str = "text") -> Crf:
    """A field fitted on at most ``per_label`` training documents of each label (the bound of the sample), weighted to the labels' shares.

    Without labelled documents of both kinds the field stays at zero and scores 0.5.
    """
    texts, y, counts = labelled_sample(docs, labels, label, per_label, id_col=id_col, text=text)
    if len(set(y)) < 2:
        return Crf()
    parts = [line_features(texts[at : at + 200]) for at in range(0, len(texts), 200)]  # what a few hundred texts need at a time
    x, per = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
    del parts
    y = np.array(y)
    weight = np.array([counts[k] / (y == k).sum() for k in y], float)
    return Crf().fit(x, per, y, weight / weight.mean())


def score_documents(docs: DataFrame, field: Crf, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row, from its whole text. Null text counts as empty: one empty line.

    Very long texts are scored whole, with all their lines; equal texts have equal scores; repeated rows and null ids stay; other columns
    are not read; an empty table gives no rows. A caller's limit that a score meets exactly is met.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(texts), pa.float64())], [id_col, "score"])

    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, score double")
