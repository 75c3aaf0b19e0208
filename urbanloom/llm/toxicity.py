"""Severity of toxic language: cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import labelled_sample, text_runs

WORDS = re.compile(r"[^\W\d_]+").findall
#: Grades: 0 clean, 1 to 3 by how much toxic language a toxic document holds.
GRADES = 4
#: Lengths of the word beginnings that are features beside the words themselves.
BEGINNINGS = (3, 4, 5, 6)
#: Distinct words whose features a task remembers.
REMEMBERED = 400_000


def features_of(word: str) -> list[str]:
    """The word and its beginnings, marked with ``^``."""
    return [word, *["^" + word[:k] for k in BEGINNINGS if len(word) >= k]]


class Ordinal:
    """P(grade <= k) = sigmoid(threshold[k] - w.x): one weight a feature for all ordered thresholds; x marks the features a text has."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.w, self.threshold = np.zeros(0), np.full(GRADES - 1, 10.0)
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def hits(self, text: str | None) -> set[int]:
        found: set[int] = set()
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for word in set(WORDS(text.lower())) if text else ():
            at = known.get(word)
            if at is None:
                at = known[word] = tuple(self.index[f] for f in features_of(word) if f in self.index)
            if at:
                found.update(at)
        return found

    def above(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) of each text for k = 0, 1, ...: (texts, thresholds)."""
        total = np.array([sum([self.w[i] for i in sorted(self.hits(t))], 0.0) for t in texts])
        return 1 / (1 + np.exp(np.clip(self.threshold[None] - total[:, None], -500, 500)))

    def fit(self, x: np.ndarray, grade: np.ndarray, weight: np.ndarray, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> None:
        """Maximum likelihood by Adam; thresholds stay ordered as sums of exponentials."""
        x = x.astype(np.float32)
        theta = np.concatenate([np.zeros(x.shape[1]), [1.0], np.zeros(GRADES - 2)])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        share = weight / weight.sum()
        rows = np.arange(len(x))
        for i in range(1, rounds + 1):
            w, gaps = theta[: x.shape[1]], np.exp(theta[x.shape[1] + 1 :])
            t = theta[x.shape[1]] + np.concatenate([[0], np.cumsum(gaps)])
            cut = np.concatenate([[-1e9], t, [1e9]])
            below = 1 / (1 + np.exp(-np.clip(cut[None] - (x @ w.astype(np.float32))[:, None], -40, 40)))
            low, high = below[rows, grade], below[rows, grade + 1]
            p = np.maximum(high - low, 1e-9)
            d_low, d_high = low * (1 - low), high * (1 - high)
            d_eta = share * (d_low - d_high) / p
            slope_t = np.zeros(GRADES + 1)
            np.add.at(slope_t, grade + 1, share * d_high / p)
            np.add.at(slope_t, grade, -share * d_low / p)
            slope_t = slope_t[1:-1]
            tail = np.cumsum(slope_t[::-1])[::-1]
            slope = np.concatenate([x.T @ d_eta.astype(np.float32) - decay * w, [tail[0]], tail[1:] * gaps])
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
            theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-10)
        self.w = theta[: x.shape[1]].astype(float)
        self.threshold = theta[x.shape[1]] + np.concatenate([[0], np.cumsum(np.exp(theta[x.shape[1] + 1 :]))])


def _grades(texts: list[str], y: np.ndarray, odds: dict[str, float]) -> np.ndarray:
    """0 for clean texts; toxic ones by the thirds of their number of words with strongly toxic features."""
    strong = {f for f, o in odds.items() if o > 2.5}
    count = np.array([sum(any(f in strong for f in features_of(w)) for w in WORDS(t.lower())) if k else 0 for t, k in zip(texts, y)])
    cuts = np.quantile(count[y == 1], [1 / 3, 2 / 3])
    return np.where(y == 1, 1 + (count[:, None] > cuts[None]).sum(axis=1), 0)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = 2000, features: int = 2000, id_col: str = "doc_id", text: str = "text") -> Ordinal:
    """A model fitted on at most ``per_label`` training documents of each label (the bound of the sample), weighted to the labels' shares.

    Grades within the toxic ones come from the amount of toxic language. Features are the ``features`` words and
    word beginnings with the largest weighted log odds in the sample. Without both labels every text gets severity near 0.
    """
    texts, labels_, counts = labelled_sample(docs, labels, label, per_label, id_col=id_col, text=text)
    y = np.array(labels_)
    model = Ordinal()
    if len(set(labels_)) < 2:
        return model
    ids: dict[str, int] = {}
    of_word: dict[str, tuple[int, ...]] = {}

    def marks(t: str) -> np.ndarray:
        found = [of_word[w] if w in of_word else of_word.setdefault(w, tuple(ids.setdefault(f, len(ids)) for f in features_of(w))) for w in set(WORDS(t.lower()))]
        return np.unique(np.fromiter((i for one in found for i in one), np.int32))

    sets = [marks(t) for t in texts]
    n = [(y == 0).sum(), (y == 1).sum()]
    seen = [np.bincount(np.concatenate([s for s, k in zip(sets, labels_) if k == c]), minlength=len(ids)) for c in (0, 1)]
    odds_of = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    often = seen[0] + seen[1]
    names = list(ids)
    odds = {names[i]: float(odds_of[i]) for i in np.flatnonzero(often >= 4)}
    chosen = sorted(odds, key=lambda f: (-abs(odds[f]) * np.sqrt(often[ids[f]]), f))[:features]
    model.index = {f: i for i, f in enumerate(chosen)}
    place = np.full(len(ids), -1)
    place[[ids[f] for f in chosen]] = np.arange(len(chosen))
    x = np.zeros((len(texts), len(chosen)), np.float32)
    for row, s in zip(x, sets):
        at = place[s]
        row[at[at >= 0]] = 1
    weight = np.array([counts[k] / n[k] for k in labels_], float)
    model.fit(x, _grades(texts, y, odds), weight)
    return model


def score_documents(docs: DataFrame, model: Ordinal, limit: float = 0.5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, severity, grade, score, predicted) of every row, from its whole text.

    severity: expected grade, 0 to 3; grade: the nearest whole grade; score: P(grade > 0); predicted: 1 if score is at
    least ``limit``. Null and empty texts have no features. Very long texts are scored whole; a score just at ``limit`` is toxic;
    repeated rows and null ids stay; other columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches):
            above = shared.value.above(texts)
            severity = above.sum(axis=1)
            columns = [pa.array(severity, pa.float64()), pa.array(np.rint(severity).astype(np.int32), pa.int32()), pa.array(above[:, 0], pa.float64()), pa.array((above[:, 0] >= limit).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "severity", "grade", "score", "predicted"])

    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, severity double, grade int, score double, predicted int")
