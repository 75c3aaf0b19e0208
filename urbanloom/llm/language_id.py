"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled, text_runs

#: Character classes of an automaton: 0 for what is no letter, OTHERS classes that other letters share, then the commonest letters.
CLASSES, OTHERS = 64, 16
#: Every text is parsed whole, in segments of so many characters side by side, so that one long text costs as much per character
#: as many short ones. A phrase over a cut counts twice: at most one more phrase for 4,096 characters, under each language alike.
SEGMENT = 4096


def _shared_class(points: np.ndarray) -> np.ndarray:
    """The class of letters that are not among the commonest, by a hash of the character; large scripts keep what tells words apart."""
    return (1 + (points.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(OTHERS)).astype(np.uint8)


def automaton(symbols: list[int], classes: int = CLASSES) -> np.ndarray:
    """A suffix automaton as the flat transition table of a cross parser.

    Entry ``state * classes + symbol`` holds ``2 * next_state * classes + ends``: where the text goes on in the
    training text the match grows (ends 0); else a phrase ends and the next one begins with this symbol (ends 1).
    """
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    root = np.ones(classes, np.int32)
    for c, s in step[0].items():
        root[c] = 2 * s * classes + 1
    table = np.tile(root, (len(step), 1))
    for s, out in enumerate(step):
        for c, q in out.items():
            table[s, c] = 2 * q * classes
    return table.ravel()


class CrossParser:
    """Automata of several languages over one alphabet."""

    def __init__(self, texts: dict[str, list[str]], chars: int):
        seen: dict[str, int] = {}
        for of in texts.values():
            for c in "".join(of).lower():
                if c.isalpha():
                    seen[c] = seen.get(c, 0) + 1
        self.classes = np.zeros(0x10000, np.uint8)
        letters = np.array([i for i in range(0x10000) if chr(i).isalpha()])
        self.classes[letters] = _shared_class(letters)
        for k, c in enumerate(sorted(seen, key=lambda c: (-seen[c], c))[: CLASSES - 1 - OTHERS]):
            if ord(c) < 0x10000:
                self.classes[ord(c)] = k + 1 + OTHERS
        self.langs, self.tables, self.bits = [], [], []
        for lang in sorted(texts):
            flat, _, _ = self.symbols(texts[lang])
            flat = flat[:chars]
            if flat.any():
                self.langs.append(lang)
                self.tables.append(automaton(flat.tolist()))
                self.bits.append(np.log2(len(flat) + 1))

    def symbols(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The classes of all characters, runs of non-letters as one; how many each text has; whether it has a letter."""
        low = [t.lower() if t else "" for t in texts]
        points = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
        found = self.classes[np.minimum(points, 0xFFFF)]
        if (far := np.flatnonzero(points >= 0x10000)).size:
            found[far] = _shared_class(points[far]) * np.array([chr(p).isalpha() for p in points[far]])
        of = np.repeat(np.arange(len(low)), [len(t) for t in low])
        gap = found == 0
        keep = ~gap
        keep[1:] |= ~gap[:-1]
        letters = np.bincount(of, weights=~gap, minlength=len(low)) > 0
        return found[keep], np.bincount(of[keep], minlength=len(low)), letters

    def phrases(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each text under each language: (texts, languages)."""
        pieces = -(-sizes // SEGMENT)
        of = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(np.cumsum(sizes) - sizes, pieces) + nth * SEGMENT
        long = np.minimum(SEGMENT, sizes[of] - nth * SEGMENT)
        order = np.argsort(-long, kind="stable")
        of, begin, long = of[order], begin[order], long[order]
        out = np.zeros((len(sizes), len(self.tables)))
        if not len(of):
            return out
        active = len(long) - np.searchsorted(long[::-1], np.arange(SEGMENT), side="right")
        columns = [flat[begin[:n] + j].astype(np.int32) for j, n in enumerate(active) if n]
        for k, table in enumerate(self.tables):
            state, count = np.zeros(len(of), np.int32), np.ones(len(of), np.int32)
            for symbol in columns:
                n = len(symbol)
                at = state[:n]
                at += symbol
                now = table[at]
                count[:n] += now & 1
                np.right_shift(now, 1, out=at)
            out[:, k] = np.bincount(of, weights=count, minlength=len(sizes))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its share of the languages' inverse costs."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        flat, sizes, letters = self.symbols(texts)
        cost = self.phrases(flat, sizes) * np.array(self.bits) / np.maximum(sizes, 1)[:, None]
        best = cost.argmin(axis=1)
        inverse = 1 / np.maximum(cost, 1e-9)
        share = np.where(letters, inverse[np.arange(len(texts)), best] / inverse.sum(axis=1), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters)], share


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", texts: int = 64, chars: int = 40_000, per_text: int = 2_501) -> CrossParser:
    """Automata from at most ``texts`` distinct texts, the first ``per_text`` characters of each and ``chars`` characters in all of each language (the bounds of the sample).

    Rows without text or language are passed over. Ties between languages go to the first by name.
    """
    rows = sampled(labelled, lang, texts, text).select(lang, F.substring(text, 1, per_text).alias(text)).collect()
    by: dict[str, list[str]] = {}
    for row in rows:
        by.setdefault(row[0], []).append(row[1])
    return CrossParser(by, chars)


def identify(docs: DataFrame, parser: CrossParser, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, from its whole text.

    The language whose automaton needs the fewest phrases per character, weighted by the bits that point into its
    training text, wins. Text that is null, empty or without a letter: ``und`` with score 0. Repeated rows and ids stay; very long texts
    are taken whole; ties go to the first language by name; only the two named columns are read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches):
            lang, score = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {kind.simpleString()}, lang_pred string, score double")
