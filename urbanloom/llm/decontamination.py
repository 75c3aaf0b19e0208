"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, text_runs

WORDS, BREAK = re.compile(r"[^\W_]+").findall, re.compile(r"[\W_]").search
#: Tiles have so many words at least; an item of fewer words is one seed of its own length.
LEAST = 4
#: Share of an item's words that tiles must cover.
COVERAGE = 0.6
#: Characters of items that are broadcast at a time; a larger benchmark is worked through in blocks.
BLOCK_CHARS = 16_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Windows of a text that are hashed at a time, pairs of places that are compared at a time, characters that are split at a time.
SEGMENT, PAIRS, SPLIT = 262_144, 1_000_000, 1_000_000
#: Distinct words whose hashes a task remembers.
REMEMBERED = 1_000_000


def _word_hash(word: str) -> int:
    raw = word.encode("utf-8", "replace")
    return (zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x5BD1E995)) ^ len(raw) << 20


class WordHashes(dict):
    """64-bit hashes by word, made when first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = _word_hash(word)
        return value


def windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n words."""
    if len(ids) < n:
        return ids[:0]
    out = ids[: len(ids) - n + 1].copy()
    for k in range(1, n):
        out *= BASE
        out += ids[k : len(ids) - n + 1 + k]
    return out ^ (out >> np.uint64(29))


def segments(text: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, hashes) of the windows of a text, some at a time."""
    for at in range(0, max(0, len(text) - least + 1), SEGMENT):
        yield at, windows(text[at : at + SEGMENT + least - 1], least)


def _matches(item: np.ndarray, text: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words, starts in item, starts in text), some at a time by place in the text, of all matches of at least ``least`` words that can't be made longer.

    Karp-Rabin hashes of the windows of both give the places that may agree, the words themselves decide. A place whose
    words before it agree too lies inside a match; the others are where matches start, and are followed to their ends.
    """
    of_item = windows(item, least)
    order = np.argsort(of_item, kind="stable")
    sorted_item = of_item[order]
    for at, of_text in segments(text, least):
        first, last = (np.searchsorted(sorted_item, of_text, side) for side in ("left", "right"))
        n = last - first
        total = np.cumsum(n)
        edges = np.unique(np.r_[0, np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS)), len(n)])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            some = n[a:b]
            j = np.repeat(np.arange(a, b), some) + at
            i = order[np.repeat(first[a:b] - np.cumsum(some) + some, some) + np.arange(some.sum())]
            start = (i == 0) | (j == 0) | (item[i - 1] != text[j - 1])
            i, j = i[start], j[start]
            for k in range(least):
                same = item[i + k] == text[j + k]
                i, j = i[same], j[same]
            size, open_ = np.full(len(i), least), np.arange(len(i))
            while len(open_):
                x, y = i[open_] + size[open_], j[open_] + size[open_]
                inside = (x < len(item)) & (y < len(text))
                open_, x, y = open_[inside], x[inside], y[inside]
                open_ = open_[item[x] == text[y]]
                size[open_] += 1
            if len(i):
                yield size, i, j


def _earliest(matches: list[tuple[np.ndarray, np.ndarray, np.ndarray]], words: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matches without those that can never be marked, as enough of the same words and length come before them in the text.

    Tiles mark no more words of the text than the item has, and there are at most words / least of them, so they touch at
    most ``words + words / least * n`` places at which n words start. Of more matches that start at one place of the item and
    are n words long, one of the earlier is therefore always free, and would be marked first.
    """
    n, i, j = (np.concatenate(x) for x in zip(*matches, strict=True))
    order = np.lexsort((j, n, i))
    n, i, j = n[order], i[order], j[order]
    new = np.r_[True, (np.diff(i) != 0) | (np.diff(n) != 0)]
    rank = np.arange(len(n)) - np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))
    keep = rank <= words + words // least * n
    return n[keep], i[keep], j[keep]


def tile(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Non-overlapping tiles (start in item, start in text, words), longest first, none under ``least`` words.

    Always the longest match of unmarked words is marked next (ties: first in the item, then in the text). A match that
    tiles have cut into is not marked; what is left of it waits for its own length. Memory is bounded by the item, whatever the text
    repeats; time is their product where one word is all there is.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for part in _matches(item, text, least):
        held.append(part)
        if sum(len(n) for n, *_ in held) > PAIRS and len(held) > 1:
            held = [_earliest(held, len(item), least)]
    if not held:
        return []
    n, i, j = _earliest(held, len(item), least)
    order = np.lexsort((j, i, -n))
    ready = zip((-n[order]).tolist(), i[order].tolist(), j[order].tolist(), strict=True)
    in_item = np.zeros(len(item), bool)
    in_text: set[int] = set()  # the marked words of the text, which are as many as those of the item
    tiles: list[tuple[int, int, int]] = []
    cut: list[tuple[int, int, int]] = []
    following = next(ready, None)
    while following or cut:
        if cut and (following is None or cut[0] < following):
            n, i, j = heapq.heappop(cut)
        else:
            (n, i, j), following = following, next(ready, None)
        taken = in_item[i : i - n].copy()
        if not taken.all() and in_text:
            taken |= np.fromiter((k in in_text for k in range(j, j - n)), bool, -n)
        if not taken.any():
            in_item[i : i - n] = True
            in_text.update(range(j, j - n))
            tiles.append((i, j, -n))
            free = np.flatnonzero(np.diff(np.r_[True, in_item, True].astype(np.int8)))
            if not len(free) or (free[1::2] - free[::2]).max() < least:
                break
        elif not taken.all():
            edge = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= least:
                    heapq.heappush(cut, (a - b, i + a, j + a))
    return tiles


class Benchmark:
    """A block of items with their words and the table of their seeds."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST):
        self.least = least
        self.items = [(k, np.array([_word_hash(w) for w in WORDS(t.lower())], np.uint64)) for k, t in items if t]
        self.items = [(k, ids) for k, ids in self.items if len(ids)]
        seeds: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for n, (_, ids) in enumerate(self.items):
            size = min(least, len(ids))
            for i, h in enumerate(windows(ids, size).tolist()):
                seeds.setdefault(size, {}).setdefault(h, []).append((n, i))
        self.seeds = seeds
        self.bits = {}
        for size, table in seeds.items():
            mark = np.zeros(1 << 20, bool)
            mark[(np.fromiter(table, np.uint64, len(table)) >> np.uint64(44)).astype(np.int64)] = True
            self.bits[size] = mark

    def candidates(self, text: np.ndarray) -> dict[int, np.ndarray]:
        """Items that share seeds with the text, with the marks of their words that shared seeds cover."""
        out: dict[int, np.ndarray] = {}
        for size, table in self.seeds.items():
            likely: set[int] = set()
            for _, hashes in segments(text, size):
                likely.update(np.unique(hashes[self.bits[size][(hashes >> np.uint64(44)).astype(np.int64)]]).tolist())
            for h in likely:
                for n, i in table.get(h, ()):
                    if n not in out:
                        out[n] = np.zeros(len(self.items[n][1]), bool)
                    out[n][i : i + size] = True
        return out

    def leaks(self, text: np.ndarray, coverage: float) -> Iterator[tuple[int, float, int, int]]:
        """(item, share of its words under tiles, tiles, words in the longest) of items at or over ``coverage``."""
        for n, covered in sorted(self.candidates(text).items()):
            item, ids = self.items[n]
            if covered.sum() < coverage * len(ids):  # tiles lie within shared seeds
                continue
            tiles = tile(ids, text, min(self.least, len(ids)))
            share = sum(k for *_, k in tiles) / len(ids)
            if share >= coverage:
                yield item, share, len(tiles), max(k for *_, k in tiles)


def blocks(benchmark: DataFrame, id_col: str, text: str) -> Iterator[Benchmark]:
    """The benchmark in parts of about BLOCK_CHARS characters, chosen by the hash of the item's id."""
    size = benchmark.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n")).first()["n"]
    count = size // BLOCK_CHARS + 1
    for b in range(count):
        rows = benchmark.where(F.pmod(F.xxhash64(id_col), F.lit(count)) == b).select(id_col, text).orderBy(id_col, text).collect()
        yield Benchmark([(r[0], r[1]) for r in rows])


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """(id, item_id, coverage, tiles, longest) of every pair of a document and an item whose words tiles cover to ``coverage``.

    Words are runs of letters and digits of the lower-cased whole text. Tiles may come in any order, so reordered
    passages count. Null, empty and wordless texts and items match nothing; repeated rows give their pairs each, and so do
    repeated items. Coverage just at the threshold counts. Very long texts are taken whole. Only the named columns are read;
    where both id columns have one name, the item's is ``item_`` and that name. Empty tables give no rows.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_type = benchmark.limit(0).select(item_col).toArrow().schema.field(0).type
    out_item = item_col if item_col != id_col else f"item_{item_col}"

    def pairs(block: Benchmark) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch, texts in text_runs(batches):
                rows, found = [], []
                for i, t in enumerate(texts):
                    for leak in shared.value.leaks(word_ids(t, hashes), coverage) if t else ():
                        rows.append(i)
                        found.append(leak)
                ids = batch.column(0).take(pa.array(rows, pa.int64()))
                item, share, tiles, longest = zip(*found) if found else ((), (), (), ())
                yield pa.RecordBatch.from_pydict({id_col: ids, out_item: pa.array(item, item_type), "coverage": pa.array(share, pa.float64()), "tiles": pa.array(tiles, pa.int32()), "longest": pa.array(longest, pa.int32())})

        return docs.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, {out_item} {item_kind}, coverage double, tiles int, longest int")

    return reduce(DataFrame.unionByName, map(pairs, blocks(benchmark, item_col, item_text)))


def word_ids(text: str, hashes: WordHashes) -> np.ndarray:
    """The words' hashes; a long text is split a part at a time, between words."""
    low, at, out = text.lower(), 0, []
    while at < len(low) or not out:
        gap = BREAK(low, at + SPLIT) if at + SPLIT < len(low) else None
        end = gap.start() if gap else len(low)
        words = WORDS(low, at, end)
        out.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, item_col: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """The rows, with all their columns, that hold no item to ``coverage``; each block of items filters what the last one kept."""

    def clean(block: Benchmark, texts: list[str | None]) -> list[bool]:
        hashes = WordHashes()
        return [not t or next(block.leaks(word_ids(t, hashes), coverage), None) is None for t in texts]

    for block in blocks(benchmark, item_col, item_text):
        docs = keep_rows(docs, block, clean, text)
    return docs
