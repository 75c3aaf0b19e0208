"""Removal of repeated byte strings: a suffix order cut off at the threshold, by most-significant-digit radix passes.

Two suffixes share a repeated string when they agree in their first ``length`` bytes. Every suffix is first filed under the
smallest hash of a gram inside those bytes (the first such gram), which equal strings share: consecutive starts with the same
gram, at the same place, make a run, whose context is all that its strings cover. A gram that occurs once settles its run. Runs of one context
that occurs twice are repeated as a whole. What is left, one run for each distinct context of a gram with several, is ordered by
radix passes over digits of eight bytes, classes of one dropping out after each pass; the classes that reach the threshold are the
repeated strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_runs, written

#: Bytes of a gram and of a radix digit.
GRAM, DIGIT = 32, 8
#: Bytes that are hashed together.
BLOCK = 250_000
#: Contexts of one gram that one task orders; those of a gram with more are dealt to several, whose classes then meet by hash.
CROWD, BUCKET = 4096, 500_000
#: log2 of the bits of the filters that keep back what cannot matter; a full filter only costs shuffling.
FILTER_BITS = 26
ODD, MIX1, MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
TABLES = np.random.default_rng(13).integers(1, 2**63, (2, 256), dtype=np.uint64)


def rolling(data: np.ndarray, size: int, table: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each position, made by doubling."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    power, width, done, out = ODD, 1, 0, None
    step = TABLES[table][data]
    while True:
        if size & width:  # the next ``width`` bytes after those done
            part = step[done : done + len(data) - size + 1]
            out = part.copy() if out is None else out * power + part
            done += width
        if 2 * width > size:
            break
        step, power, width = step[:-width] * power + step[width:], np.uint64(int(power) ** 2 % 2**64), 2 * width
    out ^= out >> np.uint64(31)
    out *= MIX1
    out ^= out >> np.uint64(29)
    out *= MIX2
    return out ^ (out >> np.uint64(32))


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row."""
    low, have = values, 1
    while 2 * have <= width:
        low, have = np.minimum(low[:-have], low[have:]), 2 * have
    return np.minimum(low[: len(low) - (width - have)], low[width - have :]) if width > have else low


def runs_of(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, start, count, gram) of the runs of the texts, in blocks of bytes."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    for at in range(0, len(data), BLOCK):
        piece = data[at : at + BLOCK + length - 1]
        if len(piece) < length:
            break
        hashes = rolling(piece, GRAM)
        low = smallest(hashes, length - GRAM + 1)
        first, last = np.searchsorted(ends, at, "right"), np.searchsorted(begins, at + BLOCK, "left")
        valid = [np.arange(max(b - at, 0), min(e - length - at, BLOCK - 1) + 1) for b, e in zip(begins[first:last], ends[first:last], strict=True) if e - b >= length]
        p = np.concatenate(valid) if valid else np.zeros(0, np.int64)
        if not len(p):
            continue
        gram = low[p]
        new = np.ones(len(p), bool)  # the first of the smallest grams is another one: a smaller came, or that one stays behind
        new[1:] = (gram[1:] != gram[:-1]) | (hashes[p[:-1]] == gram[:-1]) | (p[1:] != p[:-1] + 1)
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, len(p)))
        start = p[heads] + at
        text = np.searchsorted(ends, start, "right")
        yield text, start - begins[text], counts, gram[heads].astype(np.int64)


def repeated_windows(data: np.ndarray, position: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, class) of the suffixes at ``position``, sorted by group, that agree with another of their group in ``length`` bytes.

    Radix passes from the most significant digit: a class whose next digits differ is sorted by them and divided, and
    suffixes alone in their class drop out. The last digit overlaps the one before where the length is no multiple of it.
    """
    packed = data[: len(data) - DIGIT + 1].astype(np.uint64)
    for k in range(1, DIGIT):
        packed = (packed << np.uint64(8)) | data[k : len(data) - DIGIT + 1 + k]
    order = np.arange(len(position))
    head = np.ones(len(order), bool)
    head[1:] = group[1:] != group[:-1]
    for depth in [*range(0, length - DIGIT + 1, DIGIT), *([length - DIGIT] if length % DIGIT else [])]:
        alone = head & np.append(head[1:], True)
        order, head = order[~alone], head[~alone]
        if not len(order):
            break
        digit = packed[position[order] + depth]
        differs = np.zeros(len(order), bool)
        differs[1:] = (digit[1:] != digit[:-1]) & ~head[1:]
        if differs.any():
            number = np.cumsum(head) - 1
            mixed = np.zeros(number[-1] + 1, bool)
            mixed[number[differs]] = True
            rows = np.flatnonzero(mixed[number])
            sort = rows[np.lexsort((digit[rows], number[rows]))]
            order[rows], digit[rows] = order[sort], digit[sort]
            head[1:] |= digit[1:] != digit[:-1]
    alone = head & np.append(head[1:], True) if len(head) else head
    order, head = order[~alone], head[~alone]
    return order, np.cumsum(head) - 1


MASK = (1 << FILTER_BITS) - 1


def _slot(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(MASK))


def _filter(rows: DataFrame, slot: Column) -> np.ndarray:
    """The bits of all slots of the rows: 8 MB however many rows there are."""
    bits = rows.groupBy(F.shiftright(slot, 5).cast("int").alias("w")).agg(F.bit_or(F.pow(F.lit(2.0), slot.bitwiseAND(F.lit(31))).cast("long")).alias("b")).toArrow()
    filled = np.zeros(1 << FILTER_BITS - 5, np.int64)
    filled[bits.column("w").to_numpy()] = bits.column("b").to_numpy()
    return filled


def _set(filled: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (filled[slot >> 5] >> (slot & 31) & 1).astype(bool)


RUNS = "gram long, digest long, key binary, start int, count int"
FOUND = "key binary, start int, count int"
MEETS = f"{FOUND}, bucket int, h1 array<long>, h2 array<long>, open array<boolean>, keys array<binary>, at array<int>"
NAMES = [c.split()[0] for c in MEETS.split(", ")]


class Repeats:
    """The jobs over one table of texts."""

    def __init__(self, docs: DataFrame, length: int, id_col: str, text: str):
        self.length, self.spark = length, docs.sparkSession
        body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
        self.docs = docs.select(F.col(id_col).alias("_id"), body.alias("body")).withColumn("key", F.unhex(F.md5("body")))

    def runs(self) -> DataFrame:
        """All runs whose gram occurs twice or more, but for a few that the filter lets pass."""
        length = self.length

        def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, texts in text_runs(batches, BLOCK):
                found = [gram for *_, gram in runs_of(texts, length)]
                gram, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], ["gram", "n"])

        repeated = self.docs.select("key", "body").mapInArrow(grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
        shared = self.spark.sparkContext.broadcast(_filter(repeated, F.col("gram").bitwiseAND(F.lit(MASK))))

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in text_runs(batches, BLOCK):
                for text, start, count, gram in runs_of(texts, length):
                    wanted = np.flatnonzero(_set(shared.value, gram & MASK))
                    text, start, count, gram = text[wanted], start[wanted], count[wanted], gram[wanted]
                    spans = zip(text.tolist(), start.tolist(), (start + count + length - 1).tolist(), strict=True)
                    digest = np.array([int.from_bytes(hashlib.blake2b(texts[t][a:b], digest_size=8).digest(), "little", signed=True) for t, a, b in spans], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(digest), part.column(0).take(pa.array(text)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], ["gram", "digest", "key", "start", "count"])

        return written(self.docs.select("key", "body").mapInArrow(keep, RUNS), "runs")

    def contexts(self, asked: DataFrame) -> DataFrame:
        """(gram, salt, salts, digest, key, start, count, bytes) of asked runs, which carry the key of their text."""
        length = self.length
        wanted = written(asked.groupBy("key").agg(F.collect_list(F.struct("gram", "salt", "salts", "digest", "start", "count")).alias("runs")), "asked")
        near = self._passing(self.docs.select("key", "body"), _filter(wanted, _slot(F.col("key"))), True)
        joined = near.join(wanted, "key").select("key", "body", F.col("runs.gram").alias("g"), F.col("runs.salt").alias("s"), F.col("runs.salts").alias("of"), F.col("runs.digest").alias("d"), F.col("runs.start").alias("a"), F.col("runs.count").alias("n"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = None
            for whole in batches:
                keys, rows = whole.column(0).to_pylist(), []
                for row, key in enumerate(keys):
                    if key != last:  # copies of a text follow each other
                        rows.append(row)
                    last = key
                batch = whole.take(pa.array(rows, pa.int64()))
                sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(rows)), sizes.astype(np.int64))
                g, s, of, d, a, n = (batch.column(k).flatten() for k in range(2, 8))
                bodies = batch.column(1).to_pylist()
                cuts = [bodies[o][x : x + y + length - 1] for o, x, y in zip(owner.tolist(), a.to_pylist(), n.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([g, s, of, d, batch.column(0).take(pa.array(owner)), a, n, pa.array(cuts, pa.binary())], ["gram", "salt", "salts", "digest", "key", "start", "count", "bytes"])

        return joined.mapInArrow(cut, "gram long, salt int, salts int, digest long, key binary, start int, count int, bytes binary")

    def _passing(self, rows: DataFrame, filled: np.ndarray, inside: bool) -> DataFrame:
        """The rows whose key the filter holds (inside) or surely does not."""
        shared = self.spark.sparkContext.broadcast(filled)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask = _set(shared.value, batch.column(0).to_numpy())
                yield batch.filter(pa.array(mask if inside else ~mask)).select(range(1, batch.num_columns))

        return rows.select(_slot(F.col("key")).alias("_slot"), *rows.columns).mapInArrow(run, rows.schema)

    def ordered(self, contexts: DataFrame, buckets: int) -> DataFrame:
        """Repeated starts among contexts of a gram; of grams dealt to several tasks also every class, filed by its hash."""
        length = self.length

        def settle(held: list[dict]) -> Iterator[pa.RecordBatch]:
            col = {c: [x for h in held for x in h[c]] for c in held[0]}
            seen, keep = set(), []
            for i, k in enumerate(zip(col["gram"], col["digest"], strict=True)):
                if k not in seen:
                    seen.add(k)
                    keep.append(i)
            group = pd.factorize(np.array([col["gram"][i] for i in keep]))[0]
            sizes = np.array([len(col["bytes"][i]) for i in keep], np.int64)
            counts = np.array([col["count"][i] for i in keep], np.int64)
            data = np.frombuffer(b"".join(col["bytes"][i] for i in keep), np.uint8)
            owner = np.repeat(np.arange(len(keep)), counts)
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            position = (np.cumsum(sizes) - sizes)[owner] + offset
            by_group = np.argsort(group[owner], kind="stable")
            order, number = repeated_windows(data, position[by_group], group[owner][by_group], length)
            same = by_group[order]
            start = np.array([col["start"][i] for i in keep], np.int64)
            found = np.zeros(len(owner), bool)
            found[same] = True
            at = np.flatnonzero(found)
            if len(at):  # consecutive starts of a context leave as one row
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
                heads = np.flatnonzero(new)
                first, n = at[heads], np.diff(np.append(heads, len(at)))
                yield pa.RecordBatch.from_arrays([pa.array([col["key"][keep[o]] for o in owner[first]], pa.binary()), pa.array((start[owner[first]] + offset[first]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.nulls(len(heads), pa.int32()), *(pa.nulls(len(heads), pa.list_(t)) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32()))], NAMES)
            dealt = np.array([col["salts"][i] > 1 for i in keep])[owner]
            if dealt.any():
                later = np.zeros(len(owner), bool)  # of each class one is filed, with those that are alone
                later[same[1:]] = number[1:] == number[:-1]
                at = np.flatnonzero(dealt & ~later)
                h1, h2 = (rolling(data, length, k)[position[at]].astype(np.int64) for k in (0, 1))
                bucket = (h1 & 0x7FFFFFFF) % buckets
                by = np.argsort(bucket, kind="stable")
                for b, rows in zip(*_pieces(bucket[by], by), strict=True):
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.array([int(b)], pa.int32()), pa.array([h1[rows]], pa.list_(pa.int64())), pa.array([h2[rows]], pa.list_(pa.int64())), pa.array([~found[at[rows]]], pa.list_(pa.bool_())),
                         pa.array([[col["key"][keep[o]] for o in owner[at[rows]]]], pa.list_(pa.binary())), pa.array([(start[owner[at[rows]]] + offset[at[rows]]).astype(np.int32)], pa.list_(pa.int32()))], NAMES)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, windows, last = [], 0, None
            for batch in batches:
                gram, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                turns = np.flatnonzero((gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])) + 1
                cuts = [0, *turns.tolist(), batch.num_rows]
                rows, count = batch.to_pydict(), batch.column(6).to_numpy()
                begin = 0
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if b > a:
                        me = (gram[a], salt[a])
                        if windows >= 150_000 and me != last:
                            if a > begin:
                                held.append({c: v[begin:a] for c, v in rows.items()})
                                begin = a
                            yield from settle(held)
                            held, windows = [], 0
                        windows, last = windows + int(count[a:b].sum()), me
                if batch.num_rows > begin:
                    held.append({c: v[begin:] for c, v in rows.items()})
            if held:
                yield from settle(held)

        dealt = contexts.repartition("gram", "salt").sortWithinPartitions("gram", "salt")
        return written(dealt.mapInArrow(run, MEETS), "ordered")

    def met(self, ordered: DataFrame) -> DataFrame:
        """Starts that are alone in their task but whose string another task has filed too, by a hash of 128 bits."""

        def meet(rows: pd.DataFrame) -> pd.DataFrame:
            h1, h2, alone, keys, at = (np.concatenate([np.asarray(x) for x in rows[c]]) for c in ("h1", "h2", "open", "keys", "at"))
            order = np.lexsort((h2, h1))
            same = np.zeros(len(order) + 1, bool)
            same[1:-1] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
            found = order[(same[1:] | same[:-1]) & alone[order]]
            return pd.DataFrame({"key": keys[found], "start": at[found].astype(np.int32), "count": np.ones(len(found), np.int32)})

        return ordered.where("bucket is not null").groupBy("bucket").applyInPandas(meet, FOUND)

    def ranges(self) -> DataFrame:
        """(key, spans) of the texts that hold repeated strings: (start, count) of their first bytes."""
        runs = self.runs()
        contexts = written(runs.groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "start", "count")).alias("one")), "contexts")
        copied = written(contexts.where("n > 1").select("gram", "digest"), "copied")
        whole = runs.join(copied, ["gram", "digest"], "left_semi").select("key", "start", "count")
        several = written(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").withColumn("salts", F.ceil(F.col("kinds") / CROWD).cast("int")).select("gram", "salts"), "several")
        asked = contexts.join(several, "gram").select("gram", "digest", "salts", F.pmod(F.xxhash64("digest"), F.col("salts")).cast("int").alias("salt"), "one.*")
        crowds = asked.where("salts > 1").agg(F.sum("count").alias("n")).first()["n"] or 0
        ordered = self.ordered(self.contexts(asked), 1 + crowds // BUCKET)
        found = whole.unionByName(ordered.where("key is not null").select("key", "start", "count"))
        found = found.unionByName(self.met(ordered)) if crowds else found
        return written(found.distinct().groupBy("key").agg(F.collect_list(F.struct("start", "count")).alias("spans")), "spans")

    def removed(self) -> DataFrame:
        """(_id, n_bytes, spans, kept) of every row."""
        length, ranges = self.length, self.ranges()
        filled = _filter(ranges, _slot(F.col("key")))
        rows = self.docs.select("key", "_id", "body")
        inside = self._passing(rows, filled, True).join(ranges, "key", "left").select("_id", "body", F.col("spans.start").alias("a"), F.col("spans.count").alias("n"))
        kind = f"_id {self.docs.schema['_id'].dataType.simpleString()}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"

        def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, bodies in text_runs(batches, BLOCK):
                spans, kept = [], []
                for body, a, n in zip(bodies, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    merged: list[list[int]] = []
                    for x, y in sorted(zip(a or (), n or (), strict=True)):
                        end = x + y + length - 1
                        if merged and x <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], end)
                        else:
                            merged.append([x, end])
                    edges = [0, *(v for m in merged for v in m), len(body)]
                    kept.append(b"".join(body[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)) if merged else body)
                    spans.append([{"start": x, "end": y} for x, y in merged])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(b) for b in bodies], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], ["_id", "n_bytes", "spans", "kept"])

        outside = self._passing(rows, filled, False).select("_id", "body")
        clean = outside.select("_id", F.octet_length("body").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.col("body").alias("kept"))
        return inside.mapInArrow(clear, kind).unionByName(clean)


def _pieces(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct sorted values and the rows of each."""
    distinct, first = np.unique(values, return_index=True)
    return distinct, np.split(rows, first[1:]) if len(distinct) else []


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept) of every row: its UTF-8 bytes without those that a repeated string of ``length`` bytes covers.

    A string is repeated if it also starts anywhere else, in the same text or another; strings are judged on the input and do
    not cross texts. ``spans`` are the maximal removed runs of bytes, in order; ``kept`` are the bytes that remain, which need not
    be valid UTF-8. Null texts count as empty; texts under ``length`` bytes stay whole; rows of equal text, also those of one
    id or of null ids, are copies of each other and lose all bytes if they have ``length``; very long texts are taken whole,
    in blocks; other columns are not read; an empty table gives no rows. ``length`` is at least 32, the size of a gram.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    return Repeats(docs, length, id_col, text).removed().withColumnRenamed("_id", id_col)
