"""Packing of sequences into bins of one capacity: on tables range by range, on streams with the unfinished bin kept as state."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from .rounds import settled

#: Rows of a table's range, which one task packs window by window.
RANGE_ROWS = 1_000_000


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of row numbers: longest first (ties: earlier first), each into the fullest bin with room (ties: the oldest); a longer row has a bin of its own.

    The rooms are kept in order, so a row finds its bin by bisection.
    """
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []
    for row in sorted(range(len(lengths)), key=lambda r: (-lengths[r], r)):
        at = bisect_left(rooms, (lengths[row], -1))
        room, k = rooms.pop(at) if at < len(rooms) else (capacity, len(bins))
        if k == len(bins):
            bins.append([])
        bins[k].append(row)
        insort(rooms, (room - lengths[row], k))
    return bins


def pack_sequences(df: DataFrame, key: str, length: str, capacity: int, window: int = 1000) -> DataFrame:
    """(key, length, bin): every row once, in bins of total length at most ``capacity`` unless one row alone is longer.

    Rows are packed in key order, ``window`` at a time by best fit; the last bin of a window is not closed but goes on into
    the next. Ranges of about a million rows are packed beside each other; the last window of each is left, and what is left
    of all ranges is packed in turn until one range holds it. A null length counts as 0; repeated keys are rows of their own; an empty
    table gives no bins.
    """
    kind = f"{key} {df.schema[key].dataType.simpleString()}, {length} {df.schema[length].dataType.simpleString()}"
    rest, done, level = df.select(key, length), None, 0
    while True:
        count = rest.count()
        ranges = max(1, -(-count // RANGE_ROWS))

        def pack(parts: Iterator[pd.DataFrame], last: bool = ranges == 1, level: int = level) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            name, number, held = f"{level}-{TaskContext.get().partitionId()}", 0, None

            def close(rows: pd.DataFrame, finished: bool) -> tuple[pd.DataFrame, pd.DataFrame | None]:
                nonlocal number
                bins = best_fit(rows[length].fillna(0).astype(int).tolist(), capacity)
                shut, kept = (bins, None) if finished else (bins[:-1], rows.iloc[bins[-1]])
                names = {r: f"{name}-{number + k}" for k, b in enumerate(shut) for r in b}
                number += len(shut)
                out = rows.iloc[sorted(names)]
                return out.assign(bin=np.array([names[r] for r in sorted(names)], object), open=False), kept

            for part in parts:
                for at in range(0, len(part), window):
                    rows = part.iloc[at : at + window]
                    if held is not None:
                        out, held = close(held, False)
                        yield out
                    held = rows if held is None else pd.concat([held, rows])
            if held is not None:
                yield close(held, True)[0] if last else held.assign(bin=np.full(len(held), None, object), open=True)

        spread = rest.repartitionByRange(ranges, key) if ranges > 1 else rest.coalesce(1)
        packed = settled(spread.sortWithinPartitions(key, length).mapInPandas(pack, f"{kind}, bin string, open boolean"))
        shut = packed.where("not open").drop("open")
        done = shut if done is None else done.unionByName(shut)
        if ranges == 1:
            return done
        rest, level = packed.where("open").select(key, length), level + 1


class _Packer(StatefulProcessor):
    """Rows that are not in a closed bin wait in list state; a timer closes their bins when a shard has been idle."""

    def __init__(self, key: str, length: str, capacity: int, interval: int, idle_ms: int, kind: StructType):
        self.key, self.length, self.capacity, self.interval, self.idle_ms, self.kind = key, length, capacity, interval, idle_ms, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.kind)
        self.number = handle.getValueState("number", StructType([StructField("n", LongType())]))

    def _close(self, shard, rows: list[tuple], finished: bool) -> tuple[pd.DataFrame, list[tuple]]:
        bins = best_fit([int(r[1] or 0) for r in rows], self.capacity)
        shut, kept = (bins, []) if finished else (bins[:-1], [rows[r] for r in bins[-1]])
        first = self.number.get()[0] if self.number.exists() else 0
        self.number.update((first + len(shut),))
        out = [(shard, *rows[r], f"{shard}-{first + k}") for k, b in enumerate(shut) for r in b]
        return pd.DataFrame(out, columns=["shard", self.key, self.length, "bin"], dtype=object), kept  # texts as objects: the sink takes no chunked arrays

    def _keep(self, rows: list[tuple]) -> None:
        if rows:
            self.waiting.put(rows)
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        for part in rows:
            held += [(k, int(n) if pd.notna(n) else 0) for k, n in zip(part[self.key].tolist(), part[self.length].tolist(), strict=True)]
            while len(held) >= self.interval:
                out, kept = self._close(key[0], held[: self.interval], False)
                yield out
                fresh = held[self.interval :]
                if len(kept) >= self.interval:  # one bin takes all of them: it waits for more rows than that
                    held = kept + fresh
                    break
                held = kept + fresh
        self._keep(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        if held:
            yield self._close(key[0], held, True)[0]
        self._keep([])

    def close(self) -> None:
        pass


def stream_pack(stream: DataFrame, key: str, length: str, capacity: int, shards: int = 1, interval: int = 128, idle_ms: int = 10_000) -> DataFrame:
    """(shard, key, length, bin) of a stream's rows, each once, in bins of at most ``capacity`` unless one row alone is longer.

    Rows are dealt to ``shards`` by the hash of their key. A shard packs by best fit whenever it holds ``interval`` rows; the last bin
    stays open, and with all rows that wait is state that outlives a restart. A shard that gets no row for ``idle_ms``
    closes what it holds. Under the trigger ``availableNow`` set ``spark.sql.streaming.noDataMicroBatches.enabled`` to false, as
    a query with such timers does not end by itself; timers then fire in a later run. A null length counts as 0. The state store must be RocksDB
    (``spark.sql.streaming.stateStore.providerClass``), which lists and timers need; output mode append.
    """
    kind = f"{key} {stream.schema[key].dataType.simpleString()}, {length} long"
    rows = stream.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), key, F.col(length).cast("long").alias(length))
    packer = _Packer(key, length, capacity, interval, idle_ms, StructType.fromDDL(kind))
    return rows.groupBy("shard").transformWithStateInPandas(packer, f"shard int, {kind}, bin string", "append", "processingTime")
