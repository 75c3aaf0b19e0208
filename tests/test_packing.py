"""Packing of tables and streams: every row once, bins within their capacity, no more bins than window after window in order."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.operators import datasets as D
from urbanloom.operators import packing
from urbanloom.streaming import jobs


def checked(rows, lengths, capacity):
    """Every row once, and no bin over the capacity but for one long row."""
    assert sorted(r.id for r in rows) == sorted(lengths)
    bins = {}
    for r in rows:
        bins.setdefault(r.bin, []).append(lengths[r.id] or 0)
    assert all(sum(b) <= capacity or len(b) == 1 for b in bins.values())
    return bins


def in_order(lengths, capacity, window):
    """The number of bins when windows are packed one after the other, the last bin of each going on into the next."""
    held, shut = [], 0
    for at in range(0, len(lengths), window):
        held += [n or 0 for n in lengths[at : at + window]]
        bins = packing.best_fit(held, capacity)
        shut, held = shut + len(bins) - 1, [held[r] for r in bins[-1]]
    return shut + bool(held)


def test_best_fit():
    assert packing.best_fit([5, 3, 7, 2, 12, 0], 10) == [[4], [2, 1, 5], [0, 3]]
    assert packing.best_fit([], 10) == []
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(0, 40, rng.integers(1, 60)).tolist()
        bins: list[list[int]] = []
        for r in sorted(range(len(lengths)), key=lambda r: (-lengths[r], r)):  # by looking at all bins
            fits = [b for b in bins if sum(lengths[x] for x in b) + lengths[r] <= 30]
            best = max(fits, key=lambda b: sum(lengths[x] for x in b), default=None)
            bins.append([r]) if best is None else best.append(r)
        assert packing.best_fit(lengths, 30) == bins


@pytest.mark.parametrize("per_range", [1_000_000, 130])
def test_tables(spark, monkeypatch, per_range):
    monkeypatch.setattr(packing, "RANGE_ROWS", per_range)
    lengths = {i: int(n) for i, n in enumerate(np.random.default_rng(5).integers(1, 900, 700))} | {1000: 5000, 1001: None}
    rows = spark.createDataFrame(list(lengths.items()), "id long, n long")
    bins = checked(packing.pack_sequences(rows, "id", "n", 1000, window=100).collect(), lengths, 1000)
    assert len(bins) <= in_order([lengths[k] for k in sorted(lengths)], 1000, 100)
    assert packing.pack_sequences(rows.where("false"), "id", "n", 1000).count() == 0


def test_streams_through_restarts(spark, tmp_path):
    """Two restarts; the rows that wait are state, and a timer closes them in the end."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    lengths = {i: int(n) for i, n in enumerate(np.random.default_rng(6).integers(1, 500, 240))} | {500: 3000}
    ids = list(lengths)
    bins = []
    for k in range(3):
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(k == 2).lower())
        part = ids[k * 90 : (k + 1) * 90]
        spark.createDataFrame([(i, lengths[i]) for i in part], "id long, n long").coalesce(1).write.mode("append").parquet(src)
        packed = packing.stream_pack(jobs.stream_dataset(spark, src, "id long, n long", 1), "id", "n", 1000, shards=2, interval=32, idle_ms=4000 if k == 2 else 3_600_000)
        writer = packed.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp)
        if k < 2:
            writer.trigger(availableNow=True).start().awaitTermination()
            seen = spark.read.parquet(out).count()
            assert 0 < seen < (k + 1) * 90
            bins.append(seen)
        else:
            running = writer.trigger(processingTime="1 second").start()
            until = time.time() + 60
            while time.time() < until and spark.read.parquet(out).count() < len(ids):
                time.sleep(1)
            running.stop()
    rows = spark.read.parquet(out).collect()
    assert bins[0] < bins[1]
    checked(rows, lengths, 1000)
    assert {r.bin.split("-")[0] for r in rows} == {"0", "1"} and all(r.bin.split("-")[0] == str(r.shard) for r in rows)


def test_rows_that_raise(spark):
    rows = spark.createDataFrame([(1, "5"), (2, "x"), (3, None)], "id int, v string")
    got = D.map_rows(rows, lambda r: {"n": int(r["v"])}, "n long", error="problem").collect()
    assert sorted((r.n, (r.problem or "").split(":")[0]) for r in got if r.n is not None) == [(5, "")] and sorted(r.problem.split(":")[0] for r in got if r.n is None) == ["TypeError", "ValueError"]
    assert D.map_rows(rows, lambda r: {"n": int(r["v"])}, "n long").count() == 1 and rows.select(F.col("v")).count() == 3
