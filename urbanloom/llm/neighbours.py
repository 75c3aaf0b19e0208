"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all of them, exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Levels of a tree, so that a query visits as many leaves however many rows there are; large leaves are compared in blocks.
LEVELS, LEAF_BLOCK, QUERY_BLOCK = 7, 8000, 2000


class Forest:
    """Perfect binary trees: node k has children 2k+1 and 2k+2; a split is a unit normal and an offset."""

    def __init__(self, sample: np.ndarray, trees: int, levels: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.levels, inner = levels, (1 << levels) - 1
        width = sample.shape[1] if sample.ndim == 2 else 0
        self.normal, self.offset = np.zeros((trees, inner, width)), np.zeros((trees, inner))
        for t in range(trees):
            members = {0: np.arange(len(sample))}
            for node in range(inner):
                rows = members.pop(node, np.zeros(0, int))
                w = rng.standard_normal(width)
                if len(rows) > 1:
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    w = a - b if (a != b).any() else w
                self.normal[t, node] = w = w / (np.linalg.norm(w) or 1)
                side = sample[rows] @ w
                self.offset[t, node] = cut = np.median(side) if len(rows) else 0.0
                members[2 * node + 1], members[2 * node + 2] = rows[side <= cut], rows[side > cut]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree: (vectors, trees)."""
        out = np.zeros((len(vectors), len(self.normal)), np.int32)
        for t in range(out.shape[1]):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.levels):
                side = np.einsum("ij,ij->i", vectors, self.normal[t][node]) > self.offset[t][node]
                node = 2 * node + 1 + side
            out[:, t] = node - ((1 << self.levels) - 1)
        return out

    def search(self, query: np.ndarray, sizes: np.ndarray, want: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of one queue over all trees, by the sum of the squared margins crossed, until their sizes reach ``want``."""
        margin = self.normal @ query - self.offset
        inner, queue, found, held = margin.shape[1], [(0.0, t, 0) for t in range(len(margin))], [], 0
        heapq.heapify(queue)
        while queue and held < want:
            crossed, t, node = heapq.heappop(queue)
            while node < inner:
                right = margin[t, node] > 0
                heapq.heappush(queue, (crossed + margin[t, node] ** 2, t, 2 * node + 1 + (not right)))
                node = 2 * node + 1 + right
            found.append((t, int(node - inner)))
            held += sizes[t, node - inner]
        return found


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and without null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0)


def search(rows: DataFrame, is_query: Column, k: int = 5, trees: int = 16, share: float = 0.65, sample: int = 20_000, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest other rows of each query row by cosine, nearest first, ties to smaller ids.

    Null, zero or non-finite vectors, and vectors of another length than the most common one, take no part. The
    forest is fitted on at most ``sample`` distinct vectors (the bound); every row is indexed. Each query looks at
    leaves of all trees until their sizes add up to ``share`` of the N distinct vectors and 13 sqrt(N) more, as the order of leaves is
    the less certain the fewer vectors there are, and at least to the ``trees * (k + 1)`` that hold k + 1 distinct ones whatever
    they are (this decides under some 40 vectors); as the trees' leaves overlap, that is about half of them for nearly isotropic vectors, which need it. Equal vectors are one
    candidate with its k + 1 smallest ids, which are all that an answer can hold; so a group of copies of any size costs
    one comparison. Repeated ids count as rows of their own. Only the two named columns are read; an empty table gives
    no rows.
    """
    spark, (k1, k2) = rows.sparkSession, ("_k1", "_k2")
    good = rows.where(usable(F.col(vector))).select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"), is_query.alias("_q"))
    common = good.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    good = good.where(F.size("_v") == (common["n"] if common else 0)).withColumn(k1, F.xxhash64("_v")).withColumn(k2, F.xxhash64(F.lit(11), F.col("_v")))
    place = F.row_number().over(Window.partitionBy(k1, k2).orderBy("_id"))
    first = good.select(k1, k2, "_id", "_v").withColumn("_r", place).where(F.col("_r") <= k + 1)
    classes = written(first.groupBy(k1, k2).agg(F.min(F.when(F.col("_r") == 1, F.col("_v"))).alias("_v"), F.array_sort(F.collect_list("_id")).alias("ids"), F.max(F.lit(1)).alias("one")).drop("one"), "classes")
    queries = good.where("_q").select(k1, k2, F.col("_id").alias("query_id"))
    total = classes.count()

    levels = LEVELS
    part = classes.where(F.pmod(F.xxhash64(k2, k1), F.lit(max(1, -(-2 * total // sample)))) == 0).orderBy(k1, k2).limit(sample).select("_v").collect()
    forest = Forest(_unit(np.array([r[0] for r in part], float)) if part else np.zeros((0, common["n"] if common else 1)), trees, levels)
    shared = spark.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = shared.value.leaves(_unit(_matrix(batch.column(3)))) if batch.num_rows else np.zeros((0, trees), np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves.tolist(), pa.list_(pa.int32()))], [k1, k2, "first", "_v", "leaves"])

    kind, id_kind = rows.schema[vector].dataType.simpleString(), rows.schema[id_col].dataType.simpleString()
    index = written(classes.select(k1, k2, F.col("ids")[0].alias("first"), "_v").mapInArrow(route, f"{k1} long, {k2} long, first {id_kind}, _v {kind}, leaves array<int>"), "index")
    filed = index.select(k1, k2, "first", "_v", F.posexplode("leaves").alias("tree", "leaf"))
    counted = filed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"))  # at most trees * 2 ** LEVELS rows
    sizes = np.zeros((trees, 1 << levels))
    for r in counted.collect():
        sizes[r["tree"], r["leaf"]] = r["n"]
    plan = spark.sparkContext.broadcast((sizes, max(share * total + 13 * total**0.5, trees * (k + 1))))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, want = plan.value
        for batch in batches:
            units = _unit(_matrix(batch.column(2))) if batch.num_rows else np.zeros((0, 1))
            visits = [shared.value.search(q, sizes, want) for q in units]
            at = pa.array(np.repeat(np.arange(len(visits)), [len(v) for v in visits]), pa.int64())
            tree, leaf = zip(*[x for v in visits for x in v]) if visits else ((), ())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(tree, pa.int32()), pa.array(leaf, pa.int32())], ["q1", "q2", "qv", "tree", "leaf"])

    asked = queries.select(k1, k2).distinct().join(index.select(k1, k2, "_v"), [k1, k2])
    visits = written(asked.mapInArrow(look, f"q1 long, q2 long, qv {kind}, tree int, leaf int"), "visits")
    wanted = visits.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("m"))
    cells = F.broadcast(counted.join(wanted, ["tree", "leaf"]).select("tree", "leaf", F.ceil(F.col("n") / LEAF_BLOCK).cast("int").alias("bi"), F.ceil(F.col("m") / QUERY_BLOCK).cast("int").alias("bq")))
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = filed.join(cells, ["tree", "leaf"]).withColumn("i", F.pmod(F.xxhash64(k1), "bi").cast("int")).withColumn("j", F.explode(numbers("bq"))).select("tree", "leaf", "i", "j", k1, k2, "first", "_v")
    right = visits.join(cells, ["tree", "leaf"]).withColumn("j", F.pmod(F.xxhash64("q1"), "bq").cast("int")).withColumn("i", F.explode(numbers("bi"))).select("tree", "leaf", "i", "j", "q1", "q2", "qv")

    def compare(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        """Each query's best k + 1 classes of a block, ties to smaller first ids; scores pair by pair, so they do not depend on the block."""
        out: dict[str, list] = {c: [] for c in ("q1", "q2", k1, k2, "first", "score")}
        if len(have) and len(want):
            v, q = np.stack(have["_v"]).astype(float), np.stack(want["qv"]).astype(float)
            near = _unit(q) @ _unit(v).T
            best = np.partition(near, -min(k + 1, len(v)), axis=1)[:, -min(k + 1, len(v))]
            row, at = np.nonzero(near >= best[:, None] - 1e-9)
            norm = lambda x: np.sqrt((x * x).sum(axis=1))
            score = (q[row] * v[at]).sum(axis=1) / (norm(q)[row] * norm(v)[at])
            first = have["first"].to_numpy()[at]
            order = np.lexsort((first, -score, row))
            starts = np.searchsorted(row[order], np.arange(len(q)))
            order = order[np.arange(len(order)) - starts[row[order]] <= k]
            row, at, score, first = row[order], at[order], score[order], first[order]
            out = {"q1": want["q1"].to_numpy()[row], "q2": want["q2"].to_numpy()[row], k1: have[k1].to_numpy()[at], k2: have[k2].to_numpy()[at], "first": first, "score": score}
        return pd.DataFrame(out)

    keys = ["tree", "leaf", "i", "j"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, f"q1 long, q2 long, {k1} long, {k2} long, first {id_kind}, score double")
    distinct = found.groupBy("q1", "q2", k1, k2, "first").agg(F.max("score").alias("score"))
    best = distinct.withColumn("r", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "first"))).where(F.col("r") <= k + 1)
    listed = best.join(classes.select(k1, k2, "ids"), [k1, k2]).select("q1", "q2", F.transform("ids", lambda x: F.struct((-F.col("score")).alias("far"), x.alias("id"))).alias("ids"))
    answers = listed.groupBy("q1", "q2").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("all"))
    own = queries.join(answers.withColumnsRenamed({"q1": k1, "q2": k2}), [k1, k2])
    at = F.coalesce(F.array_position(F.transform("all", lambda x: x.id), F.col("query_id")), F.lit(0))
    others = F.slice(F.when(at > 0, F.concat(F.slice("all", F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), F.slice("all", (at + 1).cast("int"), F.lit(k + 1)))).otherwise(F.col("all")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias(id_col), (-F.col("x.far")).alias("score"))
