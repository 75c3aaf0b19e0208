"""Metrics of a whole search, every query against every candidate, whose pairs are counted and added up where they are scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import recall_at_k
from .rounds import settled

#: Queries and candidates that one group scores against each other; sides of the tiles in which it does.
QUERIES, CANDIDATES = 8192, 4096
TILE = (64, 1024)
#: Beside cosines, which lie between -1 and 1: a score that is not a number comes first, a missing one last, and a query's own row is no pair.
NAN, NULL, SELF = 3.0, -3.0, -9.0


def _vectors(column):
    """The length of each row's vector (-1 for a missing one or one with a missing entry), and by length the place of each row, the vectors and their lengths in space."""
    import numpy as np
    import pyarrow.compute as pc

    flat = pc.list_flatten(column)
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    start = np.cumsum(size) - size
    missing = np.repeat(np.arange(len(size)), size)[pc.is_null(flat).to_numpy(zero_copy_only=False)]
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    size[missing] = -1
    size[pc.is_null(column).to_numpy(zero_copy_only=False)] = -1
    place, of = np.zeros(len(size), np.int64), {}
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        place[rows] = np.arange(len(rows))
        v = values[start[rows][:, None] + np.arange(n)]
        squares = np.zeros(len(rows))
        for x in v.T:
            squares += x * x
        of[n] = v, np.sqrt(squares)
    return size, place, of


def _tile(a, b, i, j):
    """Cosines of the rows i of a and j of b: sums in the order of the entries, as in :func:`metrics.cosine`, so equal vectors score alike wherever they stand."""
    import numpy as np

    out = np.full((len(i), len(j)), NULL)
    for n in np.intersect1d(a[0][i], b[0][j]).tolist():
        if n <= 0:
            continue
        p, q = np.flatnonzero(a[0][i] == n), np.flatnonzero(b[0][j] == n)
        (x, xn), (y, yn) = ([part[place] for part in side[2][n]] for side, place in ((a, a[1][i[p]]), (b, b[1][j[q]])))
        dot, one = np.zeros((len(p), len(q))), np.empty((len(p), len(q)))
        for u, v in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)):
            dot += np.multiply(u[:, None], v[None, :], out=one)
        norm = np.multiply(xn[:, None], yn[None, :], out=one)
        dot /= norm
        dot[np.isnan(dot)] = NAN
        dot[norm == 0] = NULL
        if len(p) == len(i) and len(q) == len(j):
            return dot
        out[np.ix_(p, q)] = dot
    return out


def _codes(*columns):
    """Whole numbers that are equal where the values are, -1 for missing ones, one array a column."""
    import numpy as np
    import pandas as pd

    codes = pd.factorize(pd.concat([c.to_pandas() for c in columns], ignore_index=True))[0]
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def _tiles(left, right, by_label: bool):
    """(rows i of left, rows j of right, scores) tile by tile; ``by_label``: only of equal labels."""
    import numpy as np

    a, b = _vectors(left["vector"].combine_chunks()), _vectors(right["vector"].combine_chunks())
    own, other = _codes(left["query"], right["cand"])
    label, labels = _codes(left["label"], right["label"])
    groups = [(np.flatnonzero(label == k), np.flatnonzero(labels == k)) for k in np.unique(label[label >= 0])] if by_label else [(np.arange(len(own)), np.arange(len(other)))]
    with np.errstate(all="ignore"):
        for rows, columns in groups:
            for s in range(0, len(rows), TILE[0]):
                for t in range(0, len(columns), TILE[1]):
                    i, j = rows[s : s + TILE[0]], columns[t : t + TILE[1]]
                    scores = _tile(a, b, i, j)
                    scores[own[i][:, None] == other[j][None, :]] = SELF
                    yield i, j, scores, label[i][:, None], labels[j][None, :]


def _in_blocks(queries: DataFrame, candidates: DataFrame, run, schema: str) -> DataFrame:
    """What ``run`` makes of every block of queries with every block of candidates; their numbers follow the rows."""
    n, m = (max(1, -(-df.count() // rows)) for df, rows in ((queries, QUERIES), (candidates, CANDIDATES)))
    tasks = min(2 * n * m, 8192)
    of = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    copies = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = queries.withColumns({"_q": of("query", n), "_c": copies(m)}).repartition(tasks, "_q", "_c")
    right = candidates.select(*[F.col(c).alias(c) for c in candidates.columns]).withColumns({"_c": of("cand", m), "_q": copies(n)}).repartition(tasks, "_q", "_c")
    return left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInArrow(run, schema)


def _best(left, right):
    """(query, pairs, key, cand): how many pairs each query has here, and the best of its own label, ties to the smaller id; -key is sorted by."""
    import numpy as np
    import pyarrow as pa

    ids = right["cand"].to_numpy()
    key, cand = np.full(len(left), SELF), np.full(len(left), np.iinfo(np.int64).max)
    for i, j, scores, *_ in _tiles(left, right, True):
        top = scores.max(axis=1)
        first = np.where(scores == top[:, None], ids[j][None, :], np.iinfo(np.int64).max).min(axis=1)
        cand[i] = np.where(top > key[i], first, np.where(top == key[i], np.minimum(first, cand[i]), cand[i]))
        key[i] = np.maximum(key[i], top)
    own, other = _codes(left["query"], right["cand"])
    pairs = len(other) - np.bincount(other, minlength=int(max(own.max(initial=0), other.max(initial=0))) + 1)[own]
    none = key == SELF
    return pa.table({"query": left["query"], "pairs": pa.array(pairs, pa.int64()), "key": pa.array(key, pa.float64(), mask=none), "cand": pa.array(cand, pa.int64(), mask=none)})


def _before(left, right):
    """(query, before): how many candidates come before each query's best of its label."""
    import numpy as np
    import pyarrow as pa

    ids, key, best = right["cand"].to_numpy(), left["key"].to_numpy(), left["best"].to_numpy()
    before = np.zeros(len(left), np.int64)
    for i, j, scores, *_ in _tiles(left, right, False):
        at = key[i][:, None]
        before[i] += ((scores > at) | (scores == at) & (ids[j][None, :] < best[i][:, None])).sum(axis=1)
    return pa.table({"query": left["query"], "before": pa.array(before)})


def _against(temperature: float, margin: float | None):
    """(query, n, s, hard, m, e) of other labels: their number, sum and largest score; the largest that is used, and the sum of exp((score - m) / temperature)."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        p = left["key"].to_numpy()
        n, s, e = np.zeros(len(left), np.int64), np.zeros(len(left)), np.zeros(len(left))
        hard, m = np.full(len(left), NULL), np.full(len(left), NULL)
        for i, j, scores, a, b in _tiles(left, right, False):
            other = (a != b) & (a >= 0) & (b >= 0) & (scores > SELF)
            n[i] += other.sum(axis=1)
            told = other & (scores > NULL)
            s[i] += np.where(told, np.where(scores == NAN, np.nan, scores), 0.0).sum(axis=1)
            hard[i] = np.maximum(hard[i], np.where(told, scores, NULL).max(axis=1))
            used = told if margin is None else told & (scores <= p[i][:, None] + margin)
            top = np.maximum(m[i], np.where(used, scores, NULL).max(axis=1))
            e[i] = e[i] * np.exp((m[i] - top) / temperature) + np.where(used, np.exp((scores - top[:, None]) / temperature), 0.0).sum(axis=1)
            m[i] = top
        number = lambda x: pa.array(np.where(x == NAN, np.nan, x), pa.float64(), mask=x == NULL)
        return pa.table({"query": left["query"], "n": pa.array(n), "s": pa.array(s, pa.float64(), mask=hard == NULL), "hard": number(hard), "m": number(m), "e": pa.array(np.where(m == NAN, np.nan, e), pa.float64(), mask=m == NULL)})

    return run


def best_of_label(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query, pairs, key, best): each query's number of candidates and, where one has its label, the score and id of the first of these.

    ``queries``: (query, vector, label), ``candidates``: (cand, vector, label), with whole numbers as ids and cosines as scores.
    Missing scores come last, those that are not a number first; a query's own row and rows without an id are no pairs.
    """
    queries, candidates = queries.where("query is not null"), candidates.where("cand is not null")
    parts = _in_blocks(queries, candidates, _best, "query long, pairs long, key double, cand long")
    first = F.min(F.when(F.col("key").isNotNull(), F.struct((-F.col("key")).alias("k"), "cand")))
    return parts.groupBy("query").agg(F.sum("pairs").alias("pairs"), first.alias("f")).select("query", "pairs", (-F.col("f.k")).alias("key"), F.col("f.cand").alias("best"))


def search_recall(queries: DataFrame, candidates: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row as :func:`metrics.recall_at_k` of all candidates in the order of their scores, ties to the smaller id; tables as in :func:`best_of_label`.

    Only the best candidate of a query's label and the number of those before it are kept: no pair leaves the task that scores it.
    """
    best = settled(best_of_label(queries, candidates))
    asked = queries.join(best.where("key is not null").select("query", "key", "best"), "query")
    before = _in_blocks(asked, candidates.where("cand is not null"), _before, "query long, before long").groupBy("query").agg(F.sum("before").alias("before"))
    first = best.where("pairs > 0").join(before, "query", "left")
    return recall_at_k(first.select("query", (F.col("before") + 1).alias("rank"), F.col("before").isNotNull().alias("relevant")), ks)


def search_infonce(queries: DataFrame, candidates: DataFrame, temperature: float = 0.01, margin: float | None = None) -> DataFrame:
    """One row as :func:`metrics.infonce` of all pairs, with ``queries``, the number of those with a candidate of their label; tables as in :func:`best_of_label`.

    Sums of exponentials are added up under the largest score of their block and brought together under that of the query.
    """
    best = settled(best_of_label(queries, candidates).where("best is not null").select("query", "key"))
    number = F.when(F.col("key") == NAN, F.lit(float("nan"))).when(F.col("key") > NULL, F.col("key"))
    asked = queries.join(best, "query")
    parts = settled(_in_blocks(asked, candidates.where("cand is not null"), _against(temperature, margin), "query long, n long, s double, hard double, m double, e double"))
    pos = best.select("query", number.alias("p"))
    most = pos.join(parts.groupBy("query").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("hard").alias("hard"), F.max("m").alias("m")), "query").withColumn("m", F.greatest("p", F.coalesce("m", "p")))
    tail = parts.select("query", F.col("m").alias("of"), "e").join(most.select("query", "m"), "query").groupBy("query").agg(F.sum(F.col("e") * F.exp((F.col("of") - F.col("m")) / temperature)).alias("e"))
    per = most.join(tail, "query")
    some = F.col("n") > 0
    value = (F.col("m") - F.col("p")) / temperature + F.log(F.coalesce("e", F.lit(0.0)) + F.exp((F.col("p") - F.col("m")) / temperature))
    mean = lambda x: F.avg(F.when(some, x))
    return per.agg(F.count(F.lit(1)).alias("queries"), mean(F.col("p")).alias("mean_pos"), (F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_neg"), mean(F.col("p") - F.col("hard")).alias("mean_margin"), F.avg(value).alias("infonce"))
