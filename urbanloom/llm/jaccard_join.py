"""Exact Jaccard self-join of word shingles as a metric-space join, and the groups that its links form.

Distance is d = 1 - Jaccard; links have d <= r = 0.2. The join works on distinct shingle sets, so copies cost nothing.

* First pivots are single shingles, taken as sets {s}: d(x, {s}) is 1 - 1/|x| if s is in x, else 1. The region of {s}
  holds the sets with s. A set's own pivots are its first shingles in one global order, frequent ones last. By the
  triangle inequality of the symmetric difference two linked sets, the smaller of n and the larger of m shingles, differ
  in so few that the first shingle they share is among the first n - ceil(8n/9) + 1 of the smaller one (its core window)
  and the first m - ceil(4m/5) + 1 of the larger one. So each set is replicated to the regions of that window and no
  link is lost.
* In regions of few sets all pairs are formed, and those whose windows share too little to be linked are dropped.
* A larger region is first joined with one of its members. Members that links already put into one group need no
  further test against each other. If few stay outside the largest group, they are tested against all others.
* Any other region gets document pivots. All its members' distances to them are computed; the pivots are then done.
  Each member within REACH of a pivot belongs to the Voronoi region of its nearest pivot; those far from all pivots make
  up the rest. A linked partner of a member of region j is at most d(x, nearest) + 2r and REACH + r away from pivot j,
  one of the rest's is more than REACH - r away from every pivot: members within these windows are replicated. The
  regions are joined in the same way, recursively. Where the windows would replicate most members, or one part keeps
  more than half of them, that part is finished pair by pair. In both cases a later pair is tested only if
  |d(x, p) - d(y, p)| <= r for every pivot p of its region.
* Before whole sets are compared, a pair's sketches are: the shingles are dealt by their hash to parts that do not
  overlap, and the part's counts of two sets differ by no more than the sets do within it, again by the triangle
  inequality. If the differences of all parts add up to more than linked sets may differ, the pair is dropped; and a
  distance to a pivot that must be over REACH is not measured, its lower bound stands for it.

Every round removes the pivots from their region, so the recursion ends; all pairs that are not excluded by a proven
bound, or already in one group, are tested with their whole shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, text_runs, written

WORDS = 5
R = 0.2
#: What rounding may add to a distance.
SLACK = 1e-6
#: A region of at most so many members, or with so many outside its largest group, is finished pair by pair.
FEW = 24
#: Document pivots of a larger region.
PIVOTS = 4
#: Distances to pivots beyond this one cut nothing, as their windows of 2r reach all sets; they need not be exact.
REACH = 1 - 2 * R
#: So many of the pivots before a set's pivot are looked at to form a pair in one region only.
EARLIER = 64
#: At most so many frequent shingles are moved to the end of the order; the order changes costs, not results.
FREQUENT = 1 << 21
#: Shingles that a task counts at a time, and the least count there for a shingle to be counted over all tasks.
COUNTED, AT_LEAST = 2_000_000, 3
#: Characters of the texts whose shingles are made at a time.
RUN_CHARS = 500_000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: log2 of the bits of the filter by which the sets of candidates are found again.
FILTER_BITS = 26


class Shingler:
    """Shingles of texts as 64-bit hashes, made with numpy for a run of texts at a time.

    A word's hash is a polynomial over values of its bytes, taken as a difference of running sums; A-Z have the values
    of a-z. A shingle's hash is a polynomial over its words' hashes.
    """

    def __init__(self, words: int = WORDS):
        self.words = words
        self.value = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64)
        self.value[65:91] = self.value[97:123]
        self.gap = np.zeros(256, bool)
        self.gap[[32, *range(9, 14)]] = True
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
                steps = np.full(max(n, 1 << 20), base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def _joined(self, words: np.ndarray, span: int) -> np.ndarray:
        out = words[: len(words) - span + 1] + np.uint64(span)
        for k in range(1, span):
            out = out * BASE + words[k : len(words) - span + 1 + k]
        return self._mixed(out).view(np.int64)

    def runs(self, texts: list[str | None]) -> list[np.ndarray]:
        """The hashes of all runs of words of each text, in order; of fewer words, of the whole text."""
        raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
        data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
        gap = self.gap[data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        starts, ends = edge[::2], edge[1::2]
        self._powers(len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[data] * self.up[: len(data)])])
        words = self._mixed((sums[ends] - sums[starts]) * self.down[starts])
        first = np.searchsorted(starts, np.cumsum([1, *[len(r) + 1 for r in raw]])).tolist()
        all_runs = self._joined(words, self.words) if len(words) >= self.words else np.zeros(0, np.int64)
        out = []
        for a, b in zip(first, first[1:]):
            n = b - a
            out.append(all_runs[a : b - self.words + 1] if n >= self.words else self._joined(words[a:b], n) if n else np.zeros(0, np.int64))
        return out

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The distinct shingles of each text, sorted."""
        return [np.unique(r) if len(r) > 1 else r for r in self.runs(texts)]


def _key(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def frequent_shingles(docs: DataFrame, id_col: str, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the most frequent shingles, at most FREQUENT, from all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, held, count = Shingler(words), [], 0

        def counted() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= AT_LEAST
            return pa.RecordBatch.from_arrays([pa.array(found[often]), pa.array(times[often].astype(np.int64))], ["s", "c"])

        for _, texts in text_runs(batches, RUN_CHARS):
            held += shingle.runs(texts)
            count += sum(map(len, held[-len(texts) :]))
            if count >= COUNTED:
                yield counted()
                held, count = [], 0
        if held:
            yield counted()

    found = written(docs.select(id_col, text).mapInArrow(run, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")), "frequent")
    held, least = 0, 1 << 62
    for row in found.groupBy(F.floor(F.log2("c")).alias("b")).count().orderBy(F.desc("b")).collect():
        held += row["count"]
        if held > FREQUENT:
            break
        least = 1 << row["b"]
    rows = found.where(F.col("c") >= least).orderBy("s").toArrow()
    return rows.column("s").to_numpy(), rows.column("c").to_numpy()


def shingle_sets(docs: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """(id, n, key, rare, often) of every row: size and hash of its set, and the shingles of the replication window in their order.

    ``often`` are those counted as frequent, which come last. A task gives the window of the first of equal sets only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, id_col, text, words))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = shared.value
        mark = np.zeros(1 << 24, bool)
        mark[often & (1 << 24) - 1] = True
        shingle, seen, none = Shingler(words), set(), np.zeros(0, np.int64)
        for batch, texts in text_runs(batches, RUN_CHARS):
            sizes, keys, first = [], [], ([], [])
            for s in shingle.sets(texts):
                n = len(s)
                key = _key(s) if n else None
                sizes.append(n)
                keys.append(key)
                parts = (none, none)
                if n and key not in seen:
                    seen.add(key)
                    window = n - -(-4 * n // 5) + 1
                    likely = np.flatnonzero(mark[s & (1 << 24) - 1]) if len(often) else none
                    at = np.minimum(np.searchsorted(often, s[likely]), len(often) - 1)
                    sure = often[at] == s[likely] if len(likely) else none.astype(bool)
                    known = np.zeros(n, bool)
                    known[likely[sure]] = True
                    rare = s[~known][:window]
                    last = likely[sure][np.argsort(times[at[sure]], kind="stable")][: window - len(rare)] if len(likely) else none
                    parts = (rare, s[last])
                for have, part in zip(first, parts):
                    have.append(part)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), *map(_lists, first)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n", "key", "rare", "often"])

    return written(docs.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, n long, key long, rare array<long>, often array<long>"), "sets")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles each of 2 ** k parts of all hashes holds, two parts a byte; two to four times as many parts as shingles.

    Empty where a count is over 15: then the sketch bounds nothing.
    """
    parts = 2 << max(6, (len(shingles) - 1).bit_length())
    counts = np.bincount(shingles & parts - 1, minlength=parts).astype(np.uint8)
    return (counts[: parts // 2] | counts[parts // 2 :] << 4).tobytes() if counts.max(initial=0) < 16 else b""


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference of two sets, from their sketches."""
    if not a or not b:
        return 0
    x, y = (np.frombuffer(z, np.uint8) for z in (a, b))
    x, y = (np.concatenate([z & 15, z >> 4]).astype(np.int16) for z in (x, y))
    least = min(len(x), len(y))
    return int(np.abs(x.reshape(-1, least).sum(axis=0) - y.reshape(-1, least).sum(axis=0)).sum())


class Corpus:
    """The rows whose sets are compared. The texts are read again for the sets that a round needs, so no table of whole sets is kept."""

    def __init__(self, docs: DataFrame, sets: DataFrame, id_col: str, text: str, words: int):
        self.docs, self.id_col, self.text, self.words = docs, id_col, text, words
        self.of_key = written(sets.where("n > 0").groupBy("key").agg(F.min(id_col).alias(id_col)), "of_key")

    def _wanted(self, pairs: DataFrame, kind: str, made) -> DataFrame:
        """(key, x) of the ends of pairs, x made of each set. A bit filter of fixed size on the ids keeps most other texts back."""
        keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        wanted = written(self.of_key.join(keys, "key", "left_semi"), "wanted")
        slot = F.xxhash64(self.id_col).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
        bits = wanted.groupBy(F.shiftright(slot, 5).cast("int").alias("w")).agg(F.bit_or(F.pow(F.lit(2.0), slot.bitwiseAND(F.lit(31))).cast("long")).alias("b")).toArrow()
        filled = np.zeros(1 << FILTER_BITS - 5, np.int64)
        filled[bits.column("w").to_numpy()] = bits.column("b").to_numpy()
        shared, words = self.docs.sparkSession.sparkContext.broadcast(filled), self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filled, shingle, seen = shared.value, Shingler(words), set()

            def likely() -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    at = batch.column(2).to_numpy()
                    yield batch.filter(pa.array((filled[at >> 5] >> (at & 31) & 1).astype(bool)))

            for _, texts in text_runs(likely(), RUN_CHARS):
                keys, first = [], []
                for s in shingle.sets(texts):
                    key = _key(s) if len(s) else None
                    if key is not None and key not in seen:
                        seen.add(key)
                        keys.append(key)
                        first.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), made(first)], ["key", "x"])

        rows = self.docs.select(self.id_col, self.text, slot.alias("slot")).mapInArrow(run, f"key long, x {kind}")
        return rows.groupBy("key").agg(F.first("x").alias("x")).join(wanted.select("key"), "key", "left_semi")

    @staticmethod
    def _both(pairs: DataFrame, of: DataFrame) -> DataFrame:
        """(a, b, na, nb, xa, xb) of pairs (a, b, na, nb)."""
        side = lambda c: of.select(F.col("key").alias(c), F.col("x").alias("x" + c))
        return pairs.join(side("b"), "b").join(side("a"), "a")

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """(a, b, na, nb, least) of the distinct pairs: a lower bound of their symmetric difference, from the sketches."""
        pairs = written(pairs.select("a", "b", "na", "nb").distinct(), "asked")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                least = [apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(least, pa.int64())], ["a", "b", "na", "nb", "least"])

        of = self._wanted(pairs, "binary", lambda sets: pa.array([sketch(s) for s in sets], pa.binary()))
        return written(self._both(pairs, of).select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long, na long, nb long, least long"), "bounded")

    def near(self, pairs: DataFrame) -> DataFrame:
        """The distinct pairs (a, b, na, nb) of which the sketches do not prove that they cannot be linked."""
        return self.bounded(pairs).where("least * 9 <= na + nb").drop("least")

    def measured(self, pairs: DataFrame) -> DataFrame:
        """(a, b, shared, joined): sizes of intersection and union of each distinct pair (a, b, na, nb), from the whole sets."""
        pairs = written(pairs.select("a", "b", "na", "nb").distinct(), "pairs")
        shared = self._both(pairs, self._wanted(pairs, "array<long>", _lists)).select("a", "b", "na", "nb", F.size(F.array_intersect("xa", "xb")).alias("shared"))
        return written(shared.select("a", "b", "shared", (F.col("na") + F.col("nb") - F.col("shared")).alias("joined")), "measured")


def groups(links: DataFrame) -> DataFrame:
    """(key, root) of every end of a link, root its group's smallest key: links are contracted to smaller keys until none is left."""
    edges = written(links.select("a", "b").where("a <> b").distinct(), "edges")
    found: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("root"))
        step = written(up.join(up.select(F.col("key").alias("root"), F.col("root").alias("_r")), "root").select("key", F.col("_r").alias("root")), "step")
        if found is None:
            found = step
        else:  # roots so far are ends of the remaining links, or final
            found = written(found.join(step.select(F.col("key").alias("root"), F.col("root").alias("_r")), "root", "left").select("key", F.coalesce("_r", "root").alias("root")), "found")
        of = lambda c: step.select(F.col("key").alias(c), F.col("root").alias("_" + c))
        edges = written(edges.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b").distinct(), "edges")
    return found if found is not None else links.sparkSession.createDataFrame([], "key long, root long")


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Groups after more links, which are carried over to the groups' roots."""
    if roots is None:
        return groups(links)
    of = lambda c: roots.select(F.col("key").alias(c), F.col("root").alias("_" + c))
    lifted = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    more = groups(lifted)
    kept = roots.join(more.select(F.col("key").alias("root"), F.col("root").alias("_r")), "root", "left").select("key", F.coalesce("_r", "root").alias("root"))
    new = more.join(roots.select("key"), "key", "left_anti")
    return written(kept.unionByName(new), "roots")


def _shared_windows(small: DataFrame, crowded: DataFrame) -> DataFrame:
    """(a, b, na, nb): pairs that meet in small regions and share enough of their windows to be linked.

    Linked sets share at least ceil(4/9 (n + m)) shingles, and at most max of what lies behind their windows is shared
    outside both windows; so the windows share the rest. Shingles of large regions are not counted pair by pair: as
    many as the set with fewer of them has may be shared.
    """
    rows = small.drop("large").join(crowded, "key", "left").select("token", "key", "n", F.coalesce("large", F.lit(0)).alias("large"))
    x, y = rows.alias("x"), rows.alias("y")
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.key") < F.col("y.key")) & (F.least("x.n", "y.n") * 5 >= F.greatest("x.n", "y.n") * 4))
    counted = pairs.groupBy(F.col("x.key").alias("a"), F.col("y.key").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.first("x.n").alias("na"), F.first("y.n").alias("nb"), F.first(F.least("x.large", "y.large")).alias("g"))
    return counted.where(F.col("c") + F.col("g") >= _need(F.col("na"), F.col("nb"))).select("a", "b", "na", "nb")


def _need(n: Column, m: Column) -> Column:
    """Shingles that the windows of linked sets of n and m shingles share at least."""
    behind = lambda x: F.ceil(x * 4 / 5) - 1
    return F.ceil((n + m) * 4 / 9) - F.greatest(behind(n), behind(m))


def _least_need(n: Column, lo: Column, hi: Column) -> Column:
    """The least need of n with any partner of lo to hi shingles, where lo <= n <= hi.

    It never falls from a partner to a larger one up to n. Beyond n it falls by 16/45 a shingle, but rounding can add up
    to 76/45 to that of hi against another's; so it is at least that of hi for partners two or more below hi, and hi - 1
    can have less.
    """
    return F.least(_need(n, lo), _need(n, F.greatest(n, hi - 1)), _need(n, hi))


def _able(large: DataFrame) -> DataFrame:
    """The members of large regions that may be linked within them: their window has enough shingles that any other set has.

    Partners are taken to have any size from the region's smallest to its largest within the bounds on sizes.
    """
    ends = large.groupBy("token").agg(F.min("n").alias("_lo"), F.max("n").alias("_hi"))
    sized = large.join(ends, "token").withColumn("_lo", F.greatest("_lo", F.ceil(F.col("n") * 4 / 5))).withColumn("_hi", F.least("_hi", F.floor(F.col("n") * 5 / 4)))
    return sized.where(F.col("rich") >= _least_need(F.col("n"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def _may_link(a: str, b: str) -> Column:
    """Bounds by size and window: the smaller set has the region's pivot in its core window, the larger is at most a quarter larger."""
    c = lambda side, name: F.col(f"{side}.{name}")
    smaller = (c(a, "n") < c(b, "n")) | ((c(a, "n") == c(b, "n")) & (c(a, "key") < c(b, "key")))
    core = F.when(smaller, c(a, "core")).otherwise(c(b, "core"))
    least = F.ceil((c(a, "n") + c(b, "n")) * 4 / 9)  # shingles that linked sets share at least
    room = F.least(c(a, "n") - c(a, "pos"), c(b, "n") - c(b, "pos"))  # shingles that can be shared if the pivot is the first shared one
    near = F.forall(F.arrays_zip(c(a, "far").alias("x"), c(b, "far").alias("y")), lambda z: (z.x.lo - z.y.hi <= R + SLACK) & (z.y.lo - z.x.hi <= R + SLACK))
    apart = (c(a, "pos") + c(b, "pos")) * 9 <= c(a, "n") + c(b, "n")  # what lies before the first shared shingle is not shared
    enough = F.least(c(a, "rich"), c(b, "rich")) >= _need(c(a, "n"), c(b, "n"))
    first = ~F.arrays_overlap(c(a, "earlier"), c(b, "earlier"))  # else the pair is formed in an earlier region
    return apart & enough & core & (F.least(c(a, "n"), c(b, "n")) * 5 >= F.greatest(c(a, "n"), c(b, "n")) * 4) & (room >= least) & (c(a, "home") | c(b, "home")) & near & first


def _regions(windows: DataFrame) -> DataFrame:
    """(token, key, n, pos, large) of the members of regions of two distinct sets or more; ``large``: of more than FEW.

    Frequent shingles are counted apart, with partial sums, so that no task meets all rows of a very common one.
    """
    distinct = F.first(F.struct("n", "pos")).alias("of")
    rare = windows.select("key", "n", F.posexplode("rare").alias("pos", "token")).repartition("token").groupBy("token", "key").agg(distinct)
    rare = rare.select("token", "key", "of.n", "of.pos", F.count(F.lit(1)).over(Window.partitionBy("token")).alias("m")).where("m > 1")
    often = windows.select("key", "n", F.posexplode("often").alias("pos", "token"), F.size("rare").alias("before")).select("token", "key", "n", (F.col("before") + F.col("pos")).alias("pos"))
    often = often.groupBy("token", "key").agg(distinct).select("token", "key", "of.n", "of.pos")
    sizes = often.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    both = rare.unionByName(often.join(sizes, "token"))
    return written(both.select("token", "key", "n", "pos", (F.col("m") > FEW).alias("large")), "regions")


def link_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id) of every row: the size of its set and the smallest id that links reach.

    Texts are lower-cased in A-Z and split at ASCII white space. A set: the distinct runs of ``words`` words; of fewer
    words, the whole text as one; null, empty and wordless texts have none and link with nothing. Links: Jaccard of 0.8
    or more, decided on whole numbers, so a pair just at 0.8 is linked. Shingles are compared by 64-bit hashes, equal
    sets by the hash of all of them. Repeated rows stay and link, and so do repeated ids; null ids come out as they are.
    Very long texts are taken whole. Only the two named columns are read, so others may have any name. An empty table
    gives no rows.
    """
    shared_dir(docs.sparkSession)
    windows = shingle_sets(docs, id_col, text, words)
    sets = windows.select(id_col, "n", "key")
    regions = _regions(windows)
    corpus = Corpus(docs, sets, id_col, text, words)
    rich = regions.groupBy("key").agg(F.count(F.lit(1)).alias("rich"), F.sum(F.col("large").cast("long")).alias("large"))
    rich = written(rich, "rich")
    large = _able(regions.where("large").drop("large").join(rich.drop("large"), "key"))
    large = large.withColumn("core", F.col("pos") <= F.col("n") - F.ceil(F.col("n") * 8 / 9))
    large = written(large.withColumn("earlier", F.collect_list("token").over(Window.partitionBy("key").orderBy("pos").rowsBetween(-EARLIER, -1))), "large")

    close = _shared_windows(regions.where("not large"), rich.where("large > 0").select("key", "large"))
    lead = large.groupBy("token").agg(F.min(F.struct("pos", "n", "key")).alias("lead")).select("token", F.col("lead.key").alias("lead"), F.col("lead.n").alias("lead_n"))
    star = large.join(lead, "token").where("key <> lead and 5 * least(n, lead_n) >= 4 * greatest(n, lead_n)")
    star = star.select(*_ordered("lead", "lead_n", "key", "n"))
    linked = F.col("shared") * 100 >= F.col("joined") * 80
    roots = _merged(None, corpus.measured(corpus.near(close.unionByName(star))).where(linked))

    state = large.select("token", "key", "n", "pos", "core", "rich", "earlier", F.lit(True).alias("home"), F.array().cast("array<struct<lo:double,hi:double>>").alias("far"), F.lit(False).alias("whole"))
    while True:
        grouped = state.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        counts = grouped.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"))
        top = counts.groupBy("token").agg(F.max(F.struct("c", -F.col("root"))).alias("top"), F.sum("c").alias("m"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        top = top.select("token", (-F.col("top.col2")).alias("largest"), "m", (F.col("m") - F.col("top.c")).alias("outside"))
        live = written(grouped.join(top, "token"), "live")
        done = F.col("whole") | (F.col("outside") <= FEW) | (F.col("m") <= FEW)
        few = live.where(done)
        pairs = few.where("root <> largest").alias("x").join(few.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & _may_link("x", "y"))
        found = corpus.near(pairs.select(*_ordered("x.key", "x.n", "y.key", "y.n")))
        many = live.where(~done)
        if many.isEmpty():
            roots = _merged(roots, corpus.measured(found).where(linked))
            break
        pivots, tests = _pivot_tests(many)
        reach = corpus.bounded(tests.select(*_ordered("pivot", "pivot_n", "key", "n")))
        least = F.greatest(2 * F.col("least") / (F.col("na") + F.col("nb") + F.col("least")), 1 - F.least("na", "nb") / F.greatest("na", "nb"))
        reach = reach.select("a", "b", "na", "nb", least.alias("lo"))
        tested = corpus.measured(found.unionByName(reach.where(F.col("lo") <= REACH).drop("lo")))
        roots = _merged(roots, tested.where(linked))
        exact = tested.select("a", "b", (1 - F.col("shared") / F.col("joined")).alias("d"))
        state = written(_voronoi(many, pivots, tests, reach.join(exact, ["a", "b"], "left").select("a", "b", F.coalesce("d", "lo").alias("lo"), F.coalesce("d", F.lit(1.0)).alias("hi"))), "state")

    ids = corpus.of_key.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = ids.groupBy("root").agg(F.min(id_col).alias("component_id"))
    of_key = ids.select("key", "root").join(least, "root").select("key", "component_id")
    return sets.select(id_col, "n", "key").join(of_key, "key", "left").select(id_col, F.col("n").alias("n_shingles"), F.coalesce("component_id", id_col).alias("component_id"))


def _ordered(one: str, n: str, two: str, m: str) -> list[Column]:
    """(a, b, na, nb) of a pair of keys with their sizes: a is the smaller key."""
    swap = F.col(one) > F.col(two)
    pick = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    return [pick(one, two, "a"), pick(two, one, "b"), pick(n, m, "na"), pick(m, n, "nb")]


def _pivot_tests(many: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, pivot) of each region, from its largest groups one each, and (token, pivot, key) of all its other members."""
    sizes = many.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("pos", "key", "n")).alias("p")).select("token", "root", "c", F.col("p.key").alias("pivot"), F.col("p.n").alias("pivot_n"))
    chosen = sizes.withColumn("r", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("c"), "pivot"))).where(F.col("r") <= PIVOTS)
    pivots = written(chosen.select("token", "pivot", "pivot_n"), "pivots")
    return pivots, many.select("token", "key", "n").join(pivots, "token").where("key <> pivot")


def _voronoi(many: DataFrame, pivots: DataFrame, tests: DataFrame, away: DataFrame) -> DataFrame:
    """The regions of the next round, without the pivots: Voronoi regions and the rest, with their windows; cell 0 is the rest.

    A region whose windows would replicate most members stays whole. It, and any part with over half of its region's
    members, is marked ``whole``: to be finished, as another round would hardly cut it.
    """
    away = tests.withColumn("a", F.least("pivot", "key")).withColumn("b", F.greatest("pivot", "key")).join(away, ["a", "b"]).select("token", "key", "pivot", "lo", "hi")
    away = away.join(pivots.select("token", F.col("pivot").alias("key")), ["token", "key"], "left_anti")
    near = away.groupBy("token", "key").agg(F.array_sort(F.collect_list(F.struct("pivot", "lo", "hi"))).alias("all"), F.min(F.struct("hi", "pivot")).alias("nearest"))
    homely = F.col("nearest.hi") <= REACH
    window = F.filter("all", lambda x: (x.lo <= REACH + R + SLACK) & (~homely | (x.lo <= F.col("nearest.hi") + 2 * R + SLACK)))
    rest = F.when(F.col("nearest.hi") > REACH - R - SLACK, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>"))
    near = near.withColumn("home_cell", F.when(homely, F.col("nearest.pivot")).otherwise(0)).withColumn("cells", F.array_distinct(F.concat(F.transform(window, lambda x: x.pivot), rest)))
    split = near.groupBy("token").agg((F.sum(F.size("cells")) * 4 <= F.count(F.lit(1)) * 5).alias("split"), F.count(F.lit(1)).alias("of"))
    parts = near.select("token", F.explode("cells").alias("cell")).groupBy("token", "cell").agg(F.count(F.lit(1)).alias("part"))
    placed = many.select("token", "key", "n", "pos", "core", "rich", "earlier", "home", "far").join(near, ["token", "key"]).join(split, "token")
    placed = placed.withColumn("far", F.concat("far", F.transform("all", lambda x: F.struct(x.lo.alias("lo"), x.hi.alias("hi")))))
    placed = placed.withColumn("cell", F.explode(F.when(F.col("split"), F.col("cells")).otherwise(F.array(F.lit(0).cast("long"))))).join(parts, ["token", "cell"], "left")
    home = F.col("home") & (~F.col("split") | (F.col("cell") == F.col("home_cell")))
    whole = ~F.col("split") | (F.col("part") * 2 > F.col("of"))
    return placed.select(F.when(F.col("split"), F.xxhash64("token", "cell")).otherwise(F.col("token")).alias("token"), "key", "n", "pos", "core", "rich", "earlier", home.alias("home"), "far", whole.alias("whole"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, of the smallest id of each group; all rows of that id stay. Rows without words stay.

    Null ids stay, as no group has them; very long texts are compared whole; columns may have any names; an empty table gives no rows.
    """
    linked = link_groups(docs.select(id_col, text), id_col, text)
    gone = linked.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
