"""Spelling variants: words within one edit of each other, found by pivotal grams against gram prefixes.

Every word orders its bigrams by how rare they are among words. Its prefix is its three rarest bigrams (one edit touches
two at most) with all of their repeats, its pivots the two disjoint bigrams of the prefix with the smallest sum of
frequencies. Of two words within one edit, that whose prefix ends earlier in the order has a pivot which the edit leaves
alone, and which then lies in the other's prefix.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_runs, written

#: Fixed values of the words' alphabet: runs of these letters, of which only A-Z have another case here.
RUN = "[A-Za-zÀ-ÿ]{%d,}"
SMALL = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Of this many runs in a document's words one loses a letter, as a source of misspellings.
MISSPELT = 199
#: A list of postings with more pivots than this is divided by the rest of its words.
CROWD = 16


def _lower(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(SMALL)


def count_words(docs: DataFrame, least_length: int = 6, least_count: int = 5, misspelt: int = MISSPELT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all maximal runs of letters that have the least length and occur often enough in all texts together.

    Where ``misspelt`` divides the crc32 of ``<id>:<run>``, the run loses its code point at that crc32 modulo its length
    (0: no run does). Counts are added up within a task before they are shuffled. Null texts have no words and null ids
    count as the empty text; texts are taken whole.
    """
    pattern = re.compile(RUN % least_length)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for part, texts in text_runs(batches):
            for key, body in zip(part.column(0).to_pylist(), texts, strict=True):
                start = zlib.crc32(f"{key or ''}:".encode())
                once: dict[str, int] = {}
                for run, n in Counter(pattern.findall(body or "")).items():
                    low = _lower(run)
                    once[low] = once.get(low, 0) + n
                for low, n in once.items():
                    h = zlib.crc32(low.encode(), start)
                    if misspelt and h % misspelt == 0:
                        at = h % len(low)
                        low = low[:at] + low[at + 1 :]
                        if len(low) < least_length:
                            continue
                    held[low] += n
            if len(held) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    found = docs.select(F.col(id_col).cast("string"), F.col(text)).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def pivots_and_prefix(word: str, rank: dict[str, int], freq: dict[str, int]) -> tuple[list[int], list[int]]:
    """Positions of the two pivots and of the prefix of a word of at least four letters."""
    grams = [word[i : i + 2] for i in range(len(word) - 1)]
    last = sorted(rank[g] for g in grams)[2]
    prefix = [i for i, g in enumerate(grams) if rank[g] <= last]
    # dynamic programme over positions: the cheapest gram that ends before this one, and the cheapest pair so far
    best, cheapest, ended = None, None, 0
    for i in prefix:
        while ended < len(prefix) and prefix[ended] <= i - 2:
            j = prefix[ended]
            cheapest = j if cheapest is None or freq[grams[j]] < freq[grams[cheapest]] else cheapest
            ended += 1
        if cheapest is not None and (best is None or freq[grams[cheapest]] + freq[grams[i]] < best[0]):
            best = (freq[grams[cheapest]] + freq[grams[i]], cheapest, i)
    return list(best[1:]), prefix


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, na, nb), both ways round, of all pairs of distinct words of (word, n) that exactly one inserted, deleted or replaced letter tells apart.

    A surviving gram lies left of the edit, and then all up to its end agrees, or right of it, and then all from its start
    does: these are the position limits, and the two keys under which a gram is posted. Lists with many pivots are divided
    by the rest of the word, on the other side of the gram: rests that one edit tells apart share a form of which at most
    one letter is missing. Pairs of a list are then verified inside the join. Grams of the alphabet number at most 8,100, so their
    frequencies are broadcast.
    """
    spark = words.sparkSession
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    freq = {r["g"]: r["n"] for r in grams.collect()}
    shared = spark.sparkContext.broadcast((freq, {g: k for k, g in enumerate(sorted(freq, key=lambda g: (freq[g], g)))}))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, rank = shared.value
        for batch in batches:
            keys, rests, at, pivot = [], [], [], []
            for row, word in enumerate(batch.column(0).to_pylist()):
                pivots, prefix = pivots_and_prefix(word, rank, freq)
                for i in prefix:
                    keys += ["<" + word[: i + 2], ">" + word[i:]]
                    rests += [word[i + 2 :], word[:i]]
                    at += [row, row]
                    pivot += [i in pivots] * 2
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(rests, pa.string()), batch.column(0).take(taken), batch.column(1).take(taken), pa.array(pivot, pa.bool_())], ["key", "rest", "word", "n", "pivot"])

    postings = written(words.select("word", "n").mapInArrow(post, "key string, rest string, word string, n long, pivot boolean"), "postings")
    crowded = written(postings.groupBy("key").agg(F.sum(F.col("pivot").cast("int")).alias("p")).where(F.col("p") > CROWD).select("key", F.lit(True).alias("crowded")), "crowded")
    size = F.length("rest")
    forms = F.array_distinct(F.concat(F.array("rest"), F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.concat(F.substring(F.col("rest"), F.lit(1), i - 1), F.substring(F.col("rest"), i + 1, size)))))
    told = postings.join(crowded, "key", "left").select(F.explode(F.when(F.col("crowded"), F.transform(forms, lambda f: F.concat("key", F.lit("|"), f))).otherwise(F.array("key"))).alias("key"), "word", "n", "pivot")
    left = told.where("pivot").select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    right = told.select(F.col("key").alias("k"), F.col("word").alias("b"), F.col("n").alias("nb"))
    one_edit = (F.col("a") != F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein(F.col("a"), F.col("b"), 1) == 1)
    pairs = left.join(right, (F.col("key") == F.col("k")) & one_edit)
    a_first = F.col("a") < F.col("b")
    once = pairs.select(*(F.when(a_first, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("na", "nb"), ("b", "a"), ("nb", "na")))).distinct()
    return once.select(F.explode(F.array(F.struct("a", "b", "na", "nb"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb")))).alias("x")).select("x.*")


def roots(forms: DataFrame, rounds: int = 6) -> DataFrame:
    """(word, root) of every row of (word, form): forms followed to the last word, by pointer doubling.

    A form is at least ``ratio`` = 5 times as frequent as its word, so no chain of counts that a long holds is over 27
    links long, and ``rounds`` = 6 doublings follow 64; rounds end once none moves.
    """
    links = written(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return links


def spelling_variants(docs: DataFrame, ratio: int = 5, least_length: int = 6, least_count: int = 5, misspelt: int = MISSPELT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that is long and frequent enough.

    form: the most frequent word within one edit (ties: the first in code-point order) if it is ``ratio`` times as frequent
    as the word, else null; root: the last form that is reached by following forms, the word itself if there is none.
    ``least_length`` is at least 4, so that a word has three bigrams. Repeated rows count each; null ids and texts as in
    ``count_words``; other columns are not read; an empty table gives no rows.
    """
    if least_length < 4:
        raise ValueError("least_length must be at least 4")
    words = written(count_words(docs, least_length, least_count, misspelt, id_col, text), "words")
    near = near_pairs(words).groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("nb")).alias("less"), F.col("b").alias("b"))).alias("best"))
    joined = words.join(near.withColumnRenamed("a", "word"), "word", "left")
    formed = -F.col("best.less") >= ratio * F.col("n")
    told = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.b")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")), "forms")
    return told.join(roots(told), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
