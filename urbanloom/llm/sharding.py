"""Shards of near-equal bytes: minimax contiguous partition of ordered atomic groups. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Groups are ordered by the leading hex digits of their text's md5; texts that share them move together.
CELL_DIGITS = 4


def _fill(sizes: Column, capacity: Column) -> Column:
    """Positions at which a greedy fill of ``sizes`` in order opens a shard at this capacity, the first (0) included.

    The capacity travels in the accumulator: named inside the lambda its expression would be evaluated for each size.
    """
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("cur"), F.array(F.lit(0)).alias("at"), capacity.cast("long").alias("cap"))
    return F.aggregate(sizes, zero, lambda a, s: F.struct((a.i + 1).alias("i"), F.when(a.cur + s <= a.cap, a.cur + s).otherwise(s).alias("cur"), F.when(a.cur + s <= a.cap, a["at"]).otherwise(F.concat(a["at"], F.array(a.i))).alias("at"), a.cap.alias("cap")), lambda a: a["at"])


def smallest_capacity(sizes: Column, total: Column, shards: Column) -> Column:
    """Binary search for the smallest capacity at which a greedy fill needs at most ``shards`` shards."""
    begin = F.struct(F.coalesce(F.array_max(sizes), F.lit(0)).cast("long").alias("lo"), total.cast("long").alias("hi"), shards.cast("int").alias("n"))

    def halve(a: Column, _: Column) -> Column:
        mid = F.floor((a.lo + a.hi) / 2).cast("long")
        tried = F.when(a.lo >= a.hi, F.lit(True)).otherwise(F.size(_fill(sizes, mid)) <= a.n)
        next_of = F.transform(F.array(tried), lambda fits: F.struct(F.when((a.lo >= a.hi) | fits, a.lo).otherwise(mid + 1).alias("lo"), F.when((a.lo < a.hi) & fits, mid).otherwise(a.hi).alias("hi"), a.n.alias("n")))
        return next_of[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(52)), begin, halve, lambda a: a.hi)


def even_cuts(sizes: Column, total: Column, shards: Column, capacity: Column) -> Column:
    """Positions at which shards open so that none is over ``capacity`` and each ends as near its even share as that allows.

    A fill from the end gives the first position from which the later shards can hold the rest; from there on a
    shard ends once it has an even share of what was left when it opened, and at the capacity anyway. Groups of at least
    an even share of all are left out of these shares, as none of them can be made even.
    """
    back, n, count = _fill(F.reverse(sizes), capacity), shards.cast("int"), F.size(sizes)
    early = F.transform(F.array(F.struct(back.alias("r"), n.alias("n"), count.alias("c"))), lambda x: F.transform(F.sequence(F.lit(0), x.n), lambda k: F.when(k >= x.n, x.c).when(x.n - k < F.size(x.r), x.c - F.get(x.r, x.n - k)).otherwise(0)))[0]
    even = total / n
    usual = F.aggregate(sizes, F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("h"), even.alias("e")), lambda a, s: F.struct((a.s + F.when(s < a.e, s).otherwise(0)).alias("s"), (a.h + (s >= a.e).cast("int")).alias("h"), a.e.alias("e")))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("cur"), F.array(F.lit(0)).alias("at"), F.lit(False).alias("hot"), usual.s.alias("rest"), (n - usual.h).alias("left"), capacity.cast("long").alias("cap"), even.alias("even"), n.alias("n"), early.alias("early"))

    def step(a: Column, s: Column) -> Column:
        k, hot = F.size(a["at"]), s >= a.even
        enough = hot | a.hot | (a.cur + s / 2 > a.rest / F.greatest(a.left, F.lit(1)))
        opens = (a.cur > 0) & ((a.cur + s > a.cap) | ((k < a.n) & (a.i >= F.get(a.early, k)) & enough))
        closed = opens & ~a.hot
        kept = [a[x].alias(x) for x in ("cap", "even", "n", "early")]
        return F.struct(
            (a.i + 1).alias("i"), F.when(opens, s).otherwise(a.cur + s).alias("cur"), F.when(opens, F.concat(a["at"], F.array(a.i))).otherwise(a["at"]).alias("at"), F.when(opens, hot).otherwise(a.hot | hot).alias("hot"),
            F.when(closed, a.rest - a.cur).otherwise(a.rest).alias("rest"), F.when(closed, a.left - 1).otherwise(a.left).alias("left"), *kept)

    return F.aggregate(sizes, zero, step, lambda a: a["at"])


def partition_groups(groups: DataFrame, shards: int, key: str = "cell", size: str = "bytes") -> DataFrame:
    """(key, shard) of at most some 10^5 ordered atomic groups: contiguous in their keys' order, with the smallest possible largest shard."""
    one = groups.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(size).cast("long").alias("b")))).alias("all"), F.sum(F.col(size)).cast("long").alias("total"))
    one = one.select("all", F.col("all.b").alias("sizes"), "total")
    one = one.withColumn("starts", even_cuts(F.col("sizes"), F.col("total"), F.lit(shards), smallest_capacity(F.col("sizes"), F.col("total"), F.lit(shards))))
    return one.select(F.posexplode("all"), "starts").select(F.col("col.k").alias(key), (F.size(F.filter("starts", lambda s: s <= F.col("pos"))) - 1).alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row; law ``bytes``: sizes near equal.

    Size: UTF-8 bytes of the text (null: none) plus 8. Rows of equal text stay together; null texts count as one
    group with the empty text and have a null text_crc32. An atomic group is all texts whose md5 starts with the same
    four hex digits, so the partition works on at most 65536 sizes however large the table is; against groups of single
    texts the largest shard can be larger by at most one cell's bytes. Slots number the rows
    of a shard from 0 without gaps, by cell, then a salt of the id, then id, then checksum; repeated rows get a slot
    each. A cell of n rows is numbered in about sqrt(n) salted parts of about sqrt(n) rows, so no hot text meets one
    task. grown_shard is null under this law. Null ids are rows as others, in one salt of
    their cell; very long texts count whole; only the two named columns are read. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.encode(F.col(text), "UTF-8")).alias("text_crc32"),
        F.conv(F.substring(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")), 1, CELL_DIGITS), 16, 10).cast("int").alias("cell"),
    )
    cells = rows.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    cells = cells.join(partition_groups(cells.select("cell", "bytes"), shards), "cell").withColumn("salts", F.ceil(F.sqrt("n")))
    salted = rows.join(F.broadcast(cells.select("cell", "shard", "salts")), "cell").withColumn("salt", F.pmod(F.xxhash64(id_col), "salts"))
    parts = salted.groupBy("shard", "cell", "salt").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy("cell").orderBy("salt")) - F.col("m")
    in_cell = parts.select("cell", "salt", before.alias("in_cell"))
    of_cell = cells.select("cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("of_cell"))
    offsets = in_cell.join(F.broadcast(of_cell), "cell").select("cell", "salt", (F.col("in_cell") + F.col("of_cell")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("cell", "salt").orderBy(id_col, "text_crc32", "size"))
    return salted.withColumn("place", place).join(offsets, ["cell", "salt"]).select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
