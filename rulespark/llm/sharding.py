"""Sharding of indivisible groups into bins of one capacity, best fit decreasing.

A group is all rows with one text. Groups go by falling size into the bin with
the least remaining capacity that still holds them; a balanced tree of
(remaining, bin) finds it. The capacity is the smallest of a short rising series
for which the wanted number of bins is enough.

Sizes are rounded up to twelve significant bits for the plan, so there are at
most 4096 * 52 size classes whatever the input; a plan says "groups number r and
following of this class go to this bin". Equal sizes are interchangeable, so
that is best fit decreasing one by one. Numbers of groups within a class, and of
rows within a shard, are counted in salted parts and then offset, so that no
class and no shard meets in one task.

Null texts have no bytes and form a group of their own with empty ones. Rows
with equal or null ids are separate rows. Other columns are not looked at.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespark.llm.shared import text_or_empty, written

ROW_BYTES = 8
PART_ROWS = 200_000


class RoomTree:
    """Treap of (remaining capacity, bin)."""

    def __init__(self):
        self.root: list | None = None
        self.random = random.Random(7)

    def _split(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high

    def insert(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self.random.random(), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least key with at least ``size`` remaining."""
        low, high = self._split(self.root, (size, -1))
        node = high
        while node is not None and node[2] is not None:
            node = node[2]
        if node is None:
            self.root = low
            return None
        _, high = self._split(high, (node[0][0], node[0][1] + 1))
        self.root = self._merge(low, high)
        return node[0]


def best_fit_bins(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Runs (size, rank, groups, bin) for (size, groups) classes, or None if
    more than ``most`` bins were needed."""
    tree, bins, runs = RoomTree(), 0, []
    for size, n in sorted(classes, reverse=True):
        rank = 0
        while n:
            found = tree.take(size)
            if found is None:
                if size > capacity or bins == most:
                    return None
                found, bins = (capacity, bins), bins + 1
            room, at = found
            m = min(n, room // size)
            runs.append((size, rank, m, at))
            tree.insert((room - m * size, at))
            rank, n = rank + m, n - m
    return runs


def plan(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """The runs for the least tried capacity with which ``shards`` bins do."""
    total = sum(s * n for s, n in classes)
    least = max(-(-total // shards), max((s for s, _ in classes), default=1))
    slack = 0
    while True:
        runs = best_fit_bins(classes, least + slack, shards)
        if runs is not None:
            return runs
        slack = max(slack * 2, least >> 20, 1)


def rounded(size: Column, bits: int = 12) -> Column:
    """``size`` rounded up to ``bits`` significant bits."""
    step = F.expr(f"shiftleft(1L, greatest(0, length(bin({size._jc.toString()})) - {bits}))")
    return (F.ceil(size / step) * step).cast("long")


def numbered(rows: DataFrame, by: str, key: Column, parts: int, name: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... within each value of ``by``, counted in
    ``parts`` salted parts."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    local = F.row_number().over(Window.partitionBy(by, "salt").orderBy(key)) - 1
    counts = rows.groupBy(by, "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(by, "salt", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = rows.withColumn("local", local)
    return ranked.join(counts, [by, "salt"]).withColumn(name, (F.col("local") + F.col("before")).cast("long")).drop("salt", "local", "before")


def shard(docs: DataFrame, *, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (bytes of the text and ``ROW_BYTES``), text_crc32, shard and
    slot (gapless from 0 in each shard) of every row. Sizes of shards are near
    equal unless one group alone is larger than its share."""
    spark = docs.sparkSession
    body = text_or_empty(text).cast("binary")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("digest")
    )
    rows = written(rows, "sizes")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    groups = written(groups.select("digest", rounded(F.col("bytes")).alias("class")), "groups")
    classes = [(r["class"], r["n"]) for r in groups.groupBy("class").agg(F.count("*").alias("n")).collect()]
    total = sum(n for _, n in classes)
    runs = plan(classes, shards)
    runs = spark.createDataFrame(runs, "class long, first long, n long, shard long") if runs else spark.createDataFrame([], "class long, first long, n long, shard long")
    ranked = numbered(groups, "class", F.col("digest"), max(8, total // PART_ROWS), "rank")
    # at most a few runs for each of the bounded number of classes
    placed = ranked.join(F.broadcast(runs), "class").where("rank >= first and rank < first + n").select("digest", F.col("shard").cast("int").alias("shard"))
    sharded = written(rows.join(placed, "digest").select("row", "doc_id", "size", "text_crc32", "shard"), "sharded")
    slots = numbered(sharded, "shard", F.col("row"), max(4, rows.count() // shards // PART_ROWS), "slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", "slot")
