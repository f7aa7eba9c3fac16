"""Pairs of items that share a group, without a task that holds a whole group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulespark.storage import stored

#: Items of a group in one block, about, pairs that one task compares, and items
#: that one sends to the blocks.
BLOCK, TASK, SENT = 1_000, 4_000_000, 250_000


def pairs_within(rows: DataFrame, group: str, item: str, low: str, high: str) -> DataFrame:
    """Distinct (low, high): items low < high with a group in common; nulls have
    none. Groups are cut into blocks, and any two blocks of a group meet under a
    key of their own, so tasks become more, not larger, with the pairs. A pair
    repeats only if both items are in several groups: those alone are made
    distinct."""
    members = rows.select(F.col(group).alias("__group"), F.col(item).alias("__item")).where("__group is not null and __item is not null").distinct()
    members = members.withColumn("__several", F.count(F.lit(1)).over(Window.partitionBy("__item")) > 1)
    members = stored(members, "members")
    sizes = members.groupBy("__group").agg(F.count(F.lit(1)).alias("__n"))
    members = stored(members.join(sizes, "__group"), "members")
    # the sizes of all rows' groups: the squares of the groups' sizes
    compared, n, several = members.agg(F.coalesce(F.sum(F.col("__n").cast("double")), F.lit(0.0)), F.count(F.lit(1)), F.coalesce(F.max("__several"), F.lit(False))).first()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(compared / TASK))
    members = members.repartition(1 + int((compared / BLOCK + n) / SENT), "__item")

    blocks = F.ceil(F.col("__n") / BLOCK)
    own, every = F.pmod(F.xxhash64("__item"), blocks), F.sequence(F.lit(0).cast("long"), blocks - 1)
    key = ["__group", "__x", "__y"]
    left = members.select("__group", own.alias("__x"), F.explode(every).alias("__y"), F.col("__item").alias(low), F.col("__several").alias("__s"))
    right = members.select("__group", F.explode(every).alias("__x"), own.alias("__y"), F.col("__item").alias(high), F.col("__several").alias("__t"))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        # a broadcast would be judged by the size before the blocks are repeated
        return a.repartition(parts, *key).join(b.repartition(parts, *key).hint("merge"), key).where(F.col(low) < F.col(high))

    out = met(left, right).where("not (__s and __t)").select(low, high)
    if several:
        out = out.unionByName(met(left.where("__s"), right.where("__t")).select(low, high).repartition(parts, low, high).distinct())
    return out
