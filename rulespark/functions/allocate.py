"""Numbers for those that want one: free ones in order, hints first.

``allocate`` and its variants work on one row's arrays. ``allocate_relation``
gives numbers to the rows of a relation without collecting them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespark.functions.std import col, python_function
from rulespark.storage import stored


def _free(taken, low: int, high: int) -> Column:
    return F.array_except(F.sequence(F.lit(low), F.lit(high)), F.coalesce(col(taken), F.array().cast("array<int>")))


def allocate_opt(taken, wanting, low: int, high: int) -> Column:
    """(who, number) for each; null when no number is left."""
    free = _free(taken, low, high)
    return F.transform(col(wanting), lambda w, i: F.struct(w.alias("who"), F.get(free, i).alias("number")))


def allocate(taken, wanting, low: int, high: int) -> Column:
    """(who, number) for those that get one."""
    return F.filter(allocate_opt(taken, wanting, low, high), lambda s: s["number"].isNotNull())


@python_function("array<struct<who:string,number:bigint>>")
def _hinted(taken, names, hints, low, high):
    used, out, at = set(taken), [], low
    for name, hint in zip(names, hints):
        if hint is not None and low <= hint <= high and hint not in used:
            number = hint
        else:
            while at in used:
                at += 1
            number = at
        if number <= high:
            used.add(number)
            out.append({"who": name, "number": number})
    return out


def allocate_with_hint(taken, wanting, low: int, high: int) -> Column:
    """``wanting`` has structs (who, hint); a hint is used if it is free."""
    names = F.transform(col(wanting), lambda s: s["who"].cast("string"))
    hints = F.transform(col(wanting), lambda s: s["hint"].cast("long"))
    return _hinted(col(taken).cast("array<bigint>"), names, hints, F.lit(low), F.lit(high))


def adjust_allocation(allocated, wanting, low: int, high: int) -> Column:
    """Those with a number in the map ``allocated`` keep it, others get a new one."""
    kept = F.filter(F.transform(col(wanting), lambda w: F.struct(w.alias("who"), F.try_element_at(col(allocated), w).alias("number"))), lambda s: s["number"].isNotNull())
    fresh = F.filter(col(wanting), lambda w: ~F.map_contains_key(col(allocated), w))
    return F.concat(kept, allocate(F.transform(kept, lambda s: s["number"]), fresh, low, high))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in the order of ``key``, nulls last. Rows are
    sorted in ranges that are stored, and each range counts on from those before it."""
    order = F.col(key).asc_nulls_last()
    ranges = stored(df.repartitionByRange(order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    # one row for each range
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return ranges.withColumn("__local", local).join(counts.select("__range", before.alias("__before")), "__range").select(*df.columns, (F.col("__local") + F.col("__before")).cast("long").alias(name))


def allocate_relation(wanting: DataFrame, taken: DataFrame, name: str, low: int, high: int) -> DataFrame:
    """``wanting`` with a column ``name``: the free numbers in the order of its
    first column, as far as they go. taken: one column of numbers."""
    free = wanting.sparkSession.range(low, high + 1).toDF("number").join(taken.toDF("number"), "number", "left_anti")
    return numbered(wanting, wanting.columns[0], "__i").join(numbered(free, "number", "__i"), "__i").select(*wanting.columns, F.col("number").alias(name))
