"""Aggregates over a group, for ``groupBy(...).agg``. A group's values are
distinct and in their own order; where Spark has an aggregate for it, that is
used, so that partial sums are made before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions import sets, vecs
from rulespark.functions.std import col


def to_set(x) -> Column:
    return F.array_sort(F.collect_set(col(x)))


to_vec = to_hashset = to_set


def key(k) -> Column:
    return F.any_value(col(k))


def count_distinct(x) -> Column:
    return F.count_distinct(col(x))


def count(condition=None) -> Column:
    return F.count(F.lit(1)) if condition is None else F.count_if(condition)


def min(x) -> Column:  # noqa: A001
    return F.min(col(x))


def max(x) -> Column:  # noqa: A001
    return F.max(col(x))


first = min


def nth(x, n) -> Column:
    return F.get(to_set(x), col(n).cast("int"))


def sum_of(x) -> Column:
    return F.sum(col(x))


def arg_min(value, by) -> Column:
    """Value with the least ``by``; ties to the least value."""
    return F.min(F.struct(col(by).alias("k"), col(value).alias("v")))["v"]


def arg_max(value, by) -> Column:
    """Value with the largest ``by``; ties to the largest value."""
    return F.max(F.struct(col(by).alias("k"), col(value).alias("v")))["v"]


def all(condition) -> Column:  # noqa: A001
    return F.every(condition)


def any(condition) -> Column:  # noqa: A001
    return F.some(condition)


def find(x, f) -> Column:
    return F.min(F.when(f(col(x)), col(x)))


def filter(x, f) -> Column:  # noqa: A001
    return F.array_sort(F.collect_set(F.when(f(col(x)), col(x))))


def map(x, f) -> Column:  # noqa: A001
    return vecs.map(to_set(x), f)


def flatmap(x, f) -> Column:
    return vecs.flatmap(to_set(x), f)


def filter_map(x, f) -> Column:
    return vecs.filter_map(to_set(x), f)


def fold(x, start, f) -> Column:
    return F.aggregate(to_set(x), col(start), f)


def to_map(k, v) -> Column:
    """Of several values for one key, the largest stands."""
    entries = F.array_sort(F.collect_set(F.struct(col(k).alias("key"), col(v).alias("value"))))
    last = F.filter(entries, lambda e, i: F.coalesce(F.get(entries, i + 1)["key"] != e["key"], F.lit(True)))
    return F.map_from_entries(last)


def to_setmap(k, v) -> Column:
    entries = F.collect_set(F.struct(col(k).alias("key"), col(v).alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_sort(F.transform(F.filter(entries, lambda e: e["key"] == n), lambda e: e["value"]))))


def set_unions(s) -> Column:
    return sets.unions(F.collect_list(col(s)))


def unzip(pair) -> Column:
    return vecs.unzip(to_set(pair))


union = setref_unions = set_unions
for _n in ("count_distinct", "first", "nth", "to_set", "to_vec", "to_map", "to_setmap", "set_unions", "setref_unions", "min", "max", "key", "unzip", "to_hashset"):
    globals()["group_" + _n] = globals()[_n]
group_hashset_unions = set_unions
