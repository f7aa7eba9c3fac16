"""Sets, as sorted arrays without repeats; hash sets and small sets are the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions import vecs
from rulespark.functions.std import col


def empty(kind: str = "bigint") -> Column:
    return F.array().cast(f"array<{kind}>")


def singleton(x) -> Column:
    return F.array(col(x))


def size(s) -> Column:
    return F.size(col(s))


def insert(s, x) -> Column:
    return F.array_sort(F.array_union(col(s), F.array(col(x))))


def remove(s, x) -> Column:
    return F.filter(col(s), lambda y: ~y.eqNullSafe(col(x)))


contains, is_empty, nth = vecs.contains, vecs.is_empty, vecs.nth


def to_vec(s) -> Column:
    return col(s)


def union(a, b) -> Column:
    return F.array_sort(F.array_union(col(a), col(b)))


def unions(sets) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(col(sets))))


def intersection(a, b) -> Column:
    return F.array_sort(F.array_intersect(col(a), col(b)))


def difference(a, b) -> Column:
    return F.array_sort(F.array_except(col(a), col(b)))


def map(s, f) -> Column:  # noqa: A001
    return F.array_sort(F.array_distinct(F.transform(col(s), f)))


filter, filter_map, find, all, any, fold, arg_min, arg_max = vecs.filter, vecs.filter_map, vecs.find, vecs.all, vecs.any, vecs.fold, vecs.arg_min, vecs.arg_max
insert_imm, remove_imm, to_hashset = insert, remove, vecs.to_set
for _prefix in ("set_", "hashset_"):
    for _n in ("empty", "singleton", "size", "insert", "insert_imm", "remove", "remove_imm", "contains", "is_empty", "nth", "to_vec", "union", "unions", "intersection", "difference", "arg_min", "arg_max"):
        globals()[_prefix + _n] = globals()[_n]
