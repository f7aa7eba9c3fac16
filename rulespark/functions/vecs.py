"""Arrays. Positions count from 0; what changes an array returns the new one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions.std import col


def vec_empty(kind: str = "bigint") -> Column:
    return F.array().cast(f"array<{kind}>")


def vec_with_length(n, value) -> Column:
    return F.array_repeat(col(value), col(n).cast("int"))


def vec_with_capacity(n, kind: str = "bigint") -> Column:
    return vec_empty(kind)


def vec_singleton(x) -> Column:
    return F.array(col(x))


def vec_len(v) -> Column:
    return F.size(col(v))


def push(v, x) -> Column:
    return F.array_append(col(v), col(x))


def pop(v) -> Column:
    """The array without its last element."""
    return F.slice(col(v), 1, F.greatest(F.size(col(v)) - 1, F.lit(0)))


def append(v, other) -> Column:
    return F.concat(col(v), col(other))


def contains(v, x) -> Column:
    return F.exists(col(v), lambda y: y.eqNullSafe(col(x)))


def is_empty(v) -> Column:
    return F.size(col(v)) == 0


def nth(v, n) -> Column:
    return F.get(col(v), col(n).cast("int"))


def first(v) -> Column:
    return F.get(col(v), F.lit(0))


def last(v) -> Column:
    return F.get(col(v), F.size(col(v)) - 1)


def to_set(v) -> Column:
    return F.array_sort(F.array_distinct(col(v)))


def sort(v) -> Column:
    return F.array_sort(col(v))


def sort_by(v, key: Callable[[Column], Column]) -> Column:
    """By a key; equal keys keep their order."""
    keyed = F.transform(col(v), lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def resize(v, n, value) -> Column:
    n = col(n).cast("int")
    return F.slice(F.concat(col(v), F.array_repeat(col(value), F.greatest(n - F.size(col(v)), F.lit(0)))), 1, n)


def truncate(v, n) -> Column:
    return F.slice(col(v), 1, F.least(col(n).cast("int"), F.size(col(v))))


def swap_nth(v, n, value) -> Column:
    return update_nth(v, n, value)


def update_nth(v, n, value) -> Column:
    return F.transform(col(v), lambda x, i: F.when(i == col(n), col(value)).otherwise(x))


def zip(a, b) -> Column:  # noqa: A001
    """Pairs (x, y), as many as the shorter array has."""
    n = F.least(F.size(col(a)), F.size(col(b)))
    pairs = F.transform(F.slice(col(a), 1, n), lambda x, i: F.struct(x.alias("x"), F.get(col(b), i).alias("y")))
    return pairs


def unzip(v) -> Column:
    return F.struct(F.transform(col(v), lambda p: p["x"]).alias("x"), F.transform(col(v), lambda p: p["y"]).alias("y"))


def reverse(v) -> Column:
    return F.reverse(col(v))


def map(v, f: Callable[[Column], Column]) -> Column:  # noqa: A001
    return F.transform(col(v), f)


def flatmap(v, f: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(col(v), f))


def filter(v, f: Callable[[Column], Column]) -> Column:  # noqa: A001
    return F.filter(col(v), f)


retain = filter


def filter_map(v, f: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform(col(v), f), lambda x: x.isNotNull())


def find(v, f: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(col(v), f), F.lit(0))


def all(v, f: Callable[[Column], Column]) -> Column:  # noqa: A001
    return F.forall(col(v), f)


def any(v, f: Callable[[Column], Column]) -> Column:  # noqa: A001
    return F.exists(col(v), f)


def count(v, f: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(col(v), f))


def fold(v, start, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(col(v), col(start), f)


def arg_min(v, key: Callable[[Column], Column]) -> Column:
    """The first element with the least key."""
    keyed = F.transform(col(v), lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.array_min(keyed)["x"]


def arg_max(v, key: Callable[[Column], Column]) -> Column:
    """The last element with the largest key."""
    keyed = F.transform(col(v), lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.array_max(keyed)["x"]


push_imm, sort_imm, reverse_imm = push, sort, reverse
for _n in ("push", "pop", "append", "push_imm", "contains", "is_empty", "nth", "to_set", "sort", "sort_imm", "sort_by", "resize", "truncate", "swap_nth", "update_nth", "zip", "unzip", "reverse", "arg_min", "arg_max"):
    globals()["vec_" + _n] = globals()[_n]
