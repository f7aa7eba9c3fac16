"""Maps. Where order matters it is that of the keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions.std import col


def map_empty(kind: str = "map<string,bigint>") -> Column:
    return F.create_map().cast(kind)


def map_singleton(k, v) -> Column:
    return F.create_map(col(k), col(v))


def _sorted(m) -> Column:
    return F.array_sort(F.map_entries(col(m)), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def size(m) -> Column:
    return F.size(col(m))


def is_empty(m) -> Column:
    return F.size(col(m)) == 0


def insert(m, k, v) -> Column:
    return F.map_concat(remove(m, k), F.create_map(col(k), col(v)))


def remove(m, k) -> Column:
    return F.map_filter(col(m), lambda x, _: x != col(k))


def get(m, k) -> Column:
    return F.try_element_at(col(m), col(k))


def contains_key(m, k) -> Column:
    return F.map_contains_key(col(m), col(k))


def keys(m) -> Column:
    return F.array_sort(F.map_keys(col(m)))


map_keys = keys


def values(m) -> Column:
    return F.transform(_sorted(m), lambda e: e["value"])


def nth_key(m, n) -> Column:
    return F.get(keys(m), col(n).cast("int"))


def nth_value(m, n) -> Column:
    return F.get(values(m), col(n).cast("int"))


def union(a, b) -> Column:
    """Entries of both; those of ``b`` where both have a key."""
    return F.map_concat(F.map_filter(col(a), lambda k, _: ~F.map_contains_key(col(b), k)), col(b))


def to_vec(m) -> Column:
    return _sorted(m)


def to_map(entries) -> Column:
    return F.map_from_entries(col(entries))


def map(m, f) -> Column:  # noqa: A001
    return F.transform_values(col(m), f)


map_in_place = map_map_in_place = map


def filter(m, f) -> Column:  # noqa: A001
    return F.map_filter(col(m), f)


retain = filter


def filter_map(m, f) -> Column:
    return F.map_filter(F.transform_values(col(m), f), lambda _, v: v.isNotNull())


def find(m, f) -> Column:
    return F.get(F.filter(_sorted(m), lambda e: f(e["key"], e["value"])), F.lit(0))


def any(m, f) -> Column:  # noqa: A001
    return F.exists(F.map_entries(col(m)), lambda e: f(e["key"], e["value"]))


def fold(m, start, f) -> Column:
    return F.aggregate(_sorted(m), col(start), lambda a, e: f(a, e["key"], e["value"]))


insert_imm = insert
for _n in ("size", "insert", "remove", "insert_imm", "get", "contains_key", "is_empty", "nth_key", "nth_value", "union", "values"):
    globals()["map_" + _n] = globals()[_n]
