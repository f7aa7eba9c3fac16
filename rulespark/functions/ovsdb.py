"""Values of a switch database's update documents: UUIDs and optional sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions.std import col


def extract_uuid(x: Column) -> Column:
    """Of a struct (uuid, named): whichever there is."""
    return F.coalesce(x["uuid"], x["named"])


def uuid2str(u) -> Column:
    return F.lower(col(u))


def uuid2name(u) -> Column:
    """A name that is allowed where UUIDs are not."""
    return F.concat(F.lit("u"), F.regexp_replace(F.lower(col(u)), "-", "_"))


def set_map_uuid2str(s) -> Column:
    return F.transform(col(s), uuid2str)


def set_map_uuid2name(s) -> Column:
    return F.transform(col(s), uuid2name)


def set_extract_uuids(s) -> Column:
    return F.array_sort(F.array_distinct(F.transform(col(s), extract_uuid)))


def map_extract_val_uuids(m) -> Column:
    return F.transform_values(col(m), lambda _, v: extract_uuid(v))


def group2set_remove_sentinel(x, sentinel="") -> Column:
    """A group's values as a set, without the one that stands for none."""
    return F.array_sort(F.collect_set(F.when(col(x) != sentinel, col(x))))


group2vec_remove_sentinel = group2set_remove_sentinel


def group2map_remove_sentinel(k, v, sentinel="") -> Column:
    return F.map_from_entries(F.array_sort(F.collect_set(F.when(col(k) != sentinel, F.struct(col(k).alias("key"), col(v).alias("value"))))))
