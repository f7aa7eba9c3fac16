"""Functions of programs in the other rule dialect that can be converted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions import fp
from rulespark.functions.std import col, wrap


def castTo32(x) -> Column:  # noqa: N802
    return wrap(x, "s32").cast("int")


def castTo64(x) -> Column:  # noqa: N802
    return col(x).cast("long")


def cat(a, b) -> Column:
    return F.concat(col(a), col(b))


def strlen(s) -> Column:
    return F.octet_length(col(s))


def ord(s) -> Column:  # noqa: A001
    """A number that is the same for equal strings."""
    return F.hash(col(s))


def substr(s, start, length) -> Column:
    """Nothing for a start beyond the string."""
    return F.substr(col(s), col(start) + 1, F.greatest(col(length), F.lit(0)))


def contains(part, s) -> Column:
    return F.contains(col(s), col(part))


def re_match(pattern, s) -> Column:
    """Whether the whole string matches."""
    return F.regexp_like(col(s), F.concat(F.lit("^(?:"), col(pattern), F.lit(")$")))


def to_number(s) -> Column:
    return F.coalesce(col(s).try_cast("int"), F.lit(0))


def to_istring(x) -> Column:
    return col(x).cast("string")


def random() -> Column:
    """Another number for each row."""
    return F.monotonically_increasing_id()


def land(a, b) -> Column:
    return ((col(a) != 0) & (col(b) != 0)).cast("int")


def lor(a, b) -> Column:
    return ((col(a) != 0) | (col(b) != 0)).cast("int")


def lnot(a) -> Column:
    return (col(a) == 0).cast("int")


def ftoi(x) -> Column:
    return fp.int_from_d(x).try_cast("int")


def ftou(x) -> Column:
    return fp.int_from_d(x).try_cast("long")


def itof(x) -> Column:
    return col(x).cast("float")


def itou(x) -> Column:
    return wrap(x, "u32")


def utoi(x) -> Column:
    return wrap(x, "s32")


utof = itof
for _n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh", "exp"):
    globals()[_n] = getattr(fp, _n + "_d")
log = fp.ln_d


def group_count32() -> Column:
    return F.count(F.lit(1)).cast("int")


def group_max(x) -> Column:
    return F.max(col(x))


def group_min(x) -> Column:
    return F.min(col(x))


def group_mean(x) -> Column:
    return F.avg(col(x))


group_mean_d = group_mean


def group_sum(x) -> Column:
    return F.sum(col(x))


group_sum_u = group_sum_d = group_sum
for _n in ("count32", "max", "min", "mean", "mean_d", "sum", "sum_u", "sum_d"):
    globals()["souffle_group_" + _n] = globals()["group_" + _n]
