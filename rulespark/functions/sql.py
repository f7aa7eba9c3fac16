"""What SQL programs use: extracts, nullable operators, aggregates. Names that
end in ``_N`` take nulls, those in ``_R`` do not have them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions.std import col

sql_extract_year = lambda d: F.year(col(d))
sql_extract_month = lambda d: F.month(col(d))
sql_extract_week = lambda d: F.weekofyear(col(d))
sql_extract_day = sql_extract_day_of_month = lambda d: F.dayofmonth(col(d))
sql_extract_doy = lambda d: F.dayofyear(col(d))
#: 0 is Sunday
sql_extract_dow = sql_extract_day_of_week = lambda d: F.dayofweek(col(d)) - 1
sql_extract_hour = lambda t: F.hour(col(t))
sql_extract_minute = lambda t: F.minute(col(t))
sql_extract_second = lambda t: F.second(col(t))


def sql_array_contains(a, x) -> Column:
    return F.array_contains(col(a), col(x))


sql_array_contains_N = sql_set_contains = sql_set_contains_N = sql_array_contains  # noqa: N816


def sql_array_length(a) -> Column:
    return F.when(col(a).isNotNull(), F.size(col(a)))


def sql_substr(s, start, length) -> Column:
    """From the position ``start``, which counts from 1."""
    return F.substr(col(s), col(start), col(length))


def sql_abs(x) -> Column:
    return F.abs(col(x))


def sql_concat(*parts) -> Column:
    return F.concat(*(col(p).cast("string") for p in parts))


sql_substr_N, sql_abs_N, sql_concat_N = sql_substr, sql_abs, sql_concat  # noqa: N816


def is_null(x) -> Column:
    return col(x).isNull()


def insert_non_null(a, x) -> Column:
    return F.when(col(x).isNull(), col(a)).otherwise(F.array_append(col(a), col(x)))


def unwrapBool(x) -> Column:  # noqa: N802
    """A condition that is null does not hold."""
    return F.coalesce(col(x), F.lit(False))


def b_not_N(x) -> Column:  # noqa: N802
    return ~col(x)


def b_and(a, b) -> Column:
    """Null if either side is."""
    return F.when(col(a).isNotNull() & col(b).isNotNull(), col(a) & col(b))


def b_or(a, b) -> Column:
    return F.when(col(a).isNotNull() & col(b).isNotNull(), col(a) | col(b))


def set_signed_sum(s) -> Column:
    """The sum of a set's elements."""
    return F.aggregate(col(s), F.lit(0).cast("long"), lambda a, x: a + x)


set_int_sum = set_signed_sum


def limit(v, n) -> Column:
    """The first elements of an array."""
    return F.slice(col(v), 1, F.least(col(n).cast("int"), F.size(col(v))))


# -- aggregates ------------------------------------------------------------------
def _count(x=None) -> Column:
    return F.count(F.lit(1)) if x is None else F.count(col(x))


def _int_avg(x) -> Column:
    """Truncated towards zero."""
    total, n = F.sum(col(x)), F.count(col(x))
    return F.when(n > 0, F.call_function("div", total, n))


_AGGREGATES = {
    "any": lambda x: F.some(col(x)), "some": lambda x: F.some(col(x)), "every": lambda x: F.every(col(x)), "count": _count, "min": lambda x: F.min(col(x)), "max": lambda x: F.max(col(x)),
    "sum_signed": lambda x: F.sum(col(x)), "sum_int": lambda x: F.sum(col(x)), "sum_double": lambda x: F.sum(col(x).cast("double")), "sum_float": lambda x: F.sum(col(x).cast("float")).cast("float"),
    "avg_signed": _int_avg, "avg_int": _int_avg, "avg_double": lambda x: F.avg(col(x).cast("double")), "avg_float": lambda x: F.avg(col(x).cast("float")).cast("float"),
}
for _n, _f in _AGGREGATES.items():
    globals()[f"agg_{_n}_R"] = globals()[f"agg_{_n}_N"] = _f


def _finish(kind: str):
    def finish(total, n) -> Column:
        """An average from a sum and a count; null for none."""
        quotient = F.call_function("div", col(total), F.nullif(col(n), F.lit(0))) if kind in ("signed", "int") else F.try_divide(col(total), col(n)).cast(kind)
        return quotient

    return finish


for _n in ("signed", "int", "double", "float"):
    globals()[f"avg_{_n}_R"] = globals()[f"avg_{_n}_N"] = _finish(_n)
