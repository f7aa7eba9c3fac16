"""Strings. Lengths and offsets are bytes of UTF-8. Interned strings are plain ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions.std import col


def len(s) -> Column:  # noqa: A001
    return F.octet_length(col(s))


def concat(*parts) -> Column:
    return F.concat(*(col(p).cast("string") for p in parts))


def contains(s, part) -> Column:
    return F.contains(col(s), col(part))


def starts_with(s, prefix) -> Column:
    return F.startswith(col(s), col(prefix))


def ends_with(s, suffix) -> Column:
    return F.endswith(col(s), col(suffix))


def join(parts, separator) -> Column:
    return F.array_join(col(parts), separator) if isinstance(separator, str) else F.concat_ws("", F.transform(col(parts), lambda x, i: F.when(i == 0, x).otherwise(F.concat(col(separator), x))))


def split(s, separator) -> Column:
    """At each place of the literal separator."""
    return F.split(col(s), F.concat(F.lit("\\Q"), col(separator), F.lit("\\E")), -1)


def replace(s, old, new) -> Column:
    return F.replace(col(s), col(old), col(new))


def substr(s, start, end) -> Column:
    """Bytes [start, end), both cut to the string."""
    data = F.encode(col(s), "UTF-8")
    size = F.octet_length(col(s))
    a, b = F.least(col(start).cast("int"), size), F.least(col(end).cast("int"), size)
    return F.decode(F.substring(data, a + 1, F.greatest(b - a, F.lit(0))), "UTF-8")


def trim(s) -> Column:
    return F.regexp_replace(col(s), r"(?U)^\s+|\s+$", "")


def to_lowercase(s) -> Column:
    return F.lower(col(s))


def to_uppercase(s) -> Column:
    return F.upper(col(s))


def reverse(s) -> Column:
    return F.reverse(col(s))


def to_bytes(s) -> Column:
    data = F.encode(col(s), "UTF-8")
    n = F.octet_length(col(s))
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int"))
    return F.when(n > 0, each).otherwise(F.array().cast("array<int>"))


def from_utf8(data) -> Column:
    """A result: the text of an array of bytes, or an error."""
    joined = F.unhex(F.array_join(F.transform(col(data), lambda b: F.lpad(F.hex(b), 2, "0")), ""))
    good = F.is_valid_utf8(joined.cast("string"))
    return F.struct(F.when(good, F.decode(joined, "UTF-8")).alias("ok"), F.when(~good, F.lit("invalid UTF-8")).alias("err"))


def encode_utf16(s) -> Column:
    text = F.hex(F.encode(col(s), "UTF-16BE"))
    n = (F.length(text) / 4).cast("int")
    units = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(text, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))
    return F.when(n > 0, units).otherwise(F.array().cast("array<int>"))


def from_utf16(units) -> Column:
    data = F.unhex(F.array_join(F.transform(col(units), lambda u: F.lpad(F.hex(u), 4, "0")), ""))
    return F.struct(F.decode(data, "UTF-16BE").alias("ok"), F.lit(None).cast("string").alias("err"))


def intern(s) -> Column:
    return col(s)


ival = string_intern = istring_str = intern


def istring_ord(s) -> Column:
    """A number for the string, the same for equal ones."""
    return F.hash(col(s))


def encode(data) -> Column:
    """Base64 of bytes."""
    return F.base64(col(data))


def decode(s) -> Column:
    """A result: bytes of base64 text, or an error."""
    good = F.try_to_binary(col(s), F.lit("base64"))
    return F.struct(good.alias("ok"), F.when(good.isNull(), F.lit("invalid base64")).alias("err"))


_NAMES = ("contains", "join", "len", "replace", "split", "starts_with", "ends_with", "substr", "to_bytes", "trim", "to_lowercase", "to_uppercase", "reverse")
for _prefix in ("string_", "istring_"):
    for _n in _NAMES:
        globals()[_prefix + _n] = globals()[_n]
str_to_lower = to_lowercase
