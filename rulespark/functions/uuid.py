"""UUIDs, as their text in lower case with hyphens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions.std import col, python_function

NAMESPACES = {"DNS": "6ba7b810-9dad-11d1-80b4-00c04fd430c8", "URL": "6ba7b811-9dad-11d1-80b4-00c04fd430c8", "OID": "6ba7b812-9dad-11d1-80b4-00c04fd430c8", "X500": "6ba7b814-9dad-11d1-80b4-00c04fd430c8"}


def nil() -> Column:
    return F.lit("00000000-0000-0000-0000-000000000000")


def _namespace(name: str):
    return lambda: F.lit(NAMESPACES[name])


nAMESPACE_DNS, nAMESPACE_URL, nAMESPACE_OID, nAMESPACE_X500 = map(_namespace, ("DNS", "URL", "OID", "X500"))


def _hyphened(digits: Column) -> Column:
    return F.regexp_replace(F.lower(digits), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def new_v5(namespace, name) -> Column:
    """From the SHA-1 of a namespace and a name."""
    space = F.unhex(F.replace(col(namespace), F.lit("-"), F.lit("")))
    digest = F.sha1(F.concat(space, F.encode(col(name), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return _hyphened(F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15)))


def parse_str(s) -> Column:
    """Of text with or without hyphens, braces or the urn prefix; else null."""
    digits = F.regexp_replace(F.lower(col(s)), r"^urn:uuid:|[{}-]", "")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), _hyphened(digits))


def from_bytes(b) -> Column:
    return F.when(F.octet_length(col(b)) == 16, _hyphened(F.hex(col(b))))


def to_hyphenated_lower(u) -> Column:
    return F.lower(col(u))


def to_hyphenated_upper(u) -> Column:
    return F.upper(col(u))


def to_simple_lower(u) -> Column:
    return F.replace(F.lower(col(u)), F.lit("-"), F.lit(""))


def to_simple_upper(u) -> Column:
    return F.upper(to_simple_lower(u))


def to_urn_lower(u) -> Column:
    return F.concat(F.lit("urn:uuid:"), F.lower(col(u)))


def to_urn_upper(u) -> Column:
    return F.concat(F.lit("urn:uuid:"), F.upper(col(u)))


def is_nil(u) -> Column:
    return col(u) == nil()


@python_function("string")
def as_u128(u):
    """As decimal text."""
    return None if u is None else str(int(u.replace("-", ""), 16))


@python_function("string")
def to_u128_le(u):
    return None if u is None else str(int.from_bytes(bytes.fromhex(u.replace("-", "")), "little"))


@python_function("string")
def from_u128(x):
    import uuid

    return None if x is None else str(uuid.UUID(int=int(x)))


@python_function("string")
def from_u128_le(x):
    import uuid

    return None if x is None else str(uuid.UUID(bytes=int(x).to_bytes(16, "little")))
