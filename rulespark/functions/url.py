"""URLs, as text; what is no URL gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions.std import col, python_function

PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}


def url_parse(s) -> Column:
    return F.when(col(s).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), col(s))


url_to_string = url_parse


def scheme(u) -> Column:
    return F.lower(F.regexp_extract(col(u), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def has_authority(u) -> Column:
    return col(u).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")


def cannot_be_a_base(u) -> Column:
    return ~col(u).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:/")


_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:([^/?#@:]*)(?::([^/?#@]*))?@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?"


def _part(u, i: int) -> Column:
    return F.regexp_extract(col(u), _AUTHORITY, i)


def username(u) -> Column:
    return _part(u, 1)


def password(u) -> Column:
    return F.nullif(_part(u, 2), F.lit(""))


def host_str(u) -> Column:
    return F.nullif(F.lower(_part(u, 3)), F.lit(""))


def has_host(u) -> Column:
    return host_str(u).isNotNull()


def domain(u) -> Column:
    """The host, if it is a name."""
    return F.when(~host_str(u).rlike(r"^(\[.*\]|\d+\.\d+\.\d+\.\d+)$"), host_str(u))


def port(u) -> Column:
    given = _part(u, 4).try_cast("int")
    return F.when(given != F.coalesce(_known(u), F.lit(-1)), given)


def _known(u) -> Column:
    out = F.lit(None).cast("int")
    for name, n in PORTS.items():
        out = F.when(scheme(u) == name, n).otherwise(out)
    return out


def port_or_known_default(u) -> Column:
    return F.coalesce(port(u), _known(u))


def path(u) -> Column:
    rest = F.regexp_extract(col(u), r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)
    return F.when((rest == "") & has_authority(u), "/").otherwise(rest)


def query(u) -> Column:
    return F.when(col(u).rlike(r"^[^#]*\?"), F.regexp_extract(col(u), r"^[^#?]*\?([^#]*)", 1))


def fragment(u) -> Column:
    return F.when(F.contains(col(u), F.lit("#")), F.regexp_extract(col(u), r"#(.*)$", 1))


@python_function("string")
def join(base, reference):
    from urllib.parse import urljoin

    return None if base is None or reference is None else urljoin(base, reference)
