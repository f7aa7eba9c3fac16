"""JSON, as text or as Spark variants (``value``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions.std import col, python_function


def from_json_string(s, schema: str) -> Column:
    """A result: a value of ``schema``, or an error."""
    value = F.from_json(col(s), schema)
    good = F.try_parse_json(col(s)).isNotNull()
    return F.struct(F.when(good, value).alias("ok"), F.when(~good, F.lit("invalid JSON")).alias("err"))


def to_json_string(x) -> Column:
    return F.to_json(col(x))


def from_json_value(v, schema: str) -> Column:
    return from_json_string(F.to_json(col(v)), schema)


def to_json_value(x) -> Column:
    return F.parse_json(F.to_json(col(x)))


def parse(s) -> Column:
    return F.try_parse_json(col(s))


_from_json_string, _from_json_value = from_json_string, from_json_value


def _kind(v) -> Column:
    return F.schema_of_variant(col(v))


def as_bool(v) -> Column:
    return F.when(_kind(v) == "BOOLEAN", F.try_variant_get(col(v), "$", "boolean"))


def as_number(v) -> Column:
    return F.when(_kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(col(v), "$", "double"))


def as_string(v) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(col(v), "$", "string"))


def as_array(v) -> Column:
    return F.try_variant_get(col(v), "$", "array<variant>")


def as_object(v) -> Column:
    return F.try_variant_get(col(v), "$", "map<string,variant>")


def get(v, name: str) -> Column:
    return F.try_variant_get(col(v), f"$['{name}']", "variant")


def get_or(v, name: str, default) -> Column:
    return F.coalesce(get(v, name), col(default))


def get_by_ptr(v, pointer: str) -> Column:
    """By a pointer like /a/0/b; "" is the whole value."""
    path = "$"
    for part in pointer.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        path += f"[{part}]" if part.isdigit() else f"['{part}']"
    return F.try_variant_get(col(v), path, "variant")


@python_function("string")
def _set_text(text, pointer, value):
    import json

    if text is None:
        return None
    root = json.loads(text)
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    new = json.loads(value)
    if not parts:
        return json.dumps(new)
    node = root
    try:
        for p in parts[:-1]:
            node = node[int(p)] if isinstance(node, list) else node[p]
        if isinstance(node, list):
            node[int(parts[-1])] = new
        elif parts[-1] in node:
            node[parts[-1]] = new
        else:
            return None
    except (KeyError, IndexError, ValueError, TypeError):
        return None
    return json.dumps(root)


def set_by_ptr(v, pointer: str, value) -> Column:
    """The value with another one at the pointer; none if nothing is there."""
    return F.parse_json(_set_text(F.to_json(col(v)), F.lit(pointer), F.to_json(col(value))))


get_by_ptr_, set_by_ptr_ = get_by_ptr, set_by_ptr


def _or(f):
    return lambda v, default: F.coalesce(f(v), col(default))


as_bool_or, as_number_or, as_string_or, as_array_or, as_object_or = map(_or, (as_bool, as_number, as_string, as_array, as_object))
for _n in ("as_bool", "as_number", "as_string", "as_array", "as_object", "as_bool_or", "as_number_or", "as_string_or", "as_array_or", "as_object_or", "get", "get_or"):
    globals()["jval_" + _n] = globals()[_n]
