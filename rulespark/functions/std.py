"""Basic functions: optional values and results, integers, hashes, byte order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTHS = {"u8": 8, "u16": 16, "u32": 32, "u64": 64, "s8": 8, "s16": 16, "s32": 32, "s64": 64}


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def python_function(returns: str):
    """A function of single values in Python, sent in Arrow batches; only for
    what Spark has no expression for. Made when it is first used, as it needs a
    session."""

    def register(f: Callable) -> Callable[..., Column]:
        def call(*args) -> Column:
            return F.udf(f, returns, useArrow=True)(*map(col, args))

        call.__name__, call.__doc__ = f.__name__, f.__doc__
        return call

    return register


# -- optional values and results -------------------------------------------
def is_none(x) -> Column:
    return col(x).isNull()


def is_some(x) -> Column:
    return col(x).isNotNull()


def unwrap_or(x, default) -> Column:
    return F.coalesce(col(x), col(default))


def default(kind: str) -> Column:
    """The zero of a type."""
    zeros = {"string": "", "boolean": False, "double": 0.0, "float": 0.0}
    if kind.startswith("array"):
        return F.array().cast(kind)
    if kind.startswith("map"):
        return F.create_map().cast(kind)
    return F.lit(zeros.get(kind, 0)).cast(kind)


def unwrap_or_default(x, kind: str) -> Column:
    return F.coalesce(col(x), default(kind))


def map_option(x, f: Callable[[Column], Column]) -> Column:
    return F.when(col(x).isNotNull(), f(col(x)))


def and_then(x, f: Callable[[Column], Column]) -> Column:
    return map_option(x, f)


def ok(x) -> Column:
    return F.struct(col(x).alias("ok"), F.lit(None).cast("string").alias("err"))


def err(x, kind: str) -> Column:
    return F.struct(F.lit(None).cast(kind).alias("ok"), col(x).alias("err"))


def ok_or(x, error) -> Column:
    return F.struct(col(x).alias("ok"), F.when(col(x).isNull(), col(error)).alias("err"))


def ok_or_else(x, error: Callable[[], Column]) -> Column:
    return ok_or(x, error())


def is_ok(r: Column) -> Column:
    return r["err"].isNull()


def is_err(r: Column) -> Column:
    return r["err"].isNotNull()


def map_result(r: Column, f: Callable[[Column], Column]) -> Column:
    return F.struct(F.when(is_ok(r), f(r["ok"])).alias("ok"), r["err"].alias("err"))


def map_err(r: Column, f: Callable[[Column], Column]) -> Column:
    return F.struct(r["ok"].alias("ok"), F.when(is_err(r), f(r["err"])).alias("err"))


def result_unwrap_or(r: Column, default_value) -> Column:
    return F.when(is_ok(r), r["ok"]).otherwise(col(default_value))


def result_unwrap_or_default(r: Column, kind: str) -> Column:
    return F.when(is_ok(r), r["ok"]).otherwise(default(kind))


def to_set(x) -> Column:
    """An optional value as a set of none or one."""
    return F.when(col(x).isNull(), F.array()).otherwise(F.array(col(x)))


to_vec_option = to_set
option_unwrap_or, option_unwrap_or_default = unwrap_or, unwrap_or_default


def ref_new(x) -> Column:
    return col(x)


deref = to_any = ref_new


def from_any(x, kind: str) -> Column:
    return F.try_variant_get(col(x), "$", kind)


# -- integers ----------------------------------------------------------------
def wrap(x, kind: str) -> Column:
    """An integer of ``kind``: the low bits, as signed or unsigned. 64 unsigned
    bits are a decimal."""
    bits = WIDTHS[kind]
    if kind == "s64":
        return col(x).cast("long")
    low = F.pmod(col(x).cast("decimal(38,0)"), F.lit(str(2**bits)).cast("decimal(38,0)"))
    if kind[0] == "s":
        low = F.when(low >= 2 ** (bits - 1), low - 2**bits).otherwise(low)
    return low.cast("decimal(20,0)" if kind == "u64" else "long")


def pow32(base, exp, kind: str = "s64") -> Column:
    """Integer power, by squaring; wraps around as the type does. Exponents are
    below 2**32."""
    bits = WIDTHS[kind]
    if bits < 64:
        modulus = F.lit(2**bits).cast("decimal(38,0)")
        zero = F.struct(F.lit(1).cast("decimal(38,0)").alias("r"), F.pmod(col(base).cast("decimal(38,0)"), modulus).cast("decimal(38,0)").alias("b"))

        def step(s: Column, i: Column) -> Column:
            bit = F.pmod(F.floor(col(exp).cast("double") / F.pow(F.lit(2.0), i)), F.lit(2)) == 1
            r = F.when(bit, F.pmod((s["r"] * s["b"]).cast("decimal(38,0)"), modulus)).otherwise(s["r"])
            b = F.pmod((s["b"].cast("decimal(19,0)") * s["b"].cast("decimal(19,0)")).cast("decimal(38,0)"), modulus)
            return F.struct(r.cast("decimal(38,0)").alias("r"), b.cast("decimal(38,0)").alias("b"))

        if bits <= 32:
            return wrap(F.aggregate(F.sequence(F.lit(0), F.lit(31)), zero, step, lambda s: s["r"]), kind)
    return _pow64(col(base), col(exp), F.lit(kind))


@python_function("decimal(20,0)")
def _pow64(base, exp, kind):
    from decimal import Decimal

    if base is None or exp is None:
        return None
    x = pow(int(base), int(exp), 1 << 64)
    if kind[0] == "s" and x >= 1 << 63:
        x -= 1 << 64
    return Decimal(x)


def _pow_of(kind: str):
    return lambda base, exp: pow32(base, exp, kind)


u8_pow32, u16_pow32, u32_pow32, u64_pow32 = map(_pow_of, ("u8", "u16", "u32", "u64"))
s8_pow32, s16_pow32, s32_pow32, s64_pow32 = map(_pow_of, ("s8", "s16", "s32", "s64"))


@python_function("string")
def bigint_pow32(base, exp):
    """Of any size, as decimal text."""
    return None if base is None or exp is None else str(int(base) ** int(exp))


@python_function("string")
def _wide_pow(base, exp, signed):
    if base is None or exp is None:
        return None
    x = pow(int(base), int(exp), 1 << 128)
    return str(x - (1 << 128) if signed and x >= 1 << 127 else x)


def u128_pow32(base, exp) -> Column:
    return _wide_pow(col(base).cast("string"), col(exp), F.lit(False))


def s128_pow32(base, exp) -> Column:
    return _wide_pow(col(base).cast("string"), col(exp), F.lit(True))


def shift_left(x, n, kind: str = "u32") -> Column:
    return wrap(col(x).cast("decimal(10,0)") * F.pow(F.lit(2), col(n)).cast("decimal(20,0)"), kind)


def bits(x, high: int, low: int) -> Column:
    """The slice x[high:low]."""
    return F.shiftrightunsigned(col(x).cast("long"), low).bitwiseAND(F.lit((1 << (high - low + 1)) - 1))


def bit_concat(a, b, width: int) -> Column:
    """``a`` and then the ``width`` bits of ``b``."""
    return F.shiftleft(col(a).cast("long"), width).bitwiseOR(col(b).cast("long"))


def implies(a, b) -> Column:
    return ~col(a) | col(b)


def hex(x) -> Column:
    return F.lower(F.hex(col(x)))


def parse_dec_u64(s) -> Column:
    text = F.regexp_replace(col(s), r"^\+", "")
    number = text.try_cast("decimal(38,0)")
    return F.when(text.rlike(r"^[0-9]+$") & (number < F.lit(str(2**64)).cast("decimal(38,0)")), number.cast("decimal(20,0)"))


def parse_dec_i64(s) -> Column:
    return F.when(col(s).rlike(r"^[+-]?[0-9]+$"), col(s).try_cast("long"))


def range_vec(start, end, step: int = 1) -> Column:
    """From ``start`` up or down to, but without, ``end``."""
    last = col(end) - (1 if step > 0 else -1)
    some = col(start) < col(end) if step > 0 else col(start) > col(end)
    return F.when(some, F.sequence(col(start), last, F.lit(step))).otherwise(F.array().cast("array<bigint>"))


def min(a, b) -> Column:
    return F.least(col(a), col(b))


def max(a, b) -> Column:
    return F.greatest(col(a), col(b))


def to_string(x) -> Column:
    return col(x).cast("string")


def to_string_debug(x) -> Column:
    return F.to_json(F.struct(col(x).alias("v")))


__builtin_2string = to_string


# -- hashes and byte order -----------------------------------------------------
def hash32(x) -> Column:
    return F.hash(col(x)).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def hash64(x) -> Column:
    return F.xxhash64(col(x))


def hash128(x) -> Column:
    return F.md5(F.to_json(F.struct(col(x).alias("v"))))


def ntohs(x) -> Column:
    x = col(x).cast("int")
    return F.shiftleft(x.bitwiseAND(0xFF), 8).bitwiseOR(F.shiftright(x, 8).bitwiseAND(0xFF))


def ntohl(x) -> Column:
    x = col(x).cast("long")
    parts = [F.shiftleft(F.shiftright(x, 8 * i).bitwiseAND(F.lit(0xFF).cast("long")), 24 - 8 * i) for i in range(4)]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3])


htons, htonl = ntohs, ntohl


def udf(function: Callable, returns: str | T.DataType):
    """A function of the user, one Arrow batch at a time (pandas series)."""
    return F.pandas_udf(function, returns)
