"""Floating-point functions, for single (``_f``) and double (``_d``) precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions.std import col


def _trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


#: half away from zero
def _round(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


_UNARY = {
    "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"), "round": _round, "trunc": _trunc, "fract": lambda x: x - _trunc(x), "abs": F.abs,
    "signum": lambda x: F.when(F.isnan(x), x).when(x >= 0, 1.0).otherwise(-1.0), "sqrt": lambda x: F.when(x < 0, F.lit(float("nan"))).otherwise(F.sqrt(x)), "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), x),
    "ln": F.ln, "log2": F.log2, "log10": F.log10, "cbrt": F.cbrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "recip": lambda x: F.try_divide(F.lit(1.0), x), "to_degrees": F.degrees, "to_radians": F.radians, "is_nan": F.isnan,
    "is_infinite": lambda x: F.abs(x) == float("inf"), "is_finite": lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")),
}
_BINARY = {"atan2": F.atan2, "powi": F.pow, "powf": F.pow, "log": lambda x, base: F.ln(x) / F.ln(base)}
_LOGICAL = {"is_nan", "is_infinite", "is_finite"}


def _made(name: str, f, kind: str):
    def call(*xs) -> Column:
        out = f(*(col(x).cast("double") for x in xs))
        return out if name in _LOGICAL else out.cast(kind)

    call.__name__ = name
    return call


for _suffix, _kind in (("f", "float"), ("d", "double")):
    for _n, _f in {**_UNARY, **_BINARY, "mul_add": lambda x, a, b: x * a + b}.items():
        globals()[f"{_n}_{_suffix}"] = _made(_n, _f, _kind)


def nan_d() -> Column:
    return F.lit(float("nan"))


def nan_f() -> Column:
    return F.lit(float("nan")).cast("float")


def int_from_d(x) -> Column:
    """The whole part; no value for what is not a number."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), _trunc(x).try_cast("decimal(38,0)"))


int_from_f = int_from_d


def parse_d(s) -> Column:
    return col(s).try_cast("double")


def parse_f(s) -> Column:
    return col(s).try_cast("float")
