"""Element-wise functions on matrices: a table of Column builders that follow NumPy on doubles.

Spark raises or gives NULL at many domain borders where NumPy gives infinities
or NaN, and treats NaN as the largest value; NULL means masked here and nothing
else, so these borders are spelled out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

NAN, INF = float("nan"), float("inf")


def _nan(*cs: Column) -> Column:
    out = F.isnan(cs[0])
    for c in cs[1:]:
        out = out | F.isnan(c)
    return out


def divide(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(_nan(a) | (a == 0), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def floor_divide(a: Column, b: Column) -> Column:
    q = divide(a, b)
    r = remainder(a, b)
    exact = F.when(_nan(q) | (F.abs(q) == INF), q).otherwise(F.rint((a - r) / F.when(b == 0, 1.0).otherwise(b)))
    return exact


def remainder(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    r = F.try_mod(a, b)
    return F.when(b == 0, NAN).when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def fmod(a: Column, b: Column) -> Column:
    return F.when(b == 0, NAN).otherwise(F.try_mod(a.cast("double"), b.cast("double")))


def _log(f: Callable[[Column], Column], at: float) -> Callable[[Column], Column]:
    """A logarithm that is -inf at ``at`` and NaN below."""

    def g(a: Column) -> Column:
        a = a.cast("double")
        return F.when(_nan(a) | (a < at), NAN).when(a == at, -INF).otherwise(f(a))

    return g


def _logaddexp(f: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    def g(a: Column, b: Column) -> Column:
        return F.when(_nan(a, b), NAN).when(a == b, a + f(F.lit(0.0))).otherwise(F.greatest(a, b) + f(-F.abs(a - b)))

    return g


def _compare(f: Callable[[Column, Column], Column], if_nan: bool) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(_nan(a, b), F.lit(if_nan)).otherwise(f(a, b))


def _integer_udf(f: Callable) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(LongType())
    def g(a: pd.Series, b: pd.Series) -> pd.Series:
        ok = a.notna() & b.notna()
        out = pd.Series(pd.array([None] * len(a), dtype="Int64"))
        out[ok.to_numpy()] = f(a[ok].to_numpy(dtype=np.int64), b[ok].to_numpy(dtype=np.int64))
        return out

    return lambda a, b: g(a.cast("long"), b.cast("long"))


def _shift(left: bool) -> Callable[[Column, Column], Column]:
    def g(a: Column, b: Column) -> Column:
        a, n = a.cast("long"), b.cast("int")
        wide = F.lit(0).cast("long") if left else F.when(a < 0, -1).otherwise(0).cast("long")
        return F.when((n >= 64) | (n < 0), wide).otherwise(F.call_function("shiftleft" if left else "shiftright", a, n))

    return g


def _truth(c: Column) -> Column:
    return c.cast("double") != 0


def _long(c: Column) -> Column:
    return c.cast("long")


def _d(c: Column) -> Column:
    return c.cast("double")


UNARY: dict[str, Callable[[Column], Column]] = {
    "negative": lambda a: -a,
    "positive": lambda a: a,
    "absolute": F.abs,
    "fabs": lambda a: F.abs(_d(a)),
    "rint": lambda a: F.rint(_d(a)),
    "sign": lambda a: F.when(_nan(a), NAN).otherwise(F.signum(_d(a))),
    "conj": lambda a: a,
    "conjugate": lambda a: a,
    "exp": F.exp,
    "exp2": lambda a: F.pow(F.lit(2.0), a),
    "log": _log(F.ln, 0),
    "log2": _log(F.log2, 0),
    "log10": _log(F.log10, 0),
    "expm1": F.expm1,
    "log1p": _log(F.log1p, -1),
    "sqrt": lambda a: F.sqrt(_d(a)),
    "square": lambda a: a * a,
    "cbrt": lambda a: F.cbrt(_d(a)),
    "reciprocal": lambda a: divide(F.lit(1.0), a),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "arcsin": F.asin,
    "arccos": F.acos,
    "arctan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "arcsinh": F.asinh,
    "arccosh": F.acosh,
    "arctanh": F.atanh,
    "degrees": F.degrees,
    "rad2deg": F.degrees,
    "radians": F.radians,
    "deg2rad": F.radians,
    "invert": lambda a: F.bitwise_not(_long(a)),
    "floor": lambda a: F.when(_nan(a) | (F.abs(a) >= 2.0**53), _d(a)).otherwise(_d(F.floor(a))),
    "ceil": lambda a: F.when(_nan(a) | (F.abs(a) >= 2.0**53), _d(a)).otherwise(_d(F.ceil(a))),
    "trunc": lambda a: F.when(_nan(a) | (F.abs(a) >= 2.0**53), _d(a)).when(a < 0, _d(F.ceil(a))).otherwise(_d(F.floor(a))),
    "logical_not": lambda a: ~_truth(a),
}

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": divide,
    "true_divide": divide,
    "logaddexp": _logaddexp(lambda x: F.log1p(F.exp(x))),
    "logaddexp2": _logaddexp(lambda x: F.log1p(F.pow(F.lit(2.0), x)) / math.log(2)),
    "floor_divide": floor_divide,
    "power": lambda a, b: F.pow(_d(a), _d(b)),
    "float_power": lambda a, b: F.pow(_d(a), _d(b)),
    "remainder": remainder,
    "mod": remainder,
    "fmod": fmod,
    "heaviside": lambda a, b: F.when(_nan(a), NAN).when(a < 0, 0.0).when(a > 0, 1.0).otherwise(_d(b)),
    "gcd": _integer_udf(np.gcd),
    "lcm": _integer_udf(np.lcm),
    "arctan2": F.atan2,
    "hypot": F.hypot,
    "bitwise_and": lambda a, b: _long(a).bitwiseAND(_long(b)),
    "bitwise_or": lambda a, b: _long(a).bitwiseOR(_long(b)),
    "bitwise_xor": lambda a, b: _long(a).bitwiseXOR(_long(b)),
    "left_shift": _shift(True),
    "right_shift": _shift(False),
    "greater": _compare(lambda a, b: a > b, False),
    "greater_equal": _compare(lambda a, b: a >= b, False),
    "less": _compare(lambda a, b: a < b, False),
    "less_equal": _compare(lambda a, b: a <= b, False),
    "not_equal": _compare(lambda a, b: a != b, True),
    "equal": _compare(lambda a, b: a == b, False),
    "logical_and": lambda a, b: _truth(a) & _truth(b),
    "logical_or": lambda a, b: _truth(a) | _truth(b),
    "logical_xor": lambda a, b: _truth(a) != _truth(b),
    "maximum": lambda a, b: F.when(_nan(a, b), NAN).otherwise(F.greatest(a, b)),
    "minimum": lambda a, b: F.when(_nan(a, b), NAN).otherwise(F.least(a, b)),
}
