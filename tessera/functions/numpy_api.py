"""Module-level functions by NumPy's names: reductions and element-wise functions of matrices."""

from __future__ import annotations

from ..operators import BandMatrix
from ..operators.elementwise import apply
from .ufuncs import BINARY, UNARY


def _reduction(name: str):
    def f(m: BandMatrix, axis=None, banded_only: bool = False, **other):
        if other:
            raise ValueError(f"{', '.join(other)} not supported")
        return getattr(m, name)(axis, banded_only)

    f.__name__ = name
    return f


def clip(m: BandMatrix, low=None, high=None) -> BandMatrix:
    return m.clip(low, high)


REDUCTIONS = {name: _reduction(name) for name in ("sum", "prod", "min", "max", "mean", "var", "std", "ptp", "all", "any")}
FUNCTIONS = REDUCTIONS | {"clip": clip}


def register_array_function(func, name: str) -> None:
    """Make ``func(matrix, ...)`` available under a name."""
    FUNCTIONS[name] = func


def call(name: str, *args, **kwargs):
    """A registered function, or an element-wise one of one or two operands."""
    if name in FUNCTIONS:
        return FUNCTIONS[name](*args, **kwargs)
    if name not in UNARY and name not in BINARY:
        raise ValueError(f"no function {name}")
    if kwargs:
        raise ValueError("axis, keepdims and dtype are not supported here")
    return apply(name, *args)
