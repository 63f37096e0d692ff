"""Operators on banded matrices."""

from . import elementwise, indexing, reductions
from .matrix import BandMatrix

__all__ = ["BandMatrix", "elementwise", "indexing", "reductions"]
