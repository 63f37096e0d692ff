"""Python's and NumPy's ways into a matrix: brackets, iteration, ``np.add(a, b)``, ``np.sum(m, axis="diag")``.

Brackets read; ``put`` is the assignment, and returns a new matrix. What is read
is a DataFrame for all matrices of the object, or a matrix for a square slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .elementwise import apply, divmod_, keep_where
from .matrix import KEY, BandMatrix


def _span(x: int | slice, n: int) -> range:
    if isinstance(x, slice):
        if (x.start or 0) < 0 or (x.stop is not None and x.stop < 0) or (x.step or 1) < 1:
            raise ValueError("negative slice bounds or steps")
        return range(*x.indices(n))
    return range(int(x), int(x) + 1)


def _points(m: BandMatrix, rows, cols, values=None) -> DataFrame:
    """Lists of rows and columns, one of which may be a single number, for every matrix, in order of ``place``."""
    rows, cols = np.broadcast_arrays(np.asarray(rows, dtype=int).ravel(), np.asarray(cols, dtype=int).ravel())
    values = [None] * len(rows) if values is None else np.broadcast_to(np.asarray(values, dtype=float).ravel(), rows.shape).tolist()
    data = [(k, int(r), int(c), v) for k, (r, c, v) in enumerate(zip(rows, cols, values, strict=True))]
    points = m.cells.sparkSession.createDataFrame(data, "place int, row int, col int, value double")
    return m.meta.select("chrom").crossJoin(F.broadcast(points))  # as many rows as were asked for, for each matrix


def get(m: BandMatrix, key) -> DataFrame | BandMatrix:
    """m[i, j], m[a:b], m[a:b, c:d], m[[..], [..]] or m[condition], where condition is a matrix of truth values."""
    if isinstance(key, BandMatrix):
        return m.where(key.band().where("v = 1"))
    rows, cols = key if isinstance(key, tuple) else (key, key)
    if isinstance(rows, slice) or isinstance(cols, slice):
        n = len(m)
        r, c = _span(rows, n), _span(cols, n)
        if isinstance(rows, slice) and isinstance(cols, slice) and r == c and r.step == 1:
            return m.submatrix(r.start, r.stop)
        return m.rectangle(r, c)
    return m.get_values(_points(m, rows, cols).drop("value"))


def put(m: BandMatrix, key, value) -> BandMatrix:
    """A new matrix with other values at what ``get`` would read: a number, or a flat list in row order for lists and slices."""
    if isinstance(key, BandMatrix):
        hit = key.band().where("v = 1").select(*KEY)
        return m.set_values(hit.select("chrom", F.col("i").alias("row"), (F.col("i") + F.col("k")).alias("col"), F.lit(float(value)).alias("value")))
    rows, cols = key if isinstance(key, tuple) else (key, key)
    if isinstance(rows, slice) or isinstance(cols, slice):
        n = len(m)
        r, c = np.meshgrid(_span(rows, n), _span(cols, n), indexing="ij")
        return m.set_values(_points(m, r, c, value))
    return m.set_values(_points(m, rows, cols, value))


def iterate(df: DataFrame, by: str) -> Iterator[tuple[str, int, list]]:
    """(chrom, number, values) one after the other; the driver holds one partition at a time."""
    for r in df.orderBy("chrom", by).toLocalIterator():
        yield r["chrom"], r[by], r["values"]


def array_ufunc(self, ufunc, method, *inputs, **kwargs):
    if method != "__call__":
        return NotImplemented
    where = kwargs.pop("where", None)
    if kwargs or not (where is None or isinstance(where, BandMatrix)):
        raise ValueError(f"{', '.join(kwargs) or 'where= of this type'} not supported")
    if where is not None:
        done = array_ufunc(self, ufunc, method, *inputs)
        first = next(x for x in inputs if isinstance(x, BandMatrix))
        return done if done is NotImplemented else tuple(keep_where(r, first, where) for r in done) if isinstance(done, tuple) else keep_where(done, first, where)
    if not all(isinstance(x, (BandMatrix, int, float, np.number)) for x in inputs):
        return NotImplemented
    x = [float(v) if isinstance(v, np.number) else v for v in inputs]
    name = ufunc.__name__
    try:
        if name == "divmod":
            return divmod_(*x)
        if len(x) == 1:
            return apply(name, x[0])
        return apply(name, *x) if isinstance(x[0], BandMatrix) else apply(name, x[1], x[0], reverse=True)
    except KeyError:
        return NotImplemented


def array_function(self, func, types, args, kwargs):
    from ..functions import numpy_api

    f = numpy_api.FUNCTIONS.get(getattr(func, "__name__", ""))
    if f is None:
        return NotImplemented
    return f(*args, **{k: v for k, v in kwargs.items() if v is not np._NoValue})


def _install() -> None:
    for name, number in (("count_masked", "masked"), ("count_unmasked", "unmasked"), ("count_in_band_masked", "in_band_masked"), ("count_out_band_masked", "out_band_masked"), ("count_in_band", "in_band"), ("count_out_band", "out_band")):
        setattr(BandMatrix, name, lambda self, _c=number: self.counts().select("chrom", F.col(_c).alias("value")))
    BandMatrix.__getitem__ = get
    BandMatrix.put = put
    BandMatrix.__iter__ = lambda self: iterate(self.diagonals(), "k")
    BandMatrix.iterrows = BandMatrix.itercols = lambda self: iterate(self.full_rows(), "i")
    BandMatrix.__contains__ = lambda self, x: any(r["found"] for r in self.contains(float(x)).collect())
    BandMatrix.copy = lambda self: BandMatrix(self.cells, self.meta, self.bins)  # nothing is ever changed in place
    BandMatrix.__array_ufunc__ = array_ufunc
    BandMatrix.__array_function__ = array_function


def set_mask(m: BandMatrix, mask: DataFrame) -> BandMatrix:
    """Replace the element mask by ``mask(chrom, i, k)``; masked bins stay."""
    at = mask.select("chrom", F.col("i").alias("row"), (F.col("i") + F.col("k")).alias("col"))
    return m.drop_mask().add_mask(at)


BandMatrix.set_mask = set_mask
_install()


def assert_equal(a: BandMatrix, b: BandMatrix) -> None:
    """Raise if any matrix of the two objects differs in size, default, masks or unmasked values."""
    wrong = [r["chrom"] for r in a.equals(b).collect() if not r["equal"]]
    if wrong:
        raise AssertionError(f"different: {', '.join(wrong)}")
